"""Hard negatives by threshold joins with norm bounds (after L2AP).

Anchors meet all rows in blocks: anchors are dealt to sets, rows to strips, and each (set, strip) is one unit of work, so
that no task holds more than ANCHORS anchors and STRIP rows (both dealt by hash, hence even). Rows go once to each set of
anchors, which are few; anchors once to each strip.

A unit sorts the dimensions by weight and builds an inverted index of its rows: a row's last dimensions, as far as their
norm alone can't bring any anchor of the set to its threshold, are left out. Partial scores are accumulated dimension by
dimension; a pair is dropped once its score so far and the product of the norms that remain can't reach the anchor's
threshold. What is left is finished with the dimensions left out, so that every score is exact.

For each anchor and positive, negatives lie in a window of scores. The threshold starts just below the window's upper
end and is lowered, round by round, for the anchors whose windows aren't full yet, down to the windows' lower end. A
window that has its negatives is complete: whatever scores less ranks behind.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows with
one id the first by label, then by vector, counts; vectors of fewer dimensions count as if zeros followed; ties go to the
smaller id; an anchor without positives and a positive without negatives give no rows; an empty table gives no rows;
further columns are ignored. Scores are exact while they stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, shuffle_partitions, small_batches, spill, table

#: Anchors of a set and rows of a strip, on average (bounds a task's memory, not the result).
ANCHORS, STRIP = 8192, 16_384
#: A window's share, from its lower end, that a round's threshold leaves out.
LOWERED = (0.97, 0.85, 0.5, 0.0)
#: Anchors and rows scored at once, and dimensions between two prunings.
TILE_ANCHORS, TILE_ROWS, STEP = 256, 8192, 8
#: A tile with a smaller share of living pairs is finished pair by pair.
SPARSE = 0.1


def vectors(cells: list[bytes]) -> np.ndarray:
    """Vectors of little-endian doubles as rows of a matrix, shorter ones filled with zeros."""
    flat = [np.frombuffer(c, "<f8") for c in cells]
    d = max((len(v) for v in flat), default=0)
    out = np.zeros((len(flat), max(d, 1)))
    for k, v in enumerate(flat):
        out[k, : len(v)] = v
    return out


def taken(rows: DataFrame) -> DataFrame:
    """vec_id, label, vec (floor(256 x) of each component, as bytes) of the rows that take part, one per id."""

    def run(batches):
        for b in batches:
            out = []
            for v in b["embedding"]:
                x = np.asarray(v, dtype=object) if v is not None else None
                x = None if x is None or any(c is None for c in x) else np.asarray(v, dtype=np.float64)
                out.append(np.floor(256 * x).astype("<f8").tobytes() if x is not None and np.isfinite(256 * x).all() else None)
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "vec": pd.Series(out, dtype=object)})

    known = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    known = known.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    out = known.mapInPandas(run, "vec_id long, label long, vec binary").filter("vec IS NOT NULL")
    return out.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def threshold_join(q: np.ndarray, floor: np.ndarray, y: np.ndarray):
    """Yields (anchor positions, row positions, scores) of all pairs with score >= floor[anchor], tile by tile."""
    d = max(q.shape[1], y.shape[1])
    q, y = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (q, y))
    order = np.argsort(-np.square(y).sum(axis=0), kind="stable")
    q, y = q[:, order], y[:, order]
    tail_q, tail_y = (np.sqrt(np.concatenate([np.cumsum(np.square(m[:, ::-1]), axis=1)[:, ::-1], np.zeros((len(m), 1))], axis=1)) for m in (q, y))
    for a in range(0, len(q), TILE_ANCHORS):
        qa, fa, ta = q[a : a + TILE_ANCHORS], floor[a : a + TILE_ANCHORS], tail_q[a : a + TILE_ANCHORS]
        # the index: a row's dimensions up to where what follows reaches no anchor's threshold
        norm = ta[:, 0]
        least = np.min(np.where(norm > 0, fa / np.maximum(norm, 1e-300), np.where(fa > 0, np.inf, 0)))
        indexed = (tail_y[:, :d] * (1 + 1e-9) + 1e-6 >= least).sum(axis=1) if least > 0 else np.full(len(y), d)
        listed = np.argsort(-indexed, kind="stable")
        listed = listed[: int((indexed > 0).sum())]  # rows without an indexed dimension are nobody's candidates
        for r in range(0, len(listed), TILE_ROWS):
            row = listed[r : r + TILE_ROWS]
            yield from _tile(qa, fa, ta, y[row], tail_y[row], indexed[row], a, row)


def _tile(q, floor, tail_q, y, tail_y, indexed, a, row):
    d = q.shape[1]
    score, live = np.zeros((len(q), len(y))), np.ones((len(q), len(y)), dtype=bool)
    columns = np.ascontiguousarray(y.T)  # dimension by dimension: the lists of the index, longest rows first
    for lo in range(0, d, STEP):
        hi = min(d, lo + STEP)
        n = int((indexed > lo).sum())  # rows that still have indexed dimensions
        if not n:
            break
        score[:, :n] += q[:, lo:hi] @ columns[lo:hi, :n]
        done = np.minimum(-(-indexed // STEP) * STEP, d)
        done[:n] = hi
        live &= score + tail_q[:, done] * tail_y[np.arange(len(y)), done] * (1 + 1e-9) + 1e-3 >= floor[:, None]
        if live[:, :n].mean() < SPARSE:
            break
    i, j = np.nonzero(live)
    if not len(i):
        return
    s = score[i, j]
    at = np.minimum(np.where(np.arange(len(y)) < n, hi, -(-indexed // STEP) * STEP), d)[j]  # dimensions summed so far
    for lo in range(0, d, STEP):
        k = np.flatnonzero(at <= lo)
        if len(k):
            s[k] += np.einsum("ij,ij->i", q[i[k], lo : lo + STEP], y[j[k], lo : lo + STEP])
            keep = np.ones(len(i), dtype=bool)
            left = min(d, lo + STEP)
            keep[k] = s[k] + tail_q[i[k], left] * tail_y[j[k], left] * (1 + 1e-9) + 1e-3 >= floor[i[k]]
            i, j, s, at = i[keep], j[keep], s[keep], at[keep]
    keep = s >= floor[i]
    yield a + i[keep], row[j[keep]], s[keep].astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first `most` of each group: higher scores, then smaller ids."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < most]


def _dealt(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(name), key), F.lit(n)).cast("int"))


def _units(anchors: DataFrame, rows: DataFrame, sets: int, strips: int, *more: str):
    """Anchors and rows grouped by (set, strip): each anchor goes to every strip, each row to every set."""
    a = _dealt(anchors, "vec_id", sets, "set").withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    r = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # both come from one table
    r = _dealt(r, "vec_id", strips, "strip").withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    return a.groupBy(*more, "set", "strip").cogroup(r.groupBy(*more, "set", "strip"))


def positives(anchors: DataFrame, rows: DataFrame, sets: int, strips: int, most: int) -> DataFrame:
    """vec_id, positive_id, positive_score, at most `most` per anchor: its first other rows of the same label."""

    def top(a, r):
        none = pd.DataFrame({"vec_id": pd.Series(dtype="int64"), "positive_id": pd.Series(dtype="int64"), "positive_score": pd.Series(dtype="int64")})
        if not len(a) or not len(r):
            return none
        q, y, own, ids = vectors(a["vec"]), vectors(r["vec"]), a["vec_id"].to_numpy(), r["vec_id"].to_numpy()
        floor = np.full(len(q), -np.inf)
        held = [np.zeros(0, dtype=np.int64)] * 3
        for lo in range(0, len(y), TILE_ROWS):
            for i, j, s in threshold_join(q, floor, y[lo : lo + TILE_ROWS]):
                other = own[i] != ids[lo + j]
                held = [np.concatenate([x, v]) for x, v in zip(held, (i[other], s[other], ids[lo + j[other]]))]
                k = best(*held, most)
                held = [x[k] for x in held]
            n = np.bincount(held[0], minlength=len(q))
            full = np.flatnonzero(n >= most)  # the last one kept is the threshold from now on
            floor[full] = -np.inf
            np.minimum.at(least := np.full(len(q), np.inf), held[0], held[1])
            floor[full] = least[full]
        return pd.DataFrame({"vec_id": own[held[0]], "positive_id": held[2], "positive_score": held[1]})

    found = _units(anchors, rows, sets, strips, "label").applyInPandas(top, "vec_id long, positive_id long, positive_score long")
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("k", rank).filter(F.col("k") <= most).drop("k")


def negatives(anchors: DataFrame, rows: DataFrame, sets: int, strips: int, most: int) -> DataFrame:
    """anchors: vec_id, label, vec, windows (positive_id, low, high, from). Per window at most `most` rows of another label
    with from <= score <= high: vec_id, positive_id, negative_id, negative_score."""

    def top(a, r):
        none = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("vec_id", "positive_id", "negative_id", "negative_score")})
        if not len(a) or not len(r):
            return none
        q, y, own, ids = vectors(a["vec"]), vectors(r["vec"]), a["vec_id"].to_numpy(), r["vec_id"].to_numpy()
        label_a, label_r = a["label"].to_numpy(), r["label"].to_numpy()
        size = np.array([len(w) for w in a["windows"]])
        flat = [w for ws in a["windows"] for w in ws]
        high, start, positive = (np.array([w[c] for w in flat], dtype=np.int64) for c in ("high", "start", "positive_id"))
        first = np.concatenate([[0], np.cumsum(size)])
        floor = np.minimum.reduceat(start, first[:-1]).astype(np.float64)
        held = [np.zeros(0, dtype=np.int64)] * 3
        for i, j, s in threshold_join(q, floor, y):
            other = label_a[i] != label_r[j]
            i, j, s = i[other], j[other], s[other]
            for k in range(int(size.max())):  # the k-th window of each anchor
                has = size[i] > k
                w = first[i[has]] + k
                inside = (s[has] >= start[w]) & (s[has] <= high[w])
                held = [np.concatenate([x, v]) for x, v in zip(held, (w[inside], s[has][inside], ids[j[has][inside]]))]
            k = best(*held, most)
            held = [x[k] for x in held]
        at = np.searchsorted(first, held[0], side="right") - 1
        return pd.DataFrame({"vec_id": own[at], "positive_id": positive[held[0]], "negative_id": held[2], "negative_score": held[1]})

    found = _units(anchors, rows, sets, strips).applyInPandas(top, "vec_id long, positive_id long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("vec_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("k", rank).filter(F.col("k") <= most)


def mine(vectors_: DataFrame, anchor, n_positives: int = 5, n_negatives: int = 3, low: tuple = (50, 100), high: tuple = (95, 100)) -> DataFrame:
    """anchor: a condition on (vec_id). Negatives of a positive of score s have low * s <= score <= high * s (fractions)."""
    spark = vectors_.sparkSession
    rows = spill(vectors_, "vectors")
    n = rows.agg(F.count("*").alias("n"), F.count(F.when(anchor, 1)).alias("a")).first()
    sets, strips = max(1, -(-n["a"] // ANCHORS)), max(1, -(-n["n"] // STRIP), shuffle_partitions(spark))
    anchors = rows.filter(anchor)
    known = spill(positives(anchors, rows, sets, strips, n_positives), "positives")
    (p, q), (u, v) = low, high
    windows = known.withColumn("low", F.expr(f"-((-positive_score * {p} - pmod(-positive_score * {p}, {q})) div {q})")).withColumn("high", F.expr(f"(positive_score * {u} - pmod(positive_score * {u}, {v})) div {v}"))
    open_ = windows.filter("low <= high")
    found, left, written = [], None, []
    for share in LOWERED:
        todo = open_ if left is None else left
        start = F.least(F.col("high"), F.ceil(F.col("low") + (F.col("high") - F.col("low")) * share)) if share else F.col("low")
        todo = spill(todo.withColumn("start", start), "windows")
        written.append(todo)
        count = todo.agg(F.countDistinct("vec_id")).first()[0]
        if not count:
            break
        per = todo.groupBy("vec_id").agg(F.collect_list(F.struct("positive_id", "high", "start")).alias("windows"))
        got = spill(negatives(anchors.join(per, "vec_id"), rows, max(1, -(-count // ANCHORS)), strips, n_negatives), "negatives")
        full = got.groupBy("vec_id", "positive_id").agg(F.count("*").alias("c")).withColumn("full", (F.col("c") >= n_negatives) | F.lit(share == 0)).select("vec_id", "positive_id", "full")
        found.append(got.join(full.filter("full"), ["vec_id", "positive_id"]).drop("full"))
        if share == 0:
            break
        left = todo.drop("start").join(full.filter("full"), ["vec_id", "positive_id"], "left_anti")
    if not found:
        found = [spark.createDataFrame([], "vec_id long, positive_id long, negative_id long, negative_score long, k int")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = out.join(known, ["vec_id", "positive_id"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("k").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = taken(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0)
