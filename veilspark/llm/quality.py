"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams: byte n-grams of 1 to 4, and n-grams of word shapes (repeated word, repeated
line, upper case, symbols). Each is scaled by the log-ratio of its smoothed class counts; a linear hinge-loss model on
the scaled indicators is fitted by dual coordinate descent and interpolated with its mean weight. Training uses at most
SAMPLE labelled documents of each class, chosen by a hash of doc_id; one task fits them. Scoring is map-only and covers
whole texts.

Defined results: null and empty texts have no n-grams and get the score of the bias alone; labels other than 0 and 1
and labels without a document are not learned; without labels of both classes every score is 0.5; every row gives one
row, repeated rows too; further columns are ignored by score() and kept by keep_good().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

SAMPLE = 3000  # labelled documents of each class, at most
WIDTH = 1 << 18
PIECE = 1 << 17  # bytes of a text whose n-grams are coded at once (memory only)
COST, BETA, EPOCHS = 1.0, 0.25, 12
MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(code: np.ndarray, salt: int) -> np.ndarray:
    return ((code + np.uint64(salt)) * MIX >> np.uint64(46)).astype(np.int64)  # 18 bits


def shapes(text: str) -> np.ndarray:
    """Codes of word-shape n-grams: how words repeat, their case and their symbols."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    kind = []
    last = None
    for w in words:
        kind.append(1 if w == last else 2 if w.isupper() and len(w) > 1 else 3 if not w[-1].isalnum() and w[-1] not in ".,;:" else 0)
        last = w
    k = np.array(kind, dtype=np.uint64)
    out = [np.unique(k)]
    for n in (2, 3, 4):
        if len(k) >= n:
            code = np.zeros(len(k) - n + 1, dtype=np.uint64)
            for j in range(n):
                code = code * np.uint64(5) + k[j : len(k) - n + 1 + j]
            out.append(np.unique(code) + np.uint64(1000 * n))
    lines = [x for x in text.split("\n") if len(x) > 20]
    same = len(lines) - len(set(lines))
    out.append(np.array([9000 + min(9, same), 9100 + int(10 * same / max(1, len(lines))), 9200 + int(10 * len(set(words)) / len(words))], dtype=np.uint64))
    return np.concatenate(out)


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers below WIDTH."""
    whole = np.frombuffer(text.encode(), np.uint8)
    if not len(whole):
        return np.zeros(0, dtype=np.int32)
    seen = np.zeros(WIDTH, dtype=bool)
    for i in range(0, len(whole), PIECE):  # pieces overlap by three bytes, so that no n-gram is missed
        b = whole[i : i + PIECE + 3].astype(np.uint64)
        code = b
        for n in range(1, 5):
            seen[_hash(code, n << 40)] = True
            code = code[:-1] << np.uint64(8) | b[n:] if len(b) > n else code[:0]
    seen[_hash(shapes(text), 9 << 40)] = True
    return np.flatnonzero(seen).astype(np.int32)


def fit(y: np.ndarray, rows: list[np.ndarray], width: int = WIDTH) -> np.ndarray:
    """Weights of the scaled indicators and, last, the bias; the ratio is already multiplied in."""
    out = np.zeros(width + 1, dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return out
    counts = [np.ones(width), np.ones(width)]
    for t, r in zip(y, rows):
        counts[int(t)][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sign = np.where(y == 1, 1.0, -1.0)
    norm = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    values = lambda i: ratio[rows[i]] * norm[i]  # noqa: E731  made anew each time: all of them would be twice the rows
    square = np.array([(v := values(i)) @ v + 1 for i in range(len(rows))])
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            v = values(i)
            g = sign[i] * (w[rows[i]] @ v + bias) - 1
            a = min(max(alpha[i] - g / square[i], 0.0), COST)
            if a != alpha[i]:
                d = (a - alpha[i]) * sign[i]
                w[rows[i]] += d * v
                bias += d
                moved = max(moved, abs(a - alpha[i]))
                alpha[i] = a
        if moved < 1e-3:
            break
    w = (1 - BETA) * np.abs(w).mean() + BETA * w  # weights lean towards the naive Bayes ratio itself
    out[:-1], out[-1] = w * ratio, BETA * bias
    return out


def margin(weights: np.ndarray, rows: np.ndarray) -> float:
    return float(weights[rows].sum() / np.sqrt(max(1, len(rows))) + weights[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Fits on at most `sample` documents of each class whose ids aren't held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y"))
    pick = lambda c: known.filter(F.col("__y") == c).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    chosen = pick(0).unionByName(pick(1))  # at most 2 * sample rows of two numbers: small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "__y", "text")

    def code(batches):
        for b in batches:
            got = pa.array([features(t or "").tobytes() for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), got], ["doc_id", "y", "x"])

    coded = rows.mapInArrow(code, "doc_id long, y int, x binary")

    # one task reads the sample in small batches: as one group, the JVM and Python would hold it several times over
    got = coded.repartition(1).mapInArrow(learn, "w binary").collect()
    return np.frombuffer(got[0]["w"], "<f4").astype(np.float64) if got else np.zeros(WIDTH + 1)


def learn(batches):
    """One row: the weights fitted to all rows of doc_id, y and x; no row without any."""
    held: dict[tuple[int, int], bytes] = {}
    for b in batches:
        for d, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            held[d, y] = min(x, held.get((d, y), x))  # repeated rows once, whatever their order
    if held:
        keys = sorted(held)
        w = fit(np.array([y for _, y in keys]), [np.frombuffer(held[k], np.int32) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], ["w"])


def scores(weights: np.ndarray, texts: list) -> np.ndarray:
    m = np.array([margin(weights, features(t or "")) for t in texts], dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score: 1 is good."""
    w = weights.astype(np.float32)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(w, b.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    w, at = weights.astype(np.float32), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(w, b.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
