"""Exact substring removal with a logarithmic family of suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier. Texts that are equal to an earlier one go
whole. For the rest, every string of LENGTH bytes holds a minimizer (an anchor of GRAM bytes whose place depends on the
string alone), so equal strings meet at equal anchors. One pass finds the anchors, each with a hash of its surroundings;
of equal surroundings all but the first are settled, in the map task as far as it sees them and then where the anchor's
hash sends them. Only anchors with differing surroundings are followed up, with their bytes: each task gets its anchors'
surroundings in batches, in document order. A batch gets a suffix array (its suffixes sorted by their first LENGTH
bytes), which is merged with each existing level in turn, equal neighbours being the matches; levels of equal size merge
into one, so that each suffix moves a logarithmic number of times.

Anchors with more than WIDE differing surroundings would be too much for one task. Their LENGTH-byte strings are dealt by
a hash of the whole string instead, and the first of each is found by a window over that hash.

Defined results: a null text counts as empty; texts below LENGTH bytes keep all; a null doc_id removes nothing and is
compared with nothing; rows of equal doc_id and text get equal results; rows of equal doc_id but different text are taken
for one document, so that they get equal n_removed and n_spans, of one of them; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import scratch, shuffle_partitions, spill, table
from .words import chunks, mix, prefix, spans as span_hash

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # an anchor's string starts at most so far before it
BATCH = 1 << 18  # suffixes in a batch
CONTEXTS = 20_000  # surroundings that a task indexes, on average: bounds the memory of its levels
WIDE, LOCAL = 20_000, 4096  # differing surroundings of one anchor, in all and in one flush of a map task, beyond which they are dealt by string
SLICE = 1 << 24  # bytes whose anchors are found at once (memory only)
FLUSH = 500_000  # anchors a map task holds at once (memory only)
PARTS = 3  # an anchor's strings, by where they start, in so many parts: a part whose common bytes are unique has no match
OPEN, SETTLED, SPREAD, MARK = 0, 1, 2, 3  # kinds of rows between the steps


def anchors(texts: list[bytes]):
    """(text number, place, hash, hash of the surroundings, end of the surroundings) of the minimizers of all
    LENGTH-byte strings of all texts; of equal hashes the leftmost counts. Surroundings begin REACH bytes before."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    across = np.zeros(n, dtype=bool)  # strings that would go beyond their text
    for b, e in zip((ends - size).tolist(), ends.tolist()):
        across[max(b, e - LENGTH + 1) : e] = True
    found = []
    for s in range(0, n - LENGTH + 1, SLICE):
        lo, w = max(0, s - REACH), min(SLICE, n - LENGTH + 1 - s)
        sums = prefix(data[lo : s + SLICE + 2 * LENGTH])
        at = np.arange(s - lo, s - lo + w + REACH)
        h = span_hash(sums, at, at + GRAM)
        m, width = (h >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64), 1  # 36 bits of hash, then the place
        while width * 2 <= REACH + 1:
            m, width = np.minimum(m[: len(m) - width], m[width:]), width * 2
        rest = REACH + 1 - width
        m = np.minimum(m[:w], m[rest : rest + w])[~across[s : s + w]] & np.uint64((1 << 28) - 1)
        hit = np.zeros(len(h), dtype=bool)
        hit[m] = True
        place = np.flatnonzero(hit)
        doc = np.searchsorted(ends, place + s, side="right")
        begin, end = np.maximum(ends[doc] - size[doc], place + s - REACH), np.minimum(ends[doc], place + s + LENGTH)
        around = mix(span_hash(sums, begin - lo, end - lo) ^ (place + s - begin).astype(np.uint64))
        base = ends[doc] - size[doc]
        found.append(np.stack([doc, place + s - base, h[place].view(np.int64), around.view(np.int64), end - base]))
    if not found:
        return np.zeros((5, 0), np.int64)
    # a slice and the next may name the same place
    found = np.concatenate(found, axis=1)
    return found[:, np.unique(np.stack([found[0], found[1]], axis=1), axis=0, return_index=True)[1]] if n > SLICE else found


def merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Unions of ranges that overlap or touch, by document."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if not len(doc):
        return doc, begin, end
    high = np.maximum.accumulate(end + (np.cumsum(np.append(True, doc[1:] != doc[:-1])) << 40)) & ((1 << 40) - 1)
    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (begin[1:] > high[:-1])))
    return doc[cut], begin[cut], np.append(high[cut[1:] - 1], high[-1])


def settle(h, g, doc, at, end):
    """Of rows with equal (h, g): the first (indices), and the ranges that the others cover."""
    order = np.lexsort((at, doc, g, h))
    hs, gs, ds, ps = h[order], g[order], doc[order], at[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])) if len(order) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    of = head[np.cumsum(new) - 1] if len(head) else head
    later = (ds != ds[of]) | (ps != ps[of])
    late = order[later]
    return order[head], merged(doc[late], np.maximum(0, at[late] - REACH), end[late])


class Levels:
    """Suffix arrays of growing size: suffixes sorted by their first LENGTH bytes, each distinct one with its first
    (document, start). A new batch is merged with every level in turn, which shows the matches."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _first(keys, doc, start):
        """Sorted distinct keys with their first (doc, start), and the number of each row's key. The sort is stable:
        two sorted runs are merged in linear time, and of equal keys the first run's come first."""
        order = np.argsort(keys, kind="stable")
        k, d, s = keys[order], doc[order], start[order]
        new = np.append(True, k[1:] != k[:-1])
        head = np.flatnonzero(new)
        first_d = np.minimum.reduceat(d, head)
        first_s = np.minimum.reduceat(np.where(d == first_d[np.cumsum(new) - 1], s, np.iinfo(np.int64).max), head)
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        return k[head], first_d, first_s, number

    def add(self, keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Marks the strings that also start earlier, in this batch or in an existing level; indexes the batch."""
        k, d, s, number = self._first(keys, doc, start)
        known = np.zeros(len(k), dtype=bool)
        for key, ld, ls in self.levels:
            _, both_d, both_s, at = self._first(np.concatenate([key, k]), np.concatenate([ld, d]), np.concatenate([ls, s]))
            there, own = np.zeros(len(both_d), dtype=bool), at[len(key) :]
            there[at[: len(key)]] = True
            known |= there[own]
            d, s = both_d[own], both_s[own]
        self._merge((k[~known], d[~known], s[~known]))
        return (d[number] != doc) | (s[number] != start)

    def _merge(self, level) -> None:
        if not len(level[0]):
            return
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = self._first(*(np.concatenate(x) for x in zip(self.levels.pop(), level)))[:3]
        self.levels.append(level)


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


_ROW = "route long, kind int, h long, g long, doc_id long, at int, end int"


def _rows(route, kind, h, g, doc, at, end):
    n = len(doc)
    full = lambda x, t: np.full(n, x, t) if np.isscalar(x) else np.asarray(x).astype(t)
    cols = [full(route, np.int64), full(kind, np.int32), full(h, np.int64), full(g, np.int64), full(doc, np.int64), full(at, np.int32), full(end, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["route", "kind", "h", "g", "doc_id", "at", "end"])


def _all_anchors(docs: DataFrame, local: int) -> DataFrame:
    """Rows for find(): anchors (OPEN, dealt by h), and what the map task sees by itself: ranges that are repeats
    (SETTLED), anchors with very many surroundings (SPREAD) and their hashes (MARK, dealt by h)."""

    def flush(held):
        doc, at, h, g, end = np.concatenate(held, axis=1)
        first, (rd, rb, re) = settle(h, g, doc, at, end)
        yield _rows(mix(rd.astype(np.uint64)).view(np.int64), SETTLED, 0, 0, rd, rb, re)
        doc, at, h, g, end = (x[first] for x in (doc, at, h, g, end))
        kinds, number, count = np.unique(h, return_inverse=True, return_counts=True)
        many = count[number] > local
        if many.any():
            yield _rows(mix(doc[many].astype(np.uint64) ^ at[many].astype(np.uint64)).view(np.int64), SPREAD, h[many], 0, doc[many], at[many], end[many])
            hot = kinds[count > local]
            yield _rows(hot, MARK, hot, 0, np.zeros(len(hot), np.int64), 0, 0)
            doc, at, h, g, end = (x[~many] for x in (doc, at, h, g, end))
        for i in range(0, len(h), 100_000):
            yield _rows(*(x[i : i + 100_000] if not np.isscalar(x) else x for x in (h, OPEN, h, g, doc, at, end)))

    def run(batches):
        held, n = [], 0
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i, j in chunks(texts, 1 << 19):
                found = anchors([t.encode() for t in texts[i:j]])
                found[0] = ids[i:j][found[0]]
                held.append(found)
                n += found.shape[1]
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return docs.filter(F.col("doc_id").isNotNull()).mapInArrow(run, _ROW)


def find(docs: DataFrame, wide: int = WIDE, local: int = LOCAL) -> DataFrame:
    """kind, h, doc_id, at, end: SETTLED ranges [at, end), and anchors with differing surroundings, one of each: OPEN, or
    SPREAD where one task couldn't hold them."""
    rows = _all_anchors(docs, local)
    ordered = rows.repartition(shuffle_partitions(docs.sparkSession), "route").sortWithinPartitions("route")

    def group(cols):
        kind, h, g, doc, at, end = cols
        kept = (kind == SETTLED) | (kind == SPREAD)
        yield _rows(0, kind[kept], h[kept], 0, doc[kept], at[kept], end[kept])
        marked, o = np.unique(h[kind == MARK]), kind == OPEN
        h, g, doc, at, end = h[o], g[o], doc[o], at[o], end[o]
        first, (rd, rb, re) = settle(h, g, doc, at, end)
        yield _rows(0, SETTLED, 0, 0, rd, rb, re)
        h, doc, at, end = h[first], doc[first], at[first], end[first]
        _, number, count = np.unique(h, return_inverse=True, return_counts=True)
        spread = (count[number] > wide) | np.isin(h, marked)
        keep = spread | (count[number] > 1)
        yield _rows(0, np.where(spread, SPREAD, OPEN)[keep], h[keep], 0, doc[keep], at[keep], end[keep])

    def run(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy().astype(np.int64) for k in range(7)]
            edge = int(np.searchsorted(cols[0], cols[0][-1]))  # the last hash may go on in the next batch
            if edge == 0 and held and held[-1][0][-1] == cols[0][0]:
                held.append(cols)
                continue
            held.append([c[:edge] for c in cols])
            yield from group([np.concatenate(x) for x in zip(*held)][1:])
            held = [[c[edge:] for c in cols]]
        if held:
            yield from group([np.concatenate(x) for x in zip(*held)][1:])

    return ordered.mapInArrow(run, _ROW).select("kind", "h", "doc_id", "at", "end")


def _contexts(held: DataFrame) -> DataFrame:
    """h, doc_id, at (of the anchor in the context), begin, context: the bytes around every OPEN anchor."""

    def run(batches):
        for b in batches:
            rows: list = []
            for d, t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = t.encode()
                for m in marks:
                    if m["kind"] == OPEN:
                        begin = max(0, m["at"] - REACH)
                        rows.append((m["h"], d, m["at"] - begin, begin, data[begin : m["end"]]))
            for i in range(0, len(rows), 20_000):
                cols = zip(*rows[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["h", "doc_id", "at", "begin", "context"])

    return held.filter(F.exists("marks", lambda m: m["kind"] == OPEN)).mapInArrow(run, "h long, doc_id long, at int, begin int, context binary")


def suffixes(contexts: list[bytes], at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context number, start in it) of the LENGTH-byte strings that may be repeated: an anchor's strings fall into PARTS
    by their start; all strings of a part share bytes around the anchor, which must occur in another context too.
    h: the anchors' hashes."""
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    base = np.cumsum(size) - size
    sums = prefix(np.frombuffer(b"".join(contexts), np.uint8))
    edge = np.linspace(0, REACH + 1, PARTS + 1).astype(np.int64)
    own, start = [], []
    for lo, hi in zip(edge[:-1], edge[1:] - 1):  # strings start lo to hi bytes before the anchor
        b, e = at - lo, at - hi + LENGTH
        some = np.flatnonzero((b >= 0) & (e <= size))
        key = span_hash(sums, base[some] + b[some], base[some] + e[some])
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        # where a context ends early, its strings of this part share fewer bytes: its anchor isn't judged by them
        short = np.isin(h, h[e > size])
        twice = np.zeros(len(at), dtype=bool)
        twice[some] = count[number] > 1
        keep = np.flatnonzero(short | twice)
        s = (at[keep][:, None] - np.arange(lo, hi + 1)[None, :]).ravel()
        k = np.repeat(keep, hi - lo + 1)
        ok = (s >= 0) & (s + LENGTH <= size[k])
        own.append(k[ok])
        start.append(s[ok])
    return np.concatenate(own), np.concatenate(start)


def _scan(contexts: DataFrame, count: int) -> DataFrame:
    """doc_id, begin, end: ranges of removed bytes found among differing surroundings."""
    ordered = contexts.repartition(max(shuffle_partitions(contexts.sparkSession), -(-count // CONTEXTS)), "h")

    def run(batches):
        h, doc, at, begin, context = [], [], [], [], []
        for b in batches:
            h.append(b.column(0).to_numpy())
            doc.append(b.column(1).to_numpy())
            at.append(b.column(2).to_numpy())
            begin.append(b.column(3).to_numpy())
            context += b.column(4).to_pylist()
        if not context:
            return
        doc, at, begin = np.concatenate(doc), np.concatenate(at).astype(np.int64), np.concatenate(begin).astype(np.int64)
        own, start = suffixes(context, at, np.concatenate(h))
        if not len(own):
            return
        size = np.array([len(c) for c in context], dtype=np.int64)
        base = np.cumsum(size) - size
        # raised by one, so that no byte is zero (UTF-8 has no byte 255)
        data = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(context), np.uint8) + np.uint8(1), LENGTH)
        order = np.lexsort((begin[own] + start, doc[own]))
        own, start = own[order], start[order]
        index = Levels()
        for i in range(0, len(own), BATCH):
            k, s = own[i : i + BATCH], start[i : i + BATCH]
            keys = np.ascontiguousarray(data[base[k] + s]).view(f"S{LENGTH}").ravel()
            d, place = doc[k], begin[k] + s
            hit = index.add(keys, d, place)
            d, b, e = merged(d[hit], place[hit], place[hit] + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(b), pa.array(e)], ["doc_id", "begin", "end"])

    return ordered.mapInArrow(run, "doc_id long, begin long, end long")


def _spread(held: DataFrame) -> DataFrame:
    """doc_id, begin, end: as _scan(), for SPREAD anchors: every string is dealt by its own hash of 128 bits."""

    def run(batches):
        for b in batches:
            for d, t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = t.encode()
                start = sorted({s for m in marks if m["kind"] == SPREAD for s in range(max(0, m["at"] - REACH), min(m["at"], m["end"] - LENGTH) + 1)})
                for i in range(0, len(start), 20_000):
                    part = start[i : i + 20_000]
                    keys = [xxhash.xxh3_128_digest(data[s : s + LENGTH]) for s in part]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([d] * len(part), pa.int64()), pa.array(part, pa.int64())], ["key", "doc_id", "begin"])

    rows = held.filter(F.exists("marks", lambda m: m["kind"] == SPREAD)).mapInArrow(run, "key binary, doc_id long, begin long")
    # a string that a document holds often is a repeat from its second place on: at most one row per document goes on
    nth = F.row_number().over(W.partitionBy("key").orderBy("doc_id", "begin"))
    return rows.withColumn("nth", nth).filter("nth > 1").select("doc_id", "begin", (F.col("begin") + LENGTH).alias("end"))


def _by_document(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text, marks, written in buckets of doc_id: what joins it later by doc_id needs no shuffle of texts."""
    spark = docs.sparkSession
    n, name = shuffle_partitions(spark), f"repeating_{uuid.uuid4().hex}"
    kind = marks.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "h", "at", "end")).alias("marks"))
    held = docs.join(kind, "doc_id").select("doc_id", "text", "marks")
    held.write.option("compression", "zstd").option("path", scratch(spark, "repeating")).bucketBy(n, "doc_id").sortBy("doc_id").saveAsTable(name)
    return spark.table(name)


def remove(docs: DataFrame, wide: int = WIDE, local: int = LOCAL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    d = _bytes(docs)
    profile = spill(d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "profiles")
    first = profile.groupBy("sha").agg(F.min("doc_id").alias("rep"))
    found = spill(find(d, wide, local), "repeats")
    reps = first.select(F.col("rep").alias("doc_id")).distinct()
    held = _by_document(d, found.join(reps, "doc_id", "left_semi"))
    kinds = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}  # at most three rows
    ranges = _scan(_contexts(held), kinds.get(OPEN, 0))
    if kinds.get(SPREAD):
        ranges = ranges.unionByName(_spread(held))
    ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))

    def cut(batches):
        for b in batches:
            rows = []
            for i, t, marks, r in zip(*(b.column(k).to_pylist() for k in range(4))):
                data, kept, n, spans, last = t.encode(), [], 0, 0, -1
                own = [(m["at"], m["end"]) for m in marks if m["kind"] == SETTLED] + [(x["begin"], x["end"]) for x in r or ()]
                for begin, end in sorted(own):
                    if begin > last:
                        spans += 1
                        kept.append(data[max(0, last) : begin])
                        n += end - begin
                        last = end
                    elif end > last:
                        n += end - last
                        last = end
                kept.append(data[max(0, last) :])
                rows.append((i, n, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["id", "n", "spans", "kept"])

    done = held.join(ranges, "doc_id", "left").select("doc_id", "text", "marks", "ranges").mapInArrow(cut, "id long, n long, spans long, kept string")
    done = done.groupBy("id").agg(F.min(F.struct("n", "spans", "kept")).alias("r")).select("id", "r.*")  # repeated rows
    rows = profile.join(first, "sha", "left").join(done, F.col("doc_id") == F.col("id"), "left")
    gone = (F.col("rep") < F.col("doc_id")) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))
