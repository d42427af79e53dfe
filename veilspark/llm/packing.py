"""Best-fit packing by minimum bin slack.

Pieces matter to a bin only by their length, so the search runs on the histogram of lengths (never more rows than the
capacity): for each bin the longest remaining length is fixed and a bitset subset-sum over the available lengths finds
the fullest feasible rest; that combination is removed as many times as the counts allow. Assigning pieces to places
then needs no large group: a piece has a rank among the pieces of its length, namely its number within its own task
plus the pieces of that length in the tasks before.

Defined results: a null text counts as empty (one piece with the end id); repeated rows are packed as often as they
occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import CACHE_WORDS, Tokens, spill, table

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room; longer lengths are preferred."""
    reach, mask, tried = 1, (1 << (room + 1)) - 1, []
    for n in sorted((n for n, c in counts.items() if c > 0 and n <= room), reverse=True):
        left, chunk = min(counts[n], room // n), 1
        while left:
            m = min(chunk, left)
            tried.append((n, m, reach))
            reach |= (reach << (n * m)) & mask
            left, chunk = left - m, chunk * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for n, m, before in reversed(tried):
        if not before >> total & 1:
            taken[n] = taken.get(n, 0) + m
            total -= n * m
    return taken


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, copies of each length in such a bin), until all lengths are used up."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        bin_ = fullest(rest, capacity - seed)
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(left[n] // m for n, m in bin_.items())
        out.append((times, bin_))
        for n, m in bin_.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def places(found: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Runs of ranks, sorted by (length, first rank): length, first rank, first bin, copies per bin, offset in the bin."""
    runs, used, bin_ = [], {}, 0
    for times, combo in found:
        at = 0
        for n, m in sorted(combo.items(), reverse=True):
            runs.append((n, used.get(n, 0), bin_, m, at))
            used[n] = used.get(n, 0) + times * m
            at += n * m
        bin_ += times
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, lead: bool = False, capacity: int = CAPACITY, end_id: int = 0, cache_words: int = CACHE_WORDS, keep: bool = True) -> DataFrame:
    """Cuts only documents longer than the capacity. part and k number the pieces of a length within their task."""

    def run(batches):
        tok, part, n_of = Tokens.get(tokenizer, lead, cache_words), TaskContext.get().partitionId(), {}
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 2000):
                rows = []
                for d, x in zip(b.column(0).slice(i, 2000).to_pylist(), tok.encode([t or "" for t in texts[i : i + 2000]])):
                    ids = np.append(np.frombuffer(x, "<u2").astype("<u4"), np.array([end_id], "<u4"))
                    for p, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        k = n_of.get(len(own), 0)
                        n_of[len(own)] = k + 1
                        rows.append((d, p, at, len(own), zlib.crc32(own.tobytes()), part, k))
                cols = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])
        if not keep:
            Tokens.forget(tokenizer, lead)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, lead: bool = False, capacity: int = CAPACITY, end_id: int = 0, cache_words: int = CACHE_WORDS, keep: bool = True) -> DataFrame:
    """One row per piece with its sequence and place. cache_words: words that a worker remembers; keep: also after its
    task (memory only)."""
    cut = spill(pieces(docs, tokenizer, lead, capacity, end_id, cache_words, keep), "pieces")
    per_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    first = per_task.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = places(combinations(counts, capacity))

    def place(frames):
        key = runs[:, 0] * (1 << 44) + runs[:, 1] if len(runs) else None
        for p in frames:
            if not len(p):
                continue
            rank = p["base"].to_numpy(np.int64) + p["k"].to_numpy(np.int64)
            r = runs[np.searchsorted(key, p["length"].to_numpy(np.int64) * (1 << 44) + rank, side="right") - 1]
            q, slot = np.divmod(rank - r[:, 1], r[:, 3])
            yield pd.DataFrame({"doc_id": p["doc_id"], "piece": p["piece"], "start": p["start"], "length": p["length"], "ids_crc32": p["ids_crc32"], "sequence_id": r[:, 2] + q, "offset": r[:, 4] + slot * r[:, 0]})

    joined = cut.join(first, ["length", "part"])
    return joined.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, lead: bool = False, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. Needs doc_ids that are unique and not null."""

    def run(batches):
        tok = Tokens.get(tokenizer, lead)
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(np.frombuffer(tok.encode([t or ""])[0], "<u2"), end_id).astype(np.int32)
                rows += [(d, p, ids[at : at + capacity].tolist()) for p, at in enumerate(range(0, len(ids), capacity))]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, ids array<int>")
    own = packed.select("doc_id", "piece", "sequence_id", "offset").join(cut, ["doc_id", "piece"])
    ordered = own.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    return ordered.select("sequence_id", F.flatten(F.col("all.ids")).alias("ids"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
