"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit set where more than half of the 64-bit hashes of its word n-grams have it. Two
fingerprints that differ in at most RADIUS bits agree on at least one of RADIUS + 1 bands of bits, so that only
fingerprints that agree on a band are compared. A group of more than GROUP distinct fingerprints is dealt anew: its free
bits are cut into RADIUS + 1 bands again, one of which similar fingerprints share too, and so on until every group is
small or has so few free bits that it can't be large. No pair is lost, and no task holds a hot group.

A group's fingerprints are stored as bit planes: plane k holds bit k of 64 fingerprints in each word. A fingerprint meets
a word of others by one XOR a plane; the distances of all 64 grow in carry-save counters (two bitwise digits and an
overflow), and the word is abandoned once all have overflowed. Only links that join what wasn't joined leave a group.

Defined results: a text without words, empty or null has fingerprint zero and is linked like any other; a text of fewer
words than n is one n-gram; repeated rows and equal doc_ids keep one row each; a null doc_id has a null component and
joins nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, small_batches, spill, table
from .graph import components

RADIUS, SEED = 2, 42
#: Distinct fingerprints compared in one group; larger groups are dealt anew (bounds a task, not the result).
GROUP = 1024
#: So few free bits leave no more than 2**FREE distinct fingerprints in a group: it is compared as it is.
FREE = 10
#: (fingerprint, word) cells compared at once, n-grams counted at once, and fingerprints made into planes at once (memory only).
CELLS, HASHES, ROWS = 1 << 18, 1 << 17, 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def hashes(text: str | None, n: int) -> list[int]:
    """XXH64 of every word n-gram, repeats included. bytes.split() cuts at the six ASCII blanks, lower() knows A-Z only."""
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(n)))), repeat(SEED)))


def fingerprint(values: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes."""
    size = np.array([len(v) for v in values])
    out = np.zeros(len(values), dtype=np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        flat = np.fromiter((h for v in values for h in v), dtype="<u8", count=int(size.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(size[some])[:-1]]), axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > size[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) per row."""

    def long_text(text):
        """A very long text: counts of its bits, some n-grams at a time."""
        words = text.encode().lower().split()
        ones, total = np.zeros(64, dtype=np.int64), len(words) - n + 1
        for lo in range(0, total, HASHES):
            part = words[lo : lo + HASHES + n - 1]
            h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(part[k:] for k in range(n)))), repeat(SEED)), dtype="<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return np.packbits(2 * ones > total, bitorder="little").view("<u8")[0] if total > 0 else fingerprint([hashes(text, n)])[0]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, held, at = np.zeros(len(texts), dtype=np.uint64), [], []
            size = 0
            for k, t in enumerate(texts):
                if t and len(t) > 8 * HASHES:
                    out[k] = long_text(t)
                else:
                    held.append(hashes(t, n))
                    at.append(k)
                    size += len(held[-1])
                if held and (size >= HASHES or k == len(texts) - 1):
                    out[at] = fingerprint(held)
                    held, at, size = [], [], 0
            if held:
                out[at] = fingerprint(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words; bit r of word w in row k is bit k of fingerprint 64 w + r."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((-len(fps) % 64, 64), dtype=np.uint8)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(fps: np.ndarray, last: np.ndarray):
    """Yields (i, j) arrays of all i < j < last[i] whose fingerprints differ in at most RADIUS bits."""
    plane, n = planes(fps), len(fps)
    words = np.where(last > np.arange(n) + 1, (last - 1) // 64 - (np.arange(n) + 1) // 64 + 1, 0)
    total = np.concatenate([[0], np.cumsum(words)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CELLS, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), words[lo:hi])
        w = (i + 1) // 64 + np.arange(len(i)) - (total[i] - total[lo])
        lo = hi
        if not len(i):
            continue
        # rows before i + 1 and from last[i] on count as too far
        over = ~((FULL << np.maximum(i + 1 - 64 * w, 0).astype(np.uint64)) & (FULL >> np.maximum(64 * (w + 1) - last[i], 0).astype(np.uint64)))
        one, two = np.zeros_like(over), np.zeros_like(over)
        own = fps[i]
        for k in range(64):
            differ = plane[k][w] ^ (np.uint64(0) - (own >> np.uint64(k) & np.uint64(1)))
            carry = one & differ
            one ^= differ
            over |= two & carry  # a fourth: counted 3 already
            two ^= carry
            over |= one & two  # three
            if k % 8 == 7:
                live = over != FULL
                if not live.all():
                    i, w, over, one, two, own = i[live], w[live], over[live], one[live], two[live], own[live]
                    if not len(i):
                        break
        if len(i):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, bit = np.nonzero(hit)
            yield i[cell], 64 * w[cell] + bit


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the labels (each the smallest position of its set) of all i and j."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def compare(groups: DataFrame) -> DataFrame:
    """Links (a, b) that join the representatives of each (mask, value) group by similar fingerprints."""

    def links(fps, reps, value):
        """Groups in a row, whole."""
        edge = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]).any(axis=1), [True]]))
        last = np.repeat(edge[1:], np.diff(edge))
        label = np.arange(len(fps))
        for i, j in near(fps, last):
            label = join_labels(label, i, j)
        k = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(reps[k]), pa.array(reps[label[k]])], ["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            new = [np.stack([b.column(c).to_numpy() for c in (0, 1)], axis=1), b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy()]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
            if len(held[1]) >= ROWS:
                edge = np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1))
                if len(edge):
                    cut = int(edge[-1]) + 1
                    yield links(held[1][:cut], held[2][:cut], held[0][:cut])
                    held = [x[cut:] for x in held]
        if held is not None and len(held[1]):
            yield links(held[1], held[2], held[0])

    dealt = groups.select("mask", "value", "fp", "rep").repartition(shuffle_partitions(groups.sparkSession), "mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(run, "a long, b long")


def bands(free: int) -> list[int]:
    """The free bits of a mask cut into RADIUS + 1 bands, as masks."""
    bits = [k for k in range(64) if free >> k & 1]
    cut = [len(bits) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [sum(1 << k for k in bits[lo:hi]) for lo, hi in zip(cut, cut[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar(distinct: DataFrame) -> DataFrame:
    """Links between the representatives of (fp, rep) rows, enough to join all that are within RADIUS bits."""
    level, found = {0}, []  # masks of bits on which the groups of this level agree
    rows, held = distinct.withColumn("mask", F.lit(0).cast("long")), None
    while level:
        finer = {m: [signed(m | b) for b in bands(~m & (1 << 64) - 1)] for m in level}
        of = F.create_map(*(x for m, f in finer.items() for x in (F.lit(signed(m)), F.array(*map(F.lit, f)))))
        dealt = rows.select("fp", "rep", F.explode(of[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
        groups = spill(dealt.join(sizes, ["mask", "value"]), "groups")
        if held is not None:
            discard(held)
        large = (F.col("n") > GROUP) & (F.bit_count("mask") < 64 - FREE)
        level = {r["mask"] & (1 << 64) - 1 for r in groups.filter(large).select("mask").distinct().collect()}
        found.append(spill(compare(groups.filter(~large)), "similar"))
        rows, held = groups.filter(large).select("fp", "rep", "mask"), groups
    discard(held)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach)."""
    small_batches(docs.sparkSession)
    rows = spill(fingerprints(docs, n), "fingerprints")
    distinct = spill(rows.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(similar(distinct))
    classes = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("root"))
    out = rows.join(classes, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
