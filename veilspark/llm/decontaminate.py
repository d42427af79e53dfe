"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit distance.

Texts are sequences of words (letters and digits, A-Z folded). A CGK random walk reads a window: at each step it copies
the current word and moves on if a random bit of (step, word) says so; equal windows walk alike, and windows at a small
edit distance end at a small Hamming distance. Several walks, each with several samples of steps, hash every window (one
starts at every word) and every item at several offsets. An item is as long as its windows: a hit aligns the whole item
with the words around it, and the edit distance between words, with free ends in the document, decides. Places next to
each other are compared as one; those without enough of the item's words aren't compared, and the distance is computed
in a band as wide as an item may have edits, so that an item of n words takes a small multiple of n * SHARE * n steps.

Items of fewer than SHORT words are too short for walks. They are cut into one piece more than they may have edits, so
that at least one piece stands unchanged wherever the item does, and every place of a piece is a candidate: nothing is missed.

Recall of longer items: an edit hides an item only if every offset's every sample meets it. A stretch of eight equal
words after an offset is enough for the shorter samples; RECALL is measured in the tests with random edits.

The benchmark is a stated query set: it is read in blocks of BLOCK_ITEMS items, each block against all documents in one
map-only pass.

Defined results: null, empty and word-less texts and items match nothing; every contaminated row is returned, repeated
rows too; further columns are ignored by find() and kept by keep_clean().
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spill, table
from .words import ALNUM, chunks, mix, words

SHARE = 0.2  # edits per word of the item
RECALL = 0.95  # target for items with up to 15 % edited words
STEPS, WALKS = 32, 2
SAMPLES = [(0, 2, 5, 7, 9), (0, 3, 6, 9, 13), (1, 4, 8, 12, 15), (0, 5, 11, 17, 22), (2, 8, 14, 20, 26), (0, 7, 15, 23, 31)]
OFFSET = 3  # words between an item's offsets
SHORT = 20  # items with fewer words are looked up by pieces, one of which any allowed edits leave whole
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20  # of the benchmark that one pass searches for
# memory only, results don't depend on them: characters searched at once, words of candidate places compared at once
CHUNK, COMPARED = 1 << 19, 1 << 18
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], dtype=np.uint64)
FILTER = 18


class Walk:
    """The sampled words of the windows at all words of a sequence."""

    def __init__(self, tokens: np.ndarray, walk: int):
        n = len(tokens)
        t = mix(np.concatenate([tokens, np.zeros(STEPS + 1, np.uint64)]) ^ np.uint64(0xA5A5 * (walk + 1)))
        at = np.arange(n)
        used = {s for x in SAMPLES for s in x}
        self.word, self.at = {}, {}
        for step in range(STEPS):
            w = t[at]
            if step in used:
                self.word[step], self.at[step] = w, at.copy()
            at += ((w >> np.uint64(step)) & np.uint64(1)).astype(np.int64)

    def keys(self, k: int) -> np.ndarray:
        out = np.zeros(len(self.word[0]), dtype=np.uint64)
        for s, odd in zip(SAMPLES[k], _ODD):
            out += self.word[s] * odd
        return mix(out)


def runs(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on, as far as all n are there."""
    out = np.zeros(len(tokens) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix(out + tokens[k : len(tokens) - n + 1 + k] * _ODD[0])
    return out


def distance(item: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """Edits that turn the item into some part of each window (rows of windows), or more than `most`.

    Only diagonals along which the whole item fits into the window are computed; a window is given up as soon as every
    one of them has more than `most` edits.
    """
    n = len(item)
    wide = windows.shape[1] - n + 1
    j = np.arange(wide, dtype=np.int32)
    out = np.full(len(windows), most + 1, dtype=np.int32)
    live, row = np.arange(len(windows)), np.zeros((len(windows), wide), dtype=np.int32)
    for i, w in enumerate(item):
        new = row + (windows[:, i : i + wide] != w)
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - j, axis=1) + j
        if i % 16 == 15 and not (keep := row.min(axis=1) <= most).all():
            live, row, windows = live[keep], row[keep], windows[keep]
            if not len(live):
                return out
    out[live] = np.minimum(row.min(axis=1), most + 1)
    return out


def holds(item: np.ndarray, windows: np.ndarray, least: int) -> np.ndarray:
    """Whether each window has the words of at least `least` places of the item, in any order."""
    own, count = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(own, windows), len(own) - 1)
    there = np.zeros((len(windows), len(own)), dtype=bool)
    r, c = np.nonzero(own[at] == windows)
    there[r, at[r, c]] = True
    return there @ count >= least


class Index:
    """The items of one block, by the keys of every sample of every walk."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.items = [], []
        for i, text in items:
            t = words([text], ALNUM)[0]
            if len(t):
                self.ids.append(i)
                self.items.append(t)
        entries: dict = {}
        pieces: dict = {}
        for k, t in enumerate(self.items):
            if len(t) < SHORT:
                cuts = np.linspace(0, len(t), int(SHARE * len(t)) + 2).astype(int)
                for o, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    pieces.setdefault(end - o, []).append((int(runs(t[o:end], end - o)[0]), k, o))
                continue
            for walk in range(WALKS):
                w = Walk(t, walk)
                for s, steps in enumerate(SAMPLES):
                    keys, end = w.keys(s), w.at[steps[-1]]
                    entries.setdefault((walk, s), []).extend((int(keys[o]), k, o) for o in range(0, len(t), OFFSET) if end[o] < len(t))
        self.tables = {n: self._table(e) for n, e in entries.items()}
        self.pieces = {n: self._table(e) for n, e in pieces.items()}

    @staticmethod
    def _table(entries: list):
        entries.sort()
        keys = np.array([e[0] for e in entries], dtype=np.uint64)
        hit = np.zeros(1 << FILTER, dtype=bool)
        hit[keys >> np.uint64(64 - FILTER)] = True
        return keys, np.array([e[1:] for e in entries], dtype=np.int64).reshape(-1, 2), hit

    @staticmethod
    def _look(found: np.ndarray, keys: np.ndarray, rows: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """(item, word at which the item would start) of all equal keys."""
        at = np.flatnonzero(hit[found >> np.uint64(64 - FILTER)])
        low, high = np.searchsorted(keys, found[at]), np.searchsorted(keys, found[at], side="right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.stack([rows[which, 0], np.repeat(at, n) - rows[which, 1]])

    def _cells(self, item: np.ndarray, start: np.ndarray, first: np.ndarray):
        """(item, text, first word of the cell, least place in it) of all cells that hold a candidate place.

        A cell is as long as an item may have edits, and one: places next to each other are compared as one.
        """
        size = np.array([len(t) for t in self.items])[item]
        # the text of a place is that of the item's middle
        doc = np.clip(np.searchsorted(first, np.clip(start + size // 2, 0, first[-1] - 1), side="right") - 1, 0, len(first) - 2)
        cell = (start - first[doc]) // ((SHARE * size).astype(np.int64) + 1)
        order = np.lexsort((start, cell, doc, item))
        item, doc, cell, start = item[order], doc[order], cell[order], start[order]
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])
        item, doc, cell, start = item[new], doc[new], cell[new], start[new]
        edge = np.flatnonzero(np.diff(item, prepend=-1, append=-1)) if len(item) else np.zeros(0, int)
        for lo, hi in zip(edge[:-1], edge[1:]):
            k = int(item[lo])
            n, most = len(self.items[k]), int(SHARE * len(self.items[k]))
            step = max(1, COMPARED // (n + 3 * most + 1))
            for a in range(lo, hi, step):
                own = slice(a, min(hi, a + step))
                yield k, doc[own], first[doc[own]] + cell[own] * (most + 1), start[own]

    def search(self, texts: list) -> list[list[tuple[int, int, int]]]:
        """For each text: (item id, edits, first word of the window) of every item found, the best place of each."""
        out: list = [[] for _ in texts]
        tokens, _, _, first = words(texts, ALNUM)
        if not len(tokens) or not self.items:
            return out
        hits = []
        for walk in sorted({w for w, _ in self.tables}):
            own = Walk(tokens, walk)
            hits += [self._look(own.keys(s), *self.tables[w, s]) for w, s in self.tables if w == walk]
        hits += [self._look(runs(tokens, n), *t) for n, t in self.pieces.items() if len(tokens) >= n]
        if not hits:
            return out
        hits = np.concatenate(hits, axis=1)
        code = np.unique(hits[0] * (1 << 40) + hits[1] + (1 << 39))
        item, start = code >> 40, (code & ((1 << 40) - 1)) - (1 << 39)
        best: dict = {}
        for k, doc, low, at in self._cells(item, start, first):
            t = self.items[k]
            n, most = len(t), int(SHARE * len(t))
            where = low[:, None] + np.arange(-most, n + 2 * most)
            # words beyond the text count as none
            mine = (where >= first[doc][:, None]) & (where < first[doc + 1][:, None])
            windows = np.where(mine, tokens[np.clip(where, 0, len(tokens) - 1)], np.uint64(0))
            fit = holds(t, windows, n - most)
            doc, at, d = doc[fit], at[fit], distance(t, windows[fit], most)
            for dd, aa, oo in zip(d[d <= most].tolist(), at[d <= most].tolist(), doc[d <= most].tolist()):
                if (key := (oo, k)) not in best or dd < best[key][0]:
                    best[key] = (dd, aa - int(first[oo]))
        for (o, k), (d, a) in sorted(best.items()):
            out[o].append((self.ids[k], d, max(0, a)))
        return out


def blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The query set, in blocks of about `size` items and at most about BLOCK_BYTES; each is read on its own."""
    own = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).filter(F.col("t").isNotNull() & F.col("i").isNotNull())
    whole = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    n = max(1, -(-whole["n"] // size), -(-whole["b"] // BLOCK_BYTES))
    for k in range(n):
        part = own if n == 1 else own.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def find(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, edits, first_word: one row per document and item found in it."""
    kind = "doc_id long, item_id long, edits int, first_word long"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts: list[DataFrame] = []
    for items in blocks(benchmark, block_items):
        if parts:  # a benchmark of several blocks: what a block found is written, its items leave the driver and the plan
            parts[-1] = spill(parts[-1], "found")

        def run(batches, items=items):
            index = Index(items)
            for b in batches:
                ids, texts, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
                for i, j in chunks(texts, CHUNK):
                    for d, found in zip(ids[i:j], index.search(texts[i:j])):
                        rows += [(d, *f) for f in found]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "edits", "first_word"])

        parts.append(own.mapInArrow(run, kind))
        del items, run
    return functools.reduce(DataFrame.unionByName, parts)


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found."""
    at = docs.columns.index("text")
    for items in blocks(benchmark, block_items):

        def run(batches, items=items):
            index = Index(items)
            for b in batches:
                texts = b.column(at).to_pylist()
                clean = [not f for i, j in chunks(texts, CHUNK) for f in index.search(texts[i:j])]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document: its items and the fewest edits."""
    d = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.min("edits").cast("long").alias("fewest_edits"),
    )
