"""Cross-tokenizer alignment by interval coalescing.

The tokens of two vocabularies A and B over one text are byte intervals. All of them are sorted by start; the running
maximum of their ends tells where a group breaks: a token that starts where everything before it has ended opens a new
one. Within a group every A token is linked with the B tokens whose bytes it overlaps.

A text is cut before each run of white space, where neither vocabulary merges across (B's pieces are searched for white
space after another character when they are loaded; a text with a character that merges so isn't cut). Each distinct piece is encoded and coalesced once per worker, so that a
text's groups and links are those of its pieces, in order.

How often each pair of ids is linked over the whole corpus is a table. Its most frequent pairs, at most COMMON of them
(12 bytes each), go to every task; what a text has of the others meets the table in a join. Both ways are exact.

Defined results: null and empty texts, and texts that a vocabulary doesn't give back byte for byte, have zeros and the
column '' for their groups; repeated rows and equal doc_ids keep one row each and all count; a null doc_id stays null;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, small_batches, spill, table

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space of the pattern that splits text for A
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
CROSSES = re.compile(f"[^{SPACE}][{SPACE}]")
ENDS_BLANK = re.compile(f".*[{SPACE}]\\Z", re.S).match
#: Pieces that a worker remembers before it starts afresh, the longest of them, and characters worked on at once (memory only).
PIECES, LONGEST, AT_ONCE = 500_000, 48, 1 << 20
#: Pairs given to every task, at most.
COMMON = 1 << 20
FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<int>, times array<int>"


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., size[0] of them, then those of start[1] and so on."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def coalesce(a_end: np.ndarray, b_end: np.ndarray, a_start: np.ndarray, b_start: np.ndarray) -> tuple:
    """(group of each A token, group of each B token, links as positions in A and in B), over one axis of bytes."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(opens) - 1
    lo = np.searchsorted(b_end, a_start, side="right")
    size = np.searchsorted(b_start, a_end, side="left") - lo
    return group[: len(a_end)], group[len(a_end) :], np.repeat(np.arange(len(a_end)), size), ranges(lo, size)


class Pair:
    """Two vocabularies, and the pieces that this worker has met: n_a, n_b, n_groups, links and the groups' text of each."""

    _of: dict[tuple[str, str], "Pair"] = {}

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.n_b = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("\u2581", " ").encode() for i, t in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        crossing = {m[0][1] for t in names for m in CROSSES.finditer(t.replace("\u2581", " "))}
        self.whole = re.compile(f"[{re.escape(''.join(crossing))}]").search if crossing else lambda text: None
        if len(self.a_bytes) * self.n_b >= 1 << 31:
            raise ValueError("an id pair must fit 31 bits")
        self.forget()

    @classmethod
    def get(cls, a_path: str, b_path: str) -> "Pair":
        if (a_path, b_path) not in cls._of:
            cls._of[a_path, b_path] = cls(a_path, b_path)
        return cls._of[a_path, b_path]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[bytes] = []
        self.counts, self.links = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.at = np.zeros(1, dtype=np.int64)  # where each piece's links begin

    def _ids(self, joined: str) -> tuple | None:
        """Ids of both for a text that begins with white space; None if either doesn't give its bytes back."""
        raw = joined.encode()
        a = self.a.encode(joined, add_special_tokens=False).ids
        b = self.b.encode("x" + joined)[1:]  # B puts a blank before the mark, which is an id of its own
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def learn(self, pieces: list[str]) -> list[int]:
        """Adds pieces; the number of each, -1 for one that isn't given back. Where a neighbour could merge with it, a piece is encoded alone."""
        lines, line, size = [], [], 0
        for k, p in enumerate(pieces):
            if len(p) > LONGEST or ENDS_BLANK(p) or self.whole(p):
                lines.append([k])
                continue
            line.append(k)
            size += len(p)
            if size > 4000:
                lines.append(line)
                line, size = [], 0
        lines += [line] if line else []
        number, todo = [-1] * len(pieces), []
        while lines:
            line = lines.pop()
            ids = self._ids("".join([pieces[k] for k in line]))
            if ids is not None:
                todo.append((line, *ids))
            elif len(line) > 1:
                lines += [line[: len(line) // 2], line[len(line) // 2 :]]
        if not todo:
            return number
        order = [k for line, _, _ in todo for k in line]
        a, b = np.concatenate([t[1] for t in todo]), np.concatenate([t[2] for t in todo])
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.cumsum([len(pieces[k].encode()) for k in order])
        a_group, b_group, i, j = coalesce(a_end, b_end, a_end - self.a_size[a], b_end - self.b_size[b])
        a_at, b_at = np.searchsorted(a_end, ends, side="right"), np.searchsorted(b_end, ends, side="right")
        g_at, l_at = a_group[a_at - 1] + 1, np.searchsorted(i, a_at)
        counts = np.diff(np.stack([a_at, b_at, g_at, l_at], axis=1), axis=0, prepend=0)
        said_a, said_b = _joined(a, a_group), _joined(b, b_group)
        groups = [f"{x}|{y}" for x, y in zip(said_a, said_b)]
        lo, base = 0, len(self.text)
        for k, hi in zip(order, g_at.tolist()):
            number[k] = len(self.text)
            self.text.append(";".join(groups[lo:hi]).encode())
            lo = hi
        self.counts = np.concatenate([self.counts[:base], counts])
        self.links = np.concatenate([self.links[: self.at[base]], (a[i] * self.n_b + b[j]).astype(np.int32)])
        self.at = np.concatenate([self.at[: base + 1], self.at[base] + l_at])
        return number

    def pieces(self, text: str) -> list[str]:
        return [" " + text] if self.whole(text) else PIECE.findall(" " + text)

    def profiles(self, texts: list[str | None]) -> dict:
        """Columns n_a .. n_links, groups_sha256, and each text's links: `keys`, `times`, and how many keys a text has."""
        per = [self.pieces(t) if t and "\u2581" not in t else [] for t in texts]
        words = [w for p in per for w in p]
        if len(self.known) > PIECES:
            self.forget()
        found = list(map(self.known.get, words))
        new = list(dict.fromkeys([w for w, k in zip(words, found) if k is None]))
        kept, long = [w for w in new if len(w) <= LONGEST], [w for w in new if len(w) > LONGEST]
        self.known.update(zip(kept, self.learn(kept)))
        mark = len(self.text)
        once = dict(zip(long, self.learn(long)))  # met in this batch only
        index = np.array([k if k is not None else once[w] if len(w) > LONGEST else self.known[w] for w, k in zip(words, found)], dtype=np.int64)
        doc = np.repeat(np.arange(len(per)), [len(p) for p in per])
        bad = np.zeros(len(per), dtype=bool)
        bad[doc[index < 0]] = True
        good = ~bad[doc]
        index, doc = index[good], doc[good]
        first = np.searchsorted(doc, np.arange(len(per) + 1))
        totals = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(self.counts[index], axis=0)])
        totals = totals[first[1:]] - totals[first[:-1]]
        listed = index.tolist()
        said = ["" if lo == hi else hashlib.sha256(b";".join([self.text[k] for k in listed[lo:hi]])).hexdigest() for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]
        both, n = np.unique(doc << 32 | index, return_counts=True)
        piece = both & 0xFFFFFFFF
        size = self.at[piece + 1] - self.at[piece]
        key = np.repeat((both >> 32) << 31, size) | self.links[ranges(self.at[piece], size)]
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.repeat(n, size)[order]
        opens = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[opens], np.add.reduceat(n, opens) if len(opens) else n
        out = {"totals": totals, "said": said, "keys": (key & 0x7FFFFFFF).astype(np.int32), "times": n.astype(np.int32), "at": np.searchsorted(key >> 31, np.arange(len(per) + 1)).astype(np.int32)}
        if long:  # what was met once is dropped
            del self.text[mark:]
            self.counts, self.links, self.at = self.counts[:mark], self.links[: self.at[mark]], self.at[: mark + 1]
        return out


def _joined(ids: np.ndarray, group: np.ndarray) -> list[str]:
    names, cut = list(map(str, ids.tolist())), np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(ids)]
    return [",".join(names[i:j]) if j > i + 1 else names[i] for i, j in zip(cut, cut[1:])]


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row its counts and digest, and its links as id pairs (a * number of B ids + b) with how often each occurs."""

    def run(batches):
        pair = Pair.get(a_path, b_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            lo = size = 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= AT_ONCE or k == len(texts) - 1:
                    p = pair.profiles(texts[lo : k + 1])
                    at = pa.array(p["at"])
                    cols = [pa.array(p["totals"][:, c]) for c in range(4)]
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, k + 1 - lo), *cols, pa.array(p["said"], pa.string()), pa.ListArray.from_arrays(at, pa.array(p["keys"])), pa.ListArray.from_arrays(at, pa.array(p["times"]))], [f.split()[0] for f in FIELDS.split(", ")])
                    lo, size = k + 1, 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FIELDS)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    opens = np.flatnonzero(np.diff(key, prepend=-1))
    return key[opens], np.add.reduceat(n[order], opens) if len(opens) else n


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """(key, n, best): how often each id pair is linked over all rows, and whether no pair with its B id is oftener.
    Tasks sum what they hold, a few million pairs at a time, before anything is shuffled."""

    def partial(batches):
        keys, times, held = [], [], 0
        for b in batches:
            keys.append(b.column(0).flatten().to_numpy(zero_copy_only=False))
            times.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(keys[-1])
            if held > 4 << 20:
                k, n = _summed(np.concatenate(keys), np.concatenate(times))
                if len(k) > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
                    k, n = k[:0], n[:0]
                keys, times, held = [k], [n], len(k)
        if held:
            k, n = _summed(np.concatenate(keys), np.concatenate(times))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])

    counts = found.select("keys", "times").mapInArrow(partial, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = spill(counts, "pair-counts")
    most = counts.groupBy((F.col("key") % n_b).alias("b")).agg(F.max("n").alias("most"))
    out = counts.join(most, F.col("key") % n_b == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    out = spill(out, "pairs")
    discard(counts)
    return out


def common_pairs(pairs: DataFrame, most: int) -> tuple:
    """The most frequent pairs, at most `most`: sorted keys, counts, marks; and the least count taken."""
    power = F.floor(F.log2("n") * 8).cast("int")  # eighths of a power of two: some hundred rows at any size
    floor, total = None, 0
    for r in sorted(pairs.groupBy(power.alias("p")).agg(F.count("*").alias("c"), F.min("n").alias("n")).collect(), key=lambda r: -r["p"]):
        total += r["c"]
        if total > most:
            break
        floor = r["n"]
    t = pairs.filter(F.col("n") >= floor).toArrow() if floor is not None else pairs.limit(0).toArrow()
    key, n, best = (t.column(c).to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(key)
    return key[order], n[order].astype(np.int64), best[order].astype(bool)


def align(docs: DataFrame, a_path: str, b_path: str, common: int = COMMON) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    found = spill(links(docs, a_path, b_path), "links")
    pairs = pair_counts(found, n_b)
    held = spark.sparkContext.broadcast(common_pairs(pairs, common))

    def score(batches):
        key, n, best = held.value
        for b in batches:
            at, lists = b.column(6).offsets.to_numpy(), b.column(6).flatten().to_numpy(zero_copy_only=False)
            times = b.column(7).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            if len(key):
                where = np.minimum(np.searchsorted(key, lists), len(key) - 1)
                hit = key[where] == lists
            else:
                where, hit = np.zeros(len(lists), dtype=np.int64), np.zeros(len(lists), dtype=bool)
            sums, bests = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            w, d, t = where[hit], doc[hit], times[hit]
            if len(w):
                np.add.at(sums, d, t * n[w])
                np.add.at(bests, d, t * best[w])
            rest = np.concatenate([[0], np.cumsum(~hit)]).astype(np.int32)[at - at[0]]
            rest = pa.array(rest)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(rest, pa.array(lists[~hit])), pa.ListArray.from_arrays(rest, pa.array(times[~hit]))], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "keys", "times"])

    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, keys array<int>, times array<long>"
    rows = spill(found.mapInArrow(score, shape).withColumn("row", F.monotonically_increasing_id()), "scored")
    discard(found)
    rare = rows.filter(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("t"))
    rare = rare.join(pairs, "key").groupBy("row").agg(F.sum(F.col("t") * F.col("n")).alias("more_sum"), F.sum(F.col("t") * F.col("best").cast("long")).alias("more_best"))
    out = rows.drop("keys", "times").join(rare, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
