"""Token-ID output: static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all blocks. A block holds whole documents, is coded
over interleaved lanes and carries the lane states at regular steps (checkpoints), so that it can be decoded from any
checkpoint, or from all of them side by side; checksums guard the payload and the decoded ids. Blocks are independent
of one another: a lost task repeats only its own.

The file is a Parquet container (written and read by Spark on any store); each row is one binary block plus its index:
shard, block number, document ids and lengths. Shards follow ascending doc_id.

Defined results: a null text counts as empty (its only id is the end id); equal doc_ids keep one row each, ordered by
their ids; an empty table gives an empty file; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Tokens, discard, scratch, shuffle_partitions, spill

BITS = 18  # the table's frequencies add up to 2**BITS
LOW = np.uint64(1 << 31)  # lane states stay in [2**31, 2**63)
LANES = 1024
STEP = 128  # steps between checkpoints
BLOCK = 1 << 19  # a block ends with the first document that brings it to so many ids
HEAD = struct.Struct("<4sBIIIIIII")
MAGIC, VERSION = b"SRAN", 1
VOCABULARY = 1 << 16


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**BITS; every id that occurs gets at least 1."""
    total = int(counts.sum())
    freq = np.zeros(len(counts), dtype=np.int64)
    if not total:
        freq[0] = 1 << BITS
        return freq
    seen = counts > 0
    freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * (1 << BITS) / total).astype(np.int64))
    while (over := int(freq.sum()) - (1 << BITS)) != 0:
        if over < 0:
            freq[int(freq.argmax())] -= over
        else:
            large = np.argsort(-freq, kind="stable")[: max(1, min(over, int((freq > 1).sum())))]
            cut = np.minimum(freq[large] - 1, np.maximum(1, over // len(large)))
            cut = np.where(np.cumsum(cut) <= over, cut, 0)
            if not cut.any():
                cut[0] = min(over, int(freq[large[0]]) - 1)
            freq[large] -= cut
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
        self.pad = int(freq.argmax())

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = LANES
        while lanes > 1 and n < lanes * 64:
            lanes //= 2
        steps = -(-n // lanes)
        every = min(STEP, max(1, steps))
        steps = -(-steps // every) * every
        grid = np.full(steps * lanes, self.pad, dtype=np.int64)
        grid[:n] = ids
        grid = grid.reshape(steps, lanes)
        f, c = self.freq[grid], self.cum[grid]
        most = f << np.uint64(63 - BITS)
        x = np.full(lanes, LOW, dtype=np.uint64)
        words: list = [None] * steps
        points = []
        for t in range(steps - 1, -1, -1):
            full = x >= most[t]
            words[t] = x[full].astype(np.uint32)
            x = np.where(full, x >> np.uint64(32), x)
            q, r = np.divmod(x, f[t])
            x = (q << np.uint64(BITS)) + r + c[t]
            if t % every == 0:
                points.append(x)
        start = np.cumsum([0] + [len(w) for w in words])[: steps or 1 : every].astype("<u4") if steps else np.zeros(0, "<u4")
        states = np.array(points[::-1], dtype="<u8")
        stream = np.concatenate(words).astype("<u4") if steps else np.zeros(0, "<u4")
        body = states.tobytes() + start.tobytes() + stream.tobytes()
        raw = zlib.crc32(ids.astype("<u4").tobytes())
        return HEAD.pack(MAGIC, VERSION, n, lanes, steps, every, len(stream), raw, zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids between two checkpoints (all by default; then the ids' own checksum is compared too)."""
        magic, version, n, lanes, steps, every, n_words, raw, check = HEAD.unpack_from(block)
        body = memoryview(block)[HEAD.size :]
        if magic != MAGIC or version != VERSION or zlib.crc32(body) != check:
            raise ValueError("damaged block: its checksum does not match")
        points = steps // every if steps else 0
        x = np.frombuffer(body, "<u8", points * lanes).reshape(points, lanes).astype(np.uint64)
        at = np.frombuffer(body, "<u4", points, points * lanes * 8).astype(np.int64)
        words = np.frombuffer(body, "<u4", n_words, points * lanes * 8 + points * 4).astype(np.uint64)
        last = points if last is None else last
        x, at = x[first:last].copy(), at[first:last].copy()
        out = np.empty((len(x), every, lanes), dtype=np.uint16)
        low = np.uint64((1 << BITS) - 1)
        for j in range(every if len(x) else 0):
            slot = x & low
            s = self.symbol[slot]
            out[:, j] = s
            x = self.freq[s] * (x >> np.uint64(BITS)) + slot - self.cum[s]
            need = x < LOW
            k = np.cumsum(need, axis=1)
            where = (at[:, None] + k - 1)[need]
            x[need] = (x[need] << np.uint64(32)) | words[where]
            at += k[:, -1]
        ids = out.reshape(-1)[: max(0, min(n, last * every * lanes) - first * every * lanes)]
        if first == 0 and last == points and zlib.crc32(ids.astype("<u4").tobytes()) != raw:
            raise ValueError("damaged block: its ids do not match their checksum")
        return ids


def tokenise(docs: DataFrame, tokenizer: str, lead: bool, end_id: int = 0) -> DataFrame:
    """doc_id, ids (little-endian uint16, the end id appended)."""

    def run(batches):
        tok = Tokens.get(tokenizer, lead)
        end = struct.pack("<H", end_id)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 2000):
                ids = [x + end for x in tok.encode([t or "" for t in texts[i : i + 2000]])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 2000), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Counts over all documents: one partial row per id and task, summed by Spark; at most VOCABULARY rows come back."""

    def run(batches):
        n = np.zeros(VOCABULARY, dtype=np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2"), minlength=VOCABULARY)
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(n[ids])], ["id", "n"])

    sums = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    n = np.zeros(VOCABULARY, dtype=np.int64)
    n[got["id"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return n


BLOCKS = "shard int, block int, n_docs int, n_ids long, doc_ids binary, null_ids binary, lengths binary, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, lead: bool = True, end_id: int = 0) -> None:
    """Encodes every text and writes the file, in ascending doc_id order, to `path`."""
    spark = docs.sparkSession
    tokens = spill(tokenise(docs, tokenizer, lead, end_id), "token-ids")
    freq = quantise(frequencies(tokens))

    def run(batches):
        coder = Coder(freq)
        shard, block, ids, docs_, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            lengths = np.array([len(x) // 2 for x in ids], dtype="<i8")
            known = np.array([d or 0 for d in docs_], dtype="<i8")
            null = np.packbits(np.array([d is None for d in docs_], dtype=bool)).tobytes()
            payload = coder.encode(np.frombuffer(b"".join(ids), "<u2"))
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "n_docs": len(ids), "n_ids": int(lengths.sum()), "doc_ids": known.tobytes(), "null_ids": null, "lengths": lengths.tobytes(), "payload": payload}],
                pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())]),
            )

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(x)
                docs_.append(d)
                size += len(x) // 2
                if size >= BLOCK:
                    yield row()
                    block, ids, docs_, size = block + 1, [], [], 0
        if ids:
            yield row()

    ordered = tokens.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    seen = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in seen], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    discard(tokens)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int)."""
    got = spark.read.parquet(f"{path}/table").toPandas()  # at most VOCABULARY rows
    freq = np.zeros(VOCABULARY, dtype=np.int64)
    freq[got["id"].to_numpy(dtype=np.int64)] = got["freq"].to_numpy(dtype=np.int64)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per shard
    base = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    inside = blocks.select("shard", "block", (F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("within"))
    starts = inside.join(base, "shard").select("shard", "block", (F.col("before") + F.col("within")).alias("first"))
    fields = [pa.field("shard", pa.int32()), pa.field("block", pa.int32()), pa.field("doc_id", pa.int64()), pa.field("inner", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_crc32", pa.int64())] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches):
        coder = Coder(freq)
        for b in batches:
            for r in b.to_pylist():
                ids = coder.decode(r["payload"]).astype("<u4")
                lengths = np.frombuffer(r["lengths"], "<i8")
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8), count=r["n_docs"]).astype(bool)
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8").astype(np.int64), mask=null)
                ends = np.cumsum(lengths)
                begins = (ends - lengths).astype(np.int64)
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(begins.tolist(), ends.tolist())]
                n = len(lengths)
                cols = [pa.array(np.full(n, r["shard"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), doc, pa.array(begins), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    kinds = "shard int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = blocks.select("shard", "block", "n_docs", "doc_ids", "null_ids", "lengths", "payload").mapInArrow(run, kinds)
    out = rows.join(starts, ["shard", "block"])
    return out.select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = scratch(spark, "rans")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)
