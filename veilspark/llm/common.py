"""Shared helpers: the shared scratch folder, table reading, and a tokenizer with a word cache."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept per Python worker before the cache starts afresh (bounds its memory, not the result).
CACHE_WORDS = 1_500_000
#: Bytes of an Arrow batch between the JVM and Python, unless the session asks for smaller ones (bounds memory only).
BATCH_BYTES = 4 << 20
#: Setting of Spark: the files of a query's shuffles go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ODD = b"odd"  # no ids have three bytes
#: A piece of text between blanks: no white space but a line end before it.
PIECE = re.compile(r"\n?\S+\Z").match


def small_batches(spark: SparkSession) -> None:
    """Ten thousand long texts in one batch would be held several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or what setCheckpointDir was given."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and sc.master.startswith("local"):  # one machine: a folder beside the warehouse is shared
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        sc.setCheckpointDir(root)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends here, and any executor can read it again. What
    was shuffled for it is deleted once it is written."""
    spark = df.sparkSession
    small_batches(spark)
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._spill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what spill() wrote, once nothing reads it any more."""
    path = getattr(df, "_spill_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: str = "doc_id"):
    """True for a third of the ids: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


class Tokens:
    """Token ids as little-endian uint16 bytes.

    The texts of a batch are cut at single blanks and line ends, where neither vocabulary merges across; each distinct
    piece is encoded once per worker. A text with other white space, or with more than one such character in a row, has
    pieces that say so (ODD in the cache) and goes through the tokenizer whole. `lead` says that a word keeps the blank
    before it (byte-level vocabularies) instead of dropping white space.

    Special tokens' strings in a text are ordinary text (encode_special_tokens), as the vocabularies' description asks.
    """

    _of: dict[tuple[str, bool], "Tokens"] = {}

    def __init__(self, path: str, lead: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.lead, self.cache, self.most = lead, {}, CACHE_WORDS
        self.marks = {c: x for c in ".," if len(x := self.whole(["a" + c])[0][len(self.whole(["a"])[0]) :]) == 2}
        if lead:  # ids whose token starts with the blank: the first of each word
            self.opens = np.zeros(1 << 16, dtype=bool)
            self.opens[[i for w, i in self.tok.get_vocab().items() if w.startswith("\u0120")]] = True
            self.line_end = self.tok.encode("\n", add_special_tokens=False).ids[0]

    @classmethod
    def get(cls, path: str, lead: bool, most: int = CACHE_WORDS) -> "Tokens":
        """The worker's own instance; most: pieces that it may remember."""
        if (path, lead) not in cls._of:
            cls._of[path, lead] = cls(path, lead)
        cls._of[path, lead].most = most
        return cls._of[path, lead]

    @classmethod
    def forget(cls, path: str, lead: bool) -> None:
        """Frees the worker's own instance with all that it remembers."""
        cls._of.pop((path, lead), None)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Encodes new pieces. A piece with a mark at its end has the ids of the rest, then the mark's, if a letter or
        digit stands before the mark: the tokenizer cuts there."""
        cache, marks, plain, opening, marked = self.cache, self.marks, set(), set(), []
        for w in words:
            if not PIECE(w):
                cache[w] = ODD
                continue
            if w[-1] in marks and w[-2:-1].isalnum():
                marked.append(w)
                w = w[:-1]
                if w in cache:
                    continue
            (opening if w[0] == "\n" else plain).add(w)
        self._plain(list(plain))
        self._opening(list(opening))
        for w in marked:
            cache[w] = cache[w[:-1]] + self.marks[w[-1]]

    def _opening(self, words: list[str]) -> None:
        """Pieces that begin with a line end: it is an id of its own and tells where each begins."""
        for i in range(0, len(words), 500):
            line = words[i : i + 500]
            ids = np.frombuffer(self.whole(["".join(line)])[0], "<u2")
            cut = (np.flatnonzero(ids == self.line_end) * 2).tolist() + [2 * len(ids)]
            ids = ids.tobytes()
            for k, w in enumerate(line):
                self.cache[w] = ids[cut[k] : cut[k + 1]]

    def _plain(self, words: list[str]) -> None:
        """Words in lines of 500; leading blanks or the offsets say which ids belong to which word."""
        cache = self.cache
        for i in range(0, len(words), 5000):
            lines = [words[j : j + 500] for j in range(i, min(i + 5000, len(words)), 500)]
            joined = [" " + " ".join(x) for x in lines]
            encode = self.tok.encode_batch_fast if self.lead else self.tok.encode_batch
            for line, e in zip(lines, encode(joined, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u2")
                if self.lead:
                    cut = (np.flatnonzero(self.opens[ids]) * 2).tolist() + [2 * len(ids)]
                else:
                    at = np.cumsum([0] + [len(w) + 1 for w in line])
                    last = np.array([b for _, b in e.offsets], dtype=np.int64)
                    cut = (np.searchsorted(last, at, side="right") * 2).tolist()
                    cut[0] = 0
                ids = ids.tobytes()
                for k, w in enumerate(line):
                    cache[w] = ids[cut[k] : cut[k + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [b""] * len(texts)
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        if self.lead:
            at = [i for i, x in enumerate(texts) if x]
            n = [texts[i].count(" ") + texts[i].count("\n") + 1 for i in at]
            words = ("\n" + "\n".join([texts[i] for i in at])).replace("\n", " \n").split(" ")[1:] if at else []
        else:  # separators that Python knows and the tokenizer doesn't
            at = [i for i, x in enumerate(texts) if x and not any(c in x for c in "\x1c\x1d\x1e\x1f\x85")]
            per = [texts[i].split() for i in at]
            n, words = [len(w) for w in per], [w for p in per for w in p]
        ids = list(map(cache.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        self.learn({words[k] for k in new})
        for k in new:
            ids[k] = cache[words[k]]
        known, lo = set(at), 0
        odd = [i for i, x in enumerate(texts) if x and i not in known]
        skip = 2 if self.lead else 0  # the line end put before each text
        for i, k in zip(at, n):
            own = ids[lo : lo + k]
            lo += k
            if ODD in own:
                odd.append(i)
            else:
                out[i] = b"".join(own)[skip:]
        if odd:
            for i, b in zip(odd, self.whole([texts[i] for i in odd])):
                out[i] = b
        return out
