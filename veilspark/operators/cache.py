"""What was found in texts, kept between runs: a table in two generations.

A text's hash only says where to look: a bucket of the table, and a key of the join. What counts is the text itself, so
that texts of equal hashes never share a result. Kept are texts of some length for which the scan ended; a refused scan is
not kept. The newer generation takes what is found new, and what the older one had when it is asked for again; when it has
`most` texts, the next run starts a new one and drops the oldest. So texts that come back every time stay, and the table
never holds more than two generations.

One run writes at a time. A run that fails leaves files of a generation at most twice; equal rows count once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import NEEDED, SPAN, spans

LEAST, MOST_BYTES, BUCKETS = 256, 128 * 1024, 64
_SCHEMA = f"h long, text string, spans array<{SPAN}>, generation long, bucket int"


class TextCache:
    """A cache in a folder that driver and executors share. names, locales, units: what the scan looks for; a folder holds
    results of one such setting."""

    def __init__(self, spark: SparkSession, path: str, most: int = 1_000_000, names: list[str] | None = None, locales: list[str] | None = None, units: float = float("inf"), buckets: int = BUCKETS, hash_: Column | None = None):
        self.spark, self.path, self.most, self.buckets = spark, path.rstrip("/"), most, buckets
        self.names, self.locales, self.units, self.hash = names, locales, units, hash_

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        fs, p = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))

    def table(self) -> DataFrame:
        """All that is kept: h, text, spans, generation."""
        if not self.generations():
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(*[f"{self.path}/generation={g}" for g in self.generations()])

    def _drop(self, generation: int) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generation={generation}"), True)

    def find(self, df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
        """df with the raw spans of its texts (null where the scan was refused); scans each text that isn't kept once."""
        t = F.col(text)
        h = self.hash if self.hash is not None else F.xxhash64(t)
        worth = F.coalesce(F.octet_length(t).between(LEAST, MOST_BYTES) & t.rlike(NEEDED), F.lit(False))
        wanted = df.filter(worth).select(h.alias("h"), t.alias("text")).distinct()
        kept = self.table()
        current = max(self.generations(), default=0)
        full = kept.filter(F.col("generation") == current).limit(self.most).count() >= self.most
        own = kept.groupBy("h", "text").agg(F.max_by("spans", "generation").alias("spans"), F.max("generation").alias("generation"))
        met = wanted.join(own, ["h", "text"], "left").withColumn("bucket", F.pmod("h", F.lit(self.buckets)).cast("int"))
        here = current + 1 if full else current
        old = met.filter(F.col("spans").isNotNull() & (F.col("generation") < here)).select("h", "text", "spans", "bucket")
        new = met.filter(F.col("spans").isNull()).select("h", "text", spans(F.col("text"), self.names, self.locales, self.units).alias("spans"), "bucket")
        # the table is read and written in one run: the rows go to a folder of their own first, then into the generation
        fresh = f"{self.path}/run-{uuid.uuid4().hex}"
        old.unionByName(new).filter("spans IS NOT NULL").write.parquet(fresh)
        self.spark.read.parquet(fresh).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/generation={here}")
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(fresh), True)
        for g in self.generations():
            if g < here - 1:
                self._drop(g)
        found = self.table().groupBy("h", "text").agg(F.max_by("spans", "generation").alias("found")).select(F.col("h").alias("its_hash"), F.col("text").alias("its_text"), "found")
        long = df.filter(worth).join(found, (h == F.col("its_hash")) & (t == F.col("its_text")), "left").select(*df.columns, F.col("found").alias(out))
        short = df.filter(~worth).withColumn(out, spans(t, self.names, self.locales, self.units))
        return long.unionByName(short)
