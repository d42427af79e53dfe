"""Overlap resolution as windows and joins over a spans table (key, kind, start, end, text, verified)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .detect import PRIORITY


def priority(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[kind], F.lit(0))


def resolve(spans: DataFrame, key: str) -> DataFrame:
    """Unions of overlapping spans; spans that only touch stay apart.

    A union is named by an e-mail that spans it exactly, else by priority, then length, then first start; it stays
    verified only if the naming span equals it.
    """
    order = W.partitionBy(key).orderBy("start", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.select(F.col(key), "kind", "start", "end", "verified", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0).alias("begins"))
    grouped = marked.withColumn("run", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rank = F.struct(priority(F.col("kind")), (F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), F.col("kind"))
    winner = F.max_by(F.struct("kind", "start", "end", "verified"), rank)
    got = grouped.groupBy(key, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), winner.alias("w"),
        F.collect_set(F.when(F.col("kind") == "EMAIL", F.struct("start", "end"))).alias("mails"),
    )
    exact = F.exists("mails", lambda m: (m["start"] == F.col("start")) & (m["end"] == F.col("end")))
    whole = (F.col("w.start") == F.col("start")) & (F.col("w.end") == F.col("end"))
    return got.select(key, F.when(exact, F.lit("EMAIL")).otherwise(F.col("w.kind")).alias("kind"), "start", "end", (exact | (whole & F.col("w.verified"))).alias("verified"))


def drop_overlapping(names: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Model spans that overlap nothing kept: an interval anti-join, hashed on the key."""
    a, b = names.alias("a"), kept.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return a.join(b, on, "left_anti")


def histogram(spans: DataFrame) -> DataFrame:
    return spans.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Recall, precision and F1 per kind, counting (kind, text) as multisets."""
    a = found.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("f"))
    b = expected.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("e"))
    both = a.join(b, ["kind", "text"], "full").na.fill(0, ["f", "e"])
    t = both.groupBy("kind").agg(F.sum(F.least("f", "e")).alias("hit"), F.sum("f").alias("f"), F.sum("e").alias("e"))
    recall, precision = F.try_divide("hit", "e"), F.try_divide("hit", "f")
    return t.select("kind", recall.alias("recall"), precision.alias("precision"), F.try_divide(2 * recall * precision, recall + precision).alias("f1"))


def top_spender(units: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, kind, units: the kind that used most units; of equal ones the later in `order`."""
    per_kind = units.groupBy(key, "kind").agg(F.sum("units").alias("units")).filter("units > 0")
    at = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    return per_kind.groupBy(key).agg(F.max_by("kind", F.struct("units", at)).alias("kind"), F.max("units").alias("units"))
