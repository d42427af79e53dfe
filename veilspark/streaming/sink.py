"""Masked requests as a stream sink: what may go out, and the vaults that stay.

Each micro-batch is one partition of both tables, named by the batch's number and replaced as a whole, so that a batch
that is run again after a failure writes what it wrote before and nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bodies

#: The header that says which version of the interface a request speaks, and the version if it says none.
VERSION_HEADER, VERSION = "anthropic-version", "2023-06-01"


def versioned(headers: Column) -> Column:
    """Headers with the version header, which is added only where no key is it, in whatever case."""
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(headers, none)
    has = F.exists(F.map_keys(own), lambda k: F.lower(k) == VERSION_HEADER)
    return F.when(has, own).otherwise(F.map_concat(own, F.create_map(F.lit(VERSION_HEADER), F.lit(VERSION))))


def write_batch(batch: DataFrame, number: int, out: str, vaults: str, schema: str, **masking) -> None:
    """Masks one batch (request_id, body, headers) and writes requests that may go out, with the reason where one may
    not, to `out`, and (request_id, placeholder, original) to `vaults`."""
    own = batch.select("request_id", "headers", bodies.masked(F.col("body"), schema, **masking).alias("m")).persist()
    try:
        headers = versioned(F.col("headers")) if schema == "anthropic" else F.coalesce("headers", F.create_map().cast("map<string,string>"))
        sent = own.select("request_id", F.col("m.body").alias("body"), F.when(F.col("m.body").isNotNull(), headers).alias("headers"), F.col("m.status").alias("status"))
        kept = own.select("request_id", F.explode("m.vault").alias("placeholder", "original"))
        for table, path in ((kept, vaults), (sent, out)):  # vaults first: what goes out can always be restored
            numbered = table.withColumn("batch", F.lit(number).cast("long"))
            numbered.write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(path)
    finally:
        own.unpersist()


def start(requests: DataFrame, out: str, vaults: str, checkpoint: str, schema: str, trigger: dict | None = None, **masking):
    """Starts the stream (request_id, body, headers); trigger: as for DataStreamWriter.trigger."""
    writer = requests.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, out, vaults, schema, **masking)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
