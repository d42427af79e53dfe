"""Stages between a client and a provider: applied to requests in order and to replies in reverse order.

A stage has a name and two functions of tables. Requests have request_id, schema, body, headers, vault and status; a
stage may block a row by setting a status other than `ok`, and the first reason stays: later stages see no body of it. Replies have request_id, schema, body and vault. Whatever a stage adds travels on to the next one.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bodies
from ..operators.detectors import Chain
from ..sources import requests as R

OK = "ok"


class Stage(Protocol):
    name: str

    def on_request(self, requests: DataFrame) -> DataFrame: ...

    def on_response(self, replies: DataFrame) -> DataFrame: ...


class Admission:
    """Blocks bodies that are too long or no JSON. Replies pass."""

    name = "admission"

    def __init__(self, limit: int = R.MAX_BODY):
        self.limit = limit

    def on_request(self, requests: DataFrame) -> DataFrame:
        why = F.when(F.col("body").isNull(), "blocked: no body").when(F.octet_length("body") > self.limit, "blocked: body too long").when(F.try_parse_json("body").isNull(), "blocked: no JSON")
        return requests.withColumn("status", F.coalesce(why, F.lit(OK)))

    def on_response(self, replies: DataFrame) -> DataFrame:
        return replies


class Privacy:
    """Masks requests of both shapes and restores their replies from the vault that it leaves."""

    name = "privacy"

    def __init__(self, chain: Chain | None = None, **masking):
        self.masking = masking | ({"chain": chain} if chain else {})

    def on_request(self, requests: DataFrame) -> DataFrame:
        of = lambda kind: bodies.masked(F.when(F.col("schema") == kind, F.col("body")), kind, **self.masking)
        d = requests.withColumn("__m", F.when(F.col("schema") == "anthropic", of("anthropic")).when(F.col("schema") == "openai", of("openai")))
        status = F.coalesce("__m.status", F.lit("blocked: unknown shape"))
        return d.withColumns({"body": F.col("__m.body"), "vault": F.col("__m.vault"), "status": status}).drop("__m")

    def on_response(self, replies: DataFrame) -> DataFrame:
        of = lambda kind: bodies.restored(F.col("body"), F.col("vault"), kind)
        return replies.withColumn("body", F.when(F.size("vault") > 0, F.when(F.col("schema") == "anthropic", of("anthropic")).otherwise(of("openai"))).otherwise(F.col("body")))


def outbound(requests: DataFrame, stages: list[Stage]) -> DataFrame:
    """The requests with body, vault and status after all stages, in one pass: what a stage has blocked has no body and no
    vault for the next ones, and keeps its reason."""
    empty = F.create_map().cast("map<string,string>")
    d = requests.withColumns({"vault": empty, "status": F.lit(OK)})
    for stage in stages:
        d = stage.on_request(d.withColumn("status_before", F.col("status")))
        d = d.withColumn("status", F.when(F.col("status_before") != OK, F.col("status_before")).otherwise(F.col("status"))).drop("status_before")
        ok = F.col("status") == OK
        d = d.withColumns({"body": F.when(ok, F.col("body")), "vault": F.when(ok, F.col("vault")).otherwise(empty)})
    return d


def inbound(replies: DataFrame, sent: DataFrame, stages: list[Stage]) -> DataFrame:
    """Replies (request_id, body) through all stages, the last one first; their shapes and vaults come from what was sent."""
    d = replies.select("request_id", "body").join(sent.select("request_id", "schema", "vault"), "request_id")
    for stage in reversed(stages):
        d = stage.on_response(d)
    return d
