"""Texts of plain bodies without leaving the JVM, and a table function for SQL.

A body is plain if its messages hold texts only: strings, lists of strings and of text objects, and null; no tools, tool
calls or documents. It is parsed as a variant once, and its texts are expressions on that. Every other body, and every one
that the two JSON readers could take differently (half surrogates, a key twice, anything after the end), goes through the
walk in Python (functions/walks.py), which also decides what is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import scan as S
from ..functions import walks
from . import bodies

_TEXTS = "array<struct<path:string,text:string>>"


def _kind(v: Column) -> Column:
    """STRING, VOID, OBJECT, ARRAY or another type's name; VOID for what isn't there."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1), F.lit("VOID"))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _parsed(body: Column) -> Column:
    """The body as a variant; null if it is no JSON or doesn't end where its value ends. A reader of variants stops at the
    end of the first value, so that the body is put into an object that must still tell the body's digest after it."""
    digest = F.sha2(body, 256)
    v = F.try_parse_json(F.concat(F.lit('{"b":'), body, F.lit(',"end":"'), digest, F.lit('"}')))
    whole = (_get(v, "$.end", "string") == digest) & ~body.rlike(r"\\u[dD][89a-fA-F]")
    return F.when(whole, _get(v, "$.b"))


def _one(path: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(path).alias("path"), text.alias("text")))


def _none() -> Column:
    return F.array().cast(_TEXTS)


def _parts(parts: Column, schema: str) -> Column:
    """Texts of a list of parts; null if one of them isn't plain."""

    def text(p: Column) -> Column:
        own = F.when(_kind(_get(p, "$.text")) == "STRING", _one("content", _get(p, "$.text", "string"))).otherwise(_none())
        if schema == "anthropic":
            own = F.when(_get(p, "$.type", "string") == "text", own)
        return F.when(_kind(p) == "STRING", _one("content", _get(p, "$", "string"))).when(_kind(p) == "OBJECT", own)

    each = F.transform(parts, text)
    return F.when(F.forall(each, lambda x: x.isNotNull()), F.flatten(each))


def _message(m: Column, schema: str) -> Column:
    """Texts of a message; null if it isn't plain."""
    content, kind = _get(m, "$.content"), _kind(_get(m, "$.content"))
    own = F.when(kind == "VOID", _none()).when(kind == "STRING", _one("content", _get(content, "$", "string"))).when(kind == "ARRAY", _parts(_get(m, "$.content", "array<variant>"), schema))
    if schema == "openai":
        calls = (_kind(_get(m, "$.tool_calls")) != "VOID") | (_kind(_get(m, "$.function_call")) != "VOID")
        name = F.when(_kind(_get(m, "$.name")) == "STRING", _one("name", _get(m, "$.name", "string"))).otherwise(_none())
        own = F.when(~calls, F.concat(own, name))
    return F.when(_kind(m) == "OBJECT", own).otherwise(_none())


def plain_texts(body: Column, schema: str) -> Column:
    """Array of (path, text) of a plain body in reading order; null if the body isn't plain."""

    def of(v: Column) -> Column:
        each = F.transform(_get(v, "$.messages", "array<variant>"), lambda m: _message(m, schema))
        own = F.when(F.forall(each, lambda x: x.isNotNull()), F.flatten(each))
        if schema == "anthropic":
            kind = _kind(_get(v, "$.system"))
            own = F.concat(F.when(kind == "VOID", _none()).when(kind == "STRING", _one("system", _get(v, "$.system", "string"))), own)
        return F.when((_kind(v) == "OBJECT") & (_kind(_get(v, "$.tools")) == "VOID"), own)

    # a lambda over one element: the variant is parsed once, not once for each use
    return F.element_at(F.transform(F.array(_parsed(body)), of), 1)


def plain_fields(requests: DataFrame, schema: str) -> DataFrame:
    """request_id, field_ord, path, text of the plain bodies; without Python workers."""
    found = requests.select("request_id", plain_texts(F.col("body"), schema).alias("texts")).filter("texts IS NOT NULL")
    return found.select("request_id", F.posexplode("texts").alias("field_ord", "f")).select("request_id", "field_ord", "f.path", "f.text")


def fields(requests: DataFrame, schema: str) -> DataFrame:
    """As bodies.fields, in one pass over the bodies; only those that aren't plain are sent to Python."""
    d = requests.select("request_id", "body", plain_texts(F.col("body"), schema).alias("plain"))
    odd = bodies.texts(F.when(F.col("plain").isNull(), F.col("body")), schema)["texts"]
    found = d.select("request_id", F.coalesce("plain", odd).alias("texts"))
    return found.select("request_id", F.posexplode("texts").alias("field_ord", "f")).select("request_id", "field_ord", "f.path", "f.text")


class TextFields:
    """text_fields(body, shape): one row for each text of a body. A blocked or null body gives no rows."""

    @staticmethod
    def analyze(body: AnalyzeArgument, shape: AnalyzeArgument) -> AnalyzeResult:
        if shape.value not in walks.WALKS:
            raise ValueError(f"shape: one of {', '.join(walks.WALKS)}, as a constant")
        return AnalyzeResult(StructType().add("field_ord", IntegerType()).add("path", StringType()).add("text", StringType()))

    def eval(self, body: str, shape: str):
        found: list[tuple] = []

        def keep(path, text):
            bodies.check_encodes(text)
            found.append((len(found), path, text))
            return text

        try:
            walks.WALKS[shape](walks.load(body or ""), keep)
        except (S.Blocked, RecursionError):
            return
        yield from found


def register(spark: SparkSession) -> None:
    """Makes text_fields() known to SQL: SELECT ... FROM bodies, LATERAL text_fields(body, 'openai')."""
    spark.udtf.register("text_fields", udtf(TextFields))
