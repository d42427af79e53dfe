"""Placeholders: numbering, masking and restoration.

A value keeps one placeholder per request, named by the kind under which it was first seen; numbers follow reading order
and leave out those that the text already uses. A token is `[KIND_n]`; restoration accepts other case, blanks, hyphens and
underscores inside the brackets and leaves unknown tokens as they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scan as S
from .detect import NEEDED, SPAN

TOKEN = r"\[\s*[A-Za-z]+[ _-]*[0-9]+\s*\]"
_MASKED = "struct<masked:string,vault:map<string,string>,status:string>"
_MAP = pa.map_(pa.string(), pa.string())


def number(sightings: DataFrame, request: str, order: list[str]) -> DataFrame:
    """request, text, kind, n, placeholder. sightings: request, kind, text and the order columns."""
    first = sightings.groupBy(request, "text").agg(F.min_by("kind", F.struct(*order)).alias("kind"), F.min(F.struct(*order)).alias("first_seen"))
    n = F.row_number().over(W.partitionBy(request, "kind").orderBy("first_seen"))
    return first.withColumn("n", n).select(request, "text", "kind", "n", F.concat(F.lit("["), "kind", F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("placeholder"))


def masked(text: Column, names: list[str] | None = None, locales: list[str] | None = None, units: float = S.UNITS, passes: int = S.PASSES, found: Column | None = None) -> Column:
    """Struct of the masked text, the vault (placeholder to original) and the status of a request with one text: `ok`, or
    why it is blocked; then there is no masked text and no vault. found: raw spans of the text that are known already, as
    detect.spans gives them; the first pass takes those and scans only where they are null."""

    @F.arrow_udf(_MASKED)
    def run(a: pa.Array, known: pa.Array) -> pa.Array:
        extra = S.domestic(locales) if locales is not None else []
        out, vaults, status = [], [], []
        for t, spans in zip(a.to_pylist(), known.to_pylist()):
            vault, budget = S.Vault([t] if t else []), S.Budget(units)

            def find(k, x, spans=spans, budget=budget):
                if k or spans is None:
                    return S.union(S.scan(x, names, locales, budget, extra))
                return S.union([(s["kind"], s["start"], s["end"], s["text"], s["verified"]) for s in spans])

            try:
                out.append(S.mask_by(find, t, vault, passes) if t else t)
                vaults.append(list(vault.original.items()))
                status.append("ok")
            except S.Blocked as e:
                out.append(None)
                vaults.append([])
                status.append(f"blocked: {e}")
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(vaults, _MAP), pa.array(status, pa.string())], ["masked", "vault", "status"])

    return run.asNondeterministic()(text, F.lit(None).cast(f"array<{SPAN}>") if found is None else found)


def mask(df: DataFrame, text: str = "text", names: list[str] | None = None, locales: list[str] | None = None, **limits) -> DataFrame:
    """Adds `masked`, `vault` and `status`; one row is one request. No shuffle; all other columns stay."""
    result = "result_of_masking"
    while result in df.columns:
        result += "_"
    # a text that no recogniser can read stays in the JVM: it passes as it is
    need = F.col(text).rlike(NEEDED)
    d = df.withColumn(result, masked(F.when(need, F.col(text)), names, locales, **limits))
    kept = [c for c in df.columns if c not in ("masked", "vault", "status")]
    return d.select(*kept, F.when(need, F.col(f"{result}.masked")).otherwise(F.col(text)).alias("masked"), F.col(f"{result}.vault").alias("vault"), F.col(f"{result}.status").alias("status"))


def canonical(token: Column) -> Column:
    return F.concat(F.lit("["), F.upper(F.regexp_extract(token, "([A-Za-z]+)", 1)), F.lit("_"), F.regexp_extract(token, "([0-9]+)", 1), F.lit("]"))


def is_token(text: Column) -> Column:
    """Whether a text is a placeholder and nothing else, of a known kind."""
    kind = F.upper(F.regexp_extract(text, r"^\s*\[\s*([A-Za-z]+)[ _-]*[0-9]+\s*\]\s*\z", 1))
    return F.coalesce(kind.isin(S.KINDS), F.lit(False))


def maskable(spans: Column) -> Column:
    """The spans that are no placeholders themselves."""
    return F.filter(spans, lambda s: ~is_token(s["text"]))


def demask(text: Column, vault: Column, json: bool = False) -> Column:
    """Puts the originals back, in plain or JSON-escaped form. The pieces are joined, never used as a replacement pattern."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def put(gap: Column, token: Column) -> Column:
        own = F.try_element_at(vault, canonical(token))
        if json:
            quoted = F.to_json(F.array(own))
            own = F.when(own.isNotNull(), F.substring(quoted, F.lit(3), F.length(quoted) - 4))
        return F.concat(gap, F.coalesce(own, token, F.lit("")))

    return F.when(F.size(vault) > 0, F.array_join(F.zip_with(F.split(text, TOKEN, -1), tokens, put), "")).otherwise(text)
