"""Request and reply bodies as columns: their texts, masked bodies with vaults, restored replies.

One row is one body. A body that can't be read safely is blocked: no body, no vault, a status that says why and holds no
text of it. Nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan as S
from ..functions import walks
from . import detectors as D

MAX_BODY = 16 * 1024 * 1024
_TEXTS = "struct<texts:array<struct<path:string,text:string>>,status:string>"
_BODY = "struct<body:string,vault:map<string,string>,units:map<string,double>,status:string,failures:map<string,int>>"
_STR = pa.map_(pa.string(), pa.string())
#: A detector of names as a function: from a text to spans (kind, start, end, text, verified).
Find = Callable[[str], list[tuple]]


def texts(body: Column, schema: str) -> Column:
    """Struct of the texts of a body, in reading order, and the status."""

    @F.arrow_udf(_TEXTS)
    def run(a: pa.Array) -> pa.Array:
        out, status = [], []
        for t in a.to_pylist():
            found: list[dict] = []

            def keep(path, text, found=found):
                check_encodes(text)
                found.append({"path": path, "text": text})
                return text

            try:
                walks.WALKS[schema](walks.load(t or ""), keep)
                status.append("ok")
            except (S.Blocked, RecursionError) as e:
                found.clear()
                status.append(f"blocked: {e if isinstance(e, S.Blocked) else 'nested too deeply'}")
            out.append(found)
        kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(out, kind), pa.array(status, pa.string())], ["texts", "status"])

    return run.asNondeterministic()(body)


def fields(requests: DataFrame, schema: str) -> DataFrame:
    """request_id, field_ord, path, text: one row per text of every body that isn't blocked."""
    found = requests.select("request_id", texts(F.col("body"), schema).alias("t"))
    return found.select("request_id", F.posexplode("t.texts").alias("field_ord", "f")).select("request_id", "field_ord", "f.path", "f.text")


def check_encodes(text: str) -> None:
    try:
        text.encode()
    except UnicodeEncodeError:
        raise S.Blocked("half of a surrogate pair") from None


def masked(
    body: Column, schema: str, locales: list[str] | None = None, units: float = S.UNITS, notice: bool = True,
    detector: Find | None = None, fail_open: bool = False, chain: D.Chain | None = None,
) -> Column:
    """Struct of the masked body, its vault, the validation units used by kind, the status, and how often each detector
    that may fail was passed over. All texts of a body share one vault and one budget. chain: what finds the values; or
    the structured recognisers with `detector`, which is passed over when it fails if fail_open says so."""
    if chain is None:
        chain = D.build(locales, [D.Names(detector)] if detector else [], required=not fail_open)

    @F.arrow_udf(_BODY)
    def run(a: pa.Array) -> pa.Array:
        out, vaults, used, status, failures = [], [], [], [], []
        for t in a.to_pylist():
            before = chain.failures()
            budget, vault, result, why = S.Budget(units), None, None, "ok"
            try:
                if t is None or len(t.encode()) > MAX_BODY:
                    raise S.Blocked("no body" if t is None else "body too long")
                seen: list[str] = []
                whole = walks.load(t)
                walks.WALKS[schema](whole, lambda _, x, seen=seen: seen.append(x) or x)
                vault = S.Vault(seen)
                walks.WALKS[schema](whole, lambda _, x, vault=vault, budget=budget: D.mask(x, vault, budget, chain))
                if notice and vault.original:
                    walks.add_notice(whole, schema)
                result = walks.dump(whole)
            except (S.Blocked, RecursionError) as e:
                vault, result, why = None, None, f"blocked: {e if isinstance(e, S.Blocked) else 'nested too deeply'}"
            out.append(result)
            vaults.append(list(vault.original.items()) if vault else [])
            used.append(list(budget.used.items()))
            status.append(why)
            failures.append([(k, n - before[k]) for k, n in chain.failures().items()])
        cols = [pa.array(out, pa.string()), pa.array(vaults, _STR), pa.array(used, pa.map_(pa.string(), pa.float64())), pa.array(status, pa.string()), pa.array(failures, pa.map_(pa.string(), pa.int32()))]
        return pa.StructArray.from_arrays(cols, ["body", "vault", "units", "status", "failures"])

    return run.asNondeterministic()(body)


def restored(body: Column, vault: Column, schema: str) -> Column:
    """A reply's body with its originals; a body that is no JSON stays as it is."""

    @F.arrow_udf("string")
    def run(bodies: pa.Array, vaults: pa.Array) -> pa.Array:
        out = []
        for t, v in zip(bodies.to_pylist(), vaults.to_pylist()):
            try:
                whole = walks.load(t or "")
                walks.restore_reply(whole, schema, dict(v or ()))
                t = walks.dump(whole)
            except (S.Blocked, RecursionError):
                pass
            out.append(t)
        return pa.array(out, pa.string())

    return run(body, vault)
