"""Detection as one projection: an array of spans per text, without a shuffle.

The scan itself (functions/scan.py) runs in Arrow batches; everything around it is expressions. Positions count code
points, ends exclusive. Boundaries are ASCII word characters, so that a value next to a letter of another script is found.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan as S
from ..functions.scan import DOMESTIC, NAMES, PRIORITY  # noqa: F401

SPAN = "struct<kind:string,start:int,end:int,text:string,verified:boolean>"
_FIELDS = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("verified", pa.bool_())]
#: The e-mail pattern for SQL engines: possessive, and only where a run of its characters starts, so that time is linear.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_LINEAR = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: What every recogniser's text must hold; other texts never leave the JVM.
NEEDED = r"[@\p{Nd}]|sk-|AKIA"


def spans(text: Column, names: list[str] | None = None, locales: list[str] | None = None, units: float = float("inf")) -> Column:
    """Array of raw spans of a text; empty for null. names: recognisers; locales: regions of domestic phones, none by default;
    units: validations that one text may cost, beyond which it has no array (null)."""

    @F.arrow_udf(f"array<{SPAN}>")
    def found(a: pa.Array) -> pa.Array:
        extra = S.domestic(locales) if locales is not None or set(names or ()) & set(DOMESTIC) else []
        offsets, rows, spent = [0], [], []
        for t in a.to_pylist():
            try:
                rows += S.scan(t, names, locales, S.Budget(units), extra) if t else []
                spent.append(False)
            except S.Blocked:
                spent.append(True)
            offsets.append(len(rows))
        cols = list(zip(*rows)) or [()] * 5
        parts = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _FIELDS)], fields=[pa.field(*f) for f in _FIELDS])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts, mask=pa.array(spent) if any(spent) else None)

    # a null goes through the scan for nothing; nondeterministic: never computed twice, whatever reads it
    return found.asNondeterministic()(F.when(text.rlike(NEEDED), text))


def with_spans(df: DataFrame, text: str = "text", out: str = "spans", names: list[str] | None = None, locales: list[str] | None = None) -> DataFrame:
    """Adds the array of all raw spans; all columns stay."""
    return df.withColumn(out, spans(F.col(text), names, locales))


def spans_table(df: DataFrame, key: str, text: str = "text", names: list[str] | None = None, locales: list[str] | None = None) -> DataFrame:
    """key, kind, start, end, text, verified: one row per raw span."""
    found = df.select(F.col(key), spans(F.col(text), names, locales).alias("found"))
    return found.select(F.col(key), F.explode("found").alias("s")).select(F.col(key), "s.*")
