"""Personal data in texts, with DataFrame and SQL functions only (no Python on the executors, no shuffle).

Regular expressions propose spans; checksums (Luhn for cards, mod-97 for IBANs) and range rules confirm them; words
near a span raise or lower its score. Base kinds (email, ip, card, phone) are never dropped for their score; the added
kinds (iban, secret, ssn) are kept from a score of 0.5 on. Positions are code points, ends exclusive: the text is split
at the matches, and a running sum over the lengths of gaps and matches gives each start; the words near a match are taken
from the gaps and matches on both sides of it. The expressions start only where a run of their characters starts and never step back into it, and
matches are gathered in pieces, so that time stays linear in the text.

Defined results: a null text counts as empty (no spans); every input row gives one row, repeated rows too; an empty
table gives no rows; further columns are ignored by the query and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table

#: Countries by the length of their IBANs.
IBAN = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS",
    23: "AE|GI|IL|IQ|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "PT", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM", 28: "AL|AZ|CY|DO|GT|HU|LB|PL",
    29: "BR|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC",
}


def _ibans() -> str:
    """One branch per length, in groups of four: a word after an IBAN is never taken for its last group."""
    tail = lambda n: f"(?:[ ]?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f"[ ]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    return "|".join(f"(?:{c})[0-9]{{2}}{tail(n)}" for n, c in IBAN.items())


LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, cheap test that a match needs, condition on the match h, base score)
KINDS = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains($t, '@')", "true", 0.8),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "rlike($t, '[0-9]\\\\.[0-9]')",
        "forall(split(s.h, '[.]', -1), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
        0.6,
    ),
    "card": (
        r"[0-9](?:[ -]?[0-9])++",
        "rlike($t, '[0-9][ -]?[0-9]')",
        "length(regexp_replace(s.h, '[ -]', '')) BETWEEN 16 AND 19 AND luhn_check(regexp_replace(s.h, '[ -]', ''))",
        0.8,
    ),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "contains($t, '+')", "length(regexp_replace(s.h, '[^0-9]', '')) BETWEEN 8 AND 15", 0.6),
    "iban": (
        rf"(?<![A-Za-z0-9])(?:{_ibans()})(?![A-Za-z0-9])",
        "rlike($t, '[A-Z]{2}[0-9]{2}')",
        "aggregate(split(concat(substr(replace(s.h, ' ', ''), 5), substr(replace(s.h, ' ', ''), 1, 4)), ''), 0, "
        "(r, c) -> CASE WHEN c = '' THEN r WHEN c >= 'A' THEN (r * 100 + ascii(c) - 55) % 97 ELSE (r * 10 + ascii(c) - 48) % 97 END) = 1",
        0.8,
    ),
    "secret": (
        r"(?<![A-Za-z0-9_-])(?:sk-[A-Za-z0-9_-]{16,}+|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|[0-9a-f]{40}(?![0-9A-Za-z_-]))",
        "rlike($t, 'sk-|AKIA|[0-9a-f]{40}')",
        "true",
        0.45,
    ),
    "ssn": (
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "rlike($t, '[0-9]{3}-[0-9]{2}-[0-9]{4}')",
        "substr(s.h, 1, 3) NOT IN ('000', '666') AND substr(s.h, 1, 1) <> '9' AND substr(s.h, 5, 2) <> '00' AND substr(s.h, 8) <> '0000'",
        0.5,
    ),
}
BASE = ["email", "ip", "card", "phone"]
#: Words within NEAR code points of a span, per kind: those on either side that speak for it (less after it than before
#: it), and those before it that speak against it.
NEAR = 40
FOR = {
    "email": "mail|contact|write|address",
    "ip": "\\\\bip\\\\b|host|server|address|client",
    "card": "card|visa|credit|payment|mastercard",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "secret": "token|key|secret|password|credential",
    "ssn": "ssn|social|security",
}
AGAINST = "version|release|order no|invoice|isbn|serial"
PIECE = 128
FOUND = "array<struct<start:int,end:int,h:string,b:string,a:string>>"
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _of(kind: str) -> str:
    """SQL for the accepted spans of one kind in the column that takes the place of $t."""
    pattern, test, ok, score = KINDS[kind]
    p = pattern.replace("\\", "\\\\")
    before, after = "lower(s.b)", "lower(s.a)"
    near = lambda x: f"right({x}, {NEAR})"
    # matches in pieces of PIECE: adding to an array copies it, which would be quadratic in one long array
    step = f"""(a, x) -> CASE WHEN x.h IS NULL THEN a ELSE named_struct('at', a.at + x.g + length(x.h), 'b', {near("concat(a.b, x.b, x.h)")},
            'out', concat(a.out, array(named_struct('start', a.at + x.g, 'end', a.at + x.g + length(x.h), 'h', x.h, 'b', {near("concat(a.b, x.b)")}, 'a', x.a)))) END"""
    piece = f"""aggregate(slice(z, i, {PIECE}), named_struct('at', acc.at, 'b', acc.b, 'out', cast(array() AS {FOUND})), {step})"""
    # what follows a match is the next gap and the next match
    pairs = f"""transform(array(zip_with(split($t, '{p}', -1), regexp_extract_all($t, '{p}', 0),
            (g, h) -> named_struct('g', length(g), 'b', {near("g")}, 'f', left(concat(g, coalesce(h, '')), {NEAR}), 'h', h))),
        y -> zip_with(y, slice(y, 2, size(y)), (x, n) -> named_struct('g', x.g, 'b', x.b, 'h', x.h, 'a', n.f)))"""
    found = f"""filter(flatten(transform({pairs},
        z -> flatten(aggregate(sequence(1, size(z), {PIECE}), named_struct('at', 0, 'b', '', 'outs', cast(array() AS array<{FOUND}>)),
            (acc, i) -> transform(array({piece}), r -> named_struct('at', r.at, 'b', r.b, 'outs', concat(acc.outs, array(r.out))))[0],
            acc -> acc.outs)))), s -> {ok})"""
    scored = f"""transform({found}, s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.end, 'score',
        cast(round({score} + CASE WHEN {before} RLIKE '{FOR[kind]}' THEN 0.15 WHEN {after} RLIKE '{FOR[kind]}' THEN 0.1 ELSE 0 END - CASE WHEN {before} RLIKE '{AGAINST}' THEN 0.3 ELSE 0 END, 2) AS double)))"""
    kept = scored if kind in BASE else f"filter({scored}, s -> s.score >= 0.5)"
    return f"CASE WHEN {test} THEN {kept} ELSE cast(array() AS {SPANS}) END"


def with_spans(docs: DataFrame, text: str = "text", out: str = "__spans") -> DataFrame:
    """docs and an array of spans. The array is computed once, in a projection of its own."""
    own = free(docs, "__t")
    parts = ", ".join(_of(k).replace("$t", own) for k in KINDS)
    held = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    return held.withColumn(out, F.expr(f"concat({parts})")).drop(own)


def _joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans, and the highest score."""
    d = with_spans(docs.select("doc_id", "text")).select("doc_id", "__spans")
    base = F.filter("__spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    return d.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("__spans")).alias("spans"),
        F.array_max(F.transform("__spans", lambda s: s["score"])).alias("max_score"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of `text` replaced by its kind in brackets; of overlapping spans the first names the gap."""
    spans = free(docs, "__spans")
    d = with_spans(docs, text, spans)
    t = f"`{text}`"
    # spans in pieces, each with its own stretch of the text: a place far into a text is found by counting from its start
    inner = """aggregate(p.own, named_struct('at', acc.at, 'out', cast(array() AS array<string>)),
        (a, s) -> CASE WHEN s.start >= a.at THEN named_struct('at', s.end, 'out', concat(a.out, array(substring(p.t, a.at - acc.at + 1, s.start - a.at), concat('[', upper(s.kind), ']'))))
                       ELSE named_struct('at', greatest(a.at, s.end), 'out', a.out) END)"""
    own = f"slice(z, i, {PIECE})"
    stretch = f"substring({t}, acc.at + 1, greatest(0, array_max(transform({own}, s -> s.end)) - acc.at))"
    parts = f"""transform(array(array_sort({spans}, (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 WHEN a.end > b.end THEN -1 WHEN a.end < b.end THEN 1 ELSE 0 END)),
        z -> aggregate(sequence(1, size(z), {PIECE}), named_struct('at', 0, 'parts', cast(array() AS array<string>)),
            (acc, i) -> transform(transform(array(named_struct('own', {own}, 't', {stretch})), p -> {inner}), r -> named_struct('at', r.at, 'parts', concat(acc.parts, array(array_join(r.out, '')))))[0],
            acc -> concat(array_join(acc.parts, ''), substring({t}, acc.at + 1))))[0]"""
    return d.withColumn(text, F.when(F.size(spans) > 0, F.expr(parts)).otherwise(F.col(text))).drop(spans)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
