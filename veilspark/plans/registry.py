"""

Dense test values are derived from the customer table by the same SQL on both sides.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import validators as V
from ..operators import bodies, detect, spans, vault
from ..sources import requests
from ..streaming import events

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


EMAIL = detect.EMAIL

for _by in ("lang", "source"):

    @_query(f"emails_by_{_by}", f"SELECT {_by}, count(*) AS n_emails FROM (SELECT {_by}, unnest(regexp_extract_all(text, '{EMAIL}')) AS e FROM documents) GROUP BY {_by}")
    def _emails(spark, sf_dir, by=_by):
        d = _table(spark, sf_dir, "documents").select(by, F.explode(F.regexp_extract_all("text", F.lit(detect.EMAIL_LINEAR), F.lit(0))).alias("e"))
        return d.groupBy(by).agg(F.count(F.lit(1)).alias("n_emails"))


#: name -> (SQL of a value made from c_custkey, validator)
_N9 = "lpad(cast((c_custkey * 7919 + 123456) % 1000000000 AS varchar(20)), 9, '0')"
_N11 = "lpad(cast((c_custkey * 104729 + 12345678) % 100000000000 AS varchar(20)), 11, '0')"
_N15 = "concat('1', '85', '05', lpad(cast((c_custkey * 15485863) % 10000000000 AS varchar(20)), 10, '0'))"
_N17 = "concat('11010519', lpad(cast((c_custkey * 32452843) % 10000000000 AS varchar(20)), 10, '0'))"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast({} % 26 + 1 AS int), 1)"
_DNI = f"concat(lpad(cast((c_custkey * 7919) % 100000000 AS varchar(20)), 8, '0'), {_LETTER.format('c_custkey')})"
_CF = f"concat('RSSMR', {_LETTER.format('c_custkey')}, '80A01H5', lpad(cast(c_custkey % 100 AS varchar(9)), 2, '0'), {_LETTER.format('(c_custkey * 7)')})"
_NINO = f"concat({_LETTER.format('c_custkey')}, {_LETTER.format('(c_custkey * 3)')}, '123456C')"
_VALUES = {
    "nine_digit_id": (_N9, V.nine_digit_id),
    "lv_code": (_N11, V.lv_code),
    "vat_it": (_N11, V.piva),
    "vat_gb": (_N9, V.gb_vat),
    "vat_pt": (_N9, V.nif),
    "vat_nl_verified": (_N9, V.bsn),
    "fr_nir": (_N15, V.fr_nir),
    "cn_id": (_N17, V.cn_id),
    "es_dni": (_DNI, V.es_dni),
    "it_cf": (_CF, V.it_cf),
    "gb_nino": (_NINO, V.nino_prefix),
}
#: The same rules for another engine, written on lists of digits instead of sums of substrings.
_D = "list_transform(string_split({0}, ''), lambda c: cast(c AS bigint))"


def _dot(h: str, weights: list[int]) -> str:
    return f"list_sum(list_transform(list_zip({_D.format(h)}, {weights}), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))"


def _luhn_sql(h: str) -> str:
    return f"list_sum(list_transform(list_zip(list_reverse({_D.format(h)}), range(0, 20)), lambda z: CASE WHEN z[1] IS NULL THEN 0 WHEN z[2] % 2 = 0 THEN z[1] ELSE (2 * z[1]) // 10 + (2 * z[1]) % 10 END)) % 10 = 0"


_WEIGHTS = list(range(9, 1, -1))
_BSN_SQL = f"({_dot('h', _WEIGHTS + [-1])} <> 0 AND {_dot('h', _WEIGHTS + [-1])} % 11 = 0)"
_NIF_SQL = f"(({_dot('h', _WEIGHTS + [0])} + (CASE WHEN {_dot('h', _WEIGHTS + [0])} % 11 IN (0, 1) THEN -({_dot('h', _WEIGHTS + [0])} % 11) ELSE 0 END) + cast(right(h, 1) AS int)) % 11 = 0 AND (cast(right(h, 1) AS int) = 0 OR {_dot('h', _WEIGHTS + [0])} % 11 > 1))"
_LV_SQL = f"(starts_with(h, '32') OR list_position(['0','1','2','3','4','5','6','7','8','9','0'], right(h, 1)) - 1 = (1 + 110000 - {_dot('h', [1, 6, 3, 7, 9, 10, 5, 8, 4, 2, 0])}) % 11 OR (right(h, 1) = '0' AND (1 + 110000 - {_dot('h', [1, 6, 3, 7, 9, 10, 5, 8, 4, 2, 0])}) % 11 = 10))"
_MOD_11_10 = "list_reduce(list_prepend(10, list_slice({d}, 1, {n} - 1)), lambda p, d: (CASE WHEN (p + d) % 10 = 0 THEN 10 ELSE (p + d) % 10 END) * 2 % 11)"
_RULES = {
    "nine_digit_id": f"({_BSN_SQL} OR {_NIF_SQL})",
    "lv_code": _LV_SQL,
    "vat_it": _luhn_sql("h"),
    "vat_gb": f"list_contains([0, 42], ({_dot('h', list(range(8, 1, -1)) + [10, 1])}) % 97)",
    "vat_pt": _NIF_SQL,
    "vat_nl_verified": _BSN_SQL,
    "fr_nir": "(cast(left(h, 13) AS hugeint) + cast(right(h, 2) AS hugeint)) % 97 = 0 AND cast(right(h, 2) AS int) BETWEEN 1 AND 97",
    "cn_id": f"list_extract(string_split('1,0,X,9,8,7,6,5,4,3,2', ','), cast({_dot('left(h, 17)', [2**k % 11 for k in range(17, 0, -1)])} % 11 + 1 AS int)) = upper(right(h, 1))",
    "es_dni": "list_extract(string_split('T,R,W,A,G,M,Y,F,P,D,X,B,N,J,Z,S,Q,V,H,L,C,K,E', ','), cast(cast(left(h, 8) AS bigint) - 23 * (cast(left(h, 8) AS bigint) // 23) + 1 AS int)) = right(h, 1)",
    "it_cf": """list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN (CASE WHEN h[i] BETWEEN '0' AND '9' THEN ascii(h[i]) - 48 ELSE ascii(h[i]) - 65 END)
        ELSE list_extract([1,0,5,7,9,13,15,17,19,21,2,4,18,20,11,3,6,8,12,14,16,10,22,25,24,23], CASE WHEN h[i] BETWEEN '0' AND '9' THEN ascii(h[i]) - 47 ELSE ascii(h[i]) - 64 END) END)) % 26 = ascii(h[16]) - 65""",
    "gb_nino": "regexp_full_match(h, '[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]') AND left(h, 2) NOT IN ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ')",
}
for _name, (_value, _rule) in _VALUES.items():

    @_query(f"{_name}_valid", f"SELECT c_custkey, h AS value FROM (SELECT c_custkey, {_value} AS h FROM customer) WHERE {_RULES[_name]}")
    def _valid(spark, sf_dir, value=_value, rule=_rule):
        d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(value).alias("h"))
        return d.filter(F.expr(rule("h"))).select("c_custkey", F.col("h").alias("value"))


#: recogniser -> (its value in a text, when it is found): found and rejected values, in upper and lower case, among others.
_N8 = "lpad(cast((c_custkey * 7919 + 1234567) % 100000000 AS varchar(20)), 8, '0')"
_STEUER = f"regexp_full_match(h, '[1-9][0-9]{{10}}') AND len(list_filter(list_transform(range(0, 10), lambda v: length(left(h, 10)) - length(replace(left(h, 10), cast(v AS varchar), ''))), lambda n: n > 1)) = 1 AND list_max(list_transform(range(0, 10), lambda v: length(left(h, 10)) - length(replace(left(h, 10), cast(v AS varchar), '')))) <= 3 AND NOT list_bool_or(list_transform(range(0, 10), lambda v: contains(left(h, 10), repeat(cast(v AS varchar), 3)))) AND (11 - {_MOD_11_10.format(d=_D.format('h'), n=11)}) % 10 = cast(right(h, 1) AS int)"
_MANY = "concat('1', substr('023456789', cast(c_custkey % 9 + 1 AS int), 1), '2345678', substr('0123456789', cast(c_custkey % 10 + 1 AS int), 1), cast(c_custkey // 90 % 10 AS varchar(2)))"
_FOUND = {
    "it_cf": (_CF, "h", _RULES["it_cf"]),
    "gb_nino": (_NINO, "h", _RULES["gb_nino"]),
    "es_dni": (_DNI, "h", _RULES["es_dni"]),
    "fr_nir": (_N15, "h", _RULES["fr_nir"]),
    "nine_digit": (_N9, "h", _RULES["nine_digit_id"]),
    "eleven_digit": (_N11, "h", f"({_LV_SQL} OR {_STEUER})"),
    "lv_dashed": (_N11, "concat(left(h, 6), '-', right(h, 5))", _LV_SQL),
    "cn_id": (f"concat(left({_N17}, 17), substr('0123456789X', cast(c_custkey % 11 + 1 AS int), 1))", "h", _RULES["cn_id"]),
    "vat_it_bare": (_N11, "h", _luhn_sql("h")),
    "vat_de": (_N9, "concat('De', h)", f"(11 - {_MOD_11_10.format(d=_D.format('h'), n=9)}) % 10 = cast(right(h, 1) AS int)"),
    "vat_nl": (_N9, "concat('nl', h, 'B07')", "true"),
}
for _name, (_value, _shown, _sql) in _FOUND.items():

    @_query(f"{_name}_found", f"SELECT c_custkey, {_shown} AS value FROM (SELECT c_custkey, {_value} AS h FROM customer) WHERE {_sql}")
    def _found(spark, sf_dir, name=_name, value=_value, shown=_shown):
        """In a sentence, once as it is and once inside a longer word, where it must not be found."""
        d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(value).alias("h"))
        d = d.select("c_custkey", F.concat(F.lit("No. "), F.expr(shown), F.lit(", not x"), F.expr(shown), F.lit("y")).alias("text"))
        return detect.spans_table(d, "c_custkey", "text", [name]).select("c_custkey", F.col("text").alias("value"))


#: region -> (the number as written, its digits' pattern in full, the form)
_LAST = "lpad(cast((c_custkey * 7919 + 31) % {0} AS varchar(20)), {1}, '0')"
_PHONES = {
    "fr": (f"concat('0', cast(c_custkey % 10 AS varchar(2)), ' ', {_LAST.format(100, 2)}, ' 45.67 ', {_LAST.format(90, 2)})", "0[1-9][0-9]{8}", "phone_trunk_pairs"),
    "es": (f"concat(cast(c_custkey % 9 + 1 AS varchar(2)), {_LAST.format(100, 2)}, ' ', {_LAST.format(1000, 3)}, '-', {_LAST.format(999, 3)})", "[67][0-9]{8}|[89][1-8][0-9]{7}", "phone_groups"),
    "nl": (f"concat('0', cast(c_custkey % 10 AS varchar(2)), '0', {_LAST.format(10000000, 7)})", "0([1-57][0-9]{8}|6[1-58][0-9]{7}|8[58][0-9]{7})", "phone_trunk"),
    "lv": (f"concat(cast(c_custkey % 9 + 1 AS varchar(2)), {_LAST.format(10, 1)}, ' ', {_LAST.format(1000, 3)}, ' ', {_LAST.format(999, 3)})", "[268][0-9]{7}", "phone_groups"),
    "it": (f"concat('3', {_LAST.format(100, 2)}, ' ', {_LAST.format(10000000, 7)})", "3[0-9]{8,9}", "phone_long_block"),
}
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


@_query(
    "domestic_phone",
    " UNION ALL ".join(f"SELECT '{r}' AS region, c_custkey, h AS value FROM (SELECT c_custkey, {w} AS h FROM customer) WHERE regexp_full_match({_DIGITS.format('h')}, '{p}')" for r, (w, p, _) in _PHONES.items()),
)
def _domestic(spark, sf_dir):
    """Domestic numbers as each region writes them; all but those of its plan are rejected."""
    out = []
    for region, (written, _, form) in _PHONES.items():
        d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"concat('call ', {written}, ' now')").alias("text"))
        found = detect.spans_table(d, "c_custkey", "text", [form], [region])
        out.append(found.select(F.lit(region).alias("region"), "c_custkey", F.col("text").alias("value")))
    return functools.reduce(DataFrame.unionByName, out)


_COMPACT = {"de": "0(1(5[0-9]{9}|6[0-3][0-9]{7,8}|7[0-9]{8,9})|[2-9][0-9]{5,10})", "fr": "0[1-9][0-9]{8}", "it": "0[0-9]{5,10}", "lv": "[268][0-9]{7}", "nl": _PHONES["nl"][1]}


@_query(
    "fp_by_region",
    " UNION ALL ".join(
        f"SELECT category, '{r}' AS region, cast(avg(CASE WHEN regexp_full_match(h, '{p}') AND h LIKE '0%' THEN 1 ELSE 0 END) AS double) AS rate FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ref' ELSE 'code' END AS category, "
        f"concat(cast(o_orderkey % 3 AS varchar(2)), lpad(cast(o_orderkey AS varchar(20)), 9, '7')) AS h FROM orders) GROUP BY category"
        for r, p in _COMPACT.items()
    ),
)
def _fp(spark, sf_dir):
    """Share of texts, by what they hold and by region, in which a number is taken for a domestic phone."""
    d = _table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'ref' ELSE 'code' END").alias("category"), F.expr("concat('no ', cast(o_orderkey % 3 AS varchar(2)), lpad(cast(o_orderkey AS varchar(20)), 9, '7'), '.')").alias("text"))
    each = d.select("category", *[(F.size(detect.spans(F.col("text"), detect.DOMESTIC, [r])) > 0).cast("int").alias(r) for r in _COMPACT])
    return each.groupBy("category").agg(*[F.avg(r).alias(r) for r in _COMPACT]).unpivot("category", list(_COMPACT), "region", "rate")


_FOLD = "list_reduce(list_prepend(10, list_transform(range(1, {n}), lambda i: cast(substr(h, cast(i AS int), 1) AS int))), lambda p, d: (CASE WHEN (p + d) % 10 = 0 THEN 10 ELSE (p + d) % 10 END) * 2 % 11)"


@_query("vat_de_valid", f"SELECT c_custkey, h AS value FROM (SELECT c_custkey, {_N9} AS h FROM customer) WHERE (11 - {_FOLD.format(n=9)}) % 10 = cast(substr(h, 9, 1) AS int)")
def _vat_de(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_N9).alias("h"))
    return d.filter(F.expr(V.de_vat("h"))).select("c_custkey", F.col("h").alias("value"))


_CARD = "concat('4', lpad(cast((c_custkey * 982451653) % 1000000000000000 AS varchar(20)), 15, '0'))"
_LUHN = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (cast(substr(h, cast(i AS int), 1) AS int) * 2) // 10 + (cast(substr(h, cast(i AS int), 1) AS int) * 2) % 10 ELSE cast(substr(h, cast(i AS int), 1) AS int) END)) % 10 = 0"


@_query("card_compact_luhn", f"SELECT c_custkey, h AS card FROM (SELECT c_custkey, {_CARD} AS h FROM customer) WHERE {_LUHN}")
def _card(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"concat('card ', {_CARD}, ' paid')").alias("text"))
    return detect.spans_table(d, "c_custkey", "text", ["card"]).select("c_custkey", F.col("text").alias("card"))


_IBAN = "concat('DE', lpad(cast(c_custkey % 100 AS varchar(9)), 2, '0'), lpad(cast((c_custkey * 982451653) % 1000000000000000 AS varchar(20)), 18, '0'))"
_MOD = "list_reduce(list_prepend(0, list_transform(string_split(concat(substr(h, 5), '1314', substr(h, 3, 2)), ''), lambda c: cast(c AS int))), lambda r, d: (r * 10 + d) % 97) = 1"


@_query("iban_compact_mod97", f"SELECT c_custkey, h AS iban, {_MOD} AS verified FROM (SELECT c_custkey, {_IBAN} AS h FROM customer)")
def _iban(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"concat('pay to ', {_IBAN}, '.')").alias("text"))
    return detect.spans_table(d, "c_custkey", "text", ["iban"]).select("c_custkey", F.col("text").alias("iban"), "verified")


def _extract(name: str, made: str, recogniser: str) -> None:
    @_query(name, f"SELECT c_custkey, {made} AS value FROM customer")
    def _f(spark, sf_dir):
        d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"concat('see ', {made}, ' and more')").alias("text"))
        return detect.spans_table(d, "c_custkey", "text", [recogniser]).select("c_custkey", F.col("text").alias("value"))


_extract("secrets_extract", "concat('sk-key_', lpad(cast(c_custkey AS varchar(9)), 8, '0'))", "secret")
_extract("ssn_extract", "concat(lpad(cast(c_custkey % 1000 AS varchar(9)), 3, '0'), '-12-', lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0'))", "ssn")
_extract("us_phone_shape", "concat('(555) ', lpad(cast(c_custkey % 1000 AS varchar(9)), 3, '0'), '-', lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0'))", "phone_us")

#: Spans made from lineitem rows: key l_orderkey, start and end from part and line numbers.
_SPANS = "SELECT l_orderkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN 'CARD' WHEN l_linenumber % 3 = 1 THEN 'PHONE' ELSE 'TAXID' END AS kind, cast(l_partkey % 50 AS int) AS s, cast(l_partkey % 50 + 3 + l_suppkey % 9 AS int) AS e FROM lineitem"


def _span_rows(spark, sf_dir) -> DataFrame:
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_SPANS).select("k", "kind", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(True).alias("verified"))


@_query(
    "spans_resolve",
    f"""WITH x AS ({_SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x),
    g AS (SELECT *, sum(CASE WHEN b IS NULL OR s >= b THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m)
    SELECT k, min(s) AS "start", max(e) AS "end", arg_max(kind, (CASE kind WHEN 'CARD' THEN 5 WHEN 'PHONE' THEN 3 ELSE 2 END) * 1000000 + (e - s) * 1000 - s) AS kind FROM g GROUP BY k, grp""",
)
def _resolve(spark, sf_dir):
    return spans.resolve(_span_rows(spark, sf_dir), "k").select("k", "start", "end", "kind")


@_query(
    "ner_interval_anti",
    f"""WITH x AS ({_SPANS}) SELECT k, s AS "start", e AS "end" FROM x a WHERE kind = 'TAXID' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.kind <> 'TAXID' AND a.k = b.k AND a.s < b.e AND b.s < a.e)""",
)
def _anti(spark, sf_dir):
    x = _span_rows(spark, sf_dir)
    return spans.drop_overlapping(x.filter("kind = 'TAXID'"), x.filter("kind <> 'TAXID'"), "k").select("k", "start", "end")


_SEEN = "SELECT o_custkey AS r, o_orderkey AS ord, o_orderpriority AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'EMAIL' ELSE 'PHONE' END AS kind FROM orders"


@_query(
    "placeholder_numbering",
    f"""WITH x AS ({_SEEN}), f AS (SELECT r, t, min(ord) AS first_at, arg_min(kind, ord) AS kind FROM x GROUP BY r, t)
    SELECT r, t AS text, concat('[', kind, '_', row_number() OVER (PARTITION BY r, kind ORDER BY first_at), ']') AS placeholder FROM f""",
)
def _numbering(spark, sf_dir):
    _table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    seen = spark.sql(_SEEN).withColumnRenamed("t", "text")
    return vault.number(seen, "r", ["ord"]).select("r", "text", "placeholder")


@_query("kind_histogram")
def _histogram(spark, sf_dir):
    return spans.histogram(detect.spans_table(_table(spark, sf_dir, "documents"), "doc_id"))


@_query("histogram_exact", f"SELECT 'EMAIL' AS kind, coalesce(sum(len(regexp_extract_all(text, '{EMAIL}'))), 0)::bigint AS n FROM documents UNION ALL SELECT 'SECRET', coalesce(sum(len(regexp_extract_all(text, '\\b(sk-[A-Za-z0-9_-]{{5,}}[A-Za-z0-9_]\\b|AKIA[0-9A-Z]{{16}}\\b)'))), 0)::bigint FROM documents UNION ALL SELECT 'SSN', coalesce(sum(len(regexp_extract_all(text, '\\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\\b'))), 0)::bigint FROM documents")
def _histogram_exact(spark, sf_dir):
    """Counts of the kinds that no checksum decides, with 0 for those that do not occur."""
    kinds = ["EMAIL", "SECRET", "SSN"]
    found = detect.spans(F.col("text"), ["email", "secret", "ssn"])
    each = _table(spark, sf_dir, "documents").select(found.alias("s")).select(*[F.expr(f"size(filter(s, x -> x.kind = '{k}'))").alias(k) for k in kinds])
    return each.agg(*[F.coalesce(F.sum(F.greatest(F.col(k), F.lit(0))), F.lit(0)).alias(k) for k in kinds]).unpivot([], kinds, "kind", "n")


@_query("mask_documents_full")
def mask_documents_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vault.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "masked", F.size("vault").alias("n_values"))


@_query("mask_emails", f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS masked, len(list_distinct(regexp_extract_all(text, '{EMAIL}'))) AS n_values FROM documents WHERE text IS NOT NULL")
def _mask_emails(spark, sf_dir):
    """E-mails only, their numbers taken off, so that another engine can say the result."""
    d = vault.mask(_table(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL"), names=["email"])
    return d.select("doc_id", F.regexp_replace("masked", r"\[EMAIL_[0-9]+\]", "[EMAIL]").alias("masked"), F.size("vault").cast("long").alias("n_values"))


@_query("demask_roundtrip", "SELECT doc_id, text FROM documents")
def _roundtrip(spark, sf_dir):
    d = vault.mask(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", vault.demask(F.col("masked"), F.col("vault")).alias("text"))


@_query("demask_tolerant", "SELECT c_custkey, concat('a ', c_name, ' b ', c_name, ' [TODO 3]') AS text FROM customer")
def _tolerant(spark, sf_dir):
    d = _table(spark, sf_dir, "customer")
    return d.select("c_custkey", vault.demask(F.lit("a [EMAIL_1] b [ email 1] [TODO 3]"), F.create_map(F.lit("[EMAIL_1]"), F.col("c_name"))).alias("text"))


@_query(
    "header_allowlist",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'retry-after' WHEN o_orderkey % 3 = 1 THEN 'X-RateLimit-Left' END AS kept FROM orders",
)
def _headers(spark, sf_dir):
    d = _table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, "retry-after").when(F.col("o_orderkey") % 3 == 1, "X-RateLimit-Left").otherwise("set-cookie")
    kept = F.map_keys(requests.forwardable(F.create_map(name, F.lit("1"))))
    return d.select("o_orderkey", F.get(kept, F.lit(0)).alias("kept"))


_BODY = "SELECT conv_id AS request_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id"


def _bodies(spark, sf_dir) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return m.select(F.col("conv_id").alias("request_id"), F.to_json(F.struct(messages.alias("messages"))).alias("body"))


_FIELDS = "SELECT conv_id AS request_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS int) AS field_ord, text FROM conversations WHERE text IS NOT NULL"
for _kind in ("openai", "anthropic"):

    @_query(f"{_kind}_fields", _FIELDS)
    def _fields(spark, sf_dir, kind=_kind):
        return getattr(requests, f"{kind}_fields")(_bodies(spark, sf_dir)).select("request_id", "field_ord", "text")


for _kind in ("openai", "anthropic"):

    @_query(f"mask_{_kind}_bodies", _FIELDS)
    def _mask_bodies(spark, sf_dir, kind=_kind):
        """Bodies are masked, sent back as a reply and restored: the texts are those of the conversations."""
        d = _bodies(spark, sf_dir).select("request_id", bodies.masked(F.col("body"), kind, notice=False).alias("m"))
        back = vault.demask(F.col("m.body"), F.col("m.vault"), json=True)
        return bodies.fields(d.select("request_id", back.alias("body")), kind).select("request_id", "field_ord", "text")

    @_query(f"blocked_{_kind}_bodies", "SELECT conv_id AS request_id, CASE WHEN conv_id % 3 = 0 THEN 'blocked: content: unknown " + ("element" if _kind == "openai" else "block") + "' WHEN conv_id % 3 = 1 THEN 'blocked: no JSON' ELSE 'ok' END AS status, conv_id % 3 = 2 AS has_body FROM (SELECT DISTINCT conv_id FROM conversations)")
    def _blocked(spark, sf_dir, kind=_kind):
        """An unknown element or a broken body goes out not even in part."""
        odd = '[{"type":"video","text":"a@b.org"}]' if kind == "anthropic" else "[17]"
        b = F.when(F.col("request_id") % 3 == 0, F.regexp_replace("body", r'"messages":\[', '"messages":[{"role":"user","content":' + odd + "},")).when(F.col("request_id") % 3 == 1, F.concat("body", F.lit("}"))).otherwise(F.col("body"))
        d = _bodies(spark, sf_dir).select("request_id", bodies.masked(b, kind).alias("m"))
        return d.select("request_id", "m.status", F.col("m.body").isNotNull().alias("has_body"))

    @_query(f"demask_{_kind}_responses", "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL")
    def _responses(spark, sf_dir, kind=_kind):
        """Each turn is masked, wrapped into a reply of the shape, and restored there."""
        d = vault.mask(_table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text"))
        block = F.array(F.struct(F.lit("text").alias("type"), F.col("masked").alias("text")))
        choice = F.array(F.struct(F.struct(F.col("masked").alias("content")).alias("message")))
        reply = F.to_json(F.struct(block.alias("content")) if kind == "anthropic" else F.struct(choice.alias("choices")))
        path = "$.content[0].text" if kind == "anthropic" else "$.choices[0].message.content"
        return d.select("conv_id", "turn", F.get_json_object(bodies.restored(reply, F.col("vault"), kind), path).alias("text"))

    @_query(f"stream_{_kind}_events", "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL")
    def _stream(spark, sf_dir, kind=_kind):
        """Each masked turn arrives as an event stream, its bytes cut at two places that don't care for tokens; the texts of
        the restored events are those of the conversations."""
        d = vault.mask(_table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text"))
        half = (F.length("masked") / 2).cast("int")
        pieces = F.array(F.substring("masked", F.lit(1), half), F.substring("masked", half + 1, F.length("masked")))
        if kind == "anthropic":
            event = lambda t: F.concat(F.lit("event: content_block_delta\ndata: "), F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), t.alias("text")).alias("delta"))), F.lit("\n\n"))
            end = 'event: content_block_stop\ndata: {"type":"content_block_stop","index":0}\n\n'
        else:
            event = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(t.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
            end = "data: [DONE]\n\n"
        whole = d.select(F.concat_ws(":", "conv_id", "turn").alias("stream_id"), F.concat(F.array_join(F.transform(pieces, event), ""), F.lit(end)).cast("binary").alias("b"), F.to_json("vault").alias("vault"))
        n = F.octet_length("b")
        cuts = F.array(*[F.struct(F.lit(k).alias("seq"), F.substring(F.col("b"), (n * k / 3).cast("int") + 1, (n * (k + 1) / 3).cast("int") - (n * k / 3).cast("int")).alias("bytes")) for k in range(3)])
        chunks = whole.select("stream_id", "vault", F.explode(cuts).alias("c")).select("stream_id", "c.seq", "c.bytes", F.lit(kind).alias("schema"), F.when(F.col("c.seq") == 0, F.col("vault")).alias("vault"), (F.col("c.seq") == 2).alias("is_end"), F.lit(False).alias("failed"))
        got = events.restore_recorded(chunks).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("all"))
        lines = F.split(F.array_join(F.transform("all", lambda x: x["bytes"].cast("string")), ""), "\n")
        path = "$.delta.text" if kind == "anthropic" else "$.choices[0].delta.content"
        data = F.filter(lines, lambda x: x.startswith("data: {"))
        text = F.array_join(F.transform(data, lambda x: F.coalesce(F.get_json_object(F.substring(x, F.lit(7), F.length(x)), path), F.lit(""))), "")
        id_ = F.split("stream_id", ":")
        return got.select(id_[0].cast("long").alias("conv_id"), id_[1].cast("long").alias("turn"), text.alias("text"))


_TOKENS = "SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, CASE WHEN l_partkey % 4 = 0 THEN 'O' WHEN l_partkey % 4 = 1 THEN 'B-PER' WHEN l_partkey % 4 = 2 THEN 'I-PER' ELSE 'I-ORG' END AS label, l_linenumber * 10 AS s, l_linenumber * 10 + 8 AS e FROM lineitem"


@_query(
    "bio_decode",
    f"""WITH t AS (SELECT *, CASE WHEN label = 'O' THEN NULL WHEN label LIKE '%PER' THEN 'PERSON' ELSE 'ORG' END AS kind FROM ({_TOKENS})),
    m AS (SELECT *, sum(CASE WHEN kind IS NOT DISTINCT FROM p AND label NOT LIKE 'B-%' THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY ord) AS g FROM (SELECT *, lag(kind) OVER (PARTITION BY k ORDER BY ord) AS p FROM t))
    SELECT k, kind, min(s) AS "start", max(e) AS "end" FROM m WHERE kind IS NOT NULL GROUP BY k, g, kind""",
)
def _bio(spark, sf_dir):
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    t = spark.sql(_TOKENS).select("k", "ord", "label", F.col("s").alias("start"), F.col("e").alias("end"))
    return labels.bio_decode(t, "k")


@_query("split_demaskable", "SELECT c_custkey, cast(CASE WHEN c_custkey % 2 = 0 THEN 6 ELSE 13 END AS int) AS safe FROM customer")
def _safe(spark, sf_dir):
    d = _table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 2 == 0, F.lit("hello [EMAI")).otherwise(F.lit("done [EMAIL_1"[:12] + "]"))
    return d.select("c_custkey", labels.safe_prefix(text).cast("int").alias("safe"))


@_query("dedup_detect_join", f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS n_emails FROM documents")
def _dedup(spark, sf_dir):
    """Detects each distinct text once; the hash only routes rows, the join is on the text itself."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    once = d.select("h", "text").distinct().withColumn("n_emails", F.size(F.regexp_extract_all("text", F.lit(detect.EMAIL_LINEAR), F.lit(0))).cast("long"))
    once = once.select(F.col("h").alias("k"), F.col("text").alias("t"), "n_emails")
    return d.join(once, F.col("h").eqNullSafe(F.col("k")) & F.col("text").eqNullSafe(F.col("t"))).select("doc_id", "n_emails")


@_query("precision_by_category")
def _precision(spark, sf_dir):
    """Share of documents, by language, in which a phone number is seen."""
    d = detect.with_spans(_table(spark, sf_dir, "documents").select("lang", "text"), names=["phone_cc", "phone_us"])
    return d.groupBy("lang").agg(F.avg((F.size("spans") > 0).cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))


_IBAN_GROUPS = "concat_ws(' ', substr({0}, 1, 4), substr({0}, 5, 4), substr({0}, 9, 4), substr({0}, 13, 4), substr({0}, 17, 4), substr({0}, 21, 2))".format("h")
_CARD_GROUPS = "concat_ws('-', substr(h, 1, 4), substr(h, 5, 4), substr(h, 9, 4), substr(h, 13, 4))"


@_query("iban_grouped", f"SELECT c_custkey, {_IBAN_GROUPS} AS value FROM (SELECT c_custkey, {_IBAN} AS h FROM customer)")
def _iban_grouped(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_IBAN).alias("h")).select("c_custkey", F.expr(f"concat('pay to ', {_IBAN_GROUPS}, '.')").alias("text"))
    return detect.spans_table(d, "c_custkey", "text", ["iban"]).select("c_custkey", F.col("text").alias("value"))


@_query("card_grouped_luhn", f"SELECT c_custkey, {_CARD_GROUPS} AS value FROM (SELECT c_custkey, {_CARD} AS h FROM customer) WHERE {_LUHN}")
def _card_grouped(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_CARD).alias("h")).select("c_custkey", F.expr(f"concat('card ', {_CARD_GROUPS}, ' paid')").alias("text"))
    return detect.spans_table(d, "c_custkey", "text", ["card"]).select("c_custkey", F.col("text").alias("value"))


_extract("phone_cc_shape", "concat('+49 151 ', lpad(cast(c_custkey % 100000000 AS varchar(9)), 8, '0'))", "phone_cc")
_extract("email_in_text", "concat('user.', cast(c_custkey AS varchar(9)), '@mail.example.org')", "email")

#: recogniser -> (prefix, validator of the digits after it)
_VAT = {"vat_it": ("IT", _N11, V.piva), "vat_gb": ("gb", _N9, V.gb_vat), "vat_pt": ("PT", _N9, V.nif)}
for _name, (_head, _digits, _rule) in _VAT.items():

    @_query(f"{_name}_extract", f"SELECT c_custkey, concat('{_head}', h) AS value FROM (SELECT c_custkey, {_digits} AS h FROM customer) WHERE {_rule('h')}")
    def _vat(spark, sf_dir, name=_name, head=_head, digits=_digits):
        d = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"concat('vat ', '{head}', {digits}, ', due')").alias("text"))
        return detect.spans_table(d, "c_custkey", "text", [name]).select("c_custkey", F.col("text").alias("value"))


@_query(
    "top_spender",
    f"""WITH u AS (SELECT k, kind, sum(e - s) AS units FROM ({_SPANS}) GROUP BY k, kind)
    SELECT k, arg_max(kind, units * 10 + CASE kind WHEN 'CARD' THEN 0 WHEN 'PHONE' THEN 1 ELSE 2 END) AS kind, cast(max(units) AS bigint) AS units FROM u WHERE units > 0 GROUP BY k""",
)
def _spender(spark, sf_dir):
    d = _span_rows(spark, sf_dir).withColumn("units", F.col("end") - F.col("start"))
    return spans.top_spender(d, "k", ["CARD", "PHONE", "TAXID"])


_EVAL = "SELECT l_returnflag AS kind, cast(l_partkey % 40 AS varchar(9)) AS text, l_linenumber AS n FROM lineitem"


@_query(
    "multiset_scores",
    f"""WITH x AS ({_EVAL}), a AS (SELECT kind, text, count(*) AS f FROM x WHERE n % 2 = 0 GROUP BY kind, text), b AS (SELECT kind, text, count(*) AS e FROM x WHERE n % 3 <> 0 GROUP BY kind, text),
    t AS (SELECT kind, sum(least(coalesce(f, 0), coalesce(e, 0))) AS hit, sum(coalesce(f, 0)) AS f, sum(coalesce(e, 0)) AS e FROM a FULL JOIN b USING (kind, text) GROUP BY kind),
    s AS (SELECT kind, cast(hit AS double) / cast(e AS double) AS recall, cast(hit AS double) / cast(f AS double) AS "precision" FROM t)
    SELECT kind, recall, "precision", 2 * recall * "precision" / (recall + "precision") AS f1 FROM s""",
)
def _scores(spark, sf_dir):
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    x = spark.sql(_EVAL)
    return spans.scores(x.filter("n % 2 = 0"), x.filter("n % 3 <> 0"))


@_query(
    "chunk_windows",
    """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, n, unnest(range(0, greatest(0, n - 33) + 1, 448)) AS s FROM d)
    SELECT doc_id, cast(s AS int) AS "start", cast(least(n, s + 480) AS int) AS "end" FROM w""",
)
def _windows(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.explode(labels.chunk_ranges(F.length("text"))).alias("w"))
    return d.select("doc_id", "w.start", "w.end")


@_query("redact_userinfo", r"SELECT page_id, regexp_replace(replace(url, '://', '://me:pw@'), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\1<redacted>@') AS url FROM pages")
def _redact(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", requests.redact_url(F.replace("url", F.lit("://"), F.lit("://me:pw@"))).alias("url"))


@_query(
    "credential_choice",
    """SELECT decision, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'client_authorization' WHEN o_orderkey % 2 = 0 THEN 'client_api_key'
    WHEN o_custkey % 5 = 0 THEN 'configured' ELSE 'rejected' END AS decision FROM orders) GROUP BY decision""",
)
def _credential(spark, sf_dir):
    have = lambda c: F.when(c, F.lit("set"))
    d = _table(spark, sf_dir, "orders").select(requests.credential(have(F.col("o_orderkey") % 3 == 0), have(F.col("o_orderkey") % 2 == 0), have(F.col("o_custkey") % 5 == 0)).alias("decision"))
    return d.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "admit_bodies",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'blocked' WHEN length(c_name) + length(cast(c_custkey AS varchar(20))) + 16 > 36 THEN 'blocked' ELSE 'ok' END AS status FROM customer""",
)
def _admit(spark, sf_dir):
    whole = F.concat(F.lit('{"name":"'), "c_name", F.lit('","k":'), F.col("c_custkey").cast("string"), F.lit("}"))
    d = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("{"), "c_name")).otherwise(whole).alias("body"))
    return requests.admit(d, 36).select("c_custkey", "status")


@_query("demask_json_escaped", """SELECT c_custkey, concat('{"a":"say \\"', c_name, '\\""}') AS text FROM customer""")
def _json(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").withColumn("v", F.concat(F.lit('say "'), "c_name", F.lit('"')))
    return d.select("c_custkey", vault.demask(F.lit('{"a":"[EMAIL_1]"}'), F.create_map(F.lit("[EMAIL_1]"), F.col("v")), json=True).alias("text"))


@_query("header_list", "SELECT c_custkey, concat('x-', lower(c_name), '|accept') AS names FROM customer")
def _header_list(spark, sf_dir):
    d = _table(spark, sf_dir, "customer")
    return d.select("c_custkey", F.array_join(requests.parse_header_list(F.concat(F.lit(" X-"), "c_name", F.lit(" ,, Accept "))), "|").alias("names"))


from . import flows  # noqa: E402, F401  registers its queries here
