"""Queries of stages, of replies as streams, of model outputs in windows, of bodies as variants and in SQL, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, phones
from ..operators import cache, detect, detectors, variants, vault
from ..streaming import replies
from . import stages
from .registry import _bodies, _query, _table

# --- replies

_MIXED = """SELECT conv_id, turn, text, CASE conv_id % 3 WHEN 0 THEN 'events' WHEN 1 THEN 'body' ELSE 'failed' END AS kind FROM conversations WHERE text IS NOT NULL"""


@_query("stream_mixed_replies", _MIXED)
def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is masked and comes back in three pieces, cut anywhere: as events, as one JSON body, or as events of an
    upstream that fails at the end. Vaults are a table that the first pieces meet by a join. The texts are those of the
    conversations, and exactly the failed streams end with an error event."""
    d = vault.mask(_table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text"))
    d = d.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("stream_id"), "masked", "vault")
    half = (F.length("masked") / 2).cast("int")
    event = lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(t.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    events = F.concat(event(F.substring("masked", F.lit(1), half)), event(F.substring("masked", half + 1, F.length("masked"))), F.when(F.col("conv_id") % 3 == 0, F.lit("data: [DONE]\n\n")).otherwise(F.lit("")))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("masked").alias("content")).alias("message"))).alias("choices")))
    whole = d.select("*", F.when(F.col("conv_id") % 3 == 1, body).otherwise(events).cast("binary").alias("b"))
    n = F.octet_length("b")
    cuts = F.array(*[F.struct(F.lit(k).cast("long").alias("seq"), F.substring(F.col("b"), (n * k / 3).cast("int") + 1, (n * (k + 1) / 3).cast("int") - (n * k / 3).cast("int")).alias("bytes")) for k in range(3)])
    last = F.col("c.seq") == 2
    kind = F.when(F.col("conv_id") % 3 == 1, F.lit("application/json")).otherwise(F.lit("text/event-stream; charset=utf-8"))
    chunks = whole.select("stream_id", "conv_id", F.explode(cuts).alias("c")).select("stream_id", "c.seq", "c.bytes", F.lit("openai").alias("schema"), kind.alias("content_type"), (last & (F.col("conv_id") % 3 != 2)).alias("is_end"), (last & (F.col("conv_id") % 3 == 2)).alias("failed"))
    vaults = d.select("stream_id", F.explode("vault").alias("placeholder", "original"))
    got = replies.restore_recorded(replies.with_vaults(chunks, vaults)).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("all"))
    out = got.select("stream_id", F.array_join(F.transform("all", lambda x: x["bytes"].cast("string")), "").alias("out"))
    pieces = F.filter(F.split("out", "\n"), lambda x: x.startswith("data: {") & ~x.contains('"error"'))
    streamed = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.get_json_object(F.substring(x, F.lit(7), F.length(x)), "$.choices[0].delta.content"), F.lit(""))), "")
    failed = F.col("out").endswith(replies.FAILED)
    is_body = F.col("out").startswith("{")
    kind = F.when(is_body, "body").when(failed, "failed").otherwise("events")
    id_ = F.split("stream_id", ":")
    return out.select(id_[0].cast("long").alias("conv_id"), id_[1].cast("long").alias("turn"), F.when(is_body, F.get_json_object("out", "$.choices[0].message.content")).otherwise(streamed).alias("text"), kind.alias("kind"))


# --- model outputs

_COSTS = "list_transform(string_split(text, ' '), lambda w: CAST(greatest(1, length(w) // 3) AS bigint))"


@_query(
    "word_windows",
    """WITH RECURSIVE w AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) AS k, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, list(total ORDER BY k) AS c FROM (SELECT doc_id, k, sum(greatest(1, length(word) // 3)) OVER (PARTITION BY doc_id ORDER BY k) AS total FROM w) GROUP BY doc_id),
    p AS (
      SELECT doc_id, 0 AS s, greatest(1, len(list_filter(c, lambda x: x <= 12))) AS e FROM t
      UNION ALL
      SELECT doc_id, s, greatest(s + 1, len(list_filter(c, lambda x: x <= c[s] + 12))) AS e FROM (SELECT p.doc_id, p.e - least(2, p.e - p.s - 1) AS s, t.c FROM p JOIN t ON p.doc_id = t.doc_id WHERE p.e < len(t.c))
    ) SELECT doc_id, cast(s AS int) AS "start", cast(e AS int) AS "end" FROM p""",
)
def _word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cost a token for each three letters; windows of 12 tokens, shorter than some words, overlap by two words."""
    d = _table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    costs = F.transform(F.split("text", " ", -1), lambda w: F.greatest(F.lit(1), F.floor(F.length(w) / 3)).cast("long"))
    return d.select("doc_id", F.explode(labels.word_windows(costs, 12, 2)).alias("w")).select("doc_id", "w.start", "w.end")


_TAGGED = "SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord, CASE WHEN l_partkey % 4 = 0 THEN 'O' WHEN l_partkey % 4 = 1 THEN 'B-PER' WHEN l_partkey % 4 = 2 THEN 'I-PER' ELSE 'I-ORG' END AS label FROM lineitem"


@_query(
    "stitched_entities",
    f"""WITH t AS ({_TAGGED}), n AS (SELECT k, count(*) AS n FROM t GROUP BY k),
    w AS (SELECT k, n, unnest(range(0, greatest(0, n - 2) + 1, 3)) AS s FROM n),
    x AS (SELECT w.k, w.s AS win, t.ord, CASE WHEN label = 'O' THEN NULL WHEN label LIKE '%PER' THEN 'PERSON' ELSE 'ORG' END AS kind, label FROM w JOIN t ON t.k = w.k AND t.ord >= w.s AND t.ord < w.s + 4),
    g AS (SELECT *, sum(CASE WHEN kind IS NOT DISTINCT FROM p AND label NOT LIKE 'B-%' THEN 0 ELSE 1 END) OVER (PARTITION BY k, win ORDER BY ord) AS g FROM (SELECT *, lag(kind) OVER (PARTITION BY k, win ORDER BY ord) AS p FROM x))
    SELECT DISTINCT k, kind, cast(min(ord) * 10 AS int) AS "start", cast(max(ord) * 10 + 8 AS int) AS "end" FROM g WHERE kind IS NOT NULL GROUP BY k, win, g, kind""",
)
def _stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of ten characters, in windows of four that overlap by one: each window is decoded with places of its own, the
    entities are put back where they stand and found once."""
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    t = spark.sql(_TAGGED)
    n = t.groupBy("k").agg(F.count("*").cast("int").alias("n"))
    w = n.select("k", F.explode(labels.chunk_ranges(F.col("n"), 4, 1)).alias("w")).select(F.col("k").alias("of"), "w.start", "w.end")
    x = t.join(w, (F.col("k") == F.col("of")) & (F.col("ord") >= F.col("start")) & (F.col("ord") < F.col("end")))
    x = x.select(F.struct("k", "start").alias("id"), "ord", "label", ((F.col("ord") - F.col("start")) * 10).cast("int").alias("s"), ((F.col("ord") - F.col("start")) * 10 + 8).cast("int").alias("e"))
    found = labels.bio_decode(x.withColumnsRenamed({"s": "start", "e": "end"}), "id")
    return labels.stitch(found.select(F.col("id.k").alias("k"), F.col("id.start").alias("window"), (F.col("id.start") * 10).alias("offset"), "kind", "start", "end"), "k")


@_query(
    "logit_tags",
    """SELECT l_orderkey, l_linenumber, l_partkey, cast(CASE WHEN l_suppkey % 11 = 0 THEN 3 ELSE 4 - list_position(list_reverse(m), list_max(m)) END AS int) AS tag
    FROM (SELECT *, [l_partkey % 3, l_suppkey % 3, l_linenumber % 3, cast(l_quantity AS bigint) % 3] AS m FROM lineitem)""",
)
def _logit_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four logits a token with many ties, every eleventh supplier's all NaN: the last of equal ones wins."""
    d = _table(spark, sf_dir, "lineitem")
    own = F.array(*[(F.col(c).cast("long") % 3).cast("float") for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")])
    logits = F.when(F.col("l_suppkey") % 11 == 0, F.array_repeat(F.lit(float("nan")).cast("float"), 4)).otherwise(own)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", labels.best_label(logits).cast("int").alias("tag"))


@_query(
    "logit_entities",
    """WITH t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord, [l_partkey % 3, l_suppkey % 3, l_linenumber % 3] AS m FROM lineitem),
    x AS (SELECT k, ord, CASE WHEN list_position(list_reverse(m), list_max(m)) = 1 THEN 'ORG' WHEN list_position(list_reverse(m), list_max(m)) = 2 THEN 'PERSON' END AS kind FROM t),
    g AS (SELECT *, sum(CASE WHEN kind IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY ord) AS g FROM (SELECT *, lag(kind) OVER (PARTITION BY k ORDER BY ord) AS p FROM x))
    SELECT k, kind, cast(min(ord) * 10 AS int) AS "start", cast(max(ord) * 10 + 8 AS int) AS "end" FROM g WHERE kind IS NOT NULL GROUP BY k, g, kind""",
)
def _logit_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a model's logits by token to entities: tags, then islands. The marks around a text have no characters and go."""
    d = _table(spark, sf_dir, "lineitem")
    m = F.array(*[(F.col(c).cast("long") % 3).cast("double") for c in ("l_partkey", "l_suppkey", "l_linenumber")])
    rows = d.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", m.alias("m")))).alias("rows"))
    mark = F.array(F.array(F.lit(0.0), F.lit(9.0), F.lit(0.0)))
    logits = F.concat(mark, F.transform("rows", lambda x: x["m"]), mark)
    place = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))
    none = F.array(place(F.lit(0), F.lit(0)))
    offsets = F.concat(none, F.transform("rows", lambda x, i: place(i * 10, i * 10 + 8)), none)
    names = F.create_map(*[F.lit(x) for x in ("0", "O", "1", "I-PER", "2", "I-ORG")])
    t = rows.select("k", F.explode(labels.tags(logits, offsets, names)).alias("t")).select("k", "t.*")
    return labels.bio_decode(t, "k")


# --- bodies

_WITH_TOOLS = """SELECT conv_id AS request_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS int) AS field_ord, text FROM conversations WHERE text IS NOT NULL
    UNION ALL SELECT conv_id, cast(count(text) AS int), concat('tool of ', conv_id) FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id"""


def _some_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as bodies, every fifth with a tool, which no plain body has."""
    d = _bodies(spark, sf_dir)
    tool = F.concat(F.lit('{"tools":[{"function":{"description":"tool of '), F.col("request_id").cast("string"), F.lit('"}}],'), F.substring("body", F.lit(2), F.length("body")))
    return d.withColumn("body", F.when(F.col("request_id") % 5 == 0, tool).otherwise(F.col("body")))


@_query("variant_fields", _WITH_TOOLS)
def _variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain bodies are read as variants, those with tools by the walk."""
    return variants.fields(_some_tools(spark, sf_dir), "openai").select("request_id", "field_ord", "text")


@_query("udtf_fields", _WITH_TOOLS)
def _udtf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through SQL and the table function."""
    variants.register(spark)
    _some_tools(spark, sf_dir).createOrReplaceTempView("bodies_with_tools")
    return spark.sql("SELECT request_id, f.field_ord, f.text FROM bodies_with_tools, LATERAL text_fields(body, 'openai') f")


@_query(
    "stages_round_trip",
    """SELECT conv_id AS request_id, CASE conv_id % 4 WHEN 0 THEN 'blocked: no JSON' WHEN 1 THEN 'blocked: unknown shape' ELSE 'ok' END AS status,
    CASE WHEN conv_id % 4 >= 2 THEN string_agg(text, '|' ORDER BY turn, role, text) END AS texts FROM conversations GROUP BY conv_id""",
)
def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests go out through admission and masking, and come back as replies in reverse order: the texts are those of
    the conversations, and the first stage that blocks a request gives the reason."""
    k = F.col("request_id") % 4
    body = F.when(k == 0, F.concat(F.lit("{"), F.col("body"))).otherwise(F.col("body"))
    schema = F.when(k == 1, "other").when(k == 2, "openai").otherwise("anthropic")
    requests = _bodies(spark, sf_dir).select("request_id", schema.alias("schema"), body.alias("body"), F.create_map(F.lit("x"), F.lit("y")).alias("headers"))
    way = [stages.Admission(), stages.Privacy(detectors.build(), notice=False)]
    sent = stages.outbound(requests, way)
    texts = F.from_json("body", "messages array<struct<content:string>>")["messages"]["content"]
    reply = F.when(F.col("schema") == "openai", F.to_json(F.struct(F.transform(texts, lambda t: F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices"))))
    reply = reply.otherwise(F.to_json(F.struct(F.transform(texts, lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"))))
    back = stages.inbound(sent.filter("status = 'ok'").select("request_id", reply.alias("body")), sent, way)
    own = F.from_json("body", "choices array<struct<message:struct<content:string>>>, content array<struct<text:string>>")
    back = back.select(F.col("request_id").alias("of"), F.array_join(F.coalesce(own["choices"]["message"]["content"], own["content"]["text"]), "|").alias("texts"))
    return sent.select("request_id", "status").join(back, F.col("request_id") == F.col("of"), "left").drop("of")


@_query("cached_emails", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{detect.EMAIL}')) AS bigint) AS n_emails FROM documents")
def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run fills the cache; the second one reads what it found and scans only what is too short or long to keep."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    kept = cache.TextCache(spark, f"{root.rstrip('/')}/cache-{uuid.uuid4().hex}", names=["email"])
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept.find(d)
    return kept.find(d).select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_emails"))


# --- precision: texts that hold no telephone number, by what they hold and by region


def _n(k: int, most: int, digits: int = 0) -> str:
    """The k-th number below `most` of a linear congruential generator that starts at c_custkey; digits: padded with zeros."""
    made = f"((c_custkey * 1103515245 + {12345 + 7919 * k}) % 2147483648 * {2 * k + 69069} + {k}) % 4294967291 % {most}"
    text = f"cast({made} AS varchar(20))"
    return f"lpad({text}, {digits}, '0')" if digits else text


_NEGATIVES = {
    "amount": f"concat('total ', {_n(1, 100000)}, '.', {_n(2, 100, 2)}, ' due')",
    "grouped_amount": f"concat('sum ', {_n(1, 900)}, '.', {_n(2, 1000, 3)}, '.', {_n(3, 1000, 3)}, ' paid')",
    "iso_date": f"concat('on ', '20', {_n(1, 30, 2)}, '-', {_n(2, 13, 2)}, '-', {_n(3, 29, 2)})",
    "dotted_date": f"concat('am ', {_n(1, 29, 2)}, '.', {_n(2, 13, 2)}, '.20', {_n(3, 30, 2)})",
    "clock": f"concat('at ', {_n(1, 24, 2)}, ':', {_n(2, 60, 2)}, ':', {_n(3, 60, 2)})",
    "version": f"concat('v ', {_n(1, 20)}, '.', {_n(2, 100)}, '.', {_n(3, 3000)})",
    "public_ip": f"concat('from ', {_n(1, 10)}, {_n(5, 9)}, '.', {_n(2, 256)}, '.', {_n(3, 256)}, '.', {_n(4, 256)})",
    "private_ip_10": f"concat('host 10.', {_n(1, 256)}, '.', {_n(2, 256)}, '.', {_n(3, 256)})",
    "private_ip_192": f"concat('host 192.168.', {_n(1, 256)}, '.', {_n(2, 256)})",
    "order_id": f"concat('order ', {_n(1, 100000000, 8)}, ' sent')",
    "padded_id": f"concat('ref 00', {_n(1, 10000000, 7)}, ' sent')",
    "table_row": f"concat('row ', {_n(1, 99)}, '  ', {_n(2, 1000)}, '   ', {_n(3, 1000)}, ' ', {_n(4, 10000)})",
    "coordinates": f"concat({_n(1, 90)}, '.', {_n(2, 10000, 4)}, ' ', {_n(3, 180)}, '.', {_n(4, 10000, 4)})",
    "isbn": f"concat('978-3-', {_n(1, 100, 2)}, '-', {_n(2, 1000000, 6)}, '-', {_n(3, 10)})",
    "epoch": f"concat('ts=1', {_n(1, 1000000000, 9)}, ' ok')",
}
_MADE = " UNION ALL ".join(f"SELECT '{c}' AS category, c_custkey, {sql} AS text FROM customer" for c, sql in _NEGATIVES.items())


def _matrix_sql() -> str:
    """Every start, every form, every shortened value; the plans are the fixed values of functions/phones.py."""
    gap = "[\\t \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}./()-]{1,4}"
    forms = {
        "trunk": f"0[0-9]{{1,4}}{gap}[0-9]{{3,4}}{gap}[0-9]{{3,4}}\\b|0[0-9]{{1,4}}{gap}[0-9]{{4,8}}\\b|0[0-9]{{6,11}}\\b",
        "trunk_pairs": f"0[0-9](?:{gap}[0-9]{{2}}){{4}}\\b",
        "groups": f"[1-9][0-9]{{1,2}}(?:{gap}[0-9]{{2,4}}){{1,3}}\\b",
        "long_block": f"[1-9][0-9]{{2}}{gap}[0-9]{{6,8}}\\b",
    }
    whole = " UNION ALL ".join(f"SELECT category, c_custkey, '{f}' AS form, regexp_extract(rest, '^(?:{p})') AS h FROM s WHERE regexp_matches(rest, '^(?:{p})')" for f, p in forms.items())
    cut = " UNION ALL ".join(f"SELECT category, c_custkey, form, left(h, k) AS h FROM (SELECT *, unnest(range(1, length(h))) AS k FROM w WHERE form = '{f}') WHERE regexp_matches(substr(h, k + 1, 1), '[ ./()-]') AND regexp_extract(left(h, k), '^(?:{forms[f]})') = left(h, k)" for f in ("groups", "long_block"))
    plain = "regexp_replace(h, '[^0-9]', '', 'g')"
    region = []
    for r, plan in phones.PLANS.items():
        own = ", ".join(f"'{f}'" for f, rs in phones.FAMILIES.items() if r in rs)
        digits = f"CASE WHEN {plain} LIKE '0%' THEN {'NULL' if r in ('es', 'lv', 'pt') else plain if r == 'it' else f'substr({plain}, 2)'} ELSE {plain} END"
        plan = plan.replace("\\d", "[0-9]")
        region.append(f"SELECT m.category, '{r}' AS region, cast(avg(CASE WHEN f.c_custkey IS NULL THEN 0 ELSE 1 END) AS double) AS rate FROM m LEFT JOIN (SELECT DISTINCT category, c_custkey FROM c WHERE form IN ({own}) AND regexp_full_match({digits}, '{plan}')) f ON m.category = f.category AND m.c_custkey = f.c_custkey GROUP BY m.category")
    return f"""WITH m AS ({_MADE}), s AS (SELECT category, c_custkey, substr(text, i, length(text)) AS rest FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM m) WHERE i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9_]')),
    w AS ({whole}), c AS (SELECT * FROM w UNION ALL {cut}) {' UNION ALL '.join(region)}"""


@_query("phone_precision_matrix", _matrix_sql())
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts in which a region's domestic forms see a telephone number: 15 categories, 9 regions, one scan of each
    text a region."""
    _table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    d = spark.sql(_MADE)
    each = d.select("category", *[(F.size(detect.spans(F.col("text"), detect.DOMESTIC, [r])) > 0).cast("int").alias(r) for r in phones.REGIONS])
    return each.groupBy("category").agg(*[F.avg(r).alias(r) for r in phones.REGIONS]).unpivot("category", list(phones.REGIONS), "region", "rate")
