"""Model outputs as columns: label maps, BIO islands, sigmoid, chunk ranges, the safe part of a streamed text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Kinds by the last part of a label, and by a span model's label.
NER_KINDS = {
    **dict.fromkeys(("PER", "PERSON", "GIVENNAME", "SURNAME", "FIRSTNAME", "LASTNAME", "NAME"), "PERSON"),
    **dict.fromkeys(("ORG", "ORGANIZATION", "COMPANY"), "ORG"),
    **dict.fromkeys(("LOC", "GPE", "LOCATION", "CITY", "STATE", "COUNTRY"), "LOCATION"),
}
KIND_ORDER = ["PERSON", "ORG", "LOCATION"]


def _kind(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in NER_KINDS.items() for x in kv]), label)


def label_kind(label: Column) -> Column:
    return _kind(F.upper(F.element_at(F.split(label, "[-_]"), -1)))


def begins(label: Column) -> Column:
    """Whether a label says that an entity begins: B before the first hyphen or underscore."""
    return F.upper(F.element_at(F.split(label, "[-_]"), 1)) == "B"


def span_labels(raw: Column) -> Column:
    """The labels of a comma-separated list with their kinds; null if one has no kind or there is none."""
    names = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(names, lambda x: F.struct(x.alias("label"), _kind(F.upper(x)).alias("kind")))
    return F.when((F.size(pairs) > 0) & F.forall(pairs, lambda p: p["kind"].isNotNull()), pairs)


def labels_fit(id2label: Column, classes: Column) -> Column:
    """Whether a label map names exactly the classes 0 to classes - 1."""
    return F.coalesce((F.size(id2label) == classes) & F.forall(F.sequence(F.lit(0), F.greatest(classes, F.lit(1)) - 1), lambda i: F.map_contains_key(id2label, i.cast("string"))), F.lit(False))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def bio_decode(tokens: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """Entities (key, kind, start, end) of labelled tokens (key, ord, label, start, end): a token goes on if its kind is
    that of the one before and its label does not begin a new one; a label without a kind ends the entity. text: a column
    of the whole text, if blanks around an entity are to be cut off; an entity of blanks only goes."""
    order = W.partitionBy(key).orderBy("ord")
    t = tokens.withColumn("kind", label_kind(F.col("label")))
    goes_on = F.col("kind").eqNullSafe(F.lag("kind").over(order)) & ~begins(F.col("label"))
    t = t.withColumn("entity", F.sum(F.when(goes_on, 0).otherwise(1)).over(order)).filter(F.col("kind").isNotNull())
    found = t.groupBy(key, "entity", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), *([F.first(text).alias("whole")] if text else []))
    if text:
        own = F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start"))
        found = found.select(key, "kind", "start", "end", F.regexp_replace(own, r"^\s+", "").alias("own"))
        found = found.select(key, "kind", (F.col("end") - F.length("own")).alias("start"), F.regexp_replace("own", r"\s+\z", "").alias("own")).filter("own <> ''")
        return found.select(key, "kind", "start", (F.col("start") + F.length("own")).cast("int").alias("end"))
    return found.drop("entity")


WORDS = re.compile(r"\w+(?:[-_]\w+)*|\S")


def split_words(text: Column) -> Column:
    """Places of words, hyphenated ones as one, and of single other characters; null for null."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def places(a: pa.Array) -> pa.Array:
        found = [None if t is None else [{"start": m.start(), "end": m.end()} for m in WORDS.finditer(t)] for t in a.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return places(text)


def best_spans(scores: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """key, kind, start_word, end_word: of scored word spans (key, start_word, end_word, kind, logit) above the threshold,
    the likeliest first (then the earlier, the longer, by kind), each that shares no word with one taken before."""
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    likely = scores.withColumn("p", sigmoid(F.col("logit"))).filter((F.col("p") >= threshold) & (F.col("start_word") <= F.col("end_word")))
    row = F.struct((-F.col("p")).alias("p"), F.col("start_word").alias("s"), (-F.col("end_word")).alias("e"), rank.alias("r"), F.col("kind").alias("kind"))
    greedy = """aggregate(rows, cast(array() AS array<struct<s:int,e:int,kind:string>>), (taken, x) ->
        CASE WHEN exists(taken, t -> x.s <= t.e AND t.s <= -x.e) THEN taken ELSE concat(taken, array(named_struct('s', x.s, 'e', -x.e, 'kind', x.kind))) END)"""
    got = likely.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows")).select(key, F.explode(F.expr(greedy)).alias("t"))
    return got.select(key, "t.kind", F.col("t.s").alias("start_word"), F.col("t.e").alias("end_word"))


def chunk_ranges(n: Column, window: int = 480, overlap: int = 32) -> Column:
    """[start, end) token windows that cover n tokens."""
    stride = window - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1 - overlap), F.lit(stride))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(n, s + window).alias("end"))))


def chunk_chars(n: Column, offsets: Column, window: int = 480, overlap: int = 32) -> Column:
    """[start, end) character ranges of the token windows that cover a text of n characters. offsets: array of (start, end)
    of its tokens, the marks before and after the text among them: the mark after it says (0, 0), so that the window that
    holds it ends with the text. A text without tokens has no range."""
    stride, size = max(1, window - overlap), F.size(offsets)
    count = F.when(size > window, F.ceil((size - window) / stride)).otherwise(0).cast("int")
    ranges = F.transform(F.sequence(F.lit(0), count), lambda k: _chunk(n, offsets, size, k * stride, window))
    return F.when(size > 0, ranges)


def _chunk(n: Column, offsets: Column, size: Column, first: Column, window: int) -> Column:
    start = F.element_at(offsets, first + 1)["start"].cast("int")
    end = F.when(first + window >= size, n.cast("int")).otherwise(F.greatest(F.element_at(offsets, F.least(first + window, size))["end"].cast("int"), start))
    return F.struct(start.alias("start"), end.alias("end"))


def word_windows(costs: Column, budget: int = 100, overlap: int = 8) -> Column:
    """[start, end) word windows of a text whose words cost so many tokens (one at least): each holds as many words as the
    budget allows, one if that alone costs more, and begins `overlap` words before the end of the one before, but always
    after its start. Null for null, none for no words."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def plan(a: pa.Array) -> pa.Array:
        most = max(1, budget)
        per, flat, null = a.offsets.to_numpy(), a.values.fill_null(1).to_numpy(zero_copy_only=False), a.is_null().to_pylist()
        out = []
        for k, (lo, hi) in enumerate(zip(per[:-1].tolist(), per[1:].tolist())):
            if null[k]:
                out.append(None)
                continue
            n, total = hi - lo, np.concatenate([[0], np.cumsum(np.maximum(flat[lo:hi], 1))])
            found, start, end = [], 0, 0
            while end < n:
                end = max(start + 1, int(np.searchsorted(total, total[start] + most, side="right")) - 1)
                found.append({"start": start, "end": end})
                start = end - min(overlap, end - start - 1)
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return plan(costs.cast("array<long>"))


def stitch(entities: DataFrame, key: str) -> DataFrame:
    """key, kind, start, end of entities found by windows (key, window, offset, kind, start, end): places count from the
    window's offset; in order of places, then of windows, an entity equal to the one before it goes."""
    d = entities.select(key, "window", "kind", (F.col("start") + F.col("offset")).cast("int").alias("start"), (F.col("end") + F.col("offset")).cast("int").alias("end"))
    own, last = F.struct("kind", "start", "end"), W.partitionBy(key).orderBy("start", "end", "window", "kind")
    d = d.withColumn("again", own.eqNullSafe(F.lag(own).over(last)))
    return d.filter(~F.col("again")).select(key, "kind", "start", "end")


def best_label(logits: Column) -> Column:
    """The class of the largest logit, the last of equal ones. As comparisons with NaN are neither, a NaN gives way to
    what follows it and takes the place of what stands before it: of NaNs only, the last class; 0 for no logits."""
    pairs = F.transform(logits, lambda x, i: F.struct(x.cast("double").alias("x"), i.alias("i")))
    stays = lambda a, b: ~F.isnan(a["x"]) & ~F.isnan(b["x"]) & (a["x"] > b["x"])
    won = F.aggregate(pairs, F.struct(F.lit(float("nan")).alias("x"), F.lit(0).alias("i")), lambda a, b: F.when(stays(a, b), a).otherwise(b))
    return won["i"]


def tags(logits: Column, offsets: Column, id2label: Column) -> Column:
    """Array of (ord, label, start, end) of a text's tokens: logits by token and class, offsets by token, labels by class
    as text. Tokens without characters (marks around the text) go; a class without a label is `O`."""
    label = lambda row: F.coalesce(F.try_element_at(id2label, best_label(row).cast("string")), F.lit("O"))
    all_ = F.transform(F.arrays_zip(logits.alias("l"), offsets.alias("o")), lambda t, i: F.struct(i.alias("ord"), label(t["l"]).alias("label"), t["o"]["start"].alias("start"), t["o"]["end"].alias("end")))
    return F.filter(all_, lambda t: t["start"] < t["end"])


def safe_prefix(pending: Column) -> Column:
    """How much of a streamed text can't be part of an unfinished token."""
    tail = F.regexp_extract(pending, r"(\[[A-Za-z0-9 _\-]{0,32})\z", 1)
    return F.length(pending) - F.length(tail)
