"""Variants against the walk, the table function, stages, the sink's replays, the cache table, windows and logits."""

import json
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from veilspark.functions import labels
from veilspark.operators import bodies, cache, detect, detectors, variants, vault
from veilspark.plans import stages
from veilspark.streaming import sink

# --- bodies


def random_bodies(n):
    r = random.Random(5)

    def text():
        return r.choice(["", "plain", "a@b.org", 'q"uo\\te\n', "日本 🙂", "[EMAIL_1]", "\u0000x"])

    def part():
        return r.choice([text(), {"type": "text", "text": text()}, {"text": text()}, {"type": "text"}, {"type": "image"}, {"type": "tool_use", "input": {"k": text()}}, {"type": "text", "text": 5}, 17, None, {"type": "tool_result", "content": [{"type": "text", "text": text()}]}])

    def content():
        return r.choice([text(), text(), [part() for _ in range(r.randint(0, 3))], None, 5, {"text": "x"}])

    def message():
        m = {"role": "user", "content": content()}
        if r.random() < 0.3:
            m["name"] = r.choice([text(), 5, None])
        if r.random() < 0.1:
            m["tool_calls"] = r.choice([None, [], [{"function": {"arguments": text()}}]])
        if r.random() < 0.1:
            del m["content"]
        return m if r.random() < 0.95 else r.choice([5, "x", None, [1]])

    out = []
    for _ in range(n):
        b = {"messages": [message() for _ in range(r.randint(0, 4))]}
        for key, value in (("system", [text(), [{"type": "text", "text": text()}], None, 5, [17]]), ("tools", [[], None, [{"description": text(), "function": {"description": text()}}]])):
            if r.random() < 0.2:
                b[key] = r.choice(value)
        s = json.dumps(b, ensure_ascii=r.random() < 0.3)
        out.append(r.choice([s] * 12 + [s + "}", s + " x", s + ',"end":1', " " + s + "\n", "[" + s + "]", s[:-1], s.replace('"role"', '"content":"twice","role"'), s.replace("plain", "\\ud83d"), s.replace("plain", "\\ud83d\\ude42")]))
    return out + ["", "{}", "[]", "null", "5", '{"messages":{}}', '{"messages":[]}', '{"a":1},"end":"x"} {"b":', '{"messages":[{"content":"x"}],"n":1e400}', None]


@pytest.fixture(scope="module")
def odd_bodies(spark):
    return spark.createDataFrame(list(enumerate(random_bodies(3000))), "request_id long, body string").repartition(4).cache()


@pytest.mark.parametrize("schema", ["openai", "anthropic"])
def test_variants_equal_the_walk(odd_bodies, schema):
    want = sorted(map(tuple, bodies.fields(odd_bodies, schema).collect()))
    assert sorted(map(tuple, variants.fields(odd_bodies, schema).collect())) == want
    plain = sorted(map(tuple, variants.plain_fields(odd_bodies, schema).collect()))
    assert 300 < len(plain) < len(want) and set(plain) < set(want)


def test_plain_bodies_stay_in_the_jvm(odd_bodies):
    plan = variants.plain_fields(odd_bodies, "openai")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("schema", ["openai", "anthropic"])
def test_table_function_equals_the_walk(spark, odd_bodies, schema):
    variants.register(spark)
    odd_bodies.createOrReplaceTempView("odd_bodies")
    got = spark.sql(f"SELECT request_id, f.field_ord, f.path, f.text FROM odd_bodies, LATERAL text_fields(body, '{schema}') f")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bodies.fields(odd_bodies, schema).collect()))


def test_table_function_wants_a_known_shape(spark):
    variants.register(spark)
    with pytest.raises(Exception, match="shape: one of"):
        spark.sql("SELECT * FROM text_fields('{}', 'other')").collect()


# --- stages


class Upper:
    """Marks what it sees, to tell the order."""

    def __init__(self, mark):
        self.name = self.mark = mark

    def on_request(self, requests):
        return requests.withColumn("body", F.regexp_replace("body", '"content":"', f'"content":"{self.mark}'))

    def on_response(self, replies):
        return replies.withColumn("body", F.regexp_replace("body", '"content":"', f'"content":"{self.mark}'))


def test_stages_go_out_in_order_and_back_in_reverse(spark):
    d = spark.createDataFrame([(1, "openai", '{"messages":[{"content":"mail a@b.org"}]}'), (2, "openai", "{"), (3, "openai", None), (4, None, "{}")], "request_id long, schema string, body string")
    d = d.withColumn("headers", F.create_map(F.lit("a"), F.lit("b")))
    way = [Upper("1"), stages.Admission(60), Upper("2"), stages.Privacy(detectors.build(), notice=False)]
    sent = stages.outbound(d, way)
    got = {r["request_id"]: r for r in sent.collect()}
    assert json.loads(got[1]["body"])["messages"][0]["content"] == "21mail [EMAIL_1]" and got[1]["vault"] == {"[EMAIL_1]": "a@b.org"}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == ["ok", "blocked: no JSON", "blocked: no body", "blocked: unknown shape"]
    assert all(got[k]["body"] is None and got[k]["vault"] == {} for k in (2, 3, 4))
    replies = spark.createDataFrame([(1, '{"choices":[{"message":{"content":"[EMAIL_1]"}}]}')], "request_id long, body string")
    assert json.loads(stages.inbound(replies, sent, way).first()["body"])["choices"][0]["message"]["content"] == "12a@b.org"


# --- the sink


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    rows = [(k, json.dumps({"messages": [{"content": f"mail {k}@b.org"}]}) if k != 3 else "{", {"Anthropic-Version": "x"} if k == 1 else None) for k in range(6)]
    source, out, vaults, state = (str(tmp_path / x) for x in ("in", "out", "vaults", "state"))
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, "request_id long, body string, headers map<string,string>").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("request_id long, body string, headers map<string,string>").option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: sink.start(stream(), out, vaults, state, "anthropic", {"availableNow": True}, notice=False).awaitTermination(120)
    assert run()
    read = lambda p: sorted((r["request_id"], r["batch"], *map(str, r[1:])) for r in spark.read.parquet(p).collect())
    first = read(out), read(vaults)
    assert len(first[0]) == 6 and len(first[1]) == 5 and {r[1] for r in first[0]} == {0, 1}
    sent = {r["request_id"]: r for r in spark.read.parquet(out).collect()}
    assert sent[1]["headers"] == {"Anthropic-Version": "x"} and sent[0]["headers"] == {"anthropic-version": "2023-06-01"}
    assert sent[3]["body"] is None and sent[3]["headers"] is None and sent[3]["status"] == "blocked: no JSON"
    (tmp_path / "state" / "commits" / "1").unlink()  # as if the driver had died after the write
    shutil.rmtree(tmp_path / "state" / "commits" / ".1.crc", ignore_errors=True)
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run()
    assert (read(out), read(vaults)) == first


# --- the cache table


def test_second_run_scans_only_new_texts(spark, tmp_path):
    long = lambda k: f"mail {k}@b.org and +31 20 624 11{k:02d} " + "x" * 300
    frame = lambda ks: spark.createDataFrame([(k, long(k)) for k in ks] + [(90, "short c@d.org"), (91, None), (92, "x" * 400)], "id long, text string")
    kept = cache.TextCache(spark, str(tmp_path / "c"), most=3)
    sizes = lambda: {g: kept.table().filter(F.col("generation") == g).count() for g in kept.generations()}

    def check(ks):
        d = frame(ks)
        want = {r["id"]: r["spans"] for r in detect.with_spans(d).collect()}
        assert {r["id"]: r["spans"] for r in kept.find(d).collect()} == want

    check([0, 1, 0])  # equal texts are kept once
    assert sizes() == {0: 2}
    check([0, 1, 2])
    assert sizes() == {0: 3}  # only one text was new
    check([0, 3])  # the generation is full: a new one begins, and what is met again moves into it
    assert sizes() == {0: 3, 1: 2}
    check([4])
    assert sizes() == {0: 3, 1: 3}
    check([5])  # the oldest generation goes, and with it the texts 1 and 2
    assert sizes() == {1: 3, 2: 1}
    assert {r["text"][:8] for r in kept.table().select("text").collect()} == {f"mail {k}@b" for k in (0, 3, 4, 5)}


def test_equal_hashes_share_nothing_and_refusals_are_not_kept(spark, tmp_path):
    d = spark.createDataFrame([(k, f"mail {k}@b.org, +31 20 624 11{k:02d}" + " y" * 200) for k in range(8)], "id long, text string")
    kept = cache.TextCache(spark, str(tmp_path / "a"), hash_=F.lit(7).cast("long"))
    for _ in range(2):
        assert all(r["spans"][-1]["text"] != "" and any(s["text"] == f"{r['id']}@b.org" for s in r["spans"]) for r in kept.find(d).collect())
    refused = cache.TextCache(spark, str(tmp_path / "b"), units=1)
    assert [r["spans"] for r in refused.find(d).collect()] == [None] * 8 and refused.table().count() == 0


def test_masking_takes_what_is_known(spark, tmp_path):
    d = spark.createDataFrame([(k, f"mail {k}@b.org, card 4111 1111 1111 1111" + " y" * 200) for k in range(4)], "id long, text string")
    found = cache.TextCache(spark, str(tmp_path / "c")).find(d)
    got = found.select("id", vault.masked(F.col("text"), found=F.col("spans")).alias("m")).select("id", "m.*")
    want = d.select("id", vault.masked(F.col("text")).alias("m")).select("id", "m.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


# --- windows and logits


def greedy(costs, budget, overlap):
    """The rule in words: take words while they fit, one at least; begin again `overlap` words back, but never at or before
    the last start."""
    out, start = [], 0
    while start < len(costs):
        end = start + 1
        while end < len(costs) and sum(max(1, c) for c in costs[start : end + 1]) <= max(1, budget):
            end += 1
        out.append((start, end))
        if end == len(costs):
            break
        start = max(start + 1, end - overlap)
    return out


def test_word_windows(spark):
    r = random.Random(9)
    rows = [(k, [r.choice([0, 1, 2, 3, 30]) for _ in range(r.randint(0, 60))]) for k in range(300)] + [(300, None), (301, [500]), (302, [500, 500, 1])]
    d = spark.createDataFrame(rows, "id int, costs array<int>")
    for budget, overlap in ((10, 3), (1, 0), (0, 2), (25, 40)):
        got = {x["id"]: x["w"] and [tuple(w) for w in x["w"]] for x in d.select("id", labels.word_windows(F.col("costs"), budget, overlap).alias("w")).collect()}
        for k, costs in rows:
            assert (got[k] or []) == ([] if costs is None else greedy(costs, budget, overlap)), (budget, overlap, costs)
        assert got[300] is None


def test_chunks_end_with_the_text(spark):
    tokens = [(0, 0), *[(5 * k, 5 * k + 4) for k in range(20)], (0, 0)]
    d = spark.createDataFrame([(100, tokens), (100, tokens[:4]), (100, []), (7, [(0, 0), (0, 0)])], "n int, o array<struct<start:int,end:int>>")
    got = [[tuple(x) for x in r["c"]] if r["c"] is not None else None for r in d.select(labels.chunk_chars(F.col("n"), F.col("o"), 8, 3).alias("c")).collect()]
    assert got == [[(0, 34), (20, 59), (45, 84), (70, 100)], [(0, 100)], None, [(0, 7)]]


def test_stitching_equals_the_whole_away_from_edges(spark):
    """Entities of up to three tokens, windows that overlap by four: each is whole in some window, so that every entity of
    the whole text is found, and what is found besides are parts of them at an edge."""
    r = random.Random(3)
    rows = []
    for key in range(40):
        ord_ = 0
        while ord_ < 60:
            kind, size = r.choice(["PER", "ORG", None, None]), r.randint(1, 3)
            for j in range(size):
                rows.append((key, ord_, f"{'B' if not j else 'I'}-{kind}" if kind else "O", ord_ * 10, ord_ * 10 + 8))
                ord_ += 1
    t = spark.createDataFrame(rows, "k int, ord int, label string, start int, end int")
    whole = {tuple(x) for x in labels.bio_decode(t, "k").collect()}
    n = t.groupBy("k").agg(F.max("ord").alias("m")).select("k", F.explode(labels.chunk_ranges((F.col("m") + 1).cast("int"), 12, 4)).alias("w")).select(F.col("k").alias("of"), "w.*")
    x = t.withColumnsRenamed({"start": "s", "end": "e"}).join(n, (F.col("k") == F.col("of")) & (F.col("ord") >= F.col("start")) & (F.col("ord") < F.col("end")))
    x = x.select(F.struct("k", "start").alias("id"), "ord", "label", (F.col("s") - F.col("start") * 10).alias("start_"), (F.col("e") - F.col("start") * 10).alias("end_")).withColumnsRenamed({"start_": "start", "end_": "end"})
    found = labels.bio_decode(x, "id").select(F.col("id.k").alias("k"), F.col("id.start").alias("window"), (F.col("id.start") * 10).alias("offset"), "kind", "start", "end")
    got = [tuple(x) for x in labels.stitch(found, "k").collect()]
    assert len(got) == len(set(got)) and whole <= set(got)
    assert all(any(k == w[0] and kind == w[1] and w[2] <= s and e <= w[3] for w in whole) for k, kind, s, e in set(got) - whole)


def test_the_last_of_equal_logits_wins(spark):
    def fold(row):
        best, at = math.nan, 0
        for i, x in enumerate(row):
            if not best > x:  # equal, larger, or not to be compared
                best, at = x, i
        return at

    r, nan = random.Random(1), math.nan
    rows = [[r.choice([1.0, 2.0, nan, -1.0, math.inf, -math.inf]) for _ in range(r.randint(0, 6))] for _ in range(400)] + [[], [nan] * 3, [0.0, -0.0]]
    got = [x["i"] for x in spark.createDataFrame([(x,) for x in rows], "l array<float>").coalesce(1).select(labels.best_label(F.col("l")).alias("i")).collect()]
    assert got == [fold(x) for x in rows]
