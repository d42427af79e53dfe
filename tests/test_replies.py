"""Replies as streams: equal at every cut, flushed by timers, whole bodies beside event streams, vaults by a join."""

import datetime
import json
import time

import pytest

from veilspark.streaming import replies
from veilspark.streaming.events import FAILED

KIND = "stream_id string, seq long, bytes binary, schema string, content_type string, vault map<string,string>, is_end boolean, failed boolean, at timestamp"
VAULT = {"[EMAIL_1]": "kim@post.example", "[PERSON_1]": 'K "x" Lee'}


def delta(t, choice=0):
    return 'data: {"choices":[{"index":%d,"delta":{"content":%s}}]}\n\n' % (choice, json.dumps(t))


def block(t, kind="text_delta"):
    return 'event: content_block_delta\ndata: {"type":"content_block_delta","index":1,"delta":{"type":"%s","%s":%s}}\n\n' % (kind, "text" if kind == "text_delta" else "partial_json", json.dumps(t))


OPENAI = delta("Dear [EMA") + delta("é [pers", 1) + delta("IL_1], ") + delta("on 1]", 1) + "data: [DONE]\n\n"
ANTHROPIC = block("to [PERSON") + block("_1] and [EM") + 'event: content_block_stop\ndata: {"type":"content_block_stop","index":1}\n\n'
BODY = json.dumps({"choices": [{"message": {"content": "to [EMAIL_1]"}}]}, separators=(",", ":"))


def pieces(stream, data, cuts, schema="openai", kind="text/event-stream", vault=VAULT, end=True, failed=False, at=0):
    raw, cuts = data.encode(), [0, *cuts, len(data.encode())]
    rows = []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        last = k == len(cuts) - 2
        rows.append((stream, k, raw[lo:hi], schema if not k else None, kind if not k else None, vault if not k else None, last and end and not failed, last and failed, datetime.datetime.fromtimestamp(1_700_000_000 + at)))
    return rows


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["stream_id"], r["seq"])):
        out[r["stream_id"]] = out.get(r["stream_id"], b"") + bytes(r["bytes"])
    return {k: v.decode() for k, v in out.items()}


def texts(stream):
    found = {}
    for line in stream.split("\n"):
        if line.startswith("data: {"):
            v = json.loads(line[6:])
            for c in v.get("choices", []):
                found[c["index"]] = found.get(c["index"], "") + c["delta"]["content"]
            if v.get("type") == "content_block_delta":
                found[0] = found.get(0, "") + next(iter(x for k, x in v["delta"].items() if k != "type"))
    return found


def stream(spark, folder, batches, **how):
    """Runs each batch of rows as a file of its own; gives all rows that came out, and the last progress."""
    (folder / "in").mkdir()
    chunks = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    vaults = how.pop("vaults", None)
    if vaults is not None:
        chunks = replies.with_vaults(chunks, vaults)
    wait, out, progress = how.pop("wait", 0), [], None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(folder / f"b{k}"))
        part = next((folder / f"b{k}").glob("part*.parquet"))
        part.rename(folder / "in" / f"{k}.parquet")
        if k and wait:
            time.sleep(wait)
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str("event_time" in how).lower())
        q = replies.restore(chunks, **how).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        progress = q.lastProgress or progress
    return spark.read.schema(replies.OUT).parquet(str(folder / "out")).collect(), progress


def test_every_cut_gives_the_same(spark):
    rows, n = [], 0
    for schema, data in (("openai", OPENAI), ("anthropic", ANTHROPIC)):
        for cut in range(1, len(data.encode())):
            rows += pieces(f"{schema}{n}", data, [cut], schema)
            n += 1
    got = joined(replies.restore_recorded(spark.createDataFrame(rows, KIND)).collect())
    assert len(got) == n
    for name, out in got.items():
        assert texts(out) == ({0: "Dear kim@post.example, ", 1: 'é K "x" Lee'} if name.startswith("openai") else {0: 'to K "x" Lee and [EM'}), name


def test_bodies_errors_and_missing_vaults(spark):
    rows = pieces("json", BODY, [5, 9], kind="application/json") + pieces("plain", OPENAI, [7], vault=None) + pieces("empty vault", BODY, [7], kind="application/json", vault={})
    rows += pieces("html", "<html>[EMAIL_1]", [3], kind="text/html") + pieces("failed", delta("Dear [EMA") + "dat", [20], failed=True)
    rows += pieces("failed body", BODY, [4], kind="application/json", failed=True) + pieces("failed plain", "data: {", [2], vault=None, failed=True)
    rows += pieces("no end", delta("Dear [EMAIL_1"), [9], end=False) + pieces("no type", OPENAI, [30], kind=None) + pieces("TYPE", OPENAI, [30], kind="Text/Event-Stream; charset=utf-8")
    got = joined(replies.restore_recorded(spark.createDataFrame(rows, KIND)).collect())
    assert json.loads(got["json"])["choices"][0]["message"]["content"] == "to kim@post.example"
    assert got["plain"] == OPENAI and got["empty vault"] == BODY
    assert json.loads(got["html"])["error"]["type"] == "proxy_error" and "EMAIL" not in got["html"]
    assert texts(got["failed"].removesuffix(FAILED)) == {0: "Dear [EMA"} and got["failed"].endswith(FAILED)
    assert json.loads(got["failed body"])["error"]["message"].startswith("the upstream failed")
    assert got["failed plain"] == "data: {\n\n" + FAILED
    assert texts(got["no end"]) == {0: "Dear [EMAIL_1"}
    assert texts(got["no type"]) == texts(got["TYPE"]) == {0: "Dear kim@post.example, ", 1: 'é K "x" Lee'}


def test_stream_equals_the_recorded_table_and_keeps_no_state(spark, tmp_path):
    whole = [*pieces("a", OPENAI, [15, 40, 41, 90]), *pieces("b", ANTHROPIC, [60, 70, 71, 150], "anthropic"), *pieces("c", BODY, [3, 4, 9, 20], kind="application/json"), *pieces("d", OPENAI, [1, 2, 3, 50], failed=True)]
    batches = [[r for r in whole if r[1] == k] for k in range(5)]
    got, progress = stream(spark, tmp_path, batches)
    assert joined(got) == joined(replies.restore_recorded(spark.createDataFrame(whole, KIND)).collect())
    assert progress["stateOperators"][0]["numRowsTotal"] == 0


def test_an_abandoned_stream_is_flushed_by_its_timer(spark, tmp_path):
    """Event time: the watermark passes the idle time of streams that stopped; their held text goes out, state ends."""
    first = pieces("gone", delta("Dear [EMA"), [], end=False) + pieces("gone body", BODY, [], kind="application/json", end=False) + pieces("kept", delta("to [EMA"), [], end=False)
    more = [("kept", 1, delta("IL_1]").encode(), None, None, None, False, False, first[0][8].replace(year=first[0][8].year + 1))]
    late = [("kept", 2, b"data: [DONE]\n\n", None, None, None, True, False, more[0][8])]
    got, progress = stream(spark, tmp_path, [first, more, late], event_time="at", idle="10 minutes")
    got = joined(got)
    assert texts(got["gone"]) == {0: "Dear [EMA"}
    assert json.loads(got["gone body"])["choices"][0]["message"]["content"] == "to kim@post.example"
    assert texts(got["kept"]) in ({0: "to kim@post.example"}, {0: "to [EMAIL_1]"})
    assert progress["stateOperators"][0]["numRowsTotal"] == 0


def test_the_clock_flushes_too(spark, tmp_path):
    other = pieces("other", OPENAI, [])
    got, progress = stream(spark, tmp_path, [pieces("gone", delta("Dear [EMA"), [], end=False), other], idle="2 seconds", wait=4)
    assert texts(joined(got)["gone"]) == {0: "Dear [EMA"}
    assert progress["stateOperators"][0]["numRowsTotal"] == 0


def test_vaults_come_by_a_join(spark, tmp_path):
    vaults = spark.createDataFrame([("a", k, v) for k, v in VAULT.items()] + [("a", "[EMAIL_1]", "zzz"), ("other", "[EMAIL_1]", "no@x.org")], "stream_id string, placeholder string, original string")
    rows = [(*r[:5], None, *r[6:]) for r in pieces("a", OPENAI, [15, 40]) + pieces("none", OPENAI, [15, 40])]
    got, _ = stream(spark, tmp_path, [[r for r in rows if r[1] == k] for k in range(3)], vaults=vaults)
    got = joined(got)
    assert texts(got["a"]) == {0: "Dear kim@post.example, ", 1: 'é K "x" Lee'} and got["none"] == OPENAI


@pytest.mark.parametrize("schema", ["openai", "anthropic"])
def test_several_replies_under_one_id(spark, schema):
    data = OPENAI if schema == "openai" else ANTHROPIC
    rows = pieces("s", data, [10], schema)
    rows += [(r[0], r[1] + 10, *r[2:]) for r in pieces("s", data, [], schema)]
    got = joined(replies.restore_recorded(spark.createDataFrame(rows, KIND)).collect())["s"]
    assert got.count("kim@post.example" if schema == "openai" else 'K \\"x\\" Lee') == 2
