"""Rows that must not stop a job, values that must not stay in clear, and detectors that fail."""

import json
import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veilspark.functions import scan as S
from veilspark.functions import walks
from veilspark.operators import bodies, detectors, vault
from veilspark.streaming.events import Events

ALPHABET = "AZaz09 +-./()[]_@:{}\"\\,é日🙂\u00a0\u3000\t\n" + "0123456789" * 3


@pytest.mark.parametrize("seed", range(4))
def test_stretches_hold_every_match(seed):
    """What a recogniser finds around digits is what it finds in the whole text."""
    r = random.Random(seed)
    gaps = [" ", "  ", "    ", "\u00a0", "-", " - ", "", "(", ")", "/"]
    recognisers = [*S.NUMERIC, *S.domestic(["de", "it", "fr", "es", "gb", "nl"])]
    texts = ["BE68" + "    5390" * 2 + "    BANK" * 5 + "    XYZ and more", "x" * 70 + "GB29" + "    NWBK" * 7 + "    AB"]
    for _ in range(120):
        parts = [r.choice(["BE68", "DE89", "5390", "BANK", "ab", "+44", "0", "12", "123", "4567", "89012345", "X", "RSSMRA", "80A01", "H501U", "AB", "word", "x" * 70]) for _ in range(r.randint(1, 25))]
        texts.append("".join(p + r.choice(gaps) for p in parts))
    for t in texts:
        for x in recognisers:
            whole = S.spans_of(x, t, [(0, len(t))], S.Budget(float("inf")))
            assert S.spans_of(x, t, list(S.areas(t, x.reach)), S.Budget(float("inf"))) == whole, (x.name, t)


def test_skipped_recognisers_would_find_nothing():
    """What scan() leaves out for want of digits in a row, or of a sign, has no match."""
    r = random.Random(12)
    made = {"iban": "GB29NWBK60161331926819", "card": "4111 1111 1111 1111", "phone_cc": "+31 20 624 1111", "phone_us": "(212) 555-0147", "ssn": "219-09-9999", "it_cf": "RSSMRA80A01H501U", "gb_nino": "AB 12 34 56 C", "es_dni": "12345678Z"}
    for _ in range(600):
        parts = [r.choice([*made.values(), "12", "123", "4567", "89012", "678901", "+", "-", "x", "1234567", "99999999", "123456789", "12345678901", "123456-12345"]) for _ in range(r.randint(1, 6))]
        t = r.choice([" ", "-", ""]).join(parts)
        longest = max((len(d) for d in re.findall(r"\d+", t)), default=0)
        for x in [*S.NUMERIC, *S.domestic([])]:
            if x.run > longest or x.sign not in t:
                assert not x.pattern.search(t), (x.name, t)
    for name, value in made.items():
        assert any(s[3] == value for s in S.scan(value, [name])), name


def test_a_long_grouped_iban_is_masked_to_its_end():
    t = "BE68" + "    5390" + "    BANK" * 6 + "    XYZ"
    assert [s[1:3] for s in S.scan(t, ["iban"])] == [(0, len(t))]
    v = S.Vault()
    assert S.mask(t, v, S.Budget()) == "[IBAN_1]"


def test_random_bodies_never_raise(spark):
    r = random.Random(7)
    odd = ["\\ud800", "\\udc00x", "1e400", "[EMAIL_" + "9" * 5000 + "]", "-1e999", "\\u0000", "[PHONE_1]", "a@b.org", "NaN"]

    def leaf():
        return r.choice([*map(json.dumps, ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 12)))]), f'"{r.choice(odd[:2])}"', f'"{r.choice(odd[3:8])}"', r.choice(["1e400", "17", "null", "true", "[]"])])

    def body():
        if r.random() < 0.2:
            return "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40)))
        more = f',"content":{leaf()}' if r.random() < 0.1 else ""
        return f'{{"messages":[{{"role":"user","content":{leaf()}{more}}},{{"content":[{{"type":"text","text":{leaf()}}},{leaf()}]}}],"n":{leaf()}}}'

    rows = [(k, body()) for k in range(10_000)] + [(-1, None)]
    d = spark.createDataFrame(rows, "request_id long, body string").repartition(4)
    for kind in ("openai", "anthropic"):
        got = d.select("request_id", "body", bodies.masked(F.col("body"), kind, notice=False).alias("m"), bodies.texts(F.col("body"), kind).alias("t"), bodies.restored(F.col("body"), F.create_map(F.lit("[EMAIL_1]"), F.lit("x@y.org")), kind).alias("r")).collect()
        assert len(got) == len(rows)
        for x in got:
            assert (x["m"]["status"] == "ok") == (x["m"]["body"] is not None)
            if x["m"]["body"] is not None:
                json.loads(x["m"]["body"], parse_constant=lambda c: pytest.fail(c))
        assert {s["m"]["status"] for s in got} >= {"ok", "blocked: no JSON", "blocked: half of a surrogate pair", "blocked: a number beyond the range of a double", "blocked: a key occurs twice in one object"}


def test_huge_tokens_in_a_text(spark):
    t = "[EMAIL_" + "9" * 5000 + "] a@b.org [email 1] [EMAIL_01]"
    got = vault.mask(spark.createDataFrame([(t,)], "text string")).first()
    assert got["masked"] == t.replace("a@b.org", "[EMAIL_2]") and got["vault"] == {"[EMAIL_2]": "a@b.org"}
    back = spark.createDataFrame([(got["masked"], got["vault"])], "m string, v map<string,string>")
    assert back.select(vault.demask(F.col("m"), F.col("v")).alias("t")).first()["t"] == t


def test_odd_events_pass():
    v = {"[EMAIL_1]": "x@y.org"}
    for data, want in [
        ('{"choices":[{"delta":{"content":"\\ud800 [EMAIL_1]"}}]}', '{"choices":[{"delta":{"content":"\\ud800 x@y.org"}}]}'),
        ('{"choices":[{"delta":{"content":"[EMAIL_1]"}}],"n":1e400}', '{"choices":[{"delta":{"content":"[EMAIL_1]"}}],"n":1e400}'),
    ]:
        e = Events("openai", v)
        assert (e.push(f"data: {data}\n".encode()) + e.flush()).decode() == f"data: {want}\n"


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"messages":[{"content":"x","content":"y"}]}'])
def test_a_key_twice_is_refused(text):
    with pytest.raises(S.Blocked):
        walks.load(text)


# --- budgets and detectors


def test_a_spent_budget_blocks_even_when_it_sufficed():
    one = "call +31 20 624 1111 now"
    for units, ok in [(2, True), (1.5, True), (1, False), (0.5, False), (0, False)]:
        budget = S.Budget(units)
        try:
            found = S.scan(one, budget=budget)
            assert ok and len(found) >= 1
        except S.Exhausted as e:
            assert not ok and str(e).startswith("budget exhausted")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


class Words:
    """Finds given words; counts what it is asked."""

    def __init__(self, name, pattern, fails=None):
        self.name, self.pattern, self.fails, self.asked = name, pattern, fails, 0

    def detect(self, text, budget):
        self.asked += 1
        if self.fails:
            raise self.fails
        return [("PERSON" if self.name != "org" else "ORG", m.start(), m.end(), m[0], False) for m in re.finditer(self.pattern, text)]

    def redetect(self, text, budget):
        return []


def body(text):
    return json.dumps({"messages": [{"role": "user", "content": text}]})


def run(spark, text, chain, **more):
    d = spark.createDataFrame([(body(t),) for t in ([text] if isinstance(text, str) else text)], "body string").coalesce(1)
    return [r for r in d.select(bodies.masked(F.col("body"), "openai", notice=False, chain=chain, **more).alias("m")).select("m.*").collect()]


def content(row):
    return json.loads(row["body"])["messages"][0]["content"]


def test_two_detectors_and_a_failing_third(spark):
    people, firms = Words("people", "Kim( Lee)?"), Words("org", "Lee Works|Kim")
    broken = Words("broken", "", detectors.Unavailable("no weights"))
    text = "Kim Lee of Lee Works, kim@works.example, Kim"
    chain = detectors.Chain([detectors.Structured(), people, firms, detectors.FailOpen(broken)])
    got = run(spark, text, chain)[0]
    assert content(got) == "[PERSON_1] of [ORG_1], [EMAIL_1], [PERSON_2]" and got["failures"] == {"broken": 1}
    got = run(spark, text, detectors.Chain([detectors.Structured(), people, broken]))[0]
    assert got["status"] == "blocked: a detector failed" and got["body"] is None and got["vault"] == {}


def test_spent_validations_block_even_if_the_detector_may_fail(spark):
    spent = Words("spent", "", S.Exhausted("budget exhausted"))
    got = run(spark, "nothing", detectors.Chain([detectors.Structured(), detectors.FailOpen(spent)]))[0]
    assert got["status"] == "blocked: budget exhausted" and got["body"] is None
    structured = detectors.Chain([detectors.FailOpen(detectors.Structured())])
    assert run(spark, "+31 20 624 1111", structured, units=1)[0]["status"] == "blocked: budget exhausted, most by PHONE"
    assert content(run(spark, "+31 20 624 1111", structured, units=2)[0]) == "[PHONE_1]"


def test_one_budget_for_all_fields_and_detectors(spark):
    numbers = [f"+31 20 624 11{k:02d}" for k in range(4)]
    both = detectors.Chain([detectors.Structured(), detectors.Structured(["phone_cc"])])
    assert run(spark, " and ".join(numbers[:2]), both, units=4)[0]["status"].startswith("blocked: budget exhausted")
    assert run(spark, " and ".join(numbers[:2]), both, units=5)[0]["status"] == "ok"


def test_cache_asks_once_and_keeps_no_failure():
    inner = Words("people", "Kim")
    cached = detectors.Cached(inner, 2)
    texts = [f"Kim {k} " + "x" * 300 for k in range(6)]
    for t in [texts[0], texts[0], texts[1], texts[2], texts[0], texts[3], texts[0]]:
        assert cached.detect(t, S.Budget()) == Words("people", "Kim").detect(t, None)
    assert inner.asked == 4 and cached.hits == 3  # the first text moves into the newer generation whenever it is met
    for t in texts[4:] + [texts[1]]:
        cached.detect(t, S.Budget())
    assert inner.asked == 7 and len(cached.new) + len(cached.old) <= 4
    for t in ("Kim", "Kim " + "x" * 140_000):  # too short, too long
        cached.detect(t, S.Budget()), cached.detect(t, S.Budget())
    assert inner.asked == 11
    inner.fails = ValueError("x")
    with pytest.raises(ValueError):
        cached.detect("Kim new " + "y" * 300, S.Budget())
    inner.fails = None
    assert cached.detect("Kim new " + "y" * 300, S.Budget()) == [("PERSON", 0, 3, "Kim", False)]


def test_a_cached_text_charges_once(spark):
    long = "+31 20 624 1111 " + "x" * 300
    chain = detectors.build(cache=4)
    rows = run(spark, [long, long], chain)
    assert [r["units"] for r in rows] == [{"PHONE": 1.0}, {}] and content(rows[0]) == content(rows[1])


def test_equal_hashes_are_no_hit():
    class Same(str):
        def __hash__(self):
            return 7

    cached = detectors.Cached(Words("people", "Kim|Lee"), 4)
    a, b = Same("Kim " + "x" * 300), Same("Lee " + "y" * 300)
    assert cached.detect(a, None)[0][3] == "Kim" and cached.detect(b, None)[0][3] == "Lee"
