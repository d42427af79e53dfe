"""Every operator on nulls, empty and long texts, repeated rows, extra columns with clashing names and empty tables,
against brute force."""

import functools
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from veilspark.llm import common, decontaminate, graph, langid, licences, media, ngram_join, packing, pii, quality, suffix_dedup, token_ids
from veilspark.llm.words import SPACED, words as hashed

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, spans string, start long, digest string, key string"
rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
PASSAGE = " ".join(rng.choice(VOCABULARY) for _ in range(60))


def text(n, known=0):
    """n words of the vocabulary, or of `known` words apart from it."""
    return " ".join(f"w{rng.randrange(known)}" if known else rng.choice(VOCABULARY) for _ in range(n))


@functools.cache
def rows():
    base = text(200)
    words = base.split()
    near = " ".join(words[:50] + ["changed"] + words[51:])
    texts = [
        None, "", " ", "one", "one two", base, base, near, base.upper(), f"{text(30)} {PASSAGE} {text(20)}", f"{text(25)} {PASSAGE}",
        "ab " * 300, text(6000), "mail a@b.c-d.org; +1 (555) 123-4567; 10.0.0.255 card 4111-1111-1111-1111 key sk-abcdefghijklmnopqrstuv",
        "Released under the MIT License. MIT license; General Public License", "😀 é ñ 日本語 text", "x" * 5000, "a@b.c_d@e.f 1.2.3.4.5 300.1.1.1",
    ]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [out[5]]


@pytest.fixture(scope="module")
def docs(spark):
    r = rows()
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, "z", 7, "d", "k") for i, t in r], KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_token_ids_round_trip(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    token_ids.write(docs, str(tmp_path / "a"), path)
    got = sorted(token_ids.read(spark, str(tmp_path / "a"), with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r, (i, t) in zip(got, sorted(rows(), key=lambda x: x[0]), strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["ids"]) == (i, at, ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    token_ids.write(none, str(tmp_path / "b"), path)
    assert token_ids.read(spark, str(tmp_path / "b")).count() == 0


def test_coder_checkpoints_and_damage():
    ids = np.random.default_rng(1).zipf(1.3, 300_000).clip(0, 60_000).astype(np.uint16)
    coder = token_ids.Coder(token_ids.quantise(np.bincount(ids, minlength=1 << 16)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    per = 128 * 1024
    assert (coder.decode(block, 1, 2) == ids[per : 2 * per]).all()
    with pytest.raises(ValueError):
        coder.decode(block[:-1] + bytes([block[-1] ^ 1]))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    got = packing.pack(docs, path).toPandas()
    assert (got.groupby("doc_id").size().loc[5], got.length.max()) == (2, 2048)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length.to_numpy()) - g.length.to_numpy()).all() and g.length.sum() <= 2048
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)
    want = []
    for i, t in rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == sorted(want)
    assert packing.pack(none, path).count() == 0


def test_pieces_equal_the_tokenizer():
    """Any mixture of blanks, line ends, marks and other characters."""
    parts = ["a", "Word", "x1", "it's", ".", ",", "..", "é", "\u0301", "日本", "😀", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "<|endoftext|>", "'s", "²", "1,2.", "</w>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", " ", "\n", "a\n", "\na", "odd"]
    for name, lead in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own = common.Tokens(public_tokenizers.path(name), lead)
        assert [own.encode(texts[i : i + 300]) for i in range(0, len(texts), 300)] == [own.whole(texts[i : i + 300]) for i in range(0, len(texts), 300)]


def test_minimum_bin_slack_fills_bins():
    counts = {1000: 3, 1048: 3, 700: 4, 648: 2, 5: 10}
    bins = packing.combinations(counts)
    used = {}
    for times, combo in bins:
        assert sum(n * m for n, m in combo.items()) <= 2048
        for n, m in combo.items():
            used[n] = used.get(n, 0) + n * 0 + m * times
    assert used == counts and sum(t for t, _ in bins) == 6


def test_quality_fit_holds_the_rows_once():
    """The fit makes no second copy of its sample, and takes it in batches of any size and order."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(1)
    y, feats = np.arange(600) % 2, [np.unique(r.integers(0, 4096, 2000)).astype(np.int32) for _ in range(600)]
    tracemalloc.start()
    try:
        quality.fit(y, feats, 4096)
        assert tracemalloc.get_traced_memory()[1] < sum(f.nbytes for f in feats) / 2
    finally:
        tracemalloc.stop()
    sample = [(i, int(y[i]), feats[i].tobytes()) for i in range(40)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "y", "x"])
    once = [b.to_pydict() for b in quality.learn([batch(sample)])]
    assert once == [b.to_pydict() for b in quality.learn(batch(sample[::-1][i : i + 7] + sample[:3]) for i in range(0, 40, 7))]
    assert list(quality.learn([])) == []


def test_tokens_are_forgotten(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    common.Tokens.get(path, False)
    common.Tokens.forget(path, False)
    assert (path, False) not in common.Tokens._of
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kept, dropped = (sorted(map(tuple, packing.pieces(docs, path, keep=k).select(columns).collect()), key=str) for k in (True, False))
    assert kept == dropped


def test_quality(spark, docs, none):
    good = [(i, text(60)) for i in range(300)]
    bad = [(i + 300, " ".join(f"{w}&&&" for w in text(60).split())) for i in range(300)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i < 300)) for i in range(600)] + [(1, None), (9999, 1)], "doc_id long, quality int")
    w = quality.train(d, y)
    p = quality.score(d, w).toPandas()
    held = p[[zlib.crc32(str(i).encode()) % 3 == 1 for i in p.doc_id]]
    assert ((held.score >= 0.5) == (held.doc_id < 300)).mean() > 0.97
    assert quality.score(docs, w).count() == len(rows()) and quality.keep_good(docs, w).columns == docs.columns
    assert quality.score(none, w).count() == 0
    assert set(quality.score(docs, quality.train(d, y.filter("quality = 1"))).toPandas().score) == {0.5}


def test_fit_equals_a_plain_solver(monkeypatch):
    """Dual coordinate descent against projected gradient steps on the dense dual problem."""
    monkeypatch.setattr(quality, "EPOCHS", 5000)
    r = np.random.default_rng(4)
    y, feats = np.arange(30) % 2, [np.sort(r.choice(12, int(r.integers(1, 7)), replace=False)) for _ in range(30)]
    got = quality.fit(y, feats, 12)
    counts = np.ones((2, 12))
    for t, f in zip(y, feats):
        counts[t, f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((30, 13))
    for k, f in enumerate(feats):
        x[k, f] = ratio[f] / np.sqrt(len(f))
        x[k, 12] = 1
    sign = np.where(y == 1, 1.0, -1.0)
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha = np.zeros(30)
    for _ in range(100_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, quality.COST)
    w = (alpha * sign) @ x
    mixed = (1 - quality.BETA) * np.abs(w[:-1]).mean() + quality.BETA * w[:-1]
    assert np.allclose(got[:-1], mixed * ratio, atol=5e-3) and abs(got[-1] - quality.BETA * w[-1]) < 5e-3


def test_a_score_of_a_half_is_good(docs):
    """Without training rows all weights are 0 and all scores 0.5: label 1 by the contract, so that all rows stay."""
    w = quality.fit(np.zeros(0), [])
    assert {r["score"] for r in quality.score(docs, w).collect()} == {0.5}
    assert quality.keep_good(docs, w).count() == len(rows())


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(docs, none, n, num, den):
    got = {}
    for r in ngram_join.join(docs, n, num, den).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    sets = {}
    for i, t in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert got == {i: {(len(sets[i]), root[i])} for i in sets}
    assert ngram_join.join(none, n, num, den).count() == 0
    kept = [r["doc_id"] for r in ngram_join.keep_one(docs, n, num, den).collect()]
    assert sorted(kept) == sorted(i for i in sets if root[i] == i)


def test_words_whose_sums_agree_stay_apart(spark):
    """A Thue-Morse word and its complement have equal polynomials modulo any power of two."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    for n in (8, 16, 64, 256, 1024):
        h = hashed([f"{one[:n]} {other[:n]} {one[:n]}"], SPACED)[0]
        assert h[0] == h[2] != h[1]
    d = spark.createDataFrame([(1, f"{one} x y"), (2, f"{other} x y"), (3, f"{one}\tX y")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(d, 3, 9, 10).collect()} == {1: 1, 2: 2, 3: 1}


def test_word_hashes_of_all_lengths():
    own = list({"".join(rng.choice("ab\0\1é") for _ in range(n)) for n in [*range(1, 40), 255, 256, 257, 300, 5000] for _ in range(40)})
    h = hashed([" ".join(own)], SPACED)[0]
    assert len(set(h.tolist())) == len(own) and [int(hashed([w], SPACED)[0][0]) for w in own] == h.tolist()
    assert [len(x) for x in hashed([None, "", " "], SPACED)[:3]] == [0, 0, 0] and len(hashed([], SPACED)[0]) == 0


def test_ngram_join_in_shards(docs, monkeypatch):
    whole = sorted(map(tuple, ngram_join.join(docs).collect()))
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 150)
    assert sorted(map(tuple, ngram_join.join(docs).collect())) == whole


def test_ngram_join_with_frequent_ngrams(spark, monkeypatch):
    base = text(120).split()
    d = [(i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(60)] + [(100 + i, f"{text(40)} {PASSAGE}") for i in range(50)]
    monkeypatch.setattr(ngram_join, "HOT", 8)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[100 + i] == 100 + i for i in range(50))


@pytest.mark.parametrize("n,num,den,most", [(3, 9, 10, 0), (5, 4, 5, 0), (3, 9, 10, 200_000)])
def test_frequent_ngrams_beyond_the_list_make_no_blocks(spark, monkeypatch, n, num, den, most):
    """Texts that share a frequent passage only are in no block, whether the list of frequent n-grams holds it or not; near
    copies that differ in a word, and short texts, of which all n-grams may be frequent, are linked as by brute force."""
    own = random.Random(9)
    word = lambda k: "".join(own.choice("abcdefgh") for _ in range(k))
    passage, base, short = [word(14) for _ in range(n + 3)], [word(6) for _ in range(90)], [word(7) for _ in range(14)]
    d = [[word(5) for _ in range(30)] + passage + [word(5) for _ in range(30)] for _ in range(40)]
    d += [base[:k] + [word(6)] + base[k + 1 :] for k in range(0, 90, 5)] + [base]
    d += [short[: 8 + k % 6] + [word(4)] * (k % 3 == 0) for k in range(30)] + [passage[:k] for k in range(1, len(passage))]
    sets = {i: {tuple(t[j : j + n]) for j in range(len(t) - n + 1)} if len(t) >= n else {tuple(t)} for i, t in enumerate(d)}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    monkeypatch.setattr(ngram_join, "HOT", 8)
    monkeypatch.setattr(ngram_join, "ORDER_LAST", most)
    blocks, join_blocks = [], ngram_join.join_blocks
    monkeypatch.setattr(ngram_join, "join_blocks", lambda docs, members, *rest: blocks.extend(members.collect()) or join_blocks(docs, members, *rest))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(d)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(table, n, num, den).collect()} == root
    assert not [r for r in blocks if r["rep"] < 40] and {r["rep"] for r in blocks} >= {40, 58}


def test_counting_frequent_ngrams_leaves_no_shuffle_files(spark):
    files = lambda: {f for f in str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")).split("|") if "/shuffle_" in f}
    d = spark.createDataFrame([(i, f"{text(40)} {PASSAGE}") for i in range(50)], "doc_id long, text string")
    before = files()
    assert len(ngram_join.frequent(d, 3, 9, 10)) > 0
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left


def test_texts_that_cannot_be_members_are_not_joined(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"t{i}") for i in [*range(-500, 2000), 1 << 62, None, 7]], "doc_id long, text string")
    members = spark.createDataFrame([(i,) for i in [-3, 0, 7, 7, 1999, 1 << 62]], "rep long")
    kept = [r["doc_id"] for r in ngram_join.may_be_among(texts, members).collect()]
    assert {-3, 0, 7, 1999, 1 << 62} <= set(kept) and kept.count(7) == 2 and len(kept) < 500
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 64)
    assert {-3, 0, 7, 1999, 1 << 62} <= {r["doc_id"] for r in ngram_join.may_be_among(texts, members).collect()}
    assert ngram_join.may_be_among(texts, members.filter("rep = 5")).count() == 0


def test_language(spark, docs, none):
    other = ["".join(rng.choice("nopqrstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    d = [(i, text(30), "aa") for i in range(90)] + [(100 + i, " ".join(rng.choice(other) for _ in range(30)), "bb") for i in range(90)]
    m = langid.train(spark.createDataFrame(d + [(999, text(5), None)], "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame(d, "doc_id long, text string, lang string"), m).toPandas().sort_values("doc_id")
    assert (got.lang_pred.tolist() == [x[2] for x in d]) and got.score.between(0, 1).all()
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, m).collect()}
    assert odd[0] == odd[1] == odd[2] == "und" and odd[5] in ("aa", "bb")
    assert langid.identify(none, m).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}


@pytest.mark.parametrize("documents", [19_200, 100])
def test_all_languages_are_learned(spark, monkeypatch, documents):
    monkeypatch.setattr(langid, "DOCUMENTS", documents, raising=False)
    own = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for _ in range(70)]
    d = [(k * 100 + i, " ".join(rng.choice(own[k]) for _ in range(30)), f"l{k:02}") for k in range(70) for i in range(9)]
    m = langid.train(spark.createDataFrame(d, "doc_id long, text string, lang string"))
    assert m.languages == [f"l{k:02}" for k in range(70)]
    assert np.mean([x == y for (x, _), (_, _, y) in zip(m.label([t for _, t, _ in d]), d)]) > 0.9


@pytest.mark.parametrize("letters", ["\u4e00\u5000", "\u0e01\u0e18", "az"])
def test_language_of_unspaced_text(letters):
    """Runs that differ only beyond their first 40 bytes and before their last 4."""
    sets = [[chr(ord(c) + (-k if c == "z" else k)) for k in range(10)] for c in letters]
    head, tail = letters[0] * 40, letters[0] * 4
    t = [(head + "".join(rng.choice(sets[k]) for _ in range(300)) + tail, "xy"[k]) for k in (0, 1) for _ in range(60)]
    m = langid.learn([x for x, _ in t[::2]], [y for _, y in t[::2]])
    assert [x for x, _ in m.label([x for x, _ in t[1::2]])] == [y for _, y in t[1::2]]
    assert "".join(langid.line_words(t[0][0])) == t[0][0]


def test_forward_backward_equals_all_paths():
    r = np.random.default_rng(2)
    emit, trans, size = r.normal(size=(3, 4, 3)), r.normal(size=(3, 3)), np.array([4, 1, 3])
    got, pairs = langid.forward_backward(emit, size, trans)
    marginal, want = np.zeros((3, 4, 3)), np.zeros((3, 3))
    for c, n in enumerate(size):
        paths = list(itertools.product(range(3), repeat=int(n)))
        p = np.exp([sum(emit[c, i, y] for i, y in enumerate(x)) + sum(trans[a, b] for a, b in zip(x, x[1:])) for x in paths])
        for x, q in zip(paths, p / p.sum()):
            for i, y in enumerate(x):
                marginal[c, i, y] += q
            for a, b in zip(x, x[1:]):
                want[a, b] += q
    assert np.allclose(got, marginal) and np.allclose(pairs, want)


def test_language_switches_within_a_line():
    r = random.Random(8)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 8)))
    line = lambda letters, n: [word(letters) for _ in range(n)]
    langs = {"aa": "abcdef", "bb": "uvwxyz"}
    texts = [(" ".join(line(x, 30)), k) for k, x in langs.items() for _ in range(60)]
    model = langid.learn([t for t, _ in texts], [k for _, k in texts])
    own = line("abcdef", 12) + line("uvwxyz", 12)
    m, _ = langid.forward_backward(model.rows[model.numbers(own)][None] if model.numbers(own) is not None else None, np.array([24]), model.trans)
    assert m[0].argmax(axis=1).tolist() == [0] * 12 + [1] * 12
    assert model.trans[0, 0] > model.trans[0, 1] and np.isfinite(model.trans).all()
    assert model.label(["½ ² ₃ Ⅷ 12 _", "²abc", None])[0] == ("und", 0.0) and model.label(["²abc"])[0][0] == "aa"


def test_decontamination(spark, docs, none):
    words = PASSAGE.split()
    edited = " ".join(words[:20] + ["odd"] + words[21:40] + words[42:])
    b = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, edited), (5, text(50)), (6, "b c-d org")], "item_id long, text string")
    found = {}
    for r in decontaminate.find(docs, b).collect():
        found.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert found == {9: {1, 4}, 10: {1, 4}, 13: {6}}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, b).collect()) == sorted(i for i, _ in rows() if i not in found)
    assert decontaminate.find(docs, b, block_items=2).distinct().count() == 5 and decontaminate.find(none, b).count() == 0
    assert decontaminate.find(docs, b.limit(0)).count() == 0


def test_decontamination_recall():
    items = [(i, text(rng.randint(20, 60))) for i in range(150)]
    index, found = decontaminate.Index(items), 0
    for i, t in items:
        w = t.split()
        for _ in range(max(1, int(0.15 * len(w)) - 1)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([["zz"], [], [w[p], "yy"]])
        found += i in [x[0] for x in index.search([f"{text(10)} {' '.join(w)} {text(10)}"])[0]]
    assert found / len(items) >= decontaminate.RECALL


def edited(words, kind, n, even):
    """n edits of one kind, spread evenly or at random."""
    at = [(k + 1) * len(words) // (n + 1) for k in range(n)] if even else rng.sample(range(len(words)), n)
    for p in sorted(at, reverse=True):
        words[p : p + 1] = {"replaced": ["zz"], "deleted": [], "inserted": ["yy", words[p]]}[kind]
    return words


@pytest.mark.parametrize("even", [True, False])
@pytest.mark.parametrize("kind", ["replaced", "deleted", "inserted"])
@pytest.mark.parametrize("n", [20, 40, 60, 100, 200, 300])
def test_decontamination_recall_of_edits(n, kind, even):
    items = [(i, text(n)) for i in range(40)]
    found = decontaminate.Index(items).search([f"{text(10)} {' '.join(edited(t.split(), kind, int(0.15 * n), even))} {text(10)}" for _, t in items])
    assert sum(i in [x[0] for x in f] for (i, _), f in zip(items, found)) / len(items) >= decontaminate.RECALL


@pytest.mark.parametrize("n", range(5, 20))
def test_decontamination_finds_all_short_items(n):
    """Every place and kind of as many edits as an item may have."""
    items, most = [(i, text(n)) for i in range(12)], int(decontaminate.SHARE * n)
    index = decontaminate.Index(items)
    for kind in ("replaced", "deleted", "inserted"):
        for even in (True, False):
            found = index.search([f"{text(10)} {' '.join(edited(t.split(), kind, most, even))} {text(10)}" for _, t in items])
            assert all(i in [x[0] for x in f] for (i, _), f in zip(items, found))
        if most == 1:
            for i, t in items:
                w = t.split()
                one = [" ".join(w[:p] + {"replaced": ["zz"], "deleted": [], "inserted": ["yy", w[p]]}[kind] + w[p + 1 :]) for p in range(n)]
                assert all(i in [x[0] for x in f] for f in index.search([*one, *(f"{text(5)} {x} {text(5)}" for x in one)]))


def fewest_edits(item, own):
    """Edits that turn the item into some part of the words, by the whole table."""
    row = [0] * (len(own) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(own):
            new.append(min(row[j + 1] + 1, row[j] + (x != w), new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("known", [6, 3000])
def test_decontamination_equals_brute_force(known):
    """Every document against every item: the items found are those within the limit, with their fewest edits."""
    items, docs = [(i, text(rng.choice([3, 7, 12, 19, 20, 25, 40, 80]), known)) for i in range(30)], [""]
    for _, t in items:
        w = t.split()
        for _ in range(rng.randint(0, len(w) // 4 + 1)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([["zz"], [w[p], "yy"]])
        docs.append(" ".join([text(rng.randint(1, 30), known), *w, text(rng.randint(1, 30), known)]))
    true = {(d, i, e) for d, x in enumerate(docs) for i, t in items if (e := fewest_edits(t.split(), x.split())) <= int(decontaminate.SHARE * len(t.split()))}
    found = {(d, i, e) for d, f in enumerate(decontaminate.Index(items).search(docs)) for i, e, _ in f}
    assert found <= true and len(found) >= decontaminate.RECALL * len(true) and len(true) > 15


def test_decontamination_of_long_items():
    """Thousands of words, edited and not, in many documents: in a band, and not at all where the words aren't there."""
    t = text(2000, 3000)
    near = " ".join(edited(t.split(), "replaced", 300, False))
    began = time.time()
    found = decontaminate.Index([(1, t)]).search([f"{text(50)} {near} {text(50)}", t, text(3000, 3000), None] * 8)
    assert [[x[:2] for x in f] for f in found] == [[(1, 300)], [(1, 0)], [], []] * 8 and time.time() - began < 20


def brute_removed(texts):
    seen, out = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, f in zip(b, cover) if not f)
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, none):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove(docs).collect()}
    assert got == brute_removed(rows()[:-1])
    assert suffix_dedup.remove(none).count() == 0


@pytest.mark.parametrize("wide,local", [(20_000, 4096), (2, 4096), (20_000, 2)])
def test_suffix_dedup_of_hot_anchors(spark, wide, local):
    """A line that most texts hold between others, near copies and long runs; with few surroundings per task allowed."""
    line = "a line of some fifty bytes that stands in most texts "
    texts = [f"{text(rng.randint(1, 30))} {line * rng.randint(0, 3)}{text(rng.randint(0, 30))}" for _ in range(150)]
    texts += [t[rng.randint(0, 40) :] for t in texts[:40]] + ["x" * 700, "x" * 99, None, "é" * 300]
    texts = list(enumerate(texts))
    d = spark.createDataFrame(texts + [(None, texts[0][1]), (None, None)], "doc_id long, text string")
    got = suffix_dedup.remove(d, wide, local).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == brute_removed(texts)
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got if r["doc_id"] is None) == [(0, 0), (len(texts[0][1].encode()), 0)]


def test_anchors_of_slices(monkeypatch):
    """A text of several slices has the anchors of the whole."""
    data = [text(2000).encode(), b"", b"x" * 99, b"y" * 3000, text(700).encode()]
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "SLICE", 997)
    cut = suffix_dedup.anchors(data)
    assert set(map(tuple, whole.T.tolist())) == set(map(tuple, cut.T.tolist())) and cut.shape == whole.shape


def test_suffix_levels_merge():
    levels, data = suffix_dedup.Levels(), np.array([b"%0100d" % (k * 7 % 50) for k in range(200)], dtype="S100")
    hit = np.concatenate([levels.add(data[i : i + 20], np.zeros(20, int), np.arange(i, i + 20)) for i in range(0, 200, 20)])
    seen = set()
    assert hit.tolist() == [k in seen or bool(seen.add(k)) for k in data.tolist()]
    assert len(levels.levels) <= 4


def test_pii(docs, none):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert got[13]["spans"] == "email:5:16,ip:37:47,card:53:72,phone:18:35,secret:77:102"
    assert got[17]["spans"] == "email:0:5,email:5:11,ip:12:19"
    assert (got[0]["spans"], got[0]["n_email"], got[0]["base_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())
    back = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert back[13] == "mail [EMAIL]; [PHONE]; [IP] card [CARD] key [SECRET]" and back[0] is None and back[5] == rows()[5][1]
    assert pii.redact(docs).columns == docs.columns and pii.find(none).count() == 0


def brute_base(t):
    """The contract's base kinds with another engine's expressions."""
    out = []
    luhn = lambda d: sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(x) <= 255 for x in h.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= len(re.sub("[^0-9]", "", h)) <= 19 and luhn(re.sub("[^0-9]", "", h))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= len(re.sub("[^0-9]", "", h)) <= 15),
    }
    for kind, (p, ok) in rules.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])]
    return out


def test_pii_equals_brute_force(spark):
    parts = ["a@b.org", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 151 1234567", "+1 (2", "é😀", ".", "-", " ", "x", "12", "_", "%", "a.b", "iban "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)] + [" ".join(f"u{k}@m.example 1.1.1.{k % 300}" for k in range(700)), None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(d).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")]
    back = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        spans = [x.split(":") for x in got[i]["spans"].split(",")] if got[i]["spans"] else []
        for kind, a, b in sorted(spans, key=lambda x: (int(x[1]), -int(x[2]))):
            if int(a) >= at:
                want += t[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert back[i] == (None if t is None else want + t[at:])


def test_pii_takes_time_in_proportion(spark):
    t = " ".join(f"u{k}@m{k % 97}.example" for k in range(30_000))
    d = spark.createDataFrame([(1, t), (2, "a" * 3_000_000), (3, "1" * 3_000_000)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["n_email"] for r in pii.find(d).collect()}
    pii.redact(d).write.format("noop").mode("overwrite").save()
    assert got == {1: 30_000, 2: 0, 3: 0} and time.time() - began < 60


def test_pii_checksums(spark):
    t = ["IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE89 3704 0044 0532 0130 01.", "ssn 123-45-6789", "version 666-45-6789", "1" * 4000]
    got = [r["spans"] for r in pii.find(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "", "ssn:4:15", "", ""]


def test_pii_ibans_of_each_length(spark):
    """Every country's length, with and without blanks, before an upper-case word, before another one; one character less or more is none."""
    def iban(country, n):
        own = "".join(rng.choice("0123456789") for _ in range(n - 4))
        value = int(own + "".join(str(ord(c) - 55) for c in country) + "00")
        return f"{country}{98 - value % 97:02d}{own}"

    grouped = lambda x: " ".join(x[k : k + 4] for k in range(0, len(x), 4))
    t, want = [], []
    for n, countries in pii.IBAN.items():
        for c in countries.split("|"):
            x = iban(c, n)
            for form in (x, grouped(x)):
                t += [f"{form} BANK", f"to {form}, {form}.", f"{form}7", f"A{form}", form[:-1]]
                k = len(form)
                want += [f"iban:0:{k}", f"iban:3:{k + 3},iban:{k + 5}:{2 * k + 5}", "", "", ""]
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("iban")] for r in pii.find(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    assert [",".join(got[k]) for k in range(len(t))] == want


def test_pii_context_on_both_sides(spark):
    key, far = "0123456789abcdef0123456789abcdef01234567", "x" * 60
    t = [f"api token {key}", f"{key} is the token", f"{key} {far} token", key, f"{key} a@b.org password", "123-45-6789 invoice", "invoice 123-45-6789", f"{key} {key} key"]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    want = ["secret:10:50", "secret:0:40", "", "", "email:41:48,secret:0:40", "ssn:0:11", "", "secret:41:81"]
    assert [got[k] for k in range(len(t))] == want


def test_licences(docs, none):
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert [(x["word"], x["label"]) for x in got[14]["base"]] == [(3, "mit"), (5, "mit"), (7, "gpl")]
    assert [x["label"] for x in got[14]["spans"]] == ["mit-notice"] and got[0]["n_words"] == 0 and got[13]["base"] == []
    assert licences.scan(none).count() == 0


def test_licence_chains_follow_the_template():
    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES)
    for t in ("permission is hereby granted " * 10, "to deal in the software " * 7, "to any person obtaining a copy x " * 9):
        assert scanner.scan(t)[2] == []
    grant = licences.TEMPLATES["mit"][0].split()
    halves = " ".join(grant[len(grant) // 2 :] + grant[: len(grant) // 2])
    assert all(x[3] < 1 for x in scanner.scan(halves)[2])
    for label, t in licences.TEMPLATES.items():
        for part in [t] if isinstance(t, str) else t:
            assert (label, 2, 2 + len(part.split()), 1.0) in scanner.scan(f"zz zz {part} zz")[2]


def test_licence_base_equals_brute_force():
    scanner, words = licences.Scanner(licences.TEMPLATES, licences.PHRASES), ["MIT", "mit", "License", "apache", "General", "public", "licens\u00e9", "zz", "the"]
    for _ in range(2000):
        t = "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "", " . "]) for _ in range(rng.randint(0, 12)))
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        want = sorted((i, label) for p, label in licences.PHRASES.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split())
        n, places, _ = scanner.scan(t)
        assert (n, places) == (len(own), want)


def test_automaton_statistics():
    seqs = [[rng.randrange(4) for _ in range(30)] for _ in range(3)]
    auto, probe = licences.Automaton(seqs), [rng.randrange(5) for _ in range(300)]
    runs = {tuple(s[i:j]) for s in seqs for i in range(30) for j in range(i + 1, 31)}
    for end, n, state in auto.statistics(probe):
        assert tuple(probe[end - n + 1 : end + 1]) in runs and tuple(probe[end - n : end + 1]) not in runs
        own = tuple(probe[end - n + 1 : end + 1])
        assert auto.members[state] == {k for k, s in enumerate(seqs) if any(tuple(s[i : i + n]) == own for i in range(30))}


def test_licence_templates_next_to_words_of_others():
    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES)
    short = [(label, t) for label, ts in licences.TEMPLATES.items() for t in ([ts] if isinstance(ts, str) else ts) if len(t.split()) < 60]
    for label, t in short:
        for w in [x.decode() for x in scanner.code] + ["zz"]:
            for doc in (f"{t} {w}", f"{w} {t}", f"zz {w} {t} {w} zz"):
                assert [x for x in scanner.scan(doc)[2] if x[0] == label and x[3] == 1.0], (label, doc)


def test_automaton_matches_of_each_template():
    seqs = [[rng.randrange(4) for _ in range(n)] for n in (8, 20, 30)]
    auto, probe = licences.Automaton(seqs), [rng.randrange(5) for _ in range(400)]
    for least in (1, 3):
        want = []
        for k, s in enumerate(seqs):
            runs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}
            longest = [max(n for n in range(e + 2) if tuple(probe[e + 1 - n : e + 1]) in runs) for e in range(len(probe))]
            want += [(e, n, k) for e, n in enumerate(longest) if n >= least and (e + 1 == len(probe) or tuple(probe[e + 1 - n : e + 2]) not in runs)]
        assert sorted(auto.matches(probe, least)) == sorted(want)


def test_media_copies(spark):
    draw = lambda n: "<p>" + "</p><p>".join(text(rng.randint(30, 60)) for _ in range(n)) + "</p>"
    a, b = draw(12), draw(12)
    crop = "<p>" + text(25) + "</p>" + a[a.index("</p>") + 4 :]
    pages = [(0, a), (1, a), (2, crop), (3, b), (4, None), (5, ""), (6, draw(12)), (0, a)]
    d = spark.createDataFrame([(i, h, 1, "x") for i, h in pages], "page_id long, html string, n_links int, digest string")
    got = {r["id"]: r["component_id"] for r in media.copies(media.describe(d, media.draw, "page_id", "html")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}
    last = media.copies(media.describe(spark.createDataFrame([(None, a), (None, a), (7, b)], "page_id long, html string"), media.draw, "page_id", "html")).collect()
    assert sorted(str(r["component_id"]) for r in last) == ["7", "None", "None"]
    assert media.copies(media.describe(d.limit(0), media.draw, "page_id", "html")).count() == 0


def brute_components(images: dict) -> dict:
    """Smallest reachable id, all pairs compared."""
    at = {i: i for i in images}
    pairs = [(a, b) for a in images for b in images if a < b]
    linked = [p for p, ok in zip(pairs, media.consensus([(images[a], images[b]) for a, b in pairs])) if ok]
    for _ in images:
        for a, b in linked:
            at[a] = at[b] = min(at[a], at[b])
    return at


@pytest.mark.parametrize("hot", [2, 5, 32])
def test_media_large_buckets(spark, monkeypatch, hot):
    """Common details, as in page headers, and groups of near copies: as if all pairs were compared."""
    monkeypatch.setattr(media, "HOT", hot)
    r = np.random.default_rng(3)
    common_ = np.concatenate([np.arange(5)[:, None] * 40, np.full((5, 2), 3), r.integers(0, 1 << 32, (5, media.BANDS))], axis=1)
    common_[:, 2] = 0
    images = {}
    for group in range(6):
        own = np.concatenate([r.integers(0, 900, (14, 2)), np.zeros((14, 1), int), r.integers(0, 1 << 32, (14, media.BANDS))], axis=1)
        for k in range(6):
            part = own[r.permutation(14)[: int(r.integers(2, 14))]]
            t = np.concatenate([common_[: int(r.integers(1, 4))] if group else common_, part])
            images[group * 10 + k] = t.astype("<u4").tobytes()
    d = spark.createDataFrame([(i, bytearray(p)) for i, p in images.items()], "rep long, points binary")
    got = {i: i for i in images} | {x["node"]: x["root"] for x in graph.components(media.links(d)).collect()}
    assert got == brute_components(images)


def test_media_recall():
    """Crops and edits of drawn pages with at least 20 lines."""
    images = [media.draw("<p>" + "</p><p>".join(text(rng.randint(30, 60)) for _ in range(rng.randint(8, 20))) + "</p>") for _ in range(40)]
    r = np.random.default_rng(6)

    def logo(i):
        j, (y, x) = i.copy(), (int(r.integers(0, i.shape[0] - 16)), int(r.integers(0, 96)))
        j[y : y + 16, x : x + 32] = 90
        return j

    edits = {"rows": lambda i: i[i.shape[0] // 4 :], "columns": lambda i: i[:, 20:], "odd": lambda i: i[3:-2, 5:-6], "logo": logo, "darker": lambda i: (i.astype(int) * 9 // 10).astype(np.uint8)}
    own = [media.keypoints(i).tobytes() for i in images]
    for name, edit in edits.items():
        found = media.consensus([(a, media.keypoints(edit(i)).tobytes()) for a, i in zip(own, images)])
        assert found.mean() >= 0.9, name
    assert not media.consensus(list(zip(own, own[1:] + own[:1]))).any()


def test_unfinished_components_are_an_error(spark):
    d = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    assert {tuple(r) for r in graph.components(d).collect()} == {(k, 0) for k in range(31)}
    with pytest.raises(RuntimeError):
        graph.components(d, most_rounds=1)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] > 0
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} and docs.filter("offset + length > 2048").count() == 0


def test_pipeline_stages_on_odd_rows(spark, docs, none):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table through every stage."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        assert stage(spark, none, d).count() == 0
        if k < 4:
            assert out.columns == docs.columns
        assert out.count() > 0


def test_null_ids(spark, tmp_path):
    r = [(None, "one two three four five six"), (None, "one two three four five six"), (3, "one two three four five six"), (4, None)]
    d = spark.createDataFrame(r, "doc_id long, text string")
    got = sorted((str(x["doc_id"]), str(x["component_id"])) for x in ngram_join.join(d, 3, 9, 10).collect())
    assert got == [("3", "3"), ("4", "4"), ("None", "None"), ("None", "None")]
    token_ids.write(d, str(tmp_path / "n"), public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(str(x["doc_id"]) for x in token_ids.read(spark, str(tmp_path / "n")).collect()) == ["3", "4", "None", "None"]
