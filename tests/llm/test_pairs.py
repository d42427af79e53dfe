"""Hard negatives, SimHash classes and tokenizer alignment against brute force, on odd rows, ties and hot values."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from veilspark.llm import alignment, hard_negatives, simhash

rng = random.Random(11)
KIND = "doc_id long, text string, fp string, rep long, mask int, key string, n_a long, root string"
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts():
    base = text(120).split()
    near = [" ".join(base[:k] + [rng.choice(WORDS)] + base[k + 1 :]) for k in rng.sample(range(120), 40)]
    texts = [None, "", " ", "one", "one two", "One  TWO\tthree", "é È 日本 語 🙂", "a▁b", "<s> <|endoftext|> <0x0A>", "x\r\ny \r z", "\n\nfoo  bar \n", "\x00\x1c\x85 　x y", "y" * 4000, text(30_000)]
    return texts + near + [" ".join(base)] * 5


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(odd_texts()))
    rows += [rows[5], (3, "another text of one id"), (None, "one"), (None, None)]
    return spark.createDataFrame([(i, t, "f", 1, 2, "k", 3, "r") for i, t in rows], KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def classes(ids, linked):
    """The smallest id that links reach, by plain union."""
    up = list(range(len(ids)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            a, b = find(i), find(j)
            if a != b and linked(i, j):
                up[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [ids[find(k)] for k in range(len(ids))]


def brute_fingerprint(t, n=3):
    words = (t or "").encode().lower().split()
    grams = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("group,free", [(1024, 10), (4, 1)])
def test_simhash(docs, none, monkeypatch, group, free):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "FREE", free)
    got = simhash.near_duplicates(docs).collect()
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    known = [r for r in rows if r[0] is not None]
    want = Counter((i, f"{f:016x}", c) for (i, f), c in zip(known, classes([i for i, _ in known], lambda i, j: (known[i][1] ^ known[j][1]).bit_count() <= 2)))
    want += Counter((None, f"{f:016x}", None) for i, f in rows if i is None)
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("cells", [1 << 18, 7])
def test_bit_planes_find_all_near_pairs(monkeypatch, cells):
    monkeypatch.setattr(simhash, "CELLS", cells)
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.array([int(b) ^ sum({1 << int(k) for k in r.integers(0, 64, r.integers(0, 5))}) for b in base for _ in range(40)], dtype=np.uint64)
    last = np.repeat([1, 130, 200, 480], [1, 129, 70, 280])
    got = {(int(i), int(j)) for a, b in simhash.near(fps, last) for i, j in zip(a, b)}
    assert got == {(i, j) for i in range(480) for j in range(i + 1, int(last[i])) if int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_hot_groups_are_dealt_anew(spark, monkeypatch):
    """All fingerprints within three bits of one: every band is hot; links are those of comparing all pairs."""
    monkeypatch.setattr(simhash, "GROUP", 32)
    monkeypatch.setattr(simhash, "FREE", 4)
    r = random.Random(2)
    fps = sorted({0x123456789ABCDEF0 ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 3))) for _ in range(400)} | {r.getrandbits(64) for _ in range(200)})
    rows = spark.createDataFrame([(simhash.signed(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    got = simhash.components(simhash.similar(rows)).collect()
    root = {r["node"]: r["root"] for r in got}
    want = classes(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert [root.get(k, k) for k in range(len(fps))] == want


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    t = text(5000)
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "HASHES", 100)
    assert simhash.near_duplicates(docs).first()["fingerprint"] == f"{brute_fingerprint(t):016x}"


# --- hard negatives


def brute_negatives(rows, step=5, most=5, first=3):
    seen = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = np.floor(256 * np.array(v, dtype=float)).astype(int).tolist()
        if i not in seen or label < seen[i][0]:
            seen[i] = (label, q)
    out = set()
    for a, (label, q) in seen.items():
        if a % step:
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in seen.items()}
        order = sorted(seen, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and seen[i][0] == label][:most]:
            s = score[p]
            inside = [i for i in order if seen[i][0] != label and 50 * s <= 100 * score[i] <= 95 * s]
            out |= {(a, p, k + 1, i, s, score[i]) for k, i in enumerate(inside[:first])}
    return out


def odd_vectors():
    r = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    hot = [0.5, 0.5, 0.5, 0.5, 0.0, 0.0]
    rows = [(k, int(r.integers(0, 4)), [float(x) for x in np.float32(r.normal(size=6))]) for k in range(150)]
    rows += [(k, k % 2, hot) for k in range(150, 220)]  # a third is one vector: ties
    rows += [(220, None, hot), (221, 1, None), (225, 1, [nan] * 6), (226, 1, [inf, 0.0, 0.0]), (230, 1, [0.5, None]), (None, 1, hot)]
    return rows + [(235, 1, []), (240, 2, [0.75]), (245, 3, [0.0] * 6), (250, 9, hot), (255, 1, [-x for x in hot]), rows[0], (5, 9, hot)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, l, v, "s", 1, 2) for i, l, v in odd_vectors()], "vec_id long, label int, embedding array<float>, strip string, set int, k int")


@pytest.mark.parametrize("anchors,strip,tile", [(8192, 16384, 8192), (7, 20, 16)])
def test_hard_negatives(spark, points, monkeypatch, anchors, strip, tile):
    from pyspark.sql import functions as F

    for name, value in (("ANCHORS", anchors), ("STRIP", strip), ("TILE_ROWS", tile), ("TILE_ANCHORS", tile), ("STEP", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    got = [tuple(r) for r in hard_negatives.mine(hard_negatives.taken(points), F.col("vec_id") % 5 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(odd_vectors())
    assert hard_negatives.mine(hard_negatives.taken(points.limit(0)), F.col("vec_id") % 5 == 0).collect() == []


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_threshold_join_is_exact(monkeypatch, spread):
    """Integer vectors whose weight lies in few dimensions, some zero; thresholds of both signs."""
    for name, value in (("TILE_ROWS", 50), ("TILE_ANCHORS", 8), ("STEP", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(6)
    weight = np.exp(-spread * np.arange(20))
    q, y = (np.floor(256 * r.normal(size=(n, 20)) * weight) for n in (30, 200))
    q[3] = y[7] = 0
    score = (q @ y.T).astype(int)
    for floor in (np.quantile(score, 0.99, axis=1), np.quantile(score, 0.5, axis=1), np.full(30, -np.inf), np.zeros(30)):
        got = {(int(i), int(j), int(s)) for a, b, c in hard_negatives.threshold_join(q, floor, y) for i, j, s in zip(a, b, c)}
        assert got == {(i, j, int(score[i, j])) for i in range(30) for j in range(200) if score[i, j] >= floor[i]}


# --- tokenizer alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_tokens(t):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    pair = alignment.Pair.get(A, B)
    if not t:
        return [], []
    want, x, y = (" " + t).encode(), a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
    if b"".join(pair.a_bytes[i] for i in x) != want or b"".join(pair.b_bytes[i] for i in y) != want:
        return [], []
    return x, y


def spans(ids, names):
    end = np.cumsum([len(names[i]) for i in ids])
    return [(i, int(e) - len(names[i]), int(e)) for i, e in zip(ids, end)]


def brute_alignment(texts):
    pair, per = alignment.Pair.get(A, B), []
    for t in texts:
        x, y = brute_tokens(t)
        x, y = spans(x, pair.a_bytes), spans(y, pair.b_bytes)
        groups, lo = [], 0
        for cut in sorted({e for *_, e in x} & {e for *_, e in y}):
            groups.append(",".join(str(i) for i, _, e in x if lo < e <= cut) + "|" + ",".join(str(i) for i, _, e in y if lo < e <= cut))
            lo = cut
        j0, linked = 0, []
        for i, s, e in x:
            while j0 < len(y) and y[j0][2] <= s:
                j0 += 1
            k = j0
            while k < len(y) and y[k][1] < e:
                linked.append((i, y[k][0]))
                k += 1
        per.append((len(x), len(y), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(x for *_, linked, _ in per for x in linked)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [(n_a, n_b, g, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), said) for n_a, n_b, g, x, said in per]


@pytest.mark.parametrize("common,known", [(1 << 20, 500_000), (20, 10), (0, 0)])
def test_alignment(docs, none, monkeypatch, common, known):
    monkeypatch.setattr(alignment, "PIECES", known)
    short = docs.filter("coalesce(length(text), 0) < 20000")
    rows = short.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_alignment([r["text"] for r in rows])))
    assert Counter(tuple(r) for r in alignment.align(short, A, B, common).collect()) == want
    assert alignment.align(none, A, B, common).collect() == []


def test_pieces_equal_whole_texts():
    """What is remembered by piece adds up to what the whole text gives, for texts of mixed scripts, blanks and marks."""
    r, pair = random.Random(8), alignment.Pair.get(A, B)
    parts = ["word", "Ünï", "日本", "🙂", "12", "'s", "...", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "<s>", "x" * 60]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    got = pair.profiles(texts)
    pattern, pair.whole = pair.whole, lambda text: True
    try:
        want = pair.profiles(texts)
    finally:
        pair.whole = pattern
    assert got["said"] == want["said"] and all((got[k] == want[k]).all() for k in ("totals", "keys", "times", "at"))


def test_coalescing_expands_overlaps():
    group_a, group_b, i, j = alignment.coalesce(*(np.array(x) for x in ([2, 5, 6, 9], [2, 4, 6, 8, 9], [0, 2, 5, 6], [0, 2, 4, 6, 8])))
    assert group_a.tolist() == [0, 1, 1, 2] and group_b.tolist() == [0, 1, 1, 2, 2]
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (1, 1), (1, 2), (2, 2), (3, 3), (3, 4)]


# --- copies of images, by the number of a page's lines


@pytest.mark.parametrize("lines,rows,half_size", [(9, 0.5, 0.3), (12, 0.85, 0.65), (18, 0.95, 0.9), (26, 0.95, 0.95), (50, 0.95, 0.95), (100, 0.95, 0.95)])
def test_media_recall_by_size(lines, rows, half_size):
    """Noise of three grey levels, columns and rows cut off, and half the size: of drawn pages of so many lines."""
    from veilspark.llm import media

    r, images = np.random.default_rng(6), []
    while len(images) < 40:
        i = media.draw("<p>" + "</p><p>".join(text(rng.randint(30, 45)) for _ in range(max(1, lines // 2))) + "</p>")
        images.append(i[: 4 * lines])

    def half(i):
        i = i[: i.shape[0] // 2 * 2].astype(float)
        return np.rint((i[::2, ::2] + i[1::2, ::2] + i[::2, 1::2] + i[1::2, 1::2]) / 4).astype(np.uint8)

    edits = {"noise": lambda i: np.clip(np.rint(i + r.normal(0, 3, i.shape)), 0, 255).astype(np.uint8), "columns": lambda i: i[:, 20:], "rows": lambda i: i[i.shape[0] // 4 :], "half": half}
    own = [media.keypoints(i).tobytes() for i in images]
    for name, edit in edits.items():
        found = media.consensus([(a, media.keypoints(edit(i)).tobytes()) for a, i in zip(own, images)])
        assert found.mean() >= {"half": half_size, "rows": rows, "noise": 0.85, "columns": 0.95}[name], name
    assert not media.consensus(list(zip(own, own[1:] + own[:1]))).any()


def test_stacked_images_give_what_each_gives_alone(monkeypatch):
    """Images of all sizes searched together, in stacks of any height, have the key points of each alone."""
    from veilspark.llm import media

    r = np.random.default_rng(4)
    images = [None, *(r.integers(0, 256, (h, w)).astype(np.uint8) for w in (3, 4, 5, 9, 40) for h in (*range(1, 14), 31, 60))]
    images += [media.draw("<p>" + "</p><p>".join(text(n) for n in range(1, k)) + "</p>") for k in range(2, 25)]
    alone = [media.keypoints(i) for i in images]
    assert sum(len(t) > 3 for t in alone) > 20 and all(t.dtype == np.dtype("<u4") for t in alone)
    for rows in (1, 200, 100_000):
        monkeypatch.setattr(media, "STACK", rows)
        assert all(np.array_equal(a, b) for a, b in zip(alone, media.keypoints_of(images), strict=True))
    assert media.keypoints_of([]) == []


def made_images(groups, of_group, common, seed=3):
    """Images with `common` details at different places of each, and groups that share the rest of theirs with small shifts."""
    from veilspark.llm import media

    r = np.random.default_rng(seed)
    shared = r.integers(0, 1 << 32, (common, media.BANDS))
    images = {}
    for group in range(groups):
        place, bands = r.integers(0, 900, (9, 2)), r.integers(0, 1 << 32, (9, media.BANDS))
        for k in range(of_group):
            own = np.concatenate([place + 20 + r.integers(-5, 6, (9, 2)), np.zeros((9, 1), int), bands], axis=1)
            everywhere = np.concatenate([r.integers(0, 900, (common, 2)), np.zeros((common, 1), int), shared], axis=1)
            images[group * 100 + k] = np.concatenate([everywhere, own]).astype("<u4").tobytes()
    return images


def test_images_with_one_common_detail_are_not_compared(spark, monkeypatch):
    """One detail that all images have makes a large bucket; a link needs more, so no pair is verified for it."""
    from veilspark.llm import media

    monkeypatch.setattr(media, "HOT", 5)
    compared, keep = {}, media.spill
    monkeypatch.setattr(media, "spill", lambda df, name, *x: compared.setdefault(name, []).append((out := keep(df, name, *x)).count()) or out)
    images = made_images(40, 1, 1)
    d = spark.createDataFrame([(i, bytearray(p)) for i, p in images.items()], "rep long, points binary")
    assert media.links(d).count() == 0
    assert compared["large"] == [40 * media.BANDS] and compared["pairs"] == [0, 0]


def test_points_are_dealt_once(spark, monkeypatch):
    """The details of both images of a pair come from one shuffle of all of them."""
    from veilspark.llm import media

    plans, keep = [], media.spill
    monkeypatch.setattr(media, "spill", lambda df, name, *x: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name, *x))
    images = made_images(3, 4, 2)
    d = keep(media.packed(spark.createDataFrame([(i, bytearray(p)) for i, p in images.items()], "rep long, points binary")), "packed")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        media._verify(spark.createDataFrame([(0, 1), (100, 101)], "a long, b long"), d)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plans[-1].count("ReusedExchange") == 1 and plans[-1].count("Exchange hashpartitioning(") == 4  # pairs, points, both; points again


def test_packed_points_are_whole(spark):
    from veilspark.llm import media

    images = [*made_images(2, 2, 3).values(), b"", None]
    d = media.packed(spark.createDataFrame([(k, p and bytearray(p), "x") for k, p in enumerate(images)], "rep long, points binary, further string"))
    got = d.orderBy("rep").toArrow()
    assert got["points"].combine_chunks()[:4].to_pylist() != images[:4] and got["further"].to_pylist() == ["x"] * 6
    assert media.unpacked(got["points"].combine_chunks()[:5]) == images[:5] and got["points"][5].as_py() is None
    assert d.limit(0).count() == 0 and media.packed(d.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_do_not_depend_on_order_or_bucket_sizes(spark, monkeypatch, seed):
    from veilspark.llm import graph, media

    images = made_images(5, 6, 2, seed)
    pairs = [(a, b) for a in images for b in images if a != b]
    linked = dict(zip(pairs, media.consensus([(images[a], images[b]) for a, b in pairs]).tolist()))
    assert 0 < sum(linked.values()) < len(pairs) and all(linked[a, b] == linked[b, a] for a, b in pairs)
    want = dict(zip(images, classes(list(images), lambda i, j: linked[list(images)[i], list(images)[j]])))
    d = spark.createDataFrame([(i, bytearray(p)) for i, p in images.items()], "rep long, points binary")
    for hot in (2, 32):
        monkeypatch.setattr(media, "HOT", hot)
        assert {i: i for i in images} | {x["node"]: x["root"] for x in graph.components(media.links(d)).collect()} == want


def test_small_and_blank_images_equal_their_copies(spark):
    from veilspark.llm import media

    pages = [(3, "<p>one line</p>"), (1, "<p>one line</p>"), (7, "<p>x</p>"), (9, "<p>x</p>"), (2, "<p>another</p>"), (5, None), (6, "")]
    d = spark.createDataFrame(pages, "page_id long, html string")
    got = {r["id"]: r["component_id"] for r in media.copies(media.describe(d, media.draw, "page_id", "html")).collect()}
    assert got == {3: 1, 1: 1, 7: 7, 9: 7, 2: 2, 5: 5, 6: 6}


def test_stages_keep_columns_of_any_name(spark):
    from veilspark.llm import ngram_join, pii

    d = spark.createDataFrame([(1, "mail a@b.org now", "x", "y", "z"), (2, "mail a@b.org now", "x", "y", "z"), (None, None, "x", "y", "z")], "doc_id long, text string, __t string, __spans string, __keep string")
    got = sorted(map(tuple, pii.redact(d).collect()), key=str)
    assert got == [(1, "mail [EMAIL] now", "x", "y", "z"), (2, "mail [EMAIL] now", "x", "y", "z"), (None, None, "x", "y", "z")]
    assert sorted((r["doc_id"] for r in ngram_join.keep_one(d).collect()), key=str) == [1, None]
    assert ngram_join.keep_one(d).columns == d.columns
