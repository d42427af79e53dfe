"""Language identification with a linear-chain conditional random field.

Words are letters of one script run, lower-cased; a line is a chain (cut after CHAIN words). Emissions are sums of
hashed affix, byte n-gram and whole-word features and of a lexicon learned from the training words; transitions between
languages are learned with them, from chains of one language and from chains joined of two, so that a chain may switch
language within a text. Forward-backward gives each word's
probabilities; a text gets the language with the largest sum over all its words, and the score is its share.

Long runs of letters and runs in scripts without blanks are cut into several words, so that all letters count.

Training takes every language, at most SAMPLE documents of each and fewer (one at least) where all together would be
more than DOCUMENTS, chosen by a hash of doc_id, and runs in one task. Labelling is map-only and covers whole texts.

Defined results: null texts and texts without a letter are `und` with score 0; a null lang is not learned; without any
training text all are `und`; ties go to the language that sorts first; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import CACHE_WORDS, held_out, table
from .words import chunks

SAMPLE, DOCUMENTS = 300, 19_200
WIDTH = 1 << 16
CHAIN, GROUP = 64, 4096
EPOCHS, RATE, DECAY = 3, 0.5, 1e-6
SWITCHED = 8  # one training chain in so many is joined from two
WORD = re.compile(r"[^\W\d_]+")
#: Scripts without blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
LONGEST = 40
PIECE = re.compile(f"[^{UNSPACED}]{{1,{LONGEST}}}|[{UNSPACED}]{{1,4}}")


def line_words(line: str) -> list[str]:
    """The words of a line; together all of its letters."""
    out = []
    for w in WORD.findall(line):
        if len(w) <= LONGEST and w.isascii():
            out.append(w)
        else:  # numbers like 2 as a superscript or one half are no letters
            for run in [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split():
                out += PIECE.findall(run)
    return out


def word_features(word: str) -> list[int]:
    """Feature numbers of a word: prefixes, suffixes, byte trigrams, the word itself."""
    w = word.encode()
    c, n = zlib.crc32, len(w)
    out = [c(b"^" + w[:k]) for k in range(1, min(4, n) + 1)] + [c(b"$" + w[-k:]) for k in range(1, min(4, n) + 1)] + [c(b"=" + w)]
    out += [c(w[i : i + 3]) for i in range(n - 2)]
    return [x % WIDTH for x in out]


def forward_backward(emit: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals [chain, word, language] and summed transition counts. emit: scores, padded; size: chain lengths."""
    n, t, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a = np.exp(trans)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] = x / x.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        on = (i + 1 < size)[:, None]
        y = e[:, i + 1] * beta[:, i + 1]
        x = y @ a.T
        beta[:, i] = np.where(on, x / x.sum(axis=1, keepdims=True), 1.0)
        z = (alpha[:, i] * on).T @ (y / np.maximum(1e-30, ((alpha[:, i] @ a) * y).sum(axis=1, keepdims=True)))
        pairs += z * a
    m = alpha * beta
    m /= m.sum(axis=2, keepdims=True)
    m[np.arange(t)[None, :] >= size[:, None]] = 0
    return m, pairs


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: dict[str, int]):
        self.languages, self.weights, self.trans, self.lexicon = languages, weights, trans, lexicon
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)), dtype=np.float32)

    def indices(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All feature numbers of all words, and where each word's begin."""
        k, own, flat = len(self.languages), [], []
        for w in words:
            f = word_features(w)
            f.append(WIDTH + self.lexicon.get(w, k))
            own.append(len(f))
            flat += f
        return np.array(flat, dtype=np.int64), np.concatenate([[0], np.cumsum(own)[:-1]]).astype(np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Row numbers of words; emissions of new words are added."""
        number = self.number
        if len(number) > CACHE_WORDS:
            number.clear()
            self.rows = self.rows[:0]
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            for i in range(0, len(new), 50_000):
                flat, at = self.indices(new[i : i + 50_000])
                self.rows = np.concatenate([self.rows, np.add.reduceat(self.weights[flat], at, axis=0)])
            base = len(number)
            number.update((w, base + i) for i, w in enumerate(new))
        return np.fromiter((number[w] for w in words), dtype=np.int64, count=len(words))

    def label(self, texts: list) -> list[tuple[str, float]]:
        words, text_of, size = [], [], []
        for d, t in enumerate(texts):
            for line in (t or "").lower().split("\n"):
                own = line_words(line)
                for i in range(0, len(own), CHAIN):
                    text_of.append(d)
                    size.append(len(own[i : i + CHAIN]))
                words += own
        total = np.zeros((len(texts), len(self.languages)))
        if words and self.languages:
            number, size, text_of = self.numbers(words), np.array(size), np.array(text_of)
            first = np.cumsum(size) - size
            order = np.argsort(size, kind="stable")
            for i in range(0, len(order), GROUP):
                c = order[i : i + GROUP]
                t = int(size[c].max())
                at = np.minimum(first[c][:, None] + np.arange(t), len(number) - 1)
                m, _ = forward_backward(self.rows[number[at]], size[c], self.trans)
                np.add.at(total, text_of[c], m.sum(axis=1))
        n = total.sum(axis=1)
        best = total.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        return [(self.languages[b], float(min(1.0, total[d, b] / n[d]))) if n[d] > 0 else ("und", 0.0) for d, b in enumerate(best)]


def learn(texts: list[str], langs: list[str]) -> Model:
    """Stochastic gradient steps (AdaGrad) on the chains' conditional likelihood."""
    languages = sorted(set(langs))
    k = len(languages)
    chains, target, count = [], [], {}
    for t, lang in zip(texts, langs):
        y = languages.index(lang)
        for line in (t or "").lower().split("\n"):
            own = line_words(line)
            for w in own:
                c = count.setdefault(w, [0] * k)
                c[y] += 1
            for i in range(0, len(own), CHAIN):
                chains.append(own[i : i + CHAIN])
                target.append([y] * len(chains[-1]))
    # text that switches: every SWITCHED-th chain is the beginning of one and the end of another, in the middle of a line
    if k > 1:
        order = np.random.default_rng(7).permutation(len(chains))
        for a, b in zip(order[::SWITCHED].tolist(), order[1::SWITCHED].tolist()):
            m, n = max(1, len(chains[a]) // 2), len(chains[b]) // 2
            chains.append((chains[a][:m] + chains[b][n:])[:CHAIN])
            target.append((target[a][:m] + target[b][n:])[:CHAIN])
    lexicon = {w: int(np.argmax(c)) for w, c in count.items() if sum(c) >= 5 and max(c) >= 0.8 * sum(c)}
    model = Model(languages, np.zeros((WIDTH + k + 1, k), np.float32), np.zeros((k, k)), lexicon)
    if not chains:
        return model
    vocabulary = list(count)
    code = {w: i for i, w in enumerate(vocabulary)}
    flat, at = model.indices(vocabulary)
    n_of = np.diff(np.append(at, len(flat)))
    g_w, g_t = np.full(model.weights.shape, 1e-2), np.full((k, k), 1.0)
    rng, weights, trans = np.random.default_rng(5), np.zeros(model.weights.shape), np.zeros((k, k))
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for i in range(0, len(order), 512):
            part = [chains[j] for j in order[i : i + 512]]
            y = np.concatenate([target[j] for j in order[i : i + 512]])
            size = np.array([len(c) for c in part])
            ids = np.fromiter((code[w] for c in part for w in c), np.int64)
            row, col = np.repeat(np.arange(len(part)), size), np.concatenate([np.arange(s) for s in size])
            rep = np.repeat(np.arange(len(ids)), n_of[ids])
            f = flat[np.repeat(at[ids], n_of[ids]) + np.arange(len(rep)) - np.repeat(np.cumsum(n_of[ids]) - n_of[ids], n_of[ids])]
            emit = np.zeros((len(part), int(size.max()), k))
            emit[row, col] = np.add.reduceat(weights[f], np.cumsum(n_of[ids]) - n_of[ids], axis=0)
            m, pairs = forward_backward(emit, size, trans)
            gold = np.zeros((k, k))
            within = row[1:] == row[:-1]
            np.add.at(gold, (y[:-1][within], y[1:][within]), 1)
            miss = m[row, col]
            miss[np.arange(len(ids)), y] -= 1
            grad = np.stack([np.bincount(f, weights=miss[rep, j], minlength=len(weights)) for j in range(k)], axis=1) / len(part) + DECAY * weights
            g_w += grad**2
            weights -= RATE * grad / np.sqrt(g_w)
            step = (pairs - gold) / len(part)
            g_t += step**2
            trans -= RATE * step / np.sqrt(g_t)
    model.weights, model.trans = weights.astype(np.float32), trans
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not counts:
        return Model([], np.zeros((WIDTH + 1, 0), np.float32), np.zeros((0, 0)), {})
    sample = max(1, min(sample, DOCUMENTS // len(counts)))
    # drawn with enough to spare that no language is left without documents
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, max(3 * sample, 60) / r["n"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = known.select("doc_id", "lang").filter(draw < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    few = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("k") <= sample)
    few = few.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"))  # at most DOCUMENTS rows, or one of each language
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("doc_id", F.col("__lang").alias("lang"), "text")

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=["text"]).sort_values(["doc_id", "lang"]).drop_duplicates(["doc_id", "lang"])
        m = learn(p["text"].tolist(), p["lang"].tolist())
        return pd.DataFrame({"languages": [m.languages], "weights": [m.weights.tobytes()], "trans": [m.trans.tobytes()], "words": [list(m.lexicon)], "of": [list(m.lexicon.values())]})

    got = rows.groupBy().applyInPandas(fit, "languages array<string>, weights binary, trans binary, words array<string>, of array<int>").first()
    k = len(got["languages"])
    weights = np.frombuffer(got["weights"], np.float32).reshape(-1, k)
    return Model(list(got["languages"]), weights, np.frombuffer(got["trans"]).reshape(k, k), dict(zip(got["words"], got["of"])))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    parts = (model.languages, model.weights, model.trans, model.lexicon)

    def run(batches):
        own = Model(*parts)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chunks(texts):
                got = own.label(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x for x, _ in got]), pa.array([x for _, x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
