"""N-gram Jaccard join with prefix trees.

A document's set of word n-grams is sorted in one global order: frequent n-grams last, then long before short, then by
hash. Documents with equal sets become one class. Two sets can only be similar enough if they share a known number of
n-grams among the first few of each (their prefixes), so classes are linked by counting shared prefix n-grams. Frequent
ones aren't counted in pairs: a pair may lack as many as both sets have of them, and only classes that have enough of them to
be similar by these alone are chained by set size; a connected component of these candidate links is a block. Each block's sets go into a trie; every
set walks the trie of its block, shares the overlap counted along common branches, and leaves a subtree as soon as the
lengths that remain can't reach the needed overlap, or all of the subtree is already in its component. Blocks beyond
BLOCK_NGRAMS are dealt out as pairs of shards, which loses no pair. No pair list is ever built: links are emitted only
where they join two components.

The order's frequent n-grams are those with more than HOT prefix entries, at most ORDER_LAST of them; this bound
changes only the order, never a result: further ones stay in the prefixes and are frequent n-grams there.

Defined results: null, empty and word-less texts have an empty set, link with nothing and are their own component; a
text with fewer words than n counts as one n-gram; equal texts are linked; rows of equal doc_id are kept; a null doc_id
links with nothing and has a null component; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free, shuffle_partitions, small_batches, spill, table
from .graph import components
from .words import SPACED, chunks, mix, words

HOT, ORDER_LAST = 32, 200_000
BLOCK_NGRAMS = 4_000_000
COUNTED = 1_000_000  # prefix n-grams that a task counts at once (memory only)
FILTER_BITS = 1 << 25  # of the filter that keeps texts out of a shuffle (more ids let more texts pass, the join decides)
_ODD = np.uint64(0x9E3779B97F4A7C15)
LATE = np.uint64(1 << 63)


def ngram_sets(texts: list, n: int, last: np.ndarray) -> list[np.ndarray]:
    """For each text its distinct n-grams, as numbers whose order is the global order. last: frequent n-grams, sorted."""
    h, start, end, first = words(texts, SPACED)
    size = np.concatenate([[0], np.cumsum(end - start)])
    w = len(h)
    if w >= n:
        code = h[: w - n + 1]
        for k in range(1, n):
            code = mix(code * _ODD) ^ h[k : w - n + 1 + k]
        value = _number(code, size[n:] - size[:-n], last)
    else:
        value = np.zeros(0, dtype=np.uint64)
    out = []
    for k in range(len(texts)):
        i, j = int(first[k]), int(first[k + 1])
        if j - i >= n:
            out.append(np.unique(value[i : j - n + 1]))
        elif j > i:
            code = h[i : i + 1]
            for k in range(i + 1, j):
                code = mix(code * _ODD) ^ h[k : k + 1]
            out.append(_number(mix(code + np.uint64(j - i)), np.array([size[j] - size[i]]), last))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _number(code: np.ndarray, length: np.ndarray, last: np.ndarray) -> np.ndarray:
    rank = (127 - np.minimum(length, 127)).astype(np.uint64) << np.uint64(56)
    v = rank | (mix(code) >> np.uint64(8))
    if len(last):
        at = np.minimum(np.searchsorted(last, v), len(last) - 1)
        v = np.where(last[at] == v, v | LATE, v)
    return v


def extra(size):
    """N-grams by which a prefix is longer than one shared n-gram would need: so many more are shared by similar sets."""
    return np.maximum(1, size // 10)


def prefix_length(size: int, num: int, den: int) -> int:
    return min(size, size - -(-num * size // den) + int(extra(size)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def frequent(docs: DataFrame, n: int, num: int, den: int, rounds: int = 2) -> np.ndarray:
    """The most frequent prefix n-grams of the whole table, at most ORDER_LAST; partial rows per n-gram and task.

    A second round counts the prefixes that form once the first round's n-grams come last.
    """
    last = np.zeros(0, np.uint64)
    for _ in range(rounds):
        if len(last) < ORDER_LAST:
            last = np.union1d(last, _frequent(docs, n, num, den, last, ORDER_LAST - len(last)))
    return last


def _frequent(docs: DataFrame, n: int, num: int, den: int, last: np.ndarray, most: int) -> np.ndarray:
    def run(batches):
        kept, size = [], 0

        def flush():
            v, c = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            v, c = v[v < LATE], c[v < LATE]
            for i in range(0, len(v), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000])], ["v", "c"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in chunks(texts):
                for s in ngram_sets(texts[i:j], n, last):
                    if len(s):
                        kept.append(s[: prefix_length(len(s), num, den)].copy())  # a copy frees the whole set
                        size += len(kept[-1])
                if size >= COUNTED:
                    yield from flush()
                    size = 0
        if kept:
            yield from flush()

    counts = docs.select("text").mapInArrow(run, "v long, c long").groupBy("v").agg(F.sum("c").alias("c")).filter(F.col("c") > HOT)
    top = spill(counts.orderBy(F.desc("c"), "v").limit(most).select("v"), "frequent")  # what was shuffled for it goes at once
    v = top.toPandas()["v"].to_numpy(dtype=np.int64)
    discard(top)
    return np.sort(v.view(np.uint64))


def profiles(docs: DataFrame, n: int, num: int, den: int, last: np.ndarray) -> DataFrame:
    """doc_id, size of its set, digest of its set (null if empty), prefix (binary)."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chunks(texts):
                sets = ngram_sets(texts[i:j], n, last)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                prefix = [s[: prefix_length(len(s), num, den)].tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "size", "digest", "prefix"])

    return _texts(docs).mapInArrow(run, "doc_id long, size long, digest binary, prefix binary")


def _entries(classes: DataFrame) -> DataFrame:
    """v, size, rep: one row per class and prefix n-gram."""

    def run(batches):
        for b in batches:
            ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            v = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            n = [len(x) for x in v]
            all_v, all_n, all_i = np.concatenate(v) if v else np.zeros(0, np.int64), np.repeat(sizes, n), np.repeat(ids, n)
            for i in range(0, len(all_v), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (all_v, all_n, all_i)], ["v", "size", "rep"])

    return classes.select("rep", "size", "prefix").mapInArrow(run, "v long, size long, rep long")


def candidates(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) whose components hold every pair of classes that may be similar.

    Two similar sets share at least the smaller of their extra() numbers of prefix n-grams. Where an n-gram is shared by
    at most HOT classes its pairs of fitting sizes are counted. More frequent n-grams aren't counted: a pair is a link if
    those counted and the frequent ones that each of the two has could be enough. So a pair without any counted one can
    only be similar if both have at least as many frequent ones as they must share; such classes, and no others, are
    chained by set size instead: of each frequent n-gram, each is linked to the next one.
    """
    spark = classes.sparkSession
    parts = shuffle_partitions(spark)
    rows = _entries(classes)

    def pairs(batches):
        """Pairs with their counts; b is null for an entry of a frequent n-gram: its class, its size and the n-gram."""
        held, left = [], None

        def out(v, s, r):
            edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
            group = np.repeat(np.diff(edge), np.diff(edge))
            for d in range(1, int(min(group.max(initial=0), HOT))):
                at = np.flatnonzero((v[d:] == v[:-d]) & (group[d:] <= HOT) & (s[:-d] * den >= s[d:] * num) & (r[d:] != r[:-d]))
                if len(at):
                    held.append((r[at], r[at + d], np.minimum(extra(s[at]), extra(s[at + d]))))
            at = np.flatnonzero(group > HOT)
            for i in range(0, len(at), 200_000):
                own = at[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(r[own]), pa.nulls(len(own), pa.int64()), pa.array(s[own]), pa.array(v[own])], names)

        def flush():
            a, b, need = (np.concatenate(x) for x in zip(*held))
            key, n = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), need], axis=1), axis=0, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(key[:, 2].copy()), pa.array(n)], names)

        names = ["a", "b", "need", "n"]
        for b in batches:
            v, s, r = (b.column(k).to_numpy() for k in range(3))
            if left is not None:
                v, s, r = (np.concatenate(x) for x in zip(left, (v, s, r)))
            if not len(v):
                continue
            cut = int(np.searchsorted(v, v[-1]))  # the last n-gram may go on in the next batch
            left = (v[cut:], s[cut:], r[cut:])
            yield from out(v[:cut], s[:cut], r[:cut])
            if sum(len(x[0]) for x in held) > 2_000_000:
                yield flush()
        if left is not None:
            yield from out(*left)
        if held:
            yield flush()

    rare = rows.filter("v >= 0").repartition(parts, "v").sortWithinPartitions("v", "size", "rep")
    got = spill(rare.mapInArrow(pairs, "a long, b long, need long, n long"), "pairs")
    late = rows.filter("v < 0").select("v", "size", "rep")
    hot = spill(late.unionByName(got.filter("b IS NULL").select(F.col("n").alias("v"), F.col("need").alias("size"), F.col("a").alias("rep"))), "hot")
    have = spill(hot.groupBy("rep").agg(F.count(F.lit(1)).alias("h"), F.min("size").alias("size")), "have")
    shared = got.filter("b IS NOT NULL").join(have.select(F.col("rep").alias("a"), F.col("h").alias("ha")), "a", "left")
    shared = shared.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"), F.coalesce(F.max("ha"), F.lit(0)).alias("ha"))
    shared = shared.filter("n + ha >= need").join(have.select(F.col("rep").alias("b"), F.col("h").alias("hb")), "b", "left")
    shared = spill(shared.filter("n + least(ha, coalesce(hb, 0)) >= need").select("a", "b"), "shared")
    discard(got)
    # what a class must share with one of the smallest size that fits
    alone = have.filter(f"h >= greatest(1, (size * {num} + {den - 1}) div {den} div 10)").select("rep")
    linked = chains(hot.join(alone, "rep", "left_semi").select("v", "size", "rep"), num, den)
    discard(hot)
    discard(have)
    return shared.unionByName(linked)


def chains(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links between classes that are neighbours, by set size, among those that share a frequent prefix n-gram.

    Sorted by range, so that even an n-gram that all classes share is dealt over many tasks; the first and last entry of
    each task tell whether a chain goes on in the next one.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "v", "size", "rep").sortWithinPartitions("v", "size", "rep")

    def run(batches):
        from pyspark import TaskContext

        part, last, first, found = TaskContext.get().partitionId(), None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            v, s, r = (b.column(k).to_numpy() for k in range(3))
            if last is not None:
                v, s, r = np.append(last[0], v), np.append(last[1], s), np.append(last[2], r)
            else:
                first = (int(v[0]), int(s[0]), int(r[0]))
            ok = (v[1:] == v[:-1]) & (s[:-1] * den >= s[1:] * num) & (r[1:] != r[:-1])
            found.append(np.unique(np.stack([r[:-1][ok], r[1:][ok]], axis=1), axis=0))
            last = (v[-1], s[-1], r[-1])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        zero = np.zeros(len(pairs), np.int64)
        kinds = [pa.array(x) for x in (zero.astype(np.int32), zero, zero, pairs[:, 0].copy(), pairs[:, 1].copy())]
        yield pa.RecordBatch.from_arrays(kinds, ["edge", "v", "size", "a", "b"])
        if first is not None:
            ends = [(1, first[0], first[1], first[2], part), (2, int(last[0]), int(last[1]), int(last[2]), part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends), (pa.int32(), *[pa.int64()] * 4))], ["edge", "v", "size", "a", "b"])

    got = spill(ordered.mapInArrow(run, "edge int, v long, size long, a long, b long"), "chains")
    borders = sorted((r["b"], r["edge"], r["v"], r["size"], r["a"]) for r in got.filter("edge > 0").collect())  # two rows per task
    over = [(x[4], y[4]) for x, y in zip(borders, borders[1:]) if x[1] == 2 and y[1] == 1 and x[2] == y[2] and x[3] * den >= y[3] * num and x[4] != y[4]]
    links = got.filter("edge = 0").select("a", "b")
    return links.unionByName(spark.createDataFrame(over, "a long, b long")) if over else links


class Trie:
    """Compressed trie of sorted sequences. A node holds a run of elements and the sorted leaves lo..hi below it."""

    def __init__(self, seqs: list[np.ndarray]):
        self.order = sorted(range(len(seqs)), key=lambda k: seqs[k].astype(">u4").tobytes())
        self.seqs = [seqs[k] for k in self.order]
        self.size = np.array([len(s) for s in self.seqs])
        lcp = [0]
        for x, y in zip(self.seqs, self.seqs[1:]):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            lcp.append(int(differ[0]) if len(differ) else m)
        self.lcp = np.array(lcp)
        self.nodes: list = []  # (lo, hi, depth before, depth after, least size, largest size, children)
        self.root = self._build()

    def _build(self) -> int:
        def node(lo, hi, depth):
            end = len(self.seqs[lo]) if hi - lo == 1 else int(self.lcp[lo + 1 : hi].min())
            self.nodes.append([lo, hi, depth, end, int(self.size[lo:hi].min()), int(self.size[lo:hi].max()), []])
            return len(self.nodes) - 1

        root = node(0, len(self.seqs), 0)
        todo = [root]
        while todo:
            k = todo.pop()
            lo, hi, _, end, _, _, kids = self.nodes[k]
            if hi - lo == 1:
                continue
            cut = [lo, *(np.flatnonzero(self.lcp[lo + 1 : hi] == end) + lo + 1).tolist(), hi]
            for a, b in zip(cut, cut[1:]):
                c = node(a, b, end)
                kids.append(c)
                todo.append(c)
        return root

    def matches(self, q: int, mark: np.ndarray, label: np.ndarray, num: int, den: int):
        """Later leaves similar to leaf q that are in another component. mark: where q's elements are."""
        own, n = self.seqs[q], int(self.size[q])
        stack = [(self.root, 0)]
        while stack:
            k, overlap = stack.pop()
            lo, hi, depth, end, least, most, kids = self.nodes[k]
            if hi <= q + 1 or most * den < num * n or least * num > den * n:
                continue
            if (label[max(lo, q + 1) : hi] == label[q]).all():
                continue
            seq = self.seqs[lo]
            if end > depth:
                overlap += int(mark[seq[depth:end]].sum())
            need = -(-num * (n + max(least, -(-num * n // den))) // (num + den))
            left = n - int(np.searchsorted(own, seq[end - 1], side="right")) if end else n
            if overlap + min(most - end, left) < need:
                continue
            if kids:
                stack += [(c, overlap) for c in kids]
            elif overlap * (num + den) >= num * (n + least):
                yield lo


def block_links(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(id, smallest id of its component) for all ids that are linked to a smaller one."""
    if len(ids) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(max(ids), min(ids))] if both * (num + den) >= num * (len(sets[0]) + len(sets[1])) and ids[0] != ids[1] else []
    alphabet = np.unique(np.concatenate(sets))
    trie = Trie([np.searchsorted(alphabet, s).astype(np.uint32) for s in sets])
    own = np.array([ids[k] for k in trie.order])
    label = np.arange(len(ids))
    mark = np.zeros(len(alphabet), dtype=bool)
    for q in range(len(ids)):
        mark[trie.seqs[q]] = True
        for x in trie.matches(q, mark, label, num, den):
            if label[x] != label[q]:
                label[label == label[x]] = label[q]
        mark[trie.seqs[q]] = False
    root = {}
    for i, k in zip(own.tolist(), label.tolist()):
        root[k] = min(i, root.get(k, i))
    return [(i, root[k]) for i, k in zip(own.tolist(), label.tolist()) if root[k] != i]


def may_be_among(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id has the hash of a member's; so most other texts aren't shuffled for a join."""
    bits, n = 64, members.count()
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = members.select(place("rep").alias("h")).select(F.expr("h div 64").alias("w"), F.expr("shiftleft(1L, cast(h % 64 AS int))").alias("b"))
    known = spill(at.groupBy("w").agg(F.bit_or("b").alias("b")), "filter")
    got = known.toPandas()
    discard(known)
    held = np.zeros(bits // 64, np.int64)
    held[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)

    def there(h: pa.Array) -> pa.Array:
        x = h.to_numpy(zero_copy_only=False)
        return pa.array((held[x >> 6] >> (x & 63)) & 1 == 1)

    return texts.filter(F.arrow_udf(there, "boolean")(place("doc_id")))


def join_blocks(docs: DataFrame, members: DataFrame, n: int, num: int, den: int, last: np.ndarray) -> DataFrame:
    """members: rep, size, block. Links (a, b) inside blocks."""
    sizes = members.groupBy("block").agg(F.sum("size").alias("w"))
    shards = F.ceil(F.col("w") / BLOCK_NGRAMS).cast("int")
    dealt = members.join(sizes, "block").withColumn("of", shards).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("rep", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = may_be_among(_texts(docs), members).join(dealt, F.col("doc_id") == F.col("rep")).select("block", "i", "j", "rep", "text")
    ordered = texts.repartition(shuffle_partitions(docs.sparkSession), "block", "i", "j").sortWithinPartitions("block", "i", "j", "rep")

    def run(batches):
        key, ids, sets = None, [], []

        def done():
            links = block_links(ids, sets, num, den) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            reps, texts = b.column(3).to_pylist(), b.column(4).to_pylist()
            for lo, hi in chunks(texts):
                for k, r, s in zip(keys[lo:hi], reps[lo:hi], ngram_sets(texts[lo:hi], n, last)):
                    if k != key:
                        if len(ids) > 1:
                            yield done()
                        key, ids, sets = k, [], []
                    if not ids or ids[-1] != r:  # equal rows of one document
                        ids.append(r)
                        sets.append(s)
        if len(ids) > 1:
            yield done()

    return ordered.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by a Jaccard similarity of at least num / den."""
    small_batches(docs.sparkSession)
    last = frequent(docs, n, num, den)
    rows = spill(profiles(docs, n, num, den, last), "profiles")
    known = rows.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    least = known.groupBy("digest").agg(F.min(F.struct("doc_id", "size", "prefix")).alias("r"))
    classes = spill(least.select("digest", F.col("r.doc_id").alias("rep"), F.col("r.size").alias("size"), F.col("r.prefix").alias("prefix")), "classes")
    ids = spill(rows.select("doc_id", "size", "digest"), "ids")
    discard(rows)
    blocks = components(candidates(classes, num, den))
    members = spill(classes.select("rep", "size").join(blocks, F.col("rep") == F.col("node")).select("rep", "size", F.col("root").alias("block")), "members")
    reps = spill(classes.select("digest", "rep"), "reps")
    discard(classes)
    links = spill(join_blocks(docs, members, n, num, den, last), "near")
    split = members.groupBy("block").agg(F.sum("size").alias("w")).filter(F.col("w") > BLOCK_NGRAMS).limit(1).count()
    discard(members)
    roots = components(links) if split else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = reps.join(roots, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = ids.join(named, "digest", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs with the smallest doc_id of each component, repeated rows once; a null doc_id stays."""
    found = join(docs, n, num, den).filter("doc_id = component_id").select(F.col("doc_id").alias(free(docs, "__keep"))).distinct()
    kept = docs.join(found, docs["doc_id"] == found[found.columns[0]], "left_semi")
    once = kept.dropDuplicates(["doc_id", "text"])
    return once.unionByName(docs.filter(F.col("doc_id").isNull()))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), 3, 9, 10)
