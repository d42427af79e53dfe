"""Copies of images by local descriptors.

Corners (Harris, at two scales; the strongest within RADIUS pixels, wherever the image is cut) are described by binary
tests on a smoothed patch, turned to the patch's orientation. Equal images become one class. Two images are linked if
enough details of each stand in the other at one shift (geometric consensus), and at one ratio of sizes, 1 or 2: a third of the details of the image that has
fewer, LEAST at least; so crops and edits are found, and pages that share a header only are not.

Descriptors meet in Hamming tables: each is cut into BANDS, and details with an equal band are alike. Every image has its
details in one order, rare ones first (by counts of all bands in BINS bins; they change the order only, never a result).
An image linked with a larger one shares at least TRIES of all but its last need() - TRIES details (its prefix), and one
of all but its last need() - 1. Buckets of at most HOT entries vote for their pairs of prefix details and others; which of
these agree in place is for the consensus to say, when the pair is compared.
Larger buckets, where copies of one image or common details meet, are searched by components: each prefix entry is
compared with the bucket's fullest image, and what is still apart then is compared across components; see links().

The tables here hold no pictures, so the query draws each page: its visible words in a micro font, a new line for each
block, which is what a screenshot thumbnail would show.

Defined results: a null or damaged image has no keypoints and links with nothing; equal images are one class, with or
without keypoints; an image of fewer than LEAST keypoints links with its equals only; repeated rows and equal ids keep one
row each; a null id links with nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, spill, table
from .graph import components
from .words import mix

PATCH, RADIUS, CORNER, BANDS, SHIFT = 7, 8, 3e5, 2, 8
LEAST, TRIES, HOT, BINS = 3, 3, 32, 1 << 16
KEY = 32 + (BANDS - 1).bit_length()  # bits of a key: the band's number and its 32 bits
COMMON = 0.01  # share of all images: a bin with more entries is dealt over tasks like a large bucket
WIDTH = 128
MARGIN = 48  # of nine pixels' sum: what flat places differ by through noise is no difference
_rng = np.random.default_rng(11)
TESTS = _rng.integers(-PATCH, PATCH + 1, size=(32 * BANDS, 4))
FULL = 0.85  # share of a patch that isn't blank: shapes of blank places are the same in many images
BORDER = 10
STACK = 512  # rows of pictures that are searched together (speed only)
KEPT = 6  # details of each scale that an image keeps at least, the fullest ones, however blank they are
TAG, BLOCK, HIDDEN = re.compile(r"<[^>]*>"), re.compile(r"</?(?:p|div|h\d|li|ul|tr|table|article|nav|br)\b[^>]*>"), re.compile(r"<(script|style|title)\b.*?</\1>|<!--.*?-->", re.S)


def draw(html: str | None) -> np.ndarray | None:
    """Grey pixels: each character is a column of three, its darkness follows its code."""
    if not html:
        return None
    lines, line = [], ""
    for block in BLOCK.sub("\n", HIDDEN.sub(" ", html)).split("\n"):
        for word in TAG.sub(" ", block).split():
            while len(word) > WIDTH:
                lines.append(word[:WIDTH])
                word = word[WIDTH:]
            if len(line) + len(word) + 1 > WIDTH:
                lines.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        if line:
            lines.append(line)
            line = ""
    if not lines:
        return None
    code = np.frombuffer("".join([x.ljust(WIDTH, "\0") for x in lines]).encode("utf-32-le"), np.uint32).reshape(-1, WIDTH)
    ink = np.where((code == 0) | (code == 32), 0, 1).astype(np.uint8)
    image = np.full((4 * len(lines), WIDTH), 255, np.uint8)
    for r, m in enumerate((37, 101, 59)):
        image[r::4] = 255 - ink * (60 + (code * m) % 160).astype(np.uint8)
    return image


def _sum(a: np.ndarray, n: int) -> np.ndarray:
    """Sums over n x n squares that lie inside."""
    h, w = a.shape[0] - n + 1, a.shape[1] - n + 1
    rows = sum((a[k : k + h] for k in range(1, n)), a[:h])
    return sum((rows[:, k : k + w] for k in range(1, n)), rows[:, :w])


def _highest(a: np.ndarray, n: int) -> np.ndarray:
    """Maxima over n x n squares that lie inside."""
    for _ in range(2):
        width = 1
        while width * 2 <= n:
            a, width = np.maximum(a[:-width], a[width:]), width * 2
        if width < n:
            a = np.maximum(a[: width - n], a[n - width :])
        a = a.T
    return a


def keypoints(image: np.ndarray | None) -> np.ndarray:
    """Rows of x, y, scale and BANDS numbers of 32 bits: an image's corners, of equal ones the topmost."""
    return keypoints_of([image])[0]


def keypoints_of(images: list[np.ndarray | None]) -> list[np.ndarray]:
    """keypoints() of each image. Images of one width are searched together, one below the other."""
    out = [np.zeros((0, 3 + BANDS), "<u4")] * len(images)
    stacks: dict[int, list[int]] = {}
    rows: dict[int, int] = {}
    full: list[list[int]] = []
    for k, image in enumerate(images):
        if image is None or min(image.shape) < 4:
            continue
        w = image.shape[1]
        stacks.setdefault(w, []).append(k)
        rows[w] = rows.get(w, 0) + image.shape[0] + 2 * BORDER
        if rows[w] >= STACK:
            full.append(stacks.pop(w))
            rows[w] = 0
    for own in [*full, *stacks.values()]:
        for i, found in zip(own, _stacked([images[i] for i in own])):
            out[i] = found
    return out


def _stacked(images: list[np.ndarray]) -> list[np.ndarray]:
    """keypoints() of each image; all have one width, and four rows and columns at least."""
    found, of, total = [], [], len(images)
    own = np.arange(total)
    edge = int(PATCH * 1.5) + 2
    for scale in (0, 1):
        if scale:
            w = (images[0].shape[1] // 2) * 2
            images = [i[: (i.shape[0] // 2) * 2, :w].astype(np.float32) for i in images]
            images = [(i[::2, ::2] + i[1::2, ::2] + i[::2, 1::2] + i[1::2, 1::2]) / 4 for i in images]
            own = np.array([k for k, i in zip(own.tolist(), images) if min(i.shape) >= 4], dtype=np.int64)
            images = [i for i in images if min(i.shape) >= 4]
        if not images:
            break
        # blank space around each picture, so that details at its border count
        h, w = np.array([i.shape[0] for i in images]), images[0].shape[1]
        top = np.cumsum(h + 2 * BORDER) - (h + 2 * BORDER)
        sheet = np.full((int((h + 2 * BORDER).sum()), w + 2 * BORDER), 255, np.float32)
        for i, y in zip(images, top.tolist()):
            sheet[y + BORDER : y + BORDER + i.shape[0], BORDER:-BORDER] = i
        s = _sum(sheet, 3)  # s[y, x] is the square around (x + 1, y + 1)
        t = s[edge - 3 : 3 - edge, edge - 3 : 3 - edge]
        if min(t.shape) < 5:
            continue
        gx, gy = t[1:-1, 2:] - t[1:-1, :-2], t[2:, 1:-1] - t[:-2, 1:-1]
        xx, yy, xy = _sum(gx * gx, 3), _sum(gy * gy, 3), _sum(gx * gy, 3)
        r = (xx * yy - xy * xy) / (xx + yy + 1)  # r[y, x] belongs to (x + edge, y + edge)
        for a, b in zip((top + h + 2 * BORDER - 2 * edge).tolist(), top[1:].tolist()):
            r[a:b] = -1  # between two pictures
        framed = np.full((r.shape[0] + 2 * RADIUS, r.shape[1] + 2 * RADIUS), -1, np.float32)
        framed[RADIUS:-RADIUS, RADIUS:-RADIUS] = r
        best = _highest(framed, 2 * RADIUS + 1)
        high = np.flatnonzero(r > CORNER)
        y, x = np.divmod(high[r.ravel()[high] == best[high // r.shape[1], high % r.shape[1]]], r.shape[1])
        if not len(x):
            continue
        k = np.searchsorted(top, y, side="right") - 1
        y, x = y + edge, x + edge
        off, width, flat = np.arange(-PATCH, PATCH + 1), s.shape[1], s.ravel()
        p = 9 * 255 - flat[((y - 1) * width + x - 1)[:, None, None] + (off[:, None] * width + off)]
        ink = (p > MARGIN).mean(axis=(1, 2))
        n = np.bincount(k, minlength=len(images))
        least = np.append(ink[np.lexsort((-ink, k))], 0)[np.cumsum(n) - n + np.minimum(n, KEPT) - 1]  # not read where n is 0
        full = ink >= np.minimum(FULL, least[k])
        x, y, p, k = x[full], y[full], p[full], k[full]
        angle = np.arctan2((p.sum(axis=2) * off).sum(axis=1), (p.sum(axis=1) * off).sum(axis=1))
        c, d = np.cos(angle)[:, None], np.sin(angle)[:, None]
        middle = ((y - 1) * width + x - 1)[:, None]
        at = lambda u, v: flat[middle + np.rint(d * u + c * v).astype(np.int32) * width + np.rint(c * u - d * v).astype(np.int32)]
        bits = at(TESTS[:, 0], TESTS[:, 1]) + MARGIN < at(TESTS[:, 2], TESTS[:, 3])
        bands = np.packbits(bits, axis=1).view(">u4")
        of.append(own[k])
        found.append(np.concatenate([np.stack([(x - BORDER) << scale, (y - top[k] - BORDER) << scale, np.full(len(x), scale)], axis=1), bands], axis=1).astype("<u4"))
    if not found:
        return [np.zeros((0, 3 + BANDS), "<u4")] * total
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")  # by image, then scale, then from top to bottom
    of, found = of[order], found[order]
    code = found[:, 3].astype(np.uint64) << np.uint64(32) | found[:, 4].astype(np.uint64)
    code = mix(code) ^ found[:, 2]
    order = np.lexsort((code, of))
    first = np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (code[order][1:] != code[order][:-1])])
    kept = np.sort(order[first])
    of, found = of[kept], found[kept]
    return np.split(found, np.searchsorted(of, np.arange(1, total)))


def describe(rows: DataFrame, paint, key: str, column: str) -> DataFrame:
    """id, n_keypoints, digest, points (binary). paint: the column's value -> grey pixels or None."""

    def run(batches):
        for b in batches:
            n, digest, points = [], [], []
            for at in range(0, b.num_rows, 64):
                images = [paint(v) for v in b.column(1).slice(at, 64).to_pylist()]
                for image, t in zip(images, keypoints_of(images)):
                    n.append(len(t))
                    digest.append(xxhash.xxh3_128_digest(image.tobytes() + image.shape[1].to_bytes(4, "little")) if image is not None else None)
                    points.append(t.tobytes() if len(t) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(points, pa.binary())], ["id", "n_keypoints", "digest", "points"])

    return rows.select(F.col(key).cast("long").alias("id"), column).mapInArrow(run, "id long, n_keypoints long, digest binary, points binary")


def packed(classes: DataFrame) -> DataFrame:
    """The classes with their points byte by byte: first all first bytes, then all second ones. The many that are zero
    stand together then, and what is shuffled is smaller."""
    at = classes.columns.index("points")

    def run(batches):
        for b in batches:
            points = [None if p is None else np.frombuffer(p, np.uint8).reshape(-1, 4 * (3 + BANDS)).T.tobytes() for p in b.column(at).to_pylist()]
            yield b.set_column(at, "points", pa.array(points, pa.binary()))

    return classes.mapInArrow(run, classes.schema)


def unpacked(points: pa.Array) -> list[bytes]:
    """The points of packed() images as they were."""
    return [np.frombuffer(p, np.uint8).reshape(4 * (3 + BANDS), -1).T.tobytes() for p in points.to_pylist()]


def _details(points: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all details of several images: the image's number, the keys (detail, band), x, y and scale. A key holds no scale:
    a copy at half the size has at one scale what the original has at the next."""
    t = np.frombuffer(b"".join(points), "<u4").reshape(-1, 3 + BANDS).astype(np.int64)
    own = np.repeat(np.arange(len(points)), [len(p) // (4 * (3 + BANDS)) for p in points])
    return own, (np.arange(BANDS) << 32) | t[:, 3:], t[:, 0], t[:, 1], t[:, 2]


def _bin(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(48)).astype(np.int64) % BINS


def _shifts(dx: np.ndarray, dy: np.ndarray, ratio: np.ndarray) -> list[np.ndarray]:
    """The bins of shifts in four grids that lie half a bin apart, so that near shifts share one; ratio: a number for each
    ratio of sizes."""
    half = SHIFT // 2
    return [((ratio * 4 + 2 * i + j) << 44) | ((dx + i * half) // SHIFT + (1 << 20)) << 22 | ((dy + j * half) // SHIFT + (1 << 20)) for i in (0, 1) for j in (0, 1)]


def need(n):
    """Details that an image of n details must share with a larger one."""
    return np.maximum(LEAST, (n + 2) // 3)


def consensus(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """For each pair of images, whether need() details of each stand in the other at one shift and one ratio of sizes. A
    detail counts once at a shift, however many of its bands agree. Shifts are seen from either image, so that the order of
    the two doesn't matter."""
    i, k, x, y, p = _details([a for a, _ in pairs])
    j, m, u, v, q = _details([b for _, b in pairs])
    least = need(np.minimum(np.bincount(i, minlength=len(pairs)), np.bincount(j, minlength=len(pairs))))
    alike = []
    for band in range(BANDS):
        key, other = (i << 36) | k[:, band], (j << 36) | m[:, band]
        order = np.argsort(other, kind="stable")
        lo, hi = np.searchsorted(other[order], key, side="left"), np.searchsorted(other[order], key, side="right")
        n = hi - lo
        own = np.repeat(np.arange(len(key)), n)
        alike.append(own * len(j) + order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)])
    alike = np.unique(np.concatenate(alike))
    own, other = alike // max(1, len(j)), alike % max(1, len(j))
    # places in the picture of the larger size: a detail of scale 1 beside one of scale 0 says that one picture is half the other
    ratio = p[own] - q[other]
    up, down = np.where(ratio > 0, 2, 1), np.where(ratio < 0, 2, 1)
    dx, dy = u[other] * up - x[own] * down, v[other] * up - y[own] * down
    bins = _shifts(dx, dy, ratio + 1) + _shifts(-dx, -dy, ratio + 4)
    own, other = np.tile(own, len(bins)), np.tile(other, len(bins))
    shifts, spot = np.unique(np.concatenate(bins), return_inverse=True)
    _, spot = np.unique(i[own] * (len(shifts) + 1) + spot, return_inverse=True)
    full = None
    for detail in (own, other):
        got = np.bincount(np.unique(spot * (1 << 32) + detail) >> 32, minlength=int(spot.max(initial=-1)) + 1)
        full = got if full is None else np.minimum(full, got)
    out = np.zeros(len(pairs), dtype=bool)
    if len(own):
        of = np.zeros(len(full), np.int64)
        of[spot] = i[own]
        out[of[full >= least[of]]] = True
    return out


def _verify(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs among the candidates that have geometric consensus. The details of a, which has fewer, go to those of b."""
    pairs = spill(candidates.filter("a <> b").distinct(), "pairs")  # a table: the planner knows its size
    # both sides read the classes alike, so that Spark deals them by id once and reads that twice
    x = pairs.join(classes.select(F.col("rep").alias("a"), F.col("points").alias("pa")), "a")
    y = classes.select(F.col("rep").alias("b"), F.col("points").alias("pb"))

    def run(batches):
        for t in batches:
            for i in range(0, t.num_rows, 500):
                part = t.slice(i, 500)
                ok = consensus(list(zip(unpacked(part.column(2)), unpacked(part.column(3)))))
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    found = spill(x.join(y, "b").select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long"), "links")
    discard(pairs)
    return found


def sketch(classes: DataFrame) -> np.ndarray:
    """How many entries each bin has, over all images: BINS numbers."""

    def run(batches):
        n = np.zeros(BINS, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(_bin(_details(unpacked(b.column(0)))[1].ravel()), minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bin", "n"])

    got = classes.select("points").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BINS, np.int64)
    out[got["bin"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _entries(classes: DataFrame, load: np.ndarray, common: int) -> DataFrame:
    """word and rep. A word holds the key in its lowest KEY bits and a mark above: n (details of the image), two bits first
    (2: in the prefix that shares one detail with any link, 1: in that which shares TRIES, 0: in none), one bit large."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            reps, points = b.column(0).to_numpy(), unpacked(b.column(1))
            own, key, *_ = _details(points)
            size = np.bincount(own, minlength=len(points))
            count = load[_bin(key.ravel())].reshape(key.shape)
            order = np.lexsort((mix(key[:, 0].astype(np.uint64)), count.max(axis=1), own))
            rank = np.empty(len(own), np.int64)
            rank[order] = np.arange(len(own)) - (np.cumsum(size) - size)[own]
            n = size[own]
            first = (rank < n - need(n) + TRIES).astype(np.int64) + (rank < n - need(n) + 1)
            large = count > common
            rep = reps[own]
            keys = key.T.ravel()
            large = large.T.ravel()
            cols = [(np.tile(n << 3 | first << 1, BANDS) | large) << KEY | keys, np.tile(rep, BANDS)]
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in cols], ["word", "rep"])

    rows = classes.filter(F.octet_length("points") >= LEAST * 4 * (3 + BANDS)).select("rep", "points")
    return rows.mapInArrow(run, "word long, rep long")


def _buckets(entries: DataFrame) -> DataFrame:
    """kind 0: votes (a, b, n; a has fewer details, or as many and a smaller id) of buckets of at most HOT entries; kind 1:
    entries of larger ones (a: rep, b: key, n: details, mark: twice the number of its details with this key that the votes
    count, plus 1 if one of them has first 2)."""
    key = F.col("word").bitwiseAND(F.lit((1 << KEY) - 1))
    route = F.when(F.shiftright("word", KEY).bitwiseAND(1) == 1, F.xxhash64(key, "rep")).otherwise(key)
    ordered = entries.repartition(shuffle_partitions(entries.sparkSession), route).sortWithinPartitions(key, "rep")
    names = ["kind", "a", "b", "n", "mark"]

    def batch(kind, a, b, n, mark):
        cols = (np.full(len(a), kind, np.int32), a, b, n, mark)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int32 if k == 0 else np.int64)) for k, c in enumerate(cols)], names)

    def take(cols):
        key, rep, mark = cols
        if not len(key):
            return
        n, first, large = mark >> 3, mark >> 1 & 3, mark & 1
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.repeat(np.diff(edge), np.diff(edge))
        hot = (size > HOT) | large.astype(bool)
        if hot.any():  # one row per image: in its prefix if any of its equal details is
            k, r, f = key[hot], rep[hot], first[hot]
            head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
            counted = np.add.reduceat((f > 0).astype(np.int64), head)
            yield batch(1, r[head], k[head], n[hot][head], counted * 2 + np.maximum.reduceat(f == 2, head))
        found = []
        for d in range(1, HOT):
            i = np.flatnonzero((key[d:] == key[:-d]) & ~hot[d:] & ~hot[:-d])
            if not len(i):
                break
            j = i + d
            # the detail of the smaller image must be in its prefix
            ok = (rep[i] != rep[j]) & np.where(n[i] < n[j], first[i], np.where(n[j] < n[i], first[j], first[i] | first[j])).astype(bool)
            i, j = i[ok], j[ok]
            i, j = np.where(n[j] < n[i], j, i), np.where(n[j] < n[i], i, j)  # rep rises from i to j where n is equal
            found.append(np.stack([rep[i], rep[j]], axis=1))
        if found:
            u, c = np.unique(np.concatenate(found), axis=0, return_counts=True)
            yield batch(0, u[:, 0], u[:, 1], c, np.zeros_like(c))

    def run(batches):
        left = None
        for b in batches:
            if not b.num_rows:
                continue
            word, rep = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            cols = [word & ((1 << KEY) - 1), rep, word >> KEY]
            if left is not None:
                cols = [np.concatenate(c) for c in zip(left, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on in the next batch
            if cols[2][-1] & 1:  # of a large one only its last image is held back
                cut += int(np.searchsorted(cols[1][cut:], cols[1][-1]))
            left = [c[cut:] for c in cols]
            yield from take([c[:cut] for c in cols])
        if left is not None:
            yield from take(left)

    return ordered.mapInArrow(run, "kind int, a long, b long, n long, mark long")


def links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes (rep, points) with geometric consensus, enough of them that the components are exact."""
    return linked(spill(packed(classes.select("rep", "points")), "packed"))


def linked(classes: DataFrame) -> DataFrame:
    """links() of packed() classes.

    A pair is a candidate if its votes, and the keys of large buckets that both have, are enough together. Pairs with a
    vote are judged first. Of the others, every image that has the key of a large bucket in its first prefix is paired with
    the bucket's image that has most details; where a bucket's images are in several components after that, those images
    meet the larger ones of other components; either is compared only if the keys in common are enough. So no pair that
    could join two components stays uncompared, and pairs already in one component aren't compared.

    Of keys of large buckets only a hash travels with an image: equal hashes can add candidates, never lose one.
    """
    total = classes.count()
    met = spill(_buckets(_entries(classes, sketch(classes), max(HOT, int(COMMON * total)))), "met")
    hot = met.filter("kind = 1").select(F.hash("b").alias("key"), F.col("a").alias("rep"), "n", (F.col("mark") % 2).alias("first"), F.expr("mark div 2").alias("counted"))
    hot = spill(hot.groupBy("key", "rep").agg(F.max("n").alias("n"), F.max("first").alias("first"), F.sum("counted").alias("counted")), "large")
    counted = F.flatten(F.collect_list(F.array_repeat("key", F.least("counted", F.lit(TRIES)).cast("int"))))  # each key as often as it counts
    own = hot.groupBy("rep").agg(F.max("n").alias("n"), F.collect_list("key").alias("keys"), counted.alias("counted"), F.collect_list(F.when(F.col("first") == 1, F.col("key"))).alias("first"))
    own = spill(own, "large-of-image")
    shared = "size(filter(counted, k -> array_contains(keys, k)))"
    # dealt by a: the sums and the join both need no other deal
    votes = met.filter("kind = 0").select("a", "b", "n").repartition("a").groupBy("a", "b").agg(F.sum("n").alias("n"))
    few = votes.filter(F.col("n") < TRIES).withColumnRenamed("n", "votes").join(own.filter("size(counted) > 0").select(F.col("rep").alias("a"), "counted"), "a")
    few = few.filter(f"votes + size(counted) >= {TRIES}").join(own.select(F.col("rep").alias("b"), "keys"), "b").filter(f"votes + {shared} >= {TRIES}")
    fullest = hot.groupBy("key").agg(F.max(F.struct("n", "rep")).alias("m")).select("key", F.col("m.rep").alias("rep")).join(own.select("rep", "keys"), "rep")
    starred = own.filter(f"size(counted) >= {TRIES}").select(F.explode("first").alias("key"), F.col("rep").alias("a"), "counted")
    starred = starred.join(fullest.select("key", F.col("rep").alias("b"), "keys"), "key").filter(f"{shared} >= {TRIES}")
    near = votes.filter(F.col("n") >= TRIES).select("a", "b").unionByName(few.select("a", "b")).unionByName(starred.select("a", "b"))
    found = _verify(near, classes)
    discard(met)
    roots = spill(components(found), "roots")
    placed = spill(own.join(roots, F.col("rep") == F.col("node"), "left").select("rep", "n", "keys", "counted", "first", F.coalesce("root", "rep").alias("root")), "placed")
    for done in (hot, own, roots):
        discard(done)
    split = placed.select("root", F.explode("keys").alias("key")).groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    x = placed.filter(f"size(counted) >= {TRIES}").select(F.explode("first").alias("key"), F.col("rep").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), "counted").join(split, "key", "left_semi")
    y = placed.select(F.explode("keys").alias("key"), F.col("rep").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), "keys").join(split, "key", "left_semi")
    # pairs with a vote elsewhere were judged with it before
    rest = y.join(x, "key").filter(f"ra <> rb AND nb >= na").filter(f"{shared} >= {TRIES}").select("a", "b")
    closing = _verify(rest, classes)
    discard(placed)
    return found.unionByName(closing)


def copies(described: DataFrame) -> DataFrame:
    """id, n_keypoints, component_id: images linked, over any number of steps, have the smallest id among them."""
    held = spill(described.withColumn("at", F.monotonically_increasing_id()), "keypoints")
    known = held.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    least = spill(known.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("r")).select("r.at"), "classes")
    classes = spill(packed(known.join(least, "at", "left_semi").select("digest", F.col("id").alias("rep"), "points")), "images")
    ids = spill(held.drop("points", "at"), "image-ids")
    discard(held)
    roots = components(linked(classes.filter("points IS NOT NULL").select("rep", "points")))
    named = classes.select("digest", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = ids.join(named, "digest", "left")
    return out.select("id", "n_keypoints", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(describe(table(spark, sf_dir, "pages"), draw, "page_id", "html")).withColumnRenamed("id", "page_id")
