"""Word hashes of many texts at once, with numpy: one pass over the bytes, no Python object per word."""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Bytes that are no letter or digit become blanks; A-Z become lower case.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: White space becomes blanks; A-Z become lower case.
SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(int(base))
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers[key][:n]


def prefix(buffer: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes, modulo 2**64."""
    out = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _power(_P, len(buffer)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(_Q, len(sums))[start] + (end - start).astype(np.uint64))


#: Words of more bytes than this are hashed one by one.
LONG = 256
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: words of up to seven bytes never hash alike, longer ones are mixed eight
    bytes at a time, each step a bijection of what was there before, so that no sum of bytes cancels out."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([b, np.zeros(8, np.uint8)]), 8)
    n = end - start
    lane = np.ascontiguousarray(eight[start]).view("<u8")[:, 0] & _KEEP[np.minimum(n, 8)]
    out = mix(np.where(n < 8, lane | n.astype(np.uint64) << np.uint64(56), lane))
    left, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(left):
        lane = np.ascontiguousarray(eight[start[left] + at]).view("<u8")[:, 0] & _KEEP[np.minimum(n[left] - at, 8)]
        out[left] = mix(mix(out[left] + _P) ^ lane)
        at += 8
        left = left[n[left] > at]
    out[n > 7] = mix(out[n > 7] ^ (n[n > 7].astype(np.uint64) << np.uint64(32)) ^ _Q)
    for k in np.flatnonzero(n > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(b[start[k] : end[k]].tobytes())
    return out


def words(texts: list, table: bytes):
    """(word hashes, first byte, end byte, first word of each text and the number of all words)."""
    coded = [(t or "").encode() for t in texts]
    joined = b" ".join(coded).translate(table)
    b = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = b != 32
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    at = np.cumsum([0] + [len(c) + 1 for c in coded])
    return word_hashes(b, start, end), start, end, np.searchsorted(start, at)


def chunks(texts: list, limit: int = 1 << 20):
    """Slices of texts of about `limit` characters together."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)
