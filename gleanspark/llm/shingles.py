"""Word shingle sets as sorted 64-bit hashes, and the fragments they are cut into."""

from __future__ import annotations

import math

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bits of the places that stand for frequent elements.
PLACES = 25
#: A size class spans this many steps of the threshold.
STEPS = 3


class WordHashes(dict):
    """64-bit hashes of words, as UTF-8 or text; emptied when it holds too many."""

    LIMIT = 150_000

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of ``text``, A-Z lowered; all words as one shingle if fewer; none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    h = np.fromiter((words[w] for w in parts), np.uint64, len(parts))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mix(out) + h[i : len(h) - k + 1 + i]
    return np.unique(mix(out))


def places(s: np.ndarray) -> np.ndarray:
    """Numbers below 2**PLACES of the elements of a set."""
    return (s >> np.uint64(64 - PLACES - 7)).astype(np.int64) & ((1 << PLACES) - 1)


class Fragments:
    """Cuts sets into fragments of the hash order so that two sets whose Jaccard similarity is at least ``percent``/100 share a whole one.

    Sets of similarity t differ in at most (1-t)/(1+t) * (|x|+|y|) elements; with more fragments than that at
    least one has none of them. Sizes are dealt into classes spanning STEPS factors of t; a set near a class's
    upper bound also emits the fragments of the class below, as its larger partner there.

    A fragment is weak if it is empty or all its elements are in ``frequent``, a bitmap over ``places``. There
    are some fragments to spare, and a set with no more weak ones than that doesn't emit them: a partner shares
    one more whole fragment than can be weak. So any bitmap gives the same links, and a good one fewer candidates.
    """

    def __init__(self, percent: int, frequent: np.ndarray | None = None):
        self.t = percent / 100
        self.percent = percent
        self.width = -STEPS * math.log(self.t) if percent < 100 else 1.0
        self.frequent = frequent

    def lower(self, c: int) -> int:
        """The smallest size of class c."""
        return math.ceil(math.exp(c * self.width) - 1e-9)

    def class_of(self, n: int) -> int:
        c = int(math.log(n) / self.width)
        while self.lower(c + 1) <= n:
            c += 1
        while self.lower(c) > n:
            c -= 1
        return c

    def count(self, c: int) -> tuple[int, int]:
        """Fragments of class c, and how many of them are to spare."""
        top = self.lower(c + 1) - 1  # the smaller of a pair
        larger = top * 100 // self.percent
        differ = (100 - self.percent) * (top + larger) // (100 + self.percent)
        spare = 2 + differ // 24
        return differ + 1 + spare, spare

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """64-bit hashes of (class, number, elements) of the fragments of the sorted set ``s``."""
        n = len(s)
        if not n:
            return np.empty(0, np.uint64)
        c, out = self.class_of(n), []
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(s + np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
        other = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(s ^ np.uint64(0xD6E8FEB86659FD93)), out=other[1:])
        rare = np.arange(n + 1)
        if self.frequent is not None:
            at = places(s)
            np.cumsum((self.frequent[at >> 3] >> (at & 7).astype(np.uint8)) & 1 ^ 1, out=rare[1:])
        for k in (c, c - 1):
            if k < 0 or k < c and self.percent * n > 100 * (self.lower(c) - 1):
                continue
            f, spare = self.count(k)
            if f == 1 + spare:
                continue  # only equal sets can be linked
            cuts = np.zeros(f + 1, np.int64)
            cuts[1:-1] = np.searchsorted(s, (np.arange(1, f, dtype=np.float64) * (2.0**64 / f)).astype(np.uint64))
            cuts[-1] = n
            a, b = cuts[:-1], cuts[1:]
            key = mix((sums[b] - sums[a]) ^ mix((other[b] - other[a]) + np.uint64(k * 1_000_003 + 17) + (np.arange(f, dtype=np.uint64) << np.uint64(32))))
            strong = rare[b] > rare[a]
            out.append(key if f - strong.sum() > spare else key[strong])
        return np.concatenate(out) if out else np.empty(0, np.uint64)
