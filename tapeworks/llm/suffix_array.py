"""Suffix arrays by the difference cover modulo 3, on arrays.

The suffixes at positions 1 and 2 modulo 3 are the sample: their triples are sorted and named; where names repeat, the
suffixes of the string of names are sorted the same way. The remaining suffixes are sorted by first symbol and the rank of
the sampled suffix behind it, and merged: a remaining suffix is compared with a sampled one by at most two symbols and a
rank, so its place among each of the two sample classes is one binary search.

Positions and ranks are 32-bit: about 35 bytes of memory a byte of text at the peak."""

from __future__ import annotations

import numpy as np


def _named(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """How many distinct keys there are, and each one's place among them from 1."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    del keys
    names = np.empty(len(order), np.int32)
    names[order] = np.cumsum(new, dtype=np.int32)
    return int(new.sum()), names


def _joined(high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """high * width + low, or in the same order where that does not fit 62 bits."""
    if (int(high.max(initial=0)) + 1) * width < 1 << 62:
        return high.astype(np.int64) * width + low
    return _named(high)[1].astype(np.int64) * width + low


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``s`` (positive integers) in ascending order; a suffix precedes longer ones that
    start with it."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int32)
    s = np.concatenate([s.astype(np.int32, copy=False), np.zeros(3, np.int32)])
    # an empty suffix closes the first class where it would not end in padding
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32), np.arange(2, n, 3, dtype=np.int32)])
    width = int(s.max()) + 1
    distinct, names = _named(_joined(_joined(s[sample], s[sample + 1], width), s[sample + 2], width))
    if distinct < len(sample):
        below = suffix_order(names)
        names[below] = np.arange(1, len(sample) + 1, dtype=np.int32)
        del below
    rank = np.zeros(n + 3, np.int32)
    rank[sample] = names
    ordered = np.empty(len(sample), np.int32)
    ordered[names - 1] = sample
    ordered = ordered[ordered < n]
    base = len(sample) + 1
    del sample, names

    one = lambda i: s[i].astype(np.int64) * base + rank[i + 1]
    rest = np.arange(0, n, 3, dtype=np.int32)
    rest = rest[np.argsort(one(rest))]
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    place = np.arange(len(rest)) + np.searchsorted(one(first), one(rest))
    del first
    both = np.concatenate([second, rest])
    keys = _joined(_joined(s[both], s[both + 1], width), rank[both + 2], base)
    place += np.searchsorted(keys[: len(second)], keys[len(second) :])
    del both, keys, second
    out, free = np.empty(n, np.int32), np.ones(n, bool)
    out[place], free[place] = rest, False
    out[free] = ordered
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int, block: int = 1 << 15) -> np.ndarray:
    """Which of the ``starts`` begin a string of ``length`` bytes that another of them begins too: suffixes in order, each
    compared with its neighbour. Every start must have ``length`` bytes behind it."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_order(text.astype(np.int32) + 1)
    order = order[wanted[order]]
    views = np.lib.stride_tricks.sliding_window_view(text, length)
    again = np.zeros(len(text), bool)
    for at in range(0, len(order) - 1, block):
        a, b = order[at : min(at + block, len(order) - 1)], order[at + 1 : at + 1 + block]
        close = np.flatnonzero((text[a + length - 1] == text[b + length - 1]) & (text[a] == text[b]))
        same = close[(views[a[close]] == views[b[close]]).all(axis=1)]
        again[a[same]] = again[b[same]] = True
    return again[starts]
