"""Two-stage suffix sorting in NumPy.

Suffixes that are smaller than their successors are sorted directly, by words of
eight bytes up to a depth; every other suffix T[i:] = c + T[i+1:] is induced: the
buckets of first bytes are scanned in ascending order, and in each the larger-
than-successor suffixes take the order of their successors, which are placed by
then, and stand before the directly sorted ones.
"""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from every place as big-endian numbers; zeros after the end."""
    data = np.append(data, np.zeros(pad + 8, np.uint8))
    return np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))


def _direct(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places at, ordered by the text from there, up to depth bytes."""
    key = words[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(at) else np.zeros(0, np.int64)
    for offset in range(8, depth, 8):
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        t = np.flatnonzero(tied)
        if not len(t):
            break
        key = words[at[t] + offset].astype(np.uint64)
        order = np.lexsort((key, group[t]))
        g, key = group[t], key[order]  # groups are in order, so they stay in place
        at[t] = at[t][order]
        fresh = np.append(True, (g[1:] != g[:-1]) | (key[1:] != key[:-1]))
        # new group numbers: the place of each new group's first member, which keeps the order
        group[t] = np.maximum.accumulate(np.where(fresh, t, -1)) + len(at) + 1
        group = np.cumsum(np.append(True, group[1:] != group[:-1]))
    return at


def suffix_array(data: np.ndarray, depth: int = 104) -> np.ndarray:
    """Places of all suffixes in order of their first ``depth`` bytes (at least)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    words = _words(data, depth)
    step = np.sign(np.diff(data.astype(np.int16), append=np.int16(-1)))  # > 0: smaller than its successor
    differs = np.where(step != 0, np.arange(n), n)
    differs = np.minimum.accumulate(differs[::-1])[::-1]
    small = step[differs] > 0
    counts = np.bincount(data, minlength=256)
    begins = np.cumsum(counts) - counts
    sa = np.empty(n, np.int64)
    rank = np.full(n + 1, -1, np.int64)
    direct = _direct(words, np.flatnonzero(small), depth)
    first = data[direct]
    heads = np.searchsorted(first, np.arange(257))
    for c in np.flatnonzero(counts):  # the place of a directly sorted suffix is known from the start
        own = direct[heads[c] : heads[c + 1]]
        end = begins[c] + counts[c]
        sa[end - len(own) : end] = own
        rank[own] = np.arange(end - len(own), end)
    large = np.flatnonzero(~small)
    large = large[np.argsort(data[large], kind="stable")]
    heads = np.searchsorted(data[large], np.arange(257))
    for c in np.flatnonzero(counts):
        own = large[heads[c] : heads[c + 1]]
        # successors in smaller buckets are placed; those in this one follow, one step of a run at a time
        here = own[differs[own] == own]
        here = here[np.argsort(rank[here + 1], kind="stable")]
        place = begins[c]
        while len(here):
            sa[place : place + len(here)] = here
            rank[here] = np.arange(place, place + len(here))
            place += len(here)
            here = here[here > 0] - 1
            here = here[(data[here] == c) & ~small[here]]
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int = 100) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in sa, up to ``most``; 0 for the first."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    words = _words(data, most)
    live = np.arange(1, n)
    for offset in range(0, most, 8):
        a, b = words[sa[live] + offset].astype(np.uint64), words[sa[live - 1] + offset].astype(np.uint64)
        x = a ^ b
        equal = x == 0
        out[live[equal]] += 8
        rest, x = live[~equal], x[~equal]
        lead = np.zeros(len(rest), np.int64)
        for shift in (56, 48, 40, 32, 24, 16, 8):  # equal leading bytes
            lead += (x >> np.uint64(shift)) == 0
        out[rest] += lead
        live = live[equal]
    room = n - np.maximum(sa, np.append(sa[:1], sa[:-1]))
    return np.minimum(np.minimum(out, most), room)
