"""Suffix arrays by induced sorting, with numpy doing each bucket's work at once."""

from __future__ import annotations

import numpy as np



def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes of the byte string t at a and at b share from their begins, up to `most`; eight are compared at a time."""
    raw = t.tobytes() + bytes(8)
    eight = np.ndarray((len(t) + 1,), dtype="<u8", buffer=raw, strides=(1,))
    out = np.zeros(len(a), dtype=np.int64)
    on = np.flatnonzero(most > 0)
    while len(on):
        other = eight[a[on] + out[on]] ^ eight[b[on] + out[on]]
        out[on] += np.where(other == 0, 8, np.bitwise_count((other & -other) - np.uint64(1)).astype(np.int64) >> 3)
        on = on[(other == 0) & (out[on] < most[on])]
    return np.minimum(out, most)


def smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S type); the last one is."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
    out = np.ones(n, dtype=bool)
    inside = nxt < n - 1
    out[:-1][inside] = step[nxt[inside]] > 0
    return out


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the leftmost smaller suffixes in the order given; starts: where buckets begin."""
    n, sigma = len(t), len(starts) - 1
    sa = np.full(n, -1, dtype=np.int64)
    head, tail = starts[:-1].copy(), starts[1:].copy()
    by = np.argsort(t[lms], kind="stable")
    seeds, symbol = lms[by], t[lms][by]
    edges = np.searchsorted(symbol, np.arange(sigma + 1))
    used = np.flatnonzero(np.diff(starts))

    def place(items: np.ndarray, c: int, wanted: bool, step: int) -> np.ndarray:
        """What items induce, in order: L types to the heads of their buckets, S types to the tails; those of bucket c come back."""
        before = items[items > 0] - 1
        before = before[s[before] == wanted]
        if not len(before):
            return before
        to = t[before]
        order = np.argsort(to, kind="stable")
        before, to = before[order], to[order]
        cuts = np.flatnonzero(np.diff(to)) + 1
        lengths = np.diff(np.concatenate([[0], cuts, [len(to)]]))
        symbols = to[np.concatenate([[0], cuts])]
        within = np.arange(len(to)) - np.repeat(np.concatenate([[0], cuts]), lengths)
        if step > 0:
            sa[head[to] + within] = before
            head[symbols] += lengths
        else:
            sa[tail[to] - 1 - within] = before
            tail[symbols] -= lengths
        return before[to == c]

    for c in used:  # larger suffixes, ascending
        items = sa[starts[c] : head[c]]
        while len(items):
            items = place(items, c, False, 1)
        place(seeds[edges[c] : edges[c + 1]], -1, False, 1)
    for c in used[::-1]:  # smaller suffixes, descending: a bucket's S part first, from its end, then its L part
        items = sa[tail[c] : starts[c + 1]][::-1]
        while len(items):
            items = place(items, c, True, -1)
        place(sa[starts[c] : head[c]][::-1], -1, True, -1)
    sa[0] = n - 1  # the end itself follows from nothing
    return sa


def _doubled(t: np.ndarray) -> np.ndarray:
    """A suffix array by doubling ranks: for reduced strings, whose symbols are about as many as their places."""
    n, rank, k = len(t), t.astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        both = rank * (n + 2) + after
        order = np.argsort(both)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t, a byte string of which the last byte is the only 0."""
    if len(t) <= 2:
        return np.argsort(t, kind="stable")
    s = smaller(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(t))])
    # the first induction sorts the leftmost smaller substrings, whatever the order of the seeds
    sa = _induce(t, s, lms, starts)
    is_lms = np.zeros(len(t), dtype=bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    size = np.zeros(len(t), dtype=np.int64)
    size[lms] = np.minimum(np.append(lms[1:], len(t) - 1) + 1, len(t)) - lms
    a, b = ordered[1:], ordered[:-1]
    names = np.concatenate([[0], np.cumsum((size[a] != size[b]) | (common(t, a, b, np.minimum(size[a], size[b])) < size[a]))])
    named = np.empty(len(t), dtype=np.int64)
    named[ordered] = names
    if names[-1] + 1 < len(lms):
        ordered = lms[_doubled(named[lms])]
    return _induce(t, s, ordered, starts)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In text order: how many symbols each suffix shares with the one before it in sa, and where that one begins.

    left: how many symbols from a place on count; 0 at a separator. A value whose preceding symbols are equal is one less
    than the value before it, so only the others are compared.
    """
    n = len(t)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = sa[0]
    follows = np.zeros(n, dtype=bool)
    follows[1:] = (before[1:] > 0) & (t[:-1] == t[before[1:] - 1]) & (left[:-1] > 0)
    own = np.flatnonzero(~follows)
    value = np.zeros(n, dtype=np.int64)
    value[own] = common(t, own, before[own], np.minimum(left[own], left[before[own]]))
    last = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return value[last] - (np.arange(n) - last), before


def repeated(t: np.ndarray, width: int, left: np.ndarray) -> np.ndarray:
    """True at the places of t at which a string of `width` symbols, none of them a separator, begins that begins elsewhere in t too."""
    prefixes, before = permuted_prefixes(t, suffix_array(t), left)
    out = prefixes >= width
    out[before[out]] = True
    return out
