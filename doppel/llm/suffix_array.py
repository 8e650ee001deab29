"""Suffix arrays by induced sorting and permuted common prefixes, as array passes.

The steps are those of induced sorting: classify the suffixes, sort the leftmost-
smaller (LMS) substrings, name them, sort the string of names recursively, induce
the rest. A bucket's entries are taken in waves: what is known of the bucket gives
entries of later buckets at once, and those of the same bucket in the next wave, so
the number of passes is the alphabet's size plus the longest runs, and the work is
linear.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol is the unique smallest."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    decides = np.where(step != 0, np.arange(n - 1), n - 1)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    return np.append(np.append(step, 1)[decides] > 0, True)


def _spread(sa: np.ndarray, at: np.ndarray, symbols: np.ndarray, entries: np.ndarray, down: bool) -> None:
    """Put entries, in order, at the ends ``at`` of their symbols' buckets."""
    order = np.argsort(symbols, kind="stable")
    symbols, entries = symbols[order], entries[order]
    counts = np.bincount(symbols, minlength=len(at))
    rank = np.arange(len(symbols)) - (np.cumsum(counts) - counts)[symbols]
    if down:
        sa[at[symbols] - rank] = entries
        at -= counts
    else:
        sa[at[symbols] + rank] = entries
        at += counts


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The suffix array that the given order of the LMS suffixes leads to."""
    n, size = len(t), len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    seeds = lms[np.argsort(t[lms], kind="stable")]
    seed_at = np.concatenate([[0], np.cumsum(np.bincount(t[lms], minlength=size))])
    present = np.flatnonzero(counts)
    head = starts.copy()
    for c in present.tolist():
        done = starts[c]
        while True:
            wave = sa[done:head[c]]
            last = not len(wave)
            if last:
                wave = seeds[seed_at[c]:seed_at[c + 1]]
            done = head[c]
            p = wave[wave > 0] - 1
            p = p[~smaller[p]]
            if len(p):
                _spread(sa, head, t[p], p, down=False)
            if last:
                break
    larger_end = head
    tail = ends - 1
    for c in present[::-1].tolist():
        done = ends[c] - 1
        while True:
            wave = sa[tail[c] + 1:done + 1][::-1]
            last = not len(wave)
            if last:
                wave = sa[starts[c]:larger_end[c]][::-1]
            done = tail[c]
            p = wave[wave > 0] - 1
            p = p[smaller[p]]
            if len(p):
                _spread(sa, tail, t[p], p, down=True)
            if last:
                break
    # the last suffix has no successor that could induce it
    sa[starts[t[-1]]] = n - 1
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings (in text order) by their sorted order, and how many there are."""
    length = np.append(np.diff(lms) + 1, 1)
    place = np.full(len(t), -1, np.int64)
    place[lms] = np.arange(len(lms))
    sorted_lms = place[order]
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = length[a] == length[b]
    check = np.flatnonzero(same)
    offset = 0
    while len(check):
        ok = t[lms[a[check]] + offset] == t[lms[b[check]] + offset]
        same[check[~ok]] = False
        offset += 1
        check = check[ok]
        check = check[length[a[check]] > offset]
    names = np.empty(len(lms), np.int64)
    names[sorted_lms] = np.concatenate([[0], np.cumsum(~same)])
    return names, int(names.max()) + 1


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """Suffixes of a string over an alphabet about as large as itself: ranks of doubled length."""
    rank, width = t.astype(np.int64), 1
    while True:
        second = np.zeros(len(t), np.int64)
        second[:len(t) - width] = rank[width:] + 1
        key = rank * (int(second.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(len(t), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, width = new, width * 2
        if int(rank.max()) + 1 == len(t) or width >= len(t):
            return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of ``t``, whose symbols are below ``size`` and whose last one, 0, occurs once."""
    if len(t) < 3:
        return np.argsort(t, kind="stable")
    if size > SMALL_ALPHABET:
        return _by_doubling(t)
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(t, minlength=size)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    # any order of the LMS suffixes sorts their substrings; the right order sorts all suffixes
    sa = _induce(t, smaller, lms, counts)
    order = sa[is_lms[sa]]
    names, n = _names(t, lms, order)
    if n < len(lms):
        order = lms[suffix_array(names, n)]
    return _induce(t, smaller, order, counts)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """``plcp[i]``: common prefix of suffix ``i`` and the one before it in the array.

    ``room[i]`` limits it (symbols up to the end of the text's part). Values are
    compared symbol by symbol only where they are not the last one less one, that
    is where the symbols before the two suffixes differ or a part begins.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = sa[0]
    limit = np.minimum(room, room[phi])
    limit[sa[0]] = 0
    i = np.arange(n)
    irreducible = (i == 0) | (phi == 0) | (t[i - 1] != t[phi - 1]) | (room[i - 1] == 0) | (room[phi - 1] == 0) | (limit == 0)
    at = np.flatnonzero(irreducible & (limit > 0))
    value = np.zeros(n, np.int64)
    padded = np.concatenate([t, np.zeros(8, t.dtype)]).astype(np.uint64)
    words = padded[:n].copy()
    # three symbols of up to 16 bits a step; two bits more than a byte keep separators apart
    for k in (1, 2, 3):
        words |= padded[k:n + k] << np.uint64(16 * k)
    while len(at):
        x, y = at + value[at], phi[at] + value[at]
        ok = np.zeros(len(at), bool)
        inside = (x < n) & (y < n)
        ok[inside] = words[x[inside]] == words[y[inside]]
        more = at[~ok]
        value[at[ok]] += 4
        # the first differing symbol of the last step
        for _ in range(3):
            x, y = more + value[more], phi[more] + value[more]
            keep = (x < n) & (y < n)
            more, x, y = more[keep], x[keep], y[keep]
            more = more[t[x] == t[y]]
            value[more] += 1
        at = at[ok]
        at = at[value[at] < limit[at]]
    base = np.where(irreducible, np.minimum(value, limit) + i, 0)
    # a reducible value is that of the last irreducible position less the distance
    last = np.maximum.accumulate(np.where(irreducible, i, 0))
    return np.maximum(base[last] - i, 0)
