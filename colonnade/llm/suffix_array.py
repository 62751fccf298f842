"""Suffix arrays by induced sorting, with array operations.

Suffixes are classified as smaller (S) or larger (L) than the one that follows; the leftmost S of a
run is LMS. LMS substrings are sorted and named; if names repeat, the string of names is sorted
recursively. From sorted LMS suffixes all others are induced. At the bottom level that is one linear
scan over the buckets of characters in each direction, a bucket at a time: what a bucket induces is
dealt to its buckets in order. At the levels above, whose alphabets are large, a suffix is ranked by
its symbols up to the next LMS suffix and that suffix's rank, which is the order a scan would induce.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S-type mask, LMS positions) of a string that ends with its unique smallest symbol."""
    n = len(s)
    at = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # where the next different symbol stands
    is_s = np.ones(n, bool)
    is_s[:-1] = s[at] < s[np.minimum(at + 1, n - 1)]
    return is_s, np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _rank_pieces(code: np.ndarray, start: np.ndarray, length: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Dense ranks of the pieces code[start : start + length], equal ones by ``tail``. Several symbols
    go into a word; words are taken from the last to the first, each by the pieces that reach it."""
    bits = int(code.max(initial=0) + 1).bit_length()
    per = 63 // bits
    rank = tail.astype(np.int64)
    for k in range(-(-int(length.max(initial=1)) // per) - 1, -1, -1):
        sub = np.flatnonzero(length > k * per)
        word = np.zeros(len(sub), np.int64)
        for j in range(k * per, (k + 1) * per):
            word <<= bits
            inside = j < length[sub]
            word[inside] |= code[start[sub[inside]] + j] + 1
        order = np.lexsort((rank[sub], word))
        w, r = word[order], rank[sub][order]
        new = np.ones(len(sub), np.int64)
        new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
        rank[sub[order]] = np.cumsum(new)
    return rank - 1 if len(rank) else rank


def _lms_ranks(code: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the LMS suffixes: names of LMS substrings, or the recursion on them."""
    length = np.diff(lms, append=lms[-1]) + 1
    names = _rank_pieces(code, lms, length, np.zeros(len(lms), np.int64))
    if names.max() + 1 == len(names):
        return names
    return _suffix_ranks(names)


def _suffix_ranks(s: np.ndarray) -> np.ndarray:
    """The rank of every suffix of a string of names that ends with its unique smallest."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s, lms = _types(s)
    code = 2 * s.astype(np.int64) + is_s
    ranks = _lms_ranks(code, lms)
    here = np.arange(n)
    after = np.searchsorted(lms, here, side="right")
    after[-1] = len(lms) - 1
    length = lms[after] - here + 1
    tail = ranks[after] + 1
    tail[-1] = 0
    return _rank_pieces(code, here, length, tail)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of a string of small symbols in order. The last symbol must be 0 and occur there only."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s, lms = _types(s)
    ranks = _lms_ranks(2 * s.astype(np.int64) + is_s, lms)
    seeds = lms[np.argsort(ranks)]
    sigma = int(s.max()) + 1
    count = np.bincount(s, minlength=sigma)
    end = np.cumsum(count)
    sa = np.empty(n, np.int64)
    # LMS suffixes by character, in order
    seed_of = s[seeds]
    seeds = seeds[np.argsort(seed_of, kind="stable")]
    seed_end = np.cumsum(np.bincount(seed_of, minlength=sigma))

    def deal(at: np.ndarray, into: np.ndarray, step: int) -> None:
        """Append suffixes to the buckets of their characters: upward from the heads, or downward."""
        ch = s[at]
        order = np.argsort(ch, kind="stable")
        at, ch = at[order], ch[order]
        n_of = np.bincount(ch, minlength=sigma)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        sa[into[ch] + step * place] = at
        into += step * n_of

    is_l = ~is_s
    head = end - count
    large = head.copy()  # next free place for L
    for c in range(sigma):
        if not count[c]:
            continue
        done, out = int(head[c]), []
        while done < large[c]:  # what a bucket induces in itself is its next wave
            wave = sa[done : large[c]]
            done = int(large[c])
            prior = wave[wave > 0] - 1
            prior = prior[is_l[prior]]
            same = s[prior] == c
            own = prior[same]
            sa[done : done + len(own)] = own
            large[c] += len(own)
            out.append(prior[~same])
        own = seeds[seed_end[c - 1] if c else 0 : seed_end[c]]
        out.append(own[own > 0] - 1)  # before an LMS suffix stands an L
        deal(np.concatenate(out), large, 1)
    small = end - 1  # next free place for S, downward
    for c in range(sigma - 1, -1, -1):
        if not count[c]:
            continue
        done, out = int(end[c]) - 1, []
        while done > small[c]:
            wave = sa[small[c] + 1 : done + 1][::-1]
            done = int(small[c])
            prior = wave[wave > 0] - 1
            prior = prior[is_s[prior]]
            same = s[prior] == c
            own = prior[same]
            sa[done - len(own) + 1 : done + 1] = own[::-1]
            small[c] -= len(own)
            out.append(prior[~same])
        own = sa[head[c] : large[c]][::-1]  # then the bucket's L suffixes
        prior = own[own > 0] - 1
        out.append(prior[is_s[prior]])
        deal(np.concatenate(out), small, -1)
    sa[0] = n - 1  # the sentinel alone has its character
    return sa


def common_prefixes(s: np.ndarray, order: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: by position, how many symbols a suffix shares with the one before it
    in ``order`` (some or all positions, sorted). limit: by position, where comparing stops.

    If the suffix one symbol earlier shares L symbols with a neighbour that is also one earlier, this
    one shares L - 1; only where that chain breaks are symbols compared, eight at a time."""
    n = len(s)
    before = np.full(n + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    at = np.sort(order[1:])
    prev = before[at]
    chained = (at > 0) & (prev > 0)
    chained &= (before[at - 1] == prev - 1) & (before[at - 1] >= 0)
    chained &= s[at - 1] == s[prev - 1]
    chained &= (limit[np.maximum(at - 1, 0)] == limit[at]) & (limit[np.maximum(prev - 1, 0)] == limit[np.maximum(prev, 0)])
    share = np.zeros(n, np.int64)
    fresh = at[~chained]
    a, b = fresh.copy(), before[fresh]
    left = np.minimum(limit[a] - a, limit[b] - b)
    pad = np.concatenate([s, np.zeros(8, s.dtype)])
    live = np.flatnonzero(left > 0)
    got = np.zeros(len(fresh), np.int64)
    while len(live):
        x, y = a[live] + got[live], b[live] + got[live]
        run = np.zeros(len(live), np.int64)
        same = np.ones(len(live), bool)
        for j in range(8):
            same &= pad[x + j] == pad[y + j]
            run += same
        got[live] += run
        live = live[(run == 8) & (got[live] < left[live])]
    share[fresh] = np.minimum(got, left)
    # along a chain one less at each step
    first = np.maximum.accumulate(np.where(~chained, np.arange(len(at)), 0))
    share[at] = share[at[first]] - (at - at[first])
    return share
