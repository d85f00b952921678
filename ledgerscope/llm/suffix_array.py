"""Suffix arrays by induced sorting, a bucket at a time in numpy, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from ledgerscope.llm.common import prefix_sums, span_hashes

#: Alphabets up to this size are induced bucket by bucket; larger ones are ranked by doubling.
BUCKETS = 4096


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than the next one); the last suffix is S-type."""
    n = len(text)
    smaller = np.zeros(n, bool)
    smaller[:-1] = text[:-1] < text[1:]
    smaller[-1] = True
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    at = np.flatnonzero(differs)
    return smaller[at[np.searchsorted(at, np.arange(n))]]


def _put(sa, text, edge, suffixes, step):
    """File suffixes, in order, at the edges of their buckets and move the edges; numpy sorts 16-bit symbols by radix."""
    chars = text[suffixes]
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    new = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    count = np.diff(np.append(new, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(new, count)
    sa[edge[chars] + step * rank] = suffixes[order]
    edge[chars[new]] += step * count


def induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes that the order of the leftmost S-type ones implies."""
    count = np.bincount(text, minlength=sigma)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(len(text), -1, np.int32)
    last = end - 1
    _put(sa, text, last, lms[::-1], -1)
    first = start.copy()
    l_type = ~s_type
    for c in np.flatnonzero(count):
        at = start[c]
        while at < first[c] or at == start[c]:  # L-type suffixes filed here may file more in this bucket
            to = first[c]
            before = sa[at:to] - 1
            before = before[before >= 0]
            before = before[l_type[before]]
            at = to if to > at else at + 1
            if len(before):
                _put(sa, text, first, before, 1)
            elif at >= first[c]:
                break
        before = sa[last[c] + 1 : end[c]] - 1
        before = before[before >= 0]
        before = before[l_type[before]]
        if len(before):
            _put(sa, text, first, before, 1)
    last = end - 1
    for c in np.flatnonzero(count)[::-1]:
        at = end[c] - 1
        while at > last[c]:
            to = last[c]
            before = sa[to + 1 : at + 1][::-1] - 1
            before = before[before >= 0]
            before = before[s_type[before]]
            at = to
            if len(before):
                _put(sa, text, last, before, -1)
        before = sa[start[c] : first[c]][::-1] - 1
        before = before[before >= 0]
        before = before[s_type[before]]
        if len(before):
            _put(sa, text, last, before, -1)
    return sa


def by_doubling(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, ranked by 1, 2, 4, ... symbols until no two are equal."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while k < len(text):
        key = (rank + 1) << 32
        key[:-k] |= rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(new) - 1
        if new.all():
            break
        k *= 2
    return order


def suffix_array(text: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Suffixes of text (small non-negative integers, the last one unique and least) in order.

    Suffixes are classified, leftmost S-type substrings sorted by a first induction and
    named, the string of names sorted by recursion, and all suffixes induced from that.
    A string of more than buckets names is ranked by doubling in place of a further
    recursion, whose loop over buckets would then cost more than it sorts.
    """
    sigma = int(text.max()) + 1
    if len(text) < 3:
        return np.argsort(text, kind="stable").astype(np.int32)
    text = text.astype(np.uint16 if sigma < 1 << 16 else np.int64)
    s_type = suffix_types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) < 2:
        return induce(text, s_type, lms, sigma)
    first = induce(text, s_type, lms, sigma)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    ends = np.append(lms[1:], len(text) - 1) + 1
    name = np.zeros(len(text), np.int64)
    name[lms] = span_hashes(prefix_sums(text), lms, ends).view(np.int64)
    size = np.zeros(len(text), np.int64)
    size[lms] = ends - lms
    new = np.ones(len(ordered), np.int64)
    new[1:] = (name[ordered[1:]] != name[ordered[:-1]]) | (size[ordered[1:]] != size[ordered[:-1]])
    number = np.cumsum(new) - 1
    if number[-1] + 1 < len(lms):
        name[ordered] = number
        reduced = name[lms]
        inner = suffix_array(reduced, buckets) if number[-1] < buckets else by_doubling(reduced)
        ordered = lms[inner]
    return induce(text, s_type, ordered, sigma)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each place, in text order, the symbols it shares with the suffix before it in order, up to left of the place.

    left is how far the place's own string goes; it falls by one at each place inside a
    string. Where the symbols before a place and before its predecessor are equal, the
    prefix is that of the place before less one; only the other, irreducible places are
    compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    fixed = np.ones(n, bool)
    at = np.flatnonzero((before[1:] > 0) & (left[1:] == left[:-1] - 1)) + 1
    fixed[at] = text[at - 1] != text[before[at] - 1]
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(fixed & (before >= 0) & (left > 0))
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    while len(live):
        x, y = live + shared[live], before[live] + shared[live]
        same = np.zeros(len(live), np.int64)
        on = np.ones(len(live), bool)
        for j in range(8):
            on &= padded[x + j] == padded[np.minimum(y + j, n)]
            same += on
        shared[live] = np.minimum(shared[live] + same, left[live])
        live = live[(same == 8) & (shared[live] < left[live])]
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), 0))
    return np.maximum(shared[last] - (np.arange(n) - last), 0)
