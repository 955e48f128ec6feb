"""Suffix arrays by induced sorting, and their permuted longest common prefixes, in whole-array steps.

The text is an array of small numbers that ends with a 0 found nowhere else. Suffixes smaller than their
right neighbour are S, larger ones L; an S after an L is leftmost-smaller (LMS). LMS substrings are sorted by
induction and named; if names repeat, the string of names is sorted by recursion (names beyond a small
alphabet are written as two digits first), and the sorted LMS suffixes induce all others. Induction runs
bucket by bucket: what a bucket's suffixes induce is dealt to the other buckets by one stable sort, so every
suffix is moved once a pass and the time is linear.
"""

from __future__ import annotations

import numpy as np

#: Names beyond so many are written as two digits, so that buckets stay few.
MAX_ALPHABET = 1024


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S; equal neighbours share their type."""
    ends = np.flatnonzero(t[:-1] != t[1:])
    out = np.ones(len(t), bool)
    out[:-1] = np.repeat(t[ends] < t[ends + 1], np.diff(ends, prepend=-1))
    return out


def _ranks(groups: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The place of each item within its group; groups are sorted."""
    return np.arange(len(groups)) - (np.cumsum(counts) - counts)[groups]


def induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the LMS suffixes in the order of `lms`."""
    n, buckets = len(t), len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.empty(n, np.int32)
    by = np.argsort(t[lms], kind="stable")
    first = t[lms][by]
    counts = np.bincount(first, minlength=buckets)
    lms_start = ends - counts
    sa[lms_start[first] + _ranks(first, counts)] = lms[by]

    def before(block: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray]:
        p = block[block > 0] - 1
        p = p[small[p] == kind]
        return p, t[p]

    def dealt(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(c, kind="stable")
        c = c[by]
        counts = np.bincount(c, minlength=buckets)
        return p[by], c, counts, _ranks(c, counts)

    head = starts.copy()
    used = np.flatnonzero(sizes)
    for b in used:
        parts, done = [before(sa[lms_start[b] : ends[b]], False)], starts[b]
        own = []
        while done < head[b]:
            p, c = before(sa[done : head[b]], False)
            done, same = head[b], c == b
            k = np.count_nonzero(same)
            if k:
                sa[head[b] : head[b] + k] = p[same]
                head[b] += k
                p, c = p[~same], c[~same]
            own.append((p, c))
        p, c, counts, rank = dealt(own + parts)
        sa[head[c] + rank] = p
        head += counts
    tail = ends.copy()
    tail[0] -= 1
    sa[0] = n - 1
    for b in used[::-1]:
        parts, done = [], ends[b]
        while done > tail[b]:
            p, c = before(sa[tail[b] : done][::-1], True)
            done, same = tail[b], c == b
            k = np.count_nonzero(same)
            if k:
                sa[tail[b] - k : tail[b]] = p[same][::-1]
                tail[b] -= k
                p, c = p[~same], c[~same]
            parts.append((p, c))
        parts.append(before(sa[starts[b] : head[b]][::-1], True))
        p, c, counts, rank = dealt(parts)
        sa[tail[c] - 1 - rank] = p
        tail -= counts
    return sa


def named(t: np.ndarray, order: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Names from 0 of the substrings at `order`, sorted; equal ones share a name."""
    new = np.ones(len(order), bool)
    alike = np.flatnonzero(lengths[1:] == lengths[:-1])
    sizes = lengths[alike].astype(np.int64)
    if len(alike):
        at = np.cumsum(sizes) - sizes
        shift = np.arange(sizes.sum()) - np.repeat(at, sizes)
        differ = t[np.repeat(order[alike], sizes) + shift] != t[np.repeat(order[alike + 1], sizes) + shift]
        new[alike + 1] = np.logical_or.reduceat(differ, at)
    return np.cumsum(new) - 1


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of the suffixes of t in order; t holds numbers below `alphabet` and ends with its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    small = smaller_than_next(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    sizes = np.bincount(t, minlength=alphabet)
    marked = np.zeros(n, bool)
    marked[lms] = True
    sa = induced(t, small, lms, sizes)
    order = sa[marked[sa]]
    place = np.empty(n, np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    lengths = np.append(np.diff(lms) + 1, 1)
    names = named(t, order, lengths[place[order]])
    kinds = int(names[-1]) + 1
    if kinds < len(lms):
        shorter = np.empty(len(lms), np.int64)
        shorter[place[order]] = names
        if kinds <= MAX_ALPHABET:
            ranked = suffix_array(shorter.astype(np.uint16), kinds)
        else:
            base = int(np.ceil(np.sqrt(kinds)))
            digits = np.zeros(2 * len(lms) - 1, np.uint16 if base < 1 << 16 else np.int64)
            digits[0:-1:2], digits[1:-1:2] = shorter[:-1] // base + 1, shorter[:-1] % base + 1
            ranked = suffix_array(digits, base + 1)
            ranked = ranked[ranked % 2 == 0] // 2
        order = lms[ranked]
    return induced(t, small, order, sizes)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each suffix, the symbols it shares with its predecessor in order, at most `room` of them.

    Where both follow the same symbol the value is that of the suffix before, less one; only the others are
    compared, eight symbols at a time. room falls by one from each suffix to the next, or starts anew at a
    stop (where it is 0). t holds bytes.
    """
    n = len(t)
    previous = np.empty(n, np.int64)
    previous[sa[1:]], previous[sa[0]] = sa[:-1], -1
    i = np.arange(n)
    free = np.ones(n, bool)
    free[1:] = (previous[1:] <= 0) | (t[:-1] != t[np.maximum(previous[1:] - 1, 0)]) | (room[:-1] == 0)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int64)
    active = np.flatnonzero(free & (previous >= 0) & (room > 0))
    while len(active):
        a, b = active + out[active], previous[active] + out[active]
        inside = np.maximum(a, b) < n
        differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        out[active] += np.where(inside, same, 0)
        active = active[inside & (differ == 0) & (out[active] < room[active])]
    last = np.maximum.accumulate(np.where(free, i, 0))
    return np.minimum(out[last] - (i - last), room)


def later_repeats(sa: np.ndarray, prefixes: np.ndarray, length: int) -> np.ndarray:
    """Starts of the substrings of `length` symbols that also start earlier, in no order."""
    near = prefixes[sa] >= length
    near[0] = False
    some = near.copy()
    some[:-1] |= near[1:]
    starts = sa[some]
    if not len(starts):
        return starts
    heads = ~near[some]
    least = np.minimum.reduceat(starts, np.flatnonzero(heads))
    return starts[starts != least[np.cumsum(heads) - 1]]
