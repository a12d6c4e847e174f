"""Induced sorting of suffixes with their common prefixes, on one block of strings.

Strings stand one after the other, each closed by an end mark that is smaller than every byte; a suffix ends at its string's
mark. A suffix is of type S if it is smaller than the one after it, else of type L; an S suffix after an L suffix is a seed.
Seeds are sorted by recursion: their substrings up to the next seed are sorted by one induction and named, and the string of
names is ranked. Two inductions then put all others in place: a sweep over the first bytes in rising order takes each suffix
from its bucket's queue and puts the L suffix before it at the end of that byte's queue, a sweep in falling order does so for S.

A queue's entry carries the length that its suffix has in common with the entry before it: one more than the least such value
between the two suffixes that the entries were made from.
"""

from __future__ import annotations

import numpy as np

_NONE = np.zeros(0, np.int32)
_DEEP = 255  # common prefixes are kept up to this length


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros beyond the end."""
    x = np.zeros(len(data) + 8, np.uint8)
    x[: len(data)] = data
    w = x[:-1].astype(np.uint64) << np.uint64(8) | x[1:]
    w = w[:-2] << np.uint64(16) | w[2:]
    w = w[:-4] << np.uint64(32) | w[4:]
    return w[: len(data)]


class Block:
    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """data: bytes of all strings; ends: where each stops. Adds a mark before the first and after each string."""
        sizes = np.diff(np.concatenate([[0], ends]))
        n = len(data) + len(ends) + 1
        self.shift = np.arange(len(ends), dtype=np.int64) + 1  # marks before a string
        marks = np.concatenate([[0], ends + self.shift])
        self.text = np.zeros(n, np.int16)
        inside = np.ones(n, bool)
        inside[marks] = False
        self.text[inside] = data.astype(np.int16) + 1
        raw = np.zeros(n, np.uint8)
        raw[inside] = data
        self.eight = words8(raw)
        left = np.zeros(n, np.int32)  # bytes from a place to its mark
        place = np.arange(n, dtype=np.int64)
        left[1:] = np.repeat(marks[1:], sizes + 1) - place[1:]
        self.left = left
        t = self.text
        change = np.flatnonzero(np.append(t[1:] != t[:-1], True))
        run_end = change[np.searchsorted(change, place)] if n else place
        self.run = (run_end - place + 1).astype(np.int32)  # equal bytes from here on
        after = np.append(t[1:], -1)[run_end]
        self.small = t < after
        self.small[marks] = True
        before = np.ones(n, bool)
        before[1:] = self.small[:-1]
        self.seed = self.small & ~before
        self.seed[marks] = True

    def common(self, a: np.ndarray, b: np.ndarray, most: int = _DEEP) -> np.ndarray:
        """Length of the common prefix of the suffixes a and b, up to `most`."""
        room = np.minimum(np.minimum(self.left[a], self.left[b]), most)
        out = np.zeros(len(a), np.int32)
        open_, k = np.flatnonzero(room > 0), 0
        while len(open_):
            x = self.eight[a[open_] + k] ^ self.eight[b[open_] + k]
            same = np.full(len(x), 8, np.int32)
            some = x > 0
            # the highest bit that differs tells how many bytes agree
            same[some] = (63 - np.frexp((x[some] >> np.uint64(11)).astype(np.float64))[1] + 1 - 11) >> 3
            low = some & (x >> np.uint64(11) == 0)
            same[low] = np.where(x[low] >> np.uint64(8) > 0, 6, 7)
            out[open_] += same
            k += 8
            open_ = open_[(same == 8) & (room[open_] > k)]
        return np.minimum(out, room)


def _least(lcp: np.ndarray):
    """A function (lo, hi) -> least of lcp[lo:hi], by tables of stretches of powers of two; common prefixes take one byte each."""
    tables = [lcp]
    while len(tables[-1]) > 1 << (len(tables) - 1):
        t, w = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t[:-w], t[w:]))

    def ask(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), np.uint8)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in range(int(level.max()) + 1 if len(level) else 0):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(tables[k][lo[at]], tables[k][hi[at] - (1 << k)])
        return out

    return ask


def _sweep(b: Block, order: range, kind: bool, queues: list, extra, with_lcp: bool) -> list:
    """One induction over the byte values in that order; kind is the type it puts in place.

    queues: for each byte the entries already there. extra(c): entries of the other kind that follow in the bucket. Returns for
    each byte the entries of this kind, in order of the sweep.
    """
    text, small = b.text, b.small
    out = [(_NONE, np.zeros(0, np.uint8))] * len(queues)
    for c in order:
        parts = queues[c]
        pos = np.concatenate([p for p, _ in parts]) if parts else _NONE
        lcp = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.uint8)
        poss, lcps, run = [pos], [lcp], 0
        while len(pos):  # runs of the byte itself: each round's suffixes have one more of it than those of the round before
            prev = pos - 1
            at = np.flatnonzero((text[prev] == c) & (small[prev] == kind))
            if not len(at):
                break
            run += 1
            new = np.zeros(len(at), np.uint8)
            if with_lcp:
                new[0] = min(run, _DEEP)
                new[1:] = np.minimum(_least(lcp)(at[:-1] + 1, at[1:] + 1), _DEEP - 1) + 1
            pos, lcp = prev[at], new
            poss.append(pos)
            lcps.append(lcp)
        pos, lcp = np.concatenate(poss), np.concatenate(lcps)
        out[c] = pos, lcp
        more, more_lcp = extra(c)
        if len(more):
            if with_lcp and len(pos):
                more_lcp = more_lcp.copy()
                more_lcp[0] = min(int(b.run[pos[-1]]), int(b.run[more[0]]), _DEEP)
            pos, lcp = np.concatenate([pos, more]), np.concatenate([lcp, more_lcp])
        if not len(pos):
            continue
        prev = pos - 1
        prev_text = text[prev]
        fit = (small[prev] == kind) & (prev_text != c) & (prev_text > 0) & (pos > 0)
        at = np.flatnonzero(fit)
        if not len(at):
            continue
        byte = prev_text[at]
        by = np.argsort(byte, kind="stable")
        at, byte = at[by], byte[by]
        heads = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        if with_lcp:
            value = np.ones(len(at), np.uint8)
            inner = np.ones(len(at), bool)
            inner[heads] = False
            k = np.flatnonzero(inner)
            if len(k):
                value[k] = np.minimum(_least(lcp)(at[k - 1] + 1, at[k] + 1), _DEEP - 1) + 1
        else:
            value = np.zeros(len(at), np.uint8)
        target = prev[at]
        for lo, hi in zip(heads, np.append(heads[1:], len(at))):
            queues[byte[lo]].append((target[lo:hi], value[lo:hi]))
    return out


def _induce(b: Block, seeds: np.ndarray, lcp: np.ndarray, with_lcp: bool) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, with common prefixes, from the seeds in order. Without lcp: seeds by first byte only."""
    sigma = 257
    first = b.text[seeds]
    cut = np.searchsorted(first, np.arange(sigma + 1))
    seed_of = lambda c: (seeds[cut[c] : cut[c + 1]], lcp[cut[c] : cut[c + 1]])
    larger = _sweep(b, range(sigma), False, [[] for _ in range(sigma)], seed_of, with_lcp)

    def falling(c):
        pos, x = larger[c]
        if not len(pos):
            return pos, x
        return pos[::-1], np.append(np.uint8(1), x[:0:-1])

    smaller = _sweep(b, range(sigma - 1, 0, -1), True, [[] for _ in range(sigma)], falling, with_lcp)
    poss, lcps = [seed_of(0)[0]], [np.zeros(cut[1], np.uint8)]
    for c in range(1, sigma):
        pos, x = larger[c]
        if len(pos):
            poss.append(pos)
            lcps.append(np.append(np.uint8(0), x[1:]))
        up, y = smaller[c]
        if len(up):
            seam = min(int(b.run[pos[-1]]), int(b.run[up[-1]]), _DEEP) if len(pos) else 0
            poss.append(up[::-1])
            lcps.append(np.append(np.uint8(seam), y[:0:-1]))
    return np.concatenate(poss), np.concatenate(lcps)


def sort_suffixes(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes (end marks included) in order, and the common prefix of each with the one before, up to 255.

    Equal suffixes stand side by side in any order.
    """
    seeds = np.flatnonzero(b.seed).astype(np.int32)
    if len(seeds) <= 1:
        return seeds, np.zeros(len(seeds), np.uint8)
    # Sort the seeds' substrings by an induction from the seeds by first byte, and name them in that order.
    by = np.argsort(b.text[seeds], kind="stable")
    rough, _ = _induce(b, seeds[by], np.zeros(len(seeds), np.uint8), False)
    order = rough[b.seed[rough]]
    stop = np.append(seeds[1:], len(b.text) - 1)
    length = np.zeros(len(b.text), np.int32)
    length[seeds] = stop - seeds + 1
    length[b.text == 0] = 0
    x, y = order[:-1], order[1:]
    span = np.minimum(length[x], b.left[x] + 1)
    whole = (length[x] == length[y]) & (b.common(x, y, most=1 << 20) >= np.minimum(span, b.left[x]))
    whole &= np.minimum(span, b.left[x] + 1) == np.minimum(length[y], b.left[y] + 1)
    name = np.zeros(len(b.text), np.int64)
    name[order] = np.cumsum(np.append(0, ~whole))
    rank = name[seeds]
    rank[b.text[seeds] == 0] = 0
    # Rank the string of names: each round looks twice as far, and a string's end mark comes before all names.
    mark = np.cumsum(b.text[seeds] == 0)
    step, count = 1, len(np.unique(rank))
    while True:
        ahead = np.zeros(len(rank), np.int64)
        same = mark[step:] == mark[:-step]
        ahead[:-step][same] = rank[step:][same] + 1
        ahead[b.text[seeds] == 0] = 0
        values, rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)
        if len(values) == count:
            break
        count, step = len(values), 2 * step
        if step >= len(rank):
            break
    seeds = seeds[np.argsort(rank, kind="stable")]
    lcp = np.zeros(len(seeds), np.uint8)
    lcp[1:] = b.common(seeds[:-1], seeds[1:])
    return _induce(b, seeds, lcp, True)
