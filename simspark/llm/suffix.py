"""Suffix arrays with common-prefix lengths by external induced sorting.

Suffixes of type L and S are induced from the sorted leftmost-S suffixes: a queue ordered by first character and arrival holds
tuples (position, common prefix with the tuple before), spills to disk beyond a bound, and each popped suffix hands its tuple to the
suffix one place to the left. The common prefix of two neighbours in a bucket is one more than the minimum over what was popped
between their origins. Leftmost-S suffixes are sorted by naming their substrings and recursing on the names.

Everything is done on arrays: all suffixes of a bucket that can be popped together are one block.
Code 0 separates strings; each separator counts as a character of its own, so no common prefix reaches across one.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from simspark.llm.common import RollingHash

#: Tuples that a queue keeps in memory, and names up to which a reduced string is sorted in memory.
IN_MEMORY, BASE = 1 << 18, 1 << 22
_hash = RollingHash(7, 0)


class BucketQueue:
    """A priority queue of (position, common prefix), ordered by bucket, then by arrival. The fullest buckets spill to disk."""

    def __init__(self, buckets: int, limit: int = IN_MEMORY):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(buckets)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]
        self.counts = np.zeros(buckets, np.int64)
        self.limit, self.total, self.file = limit, 0, None

    def push(self, bucket: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.held[bucket].append((at, lcp))
        self.counts[bucket] += len(at)
        self.total += len(at)
        while self.total > self.limit:
            self._spill(int(np.argmax(self.counts)))

    def _spill(self, bucket: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # scratch of this task; it has no name and goes with the process
        for at, lcp in self.held[bucket]:
            self.file.seek(0, os.SEEK_END)
            self.spilled[bucket].append((self.file.tell(), len(at)))
            self.file.write(at.astype(np.int64).tobytes() + lcp.astype(np.uint16).tobytes())
        self.held[bucket] = []
        self.total -= int(self.counts[bucket])
        self.counts[bucket] = 0

    def pop(self, bucket: int):
        """Blocks of the bucket in order of arrival; the bucket is empty afterwards."""
        for start, n in self.spilled[bucket]:
            self.file.seek(start)
            yield np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.uint16)
        held, self.held[bucket], self.spilled[bucket] = self.held[bucket], [], []
        self.total -= int(self.counts[bucket])
        self.counts[bucket] = 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))


def _range_min(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """min(values[start:stop]) for ranges that aren't empty."""
    size = stop - start
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[start[here]], table[stop[here] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


class _Inducer:
    """Hands popped suffixes on to their left neighbours. common: whether common prefixes are wanted; else they are 0."""

    def __init__(self, text: np.ndarray, small: np.ndarray, buckets: int, cap: int, want_small: bool, limit: int, common: bool):
        self.text, self.cap, self.common, self.queue = text, cap, common, BucketQueue(buckets, limit)
        self.left = np.append(False, ((small == want_small) & (text != 0))[:-1])  # whether the left neighbour is of the wanted type
        self.low = np.full(buckets, cap, np.uint16)

    def block(self, at: np.ndarray, lcp: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Push the left neighbours of a popped block; those that stay in its bucket are returned."""
        if not len(at):
            return None
        chosen = np.flatnonzero(self.left[at])
        kept = None
        if len(chosen):
            moved = at[chosen] - 1
            code = self.text[moved]
            order = np.argsort(code, kind="stable")
            chosen, code, moved = chosen[order], code[order], moved[order]
            cuts = np.flatnonzero(code[1:] != code[:-1]) + 1
            firsts, lasts = np.append(0, cuts), np.append(cuts, len(code)) - 1
            heads = code[firsts]
            new = self._common(lcp, chosen, firsts, lasts, heads) if self.common else np.zeros(len(chosen), np.uint16)
            for a, b, c in zip(firsts.tolist(), (lasts + 1).tolist(), heads.tolist()):
                if c == bucket:
                    kept = moved[a:b], new[a:b]
                else:
                    self.queue.push(c, moved[a:b], new[a:b])
        elif self.common:
            self.low = np.minimum(self.low, lcp.min())
        return kept

    def _common(self, lcp: np.ndarray, chosen: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The common prefix of each pushed suffix with the one pushed to its bucket before."""
        since = np.append(0, chosen[:-1] + 1)
        since[firsts] = 0
        new = _range_min(lcp, since, chosen + 1)
        new[firsts] = np.minimum(new[firsts], self.low[heads])
        new = np.minimum(new, self.cap - 1) + np.uint16(1)
        self.low = np.minimum(self.low, lcp.min())
        tail = chosen[lasts] + 1
        rest = np.full(len(tail), self.cap, np.uint16)
        some = np.flatnonzero(tail < len(lcp))
        if len(some):
            rest[some] = _range_min(lcp, tail[some], np.full(len(some), len(lcp)))
        self.low[heads] = rest
        return new

    def bucket(self, bucket: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pop a bucket: first what has arrived in it, then round by round what its own suffixes send to it."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        turn = self.queue.pop(bucket)
        while True:
            later = []
            for at, lcp in turn:
                if not found:
                    lcp = lcp.copy()
                    lcp[0] = 0
                found.append((at, lcp))
                if (kept := self.block(at, lcp, bucket)) is not None:
                    later.append(kept)
            if not later:
                return found
            turn = later


def _induce(text: np.ndarray, small: np.ndarray, run: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, buckets: int, cap: int, limit: int, common: bool = True):
    """(suffixes in order without separators, common prefix of each with the one before) from sorted leftmost-S suffixes. common: else the second means nothing."""
    code = text[seeds]
    at = np.searchsorted(code, np.arange(buckets + 1))
    large: list[tuple[np.ndarray, np.ndarray]] = []
    kept = np.int32 if len(text) < 2**31 else np.int64  # places that wait take no more than they need
    up = _Inducer(text, small, buckets, cap, False, limit, common)
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint16)
    for c in range(buckets):
        found = up.bucket(c)
        large.append((np.concatenate([x[0] for x in found], dtype=kept), np.concatenate([x[1] for x in found])) if found else empty)
        pos, lcp = seeds[at[c] : at[c + 1]], seed_lcp[at[c] : at[c + 1]].copy()
        if len(pos):
            lcp[0] = min(run[large[c][0][-1]], run[pos[0]], cap) if len(large[c][0]) else 0
            if c == 0:
                lcp[:] = 0
            up.block(pos, lcp, c)
    del up
    down = _Inducer(text, small, buckets, cap, True, limit, common)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(buckets - 1, 0, -1):
        found = down.bucket(c)
        pos, lcp = tuple(np.concatenate(x) for x in zip(*found)) if found else empty
        big, big_lcp = large[c][0].astype(np.int64), large[c][1]
        meet = min(run[pos[-1]], run[big[-1]], cap) if len(pos) and len(big) else 0
        if len(big):
            back = np.empty(len(big), np.uint16)
            back[0], back[1:] = meet, big_lcp[:0:-1]
            down.block(big[::-1], back, c)
        # rising order: L suffixes, then S suffixes; each with the common prefix to the one before
        joined = np.concatenate([big_lcp, np.append(lcp[1:], np.uint16(meet))[::-1] if len(pos) else lcp])
        out.append((np.concatenate([big, pos[::-1]], dtype=kept), joined))
        large[c] = empty
    out.reverse()
    return (np.concatenate([x[0] for x in out], dtype=np.int64), np.concatenate([x[1] for x in out])) if out else empty


def _order_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling, in memory; by tripling where three ranks fit into one key."""
    n = len(names)
    rank, step, times = names.astype(np.int64), 1, 3 if n + 2 < 1 << 21 else 2
    while True:
        key = rank
        for k in range(1, times):
            key = key * (n + 2)
            key[: max(0, n - k * step)] += rank[k * step :] + 1
        order = np.argsort(key)
        key = key[order]
        fresh = np.append(0, np.cumsum(key[1:] != key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= times


#: A common prefix is looked for below this first, unless all is common; pairs that are looked at together.
NEAR, PAIRS = 16, 1 << 16


def _common_prefixes(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes at a and at b, at most `most`, by bisection on hashes of equal lengths."""
    before_a, before_b, up_a, up_b = prefix[a], prefix[b], _hash.up[a], _hash.up[b]

    def same(which: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (prefix[a[which] + size] - before_a[which]) * up_a[which] == (prefix[b[which] + size] - before_b[which]) * up_b[which]

    found = most.copy()
    left = np.flatnonzero(~same(np.arange(len(a)), most))
    low, high = np.zeros(len(left), np.int64), most[left] - 1
    mid = np.minimum(high, NEAR)
    while len(left):
        hit = same(left, mid)
        low, high = np.where(hit, mid, low), np.where(hit, high, mid - 1)
        done = low >= high
        found[left[done]] = low[done]
        left, low, high = left[~done], low[~done], high[~done]
        mid = (low + high + 1) // 2
    return found


def suffix_array(text: np.ndarray, cap: int, limit: int = IN_MEMORY, base: int = BASE, names: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in rising order, common prefix of each with the one before, at most cap) of the strings in text.

    text: non-negative codes that end with a separator, 0. Separators themselves are left out. names: the text is a string of names.
    """
    n = len(text)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    if text.dtype == np.uint8:
        present = np.bincount(text, minlength=256) > 0
        text, buckets = (np.cumsum(present) - 1).astype(np.uint8)[text], int(present.sum())
    else:
        used, text = np.unique(text, return_inverse=True)
        text, buckets = text.ravel().astype(np.uint8 if len(used) <= 256 else np.int32), len(used)
    # type of each suffix: that of the first later place where neighbours differ; separators are S
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    size = np.diff(change, prepend=-1)
    last = np.repeat(change.astype(np.int32 if n < 2**31 else np.int64), size)  # last place of the run that a place stands in
    run = last - np.arange(n, dtype=last.dtype) + 1
    after = np.repeat(np.append(text, text.dtype.type(0))[change + 1], size)
    del last, change, size
    small = (after > text) | (text == 0)
    small[-1] = True
    del after
    zero = text == 0
    run[zero] = 1
    seeds = np.flatnonzero((small & np.append(False, ~small[:-1])) | zero)
    rough = seeds[np.argsort(text[seeds], kind="stable")]
    order, _ = _induce(text, small, run, rough, np.zeros(len(rough), np.uint16), buckets, cap, limit, common=False)
    # name the substrings between leftmost-S places
    is_seed = np.zeros(n, bool)
    is_seed[seeds] = True
    sorted_ = np.concatenate([np.flatnonzero(zero), order[is_seed[order]]])
    del order, is_seed, rough
    prefix = _hash.prefix(text)
    which = np.searchsorted(seeds, sorted_)
    stop = np.append(seeds[1:], n - 1)[which] + 1
    value = _hash.span(prefix, sorted_, stop)
    fresh = np.ones(len(sorted_), bool)
    ends_text = zero[stop - 1] | zero[sorted_]
    fresh[1:] = (value[1:] != value[:-1]) | ends_text[1:] | ends_text[:-1]
    name = np.cumsum(fresh)
    del stop, value, fresh, ends_text
    if name[-1] < len(sorted_):
        reduced = np.empty(len(seeds), np.int64)
        reduced[which] = name
        del name, which
        if len(reduced) <= base:
            sorted_ = seeds[_order_names(reduced)]
        else:
            inner, _ = suffix_array(np.append(reduced, 0), 1, limit, base, True)
            sorted_ = seeds[inner]
        del reduced
    # common prefixes of neighbours among them, by bisection on hashes within their strings
    ends = np.flatnonzero(zero)
    lcp = np.zeros(len(sorted_), np.uint16)
    if not names and len(sorted_) > 1:
        for k in range(1, len(sorted_), PAIRS):
            both = sorted_[k - 1 : k + PAIRS]
            to_end = ends[np.searchsorted(ends, both)] - both
            lcp[k : k + PAIRS] = _common_prefixes(prefix, both[1:], both[:-1], np.minimum(np.minimum(to_end[1:], to_end[:-1]), cap))
    del prefix
    return _induce(text, small, run, sorted_, lcp, buckets, cap, limit)


def repeated_starts(text: np.ndarray, length: int, **options) -> np.ndarray:
    """Places whose next `length` codes also start somewhere else, without reaching across a separator."""
    order, lcp = suffix_array(text, length, **options)
    long = lcp >= length
    hit = long.copy()
    hit[:-1] |= long[1:]
    return np.sort(order[hit])
