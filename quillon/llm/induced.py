"""Suffix order of a shard by induced sorting, with queues that spill to disk.

Suffixes are S or L by comparison with their right neighbour. Left-most S suffixes are named by their substrings and ordered
among themselves; all others are induced from them in two sweeps over the symbols. A sweep keeps one queue a symbol; a queue
hands out its tuples in the order in which they came, which is their sorted order, and past a bound writes them to disk.
The shortened string of names is ordered by doubling ranks, which ends as soon as ``depth`` symbols are told apart: a
vectorised stand-in for a further level of induction.
"""

from __future__ import annotations

import tempfile

import numpy as np


class SymbolQueues:
    """First-in first-out queues of positions, one a symbol; beyond ``limit`` positions in memory the largest goes to disk."""

    def __init__(self, symbols: int, limit: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.sizes = np.zeros(symbols, np.int64)
        self.limit, self.held, self.file = limit, 0, None

    def push(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Appends positions, in their order, to their symbols' queues."""
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for s, part in zip(symbols[np.r_[0, cuts]].tolist() if len(symbols) else [], np.split(positions, cuts)):
            self.parts[s].append(part)
            self.sizes[s] += len(part)
            self.held += len(part)
        while self.held > self.limit:
            self._spill(int(self.sizes.argmax()))

    def _spill(self, s: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        data = np.concatenate([p for p in self.parts[s] if isinstance(p, np.ndarray)])
        at = self.file.seek(0, 2)
        self.file.write(data.tobytes())
        self.parts[s] = [p for p in self.parts[s] if not isinstance(p, np.ndarray)] + [(at, len(data), data.dtype)]
        self.held -= len(data)
        self.sizes[s] = 0

    def take(self, s: int) -> np.ndarray:
        out = []
        for p in self.parts[s]:
            if isinstance(p, tuple):
                self.file.seek(p[0])
                p = np.frombuffer(self.file.read(p[1] * p[2].itemsize), p[2])
            else:
                self.held -= len(p)
            out.append(p)
        self.parts[s], self.sizes[s] = [], 0
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; a run of equal symbols takes the type of its end. The last suffix is L but for its end mark."""
    n = len(t)
    less = np.zeros(n, np.int8)
    less[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    less[-1] = -1
    end = np.where(less != 0, np.arange(n), n)
    end = np.minimum.accumulate(end[::-1])[::-1]
    return less[end] > 0


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _sorted_lms(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    n, m = len(t), len(lms)
    ends = np.append(lms[1:], n - 1)
    length = ends - lms + 1
    coded = np.zeros(n + 6, np.int64)
    coded[:n] = 2 * t.astype(np.int64) + s_type + 1
    name = np.zeros(m, np.int64)
    for at in range(0, int(length.max()), 6):
        word = np.zeros(m, np.int64)
        for k in range(6):
            inside = at + k < length
            word = (word << 10) | np.where(inside, coded[np.minimum(lms + at + k, n - 1)], 0)
        name = _dense(name, word)
        if at > depth:
            break
    span = 1  # names that a rank covers
    while name.max() + 1 < m and span < depth:
        follow = np.full(m, -1, np.int64)
        follow[: max(0, m - span)] = name[span:]
        name = _dense(name, follow)
        span *= 2
    return lms[np.argsort(name, kind="stable")]


def suffix_order(t: np.ndarray, symbols: int, depth: int, limit: int = 4_000_000) -> np.ndarray:
    """Positions of all suffixes in the order of their first ``depth`` symbols at least (``symbols`` is below 510)."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    t64 = t.astype(np.int64)
    found: list[np.ndarray] = [np.empty(0, np.int64)] * symbols
    seeds: list[np.ndarray] = [np.empty(0, np.int64)] * symbols
    if len(lms):
        ordered = _sorted_lms(t, s_type, lms, depth)
        first = t64[ordered]
        cuts = np.searchsorted(first, np.arange(symbols + 1))  # names sort by first symbol
        seeds = [ordered[cuts[c] : cuts[c + 1]] for c in range(symbols)]
    queues = SymbolQueues(symbols, limit)
    queues.push(t64[n - 1 :], np.array([n - 1]))
    for c in range(symbols):
        waves, wave = [], queues.take(c)
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(t64[before] == c) & ~s_type[before]]
        found[c] = np.concatenate(waves) if waves else np.empty(0, np.int64)
        both = np.concatenate([found[c], seeds[c]])
        before = both[both > 0] - 1
        before = before[(t64[before] > c) & ~s_type[before]]
        if len(before):
            queues.push(t64[before], before)
    queues.close()
    queues = SymbolQueues(symbols, limit)
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):  # from the right: the last of each queue is the smallest
        waves, wave = [], queues.take(c)
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(t64[before] == c) & s_type[before]]
        own = np.concatenate([*waves, found[c][::-1]])
        out.append(own)
        before = own[own > 0] - 1
        before = before[(t64[before] < c) & s_type[before]]
        if len(before):
            queues.push(t64[before], before)
    queues.close()
    return np.concatenate(out)[::-1]


def common_prefix_reaches(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether ``depth`` bytes from each of ``a`` equal those from ``b``, compared eight at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    alive = np.arange(len(a))
    for at in [*range(0, depth - 8, 8), depth - 8]:
        x, y = a[alive] + at, b[alive] + at
        alive = alive[(words[x] == words[y])]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out
