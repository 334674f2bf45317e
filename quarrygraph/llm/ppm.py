"""Byte-context tries for prediction by partial matching.

A gram of order k is a byte with the k bytes before it, kept as one integer whose low byte is
the byte coded; cutting high bytes gives its suffixes, so the trie of all orders up to K is the
set of grams of order K. A row starts as if after line feeds. Escape estimation is method C: a
context seen n times with d distinct bytes gives a byte seen c times c/(n+d) and the escape
d/(n+d), unless said otherwise. A context never seen is passed without cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """The gram of the given order (at most 6) that ends at each byte."""
    wide = data.astype(np.uint64)
    out = wide.copy()
    for j in range(1, order + 1):
        out[j:] |= wide[:-j] << np.uint64(8 * j)
    start, size = off[:-1], np.diff(off)
    feeds = np.uint64(sum(10 << (8 * j) for j in range(order + 1)))
    for i in range(order):
        at = start[size > i] + i
        out[at] = (out[at] & _mask(i + 1)) | (feeds & ~_mask(i + 1))
    return out


class Tally:
    """Counts of 64-bit keys, merged as they come in."""

    def __init__(self, most: int = 1_500_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.size += len(k)
        if self.size > self.most:
            merged = self.total()
            self.parts, self.size = [merged], len(merged[0])
            self.most = max(self.most, 2 * self.size)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return merge(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    k, n = keys[order], counts[order]
    if not len(k):
        return k, n
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first)


class Table:
    """Index of each of some distinct keys, by open addressing; lookups are vectorised."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.wrap = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.append(keys, _EMPTY)  # the last is what an empty slot, -1, points to
        self.index = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.index[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            self.index[at] = left[free[first]]
            stay = np.ones(len(left), bool)
            stay[free[first]] = False
            left, slot = left[stay], (slot[stay] + 1) & self.wrap

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for one that isn't there."""
        slot = self._slot(keys)
        out = self.index[slot]
        miss = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.wrap
            out[miss] = now = self.index[slot[miss]]
            miss = miss[(self.keys[now] != keys[miss]) & (now >= 0)]
        return out


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the rows' items, along the first axis, in double precision."""
    out = np.zeros((len(off) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(values, off[full], axis=0, dtype=np.float64)
    return out


def _levels(keys: np.ndarray, counts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, grams, counts) of every order from the lowest; counts may have a column for each class."""
    for k in range(order + 1):
        g, inverse = np.unique(keys & _mask(k + 1), return_inverse=True)
        if counts.ndim == 1:
            c = np.bincount(inverse, counts, len(g))
        else:
            c = np.stack([np.bincount(inverse, col, len(g)) for col in counts.T], axis=1) if counts.shape[1] else np.zeros((len(g), 0))
        yield k, g, c


class Classes:
    """Frozen tries of several classes (languages) over the union of their grams: code lengths
    in bits of bytes under each class, with escapes to shorter contexts and no exclusion."""

    def __init__(self, names: list[str], keys: np.ndarray, counts: np.ndarray, order: int):
        """keys: grams of the given order; counts: a row for each, a column for each class."""
        self.names, self.order = names, order
        self.gram: list[Table] = []
        self.cost: list[np.ndarray] = []
        self.context: list[Table] = []
        self.escape: list[np.ndarray] = []
        below: np.ndarray | None = None
        for k, g, c in _levels(keys, counts, order):
            x, at = np.unique(g >> np.uint64(8), return_inverse=True)
            n = np.zeros((len(x), len(names)))
            d = np.zeros_like(n)
            np.add.at(n, at, c)
            np.add.at(d, at, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
                cost = -np.log2(c / (n + d)[at])
            lower = 8.0 if below is None else below[self.gram[-1](g & _mask(k))]
            below = np.where(c > 0, cost, escape[at] + lower)
            self.gram.append(Table(g))
            self.cost.append(below.astype(np.float32))
            self.context.append(Table(x))
            self.escape.append(escape.astype(np.float32))

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each row under each class."""
        if not len(data):
            return np.zeros((len(off) - 1, len(self.names)))
        g = grams(data, off, self.order)
        at = self.gram[-1](g)
        each = self.cost[-1][at]
        miss = np.flatnonzero(at < 0)
        each[miss] = 0
        for k in range(self.order, -1, -1):
            if not len(miss):
                break
            x = self.context[k]((g[miss] & _mask(k + 1)) >> np.uint64(8))
            each[miss[x >= 0]] += self.escape[k][x[x >= 0]]
            if k == 0:
                each[miss] += 8
                break
            at = self.gram[k - 1](g[miss] & _mask(k))
            each[miss[at >= 0]] += self.cost[k - 1][at[at >= 0]]
            miss = miss[at < 0]
        return row_sums(each, off)


class Trie:
    """A frozen trie with escape estimation and symbol exclusion: after an escape from a context,
    the bytes seen there are taken out of the next shorter context before it is asked. Escapes are
    by method D: a byte seen c of n times gets (2c-1)/2n, the escape after d distinct bytes d/2n.

    Each context's symbols are among those of its suffixes, so what exclusion leaves in the
    suffix depends on the context alone, and is worked out once for each.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, lowest: tuple[np.ndarray, np.ndarray] | None = None):
        """lowest: bytes and counts of the empty context, where keys are only a part of the trie."""
        self.order = order
        self.gram, self.count, self.cost, self.context = [], [], [], []
        self.escape, self.rest, self.rest_escape = [], [], []
        lower: tuple | None = None
        for k, g, c in _levels(keys, counts, order):
            if k == 0 and lowest is not None:
                g, c = lowest
            x, at = np.unique(g >> np.uint64(8), return_inverse=True)
            n, d = np.bincount(at, c, len(x)), np.bincount(at, minlength=len(x)).astype(float)
            if lower is None:
                left_n, left_d = np.zeros(1), np.zeros(1)
                rest = np.log2(np.maximum(256 - d, 1))
                rest_escape = np.zeros(1)
            else:
                low_gram, low_count, low_context, low_n, low_d = lower
                parent = low_context(x & _mask(k - 1))
                seen = np.bincount(at, low_count[low_gram(g & _mask(k))], len(x))
                left_n, left_d = low_n[parent] - seen, low_d[parent] - d
                with np.errstate(divide="ignore", invalid="ignore"):
                    rest = np.where(left_d > 0, np.log2(2 * left_n), 0.0)
                    rest_escape = np.where(left_d > 0, np.log2(2 * left_n / left_d), 0.0)
            table, contexts = Table(g), Table(x)
            self.gram.append(table)
            self.count.append(np.log2(2 * c - 1).astype(np.float32))
            self.cost.append((np.log2(2 * n)[at] - np.log2(2 * c - 1)).astype(np.float32))
            self.context.append(contexts)
            self.escape.append(np.log2(2 * n / d).astype(np.float32))
            self.rest.append(rest.astype(np.float32))
            self.rest_escape.append(rest_escape.astype(np.float32))
            lower = (table, c, contexts, n, d)

    def bits(self, data: np.ndarray, off: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Code length of each row; only: flags of the last context bytes that count."""
        if not len(data):
            return np.zeros(len(off) - 1)
        g = grams(data, off, self.order)
        each = np.zeros(len(g), np.float32)
        miss = np.arange(len(g)) if only is None else np.flatnonzero(only[(g >> np.uint64(8)) & np.uint64(255)])
        above = np.full(len(miss), -1, np.int32)  # the context escaped from, whose bytes are excluded
        for k in range(self.order, -1, -1):
            if not len(miss):
                break
            key = g[miss] & _mask(k + 1)
            at = self.gram[k](key)
            hit = at >= 0
            fresh = above < 0
            now = hit & fresh
            each[miss[now]] += self.cost[k][at[now]]
            if k < self.order:
                now = hit & ~fresh
                each[miss[now]] += self.rest[k + 1][above[now]] - self.count[k][at[now]]
            miss, key, above, fresh = miss[~hit], key[~hit], above[~hit], fresh[~hit]
            x = self.context[k](key >> np.uint64(8))
            now = fresh & (x >= 0)
            each[miss[now]] += self.escape[k][x[now]]
            if k < self.order:
                each[miss[~fresh]] += self.rest_escape[k + 1][above[~fresh]]
            above = x
        if len(miss):
            each[miss] += self.rest[0][0] if len(self.rest[0]) else 8
        return row_sums(each, off)


class Counted:
    """Counts a trie is made of; as it travels, the trie is made where it is first used."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, lowest: tuple[np.ndarray, np.ndarray] | None = None):
        self.of = (keys, counts.astype(np.float32), order, lowest)

    @cached_property
    def trie(self) -> Trie:
        return Trie(*self.of)


def adaptive_bits(data: bytes, order: int, seen: dict[bytes, dict[int, int]] | None = None) -> float:
    """Code length of one text whose trie grows as it is read, from nothing or from seen
    (context -> byte -> count), by plain definition; for single documents and as a check."""
    import math

    trie = {x: dict(c) for x, c in (seen or {}).items()}
    learn, total = seen is None, 0.0
    past = b"\n" * order
    for s in data:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            c = trie.get(past[len(past) - k :])
            if not c:
                continue
            left = {t: n for t, n in c.items() if t not in excluded}
            if not left:
                continue
            whole = 2 * sum(left.values())
            if s in left:
                total += math.log2(whole / (2 * left[s] - 1))
                break
            total += math.log2(whole / len(left))
            excluded |= left.keys()
        else:
            total += math.log2(max(256 - len(excluded), 1))
        if learn:
            for k in range(order + 1):
                c = trie.setdefault(past[len(past) - k :], {})
                c[s] = c.get(s, 0) + 1
        past = (past + bytes([s]))[-order:] if order else b""
    return total
