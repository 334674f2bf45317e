"""Benchmark decontamination by q-gram lemma filtering (operator 3).

An item of m bytes that occurs in a text with at most e edits shares at least m + 1 - q(e + 1)
q-grams with it, and all of them lie on diagonals (text position minus item position) at most e
apart. So shared q-grams are counted in cells of e + 1 diagonals; two neighbouring cells make one
of the overlapping bands, and every such run of diagonals lies within one band. Bands that reach the
bound are verified by an alignment that keeps to the band's diagonals; exact occurrences are
found before that by a plain search.

Shared q-grams are counted in slices of bounded size. Where a text and an item both repeat one byte, the runs are counted as
wholes: their pairs fill a trapezium over the diagonals. Windows of equal bytes are aligned with an item once.

The benchmark is a query set: it is taken in blocks of at most BLOCK_BYTES of item text,
whose index is shipped to the tasks, and every document is read against each block. Nothing is
shuffled, whatever documents share.

Texts are compared as UTF-8 bytes with A-Z lower-cased and white space bytes as spaces; positions
are bytes. The edit budget is the rate times the item's bytes, less where the lemma needs it
(e <= m / q - 1). Items of fewer than q bytes, and null texts or items, match nothing. Repeated rows
give their matches again; equal items are separate items. Empty tables give no rows. Columns other than doc_id, item_id and text
are not read by contamination(); clean() returns all columns of the documents, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, text_bytes

#: Shared q-grams, or cells of runs, that are looked at together.
SLICE = 1 << 20
Q, RATE, BLOCK_BYTES = 8, 0.1, 4_000_000
_NORMAL = LOWER.copy()
_NORMAL[[9, 10, 11, 12, 13]] = 32
_SCHEMA = "doc_id long, item_id long, start long, end long, edits long, item_bytes long"
_STEP = np.int64(1 << 32)


def qgrams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one integer."""
    n = len(data) - Q + 1
    out = np.empty(max(n, 0), np.uint64)
    for k in range(Q):
        count = (n - k + Q - 1) // Q
        if count > 0:
            out[k::Q] = np.frombuffer(data[k : k + Q * count].tobytes(), np.uint64)
    return out


def align(item: np.ndarray, text: np.ndarray, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item's best occurrence in text on the diagonals 0 to width - 1,
    if it has at most `most` edits. Ties go to the earliest start, then the earliest end."""
    m = len(item)
    text = np.concatenate([text, np.full(max(0, m + width - len(text)), -1, np.int16)])
    across = np.arange(width, dtype=np.int64) * _STEP
    row = np.arange(width, dtype=np.int64)  # edits in the high half, start in the low one
    for i in range(m):
        new = row + (text[i : i + width] != item[i]) * _STEP
        new[:-1] = np.minimum(new[:-1], row[1:] + _STEP)
        row = np.minimum.accumulate(new - across) + across
        if not i & 15 and row.min() >> 32 > most:
            return None
    best = int(row.argmin())
    edits = int(row[best] >> 32)
    return None if edits > most else (edits, int(row[best] & 0xFFFFFFFF), m + best)


def _runs(*same: np.ndarray) -> np.ndarray:
    """Where runs begin: neighbours are of one run if they agree in all columns; the last column, if there are three, goes up by one."""
    if not len(same[0]):
        return np.empty(0, np.int64)
    new = (same[0][1:] != same[0][:-1]) | (same[1][1:] != same[1][:-1])
    if len(same) > 2:
        new |= same[2][1:] != same[2][:-1] + 1
    return np.flatnonzero(np.concatenate([[True], new]))


def _slices(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of items whose lengths sum to about SLICE, or of one item where that is longer."""
    total, k = np.cumsum(length), 0
    while k < len(length):
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + SLICE, "right")))
        yield k, to
        k = to


def _trapezium(low: int, r: int, s: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and their numbers of shared q-grams, of runs of r and s equal ones whose lowest diagonal is low."""

    def up_to(x: np.ndarray) -> np.ndarray:  # pairs on the first x + 1 diagonals
        half = lambda y: np.where(y >= 0, (y + 1) * (y + 2) // 2, 0)
        return half(x) - half(x - r) - half(x - s) + half(x - r - s)

    end = (low + r + s - 2) // width + 1
    for begin in range(low // width, end, SLICE):
        cell = np.arange(begin, min(begin + SLICE, end), dtype=np.int64)
        yield cell, up_to((cell + 1) * width - 1 - low) - up_to(cell * width - 1 - low)


class _Counts:
    """Sums by key of what is added, held merged."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.base = 0, 0

    def add(self, key: np.ndarray, n: np.ndarray | None) -> None:
        """n is 1 where it is None; else keys are distinct."""
        if n is None:
            key, n = np.unique(key, return_counts=True)
        self.parts.append((key, n))
        self.size += len(key)
        if self.size > 2 * self.base + SLICE:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([np.empty(0, np.int64), *(k for k, _ in self.parts)])
        n = np.concatenate([np.empty(0, np.int64), *(n for _, n in self.parts)])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = _runs(key, key)
        if len(first):
            key, n = key[first], np.add.reduceat(n, first)
        self.parts, self.size, self.base = [(key, n)], len(key), len(key)
        return key, n


class Block:
    """Some items and the index of their q-grams, which is built where it is first used."""

    def __init__(self, ids: list[int], texts: list[str], rate: float):
        keep = [(i, t) for i, t in zip(ids, texts) if t is not None and len(t.encode()) >= Q]
        self.ids = np.array([i for i, _ in keep], np.int64)
        self.items = [_NORMAL[np.frombuffer(t.encode(), np.uint8)] for _, t in keep]
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.minimum((rate * self.size).astype(np.int64), np.maximum(self.size // Q - 1, 0))
        self.least = self.size + 1 - Q * (self.edits + 1)

    @cached_property
    def index(self) -> tuple[np.ndarray, ...]:
        grams = [qgrams(x) for x in self.items]
        gram = np.concatenate([np.empty(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])
        run = _runs(gram, item)  # places of one q-gram side by side are one entry
        length = np.diff(np.append(run, len(gram))).astype(np.int32)
        gram, item, place = gram[run], item[run].astype(np.int32), place[run].astype(np.int32)
        order = np.argsort(gram, kind="stable")
        key, first, count = np.unique(gram[order], return_index=True, return_counts=True)
        flags = np.zeros(1 << 22, bool)
        flags[self._slot(key)] = True
        return key, first, count, item[order], place[order], length[order], flags

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def bands(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and first cells of the bands that reach the bound, in a run of texts."""
        key, first, count, item, place, long, flags = self.index
        grams = qgrams(data)
        at = np.flatnonzero(flags[self._slot(grams)])
        k = np.searchsorted(key, grams[at])
        k[k == len(key)] = 0
        ok = key[k] == grams[at]
        at, k = at[ok], k[ok]
        run = _runs(k, k, at)
        length = np.diff(np.append(run, len(at)))
        at, k = at[run], k[run]
        many = count[k]
        counted = _Counts()
        for lo, hi in _slices(many):
            n = many[lo:hi]
            post = np.repeat(first[k[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            who, begin, r, s = item[post].astype(np.int64), np.repeat(at[lo:hi], n), np.repeat(length[lo:hi], n), long[post].astype(np.int64)
            width, least = self.edits[who] + 1, begin - place[post] - s + 1  # the lowest diagonal
            one = (r == 1) & (s == 1)
            counted.add(who[one] << 40 | least[one] // width[one] + (1 << 38), None)
            for x in np.flatnonzero(~one).tolist():
                for cells in _trapezium(int(least[x]), int(r[x]), int(s[x]), int(width[x])):
                    counted.add(int(who[x]) << 40 | cells[0] + (1 << 38), cells[1])
        found, n = counted.total()
        beside = np.zeros(len(n), np.int64)
        near = np.flatnonzero(found[1:] == found[:-1] + 1)
        beside[near] = n[near + 1]
        left_alone = np.ones(len(n), bool)  # a band may also begin in the empty cell before
        left_alone[near + 1] = False
        least = self.least[found >> 40]
        hit = n + beside >= least
        before = left_alone & (n >= least)
        bands = np.concatenate([found[hit], found[before] - 1])
        return bands >> 40, (bands & ((1 << 40) - 1)) - (1 << 38)

    def matches(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of the items' occurrences, of overlapping ones the best."""
        found = set()
        aligned: dict[tuple[int, int, bytes], tuple[int, int, int] | None] = {}
        data = _NORMAL[data]
        for i, cell in zip(*(x.tolist() for x in self.bands(data))):
            e, item = int(self.edits[i]), self.items[i]
            low, high = cell * (e + 1), (cell + 2) * (e + 1) + len(item)
            rows = range(max(0, int(np.searchsorted(off, low, "right")) - 1), min(len(off) - 1, int(np.searchsorted(off, high, "left"))))
            for row in rows:
                a, b = max(low, int(off[row])), min(high, int(off[row + 1]))
                if b - a < len(item) - e:
                    continue
                at = data[a:b].tobytes().find(item.tobytes())
                if at >= 0:
                    found.add((row, i, 0, a + at - int(off[row]), a + at - int(off[row]) + len(item)))
                    continue
                # before the row's start the band's text is absent, so nothing matches there
                pad = np.full(a - low, -1, np.int16)
                window = (i, a - low, data[a:b].tobytes())
                if window not in aligned:
                    if len(aligned) > 10_000:
                        aligned.clear()
                    aligned[window] = align(item.astype(np.int16), np.concatenate([pad, data[a:b].astype(np.int16)]), 2 * (e + 1), e)
                if got := aligned[window]:
                    start = max(low + got[1], a) - int(off[row])
                    found.add((row, i, got[0], start, min(low + got[2], b) - int(off[row])))
        kept: list[tuple[int, int, int, int, int]] = []
        last: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for row, i, edits, start, end in sorted(found):
            spans = last.setdefault((row, i), [])
            if all(end <= s or start >= t for s, t in spans):
                spans.append((start, end))
                kept.append((row, i, start, end, edits))
        return kept


def _blocks(benchmark: DataFrame, rate: float) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len((r[1] or "").encode())
        if size > BLOCK_BYTES:
            yield Block(ids, texts, rate)
            ids, texts, size = [], [], 0
    yield Block(ids, texts, rate)


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end, edits and item_bytes of every occurrence of an item in a document."""
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in _blocks(benchmark, rate):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            b: Block = shipped.value
            for c in chunks(batches) if len(b.items) else ():
                rows = b.matches(*text_bytes(c.column("text")))
                if rows:
                    row, item, start, end, edits = (np.array(x, np.int64) for x in zip(*rows))
                    arrays = [c.column("doc_id").take(pa.array(row)), *map(pa.array, (b.ids[item], start, end, edits, b.size[item]))]
                    yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _SCHEMA.split(", ")])

        part = wanted.mapInArrow(find, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs in which no item occurs, with all their columns."""
    names = docs.columns
    at = names.index("text")
    out = docs.toDF(*(f"_{i}" for i in range(len(names))))
    for block in _blocks(benchmark, rate):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            b: Block = shipped.value
            for c in chunks(batches, f"_{at}"):
                good = np.ones(c.num_rows, bool)
                if len(b.items):
                    good[[m[0] for m in b.matches(*text_bytes(c.column(at)))]] = False
                yield c.filter(pa.array(good))

        out = out.mapInArrow(keep, out.schema)
    return out.toDF(*names)
