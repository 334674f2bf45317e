"""Packing of documents into fixed windows (operator 7): bounded-space online packing.

Each partition keeps a fixed number of open windows. A document's token ids are cut into whole
windows while they are longer than one; what is left goes to the open window with the least
room that takes it. If none takes it, the fullest is emitted; when its room is more than
a few ids it is first filled by cutting the document. Windows still open at the end of a
partition are leftovers. They are merged in the same way, 64 partitions at a time, level by
level, so no task ever holds more than 64 times the open windows, and the last level cuts
freely, which leaves one window that isn't full.

Defined results: null text counts as empty, so its document is the end id alone. A document has
consecutive pieces that cover its ids exactly once. Repeated ids are separate documents.
Tokens and both kinds of rows of a level come from one written table, so a task that runs
again can't disagree with itself. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, chunks, kept, materialize, text_bytes, tidy, word_spans
from .tokens import tokenizer

OPEN_WINDOWS, FAN_IN, LEAST_ROOM = 32, 64, 16
#: Bytes of text looked at together.
SLICE_BYTES = 1 << 18
#: Words and pieces that a worker remembers.
WORDS, PIECES = 400_000, 100_000
#: The pre-tokenizer's pieces of lower-case words whose characters are all below U+0250, where normal
#: form C and lower case are made character by character; what byte-level encoding writes for bytes.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PLAIN = re.compile(r"[!-;=-~\xc0-\u012f\u0131-\u024f]+")
_LETTERS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTER = {b: b if b in _LETTERS else 256 + sum(x not in _LETTERS for x in range(b)) for b in range(256)}
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, level int, closed boolean, ids binary"


class Known:
    """An index of words by 64-bit hash and first eight bytes, which grows; lookups are vectorised."""

    def __init__(self):
        self.key, self.head, self.used = np.empty(1 << 14, np.uint64), np.empty(1 << 14, np.uint64), 0
        self._slots(15)

    def _slots(self, bits: int) -> None:
        self.shift, self.wrap, self.slots = np.uint64(64 - bits), (1 << bits) - 1, np.full(1 << bits, -1, np.int32)
        self._place(np.arange(self.used, dtype=np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _place(self, left: np.ndarray) -> None:
        slot = self._slot(self.key[left])
        while len(left):
            free = np.flatnonzero(self.slots[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            self.slots[at] = left[free[first]]
            stay = np.ones(len(left), bool)
            stay[free[first]] = False
            left, slot = left[stay], (slot[stay] + 1) & self.wrap

    def add(self, keys: np.ndarray, heads: np.ndarray) -> None:
        """Take in words that aren't there, each once."""
        total = self.used + len(keys)
        while total > len(self.key):
            self.key, self.head = (np.concatenate([x, np.empty_like(x)]) for x in (self.key, self.head))
        self.key[self.used : total], self.head[self.used : total] = keys, heads
        new = np.arange(self.used, total, dtype=np.int32)
        self.used = total
        if 2 * total > len(self.slots):
            self._slots((4 * total).bit_length())
        else:
            self._place(new)

    def __call__(self, keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Number of each word in the order of taking in, -1 for one that isn't there."""
        slot = self._slot(keys)
        out = self.slots[slot]
        miss = np.flatnonzero((out >= 0) & ((self.key[out] != keys) | (self.head[out] != heads)))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.wrap
            out[miss] = now = self.slots[slot[miss]]
            miss = miss[(now >= 0) & ((self.key[now] != keys[miss]) | (self.head[now] != heads[miss]))]
        return out


def heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' first eight bytes as one integer, zeros behind shorter ones."""
    out = np.zeros(len(starts), np.uint64)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        out |= np.where(starts + k < ends, data[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


class WordIds:
    """Token ids of texts under a tokenizer that drops white space: words are encoded once and
    remembered. A word is known by its hash and first bytes, so lookups are a few vector passes."""

    def __init__(self, path: str, end_id: int):
        self.encoder, self.end_id = tokenizer(path), end_id
        self.tokenize = self.encoder.model.tokenize
        self.piece: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = Known()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words. Plain ones are cut into the pieces that the pre-tokenizer makes of them, which
        are far fewer, so each is encoded once; all others are encoded whole."""
        if len(self.piece) > PIECES:
            self.piece = {}
        piece, plain, find = self.piece, _PLAIN.fullmatch, _PIECE.findall
        cut = [find(w.lower()) if plain(w) else None for w in words]
        for p in {p for c in cut if c for p in c if p not in piece}:
            piece[p] = [t.id for t in self.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LETTER))]
        other = iter(self.encoder.encode_batch_fast([w for w, c in zip(words, cut) if c is None], add_special_tokens=False))
        get = piece.__getitem__
        return [next(other).ids if c is None else get(c[0]) if len(c) == 1 else [i for p in c for i in get(p)] for c in cut]

    def _learn(self, keys: np.ndarray, head: np.ndarray, words: list[str]) -> None:
        encoded = self._ids(words)
        sizes = np.fromiter(map(len, encoded), np.int64, len(words))
        n, total = self.known.used, self.used + int(sizes.sum())
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(words) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.size))
        self.flat[self.used : total] = np.fromiter(chain.from_iterable(encoded), np.uint32, total - self.used)
        self.first[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.used = total
        self.known.add(keys, head)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by the end id, and the bounds of the texts."""
        if self.known.used > WORDS:
            self._forget()
        starts, ends, bounds = word_spans(data, off)
        keys = Hasher(data)(starts, ends) if len(starts) else np.empty(0, np.uint64)
        head = heads(data, starts, ends)
        at = self.known(keys, head)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new = miss[_distinct(keys[miss], head[miss])]
            raw = data.tobytes()
            self._learn(keys[new], head[new], [raw[s:e].decode() for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            at[miss] = self.known(keys[miss], head[miss])
        sizes = self.size[at]
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        ids = self.flat[np.repeat(self.first[at] - total[:-1], sizes) + np.arange(total[-1])]
        out = np.full(len(ids) + len(off) - 1, self.end_id, np.uint32)
        where = total[bounds] + np.arange(len(off))  # the end id follows each text
        text = np.repeat(np.arange(len(off) - 1), np.diff(total[bounds]))
        out[np.arange(len(ids)) + text] = ids
        return out, where


def _distinct(keys: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Index of one of each pair."""
    order = np.lexsort((head, keys))
    k, h = keys[order], head[order]
    return order[np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])]


class Packer:
    """A fixed number of open windows; a window is its number of ids and its pieces
    (doc_id, start, doc_tokens, ids). Closed windows go to self.out."""

    def __init__(self, size: int, windows: int = OPEN_WINDOWS):
        self.size = size
        self.open: list[tuple[int, list]] = [(0, [])] * windows
        self.out: list[list] = []

    def add(self, pieces: list[tuple]) -> None:
        """Place pieces, which stay together if a window takes them."""
        left = sum(len(p[3]) for p in pieces)
        while left >= self.size:
            head, pieces = self._cut(pieces, self.size)
            self.out.append(head)
            left -= self.size
        if not left:
            return
        room = self.size - left
        best = max((i for i, w in enumerate(self.open) if w[0] <= room), key=lambda i: self.open[i][0], default=None)
        if best is None:
            best = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, inside = self.open[best]
            if (gap := self.size - used) >= LEAST_ROOM:
                head, pieces = self._cut(pieces, gap)
                inside = inside + head
                left -= gap
            self.out.append(inside)
            self.open[best] = (0, [])
            best = max((i for i, w in enumerate(self.open) if w[0] <= self.size - left), key=lambda i: self.open[i][0])
        used, inside = self.open[best]
        self.open[best] = (used + left, inside + pieces)

    @staticmethod
    def _cut(pieces: list[tuple], n: int) -> tuple[list[tuple], list[tuple]]:
        for k, (doc, start, total, ids) in enumerate(pieces):
            if n < len(ids):
                head = [*pieces[:k], (doc, start, total, ids[:n])] if n else pieces[:k]
                return head, [(doc, start + n, total, ids[n:]), *pieces[k + 1 :]]
            n -= len(ids)
        return pieces, []

    def leftovers(self) -> list[list]:
        return [p for used, p in self.open if used]

    def squeeze(self) -> None:
        """Close all: leftovers one after the other, cut wherever a window is full."""
        rest = [p for w in self.leftovers() for p in w]
        self.open = [(0, [])] * len(self.open)
        while sum(len(p[3]) for p in rest) > self.size:
            head, rest = self._cut(rest, self.size)
            self.out.append(head)
        if rest:
            self.out.append(rest)


def _rows(windows: list[list], part: int, first: int, level: int, closed: bool) -> pa.RecordBatch | None:
    rows = []
    for w, pieces in enumerate(windows):
        offset = 0
        for doc, start, total, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            rows.append((doc, start, len(ids), zlib.crc32(raw), total, part, first + w, offset, level, closed, None if closed else raw))
            offset += len(ids)
    if not rows:
        return None
    types = [pa.int64()] * 8 + [pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in _SCHEMA.split(", ")])


def _first_level(size: int, path: str, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, packer, n = TaskContext.get().partitionId(), None, Packer(size), 0
        for b in chunks(batches, limit=SLICE_BYTES, keep=path):
            encode = encode or kept(path, lambda: WordIds(path, end_id))
            docs = b.column("doc_id").to_pylist()
            ids, bounds = encode(*text_bytes(b.column("text")))
            for doc, lo, hi in zip(docs, bounds[:-1].tolist(), bounds[1:].tolist()):
                packer.add([(doc, 0, hi - lo, ids[lo:hi])])
            for i, (used, p) in enumerate(packer.open):  # let go of the slice's ids
                packer.open[i] = (used, [(d, s, t, x.copy() if x.base is not None else x) for d, s, t, x in p])
            if rows := _rows(packer.out, part, n, 0, True):
                yield rows
            n += len(packer.out)
            packer.out = []
        if rows := _rows(packer.leftovers(), part, n, 0, False):
            yield rows

    return pack


def _merge(size: int, level: int, last: bool):
    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() // FAN_IN
        rows = table.sort_by([("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        windows: dict[tuple, list] = {}
        for r in rows.select(["part", "window", "doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            windows.setdefault((r["part"], r["window"]), []).append((r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")))
        packer = Packer(size)
        for w in sorted(windows.values(), key=lambda w: -sum(len(p[3]) for p in w)):
            packer.add(w)
        if last:
            packer.squeeze()
        batches = [_rows(packer.out, part, 0, level, True), _rows([] if last else packer.leftovers(), part, len(packer.out), level, False)]
        return pa.Table.from_batches([b for b in batches if b], table.schema)

    return merge


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    Tokenizing and packing are one pass without a shuffle; only leftovers move, at most
    OPEN_WINDOWS a partition. sequence_id is unique: its high bits name the level and partition.
    """
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = materialize(wanted.mapInArrow(_first_level(size, tokenizer_path, end_id), _SCHEMA), "packing-0")
    done, level = [table.filter("closed")], 0
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level, parts = level + 1, -(-parts // FAN_IN)
        merged = table.filter("not closed").groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(tidy(_merge(size, level, parts == 1)), _SCHEMA)
        table = materialize(merged, f"packing-{level}")
        done.append(table.filter("closed"))
        if parts == 1:
            break
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    sequence = F.expr("shiftleft(cast(level as bigint), 58) | shiftleft(part, 26) | window")
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset")
