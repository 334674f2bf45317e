"""Removal of repeated byte strings with suffix arrays (operator 2).

A byte goes if a string of SIZE bytes that covers it starts anywhere else as well. Documents are
packed into chunk rows of about a megabyte, once, with the runs of windows that share an anchor (see
anchors.py). Then:

1. Runs are compared by anchor: a segment that occurs twice is all repeats; one that shares its
   anchor's K-gram with different segments may be in part. All others are unique. Only two hashes a run
   move, each once a chunk, so a passage that half the table contains is one entry a chunk.
2. One copy of each segment of the second kind is sent to a bucket of its K-gram, where a suffix array
   brings equal windows side by side; what it finds goes back to the chunk. A K-gram with more
   than HOT different segments is not gathered: its windows are compared by hash, one by one.
3. Each chunk marks its repeated windows and hashes what is left of its documents.

The suffix array is built by linear grouping construction over the segments' 8-byte blocks, which are aligned
to the anchor: suffixes are put into groups by their Lyndon prefixes, taken in descending order with
previous-smaller pointers, and then each group's order is emitted in one ascending pass; nothing is
renamed and solved again. Windows that agree in their whole blocks are told apart by their bytes.

Defined results: null text is empty; documents shorter than SIZE lose nothing; repeated rows, repeated
ids and overlaps within a document count as occurrences. An empty table gives an empty result. Rows are
compared as UTF-8 bytes, so a removal may begin or end inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SIZE, runs
from .common import Hasher, chunks, materialize, text_bytes, tidy

FRAGMENT_RUNS, BUCKET_SEGMENTS, HOT = 1 << 20, 1 << 12, 1 << 12
#: Bytes a partition of what joins hold as a hash table.
HASH_BYTES = 64_000_000
ALL, SOME, SUPPLY, SPREAD = 1, 2, 4, 8  # what is known of a segment, and what its chunk has to do
_U = np.uint64


# --- suffix array -------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> list[int]:
    """Order of the suffixes of an array of non-negative integers; a shorter one comes first."""
    n = len(text) + 1  # with an end that is less than all
    first = np.append(np.asarray(text, np.int64) + 1, 0)
    order = np.argsort(first, kind="stable")
    sa = order.tolist()
    at = [0] * n  # place of each suffix
    for k, i in enumerate(sa):
        at[i] = k
    sorted_first = first[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_first[1:] != sorted_first[:-1]]))
    size = [0] * n  # by group, which is named by its first place
    for h, c in zip(head.tolist(), np.diff(np.append(head, n)).tolist()):
        size[h] = c
    group = np.repeat(head, np.diff(np.append(head, n)))
    of = np.empty(n, np.int64)
    of[order] = group
    of = of.tolist()
    before = [-2] * n  # previous-smaller pointers; -1 where there is none
    end = n - 1
    # groups in descending order: a suffix before the group's, and smaller, takes in its Lyndon prefix
    while end > 0:
        g = of[sa[end]]
        times: dict[int, int] = {}
        for i in sorted(sa[g : end + 1]) if end > g else (sa[end],):
            j = i - 1
            while j >= 0 and of[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            counts = set(times.values())
            for c in (counts if len(counts) == 1 else sorted(counts, reverse=True)):
                moved = {}
                for p, k in times.items():
                    if k == c:
                        h = of[p]
                        last = h + size[h] - 1
                        q, a = sa[last], at[p]
                        sa[a], at[q] = q, a
                        sa[last], at[p] = p, last
                        size[h] -= 1
                        if h in moved:
                            moved[h].append(p)
                        else:
                            moved[h] = [p]
                for h, ps in moved.items():
                    new = h + size[h]
                    size[new] = len(ps)
                    for p in ps:
                        of[p] = new
        end = g - 1
    free = list(range(n))  # the next free place of each group
    # each suffix, in ascending order, gives their places to those whose Lyndon prefix ends before it
    placed = [False] * n
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            h = of[j]
            out[free[h]] = j
            free[h] += 1
            j = before[j]
    return out[1:]


_BLOCK = 8


def repeats(text: bytes, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Which windows occur twice, of all windows of some segments in order. Segments lie one behind the
    other in text, each count + size - 1 bytes long from start, and windows that are equal have
    their anchors at the same offset."""
    length = count + size - 1
    shift = anchor % _BLOCK  # blocks begin here
    blocks = (length - shift) // _BLOCK
    bytes_ = np.frombuffer(text, np.uint8)
    owner = np.repeat(np.arange(len(start)), blocks)
    first = np.cumsum(blocks) - blocks
    place = (start + shift)[owner] + _BLOCK * (np.arange(len(owner)) - first[owner])
    value = np.zeros(len(place), _U)
    for k in range(_BLOCK):
        value |= bytes_[place + k].astype(_U) << _U(8 * k)
    order = suffix_array(np.unique(value, return_inverse=True)[1])
    need = size - _BLOCK  # every window has this many bytes of whole blocks from its first block on
    first_window = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), bool)
    # a block counts if windows begin at it or in the bytes before it
    offset = place - start[owner]
    useful = (offset + need <= length[owner]) & (offset - _BLOCK < count[owner])
    keep = [k for k in order if useful[k]]
    place_, owner_ = place.tolist(), owner.tolist()
    start_, count_, first_ = start.tolist(), count.tolist(), first_window.tolist()

    def settle(group: list[int]) -> None:
        for d in range(_BLOCK):
            seen: dict[bytes, int] = {}
            for k in group:
                o = owner_[k]
                i = place_[k] - d
                w = i - start_[o]
                if 0 <= w < count_[o]:
                    key = text[i : i + size]
                    mine = first_[o] + w
                    other = seen.setdefault(key, mine)
                    if other != mine:
                        out[other] = out[mine] = True

    group: list[int] = []
    now = b""
    for k in keep:
        p = place_[k]
        key = text[p : p + need]
        if key == now:
            group.append(k)
            continue
        if len(group) > 1:
            settle(group)
        group, now = [k], key
    if len(group) > 1:
        settle(group)
    return out


# --- distribution -------------------------------------------------------------------------

_CHUNK = "chunk long, ids binary, offsets binary, text binary, start binary, count binary, anchor binary, gram binary, segment binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    kind = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kind[t]) for c, t in zip(columns, types)], list(names))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for b in chunks(batches):
        data, off = text_bytes(b.column("text"))
        r = runs(data, off)
        ids = pa.array(b.column("doc_id"))
        blob = np.stack([ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)])
        arrays = (blob, off, data, r.start.astype(np.int32), r.count.astype(np.int32), r.anchor.astype(np.int16), r.gram, r.segment)
        yield _rows(_CHUNK, [(number, *(x.tobytes() for x in arrays))])
        number += 1


_ENTRY = "frag int, chunk long, gram binary, segment binary, times binary"


def _entries(chunk: int, gram: np.ndarray, segment: np.ndarray, fragments: int) -> list[tuple]:
    """The chunk's different (gram, segment) with their numbers, by fragment."""
    order = np.lexsort((segment, gram))
    g, s = gram[order], segment[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])) if len(g) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(g))).astype(np.int32)
    g, s = g[first], s[first]
    frag = (g % _U(fragments)).astype(np.int64)
    out = []
    by = np.argsort(frag, kind="stable")
    for at in _alike(frag[by]):
        at = by[at]
        out.append((int(frag[at[0]]), chunk, g[at].tobytes(), s[at].tobytes(), times[at].tobytes()))
    return out


def _alike(ordered: np.ndarray) -> list[slice]:
    """Runs of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])).tolist() if len(ordered) else [0]
    return [slice(lo, hi) for lo, hi in zip(cut[:-1], cut[1:])]


def _name(fragments: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, g, s in zip(*(b.column(x).to_pylist() for x in ("chunk", "gram", "segment"))):
                yield _rows(_ENTRY, _entries(c, np.frombuffer(g, _U), np.frombuffer(s, _U), fragments))

    return name


_VERDICT = "chunk long, gram binary, segment binary, flags binary, supplied long"


def _judge(hot: int):
    """What is known of each segment of a fragment, for its chunks."""

    def judge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, _U) for x in table["gram"].to_pylist()]
        gram = np.concatenate(parts)
        segment = np.concatenate([np.frombuffer(x, _U) for x in table["segment"].to_pylist()])
        times = np.concatenate([np.frombuffer(x, np.int32) for x in table["times"].to_pylist()])
        chunk = np.repeat(table["chunk"].to_numpy(), list(map(len, parts)))
        order = np.lexsort((chunk, segment, gram))
        gram, segment, times, chunk = gram[order], segment[order], times[order], chunk[order]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new = new_gram | np.concatenate([[True], segment[1:] != segment[:-1]])
        first = np.flatnonzero(new)
        total = np.add.reduceat(times.astype(np.int64), first)
        which = np.cumsum(new) - 1
        different = np.bincount(np.cumsum(new_gram)[first] - 1)[np.cumsum(new_gram) - 1]
        flags = np.where(total[which] > 1, ALL, 0) | np.where(different > 1, SOME, 0)
        flags |= np.where(new & (different > 1), np.where(different > hot, SPREAD, SUPPLY), 0)
        keep = np.flatnonzero(flags)
        keep = keep[np.argsort(chunk[keep], kind="stable")]
        chunk, gram, segment, flags = chunk[keep], gram[keep], segment[keep], flags[keep].astype(np.uint8)
        cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else [0]
        rows = [(int(chunk[a]), gram[a:b].tobytes(), segment[a:b].tobytes(), flags[a:b].tobytes(), int((flags[a:b] & SUPPLY > 0).sum())) for a, b in zip(cut[:-1], cut[1:])]
        return pa.Table.from_batches([_rows(_VERDICT, rows)])

    return judge


def _flags(gram: np.ndarray, segment: np.ndarray, verdicts: list) -> np.ndarray:
    """The flags of each run of a chunk. A chunk supplies a segment once, however often it has it."""
    out = np.zeros(len(gram), np.uint8)
    if not verdicts or not len(gram):
        return out
    g, s, f = (np.concatenate([np.frombuffer(v[k], t) for v in verdicts]) for k, t in (("gram", _U), ("segment", _U), ("flags", np.uint8)))
    order = np.lexsort((np.concatenate([segment, s]), np.concatenate([gram, g])))
    both_g, both_s = np.concatenate([gram, g])[order], np.concatenate([segment, s])[order]
    new = np.concatenate([[True], (both_g[1:] != both_g[:-1]) | (both_s[1:] != both_s[:-1])])
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new)
    mine, theirs = key[: len(gram)], key[len(gram) :]
    table = np.zeros(len(order) + 1, np.uint8)
    table[theirs] = f
    out = table[mine]
    repeat = np.ones(len(mine), bool)
    repeat[np.unique(mine, return_index=True)[1]] = False
    out[repeat] &= ~np.uint8(SUPPLY | SPREAD)
    return out


_SUPPLIED = "frag int, hot boolean, chunk long, a binary, b binary, c binary, d binary"


def _supply(buckets: int, fragments: int):
    """Segments for the buckets' suffix arrays; hashes of windows of hot K-grams."""

    def supply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                start, count = np.frombuffer(r["start"], np.int32).astype(np.int64), np.frombuffer(r["count"], np.int32).astype(np.int64)
                anchor, gram = np.frombuffer(r["anchor"], np.int16).astype(np.int64), np.frombuffer(r["gram"], _U)
                flags = _flags(gram, np.frombuffer(r["segment"], _U), r["verdicts"])
                rows = []
                give = np.flatnonzero(flags & SUPPLY)
                bucket = (gram[give] // _U(1 << 20) % _U(buckets)).astype(np.int64)
                give, bucket = give[order := np.argsort(bucket, kind="stable")], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(give) else [0]
                for lo, hi in zip(cut[:-1], cut[1:]):
                    at = give[lo:hi]
                    text = b"".join(r["text"][s : s + c + SIZE - 1] for s, c in zip(start[at].tolist(), count[at].tolist()))
                    rows.append((int(bucket[lo]), False, r["chunk"], start[at].tobytes(), count[at].tobytes(), anchor[at].tobytes(), text))
                if len(each := np.flatnonzero(flags & SPREAD)):
                    n = count[each]
                    window = np.repeat(start[each] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    hasher = Hasher(np.frombuffer(r["text"], np.uint8))
                    left, right = hasher(window, window + SIZE), hasher(window, window + SIZE // 2)
                    frag = (left % _U(fragments)).astype(np.int64)
                    by = np.argsort(frag, kind="stable")
                    for at in _alike(frag[by]):
                        at = by[at]
                        rows.append((-1 - int(frag[at[0]]), True, r["chunk"], window[at].tobytes(), left[at].tobytes(), right[at].tobytes(), None))
                yield _rows(_SUPPLIED, rows)

    return supply


_FOUND = "chunk long, windows binary"


def _search(table: pa.Table) -> pa.Table:
    """Starts of the windows that a bucket or a fragment of hot windows finds twice, by chunk."""
    rows = table.sort_by("chunk").to_pylist()
    if rows[0]["hot"]:
        window, left, right = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("a", np.int64), ("b", _U), ("c", _U)))
        chunk = np.repeat([r["chunk"] for r in rows], [len(r["a"]) // 8 for r in rows])
        order = np.lexsort((right, left))
        l, r_ = left[order], right[order]
        same = np.zeros(len(l) + 1, bool)
        same[1:-1] = (l[1:] == l[:-1]) & (r_[1:] == r_[:-1])
        twice = np.zeros(len(l), bool)
        twice[order] = same[1:] | same[:-1]
    else:
        at, count, anchor = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in "abc")
        text = b"".join(r["d"] for r in rows)
        length = count + SIZE - 1
        twice = repeats(text, np.cumsum(length) - length, count, anchor)
        chunk = np.repeat(np.repeat([r["chunk"] for r in rows], [len(r["a"]) // 8 for r in rows]), count)
        window = np.repeat(at - np.cumsum(count) + count, count) + np.arange(count.sum())
    chunk, window = chunk[twice], window[twice]
    cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else [0]
    return pa.Table.from_batches([_rows(_FOUND, [(int(chunk[a]), window[a:b].astype(np.int32).tobytes()) for a, b in zip(cut[:-1], cut[1:])])])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(keep_text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                text, off = r["text"], np.frombuffer(r["offsets"], np.int64)
                start, count = np.frombuffer(r["start"], np.int32).astype(np.int64), np.frombuffer(r["count"], np.int32).astype(np.int64)
                flags = _flags(np.frombuffer(r["gram"], _U), np.frombuffer(r["segment"], _U), r["verdicts"] or [])
                edge = np.zeros(len(text) + 1, np.int32)
                whole = flags & ALL > 0
                np.add.at(edge, start[whole], 1)
                np.add.at(edge, (start + count + SIZE - 1)[whole], -1)
                for w in r["windows"] or []:
                    w = np.frombuffer(w["windows"], np.int32)
                    np.add.at(edge, w, 1)
                    np.add.at(edge, w + SIZE, -1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = off[1:-1]
                inner = inner[inner < len(text)]
                begins[inner] = gone[inner]
                total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
                data = np.frombuffer(text, np.uint8)
                ids, valid = np.frombuffer(r["ids"], np.int64).reshape(2, -1).tolist()
                rows = []
                for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    kept = text[lo:hi] if total[hi] == total[lo] else data[lo:hi][~gone[lo:hi]].tobytes()
                    rows.append((ids[i] if valid[i] else None, hi - lo, int(total[hi] - total[lo]), int(spans[hi] - spans[lo]), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                yield _rows(_RESULT, rows)

    return finish


def _power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def _hashed(side: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """side, to be held as a hash table if the bytes of a partition, of the table that it is made of, allow that; else it is sorted, which can spill."""
    size = table.agg(F.sum(sum(F.octet_length(c).cast("double") for c in columns))).first()[0] or 0
    few = size / int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) <= HASH_BYTES
    return side.hint("shuffle_hash") if few else side


def remove_repeats(docs: DataFrame, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with keep_text also the bytes kept."""
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = materialize(wanted.mapInArrow(_pack, _CHUNK), "suffix-chunks")
    n = packed.agg(F.sum(F.octet_length("gram").cast("double"))).first()[0] or 0
    fragments = _power_of_two(n / 8 / FRAGMENT_RUNS)
    named = packed.select("chunk", "gram", "segment").mapInArrow(_name(fragments), _ENTRY)
    verdicts = materialize(named.groupBy("frag").applyInArrow(tidy(_judge(hot)), _VERDICT), "suffix-verdicts")
    supplied = verdicts.agg(F.sum("supplied")).first()[0] or 0
    by_chunk = _hashed(verdicts.groupBy("chunk").agg(F.collect_list(F.struct("gram", "segment", "flags")).alias("verdicts")), verdicts, "gram", "segment", "flags")
    segments = packed.drop("ids", "offsets").join(by_chunk, "chunk").mapInArrow(_supply(_power_of_two(supplied / BUCKET_SEGMENTS), fragments), _SUPPLIED)
    found = materialize(segments.groupBy("frag").applyInArrow(tidy(_search), _FOUND), "suffix-found")
    windows = _hashed(found.groupBy("chunk").agg(F.collect_list(F.struct("windows")).alias("windows")), found, "windows")
    news = _hashed(by_chunk.join(windows, "chunk", "full"), verdicts, "gram", "segment", "flags")
    out = packed.join(news, "chunk", "left").mapInArrow(_finish(keep_text), _RESULT)
    return out if keep_text else out.drop("kept")
