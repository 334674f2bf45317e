"""N-gram Jaccard self-join by vertical partitioning (operator 10).

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are a
class, and classes are joined, each with its number of documents, so copies are never paired.

The global n-gram order (of the mixed hashes) is cut into fragments, and a set into a segment for each. With t the threshold, a pair
links if the overlap, which is the sum of its fragments' overlaps, is at least t / (1 + t) of the sum of the sizes.

1. Candidates. If a pair links, then so do its segments in some fragment, or the sum would fall short. In each fragment the
   segments are joined by themselves: rare n-grams first, the first m - ceil(t m) + 1 of m n-grams as prefixes, with bounds
   by size and place before overlaps are counted. Equal segments are one, and members are first compared with the first
   one of their list, so large groups of near copies become one component without a look at their pairs. What
   leaves a fragment is a spanning forest of its candidates, never more rows than it has classes. The components of all
   forests are clusters; every pair that links lies within one.
2. Counts. Small clusters whose texts are no longer than their n-grams move as texts, and one task does steps 2 and 3. For the others,
   for each two blocks of a cluster (most have one block) and each fragment, the part of every pair's overlap is counted on its own.
3. Sums. The parts are summed per pair. The number of documents linked with each class and a spanning forest of the links come out.

How it grows. Sets are joined by bands of size, one task for a fragment of a band, so every set moves once, and once more
if it can link with sets of the next band. A band has as many fragments as its n-grams need (Sizes.group_ngrams for each), but not
more than leave Sizes.least_segment n-grams in its smallest set's segments, so that chance and shared passages make no
candidates. Beyond that fragments grow with the table, but neither what moves nor a task's memory does with them: a task
writes its n-grams to a file of its own disk and maps it, and takes the prefixes in parts by n-gram, from files as well.
Only a few numbers a segment stay in memory. No partner or candidate is left out.

In this step an n-gram is the upper half of its hash, which a pair that links shares as well; chance can only add candidates.

Rows that move are packed: one row holds what a slice of texts has for one fragment. Of equal sets a task sends one.
Texts move only if their class is in a cluster, told by a bitmap of bounded size, and each once, however many copies it has. Components are found by
alternating large and small stars.

Defined results: null or wordless text has an empty set, links with nothing and is its own component. A text
of fewer words than a shingle is one n-gram. Repeated ids count as separate documents; the component is
the smallest id. An empty table gives an empty result. Columns other than doc_id and text are not read, whatever their
names. N-grams are told apart by 64-bit hashes, and so are sets.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Hasher, chunks, discard, materialize, mix, quoted, rows_of, text_bytes, tidy, trim, word_spans

WORDS, TOP, BOTTOM = 2, 60, 100  # shingles of two words, Jaccard 60/100
#: Least sizes of the bands; a set links only with sets of its own band and the next ones on either side.
EDGES = np.array([1, *(64 * 4**k for k in range(20))], np.int64)
#: Words of 64 bits of the bitmap of needed texts.
BITMAP = 1 << 20
_U = np.uint64


class Sizes(NamedTuple):
    """How the work is divided. The result is the same for all values."""

    group_ngrams: int = 1 << 22  # that a task of the first step joins, or more where least_segment allows no more fragments
    least_segment: int = 16  # n-grams that a fragment has of its band's smallest set
    pairs: int = 1 << 20  # or n-grams, looked at together
    fragments: int = 4  # of a cluster's sets, or more where they are long
    block_ngrams: int = 1 << 22  # of two blocks, in a fragment
    together: int = 2048  # classes of a block
    columns: int = 4096  # n-grams compared at a time
    large: int = 256  # classes beyond which a cluster has tasks of its own
    bin_ngrams: int = 1 << 21  # of small clusters in a task
    leads: int = 1 << 20  # n-grams of prefixes that a task joins at a time
    text: int = 12  # bytes for each n-gram up to which small clusters move as texts (an n-gram has 8, and texts are compressed)


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles, by row."""
    starts, ends, bounds = word_spans(data, off)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, _U)
    h = Hasher(LOWER[data])(starts, ends)
    row = rows_of(bounds)
    key = h.copy()
    for k in range(1, words):
        key[: len(h) - k] = mix(key[: len(h) - k] * _U(3)) + h[k:]
    key = mix(key)
    last = bounds[1:][row]  # the first word behind the row
    full = np.arange(len(h)) + words <= last
    n = np.diff(bounds)
    for r in np.flatnonzero((n > 0) & (n < words)):  # too few words: all of them are one n-gram
        first = bounds[r]
        full[first] = True
        whole = _U(n[r])
        for x in h[first : first + n[r]]:
            whole = mix(np.array([whole * _U(5) + x]))[0]
        key[first] = whole
    key, row = key[full], row[full]
    mine = mix(key + row.astype(_U) * _U(0xD1342543DE82EF95))  # equal only for equal rows and keys
    order = np.argsort(mine)
    mine = mine[order]
    order = order[np.concatenate([[True], mine[1:] != mine[:-1]])]
    key, row = key[order], row[order]
    order = np.argsort(row.astype(np.uint16 if len(bounds) <= 1 << 16 else np.int64), kind="stable")
    return row[order], key[order]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    kind = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind[t]) for c, t in zip(columns, types)], list(names))


def _least(total):
    """The least overlap of two sets that link, of the sum of their sizes."""
    return -(-TOP * total // (TOP + BOTTOM))


def _prefix(m: np.ndarray) -> np.ndarray:
    """N-grams of a segment of m, of which it shares one with any that it links with."""
    return m - -(-TOP * m // BOTTOM) + 1


def _places(who: np.ndarray) -> np.ndarray:
    """Each item's place among the items of the same value, which lie side by side."""
    begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.empty(0, np.int64)
    return np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))


# --- documents and their classes ----------------------------------------------------------


def _classes(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and number of n-grams of each row."""
    n = np.bincount(row, minlength=rows)
    total = np.zeros(rows, _U)
    np.add.at(total, row, mix(key ^ _U(0x5851F42D4C957F2D)))
    return mix(total + n.astype(_U)).view(np.int64), n


_DESCRIBED = "doc_id long, cls long, n long, th long, bytes long"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        data, off = text_bytes(b.column("text"))
        cls, n = _classes(*shingles(data, off), b.num_rows)
        yield _batch(_DESCRIBED, b.column("doc_id"), pa.array(cls, mask=n == 0), n, b.column("th"), np.diff(off))


# --- 1: candidates ------------------------------------------------------------------------

_PART = "grp long, classes binary, counts binary, grams binary"


def _packed(cls: np.ndarray, guest: np.ndarray, row: np.ndarray, gram: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """N-grams of rows, as one row for each group there is. Counts of guests are negative."""
    order = np.lexsort((row, group))
    gram, row, group = (gram[order] >> _U(32)).astype("<u4"), row[order], group[order]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else [0]
    out = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        who, count = np.unique(row[lo:hi], return_counts=True)
        out.append((int(group[lo]), cls[who].tobytes(), np.where(guest[who], -count, count).astype("<i4").tobytes(), gram[lo:hi].tobytes()))
    if out:
        yield _batch(_PART, *zip(*out))


def _segments(plan: list[tuple[int, int]]):
    """The segments of each set, in the groups of its band and of the next one if it can link there. plan: by
    band the first group, and fragments."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in chunks(batches):
            row, key = shingles(*text_bytes(b.column("text")))
            cls, n = _classes(row, key, b.num_rows)
            new = np.array([x not in seen and not seen.add(x) for x in cls.tolist()], bool) & (n > 0)
            if len(seen) > 100_000:
                seen = set()
            home = np.searchsorted(EDGES, n, "right") - 1
            for band in np.union1d(home[new], home[new] + 1).tolist():
                guest = (home == band - 1) & (BOTTOM * n >= TOP * EDGES[band])
                first, fragments = plan[band]
                mine = (new & ((home == band) | guest))[row]
                yield from _packed(cls, guest, row[mine], key[mine], first + (mix(key[mine]) % _U(fragments)).astype(np.int64))

    return cut


class _Forest:
    """Components of what has been joined so far; label is the least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            p, q = self.label[x], self.label[y]
            differ = p != q
            x, y, p, q = x[differ], y[differ], p[differ], q[differ]
            np.minimum.at(self.label, np.maximum(p, q), np.minimum(p, q))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


class _Overlap:
    """Overlaps of pairs of segments, given as the places of their n-grams in one list. N-grams are told apart by their
    lower bits, which are enough for the longest segment to be mistaken seldom; an overlap is never less than it is."""

    def __init__(self, gram: np.ndarray, start: np.ndarray, count: np.ndarray):
        bits = min(24, max(16, int(count.max(initial=0)).bit_length() + 8))
        self.gram, self.start, self.count, self.mark, self.low = gram, start, count, np.zeros(1 << bits, np.int8), np.uint32((1 << bits) - 1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        result = np.zeros(len(a), np.int64)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else [0]
        for lo, hi in zip(cut[:-1], cut[1:]):
            mine = self.gram[self.start[a[lo]] : self.start[a[lo]] + self.count[a[lo]]] & self.low
            self.mark[mine] = 1
            for k in range(lo, hi, 4096):  # bounded, however many partners a segment has
                other = b[k : min(k + 4096, hi)]
                where, size = _inside(self.start, self.count, other)
                result[order[k : k + len(other)]] = np.add.reduceat(self.mark[self.gram[where] & self.low], np.cumsum(size) - size, dtype=np.int64)
            self.mark[mine] = 0
        return result


def _inside(start: np.ndarray, count: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of segments, one segment after the other, and how many each has."""
    size = count[which]
    end = np.cumsum(size)
    return np.repeat(start[which] - end + size, size) + np.arange(end[-1] if len(end) else 0), size


def _blocks(length: np.ndarray, pairs: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose lengths sum to about pairs, or one item where that is longer."""
    total = np.cumsum(length)
    k = 0
    while k < len(length):
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + pairs, "right")))
        yield k, to
        k = to


_EDGES = "a long, b long"


#: An n-gram of a prefix, its segment, and its place there.
_LEAD = np.dtype([("gram", "<u4"), ("who", "<u4"), ("place", "<u4")])


#: Files that a task has open.
FILES = 256


def _file() -> BinaryIO:
    """A file on the task's own disk that is gone when it is closed."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def _candidates(sizes: Sizes):
    """A spanning forest of the pairs of classes whose segments in one group link."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [_file()]
        try:
            cls, count = [], []
            for b in batches:
                cls.append(text_bytes(b.column("classes"))[0].view("<i8").copy())
                count.append(text_bytes(b.column("counts"))[0].view("<i4").copy())
                files[0].write(text_bytes(b.column("grams"))[0])
                del b
            files[0].flush()
            yield forest_of(np.concatenate(cls), np.concatenate(count), np.memmap(files[0], "<u4", "r").view(np.ndarray), files)
        finally:
            for f in files:
                f.close()
            trim()

    def forest_of(cls: np.ndarray, count: np.ndarray, gram: np.ndarray, files: list[BinaryIO]) -> pa.RecordBatch:
        home = count > 0
        count = np.abs(count).astype(np.int64)
        start = np.cumsum(count) - count
        # equal segments are one
        sums = np.empty(len(cls), _U)
        for lo, hi in _blocks(count, sizes.pairs):
            some = gram[start[lo] : start[hi - 1] + count[hi - 1]].astype(_U)
            sums[lo:hi] = np.add.reduceat(mix(some ^ _U(0xE7037ED1A0B428DB)), start[lo:hi] - start[lo])
        one = np.unique(cls, return_index=True)[1]  # a class that several tasks have sent counts once
        cls, count, start, home = cls[one], count[one], start[one], home[one]
        _, first, same = np.unique(mix(sums[one] + count.astype(_U)), return_index=True, return_inverse=True)
        del sums, one
        forest = _Forest(len(cls))
        forest.join(np.arange(len(cls)), first[same])
        home[first] = np.bincount(same, home) > 0
        chosen = first[np.argsort(start[first])]  # as they lie in the file
        del first, same
        # the order: rare n-grams first, by how often a share of all hashes occurs
        shift = np.uint32(32 - min(23, max(8, int(count[chosen].sum()).bit_length() + 1)))
        often = np.zeros(1 << int(32 - shift), np.uint32)
        for lo, hi in _blocks(count[chosen], sizes.pairs):
            some = np.sort(gram[_inside(start, count, chosen[lo:hi])[0]] >> shift)
            edge = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            often[some[edge]] += np.diff(np.append(edge, len(some))).astype(np.uint32)
        level = np.concatenate([(8 * np.log2(np.maximum(x, 1), dtype=np.float32)).astype(np.uint8) for x in np.split(often, 64)])
        del often
        parts = int(-(-_prefix(count[chosen]).sum() // sizes.leads))
        overlap = _Overlap(gram, start, count)
        for begin in range(0, parts, FILES):
            mine = [_file() for _ in range(min(FILES, parts - begin))]
            files += mine
            for lo, hi in _blocks(count[chosen], min(sizes.pairs, 1 << 24)):
                at, size = _inside(start, count, chosen[lo:hi])
                some = gram[at]
                code = np.repeat(np.arange(hi - lo, dtype=_U) << _U(40), size)
                code |= level[some >> shift].astype(_U) << _U(32)
                code |= some
                code.sort()
                place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
                lead = place < np.repeat(_prefix(size), size)
                lead &= (code >> _U(32)) & _U(255) > 0  # else it is in one segment only
                code, place = code[lead], place[lead]
                rows = np.empty(len(code), _LEAD)
                rows["gram"], rows["who"], rows["place"] = code & _U(0xFFFFFFFF), chosen[lo + (code >> _U(40)).astype(np.int64)], place
                part = (rows["gram"].astype(np.int64) * parts >> 32) - begin
                order = np.argsort(part, kind="stable")
                rows, edge = rows[order], np.searchsorted(part[order], np.arange(len(mine) + 1))
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    mine[k].write(rows[edge[k] : edge[k + 1]].tobytes())
            for f in mine:
                f.seek(0)
                join(np.frombuffer(f.read(), _LEAD), count, home, forest, overlap)
                f.close()
        root = forest.label
        moved = root != np.arange(len(cls))
        return _batch(_EDGES, cls[moved], cls[root[moved]])

    def join(rows: np.ndarray, count: np.ndarray, home: np.ndarray, forest: _Forest, overlap: _Overlap) -> None:
        """Join the segments that link, of those that have an n-gram of some prefixes."""
        g, w, at = (rows[c].astype(np.int64) for c in ("gram", "who", "place"))
        order = np.lexsort((count[w], g))  # lists, by n-gram; short segments first
        g, w, at = g[order], w[order], at[order]
        del order

        def try_pairs(x: np.ndarray, y: np.ndarray) -> None:
            """Join the pairs of places of lists whose segments link."""
            p, q = w[x], w[y]
            need = _least(count[p] + count[q])
            # if this is the first n-gram they share, the overlap is at most what is left of the shorter rest
            ok = (np.minimum(count[p] - at[x], count[q] - at[y]) >= need) & (home[p] | home[q]) & (forest.label[p] != forest.label[q])
            pair = np.unique(np.minimum(p[ok], q[ok]).astype(np.int64) << 32 | np.maximum(p[ok], q[ok]))
            p, q = pair >> 32, pair & 0xFFFFFFFF
            linked = overlap(p, q) >= _least(count[p] + count[q])
            forest.join(p[linked], q[linked])

        def lists() -> tuple[np.ndarray, np.ndarray]:
            """Begin and length of the lists whose members aren't all joined yet."""
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
            length = np.diff(np.append(begin, len(g)))
            if not len(begin):
                return begin, length
            label = forest.label[w]
            mixed = np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin)
            return begin[mixed], length[mixed]

        begin, length = lists()
        for lo, hi in _blocks(length, sizes.pairs):  # members with the first of their list
            n = length[lo:hi] - 1
            x = np.repeat(begin[lo:hi], n)
            try_pairs(x, x + 1 + _places(x))
        begin, length = lists()
        place = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
        # a place of a list pairs with those behind it whose segments aren't too long
        widest = int(count.max(initial=0)) + 1
        end = np.searchsorted(g * widest + count[w], g[place] * widest + np.minimum(BOTTOM * count[w[place]] // TOP, widest - 1), "right")
        behind = end - 1 - place
        for lo, hi in _blocks(behind, sizes.pairs):
            n = behind[lo:hi]
            x = np.repeat(place[lo:hi], n)
            try_pairs(x, x + 1 + _places(x))

    return candidates


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, of an undirected graph (a, b)."""
    now = materialize(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").filter("a <> b").distinct(), "components")
    state = None
    while True:
        both = now.unionByName(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").selectExpr("b as a", "m as b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b as a", "m as b").unionByName(low.selectExpr("a", "m as b")).filter("a <> b").distinct()
        new = materialize(small, "components")
        discard(now)
        now = new
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    return now.selectExpr("a as node", "b as root").unionByName(now.selectExpr("b as node", "b as root")).distinct()


def _plan(classes: DataFrame, sizes: Sizes) -> list[tuple[int, int]]:
    """By band the first group, and fragments."""
    steps = [f"int(n >= {e})" for e in EDGES[1:]]
    home = F.expr(" + ".join(steps))
    guest = F.expr(" + ".join(f"int({BOTTOM} * n >= {TOP * e})" for e in EDGES[1:]))
    bands = classes.select("n", F.explode(F.array_distinct(F.array(home, guest))).alias("band"))
    total = {r.band: r.n for r in bands.groupBy("band").agg(F.sum("n").alias("n")).collect()}
    plan, first = [], 0
    for band, edge in enumerate(EDGES.tolist()):
        fragments = max(1, min(-(-total.get(band, 0) // sizes.group_ngrams), edge // sizes.least_segment))
        plan.append((first, fragments))
        first += fragments
    return plan


# --- 2 and 3: counts and sums -------------------------------------------------------------


def _bitmap(needed: DataFrame) -> np.ndarray:
    """Bits of the texts that are needed. It is of one size for any input; texts that aren't needed may be in it, none that are needed is missing."""
    words = needed.select(F.pmod("th", F.lit(BITMAP)).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftright(th, 40), 64) as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP, np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out


def _bits(bitmap: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The bit of each hash in a bitmap."""
    return (bitmap[th % BITMAP] >> ((th >> 40) % 64)) & 1


def _needed(bitmap):
    """The texts whose bit is set, without those that the task has had before, as far as it remembers."""

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in chunks(batches):
            th = b.column("th").to_numpy()
            bit = _bits(bitmap.value, th)
            new = [bool(y) and x not in seen and not seen.add(x) for x, y in zip(th.tolist(), bit.tolist())]
            if len(seen) > 100_000:
                seen = set()
            if any(new):
                yield b.filter(pa.array(new))

    return needed


_CUT = "bin long, i int, j int, frag int, cluster long, block int, cls long, n long, copies long, grams binary"


def _cut(bins: int, sizes: Sizes):
    """The segments of a cluster's sets, to each two blocks that they are in. Small clusters share bins."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            row, key = shingles(*text_bytes(b.column("text")))
            fragments = b.column("fragments").to_numpy()
            width = int(fragments.max())
            code = row * width + (mix(key) % fragments.astype(_U)[row]).astype(np.int64)
            order = np.argsort(code, kind="stable")
            key = key[order]
            edge = np.searchsorted(code[order], np.arange(b.num_rows * width + 1))
            out = []
            for r, (cluster, m, cls, n, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cluster", "m", "cls", "n", "copies")))):
                blocks = -(-m // sizes.together)
                block = cls % blocks
                home = cluster if m > sizes.large else cluster % bins
                for o in range(blocks):
                    for f in range(fragments[r]):
                        k = r * width + f
                        out.append((home, min(block, o), max(block, o), f, cluster, block, cls, n, copies, key[edge[k] : edge[k + 1]].tobytes()))
                if len(out) >= 4096:
                    yield _batch(_CUT, *zip(*out))
                    out = []
            if out:
                yield _batch(_CUT, *zip(*out))

    return cut


_COUNTED = "bin long, i int, j int, cluster long, frag int, at int, left binary, right binary, sizes binary, parts binary"
#: What is known of a class of a cluster.
_MEMBER = np.dtype([("cls", "<i8"), ("n", "<i8"), ("copies", "<i8")])


def _parts(most: int):
    """One fragment's part of the overlaps of all pairs of two blocks of each cluster in a bin."""

    def parts(table: pa.Table) -> pa.Table:
        whole = {c: table[c].to_numpy() for c in ("cluster", "block", "cls", "n", "copies")}
        one = np.lexsort((whole["cls"], whole["cluster"]))
        cls, cluster = whole["cls"][one], whole["cluster"][one]
        one = one[np.concatenate([[True], (cls[1:] != cls[:-1]) | (cluster[1:] != cluster[:-1])])]  # a class that several tasks have sent counts once
        whole = {c: x[one] for c, x in whole.items()}
        data, off = text_bytes(table["grams"].combine_chunks())
        grams = [data[off[k] : off[k + 1]].view(_U) for k in one.tolist()]
        bin_, i, j, f = (table[c][0].as_py() for c in ("bin", "i", "j", "frag"))
        del table
        cut = np.flatnonzero(np.concatenate([[True], whole["cluster"][1:] != whole["cluster"][:-1], [True]]))
        out = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            member = np.empty(hi - lo, _MEMBER)
            for c in ("cls", "n", "copies"):
                member[c] = whole[c][lo:hi]
            block = whole["block"][lo:hi]
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            segment = grams[lo:hi]
            row = np.repeat(np.arange(hi - lo), list(map(len, segment)))
            name, times = np.unique(np.concatenate(segment), return_inverse=True, return_counts=True)[1:]
            shared = times[name] > 1
            name, row = (np.cumsum(times > 1) - 1)[name[shared]], row[shared]
            columns = int((times > 1).sum())
            if columns > most:
                order = np.argsort(name, kind="stable")
                name, row = name[order], row[order]
            both = np.zeros((len(left), len(right)), np.float32)
            for at in range(0, columns, most):
                a, b = np.searchsorted(name, [at, at + most]) if columns > most else (0, len(name))
                hit = np.zeros((hi - lo, min(most, columns - at)), np.float32)
                hit[row[a:b], name[a:b] - at] = 1
                both += hit[left] @ hit[right].T
            kind = "<u2" if both.max(initial=0) < 1 << 16 else "<u4"
            out.append((bin_, i, j, int(whole["cluster"][lo]), f, int(kind[2]), member[left].tobytes(), b"" if i == j else member[right].tobytes(), b"", both.astype(kind).tobytes()))
        return pa.Table.from_batches([_batch(_COUNTED, *zip(*out))])

    return parts


def _at_once(bins: int, sizes: Sizes):
    """Links of the small clusters of a bin, from their texts."""
    cut, parts = _cut(bins, sizes._replace(together=sizes.large)), _parts(sizes.columns)

    def at_once(table: pa.Table) -> pa.Table:
        return _sums(parts(pa.Table.from_batches(list(cut(iter(table.to_batches()))))))

    return at_once


_LINKED = "a long, b long, others long"


def _sums(table: pa.Table) -> pa.Table:
    """Links of the pairs of two blocks, by the sums of their parts: for each class the documents of those linked with it, and a spanning forest of the links."""
    cluster, width = table["cluster"].to_numpy(), table["at"].to_pylist()
    lefts, rights, parts = (table[c].to_pylist() for c in ("left", "right", "parts"))
    same = table["i"][0].as_py() == table["j"][0].as_py()
    del table
    order = np.argsort(cluster, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1], [True]]))
    names, others, a, b = [], [], [], []
    for lo, hi in zip(cut[:-1], cut[1:]):
        rows = order[lo:hi]
        left = np.frombuffer(lefts[rows[0]], _MEMBER)
        right = left if same else np.frombuffer(rights[rows[0]], _MEMBER)
        both = np.zeros((len(left), len(right)), np.int32)
        for r in rows:
            both += np.frombuffer(parts[r], f"<u{width[r]}").reshape(both.shape)
            parts[r] = None
        linked = BOTTOM * both >= TOP * (left["n"][:, None] + right["n"][None, :] - both)
        if same:
            np.fill_diagonal(linked, False)
        names.append(left["cls"])
        others.append(linked @ right["copies"])
        if not same:
            names.append(right["cls"])
            others.append(linked.T @ left["copies"])
        forest = _Forest(len(left) + len(right) * (not same))
        for x in range(0, len(left), 64):
            p, q = np.nonzero(linked[x : x + 64])
            forest.join(p + x, q + len(left) * (not same))
        cls = left["cls"] if same else np.concatenate([left["cls"], right["cls"]])
        moved = forest.label != np.arange(len(cls))
        a.append(cls[moved])
        b.append(cls[forest.label[moved]])
    names, others, a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (names, others, a, b))
    return pa.Table.from_batches([_batch(_LINKED, names, pa.nulls(len(names), pa.int64()), others), _batch(_LINKED, a, b, pa.nulls(len(a), pa.int64()))])


def links(docs: DataFrame, sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, cls, n), classes (cls, copies, least), the documents linked with each class (cls, others)
    and edges (a, b) that join the classes of each component."""
    spark = docs.sparkSession
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    members = materialize(wanted.mapInArrow(_describe, _DESCRIBED), "ngram-documents")
    one = members.filter("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), *(F.min(c).alias(a) for c, a in (("doc_id", "least"), ("n", "n"), ("th", "th"))), F.max("bytes").alias("bytes"))
    classes = materialize(one, "ngram-classes")
    plan = _plan(classes, sizes)
    forest = wanted.select("text").mapInArrow(_segments(plan), _PART).groupBy("grp").applyInArrow(_candidates(sizes), _EDGES)
    home = components(forest).withColumnRenamed("node", "cls").withColumnRenamed("root", "cluster")
    home = home.join(classes.select("cls", "n", "copies", "th", "bytes"), "cls")
    each = home.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("whole"), F.sum("bytes").alias("bytes"))
    fragments = F.greatest(F.lit(sizes.fragments), F.ceil(F.col("whole") * F.least(F.lit(1.0), 2 * sizes.together / F.col("m")) / sizes.block_ngrams).cast("int"))
    small = F.expr(f"m <= {sizes.large} and whole <= {sizes.bin_ngrams} and bytes <= {sizes.text} * whole")
    home = materialize(home.drop("bytes").join(each.select("cluster", "m", F.when(small, 0).otherwise(fragments).alias("fragments")), "cluster"), "ngram-clusters")
    linked = []
    for some in (home.filter("fragments = 0"), home.filter("fragments > 0")):
        rows, total = some.agg(F.count(F.lit(1)), F.sum(F.when(F.col("m") <= sizes.large, F.col("n")))).first()
        bins = int(-(-(total or 0) // sizes.bin_ngrams)) or 1
        bitmap = spark.sparkContext.broadcast(_bitmap(some))
        sets = wanted.select("text", "th").mapInArrow(_needed(bitmap), "text string, th long").dropDuplicates(["th"]).join(some, "th")
        if linked:
            sets = sets.select("text", "cluster", "m", "cls", "n", "copies", "fragments").mapInArrow(_cut(bins, sizes), _CUT)
            counted = sets.groupBy("bin", "i", "j", "frag").applyInArrow(tidy(_parts(sizes.columns)), _COUNTED).groupBy("bin", "i", "j").applyInArrow(tidy(_sums), _LINKED)
        else:
            sets = sets.select("text", "cluster", "m", "cls", "n", "copies", F.lit(1).alias("fragments"))
            counted = sets.groupBy(F.pmod("cluster", F.lit(bins)).alias("bin")).applyInArrow(tidy(_at_once(bins, sizes)), _LINKED)
        linked.append(materialize(counted if rows else spark.createDataFrame([], _LINKED), "ngram-links"))
        bitmap.destroy()
    linked = linked[0].unionByName(linked[1])
    others = linked.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("others").alias("others"))
    return members, classes, others, linked.filter("b is not null").select("a", "b")


def similar(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id and class_id of every document."""
    members, classes, others, edges = links(docs, sizes)
    roots = components(edges).withColumnRenamed("node", "cls")
    roots = roots.join(roots.join(classes.select("cls", "least"), "cls").groupBy("root").agg(F.min("least").alias("component")), "root").select("cls", "component")
    by_class = classes.select("cls", "copies", "least").join(others, "cls", "left").join(roots, "cls", "left").select(
        "cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("component", "least").alias("component_id")
    )
    return members.join(by_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are their component's smallest id. Rows without an id, and rows that share
    one, stay or go together: with an id they stay if it is the smallest, without one they stay. Columns may have any names.
    Only rows whose id may be one of those that go, told by a bitmap, move; the others stay where they are read."""
    gone = materialize(similar(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "ngram-gone")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(gone.select(F.xxhash64("_gone").alias("th"))))
    may_go = F.arrow_udf(lambda th: pa.array(_bits(bitmap.value, th.to_numpy()) == 1), "boolean")
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row"))
    whole = whole.withColumn("_may_go", may_go(F.xxhash64(F.col("_row.doc_id").cast("long"))))
    kept = whole.filter("_may_go").join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti").unionByName(whole.filter("not _may_go"))
    return kept.select(*(F.col(f"_row.{quoted(c)}") for c in docs.columns))
