"""Language-model scores by prediction by partial matching (operator 5).

The model is a byte-context trie with escape estimation and symbol exclusion, pretrained on the
training documents; a document's score is its exact code length as a base-10 log probability.
What is coded is the lower-cased words, each followed by a space, then a line feed for the
end. The base score is an add-one unigram model over words and ends.

Counts cover every training document: grams and words are tallied in each task, then summed by
key. The trie is shipped whole while it is under MODEL_BYTES; beyond that it is cut by the byte
before the coded one, which all contexts of a position share, and the documents are scored against
one part after the other and the parts' sums added. Words are looked up in two ways: the HEAD most
frequent are shipped (a fixed bound), the others are joined by key, where none is frequent
enough to be a hot key.

Defined results: null or empty text has the end token alone. A null id counts as an empty text in
the split. Repeated rows are scored each for itself. With nothing to learn from, counts are 0 and
every byte costs 8 bits. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Hasher, chunks, materialize, rows_of, text_bytes, word_spans
from .langid import remainder
from .ppm import Counted, Table, Tally, Trie, grams

ORDER, HEAD, MODEL_BYTES, ROW_BYTES = 5, 1 << 17, 256_000_000, 48
_END = np.uint64(1)  # the end token's key; words' keys are hashes
_ROW = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, bits double, word long"


def canonical(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that are coded and their row offsets; keys of the words and the index of each row's first."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, off)
    keys = Hasher(data)(starts, ends) if len(starts) else np.empty(0, np.uint64)
    inside = np.flatnonzero(~SPACE[data])
    word = np.repeat(np.arange(len(starts)), ends - starts)
    size = np.zeros(len(off), np.int64)
    np.cumsum(ends - starts, out=(total := np.zeros(len(starts) + 1, np.int64))[1:])
    size = total[bounds] + bounds + np.arange(len(off))
    out = np.full(size[-1], 32, np.uint8)
    out[np.arange(len(inside)) + word + rows_of(bounds)[word]] = data[inside]
    out[size[1:] - 1] = 10
    return out, size, keys, bounds


def _count(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (Tally(), Tally())
        for b in chunks(batches):
            text, off, words, _ = canonical(*text_bytes(b.column("text")))
            tallies[0].add(grams(text, off, order))
            tallies[1].add(np.concatenate([words, np.full(len(off) - 1, _END)]))
        for kind, tally in enumerate(tallies):
            k, n = tally.total()
            for at in range(0, len(k), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), kind, np.int32)), pa.array(k[part].view(np.int64)), pa.array(n[part])], ["kind", "key", "n"])

    return count


def train(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts over docs by (kind, key): grams are kind 0, tokens kind 1."""
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_count(order), "kind int, key long, n long")
    return materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")


def _score(trie, head, only):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Trie | None = trie.value and trie.value.trie
        common, logs = head.value
        row = TaskContext.get().partitionId() << 32
        for b in chunks(batches):
            text, off, words, bounds = canonical(*text_bytes(b.column("text")))
            rows = len(off) - 1
            bits = model.bits(text, off, only) if model else 8.0 * np.diff(off)
            token = np.concatenate([words, np.full(rows, _END)])
            owner = np.concatenate([rows_of(bounds), np.arange(rows)])
            at = common(token)
            seen = at >= 0
            base = np.bincount(owner[seen], logs[at[seen]], rows)
            known = np.bincount(owner[seen], minlength=rows)
            ids = b.column("row").to_numpy() if "row" in b.schema.names else row + np.arange(rows)
            n = np.diff(bounds) + 1
            blank = lambda t, k: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), b.column("doc_id"), b.column("held_out"), pa.array(n), pa.array(known), pa.array(base), pa.array(bits), blank(pa.int64(), rows)],
                [f.split()[0] for f in _ROW.split(", ")],
            )
            rare = np.flatnonzero(~seen)
            k = len(rare)
            if k:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner[rare]]), *(blank(t, k) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(token[rare].view(np.int64))],
                    [f.split()[0] for f in _ROW.split(", ")],
                )
            row += rows

    return score


def _part(trie, only):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            text, off, _, _ = canonical(*text_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(trie.value.trie.bits(text, off, only))], ["row", "bits"])

    return score


def _tries(grams_counted: DataFrame, order: int, model_bytes: int) -> Iterator[tuple[Counted | None, np.ndarray | None]]:
    """The trie, or its parts with the last context bytes that each holds."""
    last = F.expr("shiftright(key, 8) & 255")
    sizes = {r["b"]: r["count"] for r in grams_counted.groupBy(last.alias("b")).count().collect()}  # at most 256 rows
    if not sizes:
        yield None, None
        return
    parts: list[tuple[int, list[int]]] = []
    for byte, n in sorted(sizes.items()):
        if not parts or (parts[-1][0] + n) * ROW_BYTES > model_bytes:
            parts.append((0, []))
        parts[-1] = (parts[-1][0] + n, [*parts[-1][1], byte])
    if len(parts) == 1:
        t = grams_counted.select("key", "n").toArrow()
        yield Counted(t["key"].to_numpy().view(np.uint64), t["n"].to_numpy(), order), None
        return
    t = grams_counted.groupBy(F.expr("key & 255").alias("s")).agg(F.sum("n").alias("n")).orderBy("s").toArrow()  # at most 256 rows
    lowest = t["s"].to_numpy().view(np.uint64), t["n"].to_numpy().astype(float)
    for _, bytes_ in parts:
        t = grams_counted.filter(last.isin(bytes_)).select("key", "n").toArrow()
        keys, n = t["key"].to_numpy().view(np.uint64), t["n"].to_numpy().astype(float)
        only = np.zeros(256, bool)
        only[bytes_] = True
        yield Counted(keys, n, order, lowest), only


def lm_score(docs: DataFrame, held_out_of: int = 7, held_out_rest: int = 2, order: int = ORDER, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Scores of every document, learned from those whose remainder isn't held_out_rest."""
    spark = docs.sparkSession
    held = remainder(F.col("doc_id"), held_out_of) == held_out_rest
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    counts = train(wanted.filter(~F.col("held_out")), order)
    tokens = counts.filter("kind = 1").select("key", "n")
    n_all, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    top = tokens.orderBy(F.desc("n"), "key").limit(HEAD).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    ship = spark.sparkContext.broadcast
    head = ship((Table(keys), np.log10(top["n"].to_numpy() + 1.0)))
    tries = _tries(counts.filter("kind = 0").select("key", "n"), order, model_bytes)
    model, only = next(tries)
    if only is not None:
        wanted = materialize(wanted.withColumn("row", F.monotonically_increasing_id()), "lm-documents")
    scored = materialize(wanted.mapInArrow(_score(ship(model), head, only), _ROW), "lm-scores")
    parts = [materialize(wanted.select("row", "text").mapInArrow(_part(ship(t), o), "row long, bits double"), "lm-part") for t, o in tries]
    rare = scored.filter("word is not null").select("row", F.col("word").alias("key"))
    found = rare.join(tokens, "key").groupBy("row").agg(F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("more"), F.count(F.lit(1)).alias("also"))
    out = scored.filter("word is null").join(found, "row", "left")
    for part in parts:
        out = out.join(part.withColumnRenamed("bits", "_bits"), "row").withColumn("bits", F.col("bits") + F.col("_bits")).drop("_bits")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n_all + v + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (-F.col("bits") * F.lit(math.log10(2))).alias("score"),
    )
