"""Language identification by prediction by partial matching (operator 9).

Each language has a variable-order byte context trie with escape probabilities, learned
from labelled texts and then frozen. A text's language is the one whose trie gives it the
shortest exact code length; ties go to the name that sorts first.

The tries are fitted on a bounded sample of labelled rows: of each language about
sample_bytes of text, chosen by a hash of the id, so the model and what the driver gathers are
bounded whatever the size of the table. Prediction reads whole texts, in one pass without a shuffle.

Defined results: `und` with score 0 if the text is null or has no letter; the same when there
is nothing to learn from. score is the posterior of the winner after code lengths are
divided by the root of the text's bytes. A null id counts as an empty one for held_out. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, per_row, quoted, text_bytes
from .ppm import Classes, Tally, grams

ORDER, SAMPLE_BYTES = 3, 2_000_000
#: Bytes of text looked at together; code lengths take about 100 bytes for each.
SLICE_BYTES = 1 << 18
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> Classes:
    """Tries of the languages in docs (doc_id, text, lang), which the caller restricts to training rows."""
    rows = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()
    names = sorted(r["lang"] for r in sizes if r["size"])
    if not names:
        return Classes([], np.empty(0, np.uint64), np.empty((0, 0)), order)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(min(1.0, sample_bytes / max(1, r["size"])) * (1 << 30))))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        for b in chunks(batches, limit=SLICE_BYTES):
            data, off = text_bytes(b.column("text"))
            langs = np.array(b.column("lang").to_pylist(), object)
            g = grams(data, off, order)
            at = np.repeat(langs, np.diff(off))
            for lang in set(langs):
                tallies.setdefault(lang, Tally()).add(g[at == lang])
        for lang, tally in tallies.items():
            k, n = tally.total()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    keys, row = np.unique(counted["gram"].to_numpy().view(np.uint64), return_inverse=True)
    counts = np.zeros((len(keys), len(names)))
    column = {x: i for i, x in enumerate(names)}
    counts[row, [column[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    return Classes(names, keys, counts, order)


def identify(docs: DataFrame, model: Classes, keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score and bits_per_byte of every row, behind its doc_id or the columns to keep, which may have any names."""
    keep = keep or ["doc_id"]
    wanted = docs.select(*(F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(keep)), F.col("text").cast("string").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classes = shipped.value
        for b in chunks(batches, limit=SLICE_BYTES):
            data, off = text_bytes(b.column("text"))
            size = np.diff(off)
            known = per_row(_LETTER[data], off) > 0
            for i in np.flatnonzero(~known & (size > 0)):
                known[i] = any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode(errors="replace")))
            known &= bool(m.names)
            bits = m.bits(data, off) if m.names else np.zeros((len(size), 1))
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(size)), best]
            odds = np.exp2(-(bits - least[:, None]) / np.sqrt(np.maximum(size, 1))[:, None]).sum(axis=1)
            names = np.array([*m.names, "und"], object)
            lang = names[np.where(known, best, len(m.names))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(np.where(known, 1 / odds, 0.0)), pa.array(least / np.maximum(size, 1))],
                [*b.schema.names[:-1], "lang_pred", "score", "bits_per_byte"],
            )

    schema = T.StructType([*wanted.schema.fields[:-1], *T._parse_datatype_string("lang_pred string, score double, bits_per_byte double").fields])
    return wanted.mapInArrow(predict, schema).toDF(*keep, "lang_pred", "score", "bits_per_byte")


def in_known_language(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows whose text is in a language of docs' labels: not `und`, and scored least_score or more. Columns may have any
    names, lang_pred and score among them."""
    n = len(docs.columns)
    told = identify(docs, fit(docs), docs.columns).toDF(*(f"_{i}" for i in range(n)), "_lang", "_score", "_bits")
    good = (F.col("_lang") != "und") & (F.col("_score") >= least_score)
    return told.filter(good).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def language_id(docs: DataFrame, held_out_of: int = 5) -> DataFrame:
    """Predictions for every document, learned from those whose remainder isn't 0."""
    model = fit(docs.filter(remainder(F.col("doc_id"), held_out_of) != 0))
    held = (remainder(F.col("doc_id"), held_out_of) == 0).alias("held_out")
    return identify(docs, model).select("doc_id", held, "lang_pred", "score", "bits_per_byte")
