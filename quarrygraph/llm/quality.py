"""Quality rules with adaptive thresholds (operator 1).

Every document gets a few integer ratios. A mergeable quantile sketch of each ratio is kept
per (language, source): counts in buckets that keep the leading bits of the value, so a
bucket is at most 1/32 of its value wide and merging sketches is adding counts. Thresholds
come from the sketches' quartiles, and the documents are joined with the thresholds of their
group and filtered.

Defined results: null text counts as empty (zero counts, base_failed). Null lang or source is
a group of its own. Rows are kept one by one, so repeated ids and ties stay. Extra columns are
ignored; an empty table gives an empty result. A group of fewer than `least` documents uses
the thresholds of its language, and a language with fewer those of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Hasher, chunks, materialize, mix, per_row, rows_of, text_bytes, word_spans

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_lines"])

#: Ratio -> (numerator, denominator, quartile distances allowed below and above, least distance).
#: Ratios are millionths; None leaves that side open. With quartiles at 0, which is usual for the repetition rules, their fences are half of
#: what they can reach: dup_lines is under 1,000,000, and the base rules leave repeat_words at 500,000 or less.
RULES: dict[str, tuple[str, str, float | None, float | None, int]] = {
    "word_length": ("word_chars", "n_words", 6, 6, 250_000),
    "symbols": ("n_symbols", "word_chars", None, 6, 5_000),
    "dup_lines": ("n_dup_lines", "n_lines", None, 6, 1_000_000 // 12),
    "repeat_words": ("n_repeat_words", "n_words", None, 6, 500_000 // 12),
}
LEAST = 200


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The COUNTS and n_lines of each row."""
    rows = len(off) - 1
    if not len(data):
        return [np.zeros(rows, np.int64)] * 6
    starts, ends, bounds = word_spans(data, off)
    n_words, row = np.diff(bounds), rows_of(bounds)
    hasher = Hasher(data)
    chars = per_row(~SPACE[data] & ((data & 0xC0) != 0x80), off)
    # lines that hold a word
    cut = np.flatnonzero(data == 10)
    line_start = np.concatenate([off[:-1], cut + 1])
    line_end = np.concatenate([cut, off[1:]])
    line_start.sort()
    line_end.sort()
    spaced = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[spaced], line_end[spaced]
    line_row = np.searchsorted(off, line_start, "right") - 1
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    n_lines = np.bincount(line_row, minlength=rows)
    distinct = np.unique(mix(hasher(line_start, line_end) ^ salt[line_row]), return_index=True)[1]
    dup_lines = n_lines - np.bincount(line_row[distinct], minlength=rows)
    # words in windows of three that come again
    h = hasher(starts, ends)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        gram = mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + mix(h[2:]))) ^ salt[row[:-2]]
        inside = row[:-2] == row[2:]
        at = np.flatnonzero(inside)
        at = at[repeated(gram[at])]
        for k in range(3):
            covered[at + k] = True
    repeat = np.bincount(row[covered], minlength=rows)
    return [n_words, chars, per_row(_SYMBOL[data], off), dup_lines, repeat, n_lines]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        got = counts(*text_bytes(b.column("text")))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(x.astype(np.int64)) for x in got)],
            ["doc_id", "lang", "source", *COUNTS, "n_lines"],
        )


def measure(docs: DataFrame) -> DataFrame:
    """One row of counts per document."""
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    return wanted.mapInArrow(_measure, _SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    """The rule's ratio in millionths, rounded down; 0 where its denominator is 0."""
    top, bottom = RULES[name][:2]
    return F.expr(f"case when {bottom} > 0 then (1000000 * {top}) div {bottom} else 0L end")


def bucket(value: Column) -> Column:
    """Lower edge of the sketch bucket: the value with all but its six leading bits cleared."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts by lang, source and rule of the documents that pass the base rules. They
    merge by adding; map-side combining leaves a few hundred rows a group and task."""
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(ratio(r)).alias("bucket")) for r in RULES]))
    return (
        measured.filter(~base_failed()).select("lang", "source", rules.alias("_r"))
        .groupBy("lang", "source", "_r.rule", "_r.bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile of each rule's merged sketch, as bucket edges."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rule")
    ranked = merged.withColumn("below", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    return ranked.groupBy(*keys, "rule").agg(
        F.min(F.when(4 * F.col("below") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("below") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
        F.max("total").alias("docs"),
    )


def thresholds(sketch: DataFrame, least: int = LEAST, rules: dict = RULES) -> DataFrame:
    """Lowest and highest accepted value of each rule by (lang, source), one row a group."""
    fine, by_lang, overall = (_quartiles(sketch, k).alias(a) for k, a in ((["lang", "source"], "f"), (["lang"], "l"), ([], "o")))
    joined = fine.join(by_lang, F.col("f.lang").eqNullSafe(F.col("l.lang")) & (F.col("f.rule") == F.col("l.rule"))).join(
        overall, F.col("f.rule") == F.col("o.rule")
    )
    pick = lambda q: F.when(F.col("f.docs") >= least, F.col(f"f.{q}")).when(F.col("l.docs") >= least, F.col(f"l.{q}")).otherwise(F.col(f"o.{q}"))
    rows = joined.select(F.col("f.lang").alias("lang"), F.col("f.source").alias("source"), F.col("f.rule").alias("rule"), pick("q1").alias("q1"), pick("q3").alias("q3"))
    fences = []
    for rule, (_, _, low, high, slack) in rules.items():
        mine = lambda c, rule=rule: F.max(F.when(F.col("rule") == rule, c))
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(slack))
        fences.append((mine(F.col("q1") - low * spread) if low is not None else F.lit(None).cast("long")).cast("long").alias(f"{rule}_low"))
        fences.append((mine(F.col("q3") + high * spread) if high is not None else F.lit(None).cast("long")).cast("long").alias(f"{rule}_high"))
    return rows.groupBy("lang", "source").agg(*fences)


def quality(docs: DataFrame, least: int = LEAST, rules: dict = RULES) -> DataFrame:
    """Counts, base_failed and kept of every document.

    The counts are made once and kept as a narrow table. Thresholds are one row a group; they
    are broadcast only if the optimizer finds them under spark.sql.autoBroadcastJoinThreshold,
    else joined by shuffling the narrow rows, salted so that a hot group is spread.
    """
    measured = materialize(measure(docs), "quality-counts")
    salts = 16
    limits = thresholds(sketches(measured), least, rules).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    m = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")).alias("m")
    t = limits.alias("t")
    joined = m.join(t, F.col("m._salt").eqNullSafe(F.col("t._salt")) & F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    good = F.lit(True)
    for rule, (_, _, low, high, _) in rules.items():
        value = ratio(rule)
        if low is not None:
            good = good & (value >= F.col(f"{rule}_low"))
        if high is not None:
            good = good & (value <= F.col(f"{rule}_high"))
    return joined.select(
        "m.doc_id", *(f"m.{c}" for c in COUNTS), base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(good, F.lit(False))).alias("kept"),
    )


def _oracle(rules: dict = RULES) -> str:
    ratios = " UNION ALL ".join(
        f"SELECT rid, '{r}' AS rule, CASE WHEN {b} > 0 THEN (1000000 * {a}) // {b} ELSE 0 END AS v FROM f" for r, (a, b, *_) in rules.items()
    )
    bad = " OR ".join(
        f"(rule = '{r}' AND ({' OR '.join(x for x in (low is not None and f'v < q1 - {low} * greatest(q3 - q1, {slack})', high is not None and f'v > q3 + {high} * greatest(q3 - q1, {slack})') if x)}))"
        for r, (_, _, low, high, slack) in rules.items()
    )
    level = lambda name, keys: (
        f"{name} AS (SELECT {keys}rule, min(bucket) FILTER (4 * below >= total) AS q1, min(bucket) FILTER (4 * below >= 3 * total) AS q3, max(total) AS docs FROM ("
        f"SELECT {keys}rule, bucket, sum(n) OVER (PARTITION BY {keys}rule ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {keys}rule) AS total FROM ("
        f"SELECT {keys}rule, bucket, count(*) AS n FROM s GROUP BY ALL)) GROUP BY ALL)"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
 FROM w LEFT JOIN r ON r.rid = w.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
m AS ({ratios}),
s AS (SELECT f.lang, f.source, rule, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS bucket FROM m JOIN f ON f.rid = m.rid WHERE NOT base_failed),
{level('q2', 'lang, source, ')}, {level('q1', 'lang, ')}, {level('q0', '')},
q AS (SELECT a.lang, a.source, a.rule, CASE WHEN a.docs >= {LEAST} THEN a.q1 WHEN b.docs >= {LEAST} THEN b.q1 ELSE o.q1 END AS q1, CASE WHEN a.docs >= {LEAST} THEN a.q3 WHEN b.docs >= {LEAST} THEN b.q3 ELSE o.q3 END AS q3
 FROM q2 a JOIN q1 b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rule = b.rule JOIN q0 o ON a.rule = o.rule),
x AS (SELECT DISTINCT m.rid FROM m JOIN f ON f.rid = m.rid JOIN q ON q.lang IS NOT DISTINCT FROM f.lang AND q.source IS NOT DISTINCT FROM f.source AND q.rule = m.rule WHERE {bad.replace('rule =', 'm.rule =')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM x) AS kept FROM f
"""


ORACLE = _oracle()
