"""Lexical, vector and fused search over document tables.

An index is three narrow tables, postings (doc, term, tf), documents (doc, length, prior) and terms (term, df), each a
single aggregation; a query joins its few terms with the postings, so only the postings of those terms move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Rounds

K1, B, RRF_K = 1.5, 0.4, 60
STOPWORDS = frozenset("a an and are as at be by for from in is it of on or that the this to was with".split())


def tokens(text: Column, stopwords: frozenset[str] = STOPWORDS) -> Column:
    """Lower-case words of two characters or more, cut at others than letters and digits and where the case changes."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), lambda w: (F.length(w) > 1) & ~w.isin(*sorted(stopwords)))


@dataclass
class Index:
    postings: DataFrame
    documents: DataFrame
    terms: DataFrame

    def save(self, path: str) -> None:
        for name in ("postings", "documents", "terms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "documents", "terms")))


def index(docs: DataFrame, fields: dict[str, float], prior: Column | None = None) -> Index:
    """Of docs (doc and the fields); a field's weight multiplies its terms' frequency. Length counts tokens unweighted, 1 at least."""
    each = docs.select("doc", (prior if prior is not None else F.lit(1.0)).alias("prior"), F.array(*[F.struct(F.lit(w).alias("w"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f, w in fields.items()]).alias("f"))
    postings = each.select("doc", F.explode("f").alias("f")).select("doc", F.col("f.w").alias("w"), F.explode("f.t").alias("term")).groupBy("doc", "term").agg(F.sum("w").alias("tf"))
    length = F.aggregate("f", F.lit(0), lambda n, f: n + F.size(f["t"]))
    return Index(postings, each.select("doc", "prior", F.greatest(length, F.lit(1)).alias("length")), postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def query_terms(spark: SparkSession, query: str, synonyms: dict[str, list[str]] | None = None, weight: float = 0.45) -> DataFrame:
    """term and weight: the query's own words weigh 1, their synonyms less, and a term the most it gets."""
    q = spark.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"))).alias("term")).withColumn("weight", F.lit(1.0))
    if synonyms:
        s = spark.createDataFrame([(a, b) for a, l in synonyms.items() for b in l], "term string, other string")
        q = q.unionByName(q.join(s, "term").select(F.col("other").alias("term"), F.lit(weight).alias("weight")))
    return q.groupBy("term").agg(F.max("weight").alias("weight"))


def bm25(idx: Index, terms: DataFrame, top_k: int = 10) -> DataFrame:
    """doc, score and the matched terms of weight 1, best first."""
    n = idx.documents.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hits = idx.postings.join(terms, "term").join(idx.terms, "term").join(idx.documents, "doc").crossJoin(n)  # n is one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.groupBy("doc").agg((F.sum(part) * F.max("prior")).alias("s"), F.array_sort(F.collect_set(F.when(F.col("weight") >= 1, F.col("term")))).alias("matched"))
    return scored.select("doc", F.round("s", 4).alias("score"), "matched").orderBy(F.desc("score"), "doc").limit(top_k)


def bm25_scan(docs: DataFrame, fields: dict[str, float], terms: DataFrame, top_k: int = 10) -> DataFrame:
    """What bm25() gives, without an index: one pass over docs (doc and the fields) cuts the texts into words and keeps of each
    only its length and the query's words, which are as few as the query has."""
    asked = {r.term: r.weight for r in terms.select("term", "weight").collect()}
    parts = [F.struct(F.lit(w).alias("w"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f, w in fields.items()]
    each = docs.select("doc", F.transform(F.array(*parts), lambda f: F.struct(f["w"].alias("w"), F.size(f["t"]).alias("n"), F.filter(f["t"], lambda x: x.isin(*asked)).alias("t"))).alias("f"))
    length = F.greatest(F.aggregate("f", F.lit(0), lambda n, f: n + f["n"]), F.lit(1))
    each = Rounds(docs.sparkSession).hold(each.select("doc", length.alias("length"), F.transform("f", lambda f: F.struct(f["w"].alias("w"), f["t"].alias("t"))).alias("f")))
    postings = each.select("doc", "length", F.explode("f").alias("f")).select("doc", "length", F.col("f.w").alias("w"), F.explode("f.t").alias("term")).groupBy("doc", "length", "term").agg(F.sum("w").alias("tf"))
    whole = Index(postings.drop("length"), each.select("doc", F.lit(1.0).alias("prior"), "length"), postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return bm25(whole, terms, top_k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or all zeros."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], top_k: int = 10) -> DataFrame:
    """doc and score of the vectors (doc, vector) with the largest cosine, by a full scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("doc", F.round(cosine(F.col("vector"), q), 4).alias("score")).orderBy(F.desc("score"), "doc").limit(top_k)


def fuse(lists: list[DataFrame], top_k: int = 10, keep: Column | None = None) -> DataFrame:
    """doc and score: reciprocal ranks, from 1, over 60 plus the rank, summed over lists of (doc, score), each cut at five times top_k.
    The filter comes after fusion."""
    parts = []
    for one in lists:
        w = Window.orderBy(F.desc("score"), "doc")  # one task, of at most 5 top_k rows
        parts.append(one.orderBy(F.desc("score"), "doc").limit(5 * top_k).withColumn("r", F.row_number().over(w)).select("doc", (1 / (RRF_K + F.col("r"))).alias("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fused = out.groupBy("doc").agg(F.round(F.sum("s"), 6).alias("score"))
    return (fused.filter(keep) if keep is not None else fused).orderBy(F.desc("score"), "doc").limit(top_k)
