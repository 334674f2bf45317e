"""Text, search and identity queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import search
from ..sources.supply import table
from .graph import SQL, Q, query

_STOP = ", ".join(f"'{w}'" for w in sorted(search.STOPWORDS))


def _sql_tokens(text: str) -> str:
    spaced = f"regexp_replace(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(string_split_regex({spaced}, '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH h AS (SELECT doc_id, 'sql:'||substr(sha1(translate(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g'), ' '), '{_CAPITALS}', '{_SMALL}')), 1, 16) AS id FROM documents)
SELECT id, count(*) AS n, min(doc_id) AS first FROM h GROUP BY id HAVING count(*) >= 2""")
def content_hash_dedupe(spark, sf_dir):
    """Copies among all documents, in any script. Only A to Z are the same in either case; null text counts as empty."""
    d = table(spark, sf_dir, "documents")
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", " "))
    h = d.select("doc_id", ids.content_id("sql", F.translate(spaced, _CAPITALS, _SMALL)).alias("id"))
    return h.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n >= 2")


@query(f"SELECT item_id, array_to_string({_sql_tokens('text')}, ' ') AS terms FROM benchmark")
def tokenise_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(search.tokens(F.col("text")), " ").alias("terms"))


_QUERY = "license version the thorndre einheit"
_BM25 = f"""d AS (SELECT doc_id AS doc, {_sql_tokens('text')} AS t, {_sql_tokens('source')} AS s FROM documents),
l AS (SELECT doc, greatest(len(t) + len(s), 1) AS length FROM d),
p AS (SELECT doc, term, sum(w) AS tf FROM (SELECT doc, unnest(t) AS term, 1.0 AS w FROM d UNION ALL SELECT doc, unnest(s), 3.0 FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
q AS (SELECT unnest(['license', 'version', 'thorndre', 'einheit']) AS term),
b AS (SELECT doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.6 + 0.4 * length / mean))) AS s FROM p JOIN q USING (term) JOIN f USING (term) JOIN l USING (doc), n GROUP BY doc)"""


def _lexical(spark, sf_dir, top_k):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "source")
    return search.bm25_scan(docs, {"text": 1.0, "source": 3.0}, search.query_terms(spark, _QUERY), top_k).select("doc", "score")


@query(f"WITH {_BM25} SELECT doc, round(s, 4) AS score FROM b ORDER BY score DESC, doc LIMIT 20")
def bm25_search(spark, sf_dir):
    return _lexical(spark, sf_dir, 20)


_VEC = "v AS (SELECT vec_id AS doc, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 4) AS score FROM embeddings)"


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(f"WITH {_VEC} SELECT doc, score FROM v ORDER BY score DESC, doc LIMIT 10")
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return search.nearest(v, _query_vector(spark, sf_dir))


@query(f"""WITH {_BM25}, {_VEC}, r1 AS (SELECT doc, row_number() OVER (ORDER BY round(s, 4) DESC, doc) AS r FROM b), r2 AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM v)
SELECT doc, round(sum(1 / (60 + r)), 6) AS score FROM (SELECT * FROM r1 WHERE r <= 50 UNION ALL SELECT * FROM r2 WHERE r <= 50) GROUP BY doc ORDER BY score DESC, doc LIMIT 10""")
def rrf_fusion(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return search.fuse([_lexical(spark, sf_dir, 50), search.nearest(v, _query_vector(spark, sf_dir), 50)])


@query("""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
 regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages""")
def url_parse(spark, sf_dir):
    g = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", g("^(https?)://").alias("scheme"), g("^https?://([^/?#]+)").alias("host"), g("^https?://[^/?#]+([^?#]*)").alias("path"), g("[?&]page=([0-9]+)").alias("page"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM h GROUP BY ALL""")
def href_edges(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, event_type AS name, CASE WHEN regexp_matches(lower(event_type||'_key'), 'password|secret|credential|key') AND props <> '' AND event_type = 'signup' THEN '***MASKED***' ELSE props END AS value FROM events""")
def masked_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "signup", F.concat("event_type", F.lit("_key"))).otherwise(F.col("event_type"))
    return e.select("event_id", F.col("event_type").alias("name"), ids.masked(name, F.col("props")).alias("value"))


@query("""SELECT p_partkey, upper(trim(p_name)) AS ident, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'db:'||upper(p_brand)||'.'||upper(trim(p_name)) AS object_id FROM part""")
def identity_columns(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ids.db_ident(F.col("p_name")).alias("ident"), ids.slug(F.col("p_name")).alias("slug"), ids.object_id(F.col("p_brand"), F.col("p_name")).alias("object_id"))


__all__ = ["Q", "SQL"]
