"""Queries over documents: selection, counting, shaping and folding of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import shaping
from ..functions.text import blank_to_null
from ..sources.tables import table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("documents_profile", """SELECT source, count(*) AS n, count(text) AS n_text, count(*) FILTER (WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) = '') AS n_blank, count(DISTINCT symbol) AS n_symbols, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY source""")
def documents_profile(spark, root):
    d = table(spark, root, "documents", ["source", "text", "symbol", "n_chars"])
    return d.groupBy("source").agg(
        F.count("*").alias("n"), F.count("text").alias("n_text"), F.count_if(F.col("text").isNotNull() & blank_to_null(F.col("text")).isNull()).alias("n_blank"),
        F.count_distinct("symbol").alias("n_symbols"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"),
    )


@query("language_folded", "SELECT coalesce(nullif(lower(regexp_extract(lang, '^([A-Za-z]{2})', 1)), ''), 'und') AS lang, count(*) AS n FROM documents GROUP BY ALL")
def language_folded(spark, root):
    """Documents per language, spelling variants of a code together."""
    d = table(spark, root, "documents", ["lang"])
    two = F.lower(F.regexp_extract("lang", "^([A-Za-z]{2})", 1))
    return d.groupBy(F.coalesce(F.when(two != "", two), F.lit("und")).alias("lang")).agg(F.count("*").alias("n"))


@query("mention_count", """SELECT doc_id, symbol, CAST((length(text) - length(replace(text, symbol, ''))) // length(symbol) AS BIGINT) AS n FROM documents WHERE length(symbol) > 0 AND text IS NOT NULL""")
def mention_count(spark, root):
    """Occurrences of a document's symbol anywhere in its text."""
    d = table(spark, root, "documents", ["doc_id", "symbol", "text"]).where("length(symbol) > 0 AND text IS NOT NULL")
    less = F.length("text") - F.length(F.replace("text", F.col("symbol"), F.lit("")))
    return d.select("doc_id", "symbol", F.floor(less / F.length("symbol")).cast("long").alias("n"))


@query("word_mentions", """WITH d AS (SELECT doc_id, symbol, CASE WHEN length(symbol) > 0 THEN regexp_replace(replace(text, symbol, chr(1)), '([^A-Za-z0-9' || chr(1) || '])', '\\1\\1', 'g') END AS body FROM documents WHERE symbol IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, symbol, CAST(len(regexp_extract_all(body, '(^|[^A-Za-z0-9' || chr(1) || '])' || chr(1) || '([^A-Za-z0-9' || chr(1) || ']|$)')) AS INTEGER) AS n FROM d""")
def word_mentions(spark, root):
    """Occurrences of a document's symbol as a word of its own."""
    d = table(spark, root, "documents", ["doc_id", "symbol", "text"]).where("symbol IS NOT NULL AND text IS NOT NULL")
    return d.select("doc_id", "symbol", shaping.mentions(F.col("text"), F.col("symbol")).alias("n"))


@query("news_topk", """SELECT symbol, doc_id, CAST(row_number() OVER (PARTITION BY symbol ORDER BY strpos(text, symbol) > 0 DESC, published_at DESC, doc_id DESC) AS INTEGER) AS rank FROM documents
WHERE symbol IS NOT NULL AND text IS NOT NULL AND source_type = 'news' QUALIFY rank <= 20""")
def news_topk(spark, root):
    """The 20 newest texts of each symbol, those that name it first. The rank limit is applied before the shuffle."""
    d = table(spark, root, "documents", ["doc_id", "symbol", "text", "published_at", "source_type"])
    d = d.where("symbol IS NOT NULL AND text IS NOT NULL AND source_type = 'news'").select(
        "symbol", "doc_id", "published_at", F.contains("text", F.col("symbol")).alias("named")
    )
    w = Window.partitionBy("symbol").orderBy(F.desc("named"), F.desc_nulls_last("published_at"), F.desc("doc_id"))
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("symbol", "doc_id", "rank")


@query("head_tail_shape", """SELECT doc_id, length(text) > 400 AS was_cut, md5(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 300) || chr(10) || '[... omitted ...]' || chr(10) || right(text, 100) END) AS digest FROM documents WHERE text IS NOT NULL""")
def head_tail_shape(spark, root):
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text IS NOT NULL")
    return d.select("doc_id", (F.length("text") > 400).alias("was_cut"), F.md5(shaping.head_tail(F.col("text"), 400, 0.75)).alias("digest"))


_FLAGS = {
    "advice": r"(?i)\b(buy|sell|accumulate|reduce) now\b",
    "certainty": r"(?i)\b(guaranteed|certain to|will definitely)\b",
    "figure": r"[0-9]+(\.[0-9]+)?%",
    "money": r"(USD|EUR|[$€£]) ?[0-9]",
}


@query("language_rules", "SELECT source_type, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS n_{k}" for k, p in _FLAGS.items()) + ", count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY source_type")
def language_rules(spark, root):
    """Texts that match each rule, by kind of source."""
    d = table(spark, root, "documents", ["source_type", "text"]).where("text IS NOT NULL")
    return d.groupBy("source_type").agg(*[F.count_if(F.col("text").rlike(p)).alias(f"n_{k}") for k, p in _FLAGS.items()], F.count("*").alias("n"))


@query("publication_lag", """SELECT source, count(*) AS n, round(avg(epoch(fetched_at) - epoch(published_at)), 3) AS mean_lag_s, count(*) FILTER (WHERE fetched_at > published_at + INTERVAL 1 DAY) AS n_late FROM documents GROUP BY source""")
def publication_lag(spark, root):
    d = table(spark, root, "documents", ["source", "published_at", "fetched_at"])
    lag = F.unix_micros("fetched_at") / 1e6 - F.unix_micros("published_at") / 1e6
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(lag), 3).alias("mean_lag_s"), F.count_if(F.col("fetched_at") > F.col("published_at") + F.expr("INTERVAL 1 DAY")).alias("n_late"))


@query("text_digests", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def text_digests(spark, root):
    """Exact copies by digest: only the digest is shuffled, and combined map-side."""
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text IS NOT NULL")
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("folded_copies")
def folded_copies(spark, root):
    """Copies that differ only in character form, quotes, dashes, blanks or letter case."""
    d = table(spark, root, "documents", ["doc_id", "text"]).where("text IS NOT NULL")
    return d.groupBy(F.md5(shaping.folded("text")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("text_chunks")
def text_chunks(spark, root):
    """Pieces of each text whose JSON form fits 500 characters."""
    d = table(spark, root, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.posexplode(shaping.chunked("text", F.lit(500))).alias("position", "piece"))


@query("citation_links", """WITH v AS (SELECT DISTINCT run_id, symbol, reasons_json AS j FROM verdicts), p AS (SELECT run_id, symbol, CASE json_type(j::JSON) WHEN 'ARRAY' THEN j::JSON WHEN 'OBJECT' THEN json_extract(j::JSON, '$.reasons') END AS a FROM v WHERE json_valid(j)),
s AS (SELECT run_id, symbol, unnest(CAST(json_extract_string(a, '$[*].source_ids[*]') AS VARCHAR[])) AS id FROM p WHERE a IS NOT NULL)
SELECT DISTINCT s.run_id, s.symbol, d.doc_id, d.source_type FROM s JOIN documents d ON d.source = split_part(s.id, ':', 1) AND CAST(d.doc_id AS VARCHAR) = split_part(s.id, ':', 2)""")
def citation_links(spark, root):
    """Verdicts with the documents they cite."""
    from . import ledger

    ids = ledger.reasons(spark, root).select("run_id", "symbol", F.explode("x.source_ids").alias("id")).distinct()
    part = lambda k: F.split_part("id", F.lit(":"), F.lit(k))
    ids = ids.select("run_id", "symbol", part(1).alias("source"), F.expr("try_cast(split_part(id, ':', 2) as bigint)").alias("doc_id"))
    d = table(spark, root, "documents", ["doc_id", "source", "source_type"])
    return ids.join(d, ["source", "doc_id"]).select("run_id", "symbol", "doc_id", "source_type").distinct()


QUERIES = Q
