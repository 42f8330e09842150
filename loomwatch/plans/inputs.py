"""Inputs of the registered queries, derived from the driver's tables by rules that SQL has too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: published within 48 hours, credible by their source."""
    d = table(spark, sf_dir, "documents")
    t = F.timestamp_seconds(F.lit(1704067200) + F.pmod("doc_id", F.lit(48)) * 3600)
    score = F.round(0.5 + F.pmod(F.substring("source", 4, 9).cast("int"), F.lit(5)) / 10.0, 1)
    return d.select(F.col("doc_id").alias("article_id"), "text", "source", t.alias("published_at"), F.sha2("text", 256).alias("content_hash"), score.alias("credibility_score"))


ARTICLES_SQL = """articles AS (
  SELECT doc_id AS article_id, text, source, (doc_id % 48) AS hour, sha256(text) AS content_hash, round(0.5 + (substr(source, 4)::INT % 5) / 10.0, 1) AS credibility_score FROM documents
)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entities of each article: one of its words, which copies share, and one by its number."""
    d = table(spark, sf_dir, "documents")
    words = d.select("doc_id", tx.find_all(F.col("text"), "[A-Za-z0-9]+").alias("w"))
    mark = F.concat_ws("|", F.array_max("w"), F.array_min("w"), F.floor(F.size("w") / 20).cast("string"))
    one = words.select(F.col("doc_id").alias("article_id"), F.lit("cve").alias("entity_type"), F.substring(F.sha2(mark, 256), 1, 7).alias("node_key"), (F.pmod("doc_id", F.lit(10)) / 10.0).alias("node_confidence"))
    two = d.select(F.col("doc_id").alias("article_id"), F.lit("ttp").alias("entity_type"), F.concat(F.lit("T"), F.pmod("doc_id", F.lit(50)).cast("string")).alias("node_key"), (F.pmod("doc_id", F.lit(7)) / 10.0).alias("node_confidence"))
    return one.unionByName(two)


ENTITIES_SQL = """entities AS (
  SELECT doc_id AS article_id, 'cve' AS entity_type, substr(sha256(concat_ws('|', list_max(w), list_min(w), (len(w) // 20)::VARCHAR)), 1, 7) AS node_key, (doc_id % 10) / 10.0 AS node_confidence
  FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents)
  UNION ALL SELECT doc_id, 'ttp', 'T' || (doc_id % 50)::VARCHAR, (doc_id % 7) / 10.0 FROM documents
)"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assertions: of a feed, and of a story, about an edge."""
    e = table(spark, sf_dir, "events")
    share = F.round(F.pmod(F.abs("value"), F.lit(1.0)), 3)
    return e.select(
        F.pmod("user_id", F.lit(200)).cast("string").alias("start_key"), F.col("event_type").alias("rel_type"), F.pmod("event_id", F.lit(7)).cast("string").alias("end_key"), F.concat(F.lit("feed"), F.pmod("event_id", F.lit(5)).cast("string")).alias("source_id"),
        F.concat(F.lit("s"), F.pmod("event_id", F.lit(50)).cast("string")).alias("cluster_id"), share.alias("contribution"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), F.array(F.pmod("event_id", F.lit(90)).cast("string")).alias("article_ids"),
    )


ASSERTIONS_SQL = """assertions AS (
  SELECT (user_id % 200)::VARCHAR AS start_key, event_type AS rel_type, (event_id % 7)::VARCHAR AS end_key, 'feed' || (event_id % 5)::VARCHAR AS source_id, 's' || (event_id % 50)::VARCHAR AS cluster_id,
         round(abs(value) % 1.0, 3) AS contribution, epoch_us(ts) AS ts, event_id AS seq, (event_id % 90)::VARCHAR AS art FROM events
)"""


def feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("feed0", 0.9), ("feed1", 0.6), ("feed2", 0.75), ("feed3", 1.0)], "source_id string, credibility_score double")


FEEDS_SQL = "feeds(source_id, credibility_score) AS (VALUES ('feed0', 0.9::DOUBLE), ('feed1', 0.6), ('feed2', 0.75), ('feed3', 1.0))"
