"""Streams of feed entries and polls.

``changes`` keeps the last fingerprint of each entry as keyed state; ``clusters_sink`` folds
micro-batches into a table. Both agree with their batch forms on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomwatch.operators.graph import upsert_nodes


class Changes(StatefulProcessor):
    """Emits an entry if its fingerprint is new (discovery) or differs from the stored one (update)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        entries = pd.concat(list(rows)).sort_values("seq")
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in entries.itertuples(index=False):
            if last != r.fingerprint:
                out.append((*key, r.seq, r.fingerprint, "discovery" if last is None else "update"))
                last = r.fingerprint
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["source_id", "guid", "seq", "fingerprint", "event_type"])

    def close(self) -> None: ...


class Health(StatefulProcessor):
    """Counts failures since a source's last success."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("failures", "n long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        n, last = self.n.get() if self.n.exists() else (0, None)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            n, last = (0, int(r.seq)) if r.ok else (n + 1, last)
        self.n.update((n, last))
        yield pd.DataFrame({"source_id": [key[0]], "consecutive_failures": [n], "last_success": pd.array([last], dtype="Int64")})

    def close(self) -> None: ...


def _rocks(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def changes(entries: DataFrame) -> DataFrame:
    """entries: a stream of (source_id, guid, seq, fingerprint)."""
    _rocks(entries.sparkSession)
    return entries.groupBy("source_id", "guid").transformWithStateInPandas(Changes(), "source_id string, guid string, seq long, fingerprint string, event_type string", "append", "None")


def health(polls: DataFrame, threshold: int = 6) -> DataFrame:
    """polls: a stream of (source_id, seq, ok). Each update replaces a source's row."""
    _rocks(polls.sparkSession)
    out = polls.groupBy("source_id").transformWithStateInPandas(Health(), "source_id string, consecutive_failures long, last_success long", "update", "None")
    return out.withColumn("alert", F.col("consecutive_failures") >= threshold)


def node_sink(path: str, keys: list[str], last: list[str], first: list[str] = ()):
    """For ``foreachBatch``: folds each micro-batch (with ``seq``) into the node table, a new version for each batch. A batch that is repeated writes the same version again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names = [*keys, *last, *first]
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else batch.select(*names).limit(0)
        upsert_nodes(old, batch, keys, last, first).write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def cluster_sink(path: str, articles: DataFrame, links_of):
    """For ``foreachBatch``: folds micro-batches of (article_id) into the table of clusters, a new version a batch. links_of: (batch, number) -> links (a, b)."""
    from loomwatch.operators.stories import assign_clusters

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("article_id").distinct()
        known = spark.read.parquet(f"{path}/v={number - 1}").select("article_id", "cluster_id") if number else new.limit(0).withColumn("cluster_id", F.lit(""))
        assign_clusters(known, links_of(batch, number), new, articles).write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def version_sink(path: str, apply):
    """For ``foreachBatch``: applies snapshots of domains whose version isn't the ingested one. batch: (domain, version, ...); apply: (due rows) -> None. A failed batch leaves the versions as they were."""
    from loomwatch.sources.stix import due, latest_versions

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={number - 1}") if number else batch.select("domain", "version").limit(0)
        latest = latest_versions(batch.select("domain", "version"))
        todo = due(latest, old)
        apply(batch.join(todo, ["domain", "version"], "left_semi"))
        kept = old.join(todo.select("domain"), "domain", "left_anti").unionByName(todo.select("domain", "version"))
        kept.write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


ARTICLE = "node_label string, article_id string, source_id string, guid string, cleaned_text string, title string, published_at string"


def announce_articles(articles: DataFrame) -> DataFrame:
    """(value): a JSON message for each article row, for whatever sink carries messages."""
    fields = [F.lit("Article").alias("node_label"), F.col("source_guid_key").alias("article_id"), "source_id", "guid", "cleaned_text", "title", "published_at"]
    return articles.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def announce_edges(outcomes: DataFrame) -> DataFrame:
    """(value): a JSON message for each written edge. outcomes: (EDGE, outcome, and, if known, origin)."""
    origin = F.col("origin") if "origin" in outcomes.columns else F.lit(None).cast("string").alias("origin")
    return outcomes.select(F.to_json(F.struct("rel_type", "start_key", "end_key", "outcome", origin), {"ignoreNullFields": "false"}).alias("value"))


def decoded(messages: DataFrame, schema: str, required: list[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): messages as columns, and those that are no JSON of the schema or lack a required field, as they came, with ``reason``."""
    parsed = messages.withColumn("_m", F.from_json(value, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    lacks = F.filter(F.array(*[F.when(F.col(f"_m.{c}").isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull()) if required else F.array().cast("array<string>")
    reason = F.when(F.col(value).isNull() | F.col("_m").isNull() | F.col("_m._bad").isNotNull(), "no message").when(F.size(lacks) > 0, F.concat(F.lit("lacks "), F.array_join(lacks, ", ")))
    rows = parsed.withColumn("reason", reason)
    return rows.where("reason IS NULL").select("_m.*").drop("_bad"), rows.where("reason IS NOT NULL").select(*messages.columns, "reason")


def articles_only(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(article announcements, all others) of JSON messages."""
    parsed = messages.select(F.from_json(value, "node_label string, article_id string, title string, cleaned_text string, published_at string").alias("m")).select("m.*")
    is_article = F.coalesce(F.col("node_label") == "Article", F.lit(False))
    return parsed.where(is_article), parsed.where(~is_article)
