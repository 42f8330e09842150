"""Story clusters that grow by batches of articles, of which a batch reads and writes only those it touches.

Two tables (``StateTable``) hold the state: which cluster an article is in, and the articles of each cluster. A batch
brings articles and links. Each link's ends are looked up; what is joined is a contracted graph, whose nodes are the
clusters that links reach and the new articles. Clusters join and take in articles, they never split; where several
join, the id of that with the earliest article survives. Only articles of clusters that change are read, and their
rows are first written as the batch's changes; both tables and the messages are made from these, so a batch that is
tried again after a failure gives the same, whatever was done of it before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.operators import stories
from loomwatch.operators.components import components
from loomwatch.shared import remove, written
from loomwatch.streaming.tables import Folder, StateTable

ENTITIES = "array<struct<canonical_node_key: string, entity_type: string, resolution_status: string, node_confidence: double>>"
ARTICLE = f"article_id string, published_at timestamp, credibility_score double, entities {ENTITIES}"
CHANGE = f"{ARTICLE}, cluster_id string, old_cluster_id string, is_representative boolean, cluster_size long"


class Stories:
    """The state under a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.folder = spark, path, Folder(spark, path)
        self.by_article = StateTable(spark, f"{path}/by-article", "article_id string, cluster_id string", ["article_id"], buckets=buckets)
        self.by_cluster = StateTable(spark, f"{path}/by-cluster", f"{ARTICLE}, cluster_id string", ["cluster_id", "article_id"], by=["cluster_id"], buckets=buckets)

    def clusters(self) -> DataFrame:
        """(article columns, cluster_id) of all articles."""
        return self.by_cluster.read()

    def _changed(self, articles: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of CHANGE for a batch on the state as it is."""
        articles = written(articles.dropDuplicates(["article_id"]).where("article_id IS NOT NULL"), "story-batch")
        links = written(links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")), "story-batch-links")
        ends = links.select(F.explode(F.array("a", "b")).alias("article_id")).unionByName(articles.select("article_id")).distinct()
        known = written(self.by_article.get(ends), "story-known")
        new = articles.join(known, "article_id", "left_anti")
        own, cluster = F.concat(F.lit("article "), F.col("article_id")), F.concat(F.lit("cluster "), F.col("cluster_id"))
        # Links to articles that are neither known nor new wait for nothing: they are left out.
        nodes = known.select("article_id", cluster.alias("node")).unionByName(new.select("article_id", own.alias("node")))
        a, b = (nodes.withColumnsRenamed({"article_id": x, "node": f"_{x}"}) for x in ("a", "b"))
        edges = links.join(a, "a").join(b, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        labels = components(edges)
        joined = labels.where("node LIKE 'cluster %'").select(F.expr("substring(node, 9)").alias("cluster_id"), F.col("component").alias("cluster"))
        ids = written(joined, "story-touched")
        rows = self.by_cluster.get(ids.select("cluster_id")).join(ids, "cluster_id").select("article_id", "published_at", "credibility_score", "entities", F.col("cluster_id").alias("_old"), "cluster")
        fresh = new.withColumn("node", own).join(labels, "node", "left").select("article_id", "published_at", "credibility_score", "entities", F.lit(None).cast("string").alias("_old"), F.coalesce("component", "node").alias("cluster"))
        settled = stories.settle(rows.unionByName(fresh).withColumn("entities", F.col("entities").cast(ENTITIES))).where("changed")
        out = written(settled.select(*[f.split()[0] for f in ("article_id", "published_at", "credibility_score", "entities")], "cluster_id", F.col("_old").alias("old_cluster_id"), "is_representative", "cluster_size"), "story-changes")
        for df in (articles, links, known, ids):
            remove(df)
        return out

    def changes(self, number: int) -> DataFrame:
        """All articles of the clusters that a batch changed."""
        return self.spark.read.schema(CHANGE).parquet(f"{self.path}/changes/v={number}")

    def apply(self, articles: DataFrame, links: DataFrame, number: int) -> DataFrame:
        """Folds a batch in, and gives its changes. articles: columns of ARTICLE; links: (a, b), of which at least one is of the batch, and both are known or new."""
        if not self.folder.exists(f"changes/v={number}/_SUCCESS"):
            made = self._changed(articles, links)
            made.write.mode("overwrite").parquet(f"{self.path}/changes/v={number}")
            remove(made)
        changes = self.changes(number)
        # An id whose articles all move on comes without an article, so that its bucket is touched.
        gone = changes.select(F.col("old_cluster_id").alias("cluster_id")).where("cluster_id IS NOT NULL").distinct()
        both = changes.select(*self.by_cluster.schema.names).unionByName(gone, allowMissingColumns=True)

        def fold(old: DataFrame, batch: DataFrame) -> DataFrame:
            return old.join(batch.select("cluster_id").distinct(), "cluster_id", "left_anti").unionByName(batch.where("article_id IS NOT NULL"))

        self.by_cluster.apply(both, fold, number)
        moved = changes.where(~F.col("cluster_id").eqNullSafe(F.col("old_cluster_id")))
        self.by_article.put(moved.select("article_id", "cluster_id"), number)
        return changes

    def clean(self, keep: int = 1) -> None:
        """Removes what only batches before the last ``keep`` need."""
        self.by_article.clean(keep)
        self.by_cluster.clean(keep)
        for x in self.folder.names("changes"):
            if int(x[2:]) <= self.by_article.version() - keep:
                self.folder.remove(f"changes/{x}")

    def sink(self, links_of: Callable[[DataFrame, int], DataFrame], emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` over articles. links_of: (batch, number) -> links; emit: (messages, number) -> None, called after the state is written, and again if a batch is repeated."""

        def write(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            try:
                emit(cluster_messages(self.apply(batch, links_of(batch, number), number)), number)
            finally:
                batch.unpersist()

        return write


def cluster_messages(changes: DataFrame) -> DataFrame:
    """(key, value): a JSON message for each changed cluster, with its articles and the union of their entities, each by its highest confidence."""
    members = changes.groupBy("cluster_id").agg(F.array_sort(F.collect_list("article_id")).alias("article_ids"))
    each = changes.select("cluster_id", "article_id", F.explode("entities").alias("e"))
    rank = F.struct((-F.col("e.node_confidence")).alias("c"), "article_id", "e.entity_type", "e.resolution_status")
    best = each.groupBy("cluster_id", "e.canonical_node_key").agg(F.min_by("e", rank).alias("e"))
    union = best.groupBy("cluster_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    j = members.join(union, "cluster_id", "left")
    body = F.struct(F.col("cluster_id").alias("story_cluster_id"), "article_ids", F.coalesce("es", F.array().cast(ENTITIES)).alias("union_resolved_entities"))
    return j.select(F.col("cluster_id").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
