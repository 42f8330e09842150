"""Queries that merge batches into stored state: edges, clusters, sources, polls, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.operators import graph, mentions, relations, resolve, stories
from loomwatch.plans import inputs, payloads
from loomwatch.streaming import polls

#: No cap, so that the ids of an edge are a set.
ALL = 1_000_000


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = inputs.assertions(spark, sf_dir)
    return a.where("seq % 3 = 0"), a.where("seq % 3 <> 0")


def noisy_or_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of a second batch are merged into what the first left; stories that were seen change nothing."""
    one, two = _batches(spark, sf_dir)
    none = spark.createDataFrame([], f"start_key string, rel_type string, end_key string, {graph.INFERRED}")
    e = graph.merge_inferred(graph.merge_inferred(none, one, ALL), two, ALL)
    return e.select(*graph.EDGE, F.round("inferred_confidence", 8).alias("inferred_confidence"), F.array_join("contributing_story_cluster_ids", ",").alias("clusters"), F.array_join(F.array_sort("source_article_ids"), ",").alias("ids"), "supporting_article_count", "first_observed", "last_confirmed")


def authoritative_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (graph.credibility_of(b, inputs.feeds(spark)) for b in _batches(spark, sf_dir))
    e = graph.merge_authoritative(graph.authoritative_edges(one), two)
    return e.select(*graph.EDGE, "authoritative_confidence", F.array_join("feed_sources", ",").alias("feeds"), "first_observed", "last_confirmed")


def edge_property_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of edges that are created once and matched later."""
    a = inputs.assertions(spark, sf_dir).select(*graph.EDGE, "seq")
    text = F.col("seq").cast("string")
    old = a.where("seq % 5 = 0").select(*graph.EDGE).distinct().withColumn("props", F.create_map(F.lit("origin"), F.lit("old"), F.lit("mode"), F.lit("keep")))
    mode = F.when(F.col("seq") % 2 == 1, F.concat(F.lit("m"), (F.col("seq") % 3).cast("string")))
    new = a.where("seq % 5 <> 0").withColumns({"on_create": F.create_map(F.lit("created"), text, F.lit("mode"), F.lit("new")), "on_match": F.create_map(F.lit("last"), text, F.lit("mode"), mode)})
    nodes = a.select(F.col("start_key").alias("node_key")).unionByName(a.select(F.col("end_key").alias("node_key"))).distinct().where("cast(node_key AS int) % 10 <> 3")
    out = graph.merge_properties(old, new, nodes)
    return out.withColumnRenamed("created", "is_new").select(*graph.EDGE, *[F.try_element_at("props", F.lit(p)).alias(p) for p in ("origin", "created", "last", "mode")], "is_new")


def freshness_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as modification payloads of their customers, in order."""
    o = inputs.table(spark, sf_dir, "orders")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cve_id")
    old = o.where("o_orderkey % 4 = 0 AND o_custkey % 5 <> 0").groupBy("o_custkey").agg(F.max("o_orderdate").alias("t"))
    old = old.select(key, F.lit("old").alias("status"), F.array(F.lit("w")).alias("cwe_ids"), F.when(F.col("o_custkey") % 7 != 0, text("t")).alias("last_modified"))
    new = o.where("o_orderkey % 4 <> 0").select(key, F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"), F.array(F.col("o_orderkey").cast("string")).alias("cwe_ids"), F.when(F.col("o_orderkey") % 11 != 0, text("o_orderdate")).alias("last_modified"), F.col("o_orderkey").alias("seq"))
    # An order is at most one row of either.
    per = graph.fold_deltas(old, new, "cve_id", ["status"], "cwe_ids", parts=graph.parts_for(o.count()))
    had = F.col("absent") + F.col("resynced") + F.col("stale") > 0
    return per.select("cve_id", *[F.when(had, F.col(x)).alias(x) for x in graph.OUTCOMES], "status", F.array_join("cwe_ids", ",").alias("cwes"), "last_modified")


def poll_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events")
    polled = e.select(F.pmod("user_id", F.lit(20)).cast("string").alias("source_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("started_at"), (F.col("event_type") != "click").alias("ok"))
    return graph.poll_windows(polled).select("source_id", "seq", "window_start", "window_end")


def source_nodes_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inputs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name", F.col("s_nationkey").alias("nation"))
    stored = s.where("source_id % 5 <> 1").withColumn("nation", F.when(F.col("source_id") % 4 == 0, F.col("nation") + 1).otherwise(F.col("nation"))).withColumn("is_active", F.col("source_id") % 3 != 0)
    return graph.sync_source_nodes(s.where("source_id % 7 <> 1"), stored, "source_id", ["s_name", "nation"])


def source_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.outcome_counts(source_nodes_sync(spark, sf_dir), outcome="change")


def recompute_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.authoritative_edges(graph.credibility_of(inputs.assertions(spark, sf_dir), inputs.feeds(spark))).withColumn("inferred_confidence", F.lit(0.55)).withColumn("confidence", F.greatest("authoritative_confidence", "inferred_confidence"))
    return graph.touched_by_feed(edges, inputs.feeds(spark), "feed1", 0.95)


def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of orders, some of which share a key."""
    o = inputs.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 13 != 0, F.concat(F.lit("CVE-"), (F.col("o_orderkey") % 1000 + F.col("o_custkey")).cast("string"))).alias("cve_id"))
    return graph.key_violations(o, "CVE")


def story_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of three articles each get a fourth; every third group's bridges to the next one's cluster."""
    a = inputs.articles(spark, sf_dir).select("article_id", "published_at", "credibility_score")
    g = F.floor(F.col("article_id") / 4)
    known = a.where("article_id % 4 <> 3").select("article_id", F.concat(F.lit("c"), g.cast("string")).alias("cluster_id"))
    new = a.where("article_id % 4 = 3").select("article_id")
    joins = new.where(g % 3 == 0)
    links = joins.select(F.col("article_id").alias("a"), (F.col("article_id") - 3).alias("b")).unionByName(joins.select(F.col("article_id").alias("a"), (F.col("article_id") + 1).alias("b")))
    return stories.assign_clusters(known, links, new, a)


def stale_mentions_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third article was extracted again, some of them to nothing."""
    e = inputs.entities(spark, sf_dir).select("article_id", F.when(F.col("entity_type") == "cve", "CVE").otherwise("TTP").alias("label"), "node_key")
    return graph.retract_stale(e, e.where("article_id % 3 = 0 AND article_id % 2 = 0"), ["CVE", "TTP"], e.where("article_id % 3 = 0").select("article_id"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents")
    n, i = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    kinds = F.array(*[F.lit(k) for k in ("cve", "ttp", "ioc", "ioc", "threat_actor", "tool")])
    surface = F.when(n == 0, F.concat(F.lit("CVE-2024-"), i)).when(n == 1, F.concat(F.lit("T"), (1000 + F.col("doc_id") % 40).cast("string"))).when(n == 2, F.concat(F.lit("http://H/"), i)).when(n == 3, F.concat(F.lit("Host"), i, F.lit(".Example"))).when(n == 4, F.concat(F.lit("  Alias\t"), (F.col("doc_id") % 80).cast("string"))).otherwise("x")
    return d.select(F.col("doc_id").alias("article_id"), F.get(kinds, n.cast("int")).alias("entity_type"), F.when(n == 2, "url").when(n == 3, "domain").alias("ioc_type"), surface.alias("surface_text"), (F.col("doc_id") % 11 / 10.0).alias("extraction_confidence"))


def resolve_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of all kinds by their ladders. Names are aliases of entities, or too far from all of them."""
    number = F.col("id").cast("string")
    hashed = F.concat(F.lit("q"), F.substring(F.sha2(number, 256), 1, 40))
    named = spark.range(60).select(F.concat(F.lit("G"), number).alias("merge_key"), hashed.alias("name"), F.array(F.concat(F.lit("alias "), number)).alias("aliases"), F.col("id").alias("seq"))
    m = _mentions(spark, sf_dir).withColumn("surface_text", F.when((F.col("entity_type") == "threat_actor") & (F.col("article_id") % 80 >= 60), F.concat(F.lit("Zz "), F.sha1(F.col("article_id").cast("string")))).otherwise(F.col("surface_text")))
    techniques = spark.range(30).select(F.concat(F.lit("T"), (F.col("id") + 1000).cast("string")).alias("technique_id"))
    return resolve.resolve_all(m, resolve.alias_index(named), techniques).select("article_id", "entity_type", "node_key", "resolution_status", "node_confidence")


def model_mentions_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's mentions: the least word of a text, or, of every fourth article, something invented."""
    d = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    least = F.regexp_replace(F.array_min(F.split("text", " ")), "^$", "█")
    m = d.select("article_id", F.lit("threat_actor").alias("entity_type"), F.when(F.col("article_id") % 4 == 0, "█ invented").otherwise(least).alias("surface_text"), (F.col("article_id") % 12 / 10.0).alias("extraction_confidence"))
    return mentions.guard_model_mentions(m, d)


def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional nodes merged into canonical ones: aliases by node."""
    s = inputs.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nodes = s.select(F.lit("ThreatActor").alias("label"), name(k).alias("merge_key"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("a"), (k % 4).cast("string"))).alias("aliases"))
    merges = s.where("s_suppkey % 5 IN (1, 2)").select(F.lit("ThreatActor").alias("label"), name(k).alias("merge_key"), name(k - k % 5).alias("canonical_key"))
    edges = spark.createDataFrame([], "start_key string, rel_type string, end_key string, confidence double")
    left, _ = resolve.merge_nodes(nodes, edges, merges)
    return left.select("merge_key", "name", F.array_join("aliases", ",").alias("aliases"))


def relations_resolvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events")
    rel = e.select(F.col("event_id").alias("relation_id"), F.lit("cve").alias("type_a"), F.concat(F.lit("k"), F.pmod("user_id", F.lit(40)).cast("string")).alias("key_a"), F.lit("ttp").alias("type_b"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(30)).cast("string")).alias("key_b"))
    n = spark.range(40)
    status = F.when(F.col("id") % 7 == 0, "rejected").otherwise("resolved")
    known = n.select(F.explode(F.array(F.lit("cve"), F.lit("ttp"))).alias("entity_type"), F.when(F.col("id") % 11 == 0, "").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("node_key"), status.alias("resolution_status"))
    return relations.resolvable(rel, known).select("relation_id", "key_a", "key_b")


def message_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements of articles, some of them damaged, read back."""
    d = inputs.table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("s::"), F.col("doc_id").cast("string")).alias("source_guid_key"), F.col("source").alias("source_id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("guid"), F.col("text").alias("cleaned_text"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("published_at"))
    sent = polls.announce_articles(rows.where("guid IS NULL OR cast(guid AS long) % 3 <> 0")).unionByName(rows.where("cast(guid AS long) % 3 = 0").select(F.concat(F.lit("{damaged "), F.col("guid")).alias("value")))
    good, bad = polls.decoded(sent, polls.ARTICLE, ["node_label", "article_id", "guid"])
    kept = good.select(F.lit("good").alias("kind"), F.length("cleaned_text").cast("long").alias("chars"))
    return kept.unionByName(bad.select(F.col("reason").alias("kind"), F.lit(0).cast("long").alias("chars"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def edge_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message of each edge of which a batch was merged, read back."""
    a = inputs.assertions(spark, sf_dir)
    nodes = a.select(F.col("start_key").alias("node_key")).unionByName(a.select(F.col("end_key").alias("node_key"))).distinct()
    outcomes, _ = graph.merge_edges(a.where("seq % 3 = 0"), a.where("seq % 3 <> 0"), nodes)
    sent = polls.announce_edges(outcomes.withColumn("origin", F.lit("inferred")))
    good, _ = polls.decoded(sent, "rel_type string, start_key string, end_key string, outcome string, origin string", ["rel_type", "outcome"])
    return good.groupBy("rel_type", "outcome", "origin").agg(F.count(F.lit(1)).alias("n"))


def feed_edges_asserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of two feeds as authoritative assertions."""
    edges = payloads.otx_edges(spark, sf_dir).unionByName(payloads.threatfox_relations(spark, sf_dir))
    sources = spark.createDataFrame([("otx", 0.6)], "source_id string, credibility_score double")
    e = graph.authoritative_edges(graph.feed_assertions(edges, sources, 7))
    return e.select(*graph.EDGE, "authoritative_confidence", F.array_join("feed_sources", ",").alias("feeds"), "first_observed", "last_confirmed")


def credible_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of each group of equal articles, by the credibility that its source has, if it is known."""
    a = inputs.articles(spark, sf_dir).select("article_id", "content_hash", "published_at", F.concat(F.lit("feed"), (F.col("article_id") % 7).cast("string")).alias("source_id"))
    return stories.elect(stories.with_credibility(a, inputs.feeds(spark)), "content_hash").select("content_hash", "article_id", "cluster_size", "credibility_score")


QUERIES = {
    f.__name__: f
    for f in (
        noisy_or_two_batches, authoritative_two_batches, edge_property_merge, freshness_fold, poll_watermarks, source_nodes_sync, source_sync_counts, recompute_touched, key_uniqueness, story_bridge,
        stale_mentions_processed, resolve_mentions, model_mentions_guarded, merged_nodes, relations_resolvable, message_quarantine, edge_announcements, feed_edges_asserted, credible_representatives,
    )
}

_A, _F = inputs.ASSERTIONS_SQL, inputs.FEEDS_SQL
_E = "start_key, rel_type, end_key"
_SYNC = """WITH n AS (
  SELECT s_suppkey AS i, s_name, s_nationkey AS nation, s_suppkey % 7 <> 1 AS cfg, s_suppkey % 5 <> 1 AS has, s_suppkey % 4 = 0 AS moved, s_suppkey % 3 <> 0 AS act FROM supplier
), r AS (SELECT i AS source_id, s_name, nation + CASE WHEN NOT cfg AND moved THEN 1 ELSE 0 END AS nation, cfg AS is_active,
  CASE WHEN NOT has THEN 'created' WHEN NOT cfg AND act THEN 'deactivated' WHEN cfg AND (moved OR NOT act) THEN 'updated' ELSE 'same' END AS change FROM n WHERE cfg OR has)"""

SQL = {
    "noisy_or_two_batches": f"""WITH {_A}, o AS (SELECT *, (seq % 3 <> 0)::INT AS batch, row_number() OVER (PARTITION BY {_E}, cluster_id ORDER BY (seq % 3 <> 0)::INT, seq) AS k FROM assertions)
SELECT {_E}, round(1 - product(1 - contribution) FILTER (WHERE k = 1), 8) AS inferred_confidence, string_agg(cluster_id, ',' ORDER BY cluster_id) FILTER (WHERE k = 1) AS clusters,
  array_to_string(list_sort(list(DISTINCT art) FILTER (WHERE k = 1)), ',') AS ids, count(DISTINCT art) FILTER (WHERE k = 1) AS supporting_article_count,
  coalesce(min(ts) FILTER (WHERE batch = 0), min(ts)) AS first_observed, max(ts) AS last_confirmed FROM o GROUP BY ALL""",
    "authoritative_two_batches": f"""WITH {_A}, {_F} SELECT {_E}, max(coalesce(credibility_score, 0.5)) AS authoritative_confidence, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS feeds, min(ts) AS first_observed, max(ts) AS last_confirmed
FROM assertions LEFT JOIN feeds USING (source_id) GROUP BY {_E}""",
    "edge_property_merge": f"""WITH {_A}, e AS (SELECT {_E}, bool_or(seq % 5 = 0) AS old, list(seq ORDER BY seq) FILTER (WHERE seq % 5 <> 0 AND start_key::INT % 10 <> 3 AND end_key::INT % 10 <> 3) AS w FROM assertions GROUP BY {_E})
SELECT {_E}, CASE WHEN old THEN 'old' END AS origin, CASE WHEN NOT old THEN w[1]::VARCHAR END AS created, CASE WHEN old OR len(w) > 1 THEN w[-1]::VARCHAR END AS last,
  CASE WHEN w IS NULL THEN 'keep' WHEN NOT old AND len(w) = 1 THEN 'new' WHEN w[-1] % 2 = 1 THEN 'm' || (w[-1] % 3)::VARCHAR END AS mode, NOT old AS is_new FROM e WHERE old OR w IS NOT NULL""",
    "freshness_fold": """WITH s AS (SELECT o_custkey AS c, CASE WHEN o_custkey % 7 <> 0 THEN strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') END AS t FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 5 <> 0 GROUP BY 1
), i AS (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS m, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS st FROM orders WHERE o_orderkey % 4 <> 0
), j AS (SELECT i.*, s.c IS NOT NULL AS has, s.t, greatest(s.t, max(m) OVER (PARTITION BY i.c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS w FROM i LEFT JOIN s ON s.c = i.c
), o AS (SELECT *, CASE WHEN NOT has THEN 'absent' WHEN w IS NULL OR m > w THEN 'resynced' ELSE 'stale' END AS outcome FROM j
), p AS (SELECT c, count(*) FILTER (WHERE outcome = 'absent') AS absent, count(*) FILTER (WHERE outcome = 'resynced') AS resynced, count(*) FILTER (WHERE outcome = 'stale') AS stale,
  (list(st ORDER BY k DESC) FILTER (WHERE st IS NOT NULL AND has))[1] AS st, max(k) FILTER (WHERE outcome = 'resynced') AS r, (list(m ORDER BY k DESC) FILTER (WHERE outcome = 'resynced' AND m IS NOT NULL))[1] AS m FROM o GROUP BY c)
SELECT 'c' || coalesce(p.c, s.c)::VARCHAR AS cve_id, absent, resynced, stale, CASE WHEN s.c IS NOT NULL THEN coalesce(p.st, 'old') END AS status, CASE WHEN s.c IS NOT NULL THEN coalesce(p.r::VARCHAR, 'w') END AS cwes, coalesce(p.m, s.t) AS last_modified
FROM p FULL JOIN s ON s.c = p.c""",
    "poll_watermarks": """WITH p AS (SELECT (user_id % 20)::VARCHAR AS source_id, event_id AS seq, epoch_us(ts) AS t, event_type <> 'click' AS ok FROM events)
SELECT source_id, seq, coalesce(last_value(CASE WHEN ok THEN t END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t - 86400000000) AS window_start, t AS window_end FROM p""",
    "source_nodes_sync": f"{_SYNC} SELECT * FROM r",
    "source_sync_counts": f"{_SYNC} SELECT change, count(*) AS n FROM r GROUP BY change",
    "recompute_touched": f"""WITH {_A}, {_F}, each AS (SELECT DISTINCT {_E}, source_id FROM assertions), hit AS (SELECT DISTINCT {_E} FROM each WHERE source_id = 'feed1'
), e AS (SELECT {_E}, greatest(max(coalesce(credibility_score, 0.5)), 0.55) AS was, greatest(max(CASE WHEN source_id = 'feed1' THEN 0.95 ELSE credibility_score END), 0.55) AS now FROM each JOIN hit USING ({_E}) LEFT JOIN feeds USING (source_id) GROUP BY ALL)
SELECT rel_type, count(*) AS touched, count(*) FILTER (WHERE now > was) AS raised, count(*) FILTER (WHERE now < was) AS lowered FROM e GROUP BY rel_type""",
    "key_uniqueness": "SELECT 'CVE' AS label, 'CVE-' || (o_orderkey % 1000 + o_custkey)::VARCHAR AS key, count(*) AS n FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY ALL HAVING count(*) > 1",
    "story_bridge": f"""WITH {inputs.ARTICLES_SQL}, a AS (SELECT article_id AS i, article_id // 4 AS g, hour, credibility_score AS c, article_id % 4 <> 3 AS known FROM articles
), m AS (SELECT *, CASE WHEN NOT known AND g % 3 <> 0 THEN 'n' || i::VARCHAR ELSE 'g' || (CASE WHEN g % 3 = 1 THEN g - 1 ELSE g END)::VARCHAR END AS comp FROM a
), o AS (SELECT comp, 'c' || g::VARCHAR AS id, min(hour) AS h FROM m WHERE known GROUP BY comp, g
), s AS (SELECT comp, (list(id ORDER BY h, id))[1] AS id FROM o GROUP BY comp
), b AS (SELECT comp, (list(i ORDER BY hour, c DESC, i))[1] AS best, count(*) AS n, count(DISTINCT g) FILTER (WHERE known) AS k, count(*) FILTER (WHERE known) AS kn FROM m GROUP BY comp)
SELECT i AS article_id, coalesce(s.id, sha256(best::VARCHAR)) AS cluster_id, i = best AS is_representative, CASE WHEN i = best THEN n END AS cluster_size, k <> 1 OR kn <> n AS changed FROM m JOIN b USING (comp) LEFT JOIN s USING (comp)""",
    "stale_mentions_processed": f"WITH {inputs.ENTITIES_SQL} SELECT article_id, CASE WHEN entity_type = 'cve' THEN 'CVE' ELSE 'TTP' END AS label, node_key FROM entities WHERE NOT (article_id % 3 = 0 AND article_id % 2 <> 0)",
    "resolve_mentions": """WITH m AS (SELECT doc_id AS i, doc_id % 6 AS n, doc_id % 11 / 10.0 AS c, doc_id % 40 AS t, doc_id % 80 AS a FROM documents WHERE doc_id % 6 <> 5)
SELECT i AS article_id, ['cve', 'ttp', 'ioc', 'ioc', 'threat_actor'][n + 1] AS entity_type,
  CASE n WHEN 0 THEN 'CVE-2024-' || i::VARCHAR WHEN 1 THEN CASE WHEN t < 30 THEN 'T' || (1000 + t)::VARCHAR ELSE '' END WHEN 2 THEN 'http://H/' || i::VARCHAR || '::url' WHEN 3 THEN 'host' || i::VARCHAR || '.example::domain'
    ELSE CASE WHEN a >= 60 THEN 'zz ' || sha1(i::VARCHAR) ELSE 'G' || a::VARCHAR END END AS node_key,
  CASE WHEN n = 1 AND t >= 30 THEN 'rejected' WHEN n = 4 AND a >= 60 THEN 'provisional' ELSE 'resolved' END AS resolution_status, CASE WHEN n = 1 AND t >= 30 THEN 0.0 WHEN n = 4 AND a >= 60 THEN least(c, 0.99) ELSE c END::DOUBLE AS node_confidence FROM m""",
    "model_mentions_guarded": """SELECT doc_id AS article_id, 'threat_actor' AS entity_type, list_min(string_split(text, ' ')) AS surface_text, least(doc_id % 12 / 10.0, 0.99)::DOUBLE AS extraction_confidence FROM documents
WHERE doc_id % 4 <> 0 AND list_min(string_split(text, ' ')) <> ''""",
    "merged_nodes": """WITH s AS (SELECT s_suppkey AS k, s_name FROM supplier), m AS (SELECT k - k % 5 AS k, list_sort(list(DISTINCT s_name)) AS more FROM s WHERE k % 5 IN (1, 2) GROUP BY 1)
SELECT 'n' || s.k::VARCHAR AS merge_key, s_name AS name, array_to_string(list_concat(['a' || (s.k % 4)::VARCHAR], coalesce(more, [])), ',') AS aliases FROM s LEFT JOIN m ON m.k = s.k WHERE s.k % 5 NOT IN (1, 2)""",
    "relations_resolvable": """WITH r AS (SELECT event_id AS relation_id, user_id % 40 AS a, event_id % 30 AS b FROM events)
SELECT relation_id, 'k' || a::VARCHAR AS key_a, 'k' || b::VARCHAR AS key_b FROM r WHERE a % 7 <> 0 AND a % 11 <> 0 AND b % 7 <> 0 AND b % 11 <> 0""",
    "message_quarantine": """WITH d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'lacks guid' WHEN doc_id % 3 = 0 THEN 'no message' ELSE 'good' END AS kind, length(text) AS l FROM documents)
SELECT kind, count(*) AS n, sum(CASE WHEN kind = 'good' THEN l ELSE 0 END)::BIGINT AS chars FROM d GROUP BY kind""",
    "feed_edges_asserted": f"""WITH {payloads._OTX}, {payloads._FOX}
SELECT DISTINCT v || '::' || t AS start_key, 'INDICATES' AS rel_type, cve AS end_key, 0.6::DOUBLE AS authoritative_confidence, 'otx' AS feeds, 7::BIGINT AS first_observed, 7::BIGINT AS last_confirmed FROM p WHERE v IS NOT NULL AND doc_id % 6 <> 0
UNION ALL SELECT lower(trim(f)), CASE WHEN k IN ('md5_hash', 'sha256_hash') THEN 'HAS_SAMPLE' ELSE 'COMMUNICATES_WITH' END, v || '::' || k, 0.5, 'threatfox', 7, 7 FROM t""",
    "credible_representatives": f"""WITH {inputs.ARTICLES_SQL}, {_F}, r AS (
  SELECT content_hash, article_id, f.credibility_score AS c, row_number() OVER (PARTITION BY content_hash ORDER BY hour, f.credibility_score DESC NULLS LAST, article_id) AS k, count(*) OVER (PARTITION BY content_hash) AS n
  FROM articles a LEFT JOIN feeds f ON f.source_id = 'feed' || (article_id % 7)::VARCHAR)
SELECT content_hash, article_id, n AS cluster_size, c AS credibility_score FROM r WHERE k = 1""",
    "edge_announcements": f"""WITH {_A}, e AS (SELECT {_E}, bool_or(seq % 3 = 0) AS old, bool_or(seq % 3 <> 0) AS new FROM assertions GROUP BY {_E})
SELECT rel_type, CASE WHEN old THEN 'matched' ELSE 'created' END AS outcome, 'inferred' AS origin, count(*) AS n FROM e WHERE new GROUP BY ALL""",
}
