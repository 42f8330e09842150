"""Queries over merged nodes and edges, names in order, and the whole way from articles to edges."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.operators import graph, mentions, relations, resolve, stories
from loomwatch.operators.story_join import story_links
from loomwatch.plans import inputs, payloads, texts
from loomwatch.shared import written
from loomwatch.sources import stix
from loomwatch.streaming import messages, polls


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels share their keys, and nodes of one label only are merged: of the others' edges nothing changes."""
    a = inputs.assertions(spark, sf_dir)
    label = F.when(F.col("seq") % 2 == 0, "ThreatActor").otherwise("MalwareFamily").alias("start_label")
    edges = a.groupBy(label, "start_key", "rel_type", F.lit("IOC").alias("end_label"), "end_key").agg(
        F.max("contribution").alias("confidence"), F.array_sort(F.collect_set("source_id")).alias("feed_sources"), F.min("ts").alias("first_observed"), F.max("ts").alias("last_confirmed"),
        F.max("cluster_id").alias("note"),
    )
    key = F.col("start_key").cast("int")
    into = a.select(F.lit("ThreatActor").alias("label"), F.col("start_key").alias("merge_key"), (key - 1).cast("string").alias("canonical_key")).distinct().where("cast(merge_key AS int) % 3 = 1")
    out = graph.merge_labelled_edges(edges, into)
    return out.select(*graph.LABELLED, "confidence", F.array_join("feed_sources", ",").alias("feeds"), "first_observed", "last_confirmed", "note", "merged")


def attck_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's edges against what feeds of less credibility said of half of them."""
    catalog = stix.assertions(payloads._stix(spark, sf_dir), 7)
    said = catalog.where(F.length("start_key") % 2 == 0).select(*graph.EDGE, F.lit("feed0").alias("source_id"), F.lit(0.9).alias("credibility_score"), F.lit(3).cast("long").alias("ts"))
    e = graph.merge_authoritative(graph.authoritative_edges(said), catalog)
    return e.select(*graph.EDGE, "authoritative_confidence", F.size("feed_sources").cast("long").alias("n_feeds"), "first_observed", "last_confirmed")


def ladder_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order of events: known aliases, or names too far from all others, which are provisional once and known from then on."""
    number = F.col("id").cast("string")
    far = lambda c: F.concat(F.lit("q"), F.substring(F.sha2(c, 256), 1, 40))
    named = spark.range(20).select(F.concat(F.lit("G"), number).alias("merge_key"), far(number).alias("name"), F.array(F.concat(F.lit("alias  "), number)).alias("aliases"), F.col("id").alias("seq"))
    who = F.pmod("user_id", F.lit(60))
    surface = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" ALIAS "), F.pmod("event_id", F.lit(20)).cast("string"))).otherwise(F.upper(far(who.cast("string"))))
    rows = inputs.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("threat_actor").alias("entity_type"), surface.alias("surface_text"), F.lit(1.0).alias("extraction_confidence"))
    return resolve.resolve_in_order(rows, resolve.alias_index(named)).select("seq", "node_key", "resolution_status", "node_confidence")


def _name(k: int) -> str:
    return "Zz" + hashlib.sha256(str(k).encode()).hexdigest()[:12]


#: Names that articles mention, of which the first five are known.
NAMES, KNOWN = tuple(_name(k) for k in range(9)), 5


def threat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles to mentions (patterns and a model), entities, stories, relations of what an article names together, and scored edges."""
    a = inputs.articles(spark, sf_dir)
    name = F.when(F.col("article_id") % 3 == 0, F.concat(F.lit(" by "), F.get(F.array(*[F.lit(x) for x in NAMES]), (F.col("article_id") % 9).cast("int")), F.lit("."))).otherwise("")
    told = a.select("article_id", F.concat(F.expr(texts.SUFFIX.replace("doc_id", "article_id")), name).alias("text"))
    found = mentions.all_mentions(told, mentions.dictionary_model(dict.fromkeys(NAMES, "threat_actor"))).where(F.col("entity_type").isin("cve", "ttp", "threat_actor"))
    known = spark.createDataFrame([(f"G{k}", x, None, k) for k, x in enumerate(NAMES[:KNOWN])], "merge_key string, name string, aliases array<string>, seq long")
    techniques = spark.range(1000, 1030).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("technique_id"))
    entities = written(resolve.mention_edges(resolve.resolve_all(found, resolve.alias_index(known), techniques)), "graph-entities")
    links = story_links(entities, a, stories.simhash_arrow(a))
    story = stories.cluster_by_links(a.drop("text"), links).select("article_id", "cluster_id")
    of = lambda kind, key: entities.where(F.col("entity_type") == kind).select("article_id", F.col("node_key").alias(key))
    together = of("cve", "key_a").join(of("threat_actor", "key_b"), "article_id").join(story, "article_id").select("cluster_id", "key_a", "key_b").distinct()
    rel = together.select(
        F.concat_ws("|", "cluster_id", "key_a", "key_b").alias("relation_id"), F.lit("cve").alias("type_a"), "key_a", F.lit("threat_actor").alias("type_b"), "key_b", F.lit("exploited by").alias("relationship"),
        F.lit("asserted").alias("polarity"), F.lit(0.5).alias("strength"),
    )
    kinds = entities.withColumn("resolution_status", F.lit("resolved"))
    mapped = relations.map_relations(relations.resolvable(rel, kinds)).withColumnRenamed("edge_type", "rel_type")
    events = mapped.select(*graph.EDGE, "end_label", F.split("relation_id", "\\|")[0].alias("cluster_id"), "contribution", F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"))
    e = graph.inferred_edges(graph.guard_direction(events))
    return e.select(*graph.EDGE, F.round("inferred_confidence", 8).alias("confidence"), F.size("contributing_story_cluster_ids").cast("long").alias("n_stories"))


def queue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in envelopes of three, of queues and topics; some are broken, some have a record without a message."""
    d = inputs.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    g = F.floor(F.col("doc_id") / 3)
    body = F.to_json(F.struct("doc_id", "source", F.sha2("text", 256).alias("text_sha256")))
    record = F.struct(F.when(g % 2 == 0, body).alias("body"), F.when((g % 2 == 1) & (F.col("doc_id") % 15 != 4), F.struct(body.alias("Message"))).alias("Sns"))
    events = d.groupBy(g.alias("g")).agg(F.collect_list(record).alias("Records"))
    value = F.when(F.col("g") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("Records"))).alias("value")
    records, _ = messages.unwrapped(events.select(value))
    return polls.decoded(records, "doc_id long, source string, text_sha256 string", ["doc_id"])[0]


def resolved_article_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of articles with their entities, read back."""
    key = lambda i: F.concat(F.col("source"), F.lit("::"), F.col(i).cast("string"))
    d = inputs.table(spark, sf_dir, "documents")
    articles = d.select(key("doc_id").alias("article_id"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("title"), F.lit(None).cast("string").alias("published_at"))
    names = d.select(F.col("doc_id").alias("i"), key("doc_id").alias("key"))
    e = inputs.entities(spark, sf_dir).where("article_id % 4 <> 0").join(names, F.col("article_id") == F.col("i"))
    resolved = e.select(F.col("key").alias("article_id"), "entity_type", "node_key", F.lit("resolved").alias("resolution_status"), "node_confidence")
    good, _ = polls.decoded(messages.resolved_messages(articles, resolved), messages.SHAPES["resolved"], ["article_id", "source_id"])
    told = F.transform("resolved_entities", lambda x: F.concat_ws(":", x["entity_type"], x["canonical_node_key"], F.round(x["node_confidence"] * 10).cast("int").cast("string")))
    return good.select("article_id", "title", "published_at", "source_id", F.array_join(told, ",").alias("entities"))


QUERIES = {f.__name__: f for f in (merged_edges, attck_assertions, ladder_in_order, threat_graph, queue_records, resolved_article_messages)}

_MENTIONED = f"""entities AS (
  SELECT DISTINCT doc_id AS article_id, 'cve' AS entity_type, upper(unnest(regexp_extract_all(t, 'CVE-\\d{{4}}-\\d{{4,7}}'))) AS node_key FROM told
  UNION SELECT * FROM (SELECT DISTINCT doc_id, 'ttp', upper(unnest(regexp_extract_all(t, '\\bT\\d{{4}}(?:\\.\\d{{3}})?\\b'))) AS k FROM told) WHERE k IN (SELECT 'T' || i::VARCHAR FROM range(1000, 1030) r(i))
  UNION SELECT doc_id, 'threat_actor', CASE WHEN doc_id % 9 < {KNOWN} THEN 'G' || (doc_id % 9)::VARCHAR ELSE lower(({list(NAMES)!r})[doc_id % 9 + 1]) END FROM documents WHERE doc_id % 3 = 0
)"""
_TOLD = "told AS (SELECT doc_id, text || ' CVE-2024-' || (1000 + doc_id % 97)::VARCHAR || ' T' || (1000 + doc_id % 50)::VARCHAR || ' ' AS t FROM documents)"

SQL = {
    "merged_edges": f"""WITH {inputs.ASSERTIONS_SQL}, e AS (
  SELECT CASE WHEN seq % 2 = 0 THEN 'ThreatActor' ELSE 'MalwareFamily' END AS l, start_key, rel_type, end_key, max(contribution) AS c, list(DISTINCT source_id) AS f, min(ts) AS t0, max(ts) AS t1, max(cluster_id) AS note FROM assertions GROUP BY ALL
), m AS (
  SELECT l, CASE WHEN l = 'ThreatActor' AND start_key::INT % 3 = 1 THEN (start_key::INT - 1)::VARCHAR ELSE start_key END AS k, start_key, rel_type, end_key, c, f, t0, t1, note FROM e
)
SELECT l AS start_label, k AS start_key, rel_type, 'IOC' AS end_label, end_key, max(c) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(f)))), ',') AS feeds, min(t0) AS first_observed, max(t1) AS last_confirmed,
  coalesce(min(note) FILTER (WHERE k = start_key), min(note)) AS note, count(*) AS merged FROM m GROUP BY l, k, rel_type, end_key""",
    "attck_assertions": f"""WITH {payloads._STIX}, r AS (SELECT DISTINCT a.key AS s, CASE WHEN a.i % 3 = 1 THEN 'USES' ELSE 'ATTRIBUTED_TO' END AS t, b.key AS e FROM n a JOIN n b ON b.i = a.i + 1 WHERE a.i % 3 <> 0)
SELECT s AS start_key, t AS rel_type, e AS end_key, 1.0::DOUBLE AS authoritative_confidence, CASE WHEN length(s) % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_feeds, CASE WHEN length(s) % 2 = 0 THEN 3 ELSE 7 END::BIGINT AS first_observed, 7::BIGINT AS last_confirmed FROM r""",
    "ladder_in_order": """WITH e AS (SELECT event_id AS seq, event_id % 3 = 0 AS named, event_id % 20 AS g, user_id % 60 AS u FROM events
), n AS (SELECT *, row_number() OVER (PARTITION BY named, u ORDER BY seq) AS k FROM e)
SELECT seq, CASE WHEN named THEN 'G' || g::VARCHAR WHEN u < 20 THEN 'G' || u::VARCHAR ELSE 'q' || substr(sha256(u::VARCHAR), 1, 40) END AS node_key,
  CASE WHEN NOT named AND u >= 20 AND k = 1 THEN 'provisional' ELSE 'resolved' END AS resolution_status, CASE WHEN NOT named AND u >= 20 AND k = 1 THEN 0.99 ELSE 1.0 END::DOUBLE AS node_confidence FROM n""",
    "queue_records": """SELECT doc_id, source, sha256(text) AS text_sha256 FROM documents
WHERE (doc_id // 3) % 7 <> 0 AND NOT ((doc_id // 3) % 2 = 1 AND doc_id % 15 = 4)""",
    "resolved_article_messages": f"""WITH {inputs.ENTITIES_SQL}, e AS (
  SELECT article_id, string_agg(entity_type || ':' || node_key || ':' || round(node_confidence * 10)::INT::VARCHAR, ',' ORDER BY node_key, entity_type) AS t FROM entities WHERE article_id % 4 <> 0 GROUP BY article_id)
SELECT source || '::' || doc_id::VARCHAR AS article_id, CASE WHEN doc_id % 5 <> 0 THEN lang ELSE '' END AS title, '' AS published_at, source AS source_id, coalesce(t, '') AS entities FROM documents LEFT JOIN e ON article_id = doc_id""",
    "threat_graph": f"""WITH RECURSIVE {_TOLD}, {texts._SCORES.replace(inputs.ENTITIES_SQL, _MENTIONED)}, e AS (SELECT a, b FROM scores WHERE score >= 0.6 UNION ALL SELECT b, a FROM scores WHERE score >= 0.6
), r AS (SELECT article_id AS x, article_id AS y FROM articles UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y
), c AS (SELECT x AS article_id, min(y) AS c FROM r GROUP BY x
), pairs_named AS (SELECT DISTINCT c, p.node_key AS v, q.node_key AS w FROM entities p JOIN entities q USING (article_id) JOIN c USING (article_id) WHERE p.entity_type = 'cve' AND q.entity_type = 'threat_actor')
SELECT v AS start_key, 'EXPLOITED_BY' AS rel_type, w AS end_key, round(1 - pow(0.5, count(*)), 8)::DOUBLE AS confidence, count(*) AS n_stories FROM pairs_named GROUP BY v, w""",
}
