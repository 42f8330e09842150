"""Queries over graph state: upserts, edges, scores, differences, relations, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.functions import text as tx
from loomwatch.operators import graph, relations, resolve
from loomwatch.plans import inputs
from loomwatch.sources import feeds


def node_upsert_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers take the status of their last order and keep the priority of their first."""
    c = inputs.table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("string").alias("status"), F.when(F.col("c_custkey") % 2 == 0, F.lit("old")).alias("priority"))
    o = inputs.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("seq"))
    return graph.upsert_nodes(c, o, ["c_custkey"], last=["status"], first=["priority"])


def epss_enrich_existing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("cve_id"), F.lit(None).cast("double").alias("epss_score"))
    u = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cve_id"), (F.col("quality") * 0.5 + F.col("toxic") * 0.25).alias("epss_score"), F.col("doc_id").alias("seq"))
    return graph.update_existing(d, u, "cve_id", "epss_score")


def new_key_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events").select((F.col("user_id") * 3 - 20).alias("c_custkey"))
    return graph.new_keys(e, inputs.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


def _supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = inputs.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("start_key"), F.lit("USES").alias("rel_type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("end_key"), F.col("l_orderkey").alias("k"))
    nodes = inputs.table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_key"))
    nodes = nodes.unionByName(inputs.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_key")))
    return x.where("k % 3 = 0"), x.where("k % 3 <> 0"), nodes


def edge_merge_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, nodes = _supply(spark, sf_dir)
    outcomes, violations = graph.merge_edges(old, new, nodes)
    every = outcomes.unionByName(violations.withColumn("outcome", F.lit("violation")))
    return every.groupBy("start_key", "outcome").agg(F.count(F.lit(1)).alias("n_edges"))


def mentions_edge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.assertions(spark, sf_dir)
    keys = ["start_key", "end_key"]
    return graph.latest_edges(a.limit(0), a, keys, ["contribution", "cluster_id"])


def noisy_or_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.inferred_edges(inputs.assertions(spark, sf_dir))
    return e.select(*graph.EDGE, F.round("inferred_confidence", 8).alias("inferred_confidence"), F.array_join("contributing_story_cluster_ids", ",").alias("clusters"), "first_observed", "last_confirmed")


def _authoritative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.authoritative_edges(graph.credibility_of(inputs.assertions(spark, sf_dir), inputs.feeds(spark)))


def authoritative_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _authoritative(spark, sf_dir).select(*graph.EDGE, "authoritative_confidence", F.array_join("feed_sources", ",").alias("feeds"), "first_observed", "last_confirmed")


def edge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both components of edges; even events are of feeds, odd ones of stories."""
    a = inputs.assertions(spark, sf_dir)
    auth = graph.authoritative_edges(graph.credibility_of(a.where("seq % 2 = 0"), inputs.feeds(spark)))
    both = graph.combine_edges(auth, graph.inferred_edges(a.where("seq % 2 = 1")))
    return both.select(*graph.EDGE, F.round("confidence", 8).alias("confidence"), F.array_join("origin", ",").alias("origin"), "first_observed", "last_confirmed")


def recompute_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _authoritative(spark, sf_dir).withColumn("inferred_confidence", F.lit(0.55)).withColumn("confidence", F.greatest("authoritative_confidence", "inferred_confidence"))
    out = graph.recompute_for_feed(edges, inputs.feeds(spark), "feed1", 0.8)
    return out.select(*graph.EDGE, "authoritative_confidence", "confidence")


def capped_article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.capped_ids(inputs.assertions(spark, sf_dir), ["rel_type", "end_key"], cap=40)
    return out.select("rel_type", "end_key", F.array_join("source_article_ids", ",").alias("ids"), "supporting_article_count")


def cwe_resync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cve"), (F.col("l_partkey") % 100).alias("cwe"), "l_returnflag")
    return graph.difference(x.where("l_returnflag = 'R'"), x.where("l_returnflag = 'A'"), ["cve", "cwe"])


def freshness_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against the stored time of their customer."""
    o = inputs.table(spark, sf_dir, "orders")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    stored = o.where("o_orderkey % 4 = 0").groupBy("o_custkey").agg(fmt(F.max("o_orderdate")).alias("stored"))
    incoming = o.where("o_orderkey % 4 <> 0").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 11 != 0, fmt("o_orderdate")).alias("incoming"))
    j = incoming.join(stored, "o_custkey", "left")
    return j.select("o_orderkey", F.when(graph.is_fresher(F.col("incoming"), F.col("stored")), "resynced").otherwise("stale").alias("outcome"))


def retract_stale_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.entities(spark, sf_dir).select("article_id", F.when(F.col("entity_type") == "cve", "CVE").otherwise("TTP").alias("label"), "node_key")
    current = e.where("article_id % 3 = 0 AND (label = 'TTP' OR article_id % 2 = 0)")
    return graph.retract_stale(e, current, ["CVE"])


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("merge_key"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("Alias "), (F.col("s_suppkey") % 60).cast("string"))).alias("aliases"), F.col("s_suppkey").alias("seq"))


def alias_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = resolve.alias_index(_named(spark, sf_dir))
    names = inputs.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" alias "), (F.col("c_custkey") % 80).cast("string")).alias("n"))
    return names.join(aliases, resolve.normal("n") == aliases["alias"], "left").select("c_custkey", "merge_key")


def alias_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a letter swapped, against the aliases."""
    aliases = resolve.alias_index(_named(spark, sf_dir))
    names = inputs.table(spark, sf_dir, "supplier").select(F.lower(F.concat(F.lit("x"), F.substring("s_name", 2, 40))).alias("name"))
    return resolve.fuzzy_match(names, aliases)


def reconcile_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.assertions(spark, sf_dir).select("start_key", "rel_type", "end_key", F.col("contribution").alias("confidence"))
    mapping = a.select(F.col("start_key").alias("old_key")).distinct().where("cast(old_key AS int) % 3 = 1").select("old_key", (F.col("old_key").cast("int") - 1).cast("string").alias("new_key"))
    return graph.remap_edges(a, mapping)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in relations.LABELS])
    words = F.array(*[F.lit(w) for w in ("uses", "drops file", "beacons to C2", "file callback")])
    e = inputs.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("relation_id"), F.get(kinds, F.pmod("user_id", F.lit(6)).cast("int")).alias("type_a"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("key_a"), F.get(kinds, F.pmod("event_id", F.lit(6)).cast("int")).alias("type_b"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("key_b"),
        F.get(words, F.pmod(F.floor(F.col("event_id") / 6), F.lit(4)).cast("int")).alias("relationship"), F.when(F.col("event_id") % 5 == 0, "hedged").when(F.col("event_id") % 7 == 0, "negated").otherwise("asserted").alias("polarity"), (F.pmod("event_id", F.lit(13)) / 10.0).alias("strength"),
    )


def edge_catalog_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.map_relations(_candidates(spark, sf_dir)).withColumn("contribution", F.round("contribution", 6))


def re_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.articles(spark, sf_dir).select("content_hash")
    return relations.cache_misses(a, inputs.articles(spark, sf_dir).where("article_id % 2 = 0").select("content_hash"))


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events")
    return e.select(F.pmod("user_id", F.lit(20)).cast("string").alias("source_id"), F.pmod("event_id", F.lit(40)).cast("string").alias("guid"), F.col("event_id").alias("seq"), F.sha2(F.col("event_type"), 256).alias("fingerprint"), (F.col("event_type") != "click").alias("ok"))


def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.detect_changes(_polls(spark, sf_dir)).select("source_id", "guid", "seq", "event_type")


def poll_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polls(spark, sf_dir).withColumn("ok", F.pmod("seq", F.lit(97)) < F.pmod(F.col("source_id").cast("int"), F.lit(9)))
    return graph.poll_health(p)


def source_sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inputs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name", F.col("s_nationkey").alias("nation"))
    stored = s.where("source_id % 5 <> 1").withColumn("nation", F.when(F.col("source_id") % 4 == 0, F.col("nation") + 1).otherwise(F.col("nation")))
    return graph.sync_sources(s.where("source_id % 7 <> 1"), stored, "source_id", ["s_name", "nation"])


def http_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in (200, 204, 301, 401, 403, 404, 429, 500, 503)])
    e = inputs.table(spark, sf_dir, "events").select("event_id", F.get(codes, F.pmod("event_id", F.lit(9)).cast("int")).alias("status"), F.when(F.col("event_id") % 4 == 0, "7.5").when(F.col("event_id") % 4 == 1, "soon").alias("after"), (F.col("event_id") % 2 == 0).alias("valid"), F.pmod("event_id", F.lit(5)).cast("int").alias("attempt"))
    return e.select("event_id", tx.classify_response(F.col("status"), F.col("after"), F.col("valid"), F.col("attempt")).alias("r")).select("event_id", "r.action", "r.alert", "r.delay")


def credibility_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.credibility_of(inputs.assertions(spark, sf_dir).select("seq", "source_id"), inputs.feeds(spark)).select("seq", "source_id", "credibility_score")


def timestamps_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of orders, written in three ways, read back."""
    o = inputs.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    n = F.col("o_orderkey") % 4
    text = F.when(n == 0, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")).when(n == 1, F.concat(F.lit("Mon, "), F.date_format("t", "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))).when(n == 2, F.concat(F.lit("Mon, "), F.date_format("t", "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("no time")
    return o.select("o_orderkey", F.unix_micros(tx.parse_time(text)).alias("micros"))


def pulse_indicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as pulses: of ten indicators each, and one or two CVEs."""
    e = inputs.table(spark, sf_dir, "events").where("event_id IS NOT NULL").select(F.floor(F.col("event_id") / 10).cast("string").alias("id"), F.struct(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("CVE-2024-"), (1000 + F.col("event_id")).cast("string"))).when(F.col("event_id") % 30 == 1, "CVE-1999-0001").otherwise(F.concat(F.lit("h"), (F.col("user_id") % 500).cast("string"))).alias("indicator"), F.when((F.col("event_id") % 10 == 0) | (F.col("event_id") % 30 == 1), "CVE").when(F.col("event_id") % 2 == 0, "hostname").otherwise("Mutex").alias("type")).alias("i"))
    pulses = e.groupBy("id").agg(F.collect_list("i").alias("indicators")).select(F.array(F.struct("id", "indicators")).alias("results"))
    return feeds.otx(pulses)[2].select("start_key", "rel_type", "end_key")


QUERIES = {
    f.__name__: f
    for f in (
        node_upsert_lww, epss_enrich_existing_only, new_key_detection, edge_merge_outcome, mentions_edge_latest, noisy_or_edges, authoritative_edges, edge_confidence, recompute_feed, capped_article_ids, cwe_resync_diff, freshness_guard,
        retract_stale_mentions, alias_exact, alias_fuzzy, reconcile_merge_edges, edge_catalog_map, re_cache_miss, change_detection, poll_health, source_sync_diff, http_classify, credibility_lookup, timestamps_parsed,
        pulse_indicates,
    )
}

_A, _F = inputs.ASSERTIONS_SQL, inputs.FEEDS_SQL
_E = "start_key, rel_type, end_key"
_AUTH = f"""auth AS (SELECT {_E}, max(coalesce(credibility_score, 0.5)) AS authoritative_confidence, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS feeds, min(ts) AS first_observed, max(ts) AS last_confirmed
  FROM {{0}} LEFT JOIN feeds USING (source_id) GROUP BY ALL)"""
_INF = f"""one AS (SELECT {_E}, cluster_id, arg_min(contribution, seq) AS c, min(ts) AS t0, max(ts) AS t1 FROM {{0}} GROUP BY ALL
), inf AS (SELECT {_E}, 1 - product(1 - c) AS inferred_confidence, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters, min(t0) AS first_observed, max(t1) AS last_confirmed FROM one GROUP BY ALL)"""

SQL = {
    "node_upsert_lww": """WITH w AS (
  SELECT c_custkey, NULL::VARCHAR AS status, CASE WHEN c_custkey % 2 = 0 THEN 'old' END AS priority, -1::BIGINT AS seq FROM customer
  UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END, o_orderpriority, o_orderkey FROM orders)
SELECT c_custkey, (list(status ORDER BY seq DESC) FILTER (WHERE status IS NOT NULL))[1] AS status, (list(priority ORDER BY seq))[1] AS priority FROM w GROUP BY c_custkey""",
    "epss_enrich_existing_only": "SELECT d.doc_id AS cve_id, quality * 0.5::DOUBLE + toxic * 0.25::DOUBLE AS epss_score FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 3 <> 0",
    "new_key_detection": "SELECT DISTINCT user_id * 3 - 20 AS c_custkey FROM events WHERE user_id * 3 - 20 NOT IN (SELECT c_custkey FROM customer)",
    "edge_merge_outcome": """WITH x AS (SELECT l_suppkey AS s, l_partkey AS p, bool_or(l_orderkey % 3 = 0) AS old, bool_or(l_orderkey % 3 <> 0) AS new FROM lineitem GROUP BY ALL)
SELECT 's' || s::VARCHAR AS start_key, CASE WHEN p % 10 = 0 OR p NOT IN (SELECT p_partkey FROM part) OR s NOT IN (SELECT s_suppkey FROM supplier) THEN 'violation' WHEN old THEN 'matched' ELSE 'created' END AS outcome, count(*) AS n_edges FROM x WHERE new GROUP BY ALL""",
    "mentions_edge_latest": f"WITH {_A} SELECT start_key, end_key, arg_max(contribution, seq) AS contribution, arg_max(cluster_id, seq) AS cluster_id FROM assertions GROUP BY ALL",
    "noisy_or_edges": f"WITH {_A}, {_INF.format('assertions')} SELECT {_E}, round(inferred_confidence, 8) AS inferred_confidence, clusters, first_observed, last_confirmed FROM inf",
    "authoritative_edges": f"WITH {_A}, {_F}, {_AUTH.format('assertions')} SELECT * FROM auth",
    "edge_confidence": f"""WITH {_A}, {_F}, ev AS (SELECT * FROM assertions WHERE seq % 2 = 0), od AS (SELECT * FROM assertions WHERE seq % 2 = 1), {_AUTH.format('ev')}, {_INF.format('od')}
SELECT {_E}, round(greatest(coalesce(authoritative_confidence, 0), coalesce(inferred_confidence, 0)), 8) AS confidence, concat_ws(',', CASE WHEN authoritative_confidence IS NOT NULL THEN 'authoritative' END, CASE WHEN inferred_confidence IS NOT NULL THEN 'inferred' END) AS origin,
  least(auth.first_observed, inf.first_observed) AS first_observed, greatest(auth.last_confirmed, inf.last_confirmed) AS last_confirmed FROM auth FULL JOIN inf USING ({_E})""",
    "recompute_feed": f"""WITH {_A}, {_F}, each AS (SELECT DISTINCT {_E}, source_id FROM assertions), hit AS (SELECT DISTINCT {_E} FROM each WHERE source_id = 'feed1')
SELECT {_E}, max(CASE WHEN source_id = 'feed1' THEN 0.8 ELSE credibility_score END)::DOUBLE AS authoritative_confidence, greatest(max(CASE WHEN source_id = 'feed1' THEN 0.8 ELSE credibility_score END)::DOUBLE, 0.55) AS confidence
FROM each JOIN hit USING ({_E}) LEFT JOIN feeds USING (source_id) GROUP BY ALL""",
    "capped_article_ids": f"""WITH RECURSIVE {_A}, o AS (SELECT rel_type, end_key, art, row_number() OVER (PARTITION BY rel_type, end_key ORDER BY seq) AS k FROM assertions
), r AS (
  SELECT rel_type, end_key, k, [art] AS ids, 1::BIGINT AS n FROM o WHERE k = 1
  UNION ALL SELECT r.rel_type, r.end_key, o.k, CASE WHEN list_contains(ids, art) THEN ids ELSE list_append(ids, art)[1:40] END, n + CASE WHEN list_contains(ids, art) THEN 0 ELSE 1 END FROM r JOIN o ON o.rel_type = r.rel_type AND o.end_key = r.end_key AND o.k = r.k + 1
) SELECT rel_type, end_key, array_to_string(arg_max(ids, k), ',') AS ids, max(n) AS supporting_article_count FROM r GROUP BY ALL""",
    "cwe_resync_diff": """WITH r AS (SELECT DISTINCT l_suppkey AS cve, l_partkey % 100 AS cwe FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_suppkey AS cve, l_partkey % 100 AS cwe FROM lineitem WHERE l_returnflag = 'A')
SELECT *, 'delete' AS change FROM (FROM r EXCEPT FROM a) UNION ALL SELECT *, 'add' FROM (FROM a EXCEPT FROM r)""",
    "freshness_guard": """WITH s AS (SELECT o_custkey, max(o_orderdate) AS t FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT o_orderkey, CASE WHEN t IS NULL THEN 'resynced' WHEN o_orderkey % 11 = 0 THEN 'stale' WHEN date_trunc('second', o_orderdate) > date_trunc('second', t) THEN 'resynced' ELSE 'stale' END AS outcome FROM orders LEFT JOIN s USING (o_custkey) WHERE o_orderkey % 4 <> 0""",
    "retract_stale_mentions": f"""WITH {inputs.ENTITIES_SQL} SELECT article_id, CASE WHEN entity_type = 'cve' THEN 'CVE' ELSE 'TTP' END AS label, node_key FROM entities WHERE NOT (article_id % 3 = 0 AND entity_type = 'cve' AND article_id % 2 <> 0)""",
    "alias_exact": """WITH n AS (SELECT 'G' || s_suppkey::VARCHAR AS m, lower(trim(s_name)) AS a, s_suppkey * 2 AS o FROM supplier UNION ALL SELECT 'G' || s_suppkey::VARCHAR, 'alias ' || (s_suppkey % 60)::VARCHAR, s_suppkey * 2 + 1 FROM supplier
), i AS (SELECT a, arg_max(m, o) AS m FROM n GROUP BY a) SELECT c_custkey, m AS merge_key FROM customer LEFT JOIN i ON a = 'alias ' || (c_custkey % 80)::VARCHAR""",
    "reconcile_merge_edges": f"""WITH {_A}, m AS (SELECT CASE WHEN start_key::INT % 3 = 1 THEN (start_key::INT - 1)::VARCHAR ELSE start_key END AS s, rel_type, CASE WHEN end_key::INT % 3 = 1 AND end_key IN (SELECT start_key FROM assertions) THEN (end_key::INT - 1)::VARCHAR ELSE end_key END AS e, contribution FROM assertions)
SELECT s AS start_key, rel_type, e AS end_key, max(contribution) AS confidence, count(*) AS merged FROM m WHERE s <> e GROUP BY ALL""",
    "edge_catalog_map": """WITH k AS (SELECT ['cve', 'ttp', 'ioc', 'threat_actor', 'malware_family', 'campaign'] AS k, ['CVE', 'TTP', 'IOC', 'ThreatActor', 'MalwareFamily', 'Campaign'] AS l
), e AS (SELECT event_id AS id, k[user_id % 6 + 1] AS a, 'a' || user_id::VARCHAR AS ka, k[event_id % 6 + 1] AS b, 'b' || event_id::VARCHAR AS kb, ['uses', 'drops file', 'beacons to c2', 'file callback'][(event_id // 6) % 4 + 1] AS r,
  CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 1.0 END * (event_id % 13) / 10.0 AS s FROM events, k WHERE event_id % 5 = 0 OR event_id % 7 <> 0
), c(t, ss, ee, w) AS (VALUES ('EXPLOITED_BY', ['cve'], ['threat_actor', 'malware_family', 'campaign'], NULL), ('USES', ['threat_actor', 'malware_family', 'campaign'], ['malware_family', 'ttp'], NULL), ('HAS_SAMPLE', ['malware_family'], ['ioc'], 'sample|hash|file'),
  ('COMMUNICATES_WITH', ['malware_family'], ['ioc'], 'communicat|c2|callback|beacon'), ('ASSOCIATED_WITH', ['threat_actor', 'campaign'], ['ioc'], NULL), ('INDICATES', ['ioc'], ['cve'], NULL), ('ATTRIBUTED_TO', ['campaign'], ['threat_actor'], NULL)
), m AS (SELECT e.*, c.t, w, list_contains(ss, a) AND list_contains(ee, b) AS f FROM e JOIN c ON (list_contains(ss, a) AND list_contains(ee, b)) OR (list_contains(ss, b) AND list_contains(ee, a))
), n AS (SELECT *, coalesce(regexp_matches(r, w), false) AS hit, count(*) OVER (PARTITION BY id) AS n, count(*) FILTER (WHERE coalesce(regexp_matches(r, w), false)) OVER (PARTITION BY id) AS h FROM m)
SELECT id AS relation_id, t AS edge_type, CASE WHEN f THEN ka ELSE kb END AS start_key, CASE WHEN f THEN kb ELSE ka END AS end_key, l[list_position(k, CASE WHEN f THEN a ELSE b END)] AS start_label, l[list_position(k, CASE WHEN f THEN b ELSE a END)] AS end_label, round(least(1, greatest(0, s))::DOUBLE, 6) AS contribution
FROM n, k WHERE n = 1 OR (h = 1 AND hit)""",
    "re_cache_miss": "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)",
    "change_detection": """WITH p AS (SELECT (user_id % 20)::VARCHAR AS source_id, (event_id % 40)::VARCHAR AS guid, event_id AS seq, event_type AS f FROM events), l AS (SELECT *, lag(f) OVER (PARTITION BY source_id, guid ORDER BY seq) AS b FROM p)
SELECT source_id, guid, seq, CASE WHEN b IS NULL THEN 'discovery' ELSE 'update' END AS event_type FROM l WHERE b IS NULL OR b <> f""",
    "poll_health": """WITH p AS (SELECT (user_id % 20)::VARCHAR AS source_id, event_id AS seq, event_id % 97 < (user_id % 20) % 9 AS ok FROM events), l AS (SELECT source_id, max(seq) FILTER (WHERE ok) AS last_success FROM p GROUP BY 1)
SELECT l.source_id, count(*) FILTER (WHERE NOT ok AND (last_success IS NULL OR seq > last_success)) AS consecutive_failures, last_success, count(*) FILTER (WHERE NOT ok AND (last_success IS NULL OR seq > last_success)) >= 6 AS alert FROM p JOIN l USING (source_id) GROUP BY l.source_id, last_success""",
    "source_sync_diff": """SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 5 = 1 THEN 'create' WHEN s_suppkey % 7 = 1 THEN 'delete' WHEN s_suppkey % 4 = 0 THEN 'update' ELSE 'same' END AS action FROM supplier WHERE NOT (s_suppkey % 5 = 1 AND s_suppkey % 7 = 1)""",
    "http_classify": """WITH e AS (SELECT event_id, [200, 204, 301, 401, 403, 404, 429, 500, 503][event_id % 9 + 1] AS s FROM events)
SELECT event_id, CASE WHEN s IN (401, 403) THEN 'no_retry' WHEN s = 429 THEN 'retry_after' WHEN s >= 500 THEN 'retry' WHEN s >= 300 THEN 'no_retry' WHEN event_id % 2 = 0 THEN 'ok' ELSE 'no_retry' END AS action, s IN (401, 403) AS alert,
  CASE WHEN s = 429 THEN CASE WHEN event_id % 4 = 0 THEN 7.5 ELSE pow(2.0, event_id % 5) END END AS delay FROM e""",
    "credibility_lookup": f"WITH {_A}, {_F} SELECT seq, source_id, coalesce(credibility_score, 0.5) AS credibility_score FROM assertions LEFT JOIN feeds USING (source_id)",
    "timestamps_parsed": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN epoch_us(date_trunc('second', o_orderdate)) END AS micros FROM orders",
    "pulse_indicates": """WITH e AS (SELECT event_id // 10 AS id, event_id AS i, event_id % 10 = 0 OR event_id % 30 = 1 AS cve, CASE WHEN event_id % 10 = 0 THEN 'CVE-2024-' || (1000 + event_id)::VARCHAR WHEN event_id % 30 = 1 THEN 'CVE-1999-0001' ELSE 'h' || (user_id % 500)::VARCHAR END AS v FROM events
), c AS (SELECT id, min(v) AS v FROM e WHERE cve GROUP BY id HAVING count(*) = 1)
SELECT DISTINCT e.v || '::' || CASE WHEN i % 2 = 0 THEN 'domain' ELSE 'mutex' END AS start_key, 'INDICATES' AS rel_type, c.v AS end_key FROM e JOIN c USING (id) WHERE NOT cve""",
}
