"""Candidate relations between entities, mapped to the edge catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which kinds of entities an edge may join, and the words that tell two edges of the same kinds apart.
CATALOG = [
    ("EXPLOITED_BY", ["cve"], ["threat_actor", "malware_family", "campaign"], None),
    ("USES", ["threat_actor", "malware_family", "campaign"], ["malware_family", "ttp"], None),
    ("HAS_SAMPLE", ["malware_family"], ["ioc"], "sample|hash|file"),
    ("COMMUNICATES_WITH", ["malware_family"], ["ioc"], "communicat|c2|callback|beacon"),
    ("ASSOCIATED_WITH", ["threat_actor", "campaign"], ["ioc"], None),
    ("INDICATES", ["ioc"], ["cve"], None),
    ("ATTRIBUTED_TO", ["campaign"], ["threat_actor"], None),
]
LABELS = {"cve": "CVE", "ttp": "TTP", "ioc": "IOC", "threat_actor": "ThreatActor", "malware_family": "MalwareFamily", "campaign": "Campaign"}
HEDGE = 0.5


def catalog(spark: SparkSession) -> DataFrame:
    """One row for each (edge, kind of start, kind of end)."""
    rows = [(e, s, t, words) for e, starts, ends, words in CATALOG for s in starts for t in ends]
    return spark.createDataFrame(rows, "edge_type string, start_type string, end_type string, words string")


def map_relations(relations: DataFrame) -> DataFrame:
    """(relation_id, edge_type, start_key, end_key, start_label, end_label, contribution) of relations that the catalog allows.

    relations: (relation_id, type_a, key_a, type_b, key_b, relationship, polarity, strength). Ends are put in the catalog's order, whatever order they came in. Of several edges exactly one must be named by its words. Negated relations go, hedged ones count half."""
    spark = relations.sparkSession
    c = F.broadcast(catalog(spark))  # a fixed table
    forward = (F.col("type_a") == F.col("start_type")) & (F.col("type_b") == F.col("end_type"))
    backward = (F.col("type_b") == F.col("start_type")) & (F.col("type_a") == F.col("end_type"))
    met = relations.where("polarity IS NULL OR polarity <> 'negated'").join(c, forward | backward).withColumn("fwd", forward)
    # Of one edge that fits both ways the forward one counts.
    met = met.groupBy("relation_id", "edge_type").agg(F.max_by(F.struct("fwd", "start_type", "end_type", "words", "key_a", "key_b", "relationship", "polarity", "strength"), F.col("fwd").cast("int")).alias("m")).select("relation_id", "edge_type", "m.*")
    named = F.coalesce(F.rlike(F.lower("relationship"), F.col("words")), F.lit(False))
    counts = met.groupBy("relation_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(named).alias("n_named"))
    kept = met.join(counts, "relation_id").where((F.col("n") == 1) | ((F.col("n_named") == 1) & named))
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    strength = F.col("strength") * F.when(F.col("polarity") == "hedged", HEDGE).otherwise(1.0)
    return kept.select(
        "relation_id", "edge_type", F.when(F.col("fwd"), F.col("key_a")).otherwise(F.col("key_b")).alias("start_key"), F.when(F.col("fwd"), F.col("key_b")).otherwise(F.col("key_a")).alias("end_key"),
        labels[F.col("start_type")].alias("start_label"), labels[F.col("end_type")].alias("end_label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength)).alias("contribution"),
    )


def resolvable(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of which both ends are entities that weren't rejected and have a key."""
    known = entities.where("resolution_status <> 'rejected' AND node_key <> ''").select("entity_type", "node_key").distinct()
    for x in ("a", "b"):
        relations = relations.join(known.withColumnsRenamed({"entity_type": f"type_{x}", "node_key": f"key_{x}"}), [f"type_{x}", f"key_{x}"], "left_semi")
    return relations


def cache_misses(texts: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """Texts, one of each hash, whose relations aren't cached."""
    return texts.join(cache.select(key), key, "left_anti").dropDuplicates([key])
