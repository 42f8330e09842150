"""STIX 2.1 bundles: objects by type to node tables, relationships to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.functions import text as tx

BUNDLE = (
    "objects array<struct<type:string,id:string,name:string,description:string,aliases:array<string>,malware_types:array<string>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
    "external_references:array<struct<source_name:string,external_id:string,url:string>>,first_seen:string,last_seen:string,objective:string,x_mitre_deprecated:boolean,revoked:boolean,x_mitre_revoked_by_id:string,"
    "relationship_type:string,source_ref:string,target_ref:string>>"
)
LABELS = {"attack-pattern": "TTP", "intrusion-set": "ThreatActor", "malware": "MalwareFamily", "campaign": "Campaign"}
RELATIONS = {"uses": "USES", "attributed-to": "ATTRIBUTED_TO"}
FRAMEWORK = "mitre-attack"


def _map(values: dict[str, str], by: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[by]


def objects(bundles: DataFrame) -> DataFrame:
    """All objects of bundles (BUNDLE, domain), with what all node kinds share: label, node_key, mitre_id, mitre_url, flags."""
    o = bundles.select("domain", F.explode("objects").alias("o")).select("domain", "o.*")
    ref = F.get(F.filter("external_references", lambda r: r["source_name"] == FRAMEWORK), 0)
    label = _map(LABELS, F.col("type"))
    return o.withColumns({"label": label, "mitre_id": ref["external_id"], "mitre_url": ref["url"], "node_key": F.when(label.isNotNull(), F.coalesce(ref["external_id"], tx.collapse(F.col("name"))))}).withColumns(
        {"is_deprecated": F.coalesce("x_mitre_deprecated", F.lit(False)), "is_revoked": F.coalesce("revoked", F.lit(False)), "revoked_by": F.col("x_mitre_revoked_by_id")}
    )


def nodes(parsed: DataFrame) -> dict[str, DataFrame]:
    """By label a table of nodes."""
    flags = ["is_deprecated", "is_revoked", "revoked_by"]
    of = lambda label: parsed.where(F.col("label") == label)
    aliases = F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")
    key = F.col("node_key")
    tactics = F.transform(F.filter(F.coalesce("kill_chain_phases", F.array().cast("array<struct<kill_chain_name:string,phase_name:string>>")), lambda p: p["kill_chain_name"] == FRAMEWORK), lambda p: p["phase_name"])
    named = [key.alias("merge_key"), "name", "mitre_id", aliases]
    return {
        "TTP": of("TTP").select(key.alias("technique_id"), "name", F.when(F.contains(key, F.lit(".")), key).alias("sub_technique_id"), tactics.alias("tactic"), "mitre_url", F.substring_index("domain", "-", 1).alias("domain"), *flags),
        "ThreatActor": of("ThreatActor").select(*named, "description", *flags),
        "MalwareFamily": of("MalwareFamily").select(*named, F.get("malware_types", 0).alias("malware_type"), "description", *flags),
        "Campaign": of("Campaign").select(*named, F.col("first_seen").alias("start_date"), F.col("last_seen").alias("end_date"), "objective", "description", *flags),
    }


def edges(parsed: DataFrame) -> DataFrame:
    """(start_label, start_key, rel_type, end_label, end_key) of modelled relationships; those with an end outside the bundle are dropped."""
    ends = parsed.where("label IS NOT NULL").select("domain", "id", "label", "node_key")
    r = parsed.where("type = 'relationship'").select("domain", _map(RELATIONS, F.col("relationship_type")).alias("rel_type"), "source_ref", "target_ref").where("rel_type IS NOT NULL")
    for side, ref in (("start", "source_ref"), ("end", "target_ref")):
        r = r.join(ends.withColumnsRenamed({"id": ref, "label": f"{side}_label", "node_key": f"{side}_key"}), ["domain", ref])
    return r.select("start_label", "start_key", "rel_type", "end_label", "end_key").distinct()


#: What the catalog's own edges count as, and for how much.
SOURCE, CREDIBILITY = "mitre_attck", 1.0


def assertions(parsed: DataFrame, ts: int) -> DataFrame:
    """``edges`` as assertions for ``graph.authoritative_edges`` and ``merge_authoritative``, of the highest credibility, read at ``ts``."""
    return edges(parsed).withColumns({"source_id": F.lit(SOURCE), "credibility_score": F.lit(CREDIBILITY), "ts": F.lit(ts).cast("long")})


def latest_versions(index: DataFrame) -> DataFrame:
    """(domain, version): of each domain the greatest version, compared number by number. index: (domain, version)."""
    return index.groupBy("domain").agg(F.max_by("version", tx.version_parts(F.col("version"))).alias("version"))


def due(latest: DataFrame, ingested: DataFrame) -> DataFrame:
    """Domains whose latest version isn't the one that was ingested."""
    last = ingested.select("domain", F.col("version").alias("_v"))
    return latest.join(last, "domain", "left").where(~F.col("version").eqNullSafe(F.col("_v"))).drop("_v")
