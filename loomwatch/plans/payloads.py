"""Queries over feed payloads: JSON documents made of table rows, some with missing parts, read back by the normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.plans import inputs
from loomwatch.sources import feeds, stix

#: Rows of a payload.
PAGE = 20


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", "source", F.col("doc_id").cast("string").alias("i"), F.floor(F.col("doc_id") / PAGE).alias("page"))


def _read(rows: DataFrame, item: Column, wrap, schema: str) -> DataFrame:
    """Payloads of a page of items each, as the JSON that a feed sends, read with a schema."""
    pages = rows.select("page", item.alias("item")).groupBy("page").agg(F.collect_list("item").alias("items"))
    return pages.select(F.to_json(wrap(F.col("items"))).alias("j")).select(F.from_json("j", schema).alias("p")).select("p.*")


def _when(modulus: int, value: Column) -> Column:
    """The value, missing in each row whose id is divisible by the modulus."""
    return F.when(F.col("doc_id") % modulus != 0, value)


def _cve(modulus: int = 17) -> Column:
    """An id, in some rows an empty one."""
    return F.when(F.col("doc_id") % modulus == 0, "").otherwise(F.concat(F.lit("CVE-2024-"), F.col("i")))


def nvd_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    text = lambda lang, v: F.struct(F.lit(lang).alias("lang"), v.alias("value"))
    metric = lambda vector: F.array(F.struct(F.struct(F.lit(vector).alias("vectorString"), (F.col("doc_id") % 100 / 10.0).alias("baseScore")).alias("cvssData")))
    criteria = lambda v: F.struct(v.alias("criteria"))
    node = F.struct(_when(3, F.array(criteria(F.concat(F.lit("p"), F.col("i"))), criteria(F.lit("common")))).alias("cpeMatch"))
    other = F.struct(F.array(criteria(F.lit("common")), criteria(F.lit("last"))).alias("cpeMatch"))
    cve = F.struct(
        _cve().alias("id"), F.lit("2024-01-01").alias("published"), F.lit("2024-02-02").alias("lastModified"),
        F.when(F.col("doc_id") % 2 == 0, F.array(text("fr", F.lit("un")), text("en", F.col("source")))).otherwise(F.array(text("de", F.col("lang")))).alias("descriptions"),
        F.struct(_when(4, metric("31")).alias("cvssMetricV31"), _when(8, metric("2")).alias("cvssMetricV2")).alias("metrics"),
        _when(5, F.array(F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), (F.col("doc_id") % 50).cast("string")).alias("value")), F.struct(F.lit("NVD-CWE-Other").alias("value"))).alias("description")))).alias("weaknesses"),
        _when(7, F.array(F.struct(F.array(node, other).alias("nodes")), F.struct(F.lit(None).cast("array<struct<cpeMatch:array<struct<criteria:string>>>>").alias("nodes")))).alias("configurations"),
    )
    n = feeds.nvd(_read(d, F.struct(cve.alias("cve")), lambda x: F.struct(x.alias("vulnerabilities")), feeds.NVD))
    return n.select("cve_id", "description", "cvss_score", "cvss_vector", "published_date", "last_modified", F.array_join("cwe_ids", ",").alias("cwes"), F.array_join("affected_products", ",").alias("products"))


def kev_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(_cve().alias("cveID"), F.col("source").alias("vendorProject"), _when(3, F.col("lang")).alias("product"), F.lit("2024-03-01").alias("dateAdded"), F.lit("Unknown").alias("knownRansomwareCampaignUse"))
    k = feeds.kev(_read(_documents(spark, sf_dir), item, lambda x: F.struct(x.alias("vulnerabilities")), feeds.KEV))
    return k.select("cve_id", "exploited_in_wild", "kev_vendor_project", "kev_product", "kev_date_added", "kev_due_date", "kev_known_ransomware_campaign_use")


def epss_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    line = F.when(F.col("doc_id") % 10 == 0, "#model:v1").when(F.col("doc_id") % 10 == 1, "cve,epss,percentile").when(F.col("doc_id") % 10 == 2, F.concat(F.lit("CVE-1-"), F.col("i"), F.lit(",none,0.1"))).otherwise(F.concat(F.lit(" CVE-2024-"), F.col("i"), F.lit(", "), (F.col("doc_id") % 100 / 100.0).cast("string"), F.lit(",0.5")))
    return feeds.epss(d.select(line.alias("value")))


def _ghsa(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ident = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    ghsa = F.when(F.col("doc_id") % 19 == 0, "").otherwise(F.concat(F.lit("GHSA-"), F.col("i")))
    item = F.struct(ghsa.alias("ghsaId"), _when(4, F.col("source")).alias("summary"), F.col("text").alias("description"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("HIGH").alias("severity"), F.lit("2024-01-01T00:00:00Z").alias("publishedAt"), F.when(F.col("doc_id") % 3 == 0, F.array(ident("GHSA", ghsa))).otherwise(F.array(ident("GHSA", ghsa), ident("CVE", _cve()))).alias("identifiers"))
    return feeds.ghsa(_read(_documents(spark, sf_dir), item, lambda x: F.struct(F.struct(F.struct(x.alias("nodes")).alias("securityAdvisories")).alias("data")), feeds.GHSA))


def ghsa_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ghsa(spark, sf_dir)[0]


def ghsa_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ghsa(spark, sf_dir)[1].select("source_guid_key", "source_id", "guid", "title", F.sha2("cleaned_text", 256).alias("text_sha256"), "published_at")


def _otx(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A pulse of three indicators for each document; some list a CVE twice, some values and types are missing."""
    ind = lambda v, t: F.struct(v.alias("indicator"), t.alias("type"))
    kinds = F.array(*[F.lit(k) for k in ("IPv4", "hostname", "URI", "FileHash-MD5", "Mutex")])
    cve = ind(F.concat(F.lit("CVE-2024-"), (F.col("doc_id") % 300).cast("string")), F.lit("CVE"))
    twice = F.when(F.col("doc_id") % 6 == 0, cve)
    value = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("v"), (F.col("doc_id") % 500).cast("string")))
    item = F.struct(F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("i")).alias("id"), F.array_compact(F.array(cve, twice, ind(value, F.get(kinds, (F.col("doc_id") % 5).cast("int"))), ind(F.lit("nokind"), F.lit(None).cast("string")))).alias("indicators"))
    return feeds.otx(_read(_documents(spark, sf_dir), item, lambda x: F.struct(x.alias("results")), feeds.OTX))


def otx_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _otx(spark, sf_dir)[0]


def otx_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _otx(spark, sf_dir)[1]


def otx_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _otx(spark, sf_dir)[2]


def _status(items: Column, name: str) -> Column:
    """Every seventh page has another status than 'ok'."""
    return F.struct(F.when(F.col("page") % 7 == 3, "no_results").otherwise("ok").alias("query_status"), items.alias(name))


def urlhaus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.floor(F.col("page_id") / PAGE).alias("page"))
    item = F.struct(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("url")).alias("url"), F.lit("online").alias("url_status"), _when(4, F.lit("host")).alias("host"), F.lit("malware_download").alias("threat"), _when(3, F.array(F.lit("a"), F.lit("b"))).alias("tags"))
    n = feeds.urlhaus(_read(p, item, lambda x: _status(x, "urls"), feeds.URLHAUS))
    return n.select("value_type_key", "value", "ioc_type", "url_status", "host", "threat", F.array_join("tags", ",").alias("tags"), "date_added")


def malwarebazaar_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(_when(9, F.sha2("text", 256)).alias("sha256_hash"), F.col("source").alias("file_name"), F.lit("exe").alias("file_type"), _when(4, F.col("lang")).alias("signature"), _when(3, F.array(F.col("lang"))).alias("tags"))
    n = feeds.malwarebazaar(_read(_documents(spark, sf_dir), item, lambda x: _status(x, "data"), feeds.BAZAAR))
    return n.select("value_type_key", "ioc_type", "file_name", "file_type", "signature", F.array_join("tags", ",").alias("tags"))


def _threatfox(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    kinds = F.array(*[F.lit(k) for k in ("md5_hash", "ip:port", "url", "sha3_384_hash", "sha256_hash")])
    item = F.struct(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("v"), F.col("i"))).alias("ioc"), F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("ioc_type"), F.lit("payload").alias("threat_type"), _when(4, F.concat(F.lit("win."), F.col("lang"))).alias("malware"), _when(8, F.concat(F.lit(" Family "), (F.col("doc_id") % 30).cast("string"))).alias("malware_printable"), (F.col("doc_id") % 100).cast("int").alias("confidence_level"))
    return feeds.threatfox(_read(_documents(spark, sf_dir), item, lambda x: _status(x, "data"), feeds.THREATFOX))


def threatfox_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threatfox(spark, sf_dir)[0].drop("first_seen")


def threatfox_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threatfox(spark, sf_dir)[1].select("merge_key", "name", F.array_join("aliases", ",").alias("aliases")).distinct()


def threatfox_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threatfox(spark, sf_dir)[2]


def _stix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of objects by number, and a relationship from each to the next one."""
    d = _documents(spark, sf_dir)
    n = F.col("doc_id") % 4
    kinds = F.array(*[F.lit(k) for k in stix.LABELS])
    named = F.concat(F.lit("N  "), F.upper("i"))
    ref = F.when(n < 3, _when(3, F.array(F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id"), F.lit("u0").alias("url")), F.struct(F.lit(stix.FRAMEWORK).alias("source_name"), F.concat(F.lit("X"), F.col("i"), F.when(F.col("doc_id") % 8 == 0, ".001").otherwise("")).alias("external_id"), F.concat(F.lit("u"), F.col("i")).alias("url")))))
    phase = F.array(F.struct(F.lit(stix.FRAMEWORK).alias("kill_chain_name"), F.col("lang").alias("phase_name")), F.struct(F.lit("else").alias("kill_chain_name"), F.lit("no").alias("phase_name")))
    none = lambda t: F.lit(None).cast(t)
    thing = F.struct(F.get(kinds, n.cast("int")).alias("type"), F.concat(F.lit("o"), F.col("i")).alias("id"), named.alias("name"), _when(5, F.array(F.lit("AKA"))).alias("aliases"), _when(6, F.array(F.lit("rat"), F.lit("bot"))).alias("malware_types"), F.when(n == 0, phase).alias("kill_chain_phases"), ref.alias("external_references"), F.lit("2020").alias("first_seen"), (F.col("doc_id") % 10 == 0).alias("revoked"), none("string").alias("relationship_type"), none("string").alias("source_ref"), none("string").alias("target_ref"))
    link = F.struct(F.lit("relationship").alias("type"), F.concat(F.lit("r"), F.col("i")).alias("id"), none("string").alias("name"), none("array<string>").alias("aliases"), none("array<string>").alias("malware_types"), F.when(n == 9, phase).alias("kill_chain_phases"), F.when(n == 9, ref).alias("external_references"), none("string").alias("first_seen"), none("boolean").alias("revoked"), F.when(F.col("doc_id") % 3 == 0, "mitigates").when(F.col("doc_id") % 3 == 1, "uses").otherwise("attributed-to").alias("relationship_type"), F.concat(F.lit("o"), F.col("i")).alias("source_ref"), F.concat(F.lit("o"), (F.col("doc_id") + 1).cast("string")).alias("target_ref"))
    rows = d.select("page", F.explode(F.array(thing, link)).alias("item"))
    bundles = _read(rows, F.col("item"), lambda x: F.struct(x.alias("objects")), stix.BUNDLE)
    return stix.objects(bundles.withColumn("domain", F.lit("enterprise-attack")))


def stix_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stix.nodes(_stix(spark, sf_dir))["TTP"]
    return t.select("technique_id", "name", "sub_technique_id", F.array_join("tactic", ",").alias("tactics"), "mitre_url", "domain", "is_deprecated", "is_revoked")


def stix_named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = stix.nodes(_stix(spark, sf_dir))
    of = lambda label, extra: n[label].select(F.lit(label).alias("label"), "merge_key", "name", "mitre_id", F.array_join("aliases", ",").alias("aliases"), extra.alias("extra"), "is_revoked")
    return of("ThreatActor", F.lit(None).cast("string")).unionByName(of("MalwareFamily", F.col("malware_type"))).unionByName(of("Campaign", F.col("start_date")))


def stix_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stix.edges(_stix(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        nvd_payloads, kev_payloads, epss_lines, ghsa_nodes, ghsa_articles, otx_indicators, otx_cves, otx_edges, urlhaus_nodes, malwarebazaar_nodes, threatfox_nodes, threatfox_families, threatfox_relations, stix_techniques, stix_named_nodes, stix_relations,
    )
}

_OTX = """p AS (SELECT doc_id, 'CVE-2024-' || (doc_id % 300)::VARCHAR AS cve, CASE WHEN doc_id % 7 <> 0 THEN 'v' || (doc_id % 500)::VARCHAR END AS v, ['ip', 'domain', 'url', 'md5_hash', 'mutex'][doc_id % 5 + 1] AS t FROM documents WHERE doc_id % 11 <> 0)"""
_FOX = """t AS (SELECT doc_id AS i, lang, 'v' || doc_id::VARCHAR AS v, ['md5_hash', 'ip:port', 'url', 'sha3_384_hash', 'sha256_hash'][doc_id % 5 + 1] AS k, ' Family ' || (doc_id % 30)::VARCHAR AS f FROM documents WHERE (doc_id // 20) % 7 <> 3 AND doc_id % 9 <> 0 AND doc_id % 8 <> 0)"""
_STIX = """o AS (SELECT doc_id AS i, lang, ['TTP', 'ThreatActor', 'MalwareFamily', 'Campaign'][doc_id % 4 + 1] AS label, 'N  ' || doc_id::VARCHAR AS name,
  CASE WHEN doc_id % 4 < 3 AND doc_id % 3 <> 0 THEN 'X' || doc_id::VARCHAR || CASE WHEN doc_id % 8 = 0 THEN '.001' ELSE '' END END AS mid, doc_id % 10 = 0 AS revoked FROM documents
), n AS (SELECT *, coalesce(mid, 'n ' || i::VARCHAR) AS key FROM o)"""

SQL = {
    "nvd_payloads": """SELECT 'CVE-2024-' || doc_id::VARCHAR AS cve_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS description, CASE WHEN doc_id % 8 <> 0 THEN (doc_id % 100 / 10.0)::DOUBLE END AS cvss_score,
  CASE WHEN doc_id % 4 <> 0 THEN '31' WHEN doc_id % 8 <> 0 THEN '2' END AS cvss_vector, '2024-01-01' AS published_date, '2024-02-02' AS last_modified, CASE WHEN doc_id % 5 <> 0 THEN 'CWE-' || (doc_id % 50)::VARCHAR ELSE '' END AS cwes,
  CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 3 <> 0 THEN 'p' || doc_id::VARCHAR || ',common,last' ELSE 'common,last' END END AS products FROM documents WHERE doc_id % 17 <> 0""",
    "kev_payloads": """SELECT 'CVE-2024-' || doc_id::VARCHAR AS cve_id, true AS exploited_in_wild, source AS kev_vendor_project, CASE WHEN doc_id % 3 <> 0 THEN lang END AS kev_product, '2024-03-01' AS kev_date_added, NULL::VARCHAR AS kev_due_date,
  'Unknown' AS kev_known_ransomware_campaign_use FROM documents WHERE doc_id % 17 <> 0""",
    "epss_lines": "SELECT 'CVE-2024-' || doc_id::VARCHAR AS cve_id, (doc_id % 100 / 100.0)::DOUBLE AS epss_score FROM documents WHERE doc_id % 10 > 2",
    "ghsa_nodes": "SELECT 'CVE-2024-' || doc_id::VARCHAR AS cve_id, 'GHSA-' || doc_id::VARCHAR AS ghsa_id, CASE WHEN doc_id % 5 <> 0 THEN 'HIGH' END AS ghsa_severity FROM documents WHERE doc_id % 19 <> 0 AND doc_id % 3 <> 0 AND doc_id % 17 <> 0",
    "ghsa_articles": """SELECT 'ghsa::GHSA-' || doc_id::VARCHAR AS source_guid_key, 'ghsa' AS source_id, 'GHSA-' || doc_id::VARCHAR AS guid, CASE WHEN doc_id % 4 <> 0 THEN source ELSE '' END AS title, sha256(coalesce(text, '')) AS text_sha256,
  '2024-01-01T00:00:00Z' AS published_at FROM documents WHERE doc_id % 19 <> 0""",
    "otx_indicators": f"WITH {_OTX} SELECT DISTINCT v AS value, t AS ioc_type, v || '::' || t AS value_type_key FROM p WHERE v IS NOT NULL",
    "otx_cves": f"WITH {_OTX} SELECT DISTINCT cve AS cve_id FROM p",
    "otx_edges": f"WITH {_OTX} SELECT DISTINCT v || '::' || t AS start_key, 'INDICATES' AS rel_type, cve AS end_key, 'otx' AS source_id FROM p WHERE v IS NOT NULL AND doc_id % 6 <> 0",
    "urlhaus_nodes": """SELECT url || '::url' AS value_type_key, url AS value, 'url' AS ioc_type, 'online' AS url_status, CASE WHEN page_id % 4 <> 0 THEN 'host' END AS host, 'malware_download' AS threat, CASE WHEN page_id % 3 <> 0 THEN 'a,b' ELSE '' END AS tags, NULL::VARCHAR AS date_added
FROM pages WHERE page_id % 9 <> 0 AND (page_id // 20) % 7 <> 3""",
    "malwarebazaar_nodes": """SELECT sha256(text) || '::sha256_hash' AS value_type_key, 'sha256_hash' AS ioc_type, source AS file_name, 'exe' AS file_type, CASE WHEN doc_id % 4 <> 0 THEN lang END AS signature, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE '' END AS tags
FROM documents WHERE doc_id % 9 <> 0 AND (doc_id // 20) % 7 <> 3""",
    "threatfox_nodes": f"WITH {_FOX} SELECT v || '::' || k AS value_type_key, v AS value, k AS ioc_type, 'payload' AS threat_type, (i % 100)::INT AS confidence_level FROM t",
    "threatfox_families": f"WITH {_FOX} SELECT DISTINCT lower(trim(f)) AS merge_key, f AS name, CASE WHEN i % 4 <> 0 THEN 'win.' || lang ELSE '' END AS aliases FROM t",
    "threatfox_relations": f"WITH {_FOX} SELECT lower(trim(f)) AS start_key, CASE WHEN k IN ('md5_hash', 'sha256_hash') THEN 'HAS_SAMPLE' ELSE 'COMMUNICATES_WITH' END AS rel_type, v || '::' || k AS end_key, 'threatfox' AS source_id FROM t",
    "stix_techniques": f"""WITH {_STIX} SELECT key AS technique_id, name, CASE WHEN contains(key, '.') THEN key END AS sub_technique_id, lang AS tactics, CASE WHEN mid IS NOT NULL THEN 'u' || i::VARCHAR END AS mitre_url, 'enterprise' AS domain, false AS is_deprecated, revoked AS is_revoked
FROM n WHERE label = 'TTP'""",
    "stix_named_nodes": f"""WITH {_STIX} SELECT label, key AS merge_key, name, mid AS mitre_id, CASE WHEN i % 5 <> 0 THEN 'AKA' ELSE '' END AS aliases, CASE label WHEN 'MalwareFamily' THEN CASE WHEN i % 6 <> 0 THEN 'rat' END WHEN 'Campaign' THEN '2020' END AS extra, revoked AS is_revoked
FROM n WHERE label <> 'TTP'""",
    # The last object of a bundle refers to one outside it, but bundles of one domain are one set.
    "stix_relations": f"""WITH {_STIX} SELECT DISTINCT a.label AS start_label, a.key AS start_key, CASE WHEN a.i % 3 = 1 THEN 'USES' ELSE 'ATTRIBUTED_TO' END AS rel_type, b.label AS end_label, b.key AS end_key FROM n a JOIN n b ON b.i = a.i + 1 WHERE a.i % 3 <> 0""",
}
