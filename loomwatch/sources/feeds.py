"""Normalisers of security feeds: raw payloads (JSON, CSV) to node and edge tables.

Each takes a DataFrame that ``spark.read`` made with the schema given here, so any of Spark's
stores can hold the payloads. Nothing here calls the network.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.functions import text as tx

NVD = (
    "vulnerabilities array<struct<cve:struct<id:string,published:string,lastModified:string,descriptions:array<struct<lang:string,value:string>>,"
    "metrics:struct<cvssMetricV31:array<struct<cvssData:struct<vectorString:string,baseScore:double>>>,cvssMetricV30:array<struct<cvssData:struct<vectorString:string,baseScore:double>>>,cvssMetricV2:array<struct<cvssData:struct<vectorString:string,baseScore:double>>>>,"
    "weaknesses:array<struct<description:array<struct<value:string>>>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>>>>"
)
KEV = "vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string>>"
GHSA = "data struct<securityAdvisories:struct<nodes:array<struct<ghsaId:string,summary:string,description:string,severity:string,publishedAt:string,identifiers:array<struct<type:string,value:string>>>>>>"
OTX = "results array<struct<id:string,indicators:array<struct<indicator:string,type:string>>>>"
URLHAUS = "query_status string, urls array<struct<url:string,url_status:string,host:string,date_added:string,threat:string,tags:array<string>>>"
BAZAAR = "query_status string, data array<struct<sha256_hash:string,file_name:string,file_type:string,signature:string,first_seen:string,tags:array<string>>>"
THREATFOX = "query_status string, data array<struct<ioc:string,ioc_type:string,threat_type:string,malware:string,malware_printable:string,confidence_level:int,first_seen:string>>"

# One feed's indicator types as node types.
OTX_TYPES = {
    "IPv4": "ip", "IPv6": "ip", "domain": "domain", "hostname": "domain", "URL": "url", "URI": "url",
    "FileHash-MD5": "md5_hash", "FileHash-SHA1": "sha1_hash", "FileHash-SHA256": "sha256_hash",
}
HASH_TYPES = ("md5_hash", "sha1_hash", "sha256_hash")


class Normalizer(Protocol):
    """What a feed offers: from a table of payloads a table of nodes, or several tables, of which the first are nodes and the last may be edges."""

    def __call__(self, payloads: DataFrame) -> DataFrame | tuple[DataFrame, ...]: ...


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Payload files, one JSON document each. A file that isn't of the schema gives nulls, which the normalisers skip."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def valid_status(payloads: DataFrame) -> DataFrame:
    """Payloads that their service calls good."""
    return payloads.where("query_status = 'ok'")


#: Of each feed what a payload must hold.
SHAPES = {"nvd": "vulnerabilities", "kev": "vulnerabilities", "ghsa": "data.securityAdvisories.nodes", "otx": "results", "urlhaus": "urls", "malwarebazaar": "data", "threatfox": "data"}


def check_shape(payloads: DataFrame, feed: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) payloads: a good one holds the feed's list, and says 'ok' where the feed has a status."""
    good = F.col(SHAPES[feed]).isNotNull()
    if "query_status" in payloads.columns:
        good = good & F.coalesce(F.col("query_status") == "ok", F.lit(False))
    return payloads.where(good), payloads.where(~good)


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), 0)


def nvd(payloads: DataFrame) -> DataFrame:
    """(cve_id, last_modified, description, cvss_score, cvss_vector, published_date, affected_products, cwe_ids)."""
    c = payloads.select(F.explode("vulnerabilities.cve").alias("c")).where("c.id IS NOT NULL AND c.id <> ''").select("c.*")
    text = F.coalesce(_first(F.col("descriptions"), lambda d: d["lang"] == "en"), F.get("descriptions", 0))["value"]
    metric = F.coalesce(*[F.get(f"metrics.{m}", 0) for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])["cvssData"]
    weak = F.flatten(F.transform("weaknesses", lambda w: F.transform(F.coalesce(w["description"], F.array().cast("array<struct<value:string>>")), lambda d: d["value"])))
    none = F.array().cast("array<string>")
    # Configurations without nodes, and nodes without products, lose none of the others.
    of_node = lambda n: F.coalesce(F.transform(n["cpeMatch"], lambda m: m["criteria"]), none)
    per = F.transform("configurations", lambda x: F.coalesce(F.flatten(F.transform(x["nodes"], of_node)), none))
    products = F.array_distinct(F.filter(F.flatten(per), lambda x: x.isNotNull() & (x != "")))
    return c.select(
        F.col("id").alias("cve_id"), F.col("lastModified").alias("last_modified"), text.alias("description"), metric["baseScore"].alias("cvss_score"), metric["vectorString"].alias("cvss_vector"),
        F.nullif("published", F.lit("")).alias("published_date"), F.when(F.size(products) > 0, products).alias("affected_products"),
        F.coalesce(F.array_distinct(F.filter(weak, lambda x: x.rlike("^CWE-[0-9]+$"))), F.array().cast("array<string>")).alias("cwe_ids"),
    )


def kev(payloads: DataFrame) -> DataFrame:
    v = payloads.select(F.explode("vulnerabilities").alias("v")).where("v.cveID IS NOT NULL AND v.cveID <> ''")
    names = {"vendorProject": "vendor_project", "product": "product", "vulnerabilityName": "vulnerability_name", "dateAdded": "date_added", "requiredAction": "required_action", "dueDate": "due_date", "knownRansomwareCampaignUse": "known_ransomware_campaign_use"}
    return v.select(F.col("v.cveID").alias("cve_id"), F.lit(True).alias("exploited_in_wild"), *[F.col(f"v.{a}").alias(f"kev_{b}") for a, b in names.items()])


def epss(lines: DataFrame) -> DataFrame:
    """(cve_id, epss_score). lines: ``spark.read.text``; lines that hold no score (header, comment) are skipped."""
    parts = F.split("value", ",")
    rows = lines.select(F.trim(F.get(parts, 0)).alias("cve_id"), F.trim(F.get(parts, 1)).try_cast("double").alias("epss_score"))
    return rows.where("epss_score IS NOT NULL AND cve_id LIKE 'CVE-%'")


def ghsa(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vulnerabilities, articles): each advisory is an article; of those with a CVE id its node."""
    n = payloads.select(F.explode("data.securityAdvisories.nodes").alias("n")).where("n.ghsaId IS NOT NULL AND n.ghsaId <> ''").select("n.*")
    cve = _first(F.col("identifiers"), lambda i: i["type"] == "CVE")["value"]
    nodes = n.select(cve.alias("cve_id"), F.col("ghsaId").alias("ghsa_id"), F.nullif("severity", F.lit("")).alias("ghsa_severity")).where("cve_id IS NOT NULL AND cve_id <> ''")
    articles = n.select(tx.key(F.lit("ghsa"), F.col("ghsaId")).alias("source_guid_key"), F.lit("ghsa").alias("source_id"), F.col("ghsaId").alias("guid"), F.coalesce("summary", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("cleaned_text"), F.col("publishedAt").alias("published_at"))
    return nodes, articles


def otx(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(indicators, CVEs, edges): indicators and CVE ids of all pulses, and INDICATES edges of the pulses with exactly one CVE (one listed twice is two). Pulses without an id and indicators without a value or type are skipped."""
    p = payloads.select(F.explode("results").alias("p")).where("coalesce(p.id, '') <> ''").select("p.id", F.filter("p.indicators", lambda i: (F.coalesce(i["indicator"], F.lit("")) != "") & (F.coalesce(i["type"], F.lit("")) != "")).alias("indicators"))
    cves = F.transform(F.filter("indicators", lambda i: i["type"] == "CVE"), lambda i: i["indicator"])
    types = F.create_map(*[F.lit(x) for kv in OTX_TYPES.items() for x in kv])
    rows = p.select("id", cves.alias("cves"), F.explode(F.filter("indicators", lambda i: i["type"] != "CVE")).alias("i"))
    rows = rows.select("id", "cves", F.col("i.indicator").alias("value"), F.coalesce(types[F.col("i.type")], F.lower("i.type")).alias("ioc_type"))
    nodes = rows.select("value", "ioc_type", tx.key(F.col("value"), F.col("ioc_type")).alias("value_type_key")).distinct()
    edges = rows.where(F.size("cves") == 1).select(tx.key(F.col("value"), F.col("ioc_type")).alias("start_key"), F.lit("INDICATES").alias("rel_type"), F.get("cves", 0).alias("end_key"), F.lit("otx").alias("source_id")).distinct()
    return nodes, p.select(F.explode(cves).alias("cve_id")).distinct(), edges


def urlhaus(payloads: DataFrame) -> DataFrame:
    u = valid_status(payloads).select(F.explode("urls").alias("u")).where("u.url IS NOT NULL AND u.url <> ''")
    return u.select(tx.key(F.col("u.url"), F.lit("url")).alias("value_type_key"), F.col("u.url").alias("value"), F.lit("url").alias("ioc_type"), "u.url_status", "u.host", "u.threat", F.coalesce("u.tags", F.array().cast("array<string>")).alias("tags"), "u.date_added")


def malwarebazaar(payloads: DataFrame) -> DataFrame:
    d = valid_status(payloads).select(F.explode("data").alias("d")).where("d.sha256_hash IS NOT NULL AND d.sha256_hash <> ''")
    return d.select(tx.key(F.col("d.sha256_hash"), F.lit("sha256_hash")).alias("value_type_key"), F.col("d.sha256_hash").alias("value"), F.lit("sha256_hash").alias("ioc_type"), "d.file_name", "d.file_type", "d.signature", F.coalesce("d.tags", F.array().cast("array<string>")).alias("tags"), "d.first_seen")


def threatfox(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(indicators, malware families, edges from family to indicator)."""
    d = valid_status(payloads).select(F.explode("data").alias("d")).select("d.*").where("coalesce(ioc, '') <> '' AND coalesce(ioc_type, '') <> '' AND coalesce(malware_printable, '') <> ''")
    d = d.withColumn("merge_key", F.lower(F.trim("malware_printable"))).withColumn("value_type_key", tx.key(F.col("ioc"), F.col("ioc_type")))
    nodes = d.select("value_type_key", F.col("ioc").alias("value"), "ioc_type", "threat_type", "confidence_level", "first_seen")
    families = d.select("merge_key", F.col("malware_printable").alias("name"), F.when(F.coalesce("malware", F.lit("")) != "", F.array("malware")).otherwise(F.array().cast("array<string>")).alias("aliases"))
    rel = F.when(F.col("ioc_type").isin(*HASH_TYPES), "HAS_SAMPLE").otherwise("COMMUNICATES_WITH")
    return nodes, families, d.select(F.col("merge_key").alias("start_key"), rel.alias("rel_type"), F.col("value_type_key").alias("end_key"), F.lit("threatfox").alias("source_id")).distinct()


REGISTRY = "source_id string, name string, url string, type string, category string, credibility_score double, polling_tier string, auth_param_ref string, api_version string"
REQUIRED = ("source_id", "name", "url", "type", "category", "credibility_score", "polling_tier")


def source_registry(spark: SparkSession, text: str) -> DataFrame:
    """The configured sources, from YAML text (a small file of settings). A source without a required field is an error."""
    import yaml

    names = [c.split()[0] for c in REGISTRY.split(", ")]
    rows = yaml.safe_load(text) or []
    for r in rows:
        if missing := [c for c in REQUIRED if r.get(c) is None]:
            raise ValueError(f"source {r.get('source_id')!r} lacks {', '.join(missing)}")
    return spark.createDataFrame([tuple(float(r[c]) if c == "credibility_score" else r.get(c) for c in names) for r in rows], REGISTRY)


FEED_ITEM = "id string, guid string, title string, summary string, description string, link string, published string, pubDate string"


def read_rss(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of feed files (rowTag 'item', or 'entry' for the other format)."""
    return feed_entries(spark.read.schema(FEED_ITEM).option("rowTag", row_tag).xml(path))


def feed_entries(items: DataFrame) -> DataFrame:
    """(guid, title, summary, link, published_at, fingerprint) of raw entries, missing fields empty; an entry is named by its id, guid or link."""
    has = set(items.columns)
    field = lambda *names: F.coalesce(*[F.col(n) for n in names if n in has], F.lit(""))
    name = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in ("id", "guid", "link") if n in has], F.lit(""))
    out = items.select(name.alias("guid"), field("title").alias("title"), field("summary", "description").alias("summary"), field("link").alias("link"), F.coalesce(*[F.col(n) for n in ("published", "pubDate") if n in has], F.lit(None).cast("string")).alias("published_at"))
    return out.withColumn("fingerprint", F.sha2(F.concat("title", "summary", "link"), 256))


def article_rows(events: DataFrame) -> DataFrame:
    """Articles of feed entries with page_text, the page's main text or null if it couldn't be had: the summary then stands in."""
    text = F.coalesce("page_text", "summary")
    return events.select(tx.key(F.col("source_id"), F.col("guid")).alias("source_guid_key"), "source_id", "guid", "title", F.col("link").alias("url"), text.alias("cleaned_text"), "summary", F.sha2(text, 256).alias("content_hash"), "published_at", F.col("page_text").isNull().alias("is_fallback_content"), F.lit(1).cast("long").alias("dedup_cluster_size"))


def page_text(html: Column) -> Column:
    """The text of a page's paragraphs and headings, by patterns only."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|form)\b.*?</\1\s*>", " ")
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<(p|h[1-6]|li|blockquote|pre)\b[^>]*>(.*?)</\1\s*>"), F.lit(2))
    plain = F.transform(blocks, lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"(?s)<[^>]*>", " "), r"\s+", " ")))
    text = F.array_join(F.filter(plain, lambda b: b != ""), "\n")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.nullif(text, F.lit(""))
