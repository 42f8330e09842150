"""Queries over article texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.functions import text as tx
from loomwatch.operators import mentions, nearest, stories
from loomwatch.operators.story_join import story_links
from loomwatch.plans import inputs
from loomwatch.shared import written
from loomwatch.sources import feeds
from loomwatch.sources.main_text import with_main_text


def article_keys_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents")
    k = tx.key(F.col("source"), F.col("doc_id").cast("string"))
    a, b = tx.split_key(k)
    return d.select("doc_id", k.alias("article_key"), a.alias("source_part"), b.alias("guid_part"), F.sha2("text", 256).alias("content_hash"))


def exact_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of articles with one content hash: the representative and the size."""
    return stories.elect(inputs.articles(spark, sf_dir), "content_hash").where("cluster_size > 1").select("content_hash", "article_id", "cluster_size", "source")


def ioc_mentions_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents")
    kinds = ("email", "sha1", "ipv4")
    named = lambda k: lambda v: F.struct(F.lit(k).alias("ioc_type"), F.lower(v).alias("value"))
    found = F.concat(*[F.transform(tx.find_all(F.col("text"), tx.PATTERNS[k]), named(k)) for k in kinds])
    rows = d.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*").where(~((F.col("ioc_type") == F.lit("ipv4")) & tx.is_reserved(F.col("value"))))
    return rows.distinct().groupBy("ioc_type", "value").agg(F.count(F.lit(1)).alias("n_articles"))


SUFFIX = "concat(text, ' CVE-2024-', cast(1000 + doc_id % 97 as string), ' T', cast(1000 + doc_id % 50 as string), ' hxxp://evil', cast(doc_id % 31 as string), '[.]example(dot)org/a 203.0[.]113.', cast(doc_id % 250 as string))"


def refang_cve_ttp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents").select("doc_id", F.expr(SUFFIX).alias("text"))
    plain = tx.refang(F.col("text"))
    every = lambda pattern: F.array_join(tx.find_all(plain, pattern), ",")
    return d.select("doc_id", every(tx.CVE).alias("cves"), every(tx.TTP).alias("ttps"), every(r"https?://[^\s\"'<>]+").alias("urls"), every(tx.PATTERNS["ipv4"]).alias("ipv4s"))


def ioc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of values made from rows."""
    d = inputs.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    n = F.pmod("doc_id", F.lit(7))
    v = (
        F.when(n == 0, F.sha2("text", 256)).when(n == 1, F.sha1("text")).when(n == 2, F.md5("text")).when(n == 3, F.concat(F.lit("a.b+c@x-"), F.col("doc_id").cast("string"), F.lit(".org")))
        .when(n == 4, F.concat(F.lit("http://h/"), F.col("doc_id").cast("string"))).when(n == 5, F.concat(F.lit("203.0.113."), F.pmod("doc_id", F.lit(256)).cast("string"))).otherwise(F.concat(F.lit("no indicator "), F.col("doc_id").cast("string")))
    )
    return d.select("doc_id", tx.classify(v).alias("ioc_type"))


def ioc_extract_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.expr(SUFFIX).alias("text"))
    return mentions.extract_mentions(d)


def benign_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).alias("domain"))
    benign = spark.createDataFrame([(x,) for x in (*tx.BENIGN, "www.example.com")], "domain string")
    return p.join(F.broadcast(benign), "domain", "left_anti").groupBy("domain").agg(F.count(F.lit(1)).alias("n_pages"))


def simhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.simhash(inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text"))


def simhash64_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.simhash_arrow(inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text"))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.candidate_pairs(inputs.entities(spark, sf_dir), inputs.articles(spark, sf_dir), 12)


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e = inputs.articles(spark, sf_dir), inputs.entities(spark, sf_dir)
    return stories.scored_pairs(e, a, stories.simhash_arrow(a), 72, digits=8).where("score >= 0.3")


def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the bounded join; entities are made once."""
    a, e = inputs.articles(spark, sf_dir), written(inputs.entities(spark, sf_dir), "entities")
    return stories.cluster_by_links(a.drop("text"), story_links(e, a, stories.simhash_arrow(a)))


def cluster_entity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.articles(spark, sf_dir).select("article_id", F.col("content_hash").alias("cluster_id"))
    u = stories.entity_union(c, inputs.entities(spark, sf_dir))
    return u.select("cluster_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("entities", lambda e: F.concat(e["node_key"], F.lit("="), F.round(e["node_confidence"] * 10).cast("int").cast("string"))), ",").alias("entities"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "pages").select("page_id", feeds.page_text(F.col("html")).alias("page_text"))


def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(inputs.table(spark, sf_dir, "pages").select("page_id", "html"), text_col="main_text").drop("html")


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest, by cosine, to each whose id is divisible by 50."""
    v = inputs.table(spark, sf_dir, "embeddings")
    return nearest.nearest(v, v.where("vec_id % 50 = 0"), 5)


QUERIES = {f.__name__: f for f in (article_keys_hash, exact_dup_clusters, ioc_mentions_by_type, refang_cve_ttp, ioc_classify, ioc_extract_full, benign_domain_filter, simhash64, simhash64_arrow, candidate_pairs, pair_scores, story_clusters, cluster_entity_union, page_text, page_main_text, embedding_topk)}

_SIMHASH = r"""
shingles AS (
  SELECT doc_id AS article_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) ELSE w END) AS s
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)
), votes AS (
  SELECT article_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v
  FROM (SELECT article_id, ('0x' || substr(sha256(s), 49, 16))::UBIGINT AS h FROM shingles), (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY ALL
), simhashes AS (SELECT article_id, sum(CASE WHEN v > 0 THEN (1::HUGEINT << b::HUGEINT) ELSE 0 END) AS u FROM votes GROUP BY article_id
), simhash AS (SELECT article_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS simhash FROM simhashes)"""

_PAIRS = """pairs AS (
  SELECT DISTINCT x.article_id AS a, y.article_id AS b FROM entities x JOIN entities y ON x.entity_type = y.entity_type AND x.node_key = y.node_key AND x.article_id < y.article_id
  WHERE abs(x.article_id % 48 - y.article_id % 48) <= {0})"""

_SCORES = f"""{_SIMHASH}, {inputs.ARTICLES_SQL}, {inputs.ENTITIES_SQL}, {_PAIRS.format(72)},
sets AS (SELECT article_id, list(entity_type || '|' || node_key) AS k FROM entities GROUP BY article_id
), scores AS (
  SELECT a, b, CASE WHEN p.content_hash = q.content_hash THEN 1.0 ELSE
    0.5 * len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k))) + 0.3 * coalesce(1 - bit_count(xor(s.simhash, t.simhash)) / 64.0, 0) + 0.2 * greatest(0, 1 - abs(p.hour - q.hour) / 72.0) END AS score
  FROM pairs JOIN articles p ON p.article_id = a JOIN articles q ON q.article_id = b JOIN sets x ON x.article_id = a JOIN sets y ON y.article_id = b
  LEFT JOIN simhash s ON s.article_id = a LEFT JOIN simhash t ON t.article_id = b)"""

SQL = {
    "article_keys_hash": "SELECT doc_id, source || '::' || doc_id::VARCHAR AS article_key, source AS source_part, doc_id::VARCHAR AS guid_part, sha256(text) AS content_hash FROM documents",
    "exact_dup_clusters": f"""WITH {inputs.ARTICLES_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY hour, credibility_score DESC, article_id) AS k, count(*) OVER (PARTITION BY content_hash) AS cluster_size FROM articles)
SELECT content_hash, article_id, cluster_size, source FROM r WHERE k = 1 AND cluster_size > 1""",
    "ioc_mentions_by_type": r"""WITH m AS (
  SELECT doc_id, 'email' AS ioc_type, unnest(regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b')) AS v FROM documents
  UNION ALL SELECT doc_id, 'sha1', unnest(regexp_extract_all(text, '\b[a-fA-F0-9]{40}\b')) FROM documents
  UNION ALL SELECT doc_id, 'ipv4', unnest(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) FROM documents
), d AS (SELECT DISTINCT doc_id, ioc_type, lower(v) AS value FROM m)
SELECT ioc_type, value, count(*) AS n_articles FROM d
WHERE NOT (ioc_type = 'ipv4' AND regexp_matches(value, '^(10\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\.)')) GROUP BY ALL""",
    "refang_cve_ttp": r"""WITH d AS (
  SELECT doc_id, text || ' CVE-2024-' || (1000 + doc_id % 97)::VARCHAR || ' T' || (1000 + doc_id % 50)::VARCHAR || ' hxxp://evil' || (doc_id % 31)::VARCHAR || '[.]example(dot)org/a 203.0[.]113.' || (doc_id % 250)::VARCHAR AS t FROM documents
), r AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(translate(t, chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), 'hxxp', 'http'), '[.]', '.'), '(dot)', '.'), '[dot]', '.'), '[at]', '@'), '(at)', '@'), '[:]', ':') AS t FROM d)
SELECT doc_id, array_to_string(regexp_extract_all(t, 'CVE-\d{4}-\d{4,7}'), ',') AS cves, array_to_string(regexp_extract_all(t, '\bT\d{4}(?:\.\d{3})?\b'), ',') AS ttps,
  array_to_string(regexp_extract_all(t, 'https?://[^\s"''<>]+'), ',') AS urls, array_to_string(regexp_extract_all(t, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), ',') AS ipv4s FROM r""",
    "ioc_classify": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'sha256' WHEN 1 THEN 'sha1' WHEN 2 THEN 'md5' WHEN 3 THEN 'email' WHEN 4 THEN 'url' WHEN 5 THEN 'ipv4' END AS ioc_type FROM documents",
    "benign_domain_filter": """WITH p AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain FROM pages)
SELECT domain, count(*) AS n_pages FROM p WHERE domain NOT IN ('microsoft.com', 'github.com', 'google.com', 'www.example.com') GROUP BY domain""",
    "simhash64": f"WITH {_SIMHASH} SELECT article_id, simhash FROM simhash",
    "simhash64_arrow": f"WITH {_SIMHASH} SELECT article_id, simhash FROM simhash",
    "candidate_pairs": f"WITH {inputs.ENTITIES_SQL}, {_PAIRS.format(12)} SELECT a, b FROM pairs",
    "pair_scores": f"WITH {_SCORES} SELECT a, b, round(score::DOUBLE, 8) AS score FROM scores WHERE round(score::DOUBLE, 8) >= 0.3",
    "story_clusters": f"""WITH RECURSIVE {_SCORES}, e AS (SELECT a, b FROM scores WHERE score >= 0.6 UNION ALL SELECT b, a FROM scores WHERE score >= 0.6
), r AS (SELECT article_id AS x, article_id AS y FROM articles UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y
), c AS (SELECT x AS article_id, min(y) AS c FROM r GROUP BY x
), k AS (SELECT article_id, first_value(article_id) OVER (PARTITION BY c ORDER BY hour, credibility_score DESC, article_id) AS best, count(*) OVER (PARTITION BY c) AS n FROM articles JOIN c USING (article_id))
SELECT article_id, sha256(best::VARCHAR) AS cluster_id, article_id = best AS is_representative, CASE WHEN article_id = best THEN n END AS cluster_size FROM k""",
    "cluster_entity_union": f"""WITH {inputs.ARTICLES_SQL}, {inputs.ENTITIES_SQL}, u AS (SELECT content_hash AS cluster_id, node_key, max(node_confidence) AS c FROM articles JOIN entities USING (article_id) GROUP BY ALL)
SELECT cluster_id, count(*) AS n_entities, string_agg(node_key || '=' || round(c * 10)::INT::VARCHAR, ',' ORDER BY node_key) AS entities FROM u GROUP BY cluster_id""",
    "embedding_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS cosine FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM n)
SELECT query_id, rank, vec_id, cosine FROM r WHERE rank <= 5""",
}
