"""Story clusters: near-duplicate articles that share entities, found by blocking and scored pairs."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.functions import text as tx
from loomwatch.operators import meetings
from loomwatch.operators.components import components
from loomwatch.shared import written

HOURS, THRESHOLD = 72.0, 0.6
#: What entities, wording and time weigh.
WEIGHTS = (0.5, 0.3, 0.2)
BLOCKING = ("cve", "ttp", "ioc")


def simhash(articles: DataFrame, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """(id, simhash): 64 sums of votes over all 3-word shingles, one aggregation."""
    rows = articles.select(id_col, F.explode(tx.shingles(F.col(text_col))).alias("s")).select(id_col, tx.low_64(F.col("s")).alias("h"))
    votes = [F.sum(F.shiftright("h", i).bitwiseAND(1) * 2 - 1).alias(f"b{i}") for i in range(64)]
    sums = rows.groupBy(id_col).agg(*votes)
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return sums.select(id_col, value.alias("simhash"))


def simhash_arrow(articles: DataFrame, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """The same by numpy in Arrow tasks, for bulk; an article without words has no row, as above."""
    import hashlib

    kind = articles.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").lower().split()
                parts = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)] if len(words) >= 3 else words
                if parts:
                    raw = np.frombuffer(b"".join(hashlib.sha256(p.encode()).digest()[24:] for p in parts), dtype=np.uint8)
                    ones = np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                    ids.append(i)
                    out.append(int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(out, pa.int64())], names=[id_col, "simhash"])

    return articles.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, simhash long")


#: Articles of more blocking entities don't carry them to each of these; their pairs are made distinct by a shuffle.
MANY = 100


def _keyed(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, times, blocking, plain) of dated articles with a blocking entity. plain: whether an article may carry its entities, and has one time."""
    keys = entities.where(F.col("entity_type").isin(*BLOCKING) & F.col("node_key").isNotNull()).groupBy("article_id").agg(F.array_sort(F.collect_set(F.concat_ws("|", "entity_type", "node_key"))).alias("blocking"))
    times = articles.where("published_at IS NOT NULL").groupBy("article_id").agg(F.collect_set(F.unix_micros("published_at")).alias("times"))
    return keys.join(times, "article_id").withColumn("plain", (F.size("times") == 1) & (F.size("blocking") <= MANY))


def _met(left: DataFrame, right: DataFrame, hours: float) -> DataFrame:
    """(article_id_x, article_id_y) of rows of ``_keyed`` at each blocking entity that they share.

    Time is cut into spans of ``hours``: rows meet those of their own span and of the next one only, so a key's rows aren't all
    compared, and a key that is frequent at all times is dealt out by its spans."""
    window = int(hours * 3_600_000_000)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as the rows are few for what they make, they aren't put into fewer tasks

    def side(rows: DataFrame, x: str, spans: list[Column]) -> DataFrame:
        rows = rows.withColumn("t", F.explode("times")).withColumn("own", F.floor(F.col("t") / window)).withColumn("key", F.explode("blocking"))
        return rows.select("key", F.explode(F.array(*spans)).alias("span"), *[F.col(c).alias(f"{c}_{x}") for c in ("article_id", "t", "own")]).repartition(n, "key", "span")

    near = F.abs(F.col("t_x") - F.col("t_y")) <= window
    # Within a span each pair once; of neighbouring spans the earlier row is on the left.
    once = (F.col("article_id_x") != F.col("article_id_y")) & ((F.col("own_y") != F.col("span")) | (F.col("article_id_x") < F.col("article_id_y")))
    return side(left, "x", [F.col("own")]).hint("merge").join(side(right, "y", [F.col("own"), F.col("own") - 1]), ["key", "span"]).where(once & near)


def _least_first(met: DataFrame) -> DataFrame:
    return met.select(F.least("article_id_x", "article_id_y").alias("a"), F.greatest("article_id_x", "article_id_y").alias("b"))


def _pairs_of_others(rows: DataFrame, hours: float) -> DataFrame | None:
    """(a, b): the pairs with an article that isn't plain, if there is one."""
    others = rows.where("NOT plain")
    if others.isEmpty():
        return None
    both = [(others, others), (others, rows.where("plain")), (rows.where("plain"), others)]
    met = [_least_first(_met(x.select("article_id", "times", "blocking", "plain"), y.select("article_id", "times", "blocking", "plain"), hours)) for x, y in both]
    return met[0].unionByName(met[1]).unionByName(met[2]).distinct()


def _pairs_of_plain(rows: DataFrame, hours: float, scored: bool = False, digits: int | None = None) -> DataFrame:
    """(a, b), and with scored their score: the pairs of plain rows, each at the first blocking entity that both have."""
    window = int(hours * 3_600_000_000)
    more = ["content_hash", "keys", "simhash"] if scored else []
    at = rows.withColumn("t", F.get("times", 0)).select("article_id", "t", "blocking", *more, F.posexplode("blocking").alias("at", "key"))
    at = at.select("article_id", "t", "key", F.slice("blocking", F.lit(1), F.col("at")).alias("before"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = meetings.held(batches, "article_id")
        ids, t, before = table["article_id"].combine_chunks(), table["t"].to_numpy(), meetings.Sets(table["before"])
        value = _scorer(table, t, hours, digits) if scored else None
        for a, b, ok in meetings.blocks(table, "article_id", "key", "t"):
            ok &= np.abs(t[a][:, None] - t[b][None, :]) <= window
            if (met := before.common(a, b)) is not None:
                ok &= met == 0
            x, y = np.nonzero(ok)
            if len(x):
                pairs = [ids.take(pa.array(a[x])), ids.take(pa.array(b[y]))]
                yield pa.RecordBatch.from_arrays([*pairs, pa.array(value(a, b)[ok])] if scored else pairs, names=["a", "b", "score"][: 2 + scored])

    kind = rows.schema["article_id"].dataType.simpleString()
    return meetings.dealt(at, "key", "article_id", F.floor(F.col("t") / window)).applyInArrow(run, f"a {kind}, b {kind}" + (", score double" if scored else ""))


def candidate_pairs(entities: DataFrame, articles: DataFrame, hours: float = HOURS) -> DataFrame:
    """(a, b), a < b: articles that share a blocking entity and were published within ``hours``. entities: (article_id, entity_type, node_key); articles: (article_id, published_at timestamp).

    Rows of one article on the left stand together, with nearly the same articles on the right from one to the next, which columnar files store in little."""
    rows = written(_keyed(entities, articles), "pair-keys")
    others = _pairs_of_others(rows, hours)
    pairs = _pairs_of_plain(rows.where("plain"), hours)
    return pairs if others is None else pairs.unionByName(others)


def score(jaccard: Column, hamming: Column, hours_apart: Column, same_hash: Column, hours: float = HOURS) -> Column:
    near = F.greatest(F.lit(0.0), 1 - hours_apart / hours)
    return F.when(same_hash, F.lit(1.0)).otherwise(WEIGHTS[0] * jaccard + WEIGHTS[1] * hamming + WEIGHTS[2] * near)


def _info(entities: DataFrame, articles: DataFrame, hashes: DataFrame) -> DataFrame:
    keys = entities.groupBy("article_id").agg(F.collect_set(F.concat_ws("|", "entity_type", "node_key")).alias("keys"))
    return articles.select("article_id", F.unix_micros("published_at").alias("t"), "content_hash").join(keys, "article_id", "left").join(hashes, "article_id", "left")


def _score(x: str, y: str, hours: float) -> Column:
    """Of the columns of ``_info`` with these endings."""
    c = lambda name, s: F.col(f"{name}_{s}")
    none = F.array().cast("array<string>")
    kx, ky = F.coalesce(c("keys", x), none), F.coalesce(c("keys", y), none)
    common = F.size(F.array_intersect(kx, ky))
    union = F.size(kx) + F.size(ky) - common
    jaccard = F.when(union > 0, common / union).otherwise(0.0)
    hamming = F.coalesce(1 - F.bit_count(c("simhash", x).bitwiseXOR(c("simhash", y))) / 64, F.lit(0.0))
    apart = F.coalesce(F.abs(c("t", x) - c("t", y)) / 3.6e9, F.lit(hours))
    same = (c("content_hash", x) == c("content_hash", y)) & (c("content_hash", x) != "")
    return score(jaccard, hamming, apart, F.coalesce(same, F.lit(False)), hours)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As ``F.round``: half up, by the shortest decimal that a number is written as."""
    unit = 10.0**digits
    whole = np.floor(x * unit + 0.5)
    open_ = np.abs(x * unit + 0.5 - np.rint(x * unit + 0.5)) < 1e-5  # too near to a half to be sure
    out = whole / unit
    if open_.any():
        some, at = np.unique(x[open_], return_inverse=True)
        out[open_] = np.array([float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in some.tolist()])[at]
    return out


def _scorer(table: pa.Table, t: np.ndarray, hours: float, digits: int | None):
    """``_score`` of all pairs of rows, on the left and on the right, of articles that meet at the table's ``key``."""
    keys, size = meetings.Sets(table["keys"], table["key"]), table["keys"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)
    text = table["content_hash"].combine_chunks()
    text = np.where(text.fill_null("").to_numpy(zero_copy_only=False) == "", -1, meetings.codes(table["content_hash"]))
    known = table["simhash"].is_valid().to_numpy()
    bits = table["simhash"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)

    def value(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = keys.common(a, b)
        common = 1.0 if common is None else common + 1.0
        jaccard = common / (size[a][:, None] + size[b][None, :] - common)
        hamming = 1 - np.bitwise_count(bits[a][:, None] ^ bits[b][None, :]) / 64
        if not (known[a].all() and known[b].all()):
            hamming[~(known[a][:, None] & known[b][None, :])] = 0.0
        near = np.maximum(0.0, 1 - np.abs(t[a][:, None] - t[b][None, :]) / 3.6e9 / hours)
        out = WEIGHTS[0] * jaccard + WEIGHTS[1] * hamming + WEIGHTS[2] * near
        out[(text[a][:, None] == text[b][None, :]) & (text[a] >= 0)[:, None]] = 1.0
        return out if digits is None else _rounded(out, digits)

    return value


def pair_scores(pairs: DataFrame, entities: DataFrame, articles: DataFrame, hashes: DataFrame, hours: float = HOURS) -> DataFrame:
    """(a, b, score). articles: (article_id, published_at, content_hash). Jaccard counts all entity kinds."""
    info = _info(entities, articles, hashes)
    side = lambda x: info.select(*[F.col(c).alias(x if c == "article_id" else f"{c}_{x}") for c in info.columns])
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", _score("a", "b", hours).alias("score"))


def scored_pairs(entities: DataFrame, articles: DataFrame, hashes: DataFrame, hours: float = HOURS, digits: int | None = None) -> DataFrame:
    """``pair_scores`` of all ``candidate_pairs``, scored where they meet: no table of pairs is shuffled. digits: that scores are rounded to."""
    info = _info(entities, articles, hashes).drop("t")
    rows = written(_keyed(entities, articles).join(info, "article_id"), "pair-keys")
    others = _pairs_of_others(rows.dropDuplicates(["article_id"]), hours)
    scores = _pairs_of_plain(rows.where("plain"), hours, True, digits)
    if others is None:
        return scores
    rest = pair_scores(others, entities, articles, hashes, hours)
    return scores.unionByName(rest if digits is None else rest.withColumn("score", F.round("score", digits)))


def cluster(articles: DataFrame, scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(article_id, cluster_id, is_representative, cluster_size). articles: (article_id, published_at, credibility_score). The representative is the earliest article (dateless last), then the most credible; size is null but there."""
    return cluster_by_links(articles, scores.where(F.col("score") >= threshold))


def cluster_by_links(articles: DataFrame, links: DataFrame) -> DataFrame:
    """``cluster`` of links (a, b)."""
    labels = components(links)
    rows = articles.join(labels.withColumnsRenamed({"node": "article_id", "component": "_c"}), "article_id", "left").withColumn("_c", F.coalesce("_c", "article_id"))
    order = F.struct(F.col("published_at").isNull(), "published_at", F.col("credibility_score").isNull(), (-F.col("credibility_score")).alias("c"), "article_id")
    best = rows.groupBy("_c").agg(F.min_by("article_id", order).alias("_best"), F.count(F.lit(1)).alias("_n"))
    j = rows.join(best, "_c")
    is_best = F.col("article_id") == F.col("_best")
    return j.select("article_id", F.sha2(F.col("_best").cast("string"), 256).alias("cluster_id"), is_best.alias("is_representative"), F.when(is_best, F.col("_n")).alias("cluster_size"))


def merge_incremental(known: DataFrame, links: DataFrame, new: DataFrame) -> DataFrame:
    """(article_id, cluster): labels after new articles and links came. Clusters grow and merge, they never split. known: (article_id, cluster), cluster being an article of it; new: (article_id)."""
    chains = known.select(F.col("article_id").alias("a"), F.col("cluster").alias("b")).unionByName(links.select("a", "b"))
    labels = components(chains).withColumnsRenamed({"node": "article_id", "component": "_c"})
    every = known.select("article_id").unionByName(new.select("article_id")).distinct()
    return every.join(labels, "article_id", "left").select("article_id", F.coalesce("_c", "article_id").alias("cluster"))


def assign_clusters(known: DataFrame, links: DataFrame, new: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, cluster_id, is_representative, cluster_size, changed) of all articles after new articles and links came.

    known: (article_id, cluster_id); new: (article_id); articles: (article_id, published_at, credibility_score) of both. Where
    links bridge clusters, the id of that with the earliest member (dateless last, then the least id) survives; a cluster of new
    articles only gets an id of its own. ``changed`` marks all articles of clusters whose membership changed: what is emitted again."""
    first = known.groupBy("cluster_id").agg(F.min("article_id").alias("_anchor"))
    anchored = known.join(first, "cluster_id").select("article_id", F.col("_anchor").alias("cluster"))
    grown = merge_incremental(anchored, links, new.join(known.select("article_id"), "article_id", "left_anti"))
    rows = grown.join(known.withColumnRenamed("cluster_id", "_old"), "article_id", "left").join(articles.select("article_id", "published_at", "credibility_score"), "article_id", "left")
    return settle(rows).select("article_id", "cluster_id", "is_representative", "cluster_size", "changed")


def settle(rows: DataFrame) -> DataFrame:
    """rows with cluster_id, is_representative, cluster_size and changed. rows: (article_id, published_at, credibility_score, cluster, _old, ...) with all articles of each cluster, which so far had the ids ``_old``, or none."""
    date = F.struct(F.col("published_at").isNull().alias("none"), "published_at")
    oldest = rows.where("_old IS NOT NULL").groupBy("cluster", "_old").agg(F.min(date).alias("_t"), F.count(F.lit(1)).alias("_n"))
    survivor = oldest.groupBy("cluster").agg(F.min_by("_old", F.struct("_t", "_old")).alias("_id"), F.count(F.lit(1)).alias("_clusters"), F.sum("_n").alias("_members"))
    order = F.struct(F.col("published_at").isNull().alias("none"), "published_at", F.col("credibility_score").isNull().alias("no"), (-F.col("credibility_score")).alias("c"), "article_id")
    best = rows.groupBy("cluster").agg(F.min_by("article_id", order).alias("_best"), F.count(F.lit(1)).alias("_size"))
    j = rows.join(best, "cluster").join(survivor, "cluster", "left")
    is_best = F.col("article_id") == F.col("_best")
    changed = (F.coalesce("_clusters", F.lit(0)) != 1) | (F.col("_members") != F.col("_size"))
    new = {"cluster_id": F.coalesce("_id", F.sha2(F.col("_best").cast("string"), 256)), "is_representative": is_best, "cluster_size": F.when(is_best, F.col("_size")), "changed": changed}
    return j.withColumns(new).drop("cluster", "_best", "_size", "_id", "_clusters", "_members")


def with_credibility(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with the credibility of their source, null where the source isn't known. articles: (source_id, ...); sources: (source_id, credibility_score)."""
    rest = [c for c in articles.columns if c != "credibility_score"]
    return articles.select(*rest).join(sources.select("source_id", "credibility_score"), "source_id", "left")


def article_entities(mentions: DataFrame) -> DataFrame:
    """(article_id, entity_type, node_key) of resolved mentions, each key once an article."""
    return mentions.where("node_key <> ''").select("article_id", "entity_type", "node_key").distinct()


def entity_union(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """(cluster_id, entities): all entities of a cluster's articles by key, of the highest confidence each."""
    w = Window.partitionBy("cluster_id", "node_key").orderBy(F.desc("node_confidence"), "article_id", "entity_type")
    best = clusters.join(entities, "article_id").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("node_key", "entity_type", "node_confidence"))).alias("entities"))


def elect(articles: DataFrame, group: str) -> DataFrame:
    """The representative of each group and its size, by one aggregation."""
    order = F.struct(F.col("published_at").isNull().alias("none"), "published_at", F.col("credibility_score").isNull().alias("no"), (-F.col("credibility_score")).alias("c"), "article_id")
    rest = [c for c in articles.columns if c != group]
    best = articles.groupBy(group).agg(F.min_by(F.struct(*rest), order).alias("_best"), F.count(F.lit(1)).alias("cluster_size"))
    return best.select(group, *[F.col(f"_best.{c}").alias(c) for c in rest], "cluster_size")
