"""The property graph as keyed tables: upserts, edges, differences and assertion scores.

A new state is computed from (old state, batch) by keyed aggregation, so within a batch no
update can be lost and a repeated batch changes nothing. ``seq`` orders writes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAP = 50


def checked_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def upsert_nodes(existing: DataFrame, incoming: DataFrame, keys: list[str], last: list[str] = (), first: list[str] = (), seq: str = "seq") -> DataFrame:
    """Old and new rows by key: ``last`` columns take the latest non-null value, ``first`` columns that of the creating row."""
    names = [checked_name(c) for c in (*keys, *last, *first)]
    old = existing.select(*names, F.lit(-1).cast("long").alias("_seq"))
    new = incoming.select(*names, F.col(seq).cast("long").alias("_seq"))
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in last] + [F.min_by(c, "_seq").alias(c) for c in first]
    return old.unionByName(new).groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_n")])).select(*names)


def update_existing(existing: DataFrame, updates: DataFrame, key: str, column: str, seq: str = "seq") -> DataFrame:
    """Sets a column of rows that exist; other keys of the updates are ignored."""
    last = updates.groupBy(key).agg(F.max_by(column, seq).alias("_new"))
    return existing.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def new_keys(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Keys that don't exist yet, each once: what is to be enriched."""
    return incoming.select(key).where(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti").distinct()


EDGE = ["start_key", "rel_type", "end_key"]


def merge_edges(existing: DataFrame, incoming: DataFrame, nodes: DataFrame, node_key: str = "node_key") -> tuple[DataFrame, DataFrame]:
    """(outcomes, violations): each distinct edge with outcome created or matched, and edges of which an end is missing."""
    known = nodes.select(F.col(node_key).alias("_k")).distinct()
    edges = incoming.select(*EDGE).distinct()
    both = edges.join(known.withColumnRenamed("_k", "start_key"), "start_key", "left_semi").join(known.withColumnRenamed("_k", "end_key"), "end_key", "left_semi")
    outcome = F.when(F.col("_old").isNull(), "created").otherwise("matched")
    outcomes = both.join(existing.select(*EDGE, F.lit(True).alias("_old")).distinct(), EDGE, "left").select(*EDGE, outcome.alias("outcome"))
    return outcomes, edges.join(both, EDGE, "left_anti")


def merge_properties(existing: DataFrame, incoming: DataFrame, nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """(EDGE, props, created): all edges after writes in order of ``seq``, whose ends must be nodes (others are left out; see ``merge_edges``).

    existing: (EDGE, props map<string,string>); incoming: (EDGE, on_create, on_match, seq). The write that creates an edge sets
    on_create, each later one on_match. Of each property the last write counts; a null value removes it."""
    known = nodes.select(F.col("node_key").alias("_k")).distinct()
    valid = incoming.join(known.withColumnRenamed("_k", "start_key"), "start_key", "left_semi").join(known.withColumnRenamed("_k", "end_key"), "end_key", "left_semi")
    firsts = valid.groupBy(*EDGE).agg(F.min(seq).alias("_first")).join(existing.select(*EDGE, F.lit(True).alias("_old")), EDGE, "left")
    creates = F.col("_old").isNull() & (F.col(seq) == F.col("_first"))
    # A property's writes are aggregated, not an edge's, so no edge is gathered in one task.
    written = valid.join(firsts, EDGE).select(*EDGE, F.col(seq).cast("long").alias("_seq"), F.explode_outer(F.when(creates, F.col("on_create")).otherwise(F.col("on_match"))).alias("k", "v"))
    old = existing.select(*EDGE, F.lit(-1).cast("long").alias("_seq"), F.explode_outer("props").alias("k", "v"))
    last = old.unionByName(written).groupBy(*EDGE, "k").agg(F.max_by("v", "_seq").alias("v"), F.min("_seq").alias("_seq"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull() & F.col("v").isNotNull(), F.struct("k", "v"))))
    return last.groupBy(*EDGE).agg(F.map_from_entries(pairs).alias("props"), (F.min("_seq") >= 0).alias("created"))


def guard_direction(edges: DataFrame) -> DataFrame:
    """Fails on an ASSOCIATED_WITH edge that doesn't end at an indicator, by its end's label or, where edges have none, by its key (value::kind)."""
    at_indicator = F.col("end_label") == "IOC" if "end_label" in edges.columns else F.contains("end_key", F.lit("::"))
    bad = (F.col("rel_type") == "ASSOCIATED_WITH") & ~F.coalesce(at_indicator, F.lit(False))
    return edges.withColumn("rel_type", F.when(bad, F.raise_error(F.lit("ASSOCIATED_WITH must end at an IOC"))).otherwise(F.col("rel_type")))


def latest_edges(existing: DataFrame, incoming: DataFrame, keys: list[str], props: list[str], seq: str = "seq") -> DataFrame:
    """Evidence edges: every write replaces all properties."""
    old, new = existing.select(*keys, *props, F.lit(-1).cast("long").alias("_seq")), incoming.select(*keys, *props, F.col(seq).cast("long").alias("_seq"))
    return old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(*props), "_seq").alias("_p")).select(*keys, "_p.*")


def difference(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to delete or add, with ``change``, to make existing what is wanted."""
    old, new = existing.select(*keys).distinct(), wanted.select(*keys).distinct()
    return old.join(new, keys, "left_anti").withColumn("change", F.lit("delete")).unionByName(new.join(old, keys, "left_anti").withColumn("change", F.lit("add")))


def sync_sources(config: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action): create, update, delete or same, of a configured list against the stored one."""
    a = config.select(key, F.struct(*fields).alias("_a"), F.lit(True).alias("_in"))
    b = stored.select(key, F.struct(*fields).alias("_b"), F.lit(True).alias("_has"))
    action = F.when(F.col("_has").isNull(), "create").when(F.col("_in").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update").otherwise("same")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def sync_source_nodes(config: DataFrame, nodes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Source nodes after a sync, with ``change``: configured ones are active and take the configured fields; active ones that aren't configured stay, inactive.

    nodes: (key, *fields, is_active). change: created, updated, deactivated, or same."""
    a = config.select(key, F.struct(*fields).alias("_a"))
    b = nodes.select(key, F.struct(*fields).alias("_b"), "is_active")
    j = a.join(b, key, "full_outer")
    wanted, known = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    change = F.when(~known, "created").when(~wanted & F.col("is_active"), "deactivated").when(wanted & (~F.col("_a").eqNullSafe(F.col("_b")) | ~F.coalesce("is_active", F.lit(False))), "updated").otherwise("same")
    return j.select(key, *[F.when(wanted, F.col(f"_a.{c}")).otherwise(F.col(f"_b.{c}")).alias(c) for c in fields], wanted.alias("is_active"), change.alias("change"))


def outcome_counts(rows: DataFrame, by: list[str] = (), outcome: str = "outcome") -> DataFrame:
    """How many rows had each outcome."""
    return rows.groupBy(*by, outcome).agg(F.count(F.lit(1)).alias("n"))


#: The key that must name one node only, by label.
UNIQUE = {"Source": "url", "CVE": "cve_id", "CWE": "cwe_id", "TTP": "technique_id", "ThreatActor": "merge_key", "MalwareFamily": "merge_key", "Campaign": "merge_key", "Article": "source_guid_key", "IOC": "value_type_key"}


def key_violations(nodes: DataFrame, label: str) -> DataFrame:
    """(label, key, n): keys that more than one node of a label has; null keys don't count."""
    key = F.col(checked_name(UNIQUE[label])).cast("string")
    return nodes.where(key.isNotNull()).groupBy(F.lit(label).alias("label"), key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def retract_stale(mentions: DataFrame, current: DataFrame, labels: list[str], processed: DataFrame | None = None) -> DataFrame:
    """Mentions without those of re-extracted articles and the given labels that the new extraction doesn't hold.

    processed: (article_id), the articles that were extracted again, also those without any mention now; by default those in ``current``."""
    done = (current if processed is None else processed).select("article_id").distinct().withColumn("_done", F.lit(True))
    held = current.select("article_id", "label", "node_key").distinct().withColumn("_held", F.lit(True))
    j = mentions.join(done, "article_id", "left").join(held, ["article_id", "label", "node_key"], "left")
    stale = F.col("_done").isNotNull() & F.col("_held").isNull() & F.col("label").isin(labels)
    return j.where(~stale).select(*mentions.columns)


def _newer(at: Column, text: Column, stored_at: Column, stored: Column) -> Column:
    return F.when(stored.isNull(), True).when(text.isNull(), False).when(at.isNotNull() & stored_at.isNotNull(), at > stored_at).otherwise(text > stored)


def is_fresher(incoming: Column, stored: Column) -> Column:
    """Whether an incoming modification time (text) is strictly newer: null is stale if one is stored, else applied; texts that are no times compare as texts."""
    return _newer(F.try_to_timestamp(incoming), incoming, F.try_to_timestamp(stored), stored)


#: Rows that a task of ``fold_deltas`` or ``apply_deltas`` sorts, about; more, where one key has more.
TASK_ROWS = 1_000_000


def parts_for(rows: int) -> int:
    """Partitions for so many rows, stored and incoming together."""
    return max(1, -(-rows // TASK_ROWS))


#: What may become of a payload.
OUTCOMES = ("absent", "resynced", "stale")


def _applied(existing: DataFrame, incoming: DataFrame, keys: str, scalars: list[str], items: str, create: bool, seq: str, parts: int | None) -> DataFrame:
    """Stored (``_old``) and incoming rows with the latter's ``outcome``. Both meet in one shuffle, and each key's rows are sorted once."""
    time = F.when(F.col("last_modified").isNotNull(), F.struct(F.try_to_timestamp("last_modified").alias("t"), F.col("last_modified").alias("text"))).alias("_time")
    # A stored row without a key is nobody's, and stays by itself.
    own = F.when(F.col(keys).isNull(), F.monotonically_increasing_id())
    old = existing.select(keys, own.alias("_own"), F.lit(True).alias("_old"), F.lit(None).cast(incoming.schema[seq].dataType).alias(seq), *scalars, items, time)
    both = old.unionByName(incoming.select(keys, F.lit(None).cast("long").alias("_own"), F.lit(False).alias("_old"), seq, *scalars, items, time))
    parts = parts_for(existing.count() + incoming.count()) if parts is None else parts
    if parts > int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        both = both.repartition(parts, keys)
    before = Window.partitionBy(keys, "_own").orderBy(F.col("_old").desc(), seq).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumns({"_water": F.max("_time").over(before), "_has": F.coalesce(F.max("_old").over(before), F.lit(False))})
    fresh = _newer(F.col("_time.t"), F.col("_time.text"), F.col("_water.t"), F.col("_water.text"))
    outcome = F.when(~F.lit(create) & ~F.col("_has"), "absent").when(fresh, "resynced").otherwise("stale")
    return seen.withColumn("outcome", F.when(~F.col("_old"), outcome))


def _folded(applied: DataFrame, keys: str, scalars: list[str], items: str, seq: str) -> DataFrame:
    stored = lambda c: F.first(F.when(F.col("_old"), F.col(c)), ignorenulls=True)
    last = lambda c, which: F.max_by(c, F.when(which, F.col(seq)))
    used, fresh = (F.coalesce(x, F.lit(False)) for x in (F.col("outcome") != "absent", F.col("outcome") == "resynced"))
    return applied.groupBy(keys, "_own").agg(
        *[F.count(F.when(F.col("outcome") == x, 1)).alias(x) for x in OUTCOMES],
        F.max(F.col("_old") | used).alias("known"),
        *[F.coalesce(last(c, used & F.col(c).isNotNull()), stored(c)).alias(c) for c in scalars],
        F.when(F.max(fresh), last(items, fresh)).otherwise(stored(items)).alias(items),
        F.coalesce(last("_time", fresh & F.col("_time").isNotNull()), stored("_time"))["text"].alias("last_modified"),
    ).drop("_own")


def fold_deltas(existing: DataFrame, incoming: DataFrame, keys: str, scalars: list[str], items: str, create: bool = False, seq: str = "seq", parts: int | None = None) -> DataFrame:
    """(key, absent, resynced, stale, known, *scalars, items, last_modified) of all keys: how many payloads had each outcome, and the state, as in ``apply_deltas``, from one pass. Keys without a state aren't ``known``."""
    return _folded(_applied(existing, incoming, keys, scalars, items, create, seq, parts), keys, scalars, items, seq)


def apply_deltas(existing: DataFrame, incoming: DataFrame, keys: str, scalars: list[str], items: str, create: bool = False, seq: str = "seq", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, state) of modification payloads, applied in order of ``seq`` to the stored rows.

    existing: (key, *scalars, items, last_modified), one row a key; incoming: the same with seq. An outcome is 'absent' (no such key, unless
    ``create``), 'resynced' (newer than all before: items and the stored time are replaced) or 'stale'. Scalars are applied
    unless absent, null ones keep what is there. parts: see ``parts_for``; without it, both tables are counted first."""
    applied = _applied(existing, incoming, keys, scalars, items, create, seq, parts)
    state = _folded(applied, keys, scalars, items, seq).where("known")
    return applied.where(~F.col("_old")).select(keys, seq, "outcome"), state.select(keys, *scalars, items, "last_modified")


def credibility_of(feeds: DataFrame, sources: DataFrame, default: float = 0.5) -> DataFrame:
    return feeds.join(sources.select("source_id", "credibility_score"), "source_id", "left").withColumn("credibility_score", F.coalesce("credibility_score", F.lit(default)))


def feed_assertions(edges: DataFrame, sources: DataFrame, ts: int, source_id: str | None = None) -> DataFrame:
    """Edges that a feed states, as events for ``authoritative_edges``. edges: (EDGE, and source_id, unless it is given for all); ts: when they were read."""
    named = edges if source_id is None else edges.withColumn("source_id", F.lit(source_id))
    return credibility_of(named.select(*EDGE, "source_id", F.lit(ts).cast("long").alias("ts")), sources)


def authoritative_edges(events: DataFrame) -> DataFrame:
    """Assertions of feeds (EDGE, source_id, credibility_score, ts): the highest credibility counts."""
    return events.groupBy(*EDGE).agg(
        F.max("credibility_score").alias("authoritative_confidence"), F.sort_array(F.collect_set("source_id")).alias("feed_sources"), F.min("ts").alias("first_observed"), F.max("ts").alias("last_confirmed")
    )


def inferred_edges(events: DataFrame) -> DataFrame:
    """Contributions of stories (EDGE, cluster_id, contribution, ts, seq): noisy-or over clusters, each of which counts once, by its first contribution."""
    firsts = events.groupBy(*EDGE, "cluster_id").agg(F.min_by("contribution", "seq").alias("c"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return firsts.groupBy(*EDGE).agg(
        (1 - F.product(1 - F.col("c"))).alias("inferred_confidence"), F.sort_array(F.collect_set("cluster_id")).alias("contributing_story_cluster_ids"), F.min("t0").alias("first_observed"), F.max("t1").alias("last_confirmed")
    )


def merge_authoritative(state: DataFrame, events: DataFrame) -> DataFrame:
    """The authoritative side of edges after a batch. state: what this or ``authoritative_edges`` gave before; stored values never fall, and the first observation stays. Fails on an edge that ``guard_direction`` refuses."""
    new = authoritative_edges(guard_direction(events))
    both = state.select(*new.columns).unionByName(new)
    return both.groupBy(*EDGE).agg(
        F.max("authoritative_confidence").alias("authoritative_confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("feed_sources")))).alias("feed_sources"), F.min("first_observed").alias("first_observed"), F.max("last_confirmed").alias("last_confirmed")
    )


INFERRED = "inferred_confidence double, contributing_story_cluster_ids array<string>, source_article_ids array<string>, supporting_article_count long, first_observed long, last_confirmed long"


def merge_inferred(state: DataFrame, events: DataFrame, cap: int = CAP) -> DataFrame:
    """The inferred side of edges after a batch of stories' contributions. state: (EDGE, columns of INFERRED), as this function gave it before, at first empty.

    events: (EDGE, cluster_id, contribution, article_ids, ts, seq). A story counts once for an edge, by its first contribution: if the
    edge has it already, nothing but ``last_confirmed`` changes, neither the confidence nor ids nor their count. Fails on an edge that
    ``guard_direction`` refuses."""
    events = guard_direction(events)
    old = state.select(*EDGE, F.struct(*[c.split()[0] for c in INFERRED.split(", ")]).alias("_old"))
    touched = events.groupBy(*EDGE).agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    known = state.select(*EDGE, F.explode("contributing_story_cluster_ids").alias("cluster_id"))
    new = events.join(known, [*EDGE, "cluster_id"], "left_anti").groupBy(*EDGE, "cluster_id").agg(F.min_by(F.struct("contribution", "article_ids"), "seq").alias("_e"), F.min("seq").alias("seq"))
    gain = new.groupBy(*EDGE).agg(F.product(1 - F.col("_e.contribution")).alias("_rest"), F.collect_set("cluster_id").alias("_ids"))
    # The stored ids come before all new ones.
    listed = new.select(*EDGE, F.col("seq").cast("long").alias("seq"), F.col("_e.article_ids").alias("article_ids"))
    before = state.join(new.select(*EDGE).distinct(), EDGE, "left_semi").select(*EDGE, F.lit(-1).cast("long").alias("seq"), F.col("source_article_ids").alias("article_ids"))
    ids = capped_ids(listed.unionByName(before), EDGE, cap=cap).withColumnsRenamed({"source_article_ids": "_list", "supporting_article_count": "_count"})
    j = touched.join(old, EDGE, "full_outer").join(gain, EDGE, "left").join(ids, EDGE, "left")
    none = F.array().cast("array<string>")
    stored = lambda c, default: F.coalesce(F.col(f"_old.{c}"), default)
    counted = stored("supporting_article_count", F.lit(0).cast("long")) + F.col("_count") - F.size(stored("source_article_ids", none))
    return j.select(
        *EDGE,
        (1 - (1 - stored("inferred_confidence", F.lit(0.0))) * F.coalesce("_rest", F.lit(1.0))).alias("inferred_confidence"),
        F.array_sort(F.array_union(stored("contributing_story_cluster_ids", none), F.coalesce("_ids", none))).alias("contributing_story_cluster_ids"),
        F.coalesce("_list", F.col("_old.source_article_ids")).alias("source_article_ids"),
        F.coalesce(counted, F.col("_old.supporting_article_count")).cast("long").alias("supporting_article_count"),
        F.coalesce(F.col("_old.first_observed"), F.col("_t0")).alias("first_observed"),
        F.greatest("_old.last_confirmed", "_t1").alias("last_confirmed"),
    )


def combine_edges(authoritative: DataFrame, inferred: DataFrame) -> DataFrame:
    """Edges with both components; confidence is the larger one."""
    a, i = authoritative.withColumnsRenamed({"first_observed": "_fa", "last_confirmed": "_la"}), inferred.withColumnsRenamed({"first_observed": "_fi", "last_confirmed": "_li"})
    j = a.join(i, EDGE, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    origin = F.array_compact(F.array(F.when(F.col("authoritative_confidence").isNotNull(), "authoritative"), F.when(F.col("inferred_confidence").isNotNull(), "inferred")))
    return j.select(
        *EDGE, "authoritative_confidence", "inferred_confidence", F.greatest(zero("authoritative_confidence"), zero("inferred_confidence")).alias("confidence"), origin.alias("origin"),
        "feed_sources", "contributing_story_cluster_ids", F.least("_fa", "_fi").alias("first_observed"), F.greatest("_la", "_li").alias("last_confirmed"),
    )


def recompute_for_feed(edges: DataFrame, sources: DataFrame, feed: str, score: float) -> DataFrame:
    """Edges that a feed asserts, with the authoritative confidence that its new score gives; other feeds count by their scores."""
    touched = edges.where(F.array_contains("feed_sources", feed))
    each = touched.select(*EDGE, F.explode("feed_sources").alias("source_id")).join(sources.select("source_id", "credibility_score"), "source_id", "left")
    value = F.when(F.col("source_id") == feed, F.lit(score)).otherwise(F.col("credibility_score"))
    best = each.groupBy(*EDGE).agg(F.max(value).alias("authoritative_confidence"))
    rest = touched.drop("authoritative_confidence", "confidence").join(best, EDGE)
    return rest.withColumn("confidence", F.greatest(F.coalesce("authoritative_confidence", F.lit(0.0)), F.coalesce("inferred_confidence", F.lit(0.0))))


def touched_by_feed(edges: DataFrame, sources: DataFrame, feed: str, score: float) -> DataFrame:
    """(rel_type, touched, raised, lowered): how many edges ``recompute_for_feed`` recomputes, and of how many the confidence changes."""
    new = recompute_for_feed(edges, sources, feed, score).select(*EDGE, F.col("confidence").alias("_new"))
    j = new.join(edges.select(*EDGE, "confidence"), EDGE)
    return j.groupBy("rel_type").agg(F.count(F.lit(1)).alias("touched"), F.count_if(F.col("_new") > F.col("confidence")).alias("raised"), F.count_if(F.col("_new") < F.col("confidence")).alias("lowered"))


def capped_ids(events: DataFrame, keys: list[str], ids: str = "article_ids", seq: str = "seq", cap: int = CAP) -> DataFrame:
    """A list of the first ``cap`` ids, and a count of ids that weren't in the list when they came (exact up to the cap)."""
    values = F.transform(F.array_distinct("_ids"), lambda x, i: F.struct(x.alias("id"), i.alias("pos")))
    each = events.select(*keys, F.col(seq).alias("_seq"), F.col(ids).cast("array<string>").alias("_ids")).select(*keys, "_seq", "_ids", F.explode_outer(values).alias("_e"))
    known = F.col("_e").isNotNull()
    per = each.groupBy(*keys, known.alias("_known"), F.col("_e.id").alias("_id")).agg(F.min(F.struct("_seq", "_ids", "_e.pos")).alias("_first"), F.count_if(known).alias("_n"))
    # Ids in the list count once, all others as often as they come. The first ids are taken in each partition, then of all.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", "_id"))
    item = F.struct("_first", "_id")
    top = per.where("_known").withColumn("_rank", rank).where(F.col("_rank") <= cap).select(*keys, (1 - F.col("_n")).alias("_n"), item.alias("_item"))
    both = top.unionByName(per.select(*keys, "_n"), allowMissingColumns=True).groupBy(*keys).agg(F.array_sort(F.collect_list("_item")).alias("_items"), F.sum("_n").alias("supporting_article_count"))
    return both.select(*keys, F.transform("_items", lambda x: x["_id"]).alias("source_article_ids"), "supporting_article_count")


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with merged nodes: ends are re-pointed by (old_key, new_key), edges that then coincide become one of the highest confidence."""
    m = F.broadcast(mapping) if mapping.isLocal() else mapping
    s = m.select(F.col("old_key").alias("start_key"), F.col("new_key").alias("_s"))
    e = m.select(F.col("old_key").alias("end_key"), F.col("new_key").alias("_e"))
    moved = edges.join(s, "start_key", "left").join(e, "end_key", "left")
    moved = moved.select(F.coalesce("_s", "start_key").alias("start_key"), "rel_type", F.coalesce("_e", "end_key").alias("end_key"), "confidence")
    return moved.where("start_key <> end_key").groupBy(*EDGE).agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("merged"))


LABELLED = ["start_label", "start_key", "rel_type", "end_label", "end_key"]


def merge_labelled_edges(edges: DataFrame, into: DataFrame) -> DataFrame:
    """Edges with merged nodes, all properties kept, and ``merged``, how many edges became one.

    edges: (LABELLED and properties); into: (label, merge_key, canonical_key). Only ends of the label are re-pointed, edges of a node to itself
    go. Of edges that coincide arrays are united, ``first_observed`` is the earliest, ``last_confirmed`` and numbers the greatest; of other
    properties that of the edge that was there counts, else the least."""
    moved = edges
    for side in ("start", "end"):
        m = into.select(F.col("label").alias(f"{side}_label"), F.col("merge_key").alias(f"{side}_key"), F.col("canonical_key").alias(f"_{side}"))
        moved = moved.join(m, [f"{side}_label", f"{side}_key"], "left")
    was = F.col("_start").isNull() & F.col("_end").isNull()
    moved = moved.withColumns({"_was": was, "start_key": F.coalesce("_start", "start_key"), "end_key": F.coalesce("_end", "end_key")})
    moved = moved.where((F.col("start_key") != F.col("end_key")) | (F.col("start_label") != F.col("end_label")))

    def one(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(field.name)
        if field.name == "first_observed":
            return F.min(c).alias(field.name)
        if field.name == "last_confirmed" or isinstance(field.dataType, T.NumericType):
            return F.max(c).alias(field.name)
        return F.min(F.when(c.isNotNull(), F.struct((~F.col("_was")).alias("new"), c.alias("c"))))["c"].alias(field.name)

    rest = [one(f) for f in edges.schema if f.name not in LABELLED]
    return moved.groupBy(*LABELLED).agg(*rest, F.count(F.lit(1)).alias("merged"))


def detect_changes(entries: DataFrame, keys: list[str] = ("source_id", "guid"), fingerprint: str = "fingerprint", seq: str = "seq") -> DataFrame:
    """Entries that are new (discovery) or whose fingerprint differs from the one before (update)."""
    before = F.lag(fingerprint).over(Window.partitionBy(*keys).orderBy(seq))
    return entries.withColumn("event_type", F.when(before.isNull(), "discovery").when(before != F.col(fingerprint), "update")).where("event_type IS NOT NULL")


def poll_windows(polls: DataFrame, state: DataFrame | None = None, lookback_hours: float = 24.0, source: str = "source_id", seq: str = "seq") -> DataFrame:
    """(source, seq, window_start, window_end, ok): what each poll asks for. polls: (source, seq, started_at microseconds, ok); state: (source, last_success_at).

    A window ends when the poll begins, before anything is fetched, and the next one begins where the last successful one ended;
    a failure moves nothing. The first poll of a source looks ``lookback_hours`` back."""
    before = Window.partitionBy(source).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("ok"), F.col("started_at")), ignorenulls=True).over(before)
    rows = polls if state is None else polls.join(state.select(source, "last_success_at"), source, "left")
    stored = F.lit(None).cast("long") if state is None else F.col("last_success_at")
    first = F.col("started_at") - int(lookback_hours * 3_600_000_000)
    return rows.select(source, seq, F.coalesce(last, stored, first).alias("window_start"), F.col("started_at").alias("window_end"), "ok")


def poll_marks(windows: DataFrame, source: str = "source_id", seq: str = "seq") -> DataFrame:
    """(source, last_success_at): the state that successful polls leave."""
    return windows.where("ok").groupBy(source).agg(F.max_by("window_end", seq).alias("last_success_at"))


def poll_health(polls: DataFrame, source: str = "source_id", seq: str = "seq", ok: str = "ok", threshold: int = 6) -> DataFrame:
    """Of each source: failures since its last success, when that was, and whether to alert."""
    last = polls.groupBy(source).agg(F.max(F.when(F.col(ok), F.col(seq))).alias("last_success"))
    since = polls.join(last, source).where(F.col("last_success").isNull() | (F.col(seq) > F.col("last_success")))
    n = since.groupBy(source).agg(F.count_if(~F.col(ok)).alias("n"))
    return last.join(n, source, "left").select(source, F.coalesce("n", F.lit(0)).cast("long").alias("consecutive_failures"), "last_success").withColumn("alert", F.col("consecutive_failures") >= threshold)
