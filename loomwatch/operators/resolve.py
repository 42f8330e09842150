"""Resolution of mentions to entities: exact, fuzzy, provisional; reconciliation of provisional entities.

Names are resolved once each, not once a mention: distinct normalised names go through the
ladder, each tier seeing only what the one before left, and results are joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwatch.functions import text as tx
from loomwatch.shared import remove, written

ACCEPT, REVIEW = 0.85, 0.6


def normal(name):
    return tx.collapse(F.col(name) if isinstance(name, str) else name)


def alias_index(entities: DataFrame) -> DataFrame:
    """(alias, merge_key, first_seen): of each normalised name the last entity that has it, and the place (seq, position) where it came first. entities: (merge_key, name, aliases, seq)."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.where("merge_key IS NOT NULL").select("merge_key", "seq", F.posexplode(names).alias("pos", "raw")).where("raw IS NOT NULL")
    place = F.struct("seq", "pos")
    return rows.groupBy(normal("raw").alias("alias")).agg(F.max_by("merge_key", place).alias("merge_key"), F.min(place).alias("first_seen")).where("alias <> ''")


def _tokens(names: DataFrame) -> DataFrame:
    """(name, tokens): the characters of each name, those that repeat told apart by a number."""
    token = F.transform("_c", lambda c, i: F.concat(c, F.size(F.filter(F.slice("_c", 1, i + 1), lambda x: x == c)).cast("string")))
    return names.where("name <> ''").select("name", tx.find_all(F.col("name"), "(?s).").alias("_c")).select("name", token.alias("tokens"))


def _keys(names: DataFrame, counts: DataFrame, least: float, own: str, other: str) -> DataFrame:
    """(name, own, other, key): by length of the partner, keys of up to ``COMBINED`` of a name's rarest characters.

    A pair of lengths a and b needs ``must`` = least * (a + b) / 2 characters in common. The first c of them, in order of rarity, are
    among the first a - must + c of the one and the first b - must + c of the other, so both have the key of these c characters."""
    ranked = _tokens(names).select("name", F.explode("tokens").alias("token")).join(F.broadcast(counts), "token")
    ranked = ranked.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t")).select("name", F.length("name").alias(own), F.transform("t", lambda x: x["token"]).alias("t"))
    lengths = F.sequence(F.ceil(F.col(own) * least / (2 - least) - 1e-9).cast("int"), F.floor(F.col(own) * (2 - least) / least + 1e-9).cast("int"))
    rows = ranked.withColumn(other, F.explode(lengths))
    must = F.ceil((F.col(own) + F.col(other)) * (least / 2) - 1e-9).cast("int")
    rows = rows.withColumn("c", F.least(must, F.lit(COMBINED))).withColumn("t", F.slice("t", 1, F.greatest(F.size("t") - must + F.col("c"), F.lit(0)))).where(F.size("t") >= F.col("c"))
    rows = rows.select("name", own, other, "c", "t", F.posexplode("t").alias("at", "key"))
    for depth in range(2, COMBINED + 1):  # every further character behind the last one
        rest = F.when(F.col("c") >= depth, F.slice("t", F.col("at") + 2, F.size("t"))).otherwise(F.array(F.lit("")))
        rows = rows.select("name", own, other, "c", "t", F.col("at").alias("_at"), F.col("key").alias("_key"), F.posexplode(rest).alias("_i", "_k"))
        rows = rows.select("name", own, other, "c", "t", (F.col("_at") + 1 + F.col("_i")).alias("at"), F.concat_ws(" ", "_key", "_k").alias("key"))
    return rows.select("name", own, other, "key")


#: Characters in a key; pairs that can be alike share one.
COMBINED = 3


def likely_pairs(names: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(name, _name): the pairs that may reach a ratio of ``least``; a small part of all, none that does is lost. Both: (name).

    They share a key. What matches of two names is a common subsequence, so its length bounds the characters they share and how many
    edits they are apart."""
    both = names.select("name").unionByName(others.select("name")).distinct()
    counts = _tokens(both).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    left = _keys(names.select("name").distinct(), counts, least, "_a", "_b")
    right = _keys(others.select("name").distinct(), counts, least, "_b", "_a").withColumnRenamed("name", "_name")
    # A name has hundreds of keys, which the sizes of what they are made from don't tell: neither side is broadcast.
    pairs = left.hint("merge").join(right, ["_a", "_b", "key"]).select("name", "_name", "_a", "_b").distinct()
    must = F.ceil((F.col("_a") + F.col("_b")) * (least / 2) - 1e-9)
    # From a common subsequence of that length one name becomes the other by so many deletions and insertions.
    edits = (F.col("_a") + F.col("_b") - 2 * must).cast("int")
    return pairs.where(F.levenshtein("name", "_name") <= edits).select("name", "_name")


def _ratios(names: DataFrame, aliases: DataFrame, least: float, extra: list[str] = ()) -> DataFrame:
    """(name, alias, merge_key, first_seen, ratio, and ``extra``, columns that must be equal on both sides) of all pairs that reach ``least``, by the standard library's sequence matcher (first: the name; it isn't symmetric).

    ratio = 2 m / (la + lb), with m matching characters."""
    names, extra = names.select("name", *extra).distinct(), list(extra)
    aliases = aliases.select(F.col("alias").alias("_name"), "merge_key", "first_seen", *extra)
    scored = ratios(likely_pairs(names, aliases.select(F.col("_name").alias("name")), least), least)
    return scored.join(names, "name").join(aliases, ["_name", *extra]).withColumnRenamed("_name", "alias")


def ratios(pairs: DataFrame, least: float) -> DataFrame:
    """(name, _name, ratio) of those pairs that reach ``least``."""
    import difflib

    kept = T.StructType([T.StructField("name", T.StringType()), T.StructField("_name", T.StringType()), T.StructField("ratio", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(batch.column("name").to_pylist(), batch.column("_name").to_pylist(), strict=True)]
            yield batch.append_column("ratio", pa.array(found, pa.float64()))

    return pairs.select("name", "_name").mapInArrow(run, kept).where(F.col("ratio") >= least)


def one_apart(names: DataFrame, others: DataFrame) -> DataFrame:
    """(name, _name): all pairs that are equal once at most one character of each is left out, and few others. Both: (name)."""
    without = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.col("name").substr(F.lit(1), i - 1), F.col("name").substr(i + 1, F.length("name"))))
    parts = lambda df: df.select("name").where("name <> ''").distinct().select("name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), without), lambda x: F.xxhash64(x)))).alias("key"))
    return parts(names).hint("merge").join(parts(others).withColumnRenamed("name", "_name"), "key").select("name", "_name").distinct()


def fuzzy_match(names: DataFrame, aliases: DataFrame, least: float = ACCEPT) -> DataFrame:
    """(name, merge_key, ratio): the best alias of each name; of equal ratios the one that came first into the index.

    Where one of those that are one character apart is better than any other of the aliases' lengths can be, it is the best. Only
    the other names are compared with all that may reach ``least``."""
    names = written(names.select("name").where("name <> ''").distinct(), "fuzzy-names")
    known = written(aliases.select("alias", "merge_key", "first_seen"), "fuzzy-aliases")
    others = known.select(F.col("alias").alias("name"))
    scored = written(ratios(one_apart(names, others), least), "fuzzy-near")
    lengths = others.select(F.length("name").alias("l")).distinct().agg(F.collect_set("l").alias("lengths"))
    # Of the others at least two characters of the longer name don't match.
    bound = lambda n: 2 * F.least(F.length("name"), n, F.greatest(F.length("name"), n) - 2) / (F.length("name") + n)
    most = F.coalesce(F.array_max(F.transform("lengths", bound)), F.lit(0.0)) + 1e-9
    found = scored.groupBy("name").agg(F.max("ratio").alias("ratio"))
    open_ = names.join(found, "name", "left").crossJoin(F.broadcast(lengths)).where((most >= least) & (F.coalesce("ratio", F.lit(0.0)) <= most)).select("name")
    open_ = written(open_, "fuzzy-open")
    if not open_.isEmpty():
        scored = scored.unionByName(ratios(likely_pairs(open_, others, least), least))
    scored = scored.join(known.withColumnRenamed("alias", "_name"), "_name")
    best = scored.groupBy("name").agg(F.min_by("merge_key", F.struct(-F.col("ratio"), "first_seen", "_name")).alias("merge_key"), F.max("ratio").alias("ratio"))
    return best.select("name", "merge_key", "ratio")


def known_keys(aliases: DataFrame) -> DataFrame:
    """(merge_keys): one row, all keys in order, which is what a chooser may answer."""
    return aliases.agg(F.sort_array(F.collect_set("merge_key")).alias("merge_keys"))


def resolve_names(mentions: DataFrame, aliases: DataFrame, chooser: Callable[[DataFrame, DataFrame], DataFrame] | None = None, cap: float = 0.99) -> DataFrame:
    """mentions (article_id, entity_type, surface_text, extraction_confidence) with node_key, resolution_status, node_confidence.

    A resolved mention keeps its confidence, a provisional one is capped. chooser: (names, aliases) -> (name, merge_key), the
    pluggable model tier; answers that are no known key are ignored."""
    rows = mentions.withColumn("name", normal("surface_text")).where("name <> ''")
    names = rows.select("name").distinct()
    exact = names.join(aliases, names["name"] == aliases["alias"]).select("name", "merge_key")
    left = names.join(exact, "name", "left_anti")
    fuzzy = fuzzy_match(left, aliases).select("name", "merge_key")
    found = exact.unionByName(fuzzy)
    if chooser is not None:
        known = aliases.select("merge_key").distinct()
        found = found.unionByName(chooser(left.join(fuzzy, "name", "left_anti"), aliases).join(known, "merge_key", "left_semi").select("name", "merge_key"))
    j = rows.join(found, "name", "left")
    resolved = F.col("merge_key").isNotNull()
    j = j.withColumn("resolution_status", F.when(resolved, "resolved").otherwise("provisional")).withColumn("node_key", F.coalesce("merge_key", "name"))
    return j.withColumn("node_confidence", F.when(resolved, F.col("extraction_confidence")).otherwise(F.least("extraction_confidence", F.lit(cap)))).drop("merge_key", "name")


def first_provisional(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name): which of the names become entities if they come one by one and each that is like an earlier such one doesn't.

    names: (name, seq), the order; edges: (name, other), that name, if it comes after other, would be found like it. The answer is the
    lexicographically first maximal independent set, in rounds: a name without earlier neighbours that are undecided is decided.
    A round is two joins over what is left; of chance orders a few rounds decide all."""
    at = names.select(F.col("name").alias("other"), F.col("seq").alias("_s"))
    links = written(edges.join(names.select("name", "seq"), "name").join(at, "other").where("_s < seq").select("name", "other"), "provisional-links")
    open_, chosen = written(names.select("name").distinct(), "provisional-open"), None
    while open_.limit(1).count():
        waits = links.join(open_.select(F.col("name").alias("other")), "other", "left_semi").select("name").distinct()
        new = written(open_.join(waits, "name", "left_anti"), "provisional-new")
        old, links_left = links, links.join(new.select(F.col("name").alias("other")), "other", "left_semi").select("name").distinct()
        left = written(open_.join(new, "name", "left_anti").join(links_left, "name", "left_anti"), "provisional-open")
        links = written(old.join(left, "name", "left_semi"), "provisional-links")
        both = new if chosen is None else written(chosen.unionByName(new), "provisional-new")
        for df in (open_, old, *([] if chosen is None else [chosen, new])):
            remove(df)
        open_, chosen = left, both
    return names.select("name").limit(0) if chosen is None else chosen


def resolve_in_order(mentions: DataFrame, aliases: DataFrame, chooser: Callable[[DataFrame, DataFrame], DataFrame] | None = None, cap: float = 0.99, least: float = ACCEPT) -> DataFrame:
    """``resolve_names`` of mentions that come in order of ``seq``: a provisional entity is known to all mentions after the one that made it.

    So that one is provisional, later ones of its name are resolved to it, and a name that is like a known one or an earlier provisional one
    resolves to the likest at that time; of equals known ones come first, in the index's order, then provisional ones in theirs. ``seq`` tells
    mentions apart."""
    rows = mentions.withColumn("name", normal("surface_text")).where("name <> ''")
    names = written(rows.groupBy("name").agg(F.min("seq").alias("seq")), "ladder-names")
    exact = names.join(aliases, names["name"] == aliases["alias"]).select("name", "merge_key")
    other = names.join(exact, "name", "left_anti")
    known = written(_ratios(other, aliases, least).select("name", F.col("alias").alias("other"), "merge_key", "ratio", F.struct(F.lit(0).alias("late"), F.col("first_seen.seq").cast("long").alias("seq"), F.col("first_seen.pos").cast("long").alias("pos")).alias("at")), "ladder-known")
    left = other.join(known, "name", "left_anti")
    asked = None
    if chooser is not None:
        asked = written(chooser(left.select("name"), aliases).join(aliases.select("merge_key").distinct(), "merge_key", "left_semi").select("name", "merge_key"), "ladder-chosen")
    free = written(left if asked is None else left.join(asked, "name", "left_anti"), "ladder-free")
    among = written(ratios(likely_pairs(other, free, least).where("name <> _name"), least).withColumnRenamed("_name", "other"), "ladder-among")
    made = first_provisional(free, among.join(free.select("name"), "name", "left_semi").select("name", "other"))
    since = made.join(names, "name").select(F.col("name").alias("other"), F.col("seq").cast("long").alias("since"))
    late = among.join(since, "other").join(made, "name", "left_anti")
    late = late.select("name", "other", F.col("other").alias("merge_key"), "ratio", F.struct(F.lit(1).alias("late"), F.col("since").alias("seq"), F.lit(0).cast("long").alias("pos")).alias("at"), "since")
    # A name's likest entity is that of the time of each mention: entities that are alike to it and not to one another are few.
    every = known.withColumn("since", F.lit(None).cast("long")).unionByName(late)
    ordered = every.groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("r"), "at", "other", "merge_key", "since"))).alias("_likest"))
    rows = rows.join(ordered, "name", "left")
    then = F.filter("_likest", lambda x: x["since"].isNull() | (x["since"] < F.col("seq")))
    rows = rows.withColumn("_like", F.get(then, F.lit(0))["merge_key"]).drop("_likest")
    found = exact.withColumnRenamed("merge_key", "_exact")
    rows = rows.join(found, "name", "left")
    rows = rows.withColumn("_asked", F.lit(None).cast("string")) if asked is None else rows.join(asked.withColumnRenamed("merge_key", "_asked"), "name", "left")
    rows = rows.withColumn("merge_key", F.coalesce("_exact", "_like", "_asked")).drop("_exact", "_like", "_asked")
    own = made.join(names, "name").select("name", F.col("seq").alias("_first"))
    j = rows.join(own, "name", "left")
    makes = F.coalesce(F.col("seq") == F.col("_first"), F.lit(False))
    j = j.withColumns({"resolution_status": F.when(makes, "provisional").otherwise("resolved"), "node_key": F.coalesce("merge_key", "name")})
    return j.withColumn("node_confidence", F.when(makes, F.least("extraction_confidence", F.lit(cap))).otherwise(F.col("extraction_confidence"))).drop("merge_key", "name", "_first")


def resolve_all(mentions: DataFrame, aliases: DataFrame, techniques: DataFrame, chooser: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mentions of all kinds, each by its ladder; kinds that nothing resolves are skipped, rejected mentions stay without a node."""
    named = resolve_names(mentions.where(F.col("entity_type").isin("threat_actor", "malware_family")), aliases, chooser)
    known = resolve_known(mentions, techniques).withColumn("node_confidence", F.when(F.col("resolution_status") == "rejected", 0.0).otherwise(F.col("extraction_confidence")))
    return known.unionByName(named)


def mention_edges(resolved: DataFrame) -> DataFrame:
    """(article_id, entity_type, node_key, node_confidence) of mentions that have a node."""
    return resolved.where("resolution_status <> 'rejected' AND node_key <> ''").select("article_id", "entity_type", "node_key", "node_confidence").distinct()


def resolve_known(mentions: DataFrame, techniques: DataFrame) -> DataFrame:
    """CVE mentions resolve (a stub is made where needed), technique mentions must exist, indicators resolve by value and kind."""
    known = techniques.select(F.col("technique_id").alias("_t")).distinct()
    j = mentions.join(known, (F.col("entity_type") == "ttp") & (F.col("surface_text") == F.col("_t")), "left")
    kind = F.col("entity_type")
    value = F.when(F.col("ioc_type") == "url", F.col("surface_text")).otherwise(F.lower("surface_text"))
    node = F.when(kind == "ioc", tx.key(value, F.col("ioc_type"))).when((kind == "ttp") & F.col("_t").isNull(), "").otherwise(F.col("surface_text"))
    status = F.when((kind == "ttp") & F.col("_t").isNull(), "rejected").otherwise("resolved")
    return j.where(kind.isin("cve", "ttp", "ioc")).withColumn("node_key", node).withColumn("resolution_status", status).drop("_t")


def reconcile(provisional: DataFrame, canonical: DataFrame) -> DataFrame:
    """(label, merge_key, canonical_key, action): 'merge' where a provisional key is a name of a canonical entity of its label, else 'review', a row for each canonical entity that it is similar to.

    provisional: (label, merge_key); canonical: (label, merge_key, name, aliases), not provisional."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    index = canonical.select("label", "merge_key", F.explode(names).alias("raw")).where("raw IS NOT NULL").select("label", "merge_key", normal("raw").alias("alias"), F.lit(0).alias("first_seen")).where("alias <> ''").distinct()
    keys = provisional.select("label", "merge_key", normal("merge_key").alias("name"))
    to = index.select("label", F.col("alias").alias("name"), F.col("merge_key").alias("canonical_key"))
    exact = keys.join(to, ["label", "name"]).select("label", "merge_key", "canonical_key").distinct()
    near = _ratios(keys, index, REVIEW, ["label"]).select("label", "name", F.col("merge_key").alias("canonical_key")).distinct()
    review = keys.join(near, ["label", "name"]).select("label", "merge_key", "canonical_key").join(exact, ["label", "merge_key", "canonical_key"], "left_anti")
    return exact.withColumn("action", F.lit("merge")).unionByName(review.withColumn("action", F.lit("review")))


def merge_nodes(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with provisional nodes merged: they go, their names become aliases of the canonical node, their edges are re-pointed and parallel ones become one.

    nodes: (label, merge_key, name, aliases); merges: (label, merge_key, canonical_key), of several canonical keys of one node the least counts.
    edges: with labels see ``merge_labelled_edges``; without them (EDGE, confidence), and then keys that nodes of several labels have are left
    as they are, since it isn't known whose edges they are."""
    from loomwatch.operators.graph import merge_labelled_edges, remap_edges

    into = merges.groupBy("label", "merge_key").agg(F.min("canonical_key").alias("canonical_key"))
    named = nodes.join(into, ["label", "merge_key"]).select("label", F.col("canonical_key"), F.coalesce("name", "merge_key").alias("n"))
    more = named.groupBy("label", F.col("canonical_key").alias("merge_key")).agg(F.array_sort(F.collect_set("n")).alias("_more"))
    left = nodes.join(into, ["label", "merge_key"], "left_anti").join(more, ["label", "merge_key"], "left")
    none = F.array().cast("array<string>")
    aliases = F.concat(F.coalesce("aliases", none), F.array_except(F.coalesce("_more", none), F.coalesce("aliases", none)))
    left = left.select("label", "merge_key", "name", aliases.alias("aliases"))
    if "start_label" in edges.columns:
        return left, merge_labelled_edges(edges, into)
    owners = nodes.select("label", "merge_key").unionByName(into.select("label", "merge_key")).groupBy("merge_key").agg(F.count_distinct("label").alias("n"))
    mapping = into.join(owners.where("n = 1"), "merge_key").select(F.col("merge_key").alias("old_key"), F.col("canonical_key").alias("new_key"))
    return left, remap_edges(edges, mapping)
