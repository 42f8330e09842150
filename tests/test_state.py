"""Batches merged into a stored state, and the streams that do it."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import graph, stories
from loomwatch.settings import Settings
from loomwatch.streaming import polls

EVENT = "start_key string, rel_type string, end_key string, cluster_id string, contribution double, article_ids array<string>, ts long, seq long"
STATE = f"start_key string, rel_type string, end_key string, {graph.INFERRED}"


def event(cluster, contribution, ids, seq, end="b"):
    return ("a", "USES", end, cluster, contribution, ids, seq * 10, seq)


def test_stories_count_once_over_batches(spark):
    state = spark.createDataFrame([], STATE)
    batches = [[event("s1", 0.7, ["x", "y"], 1)], [event("s1", 0.9, ["z"], 2), event("s2", 0.7, ["y", "w"], 3), event("s2", 0.1, ["v"], 4)], [event("s3", 0.5, ["q"], 5, "c")]]
    for rows in batches:
        state = spark.createDataFrame(graph.merge_inferred(state, spark.createDataFrame(rows, EVENT)).collect(), STATE)
    got = {r.end_key: r for r in state.collect()}
    b = got["b"]
    assert b.inferred_confidence == pytest.approx(0.91) and b.contributing_story_cluster_ids == ["s1", "s2"]
    assert (b.source_article_ids, b.supporting_article_count, b.first_observed, b.last_confirmed) == (["x", "y", "w"], 3, 10, 40)
    assert (got["c"].inferred_confidence, got["c"].source_article_ids) == (0.5, ["q"])


def test_ids_beyond_the_cap_are_counted_only(spark):
    one = graph.merge_inferred(spark.createDataFrame([], STATE), spark.createDataFrame([event("s1", 0.5, [f"i{k}" for k in range(5)], 1)], EVENT), cap=3)
    one = spark.createDataFrame(one.collect(), STATE)
    two = graph.merge_inferred(one, spark.createDataFrame([event("s2", 0.5, ["i0", "i4"], 2)], EVENT), cap=3).first()
    assert one.first().source_article_ids == ["i0", "i1", "i2"] and one.first().supporting_article_count == 5
    assert two.source_article_ids == ["i0", "i1", "i2"] and two.supporting_article_count == 6  # i4 isn't in the list any more


def test_feeds_never_lower_a_stored_value(spark):
    schema = "start_key string, rel_type string, end_key string, source_id string, credibility_score double, ts long"
    one = graph.authoritative_edges(spark.createDataFrame([("a", "USES", "b", "f1", 0.8, 5)], schema))
    two = graph.merge_authoritative(one, spark.createDataFrame([("a", "USES", "b", "f2", 0.6, 9), ("a", "USES", "c", "f2", 0.6, 9)], schema))
    assert {r.end_key: (r.authoritative_confidence, r.feed_sources, r.first_observed, r.last_confirmed) for r in two.collect()} == {"b": (0.8, ["f1", "f2"], 5, 9), "c": (0.6, ["f2"], 9, 9)}


def test_create_and_match_properties(spark):
    edge = "start_key string, rel_type string, end_key string"
    old = spark.createDataFrame([("a", "R", "b", {"x": "1", "y": "1"})], f"{edge}, props map<string,string>")
    new = spark.createDataFrame([("a", "R", "b", {"c": "1"}, {"x": "2", "y": None}, 1), ("a", "R", "c", {"c": "1", "x": "0"}, {"x": "9"}, 2), ("a", "R", "c", {"c": "2"}, {"x": "3"}, 3), ("a", "R", "gone", {"c": "1"}, {}, 4)], f"{edge}, on_create map<string,string>, on_match map<string,string>, seq long")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_key string")
    got = {r.end_key: (r.props, r.created) for r in graph.merge_properties(old, new, nodes).collect()}
    assert got == {"b": ({"x": "2"}, False), "c": ({"c": "1", "x": "3"}, True)}


def test_an_article_without_mentions_loses_its_old_ones(spark):
    m = spark.createDataFrame([(1, "CVE", "c1"), (1, "ThreatActor", "t"), (2, "CVE", "c2"), (3, "CVE", "c3")], "article_id long, label string, node_key string")
    current = m.where("article_id = 2")
    left = graph.retract_stale(m, current, ["CVE", "TTP", "IOC"], spark.createDataFrame([(1,), (2,)], "article_id long"))
    assert sorted(map(tuple, left.collect())) == [(1, "ThreatActor", "t"), (2, "CVE", "c2"), (3, "CVE", "c3")]


ROW = "cve_id string, score string, cwe_ids array<string>, last_modified string"


def test_deltas_are_applied_in_order(spark):
    old = spark.createDataFrame([("A", "1", ["w0"], "2024-01-02"), ("B", None, [], None)], ROW)
    new = spark.createDataFrame([("A", "2", ["w1"], "2024-01-01", 1), ("A", None, ["w2"], "2024-01-05", 2), ("A", "3", ["w3"], "2024-01-04", 3), ("A", "4", ["w4"], None, 4), ("B", "5", ["w5"], None, 5), ("C", "6", ["w6"], "2024-01-01", 6)], f"{ROW}, seq long")
    outcomes, state = graph.apply_deltas(old, new, "cve_id", ["score"], "cwe_ids")
    assert [r.outcome for r in sorted(outcomes.collect(), key=lambda r: r.seq)] == ["stale", "resynced", "stale", "stale", "resynced", "absent"]
    assert {r.cve_id: tuple(r)[1:] for r in state.collect()} == {"A": ("4", ["w2"], "2024-01-05"), "B": ("5", ["w5"], None)}
    outcomes, state = graph.apply_deltas(old, new, "cve_id", ["score"], "cwe_ids", create=True)
    assert {r.cve_id: tuple(r)[1:] for r in state.collect()}["C"] == ("6", ["w6"], "2024-01-01")
    assert {r.outcome: r.n for r in graph.outcome_counts(outcomes).collect()} == {"stale": 3, "resynced": 3}


def test_windows_begin_where_the_last_good_poll_ended(spark):
    hour = 3_600_000_000
    polled = spark.createDataFrame([("n", 1, 100 * hour, False), ("n", 2, 101 * hour, True), ("n", 3, 102 * hour, False), ("n", 4, 103 * hour, True), ("m", 1, 50 * hour, True)], "source_id string, seq long, started_at long, ok boolean")
    w = graph.poll_windows(polled, spark.createDataFrame([("m", 49 * hour)], "source_id string, last_success_at long"))
    got = {(r.source_id, r.seq): r.window_start // hour for r in w.collect()}
    assert got == {("n", 1): 76, ("n", 2): 77, ("n", 3): 101, ("n", 4): 101, ("m", 1): 49}
    assert {r.source_id: r.last_success_at // hour for r in graph.poll_marks(w).collect()} == {"n": 103, "m": 50}


def test_sources_that_leave_the_list_become_inactive(spark):
    config = spark.createDataFrame([("a", "A"), ("b", "B"), ("d", "D")], "source_id string, name string")
    nodes = spark.createDataFrame([("a", "A", True), ("b", "old", True), ("c", "C", True), ("d", "D", False), ("e", "E", False)], "source_id string, name string, is_active boolean")
    got = {r.source_id: (r.name, r.is_active, r.change) for r in graph.sync_source_nodes(config, nodes, "source_id", ["name"]).collect()}
    assert got == {"a": ("A", True, "same"), "b": ("B", True, "updated"), "c": ("C", False, "deactivated"), "d": ("D", True, "updated"), "e": ("E", False, "same")}


def test_keys_are_unique(spark):
    nodes = spark.createDataFrame([("c1",), ("c1",), ("c2",), (None,), (None,)], "cve_id string")
    assert [tuple(r) for r in graph.key_violations(nodes, "CVE").collect()] == [("CVE", "c1", 2)]


DAY = dt.datetime(2024, 1, 1)


def test_the_older_cluster_survives_a_bridge(spark):
    articles = spark.createDataFrame([(1, DAY + dt.timedelta(hours=9), 0.5), (2, None, 0.9), (3, DAY + dt.timedelta(hours=2), 0.5), (4, DAY, 0.5), (5, DAY + dt.timedelta(hours=1), None), (6, DAY, None), (7, DAY, 0.1)], "article_id long, published_at timestamp, credibility_score double")
    known = spark.createDataFrame([(1, "zz"), (2, "zz"), (3, "yy"), (6, "aa")], "article_id long, cluster_id string")
    new = spark.createDataFrame([(4,), (5,), (7,)], "article_id long")
    links = spark.createDataFrame([(5, 2), (5, 3)], "a long, b long")
    got = {r.article_id: r for r in stories.assign_clusters(known, links, new, articles).collect()}
    assert {got[i].cluster_id for i in (1, 2, 3, 5)} == {"yy"} and got[6].cluster_id == "aa"
    assert [i for i in got if got[i].is_representative and got[i].cluster_id == "yy"] == [5] and got[5].cluster_size == 4
    assert {i for i in got if got[i].changed} == {1, 2, 3, 4, 5, 7} and got[4].cluster_id != got[7].cluster_id
    again = stories.assign_clusters(spark.createDataFrame([(r.article_id, r.cluster_id) for r in got.values()], "article_id long, cluster_id string"), links, new, articles).collect()
    assert {r.article_id: r.cluster_id for r in again} == {i: r.cluster_id for i, r in got.items()} and not any(r.changed for r in again)


def test_cluster_and_version_sinks(spark, tmp_path):
    articles = spark.createDataFrame([(i, DAY, 0.5) for i in range(1, 5)], "article_id long, published_at timestamp, credibility_score double")
    links = {0: [(1, 2)], 1: [(2, 3)]}
    write = polls.cluster_sink(str(tmp_path / "c"), articles, lambda batch, number: spark.createDataFrame(links[number], "a long, b long"))
    for number, ids in ((0, [1, 2]), (1, [3, 4]), (1, [3, 4])):
        write(spark.createDataFrame([(i,) for i in ids], "article_id long"), number)
    got = {r.article_id: r.cluster_id for r in spark.read.parquet(str(tmp_path / "c/v=1")).collect()}
    assert got[1] == got[2] == got[3] != got[4]
    applied = []
    sink = polls.version_sink(str(tmp_path / "v"), lambda rows: applied.append(sorted(r.domain for r in rows.collect())))
    for number, version in ((0, "9.0"), (1, "9.0"), (2, "10.0")):
        sink(spark.createDataFrame([("e", version, 1), ("m", "1.0", 1)], "domain string, version string, x long"), number)
    assert applied == [["e", "m"], [], ["e"]]


def test_messages(spark):
    articles = spark.createDataFrame([("s::g", "s", "g", "text", "t", None)], "source_guid_key string, source_id string, guid string, cleaned_text string, title string, published_at string")
    message = polls.announce_articles(articles)
    assert json.loads(message.first().value) == {"node_label": "Article", "article_id": "s::g", "source_id": "s", "guid": "g", "cleaned_text": "text", "title": "t", "published_at": None}
    edges = spark.createDataFrame([("a", "USES", "b", "created")], "start_key string, rel_type string, end_key string, outcome string")
    assert json.loads(polls.announce_edges(edges).first().value) == {"rel_type": "USES", "start_key": "a", "end_key": "b", "outcome": "created", "origin": None}
    every = message.unionByName(spark.createDataFrame([("{broken",), ('{"article_id": "x"}',), (None,)], "value string"))
    good, bad = polls.decoded(every, polls.ARTICLE, ["node_label", "article_id"])
    assert [r.article_id for r in good.collect()] == ["s::g"]
    assert sorted((r.value or "", r.reason) for r in bad.collect()) == [("", "no message"), ('{"article_id": "x"}', "lacks node_label"), ("{broken", "no message")]
    a, others = polls.articles_only(every.unionByName(polls.announce_edges(edges)))
    assert a.count() == 1 and others.count() == 4


def test_health_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i, i % 5 != 0 and i < 20) for i in range(40)]
    schema = "source_id string, seq long, ok boolean"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = {}

    def keep(batch, _):
        out.update({r.source_id: (r.consecutive_failures, r.last_success, r.alert) for r in batch.collect()})

    q = polls.health(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "k")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert out == {r.source_id: (r.consecutive_failures, r.last_success, r.alert) for r in graph.poll_health(df).collect()}


def test_settings():
    assert Settings.of({"dedup_threshold": "0.7", "benign_domains": "a.org, b.org"}) == Settings(dedup_threshold=0.7, benign_domains=("a.org", "b.org"))
    with pytest.raises(ValueError, match="no such"):
        Settings.of({"x": 1})


def test_entities_of_articles(spark):
    m = spark.createDataFrame([(1, "cve", "c"), (1, "cve", "c"), (1, "ttp", "")], "article_id long, entity_type string, node_key string")
    assert [tuple(r) for r in stories.article_entities(m).collect()] == [(1, "cve", "c")]
    assert m.where(F.col("node_key") == "").count() == 1
