"""Keyed state tables: what a batch reads and writes, and stories that grow by batches."""

from __future__ import annotations

import datetime as dt
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import stories
from loomwatch.streaming.story_state import Stories, cluster_messages
from loomwatch.streaming.tables import StateTable, nodes_table

KV = "k string, v long"


def files(df) -> set[str]:
    """The folders of the files that a table is read from."""
    return {f.rsplit("/", 1)[0].split("/data/")[1] for f in df.inputFiles()}


def rows(spark, *kv):
    return spark.createDataFrame(list(kv), KV)


def test_a_batch_reads_and_writes_its_buckets_only(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), KV, ["k"], buckets=8)
    assert t.read().collect() == [] and t.version() == -1
    every = [(f"k{i}", i) for i in range(100)]
    assert t.put(rows(spark, *every)) == list(range(8))
    key = rows(spark, ("k7", 0))
    (bucket,) = t.buckets_of(key)
    assert t.put(rows(spark, ("k7", -7))) == [bucket]
    assert sorted(p.name for p in (tmp_path / "t/data/v=1").iterdir() if p.is_dir()) == [f"_b={bucket}"]
    assert files(t.get(key)) == {f"v=1/_b={bucket}"}
    assert files(t.read()) == {f"v={1 if b == bucket else 0}/_b={b}" for b in range(8)}
    assert {r.k: r.v for r in t.get(key).collect()} == {"k7": -7}
    assert {r.k: r.v for r in t.read().collect()} == dict(every) | {"k7": -7}
    assert {r.k: r.v for r in t.read(version=0).collect()} == dict(every)  # what a reader began with stays


def test_deletes_repeats_and_failures(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), KV, ["k"], buckets=4)
    t.put(rows(spark, *[(f"k{i}", i) for i in range(20)], (None, 5)), number=3)
    assert t.read().count() == 20
    assert t.put(rows(spark, ("k1", 99)), number=3) == []  # committed already
    t.delete(rows(spark, ("k1", 0), ("none", 0)), number=4)
    assert {r.k for r in t.read().collect()} == {f"k{i}" for i in range(20)} - {"k1"}

    def fails(old, batch):
        return old.withColumn("v", F.raise_error(F.lit("broken")).cast("long"))

    with pytest.raises(Exception, match="broken"):
        t.apply(rows(spark, ("k2", 0)), fails, number=5)
    assert t.version() == 4 and t.read().count() == 19
    t.put(rows(spark, ("k2", 1), ("k2", 3), ("k2", 2)), number=5, seq="v")
    assert {r.v for r in t.get(rows(spark, ("k2", 0))).collect()} == {3}
    with pytest.raises(ValueError, match="doesn't touch"):
        t.apply(rows(spark, ("k2", 0)), lambda old, batch: rows(spark, *[(f"k{i}", 0) for i in range(20)]), number=6)
    t.delete(t.read().select("k"), number=6)  # the last row of a bucket goes too
    assert t.manifest() == {} and t.read().collect() == []
    t.apply(rows(spark), lambda old, batch: old, number=7)
    assert t.version() == 7


def test_old_versions_go(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), KV, ["k"], buckets=4)
    t.put(rows(spark, *[(f"k{i}", i) for i in range(40)]))
    for i in range(3):
        t.put(rows(spark, (f"k{i}", -i)))
    before = {r.k: r.v for r in t.read().collect()}
    t.clean(keep=1)
    assert {r.k: r.v for r in t.read().collect()} == before
    held = {(p.parent.name, p.name) for p in (tmp_path / "t/data").glob("v=*/_b=*")}
    assert held == {(f"v={v}", f"_b={b}") for b, v in t.manifest().items()}
    assert [p.name for p in (tmp_path / "t/manifests").glob("*.json")] == ["000000000003.json"]


def test_one_writer(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), KV, ["k"], buckets=2)

    def late(old, batch):
        StateTable(spark, t.path, KV, ["k"], buckets=2).put(rows(spark, ("x", 1)), number=0)
        return batch

    with pytest.raises(RuntimeError, match="another"):
        t.apply(rows(spark, ("y", 2)), late, number=0)


def test_nodes_by_a_stream(spark, tmp_path):
    schema = "k string, v string, seq long"
    for i, part in enumerate([[("a", "1", 0), ("b", "1", 1)], [("a", "2", 2), ("a", None, 3)], [("c", "5", 4)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    table, sink = nodes_table(spark, str(tmp_path / "t"), "k string, v string", ["k"], ["v"], buckets=4)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)

    run()
    assert {r.k: r.v for r in table.read().collect()} == {"a": "2", "b": "1", "c": "5"}
    spark.createDataFrame([("b", "9", 9)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p9")
    run()  # from where it ended
    assert {r.k: r.v for r in table.read().collect()} == {"a": "2", "b": "9", "c": "5"}
    assert table.version() == 3


DAY = dt.datetime(2024, 1, 1)
ROW = "article_id string, published_at timestamp, credibility_score double, entities array<struct<canonical_node_key: string, entity_type: string, resolution_status: string, node_confidence: double>>"


def article(i: int, r: random.Random):
    at = None if r.random() < 0.1 else DAY + dt.timedelta(hours=r.randrange(50))
    return (f"a{i:03d}", at, r.choice([None, 0.2, 0.9]), [(f"k{r.randrange(6)}", "cve", "resolved", r.randrange(10) / 10) for _ in range(r.randrange(3))])


def batches(seed: int, n: int = 4):
    r, out, have = random.Random(seed), [], 0
    for _ in range(n):
        new = [article(have + i, r) for i in range(r.randrange(6, 14))]
        have += len(new)
        links = [(f"a{r.randrange(have - len(new), have):03d}", f"a{r.randrange(have):03d}") for _ in range(r.randrange(7))]
        out.append((new, links))
    return out


def test_stories_equal_the_whole_table_s_clusters(spark, tmp_path):
    state = Stories(spark, str(tmp_path / "s"), buckets=16)
    known, seen, held = [], [], {}
    for number, (new, links) in enumerate(batches(21)):
        seen += new
        every, pairs = spark.createDataFrame(seen, ROW), spark.createDataFrame(links, "a string, b string")
        fresh = spark.createDataFrame(new, ROW)
        want = stories.assign_clusters(spark.createDataFrame(known, "article_id string, cluster_id string"), pairs, fresh.select("article_id"), every).collect()
        before = state.by_cluster.manifest()
        changes = state.apply(fresh, pairs, number)
        got = {(x.article_id, x.cluster_id, x.is_representative, x.cluster_size) for x in changes.collect()}
        assert got == {(x.article_id, x.cluster_id, x.is_representative, x.cluster_size) for x in want if x.changed}
        assert {x.article_id: x.cluster_id for x in state.clusters().collect()} == {x.article_id: x.cluster_id for x in want} == {x.article_id: x.cluster_id for x in state.by_article.read().collect()}
        # Buckets that hold no changed cluster, old or new, are as they were.
        touched = set(state.by_cluster.buckets_of(changes)) | set(state.by_cluster.buckets_of(changes.where("old_cluster_id IS NOT NULL").select(F.col("old_cluster_id").alias("cluster_id"))))
        after = state.by_cluster.manifest()
        assert {b: v for b, v in after.items() if b not in touched} == {b: v for b, v in before.items() if b not in touched}
        assert all(after[b] == number for b in touched & set(after))
        known = [(x.article_id, x.cluster_id) for x in want]
        held |= {x.key: json.loads(x.value) for x in cluster_messages(changes).collect()}
    assert len({c for _, c in known}) < len(known) - 8
    by = {}
    for a, c in known:
        by.setdefault(c, []).append(a)
    of = {a: es for a, _, _, es in seen}
    for c, ids in by.items():
        assert held[c]["article_ids"] == sorted(ids)
        best = {}
        for a in ids:
            for k, _, _, conf in of[a]:
                best[k] = max(best.get(k, 0), conf)
        assert [(e["canonical_node_key"], e["node_confidence"]) for e in held[c]["union_resolved_entities"]] == sorted(best.items())


def test_a_batch_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    (one, l1), (two, l2), *_ = batches(5)
    frames = lambda new, links: (spark.createDataFrame(new, ROW), spark.createDataFrame(links, "a string, b string"))
    whole, broken = Stories(spark, str(tmp_path / "w"), 8), Stories(spark, str(tmp_path / "b"), 8)
    for s in (whole, broken):
        s.apply(*frames(one, l1), 0)
    whole.apply(*frames(two, l2), 1)
    for name in ("by_cluster", "by_article"):
        with monkeypatch.context() as m:
            m.setattr(getattr(broken, name), "apply", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                broken.apply(*frames(two, l2), 1)
    sent = []
    sink = broken.sink(lambda batch, number: frames(two, l2)[1], lambda messages, number: sent.append(sorted(r.value for r in messages.collect())))
    for _ in range(2):
        sink(frames(two, l2)[0], 1)
    for s in ("by_article", "by_cluster"):
        a, b = (sorted(map(str, getattr(x, s).read().collect())) for x in (whole, broken))
        assert a == b
    assert sent[0] == sent[1] == sorted(r.value for r in cluster_messages(whole.changes(1)).collect())
    assert Path(f"{broken.path}/changes/v=1/_SUCCESS").exists()
    before = sorted(map(str, broken.clusters().collect()))
    broken.clean()
    assert sorted(map(str, broken.clusters().collect())) == before
    assert [p.name for p in Path(f"{broken.path}/changes").iterdir()] == ["v=1"]
