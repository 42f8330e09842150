"""Modification payloads folded into stored rows."""

import random

from loomwatch.operators import graph
from loomwatch.plans import state as plans
from pyspark.sql import functions as F

ROW = "cve_id string, score string, cwe_ids array<string>, last_modified string"


def fold(old, new, create):
    """The plain rule, payload by payload; times here are ISO dates, so that their texts have their order."""
    state, counts = {r[0]: r[1:] for r in old}, {}
    for k, score, items, at, _ in sorted(new, key=lambda r: r[4]):
        n = counts.setdefault(k, dict.fromkeys(graph.OUTCOMES, 0))
        if k not in state and not create:
            n["absent"] += 1
            continue
        s, i, t = state.get(k, (None, None, None))
        seen = counts[k].setdefault("seen", t)
        newer = seen is None or at is not None and at > seen
        n["resynced" if newer else "stale"] += 1
        n["seen"] = max(filter(None, (seen, at)), default=None)
        state[k] = (s if score is None else score, items if newer else i, at if newer and at is not None else t)
    return state, {k: tuple(n[x] for x in graph.OUTCOMES) for k, n in counts.items()}


def test_one_pass_is_the_fold_of_each_payload(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 20)
    rng = random.Random(5)
    at = lambda: rng.choice([None, *[f"2024-01-{d:02}" for d in range(1, 15)]])
    old = [(f"k{i}", rng.choice([None, "s"]), rng.choice([None, [], ["w"]]), at()) for i in range(0, 40, 2)]
    new = [(f"k{rng.randrange(40)}", rng.choice([None, str(i)]), rng.choice([None, [], [str(i)]]), at(), i) for i in range(300)]
    a, b = spark.createDataFrame(old, ROW), spark.createDataFrame(new, f"{ROW}, seq long")
    for create in (False, True):
        state, counts = fold(old, new, create)
        got = graph.fold_deltas(a, b, "cve_id", ["score"], "cwe_ids", create).collect()
        assert {r.cve_id: (r.score, r.cwe_ids, r.last_modified) for r in got if r.known} == state
        assert {r.cve_id: (r.absent, r.resynced, r.stale) for r in got if r.absent + r.resynced + r.stale} == counts
        assert all(r.score is r.cwe_ids is r.last_modified is None for r in got if not r.known)
        assert {r.cve_id: tuple(r)[1:] for r in graph.apply_deltas(a, b, "cve_id", ["score"], "cwe_ids", create)[1].collect()} == state


def test_rows_without_a_key_meet_nobody(spark):
    old = spark.createDataFrame([(None, "1", ["a"], "2024-01-01"), (None, "2", ["b"], None), ("A", "3", ["c"], None)], ROW)
    new = spark.createDataFrame([(None, "4", ["d"], "2024-01-02", 1)], f"{ROW}, seq long")
    outcomes, state = graph.apply_deltas(old, new, "cve_id", ["score"], "cwe_ids")
    assert [r.outcome for r in outcomes.collect()] == ["absent"]
    assert sorted(r.score for r in state.collect()) == ["1", "2", "3"]
    outcomes, state = graph.apply_deltas(old, new, "cve_id", ["score"], "cwe_ids", create=True)
    assert [r.outcome for r in outcomes.collect()] == ["resynced"]
    assert sorted(r.score for r in state.collect()) == ["1", "2", "3", "4"]


def test_tasks_grow_in_number_not_in_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    old = spark.range(1000).select(F.col("id").cast("string").alias("cve_id"), F.lit("s").alias("score"), F.array().cast("array<string>").alias("cwe_ids"), F.lit("2024-01-01").alias("last_modified"))
    new = old.withColumn("seq", F.col("cve_id").cast("long"))
    for df in graph.apply_deltas(old, new, "cve_id", ["score"], "cwe_ids"):
        n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(n) == 20 and sum(n) == 1000 and max(n) < 100


def test_stored_and_incoming_rows_are_sorted_once(spark):
    plan = plans.freshness_fold(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 1 and "Join" not in plan
