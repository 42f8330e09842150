"""Pairs that meet in packs, in parts of a key and in neighbouring spans are the same, and they come from few shuffled rows."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwatch.operators import meetings, stories

START = dt.datetime(2024, 1, 1)


def made_up(spark, n: int = 400):
    """Articles of one key that half of all have, and of others; ids are strings."""
    r = random.Random(1)
    times = {f"a{i:03}": START + dt.timedelta(hours=r.randrange(100)) for i in range(n)}
    keys = {i: ({("ttp", "hot")} if r.random() < 0.5 else set()) | {("cve", f"k{r.randrange(60)}") for _ in range(r.randrange(4))} for i in times}
    e = spark.createDataFrame([(i, *k) for i, ks in keys.items() for k in ks], "article_id string, entity_type string, node_key string")
    a = spark.createDataFrame([(i, t, f"t{r.randrange(90)}") for i, t in times.items()], "article_id string, published_at timestamp, content_hash string")
    h = spark.createDataFrame([(i, r.getrandbits(64) - (1 << 63)) for i in times if r.random() < 0.9], "article_id string, simhash long")
    want = sorted((i, j) for i in times for j in times if i < j and keys[i] & keys[j] and abs(times[i] - times[j]) <= dt.timedelta(hours=12))
    return e, a, h, want


@pytest.mark.parametrize(("part", "small", "block"), [(4096, 64, 1024), (7, 3, 5), (20, 0, 1024), (4096, 10_000, 16)])
def test_each_pair_once_however_it_is_cut(spark, monkeypatch, part, small, block):
    monkeypatch.setattr(meetings, "PART", part)
    monkeypatch.setattr(meetings, "SMALL", small)
    monkeypatch.setattr(meetings, "BLOCK", block)
    e, a, h, want = made_up(spark)
    got = stories.scored_pairs(e, a, h, 12).cache()
    assert sorted((r.a, r.b) for r in got.collect()) == want
    scores = stories.pair_scores(stories.candidate_pairs(e, a, 12), e, a, h, 12)
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, got.collect()))


def test_no_row_leaves_the_tasks_for_a_pair(spark):
    """Before, the JVM's join made a row of both sides for each pair; now pairs are made within blocks, and their scores at once."""
    e, a, h, want = made_up(spark)
    plan = stories.scored_pairs(e, a, h, 12)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("FlatMapGroupsInArrow")[0]
    assert "FlatMapGroupsInArrow" in plan


def test_common_members():
    r = random.Random(3)
    rows = [sorted({str(r.randrange(30)) for _ in range(r.randrange(12))}) for _ in range(60)]
    rows += [sorted({str(r.randrange(30)) for _ in range(60)}) for _ in range(30)]  # so alike that their counts are a product of matrices
    sets = meetings.Sets(pa.chunked_array([pa.array(rows, pa.list_(pa.string()))]))
    for a, b in ((np.arange(60), np.arange(60)), (np.arange(60, 90), np.arange(60, 90)), (np.array([3]), np.array([5, 70]))):
        got = sets.common(a, b)
        want = [[len(set(rows[i]) & set(rows[j])) for j in b] for i in a]
        assert (np.zeros((len(a), len(b)), dtype=int) if got is None else got).tolist() == want


def test_rounded_as_spark_does(spark):
    x = [0.123456785, 0.123456775, 0.5, 1.0, 0.3333333333, 0.000000005, 0.514931495, 0.29999999499999996, 0.299999995]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 8)).collect()]
    assert stories._rounded(np.array(x), 8).tolist() == want
    assert want[0] == float(Decimal("0.123456785").quantize(Decimal("1e-8"), ROUND_HALF_UP))
