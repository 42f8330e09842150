"""Pairs of articles leave the join that they meet in once each, and nothing shuffles them."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import stories

START = dt.datetime(2024, 1, 1)


def made_up(spark, seed: int):
    """Articles of none to seven entities; some have two dates, or none."""
    r = random.Random(seed)
    times = {i: [START + dt.timedelta(hours=r.randrange(200)) for _ in range(r.choice([0, 1, 1, 1, 1, 2]))] or [None] for i in range(120)}
    keys = {i: {(r.choice(["cve", "ioc", "ttp", "threat_actor"]), f"k{r.randrange(12)}") for _ in range(r.randrange(8))} for i in times}
    e = spark.createDataFrame([(i, *k) for i, ks in keys.items() for k in ks] * 2, "article_id long, entity_type string, node_key string")
    a = spark.createDataFrame([(i, t, f"t{i % 50}") for i, ts in times.items() for t in ts], "article_id long, published_at timestamp, content_hash string")
    h = spark.createDataFrame([(i, r.getrandbits(64) - (1 << 63)) for i in times if i % 9], "article_id long, simhash long")
    block = {i: {k for k in ks if k[0] in stories.BLOCKING} for i, ks in keys.items()}
    near = lambda i, j: any(x and y and abs(x - y) <= dt.timedelta(hours=72) for x in times[i] for y in times[j])
    return e, a, h, sorted((i, j) for i in times for j in times if i < j and block[i] & block[j] and near(i, j))


@pytest.mark.parametrize("many", [100, 3])
def test_each_pair_once(spark, monkeypatch, many):
    monkeypatch.setattr(stories, "MANY", many)
    e, a, _, want = made_up(spark, many)
    assert sorted(map(tuple, stories.candidate_pairs(e, a, 72).collect())) == want
    assert len(want) > 300


@pytest.mark.parametrize("many", [100, 3])
def test_scores_where_they_meet(spark, monkeypatch, many):
    monkeypatch.setattr(stories, "MANY", many)
    e, a, h, _ = made_up(spark, many)
    want = sorted(map(tuple, stories.pair_scores(stories.candidate_pairs(e, a, 72), e, a, h, 72).collect()))
    assert sorted(map(tuple, stories.scored_pairs(e, a, h, 72).collect())) == want


def test_no_exchange_above_the_join(spark):
    e, a, h, _ = made_up(spark, 1)
    a = a.groupBy("article_id").agg(F.min("published_at").alias("published_at"), F.min("content_hash").alias("content_hash"))
    for df in (stories.candidate_pairs(e, a, 72), stories.scored_pairs(e, a, h, 72)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Join") == 1
