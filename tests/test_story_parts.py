"""Units of a frequent key meet in parts: the components are those of all pairs, and what leaves the tasks are rows of units, not of pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwatch.operators import meetings, stories, story_join
from loomwatch.operators.components import components
from tests.test_story_join import START, made_up


@pytest.mark.parametrize(("seed", "frequent"), [(7, 5), (8, 200)])
def test_same_components_in_parts(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(story_join, "FREQUENT", frequent)
    monkeypatch.setattr(story_join, "PART", 12)
    monkeypatch.setattr(story_join, "ROWS", 5)
    monkeypatch.setattr(meetings, "SMALL", 3)
    monkeypatch.setattr(meetings, "BLOCK", 10)
    e, a, h = made_up(spark, seed)
    scored = stories.pair_scores(stories.candidate_pairs(e, a, 72), e, a, h, 72).where(F.col("score") >= 0.6)
    assert {tuple(r) for r in components(story_join.story_links(e, a, h)).collect()} == {tuple(r) for r in components(scored).collect()}


def test_pairs_of_a_frequent_key_stay_in_the_tasks(spark, monkeypatch):
    """3,000 articles of one technique, each with one more entity: no join in Spark compares their 4.5 million pairs, and a row is a link that is needed."""
    r, n, seen = random.Random(2), 3000, {}
    monkeypatch.setattr(story_join, "PART", 700)

    def put(df, name, put=story_join.written):
        seen.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name)

    monkeypatch.setattr(story_join, "written", put)
    words = [r.getrandbits(64) for _ in range(30)]
    bits = [words[i % 30] ^ (1 << r.randrange(64)) for i in range(n)]  # thirty wordings, one bit from each other
    a = spark.createDataFrame([(i, START, f"t{i}") for i in range(n)], "article_id long, published_at timestamp, content_hash string")
    e = spark.createDataFrame([(i, *k) for i in range(n) for k in (("cve", f"c{i}"), ("ttp", "T1"))], "article_id long, entity_type string, node_key string")
    h = spark.createDataFrame([(i, b - (1 << 64) if b >= 1 << 63 else b) for i, b in enumerate(bits)], "article_id long, simhash long")
    links = story_join.story_links(e, a, h)
    got = dict(map(tuple, components(links).collect()))
    assert [got[i] for i in range(n)] == [i % 30 for i in range(n)]
    assert links.count() < 5 * n
    plan = seen["story-cross"][0] + seen["story-between"][0]
    assert plan.count("FlatMapGroupsInArrow") >= 2


def test_labels_of_joined_rows():
    label = np.array([0, 1, 2, 3, 4, 5])
    out = story_join._joined(story_join._joined(label, np.array([1, 4]), np.array([3, 5])), np.array([3, 3]), np.array([5, 1]))
    assert out.tolist() == [0, 1, 2, 1, 1, 1]
