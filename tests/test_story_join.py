"""The bounded story join links what all candidate pairs over the threshold link."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import stories, story_join
from loomwatch.operators.components import components

START = dt.datetime(2024, 1, 1)


def made_up(spark, seed: int, n: int = 260, hot: float = 0.4):
    """Articles with copies, near copies, a frequent key, few or many entities, gaps of all sizes, and missing dates, words and entities."""
    r = random.Random(seed)
    articles, entities, hashes = [], [], []
    for i in range(n):
        if i > 5 and r.random() < 0.5:  # like an earlier one in some ways
            j = r.randrange(i)
            keys, bits, text = [k for a, *k in entities if a == j], next((h for a, h in hashes if a == j), None), articles[j][2]
            at = articles[j][1] and articles[j][1] + dt.timedelta(hours=r.choice([0, 0.5, 2, 20, 35.9, 36, 50, 71.9, 72, 73]))
            if r.random() < 0.5:
                keys, text = keys + [["ttp", f"T{r.randrange(9)}"]], f"text {i}"
            if bits is not None and r.random() < 0.6:
                bits &= (1 << 64) - 1
                for b in r.sample(range(64), r.choice([1, 3, 6, 14, 22])):
                    bits ^= 1 << b
                bits = bits - (1 << 64) if bits >= 1 << 63 else bits
        else:
            keys = [[r.choice(["cve", "ioc", "threat_actor", "ttp"]), f"k{r.randrange(40)}"] for _ in range(r.choice([0, 1, 1, 2, 3, 6, 12]))]
            bits, text, at = r.getrandbits(64) - (1 << 63), f"text {i}", START + dt.timedelta(minutes=r.randrange(60 * 24 * 9))
            bits, at = None if r.random() < 0.1 else bits, None if r.random() < 0.05 else at
        if r.random() < hot:
            keys = [*keys, ["ttp", "hot"]]
        articles.append((i, at, r.choice([text, text, ""])))
        entities += [(i, *k) for k in keys]
        hashes += [(i, bits)] if bits is not None else []
    return spark.createDataFrame(entities, "article_id long, entity_type string, node_key string"), spark.createDataFrame(articles, "article_id long, published_at timestamp, content_hash string"), spark.createDataFrame(hashes, "article_id long, simhash long")


@pytest.mark.parametrize(("seed", "frequent", "threshold"), [(1, 200, 0.6), (2, 3, 0.6), (3, 10, 0.65), (4, 3, 0.5)])
def test_same_components_as_all_pairs(spark, monkeypatch, seed, frequent, threshold):
    monkeypatch.setattr(story_join, "FREQUENT", frequent)
    e, a, h = made_up(spark, seed)
    pairs = stories.candidate_pairs(e, a, 72)
    scored = stories.pair_scores(pairs, e, a, h, 72).where(F.col("score") >= threshold)
    want = {tuple(r) for r in components(scored).collect()}
    got = {tuple(r) for r in components(story_join.story_links(e, a, h, 72, threshold)).collect()}
    assert got == want
    assert len(want) > 60
    assert len({c for _, c in want}) > 3


def test_edge_cases(spark):
    e, a, h = made_up(spark, 5)
    for x, y, z in ((e.limit(0), a, h), (e, a.limit(0), h), (e.limit(0), a.limit(0), h.limit(0))):
        assert story_join.story_links(x, y, z).collect() == []
    twice = story_join.story_links(e.unionByName(e), a, h)
    assert {tuple(r) for r in components(twice).collect()} == {tuple(r) for r in components(story_join.story_links(e, a, h)).collect()}
    with pytest.raises(ValueError, match="too high"):
        story_join.story_links(e, a, h, threshold=0.9)


def test_a_key_of_a_third_of_all_articles(spark):
    """What meets by a key that a third of 3,000 articles have, at five entities each, is a small part of its pairs; exact copies add a row a cell."""
    r = random.Random(6)
    n, hot = 3000, 1000
    articles = [(i, START + dt.timedelta(minutes=i), f"t{i}") for i in range(n)]
    entities = [(i, "cve", f"{i}-{k}") for i in range(n) for k in range(4)] + [(i, "ttp", "hot") for i in range(hot)]
    copies = [(n + i, START + dt.timedelta(minutes=i), "t0") for i in range(2000)]
    entities += [(n + i, *k) for i in range(2000) for k in (*[("cve", f"0-{k}") for k in range(4)], ("ttp", "hot"))]
    bits = [r.getrandbits(64) - (1 << 63) for _ in range(n)]
    e = spark.createDataFrame(entities, "article_id long, entity_type string, node_key string")
    a = spark.createDataFrame(articles + copies, "article_id long, published_at timestamp, content_hash string")
    h = spark.createDataFrame([(i, x) for i, x in enumerate(bits)] + [(n + i, bits[0]) for i in range(2000)], "article_id long, simhash long")
    units = story_join._units(story_join.profiles(e, a, h, 72)).cache()
    assert units.count() < n + 30
    met = Counter((x.key, x.token) for x in story_join._emitted(units, 0.6).collect())
    assert sum(c * (c - 1) // 2 for c in met.values()) < hot * hot / 2 / 20
    links = story_join.story_links(e, a, h)
    assert links.count() < n + 3000
    assert components(links).where("component = 0").count() == 2001
