"""What the story join writes doesn't grow with the square of a frequent key's articles."""

from __future__ import annotations

import datetime as dt
import random

from loomwatch.operators import story_join
from loomwatch.operators.components import components

START = dt.datetime(2024, 1, 1)


def test_links_of_a_frequent_pair_of_keys(spark, monkeypatch):
    """600 articles of one technique and one actor, with an entity each of its own: nearly all pairs link."""
    r, n, sizes = random.Random(1), 600, {}
    monkeypatch.setattr(story_join, "written", lambda df, name, put=story_join.written: sizes.setdefault(name, put(df, name)))
    a = spark.createDataFrame([(i, START + dt.timedelta(minutes=i), f"t{i}") for i in range(n)], "article_id long, published_at timestamp, content_hash string")
    e = spark.createDataFrame([(i, *k) for i in range(n) for k in (("cve", f"c{i}"), ("ttp", "T1"), ("ioc", "x"))], "article_id long, entity_type string, node_key string")
    h = spark.createDataFrame([(i, r.getrandbits(64) & ((1 << 20) - 1)) for i in range(n)], "article_id long, simhash long")
    counts = {}
    monkeypatch.setattr(story_join, "remove", lambda df: counts.update({name: d.count() for name, d in sizes.items() if d is df}))
    links = story_join.story_links(e, a, h)
    assert components(links).where("component = 0").count() == n
    assert counts["story-cross"] < n
    assert links.count() < 64 * n
