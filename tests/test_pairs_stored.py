"""All pairs of a frequent key are stored in little: rows of one article stand together, with the same articles beside them from one to the next."""

from __future__ import annotations

import datetime as dt

from loomwatch.operators import stories

START = dt.datetime(2024, 1, 1)


def test_bytes_a_pair(spark, tmp_path):
    n = 6000
    a = spark.createDataFrame([(i * 50, START + dt.timedelta(hours=i * 50 % 48)) for i in range(n)], "article_id long, published_at timestamp")
    e = spark.createDataFrame([(i * 50, "ttp", "T1") for i in range(n)], "article_id long, entity_type string, node_key string")
    stories.candidate_pairs(e, a, 12).write.parquet(out := str(tmp_path / "pairs"))
    pairs = spark.read.parquet(out).count()
    size = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet"))
    print(pairs, size, size / pairs)
    assert pairs > 7_000_000
    assert size < 0.4 * pairs
