"""Resampling against its formulas, word by word."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from loomwatch.llm import resample

R = random.Random(8)
WORDS = [f"w{i}" for i in range(60)] + ["ünï", "日本", "Big", "x1y"]
DOCS = [None, "", "...", "one two", "Été-ÉTÉ"] + [" ".join(R.choice(WORDS) + R.choice(["", ",", "."]) for _ in range(R.choice([3, 19, 20, 21, 90]))) for _ in range(120)]
ROWS = [(i, t, "a") for i, t in enumerate(DOCS)] + [(9, DOCS[9], "again"), (9, DOCS[9], "again"), (10, DOCS[40], "other"), (None, DOCS[50], "no id")]
ITEMS = [None, "", *(" ".join(R.choice(WORDS[:9]) for _ in range(40)) for _ in range(5))]


def features(text: str | None, longest: int) -> list[str]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(rows: list[tuple], items: list, longest: int, buckets: int, share: int = 10) -> tuple[list[tuple], list[tuple]]:
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in xs for f in features(x, longest)) for xs in ([r[1] for r in rows], items))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text, *_ in rows:
        f = features(text, longest)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score, score is not None and len(features(text, 1)) >= 20))
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    return [r[:4] for r in out], [r[:4] for r in drawn[: share * len(drawn) // 100]]


def compare(got: list, want: tuple[list, list]) -> None:
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want[0], key=key)
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, len(drawn) + 1))
    assert [tuple(r)[:4] for r in drawn] == want[1]


@pytest.mark.parametrize(("longest", "buckets", "nodes"), [(1, 10_000, 1 << 20), (3, 500, 1 << 20), (2, 7, 1)])
def test_equals_the_formulas(spark, monkeypatch, longest, buckets, nodes):
    monkeypatch.setattr(resample, "NODES", nodes)  # tasks of a local session are forked later, with this value
    docs = spark.createDataFrame(ROWS, "`a.id` long, text string, weight string").repartition(5)
    items = spark.createDataFrame([(t,) for t in ITEMS], "body string")
    got = resample.resample(docs, items, id_col="a.id", target_text_col="body", longest=longest, buckets=buckets, share=30)
    assert got.columns == ["a.id", "n_features", "weight", "score", "rank"]
    compare(got.collect(), plain(ROWS, ITEMS, longest, buckets, 30))


def test_tries_sum_the_same_however_often_they_are_begun(monkeypatch):
    import pyarrow as pa

    totals = []
    for nodes in (1, 50, 1 << 20):
        monkeypatch.setattr(resample, "NODES", nodes)
        trie = resample.Trie(2, 100)
        for a in range(0, len(DOCS), 10):
            trie.add(pa.array(DOCS[a : a + 10], pa.string()))
        trie.merge()
        totals.append(trie.totals.tolist())
    want = Counter(zlib.crc32(f.encode()) % 100 for t in DOCS for f in features(t, 2))
    assert totals == [[want[b] for b in range(100)]] * 3


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, x string")
    items = spark.createDataFrame([(t,) for t in ITEMS], "text string")
    compare(resample.resample(docs, items.limit(0)).collect(), plain(ROWS, [], 1, 10_000))
    assert resample.resample(docs.limit(0), items).collect() == []


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    texts = [*DOCS, " ".join(WORDS * 2000)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in ITEMS], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = resample.op13_resample(spark, str(tmp_path)).collect()
    compare(got, plain([(i, t) for i, t in enumerate(texts)], ITEMS, 1, 10_000))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(str, c.sql(resample.SQL["op13_resample"]).fetchall())) == sorted(str(tuple(r)) for r in got)
