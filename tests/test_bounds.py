"""Queries read whole texts, and no group is gathered into one row."""

from __future__ import annotations

import random

from loomwatch.operators import graph, nearest
from loomwatch.plans import inputs, texts


def plan(df):
    return df._jdf.queryExecution().toString()


def test_first_ids_are_not_gathered_whole(spark):
    r = random.Random(2)
    rows = [(r.choice(["k", "l", None]), r.randrange(200), [f"a{r.randrange(30)}" for _ in range(r.randrange(4))]) for _ in range(300)] + [("empty", 1, [])]
    got = graph.capped_ids(spark.createDataFrame(rows, "k string, seq long, article_ids array<string>").repartition(4), ["k"], cap=5)
    want = {}
    for k, _, ids in sorted(rows, key=lambda x: (x[1], x[2])):
        have, n = want.get(k, ([], 0))
        new = [x for x in dict.fromkeys(ids) if x not in have]
        want[k] = ((have + new)[:5], n + len(new))
    assert {x.k: (x.source_article_ids, x.supporting_article_count) for x in got.collect()} == want
    assert "WindowGroupLimit" in plan(got)


def test_nearest_are_not_gathered_whole(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(60)]
    monkeypatch.setattr(inputs, "table", lambda *_: spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = texts.embedding_topk(spark, "")
    assert "collect_list" not in plan(got) and "WindowGroupLimit" in plan(got)
    assert got.count() == 10  # of ids 0 and 50
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    wide = [*rows, (60, [0.0] * 4), (61, None), *((100 + i, rows[i][1]) for i in range(8))]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<float>").repartition(5)
    found = {}
    for x in nearest.nearest(df, df, 3, block=20).collect():
        found.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    import numpy as np

    kept = {i: np.float32(e).astype(float) for i, e in wide if e and any(e)}
    for i, e in kept.items():
        best = sorted((-round(float(dot(e, f) / (dot(e, e) * dot(f, f)) ** 0.5), 6), j) for j, f in kept.items() if j != i)
        assert sorted(found[i]) == [(r + 1, j) for r, (_, j) in enumerate(best[:3])], i
    assert set(found) == set(kept)


def test_indicators_are_found_in_the_whole_text(spark, monkeypatch):
    body = "CVE-2021-12345 by T1234 from hxxps://a[.]b/c and 198.51[.]100.7 " + "word " * 100
    monkeypatch.setattr(inputs, "table", lambda *_: spark.createDataFrame([(1, body), (2, "none")], "doc_id long, text string"))
    monkeypatch.setattr(texts, "SUFFIX", "text")
    got = {r.doc_id: tuple(r)[1:] for r in texts.refang_cve_ttp(spark, "").collect()}
    assert got == {1: ("CVE-2021-12345", "T1234", "https://a.b/c", "198.51.100.7"), 2: ("",) * 4}
