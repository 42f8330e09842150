"""Nearest vectors in broadcast blocks and in dealt ones."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loomwatch.operators import nearest


def rows_of(seed: int) -> list[tuple]:
    r = random.Random(seed)
    out = [(i, [r.randrange(-3, 4) for _ in range(5)]) for i in range(90)]
    return out + [(200, [0] * 5), (201, None), *((300 + i, out[i][1]) for i in range(9)), *((7, [1, 2, 3, 4, 5]) for _ in range(40))]  # zero, null, equal ones, many rows of one id


@pytest.mark.parametrize(("few", "block", "rows_block"), [(0, 7, 11), (0, 1000, 13), (0, 9, 1000), (8, 200, 1), (100, 5, 1)])
def test_equals_all_pairs(spark, monkeypatch, few, block, rows_block):
    monkeypatch.setattr(nearest, "PART", 16)
    rows = rows_of(2)
    df = spark.createDataFrame([(i, e and [float(x) for x in e]) for i, e in rows], "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 3 = 0 OR vec_id = 201 OR vec_id = 200")
    got: dict[int, list] = {}
    for x in nearest.nearest(df, asked, 4, few=few, block=block, rows_block=rows_block).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.cosine))
    sound = [(i, np.array(e, dtype=float)) for i, e in rows if e and any(e)]
    for i, e in sound:
        if i % 3:
            continue
        pairs = sorted((-round(float(e @ f / np.sqrt((e @ e) * (f @ f))), 6), j) for j, f in sound if j != i)[:4]
        assert sorted(got[i]) == [(n + 1, j, -c) for n, (c, j) in enumerate(pairs)]
    assert set(got) == {i for i, _ in sound if i % 3 == 0}


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for few in (0, 8):
        assert nearest.nearest(df, some, 2, few=few).collect() == nearest.nearest(some, df, 2, few=few).collect() == nearest.nearest(some, some, 2, few=few).collect() == []
