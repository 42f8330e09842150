"""The best alias of a name, where all names are much alike."""

from __future__ import annotations

import difflib
import random

import pytest

from loomwatch.operators import resolve


def frames(spark, names, aliases):
    return spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(a, f"k{i}", (i, 0)) for i, a in enumerate(aliases)], "alias string, merge_key string, first_seen struct<seq:int,pos:int>")


@pytest.mark.parametrize("least", [0.6, 0.85])
def test_best_of_all_pairs(spark, least):
    r = random.Random(int(least * 100))
    word = lambda: "".join(r.choice("abc é") for _ in range(r.randrange(1, 14))).strip() or "a"
    names, aliases = sorted({word() for _ in range(120)}), sorted({word() for _ in range(90)})
    r.shuffle(aliases)
    got = {x.name: (x.merge_key, x.ratio) for x in resolve.fuzzy_match(*frames(spark, names, aliases), least).collect()}
    want = {}
    for n in names:
        best = min((-difflib.SequenceMatcher(None, n, a).ratio(), i) for i, a in enumerate(aliases))
        if -best[0] >= least:
            want[n] = (f"k{best[1]}", -best[0])
    assert got == want
    assert 10 < len(want)


def test_numbered_names_are_not_compared_with_all(spark, monkeypatch):
    """Each name is one letter from its alias and some letters from all others: only pairs of the former kind are looked at."""
    monkeypatch.setattr(resolve, "likely_pairs", lambda *_: pytest.fail("all were compared"))
    n = 2000
    names, aliases = frames(spark, [f"xupplier#{i:09}" for i in range(n)], [f"supplier#{i:09}" for i in range(n)])
    got = {x.name: x.merge_key for x in resolve.fuzzy_match(names, aliases).collect()}
    assert got == {f"xupplier#{i:09}": f"k{i}" for i in range(n)}
    assert resolve.one_apart(names, aliases.selectExpr("alias AS name")).count() == n


def test_keys_are_not_broadcast(spark):
    pairs = resolve.likely_pairs(*(spark.createDataFrame([(x,) for x in s], "name string") for s in (["fancy bear"], ["fancy baer"])), 0.85)
    assert pairs.count() == 1
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [_a" in plan
