"""Scores of the language model don't depend on its limits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwatch.llm import ngram_lm


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"p{k} q{k} r{k}" for k in r.sample(range(200), 30))) for i in range(60)]
    return spark.createDataFrame([*rows, (60, None), (61, "unheard of"), (62, "q5 r5 q5 r5")], "doc_id long, text string").repartition(3)


def scores(texts, **limits):
    found = ngram_lm.score_texts(texts, F.col("doc_id") % 5 != 0, "doc_id", settings=ngram_lm.Settings(**limits))
    return {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in found.collect()}


@pytest.mark.parametrize("hot", [0, 40])
def test_words_beyond_the_hot_ones_keep_their_pairs(texts, hot):
    want, got = scores(texts), scores(texts, hot_words=hot)
    assert got.keys() == want.keys()
    for i, row in got.items():
        assert row == pytest.approx(want[i], rel=1e-9), i


@pytest.mark.parametrize("hot", [1_000_000, 40, 0])
def test_pairs_beyond_the_filter_count(texts, hot, monkeypatch):
    want = scores(texts, bits_per_item=40)
    monkeypatch.setattr(ngram_lm, "WORDS_A_PART", 1000)
    monkeypatch.setattr(ngram_lm, "FLUSH", 500)
    for size in (0, 1500):
        got = scores(texts, bits_per_item=40, max_bytes=size, hot_words=hot)
        assert got.keys() == want.keys()
        for i, row in got.items():
            assert row == pytest.approx(want[i], rel=1e-9), (size, i)
