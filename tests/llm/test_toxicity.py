"""The factorization machine's score and gradient against their definition."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwatch.llm import toxicity


def machine(d=6, k=3, seed=1):
    r = np.random.default_rng(seed)
    return toxicity.Machine(np.arange(d), 0.3, r.normal(size=d), r.normal(size=(d, k)))


def brute(m, row):
    z = m.w0 + sum(m.w[i] for i in row) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(row, 2))
    return 1 / (1 + math.exp(-z))


ROWS = [[], [0], [1, 4], [0, 1, 2, 3, 4, 5], [2, 5], [2, 5]]


def test_score_is_the_machine_of_order_two():
    m = machine()
    doc = np.repeat(np.arange(len(ROWS)), [len(r) for r in ROWS])
    got = m.score(doc, np.array([x for r in ROWS for x in r]), len(ROWS))
    assert got.tolist() == pytest.approx([brute(m, r) for r in ROWS], rel=1e-12)


def test_gradient_is_that_of_the_mean_loss():
    m, y = machine(), np.array([0.0, 1.0, 1.0, 0.0, 1.0, 0.0])

    def loss(p, w0):
        q = toxicity.Machine(m.terms, w0, p[:, 0], p[:, 1:])
        return -sum(math.log(brute(q, r) if t else 1 - brute(q, r)) for r, t in zip(ROWS, y, strict=True)) / len(y)

    p = np.column_stack([m.w, m.v])
    g, g0 = toxicity.gradient(p, m.w0, [np.array(r, dtype=np.int64) for r in ROWS], y)
    step = 1e-6
    for i, j in itertools.product(range(p.shape[0]), range(p.shape[1])):
        q = p.copy()
        q[i, j] += step
        assert g[i, j] == pytest.approx((loss(q, m.w0) - loss(p, m.w0)) / step, abs=1e-4)
    assert g0 == pytest.approx((loss(p, m.w0 + step) - loss(p, m.w0)) / step, abs=1e-4)


def test_terms_are_words_and_their_beginnings():
    doc, term, n = toxicity._terms(pa.array(["Abcdef abcdeg", None, "abcdef", ""]))
    sets = [set(term[doc == i].tolist()) for i in range(n)]
    assert len(sets[0]) == 4 and len(sets[2]) == 3 and sets[2] < sets[0] and not sets[1] | sets[3]


def test_chosen_terms_follow_the_likelihood_ratio(spark):
    texts = [(f"bad thing{i % 3}", 1) for i in range(30)] + [(f"good thing{i % 3}", 0) for i in range(60)] + [("bad", 0)]
    rows = spark.createDataFrame(texts, "_text string, _label int").repartition(3)
    s = toxicity.Settings()
    chosen = set(toxicity._choose(toxicity._counts(rows), 30, 61, s).tolist())
    doc, term, _ = toxicity._terms(pa.array([t for t, _ in texts]))
    y, want = np.array([y for _, y in texts]), set()
    for t in set(term.tolist()):
        with_ = y[doc[term == t]]
        cells = {(1, 1): int(with_.sum()), (1, 0): int((1 - with_).sum())}
        cells |= {(0, 1): 30 - cells[1, 1], (0, 0): 61 - cells[1, 0]}
        g = 2 * sum(n * math.log(n * 91 / ((cells[h, 0] + cells[h, 1]) * (30 if c else 61))) for (h, c), n in cells.items() if n)
        if g >= s.least_ratio and cells[1, 0] + cells[1, 1] >= s.min_docs:
            want.add(t)
    assert chosen == want and want


def test_repeated_rows_and_labels_and_long_texts(spark):
    rows = [(i, ("awful slur" if i % 2 else "kind words") + " filler" * (20_000 if i < 3 else 2), "x") for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:10], (None, None, "x")], "doc_id long, text string, toxic string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).select("doc_id", "predicted").collect()
    assert len(got) == 71 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None)
    assert toxicity.score_toxicity(docs.select("doc_id", "text", F.lit(1).alias("score")), toxicity.train(docs, labels)).columns == ["doc_id", "score", "predicted"]


def test_the_sample_is_the_first_by_hash(spark, monkeypatch):
    """Whether a bound on the hashes holds enough rows or, with ids that repeat, doesn't."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda terms, rows, labels, settings: seen.append((len(rows), sorted(map(len, rows)), labels.sum())))
    for ids in ([i for i in range(900)], [0] * 300 + list(range(600)), [7] * 900):
        rows = [(i, " ".join(["bad" if i % 2 else "good"] * (1 + i % 5))) for i in ids]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        labels = spark.createDataFrame([(i, i % 2) for i in sorted(set(ids))], "doc_id long, toxic int")
        toxicity.train(docs, labels, settings=toxicity.Settings(max_rows=100))
        toxicity.train(docs, labels, settings=toxicity.Settings(max_rows=100_000))
        hashed = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(100).collect()
        small, whole = seen[-2:]
        assert small[0] == 100 and whole[0] == 900
        assert small[2] == sum(r.doc_id % 2 for r in hashed)
