"""Periodic runs against all periods of all places, and the query against its contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from loomwatch.llm import runs, vec


def plain_runs(w: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period): for each period, the stretches that agree with themselves that far away; of equal ones the smallest period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def find(texts: list[list[int]], **limits) -> list[list[tuple[int, int, int]]]:
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    ids = np.array([x for t in texts for x in t], dtype=np.int64)
    out: list[list] = [[] for _ in texts]
    for t, *r in zip(*runs.Runs(ids, at, **limits).find(), strict=True):
        out[t].append(tuple(int(x) for x in r))
    return out


def made_up(r: random.Random) -> list[int]:
    """Random words of a small alphabet, with repeated parts, some of them inside others, some broken."""
    out: list[int] = []
    while len(out) < r.randrange(10, 400):
        part = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 30))]
        if r.random() < 0.5:
            part = part * r.randrange(1, 12) + part[: r.randrange(len(part) + 1)]
        if r.random() < 0.3:
            part[r.randrange(len(part))] = 99
        out += part * r.choice([1, 1, 1, 3])
    return out


def test_runs_equal_all_periods():
    r = random.Random(11)
    texts = [[], [1], [1] * 23, [1] * 24, [1] * 25, [1, 2] * 12, [1, 2] * 12 + [1], list(range(8)) * 3, list(range(9)) * 3, list(range(9)) * 2, [0, 0, 1] * 200, [0, 0, 0, 1] * 50 + [0] * 70]
    texts += [made_up(r) for _ in range(400)]
    got = find(texts)
    for t, g in zip(texts, got, strict=True):
        assert g == plain_runs(t), t
    assert sum(map(len, got)) > 300
    assert find(texts, least=40, times=4) == [plain_runs(t, 40, 4) for t in texts]
    with pytest.raises(ValueError, match="three periods"):
        find(texts, times=2)


def test_hashes_that_lie_change_nothing(monkeypatch):
    r = random.Random(2)
    texts = [made_up(r) for _ in range(60)]
    monkeypatch.setattr(runs.vec, "mix", lambda h: h * np.uint64(0))  # all runs of one length have one hash
    assert find(texts) == [plain_runs(t) for t in texts]


def test_a_hash_s_worst_words_and_long_texts():
    word = [0]
    while len(word) < 1 << 13:
        word += [1 - x for x in word]
    assert find([word]) == [[]]  # each factor of it occurs in a row twice at most
    n = 200_000
    r = random.Random(4)
    part = [r.randrange(1000) for _ in range(n // 4)]
    assert find([[7] * n, [1, 2, 3] * (n // 3), part * 4, part]) == [[(0, n, 1)], [(0, n // 3 * 3, 3)], [(0, n, n // 4)], []]


def test_words_of_one_hash_are_told_apart():
    texts = ["a b a b", "b c", None, "ünï a"]
    words = vec.Words(*vec.text_bytes(pa.array(texts)), lower=False)
    plain = re.findall(r"\S+", " ".join(t or "" for t in texts))
    same = [[x == y for y in plain] for x in plain]
    ids, first = runs.intern_words(words)
    assert ids[first].tolist() == list(range(len(first)))
    assert (ids[:, None] == ids[None, :]).tolist() == same
    words.hash = np.zeros_like(words.hash)
    ids, first = runs.intern_words(words)
    assert ids[first].tolist() == list(range(len(first)))
    assert (ids[:, None] == ids[None, :]).tolist() == same


TEXTS = [None, "", " \n\t", "one", "a b " * 12, "x  y\tz\n" * 40 + "end", "spam " * 300, "Ünï cödé 日本 " * 9, "v " * 23, ("to be or not to be " * 10 + "no ") * 5] + [" ".join(f"w{random.Random(i).randrange(40)}" for _ in range(17 * i)) for i in range(60)]


def split(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def collapsed(w: list[str]) -> str:
    gone = {i for s, n, q in plain_runs(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_columns_of_a_table(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate([*TEXTS, TEXTS[6], TEXTS[6]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, `a.b` string").repartition(3)
    got = runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"]
    for r in got.collect():
        w = split(r.text)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), plain_runs(w), collapsed(w))
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, TEXTS[5])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, changed = {}, 0
    for i, t in rows:
        w = split(t)
        if i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w, changed = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)], changed + 1
        found = plain_runs(w)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i] = (len(found), *best, None if not found else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w)))
    assert changed > 10
    got = runs.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {k for _, k in got.dtypes} == {"bigint", "string"}
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
