"""Names that are alike: the pairs that are looked at, and names that come one by one."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import resolve

SYLLABLES = ["fan", "cy", "be", "ar", "la", "za", "rus", "pan", "da", "ki", "mu", "to", "sand", "worm", "tur", "spi", "der", "oil", "rig", "co", "zy"]


def made_up(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    out = [" ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(r.choice([1, 1, 2]))) for _ in range(n)]
    for i in range(0, n, 3):  # some with a letter changed, lost or added, or of other scripts
        x = list(out[r.randrange(n)])
        at = r.randrange(len(x))
        x[at : at + r.choice([0, 1])] = r.choice(["", "q", "x", "é", "日", "😀"])
        out[i] = "".join(x) or "a"
    return out


def frame(spark, names):
    return spark.createDataFrame([(x,) for x in names], "name string").distinct()


@pytest.mark.parametrize("least", [0.85, 0.6])
def test_no_pair_is_lost(spark, least):
    a, b = made_up(150, 1) + ["", "a", "ab", "aaaa", "aaab", "abab"], made_up(150, 2) + ["", "a", "b", "aab", "aaa"]
    want = {(x, y) for x in set(a) - {""} for y in set(b) - {""} if difflib.SequenceMatcher(None, x, y).ratio() >= least}
    pairs = resolve.likely_pairs(frame(spark, a), frame(spark, b), least)
    got = {tuple(r)[:2] for r in resolve.ratios(pairs, least).collect()}
    assert got == want
    assert len(want) > 15


def test_few_pairs_are_looked_at(spark):
    """Twice the names on both sides are four times the pairs; what is verified is a small part, and about what is alike."""
    r = random.Random(3)
    counts = []
    for n in (500, 1000):
        a, b = ([" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 9))) for _ in range(2)) for _ in range(n)] for _ in range(2))
        b[: n // 10] = [x[:-1] + "q" for x in a[: n // 10]]
        counts.append(resolve.likely_pairs(frame(spark, a), frame(spark, b), 0.85).count())
        assert counts[-1] < 3 * n // 10
    assert counts[1] < 3 * counts[0]


def plain_ladder(mentions, aliases, choose, least=0.85, cap=0.99):
    """One by one: exact name, likest name, what the chooser says, or a new entity."""
    index, out = dict(aliases), []  # in order of the index
    known = set(index.values())
    for seq, surface, confidence in mentions:
        name = " ".join(surface.lower().split())
        if not name:
            continue
        key = index.get(name)
        if key is None:
            best = 0.0
            for alias, k in index.items():
                ratio = difflib.SequenceMatcher(None, name, alias).ratio()
                if ratio > best:
                    best, likest = ratio, k
            key = likest if best >= least else None
        if key is None:
            key = choose.get(name)
            key = key if key in known else None
        if key is None:
            index[name] = name
            out.append((seq, name, "provisional", min(confidence, cap)))
        else:
            out.append((seq, key, "resolved", confidence))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ladder_equals_one_by_one(spark, seed):
    r = random.Random(seed)
    pool = made_up(60, seed)
    for _ in range(3):  # chains of names, each like the one before
        x = r.choice(pool) + "abcdefgh"
        for i in range(6):
            x = x[:-1 - i % 3] + r.choice("xyzw") + x[len(x) - i % 3 :]
            pool.append(x)
    entities = [(f"G{i}", x, [x.upper() + "s", "  "], i) for i, x in enumerate(r.sample(pool, 8))]
    mentions = [(i, "threat_actor", r.choice(pool).title().replace(" ", "  "), r.choice([0.5, 1.0])) for i in range(160)] + [(160, "threat_actor", "  ", 0.5)]
    r.shuffle(mentions)
    mentions = [(i, *m[1:]) for i, m in enumerate(mentions)]
    choose = {" ".join(x.lower().split()): "G1" if r.random() < 0.5 else "no key" for x in r.sample(pool, 12)}
    index = resolve.alias_index(spark.createDataFrame(entities, "merge_key string, name string, aliases array<string>, seq long"))
    ordered = [(a.alias, a.merge_key) for a in sorted(index.collect(), key=lambda a: tuple(a.first_seen))]
    answers = spark.createDataFrame(list(choose.items()), "name string, merge_key string")
    rows = spark.createDataFrame([(m[0], m[1], m[2], m[3]) for m in mentions], "seq long, entity_type string, surface_text string, extraction_confidence double")
    for chooser, said in ((None, {}), (lambda names, aliases: names.join(answers, "name"), choose)):
        got = resolve.resolve_in_order(rows, index, chooser)
        assert got.columns == [*rows.columns, "resolution_status", "node_key", "node_confidence"]
        want = plain_ladder([(m[0], m[2], m[3]) for m in mentions], ordered, said)
        assert sorted((x.seq, x.node_key, x.resolution_status, x.node_confidence) for x in got.collect()) == sorted(want)
    assert 20 < sum(x[2] == "provisional" for x in want) < len({m[2] for m in mentions})


def test_chain_in_rounds(spark):
    """Each is like its neighbours: every second one stays."""
    names = spark.createDataFrame([(f"n{i}", i) for i in range(9)], "name string, seq long")
    edges = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(9) for j in range(9) if abs(i - j) == 1], "name string, other string")
    assert {r.name for r in resolve.first_provisional(names, edges).collect()} == {f"n{i}" for i in range(0, 9, 2)}
    assert resolve.first_provisional(names.limit(0), edges).collect() == []
    assert {r.name for r in resolve.first_provisional(names.withColumn("seq", -F.col("seq")), edges.where("name > other")).collect()} == {f"n{i}" for i in range(9)}  # each comes before what it would be like
