"""Conversations with equal and missing turn numbers, repeated rows and many turns come back whole."""

from __future__ import annotations

import hashlib
import random

from loomwatch.llm import chat


def test_odd_conversations_come_back(spark, tmp_path):
    r = random.Random(9)
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "user", "first"), (1, 1, "user", "same"), (1, 1, "user", "same")]
    rows += [(2, n, r.choice(["user", "assistant"]), f"turn {n} \\ <s>") for n in range(2000)]
    rows += [(c, n, "user", f"shared {n}" if n < 5 else f"own {c}") for c in range(10, 40) for n in range(7)]
    rows += [(50, 0, "assistant", "long " * 40_000), (51, 0, None, ""), (52, 0, "", None)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, node string").repartition(5)
    chat.format_trees(df, str(tmp_path / "c"))
    got = {x.conv_id: x for x in chat.read_back(spark, str(tmp_path / "c")).collect()}
    want: dict[int, list] = {}
    for c, n, role, text in rows:
        want.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        whole = hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    nodes = spark.read.parquet(str(tmp_path / "c/nodes"))
    assert nodes.count() == 6 + 2000 + 5 + 2 * 30 + 1 + 1  # 51 and 52 are alike
