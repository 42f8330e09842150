"""Fragments between forced boundaries give the ids of the public library, whatever the limits are."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwatch.llm import bpe


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    with open(bpe.VOCABULARY, "rb") as f:
        return Tokenizer.from_file(bpe.VOCABULARY), bpe.Codec(f.read())


def odd_texts() -> list[str | None]:
    r = random.Random(3)
    out = [
        None, "", "  ", "it's we've 'S 'l 'll ''s s's's'd'm!'s a'b", "<|startoftext|>Hi<|endoftext|><|endoftext|> x<|start", "İIΣΑΣ ǅ é é Å", "日本語" * 300, "a" * 1000, "ab" * 700, "😀" * 300, "12345 x1y2",
        "\x1c\x1d a\x85b​c　d", "Ᲊ\U00010d50 Ɤx ꟍ", "the" * 900, "internationalization" * 50, "tion" * 400, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)),
    ]
    out += ["".join(r.choice("abcdeiou  \n'svtlm12_ü日😀ÉΣİ<|>́") for _ in range(r.randrange(300))) for _ in range(100)]
    return out + ["".join(chr(r.choice([r.randrange(0x20, 0x250), r.randrange(0x300, 0x3000), r.randrange(0x10000, 0x1FFFF)])) for _ in range(200)) for _ in range(50)]


@pytest.mark.parametrize(("size", "wide", "step"), [(1 << 19, 64, 32), (300, 64, 32), (40, 8, 4), (1 << 19, 4, 2)])
def test_ids_equal_the_library(both, monkeypatch, size, wide, step):
    public, codec = both
    monkeypatch.setattr(bpe, "SLICE", size)
    monkeypatch.setattr(bpe, "WIDE", wide)
    monkeypatch.setattr(bpe.Vocabulary.encode_fragments, "__defaults__", (step,))
    texts = odd_texts()
    ids, sizes = codec.encode_all(texts)
    cuts = np.append(0, np.cumsum(sizes))
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == public.encode(t or "", add_special_tokens=False).ids, (i, (t or "")[:40])
    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
    want = [public.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert codec.decode(lists).to_pylist() == want


def test_every_character_is_of_the_library_s_class(both):
    public, codec = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 7]
    texts = [f"a{chr(c)}1{chr(c)}" for c in points]
    ids, sizes = codec.encode_all(texts)
    want = public.encode_batch(texts, add_special_tokens=False)
    assert sizes.tolist() == [len(w.ids) for w in want]
    assert ids.tolist() == [i for w in want for i in w.ids]


def test_no_token_holds_a_forced_boundary(both):
    v = both[1].v
    assert 0 < v.inside.sum() < 512 * 512 / 20
    r = np.random.default_rng(1)
    symbols = r.integers(0, 512, 4000)
    whole, _ = v.merge(v.symbol[symbols], np.array([0]))
    ends = np.cumsum(v.lengths[whole])
    forced = np.flatnonzero(~v.inside[symbols[:-1], symbols[1:]]) + 1
    assert len(forced) > 100
    assert set(forced.tolist()) <= set(ends.tolist())


def test_columns_of_a_table(spark, both):
    public, _ = both
    rows = [(i, t, "x", i) for i, t in enumerate([*odd_texts()[:20], "twice", "twice"])]
    docs = spark.createDataFrame(rows, "`doc.id` long, text string, n_tokens string, ids int")
    got = bpe.encode(docs.repartition(3), decoded_col="n")
    assert got.columns == ["doc.id", "text", "ids", "n_tokens", "n"]
    for r in got.collect():
        want = None if r.text is None else public.encode(r.text, add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (want, len(want or []))
        assert r.n == (None if r.text is None else public.decode(want, skip_special_tokens=False))
    back = bpe.decode(got.select("n", "ids", "text"))
    assert back.columns == ["n", "ids", "text"]
    assert back.where(~F.col("n").eqNullSafe(F.col("text"))).count() == 0
    assert bpe.encode(docs.limit(0)).collect() == []


def test_other_steps_are_refused(both):
    import json

    spec = json.loads(open(bpe.VOCABULARY, encoding="utf-8").read())
    spec["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}
    with pytest.raises(ValueError, match="aren't known"):
        bpe.Codec(json.dumps(spec).encode())


def test_query(spark, both, tmp_path):
    public, _ = both
    texts = [*odd_texts(), "x " * 50_000]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, t in enumerate(texts):
        ids = public.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(public.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op11_bpe(spark, str(tmp_path)).collect()} == want
