"""The pipeline, and the verdict of its quality rules, against brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from loomwatch.llm import pieces, quality
from tests.llm.test_operators import alnum, brute_components, brute_hits, brute_lines

VOCABULARY = [a + b + c for a in ("ba", "te", "lo", "mi", "sur", "gran", "ple") for b in ("ra", "ne", "ki", "dor", "val") for c in ("", "s", "tion", "ment", "ly", "nk")]


def page(seed, words=180, width=12):
    r = random.Random(seed)
    w = [r.choice(VOCABULARY) + (r.choice(["", "", "", ",", "."])) for _ in range(words)]
    return "\n".join(" ".join(w[i : i + width]) for i in range(0, words, width))


def brute_quality(text, bands=quality.CompressionBands()):
    import zstandard

    size = lambda b: len(zstandard.ZstdCompressor(level=bands.level).compress(b))
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
    raw = (text or "").encode()
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False
    low, high = next((lo, hi) for below, lo, hi in bands.bands if len(raw) < below)
    chunks = [raw[i : i + bands.chunk] for i in range(0, len(raw) - bands.chunk + 1, bands.chunk)]
    bad = sum(not bands.chunk_band[0] <= size(c) / len(c) <= bands.chunk_band[1] for c in chunks)
    return low <= size(raw) / len(raw) <= high and bad <= bands.bad_share * len(chunks)


def brute_cut(text, items, window=13):
    """None if the document goes, else the text without the spans of its hit words."""
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower))
    words, hit = [m[0] for m in found], set()
    for _, t in items:
        b = alnum(t)
        k = min(window, len(b))
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in grams:
                hit |= set(range(i, i + k))
    assert len(hit) == brute_hits(text, items)[1]
    if hit and 20 * len(hit) >= len(words):
        return None
    out, at = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out, at = out + text[at : found[i].start()], found[i].end()
        else:
            at = found[i].end()
    return out + text[at:]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(f"question{i}" for i in range(15))
    base, long = page(1), page(2, 700)
    changed = base.replace(base.split()[30], "changedword", 1)
    texts = [
        base, base, changed, page(3), page(3).split("\n")[0] + "\n" + page(4), page(5, 20), "word " * 200, None, "", page(6) + "\n" + item, long + "\nSee " + item.upper() + ", end of it.",
        item, "".join(random.Random(5).choice("abcdefgh0123456789+/") for _ in range(4000)), page(7, 1500), page(7, 1500) + "\nWith one more line at its very end.", page(8) + "\nShared closing line of the whole site.", page(9) + "\nShared closing line of the whole site!",
        "日本語の文章 " * 3 + page(10), page(4) + "\n" + page(11), *(page(20 + i) for i in range(6)),
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    items = [(1, item), (2, None), (3, "...")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline(spark, tables):
    folder, rows, items = tables
    kept = {i: t for i, t, *_ in rows if brute_quality(t)}
    assert 0 < len(kept) < len(rows)
    lines, left = brute_lines(list(kept.items())), {}
    for i, x in lines.items():
        if x == kept[i].split("\n") or any(y.strip() for y in x):
            left[i] = "\n".join(x)
    assert len(left) < len(kept)
    classes = brute_components(list(left.items()))
    one = {i: t for i, t in left.items() if classes[i][1] == i}
    cut = {i: brute_cut(t, items) for i, t in one.items()}
    want = {i: t for i, t in cut.items() if t is not None}
    assert any(want[i] != one[i] for i in want) and len(want) < len(one)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: r for r in out.collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {i: r.text for i, r in got.items()} == want
    for i, r in got.items():
        assert (r.n_chars, r.ids, r.n_tokens, r.restored) == (len(want[i]), sp.encode(want[i]), len(r.ids), True)
        assert (r.lang, r.source) == ("en", f"s{i % 3}")


def test_stages_keep_the_columns_and_take_empty_tables(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0, name
        assert out.columns[:5] == docs.columns and (name == "sentencepiece") == (out.columns != docs.columns)


def test_quality_verdicts(spark, tables):
    folder, rows, _ = tables
    r = random.Random(3)
    more = [(100 + i, "".join(r.choice(" abcdefghijklmnop\n#") for _ in range(r.choice([30, 300, 3000, 30_000])))) for i in range(25)] + [(200 + i, page(i, 60 + 40 * i) + page(i, 100) * (i % 3)) for i in range(20)]
    every = [(i, t) for i, t, *_ in rows] + more
    got = {x.doc_id: x.kept for x in quality.quality_report(spark.createDataFrame(every, "doc_id long, text string")).collect()}
    assert got == {i: brute_quality(t) for i, t in every} and len(set(got.values())) == 2
