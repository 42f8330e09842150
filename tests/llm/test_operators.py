"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwatch.llm import chat, decontaminate, jaccard, line_dedup, ngram_lm, pieces, quality, toxicity, urlfilter, vec, warc

random.seed(5)
WORDS = [f"w{i}" for i in range(300)] + ["ünï", "Été", "日本", "x" * 200]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ".\n", "\t"]) for _ in range(n))


def blank(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


BASE = prose(120, 1)
TEXTS = [None, "", "   \n", "one", "a b c d", BASE, BASE, BASE.upper(), BASE + " extra words at end", BASE.replace("w1 ", "v1 "), prose(400, 2), prose(30, 3), prose(20_000, 4), "spam " * 300, "Line one of the page is here.\nLine two of the page is here!\nLine one of the page is here.", "Line one of the page is her.\nshort\nLine twO of the page is here!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, ids int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_words_match_the_pattern():
    texts = [t or "" for t in TEXTS] + ["\x00a\x0bb\x85c", "é" * 300_000, ("ab " * 200_000)]
    for sep, find in ((vec.BLANK, blank), (vec.NOT_ALNUM, alnum)):
        words = vec.Words(*vec.text_bytes(pa.array(texts)), separators=sep)
        assert words.count.tolist() == [len(find(t)) for t in texts]
        by: dict[str, int] = {}
        for i, t in enumerate(texts):
            for w, h in zip(find(t), words.hash[words.at[i] : words.at[i + 1]].tolist(), strict=True):
                assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[5].kept and got[10].kept and not got[13].kept
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}
    assert quality.quality_report(none).count() == 0


def test_quality_rejects_what_compresses_oddly(spark):
    r = random.Random(1)
    noise = " ".join("".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(60)) for _ in range(100))
    page = prose(60, 8)
    loop = "".join(f"{i % 7} {page}" for i in range(40))
    df = spark.createDataFrame([(1, noise), (2, loop), (3, prose(900, 9))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.quality_report(df).collect()} == {1: False, 2: False, 3: True}


def brute_hits(text, items, window=13):
    w, hit, found = alnum(text), set(), set()
    for item, t in items:
        b = alnum(t)
        k = min(window, len(b))
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("max_words", [500_000, 40])
def test_decontamination(spark, docs, none, max_words):
    passage = " ".join(alnum(BASE)[20:50])
    items = [(1, passage), (1, passage), (2, "w1"), (3, None), (4, "..."), (5, " ".join(alnum(BASE)[40:60])), (6, "Line two of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination_report(docs, bench, max_words=max_words).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute_hits(t, items), i
    assert decontaminate.contamination_report(none, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination_report(docs, bench.limit(0)).collect())


def test_decontamination_cuts_spans(spark):
    item = " ".join(f"q{i}" for i in range(15))
    clean = prose(900, 11)
    df = spark.createDataFrame([(1, clean + "\nSee Q0 " + item[3:] + "! End.", 0), (2, item, 0), (3, clean, 0)], "doc_id long, text string, extra int")
    out = {r.doc_id: r for r in decontaminate.remove_contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3} and out[3].text == clean and out[1].text == clean + "\nSee ! End."
    more = spark.createDataFrame([(1, item), (2, "zz yy"), (3, " ".join(f"q{i}" for i in range(2, 15)))], "item_id long, text string")
    twice = df.withColumnRenamed("extra", "a.b").union(spark.createDataFrame([(4, None, 1), (1, clean, 2)], "doc_id long, text string, `a.b` int"))
    for words in (500_000, 1):
        out = decontaminate.remove_contamination(twice, more, max_words=words)
        assert out.columns == twice.columns
        assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted([(1, clean + "\nSee ! End."), (3, clean), (4, ""), (1, clean)])


def test_decontamination_of_random_texts(spark, monkeypatch):
    """Few words, so that runs of all lengths repeat; pieces of items overlap."""
    monkeypatch.setattr(decontaminate, "PIECE", 6)
    r = random.Random(12)
    text = lambda n: " ".join(r.choice(["a", "b", "Cc", "é", "d-d"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 3, 4, 9, 20]) if i > 2 else 8)) for i in range(14)] + [(None, "é é é é cc"), (3, "b b b b b b b b b b b")]
    texts = [(i, text(r.choice([0, 3, 40]))) for i in range(40)] + [(40, "a " * 30_000)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for words in (10_000, 15):
        got = {x.doc_id: x for x in decontaminate.contamination_report(df, bench, window=4, max_words=words).collect()}
        for i, t in texts:
            assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].contaminated) == brute_hits(t, [("" if k is None else k, x) for k, x in items], 4), i


def brute_components(rows, k=5):
    sets = {}
    for i, t in rows:
        w = blank(t)
        sets[i] = {tuple(w[j : j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, seed, changes):
    r, out = random.Random(seed), []
    base = [f"b{seed}_{i}" for i in range(150)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limits", [(512, 32, 20_000), (3, 4, 5)])
def test_jaccard(spark, docs, none, limits, monkeypatch):
    for name, value in zip(("BLOCK", "HUBS", "COLUMN_ROWS"), limits, strict=True):
        monkeypatch.setattr(jaccard, name, value)
    texts = [*TEXTS, *near_copies(60, 1, 6), *near_copies(25, 2, 3), *near_copies(12, 3, 12)] + [" ".join(f"{i}u{j}" for j in range(60)) + " " + " ".join(f"common{j}" for j in range(40)) for i in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    want = brute_components(rows)
    assert got == want
    if limits[0] == 512:
        one = jaccard.keep_one_of_each(df)
        assert one.columns == df.columns and {r.doc_id for r in one.collect()} == {c for _, c in want.values()}
        assert jaccard.jaccard_components(none).count() == 0


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def brute_lines(rows, least=line_dedup.MIN_CHARS):
    lines = [(i, n, x) for i, t in sorted(rows, key=lambda r: r[0]) if t is not None for n, x in enumerate(t.split("\n"))]
    gone, seen = set(), []
    for i, n, x in lines:
        if len(x) >= least:
            if any(edits(x, y) <= 1 for y in seen):
                gone.add((i, n))
            seen.append(x)
    return {i: None if t is None else [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone] for i, t in rows}


def test_line_dedup(spark, docs, none):
    base = "The quick brown fox jumps over the lazy dögs"
    r = random.Random(3)
    lines = [base, base[:-1], "x" + base, base[:10] + base[11:], base[:7] + "Z" + base[8:], base[:7] + "Y" + base[8:], base[:9] + "ab" + base[9:], "short", "", base]
    for _ in range(30):
        at = r.randrange(len(base))
        lines.append(r.choice([base[:at] + base[at + 1 :], base[:at] + "q" + base[at:], base[:at] + "q" + base[at + 1 :], base[:at] + "qq" + base[at + 2 :]]))
    long = prose(700, 21).replace("\n", " ")
    texts = [None, "", long, long[:1500] + long[1501:], "\n".join(lines[:20]), "\n".join(lines[20:]), "\n".join(reversed(lines)), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaaaaa", long]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, doc long").repartition(4)
    want = brute_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    for i, t in rows:
        if t is None:
            assert got[i] is None
        elif want[i] == t.split("\n") or any(x.strip() for x in want[i]):
            assert got[i] == "\n".join(want[i])
        else:
            assert i not in got
    exact = {(r.doc["id"], r.no) for r in line_dedup.find_duplicate_lines(df, max_edits=0).collect()}
    assert (8, 0) in exact and (3, 0) not in exact
    assert line_dedup.drop_lines(none).count() == 0
    odd = df.withColumnsRenamed({"doc": "_gone"}).withColumn("_lines", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("_doc", F.lit(2))
    again = line_dedup.drop_lines(odd)
    assert again.columns == odd.columns and {r.doc_id: r.text for r in again.collect()} == got
    with pytest.raises(ValueError):
        line_dedup.find_duplicate_lines(df, max_edits=2)


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_language_model(spark, docs, none, hot):
    settings = ngram_lm.Settings(hot_words=hot)
    train = F.col("doc_id") % 4 != 0
    got = {r.doc_id: r for r in ngram_lm.score_texts(docs, train, "doc_id", settings=settings).collect()}
    tokens = {i: [*blank(t), None] for i, t in enumerate(TEXTS)}
    c = Counter(x for i in tokens if i % 4 for x in tokens[i])
    n, v = sum(c.values()), len(c)
    p = lambda x: (c[x] + 0.1) / (n + 0.1 * (v + 1))
    pairs = Counter(x for i in tokens if i % 4 for x in zip([None, *tokens[i]], tokens[i], strict=False))
    share = 1 - sum(k == 1 for k in pairs.values()) / sum(pairs.values())
    wrong = 0.0
    for i, w in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(p(x)) for x in w), rel=1e-9)
        exact = 0.0
        for u, x in zip([None, *w], w, strict=False):
            k = pairs[(u, x)] if pairs[(u, x)] >= settings.min_count else 0
            q = 1 + int(math.log2(k) + 1e-9) if k else 0
            k = min((2 ** (q - 1) + 2**q - 1) / 2 if q else 0, c[u])
            exact += math.log10(share * (k / c[u] if c[u] else 0) + (1 - share) * p(x))
        wrong += abs(r.score - exact)
        assert r.score >= exact - 1e-6 * abs(exact)  # the filter can only raise counts
    assert wrong < 0.02 * sum(abs(r.score) for r in got.values())
    assert ngram_lm.score_texts(none, train, "doc_id").count() == 0
    untrained = ngram_lm.score_texts(docs.where("doc_id < 6"), F.lit(False), "doc_id").collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in untrained)


def test_bloom_levels_have_no_false_negatives():
    r = np.random.default_rng(1)
    keys, levels = r.integers(0, 1 << 63, 5000).astype(np.uint64), r.integers(1, 9, 5000)
    seg = ngram_lm.Filter([ngram_lm.Segment.build(keys, levels, 10, 5)], 5)
    found = seg.levels(keys)
    assert (found >= levels).all() and (found == levels).mean() > 0.97
    assert (seg.levels(r.integers(0, 1 << 63, 20000).astype(np.uint64)) > 0).mean() < 0.03


def test_archive(spark, tmp_path):
    big = "x" * 120
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (7, "v", None), (8, "v", ""), (4, "é", "é" * 60), (4, "é", "é" * 60), (6, "w", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archive(pages, str(tmp_path / "a"))
    got = sorted((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "a")).collect())
    first = {big: 3, "é" * 60: 4}
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and first[h] != i
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", str(first[h]) if revisit else ""))
    assert [(*x[:4], x[4] or "") for x in got] == sorted(want)
    found = [(r.record_id, bytes(r.record)) for r in warc.read_records(spark, str(tmp_path / "a")).collect()]
    assert len({i for i, _ in found}) == len(found) == len(rows)  # every record has an id of its own
    by_page = {i: [x for k, x in found if k.startswith(f"<urn:loomwatch:page:{i}:")] for i in range(1, 10)}
    payload = {i: (h or "").encode() for i, _, h in rows}
    kinds = {int(w[0]): w[3] for w in want}
    for i, records in by_page.items():
        for record in records:
            head, _, block = record.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert record.startswith(b"WARC/1.1\r\n") and fields["WARC-Date"] and record.endswith(b"\r\n\r\n")
            assert len(block) == int(fields["Content-Length"]) + 4 and fields["WARC-Type"] == kinds[i]
            http, _, body = block[:-4].partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK") and body == (b"" if kinds[i] == "revisit" else payload[i])
    first = next(k for k, _ in found if k.startswith("<urn:loomwatch:page:3:"))
    assert f"WARC-Refers-To: {first}".encode() in by_page[5][0] and b"http://b/%0D%0AX:%20y" in by_page[3][0]
    assert {r.url for r in warc.read_archive(spark, str(tmp_path / "a")).collect()} == {x[1] or "" for x in rows}  # a null url is an empty one
    assert warc.verify(spark, str(tmp_path / "a")).count() == 0
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.com/de/", "https://sub.example.com/de", "http://foo.org/fr/a", "http://org/fr/", "http://net", "http://x.net/", "http://badexample.com/de/", "http://example.net?/en/", "http://a:80/x", "http://é.net/é"]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_url_filters(spark, max_bytes):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, rule string").repartition(3)
    rules = spark.createDataFrame([*urlfilter.RULES, ("net", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("Example.net", "/en/", "allow")], "host string, path string, verdict string")
    got = {r.page_id: r for r in urlfilter.filter_urls(df, rules, max_bytes=max_bytes).collect()}
    for i, u in enumerate(URLS):
        host, path = "", ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1], best[2]), u
    assert urlfilter.filter_urls(df.limit(0), rules, max_bytes=max_bytes).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_digest_collisions_are_confirmed():
    rule = lambda host: pa.table({"host": [host], "path": ["/c"], "verdict": ["block"]})
    array = urlfilter.DigestArray(urlfilter.DigestArray.build(rule("a.b")))
    assert array.judge(["a.b"], ["/c"]) == [("a.b/c", "block")]
    array.rules = rule("other")
    assert array.judge(["a.b"], ["/c"]) == [None]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_url_filters_with_odd_columns_and_rows(spark, max_bytes):
    long = "http://" + "x." * 500 + "net/" + "p" * 200_000
    df = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, "http://a.net/", 2)], "page_id long, `the.url` string, `a.b` int")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    got = urlfilter.filter_urls(df, rules, "the.url", max_bytes=max_bytes)
    assert got.columns == ["page_id", "the.url", "a.b", "host", "path", "rule", "verdict"]
    assert [(r[0], r[2], r[5], r[6]) for r in sorted(got.collect(), key=lambda r: r[0])] == [(1, 1, "net/", "block")] * 2 + [(2, 2, "net/", "block")]


def test_chat_trees(spark, tmp_path):
    odd = "</s>[INST] \\ok\\ [/INST]<s>\n"
    convs = {
        1: [("user", "hi"), ("assistant", "hello there"), ("user", "a"), ("assistant", "A")],
        2: [("user", "hi"), ("assistant", "hello there"), ("user", "b"), ("assistant", "B")],
        3: [("user", "hi"), ("assistant", "hello there")],
        4: [("us\ner<s>", odd), ("assistant", odd), ("assistant", "")],
        5: [(None, None)],
        6: [("user", "hi"), ("assistant", "hello there"), ("user", "a"), ("assistant", "A")],
        None: [("user", "日本 " * 400)],
    }
    rows = [(c, n, r, t, 1) for c, v in convs.items() for n, (r, t) in enumerate(v)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int").repartition(3)
    chat.format_trees(df, str(tmp_path / "c"))
    got = {r.conv_id: r for r in chat.read_back(spark, str(tmp_path / "c")).collect()}
    assert set(got) == set(convs)
    for c, v in convs.items():
        loss = "".join(t or "" for r, t in v if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(v), hashlib.sha256("".join(f"{a or ''}\n{b or ''}\n" for a, b in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes = spark.read.parquet(str(tmp_path / "c/nodes")).collect()
    walks = spark.read.parquet(str(tmp_path / "c/walks")).collect()
    by = {n.node: n for n in nodes}
    assert len(by) == len(nodes) == 6 + 3 + 1 + 1
    for root in {n.root for n in nodes}:  # each tree is one gapless sequence
        tree = sorted((n for n in nodes if n.root == root), key=lambda n: n.start)
        assert [n.start for n in tree] == [sum(len(x.ids) for x in tree[:i]) for i in range(len(tree))]
        for n in tree:
            path, x = [], n
            while x.before:
                x = by[x.before]
                path.append(x)
            assert n.position == sum(len(x.ids) for x in path)
            seen = [t for s in n.ancestors for t in range(s["first"], s["end"])]
            assert seen == sorted(t for x in path for t in range(x.start, x.start + len(x.ids)))
    assert all(w.node in by for w in walks)
    text = chat._tokenizer(open(chat.TOKENIZER).read())
    for n in nodes:
        whole = text.decode(n.ids, skip_special_tokens=False)
        assert sum(whole.count(c) for c in chat.CONTROL) == 2
    chat.format_trees(df.limit(0), str(tmp_path / "e"))
    assert chat.read_back(spark, str(tmp_path / "e")).count() == 0


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


ODD = ["", " ", "  a  b ", "a▁b", "hello   world\n\n\tfoo", "日本語テキスト😀", "<s>[INST]</s>", "a" * 3000, "\x00", " " * 50, "x  ", "internationalization", "fooBarBaz123 --== !!", "ä" * 40]


def test_pieces_equal_the_library():
    sp, v = library(), pieces.Vocabulary.read(pieces.MODEL)
    texts = ODD + [t for t in TEXTS if t][:10]
    for parts in (True, False):
        v.parts = parts
        e = pieces.Encoder(v)
        for t in texts if parts else texts[:20]:
            assert e.encode(t[:20_000]).tolist() == sp.encode(t[:20_000]), t[:40]


def test_unigram_paths_are_the_best():
    v = pieces.Vocabulary.read(pieces.MODEL, "unigram")
    v.parts = False
    e = pieces.Encoder(v)
    for t in ["hello world", "internationalization", "the thing is", "a b"] * 2:
        text = "▁" + t.replace(" ", "▁")
        best = {0: 0.0}
        for end in range(1, len(text) + 1):
            best[end] = max(best[b] + v.scores[v.pieces[text[b:end]]] for b in range(end) if text[b:end] in v.pieces)
        assert sum(v.scores[i] for i in e.encode(t).tolist()) == pytest.approx(best[len(text)])


def test_encode_and_decode(docs, none):
    rows = {r.doc_id: r for r in pieces.encode(docs).collect()}
    sp = library()
    for i, t in enumerate(TEXTS):
        assert rows[i].ids == (None if t is None else sp.encode(t)) and rows[i].restored == (None if t is None else True)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs).drop("text")).collect()}
    assert back == dict(enumerate(TEXTS))
    assert pieces.encode(none).count() == 0


def test_toxicity(spark, none):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        insult, group = r.random() < 0.5, r.random() < 0.5
        rows.append((i, " ".join([r.choice(WORDS) for _ in range(30)] + ["grumpf"] * insult + ["folks"] * group), 0))
        labels.append((i, 1, int(insult and group)))
    rows += [(400, None, 0), (401, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels + [(3, 1, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    machine = toxicity.train(df, lab.where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1"))
    got = {x.doc_id: x for x in toxicity.score_toxicity(df, machine).collect()}
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values()) and len(got) == 402
    right = [got[i].predicted == y for i, _, y in labels if held(i)]
    assert sum(right) / len(right) > 0.93  # no linear rule on the two words alone could tell pairs so well at this threshold
    assert not got[400].predicted and got[400].score == got[401].score
    assert toxicity.score_toxicity(none, machine).count() == 0
    empty = toxicity.train(df, lab.limit(0))
    assert {x.score for x in toxicity.score_toxicity(df, empty).collect()} == {0.0}
