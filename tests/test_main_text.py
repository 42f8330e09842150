"""A page's main part against all its elements, and pages with menus, comments and nested lists."""

from __future__ import annotations

import random

from loomwatch.sources import main_text as mt

PROSE = "This is a sentence of the article, which has some words in it."
MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Item {i} of the long menu of this site</a></li>" for i in range(12)) + "</ul></nav>"


def test_menus_comments_and_lists():
    page = f"""<html><head><title>no</title><style>p{{}}</style><script>var t = "<p>no no no no no no no</p>";</script></head><body><header><p>{PROSE}</p></header>{MENU}
    <div class="content"><h1>Head &amp; line</h1><p>{PROSE}<p>Second <b>bold</b> one, with a <a href='/x'>link</a> in it, not closed
    <ul><li>First point of the list, with enough words<ul><li>An inner point of the list, with enough words too</li></ul></li><li>short</li></ul>
    <p class="menu-x">{PROSE} Third.</p><p><a href="/1">{PROSE}</a></p><p>Quite short.</p><div class="comments"><p>{PROSE} I don't agree with this at all.</p></div></div>
    <div id="sidebar"><p>{PROSE} Aside.</p></div><footer><p>{PROSE} Imprint.</p></footer></body></html>"""
    want = ["Head & line", PROSE, "Second bold one, with a link in it, not closed", "First point of the list, with enough words", "An inner point of the list, with enough words too", "Quite short."]
    assert mt.main_text(page).split("\n") == want


def test_pages_without_text():
    for page in (None, "", "   ", "<p>short</p>", MENU, "<div><a href='/'>" + PROSE + "</a></div>", "<script>" + PROSE, "</p></div>", "<nav>" + PROSE + "</nav>"):
        assert mt.main_text(page) is None
    for page in (PROSE, f"<p>{PROSE}", f"<div><div>{PROSE}</div></div></div></body>", f"<table><tr><td>{PROSE}</table>", f"<p>{PROSE}<!-- {PROSE} --></p>", f"<![CDATA[x]]><p>{PROSE}</p>"):
        assert mt.main_text(page) == PROSE
    deep = "<div>" * 20_000 + PROSE + "</div>" * 20_000
    assert mt.main_text(deep) == PROSE


def elements(node):
    yield node
    for p in node.parts:
        if isinstance(p, mt.Node):
            yield from elements(p)


def total(node) -> int:
    return sum(mt.worth(n, *p) for n in elements(node) for p in n.parts if not isinstance(p, mt.Node))


def made_up(r: random.Random, depth: int = 0) -> mt.Node:
    node = mt.Node(r.choice(["div", "p", "li", "h2", "td"]), r.random() < 0.15)
    for _ in range(r.randrange(4)):
        if depth < 5 and r.random() < 0.6:
            node.parts.append(made_up(r, depth + 1))
        else:
            text = " ".join("word" for _ in range(r.choice([1, 3, 6, 9])))
            node.parts.append((text, r.choice([0, 0, len(text) // 3, len(text)])))
    return node


def test_the_best_of_all_elements():
    r, found = random.Random(5), 0
    for _ in range(2000):
        root = made_up(r)
        every = list(elements(root))
        most = max(total(n) for n in every)
        best, value = mt.main_part(root)
        if most <= 0:
            assert best is None
            continue
        found += 1
        equal = [n for n in every if total(n) == most]
        innermost = [n for n in equal if not any(m is not n and m in list(elements(n)) and any(m is x for x in elements(n)) for m in equal)]
        assert value == most and best is innermost[0]
    assert found > 500


def test_columns(spark):
    rows = [(1, f"<p>{PROSE}</p>", "old"), (2, None, "old"), (2, "<p>x</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, page_text string")
    got = mt.with_main_text(df)
    assert got.columns == ["page_id", "html", "page_text"]
    assert sorted((r.page_id, r.page_text or "") for r in got.collect()) == [(1, PROSE), (2, ""), (2, "")]
    assert mt.with_main_text(df.limit(0)).collect() == []
