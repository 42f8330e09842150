"""What operators do where a limit of theirs, or of a type, is reached."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwatch.llm import jaccard, line_dedup


def test_parts_of_a_salted_column_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_ENTRIES", 4)
    hist = bytes(np.ones(jaccard.HIST, dtype=np.uint8))
    # Salted columns 0 to 19: one class in each part. The first hub of part 0 is also that of many whole columns.
    rows = [(col, part, 2, 256, 1000 * (part + 1) + col, 2, 1 if part == 0 else 2, 1000 * (part + 1) + col) for col in range(20) for part in (0, 1)]
    rows += [(100 + i, 0, 1, 256, 1, 2, 1, 1) for i in range(40)]
    apart = spark.createDataFrame(rows, "col long, part int, parts int, n long, cls long, size long, hub long, comp long")
    classes = spark.createDataFrame([(c, hist, 256) for c in {r[4] for r in rows}], "cls long, hist binary, n long")
    got = {frozenset((r.a, r.b)) for r in jaccard._missing(apart, classes, 80).collect()}
    assert got == {frozenset((1000 + c, 2000 + c)) for c in range(20)}


def test_blocks_of_a_very_long_line(spark):
    m = 10_000_000
    count, first, end = spark.range(1).select(line_dedup._blocks(F.lit(m)).alias("n")).first().n, [], []
    for r in spark.range(count).select(*line_dedup._block(F.lit(m), F.col("id").cast("int"))).collect():
        first.append(r[0]), end.append(r[1])
    assert sorted(first) == first and first[0] == 0 and end[-1] == m and end[:-1] == first[1:]


def test_a_host_of_very_many_labels(spark):
    import tracemalloc

    from loomwatch.llm import urlfilter

    host = "a." * 20_000 + "b.net"
    rules = [("net", "/", "block"), ("b.net", "/x/", "allow"), ("a.b.net", "/x/y", "block"), (".b.net", "/", "allow")]
    urls = [(0, f"http://{host}/x/z"), (1, f"http://{host}/q"), (2, f"http://{host}/x/y"), (3, "http://a..b.net/"), (4, f"http://{'.' * 20_000}net/"), (5, f"http://net{'/x' * 20_000}")]
    want = {0: "b.net/x/", 1: "net/", 2: "a.b.net/x/y", 3: ".b.net/", 4: "net/", 5: "net/"}
    table = pa.table(dict(zip(("host", "path", "verdict"), zip(*rules, strict=True), strict=True)))
    array = urlfilter.DigestArray(urlfilter.DigestArray.build(table))
    tracemalloc.start()
    array.judge([host] * 50, ["/x/z"] * 50)
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    df, r = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    for limit in (urlfilter.MAX_BYTES, 0):
        assert {x.page_id: x.rule for x in urlfilter.filter_urls(df, r, max_bytes=limit).collect()} == want
