"""URL filters: a sorted array of 64-bit digests, probed by vectorised binary search.

A rule is a host and a path. Its key, ``host + path``, is hashed by xxhash; the hashes are
sorted, and the rules' strings are kept in the same order, in Arrow columns. Each task maps the array into
memory from a file of its own, probes it with the digests of all (domain suffix, path prefix)
pairs of a batch of urls at once, and compares the stored string of each hit, so a collision
of digests can't match. Suffixes and prefixes are only tried at the lengths that rules have, so
a host of very many labels, or a very long path, costs no more than its own length.

The array is broadcast only up to ``max_bytes``. Larger rule sets go by an equi-join of the
same keys, on the same strings, with the same result.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; a null
or empty rule host fits nothing; repeated rules count once; if rules of equal length fit, the
one with the longer host wins, and 'block' if both verdicts are given for one rule; an empty
rule table or url table gives the default verdict or no rows. Other columns pass through.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwatch.llm.shared import map_arrow

DEFAULT = "allow"
MAX_BYTES = 64 << 20
OUT = [("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, _ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _clean(rules: DataFrame) -> DataFrame:
    """Distinct rules (host, path, verdict); blocking wins if one rule has both verdicts."""
    host = _ascii_lower(F.col("host"))
    return rules.where("host IS NOT NULL AND host <> ''").select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


class DigestArray:
    """Sorted digests with their strings; ``data`` is what is broadcast."""

    def __init__(self, data: tuple[bytes, bytes, list[tuple[int, list[int]]]]):
        #: Of hosts, with those of paths that go with each.
        digests, strings, self.lengths = data
        self.rules = pa.ipc.open_stream(strings).read_all()
        with tempfile.NamedTemporaryFile(delete=False) as f:
            f.write(digests)
        self.digests = np.memmap(f.name, dtype=np.uint64, mode="r") if digests else np.zeros(0, dtype=np.uint64)
        os.unlink(f.name)  # the mapping stays, the name goes

    @staticmethod
    def build(rules: pa.Table) -> tuple[bytes, bytes, list[tuple[int, list[int]]]]:
        """rules: columns host, path, verdict, all strings."""
        import xxhash

        keys = pc.binary_join_element_wise(rules["host"], rules["path"], "")
        digests = np.fromiter((xxhash.xxh64_intdigest(k.as_py()) for k in keys), dtype=np.uint64, count=len(keys))
        order = np.argsort(digests, kind="stable")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rules.schema) as out:
            out.write_table(rules.take(pa.array(order)))
        lengths: dict[int, set[int]] = {}
        for h, p in zip(pc.utf8_length(rules["host"]).to_pylist(), pc.utf8_length(rules["path"]).to_pylist(), strict=True):
            lengths.setdefault(h, set()).add(p)
        return digests[order].tobytes(), sink.getvalue().to_pybytes(), sorted((h, sorted(p)) for h, p in lengths.items())

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """Of each url its longest rule (rule, verdict), or None."""
        import xxhash

        owner, parts = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for size, lengths in self.lengths:
                if size == len(host) or size < len(host) and host[-size - 1] == ".":
                    for n in lengths:
                        if n <= len(path):
                            owner.append(i)
                            parts.append((host[-size:], path[:n]))
        best: list[tuple | None] = [None] * len(hosts)
        if len(self.digests) and parts:
            # Urls of one site share most of their keys: each is hashed once.
            keys = pa.array([h + p for h, p in parts], pa.string()).dictionary_encode()
            wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys.dictionary.to_pylist()), dtype=np.uint64, count=len(keys.dictionary))[keys.indices.to_numpy()]
            a, b = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
            for k in np.flatnonzero(a < b):
                for host, path, verdict in zip(*(c.to_pylist() for c in self.rules.slice(a[k], b[k] - a[k]).columns), strict=True):
                    if (host, path) == parts[k]:
                        found = (len(host) + len(path), len(host), host + path, verdict)
                        if best[owner[k]] is None or found > best[owner[k]]:
                            best[owner[k]] = found
        return [x and (x[2], x[3]) for x in best]


def _by_join(urls: DataFrame, rules: DataFrame, url_col: str, default: str) -> DataFrame:
    """The same by an equi-join of keys, for rule sets of any size."""
    sizes = rules.select(F.length("host").alias("size"), F.length("path").alias("len")).distinct()
    lengths = F.broadcast(sizes.agg(F.sort_array(F.collect_set("len")).alias("lens"), F.sort_array(F.collect_set("size")).alias("sizes")))  # one row, of different lengths
    whole = F.length("host")
    fits = F.filter("sizes", lambda n: (n == whole) | ((n < whole) & (F.substring("host", whole - n, F.lit(1)) == ".")))
    suffixes = F.transform(fits, lambda n: F.substring("host", whole - n + 1, n))
    distinct = urls.select(F.col(f"`{url_col}`").alias("_url")).distinct().select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")).where("host <> ''")
    tried = distinct.join(lengths).select("_url", F.explode(suffixes).alias("host"), "path", "lens")
    tried = tried.select("_url", "host", F.explode(F.transform(F.filter("lens", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("path"))
    rank = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict")
    best = tried.join(rules, ["host", "path"]).groupBy("_url").agg(F.max(rank).alias("_best"))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(urls.columns)]).alias("_row")
    joined = urls.select(row, F.col(f"`{url_col}`").alias("_u")).join(best, F.col("_u") == F.col("_url"), "left")
    new = [host_of(F.col("_u")).alias("host"), path_of(F.col("_u")).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")]
    return joined.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(urls.columns)], *new)


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """urls with host, path, rule and verdict (which replace columns of these names). rules: (host, path, verdict)."""
    rules = _clean(rules)
    urls = urls.select(*[F.col(f"`{c}`") for c in urls.columns if c == url_col or c not in dict(OUT)])
    if (rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0) > max_bytes:
        return _by_join(urls, rules, url_col, default)
    shared = urls.sparkSession.sparkContext.broadcast(DigestArray.build(rules.select("host", "path", "verdict").toArrow().cast(pa.schema([(c, pa.string()) for c in ("host", "path", "verdict")]))))  # of checked size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(shared.value)
        for batch in batches:
            found = array.judge(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())
            yield batch.append_column("rule", pa.array([x and x[0] for x in found], pa.string())).append_column("verdict", pa.array([x[1] if x else default for x in found], pa.string()))

    n, url = len(urls.columns), F.col(f"`{url_col}`")
    parts = urls.withColumns({"host": host_of(url), "path": path_of(url)})
    return map_arrow(parts, run, T.StructType([*parts.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


#: The rules of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's url."""
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(urls, spark.createDataFrame(RULES, "host string, path string, verdict string")).drop("url")


QUERIES = {"op8_url_filters": op8_url_filters}
SQL = {
    "op8_url_filters": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (SELECT page_id, max_by(h || rules.p, length(h || rules.p)) AS rule, max_by(v, length(h || rules.p)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)"""
}
