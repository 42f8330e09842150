"""Importance resampling towards a target: documents are drawn by how much likelier their hashed word n-grams are in the target.

A feature is a run of 1 to ``longest`` words; its bucket is its bytes' CRC-32 modulo ``buckets``. A task keeps
its words in a trie: a node is a feature, its parent the feature without the last word, and it holds how often
it was met and its CRC, which goes on from its parent's. What the tries count is summed by bucket, so that a
task sends ``buckets`` rows at most, and the totals of all tasks are merged. From the totals of documents and
target each bucket gets a gain. Documents are then scored in a second pass: the gain is attached to each node
when it is made, and a document's weight is the mean over the trie paths that it walks. A trie that has
``NODES`` nodes is summed by bucket and begun anew, so a task's memory is bounded; results don't depend on it.

The draw adds noise from the document's id to its weight (the largest ``share`` percent of such sums are a
sample without replacement). Ranks come from one range sort: a row's rank is its place in its part plus the
sizes of the parts before, of which the driver gets one number each. Rows that are equal in score and id are
told apart by their place in the scored table, so no key is too frequent to be split.

Cases: null is no words; no features: weight 0; without any rows of the target, all is by the corpus' counts alone;
repeated rows are drawn each for itself, equal ones in any order; rows without an id have no score, aren't
counted for the share and aren't drawn; other columns aren't read. A very long text needs some hundred bytes a word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwatch.llm import vec
from loomwatch.llm.runs import intern_words
from loomwatch.llm.shared import remove, written

BUCKETS = 10_000
#: Nodes of a task's trie before it is begun anew.
NODES = 1 << 20
CHUNK = 1 << 21


class Trie:
    """Features as nodes: by number their CRC, how often they were met, and their gain."""

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None):
        self.longest, self.buckets, self.gains_of = longest, buckets, gains
        self.totals = np.zeros(buckets, dtype=np.int64)
        self._begin()

    def _begin(self) -> None:
        self.words: dict[bytes, int] = {}
        self.children: dict[tuple[int, int], int] = {}
        self.n, self.word_of = 0, {}
        self.crc, self.count, self.gain = np.zeros(1024, dtype=np.uint32), np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)

    def _add(self, crc: list[int]) -> None:
        while self.n + len(crc) > len(self.crc):
            self.crc, self.count, self.gain = (np.concatenate([a, np.zeros_like(a)]) for a in (self.crc, self.count, self.gain))
        new = slice(self.n, self.n + len(crc))
        self.crc[new] = crc
        if self.gains_of is not None:
            self.gain[new] = self.gains_of[self.crc[new] % self.buckets]
        self.n += len(crc)

    def _first(self, names: list[bytes]) -> np.ndarray:
        """The nodes of single words."""
        new = [x for x in names if x not in self.words]
        for i, x in enumerate(new, self.n):
            self.words[x] = i
            self.word_of[i] = x
        self._add([zlib.crc32(x) for x in new])
        return np.array([self.words[x] for x in names], dtype=np.int64)

    def _next(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        """The nodes of features (parent, node of the word behind it)."""
        new = [x for x in pairs if x not in self.children]
        for i, x in enumerate(new, self.n):
            self.children[x] = i
        self._add([zlib.crc32(b" " + self.word_of[w], int(self.crc[p])) for p, w in new])
        return np.array([self.children[x] for x in pairs], dtype=np.int64)

    def paths(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node of each feature, its text's number, words by text), for each length of features; a node may be read until the next call."""
        if self.n >= NODES:
            self.merge()
            self._begin()
        raw, offsets = vec.text_bytes(texts)
        words = vec.Words(vec.LOWER[raw], offsets, vec.NOT_ALNUM, lower=False)
        ids, first = intern_words(words)
        data = words.raw.tobytes()
        single = self._first([data[s:e] for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)])[ids] if len(ids) else ids
        node, place = single, np.arange(len(ids))
        yield node, words.doc, words.count
        for k in range(2, self.longest + 1):
            go = np.flatnonzero(place + k <= words.at[words.doc[place] + 1])
            place, parent, word = place[go], node[go], single[place[go] + k - 1]
            key, which = np.unique(parent << 32 | word, return_inverse=True)
            node = self._next([(x >> 32, x & 0xFFFFFFFF) for x in key.tolist()])[which] if len(key) else parent
            yield node, words.doc[place], words.count

    def add(self, texts: pa.Array) -> None:
        for node, _, _ in self.paths(texts):
            self.count[: self.n] += np.bincount(node, minlength=self.n)

    def merge(self) -> None:
        """The nodes' counts go to their buckets."""
        np.add.at(self.totals, self.crc[: self.n] % self.buckets, self.count[: self.n])
        self.count[:] = 0

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its words, features, and the sum of its features' gains."""
        features, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        count = features
        for node, doc, count in self.paths(texts):  # noqa: B007
            features = features + np.bincount(doc, minlength=len(texts))
            np.add.at(total, doc, self.gain[node])
        return count.astype(np.int64), features, total


def bucket_totals(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all texts; a row for each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, buckets)
        for part in vec.chunks(batches, "_text", CHUNK):
            trie.add(part.column("_text"))
        trie.merge()
        some = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(trie.totals[some])], names=["bucket", "n"])

    return docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the natural logarithm of how much likelier a bucket is in the target, rounded down; one is added to each count."""
    s, t = sum(corpus.values()), sum(target.values())
    ratio = lambda b: (float(target.get(b, 0) + 1) * float(s + buckets)) / (float(corpus.get(b, 0) + 1) * float(t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, len(shared.value), shared.value)
        for part in vec.chunks(batches, "_text", CHUNK):
            words, features, total = trie.score(part.column("_text"))
            weight = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([part.column("_id"), *map(pa.array, (words, features, weight))], names=["_id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_words long, n_features long, weight long").withColumnRenamed("_id", id_col)


def ranked(rows: DataFrame, order: list, within: int, name: str = "rank") -> DataFrame:
    """rows with their place in the order, from 1 on; null beyond ``within``. The order must tell all rows apart."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the part
    parts = written(parts.withColumns({"_part": F.spark_partition_id(), "_place": place}), name)
    sizes = parts.groupBy("_part").count()  # a row for each part
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    at = F.col("_before") + F.col("_place") + 1
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.when(at <= within, at)).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1, buckets: int = BUCKETS, share: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id, n_features, weight, score, rank) of each document; those drawn have a rank."""
    counted = [{r.bucket: r.n for r in bucket_totals(d, c, longest, buckets).collect()} for d, c in ((docs, text_col), (target, target_text_col))]  # ``buckets`` rows at most
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((key + 0.5) / 4294967296)))
    scored = weights(docs, gains(*counted, buckets), id_col, text_col, longest).withColumns({"score": F.col("weight") + noise, "_row": F.monotonically_increasing_id()})
    scored = written(scored, "resample-scored")
    takes_part = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    n = scored.where(takes_part).count()
    drawn = ranked(scored.where(takes_part), [F.col("score").desc(), F.col(f"`{id_col}`"), F.col("_row")], share * n // 100)
    rest = scored.where(~takes_part).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col(f"`{id_col}`"), "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's words."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_resample": op13_resample}
SQL = {
    "op13_resample": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word
), bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY word
), words AS (SELECT DISTINCT word FROM dw UNION SELECT word FROM bw
), steps AS (  -- the CRC's table: eight shifts of each byte
  SELECT list(c ORDER BY i) AS step FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i))
), bytes AS (SELECT word, hex(encode(word)) AS h FROM words
), crc AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, steps
), s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN crc USING (word) GROUP BY bucket
), t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM bw JOIN crc USING (word) GROUP BY bucket
), gain AS (
  SELECT i AS bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS g
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i
), mean AS (SELECT r, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, r, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN mean USING (r)
), drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20 AND score IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN drawn USING (r)"""
}
