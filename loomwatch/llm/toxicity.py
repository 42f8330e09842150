"""Toxicity: a factorization machine over hashed terms.

A text's features are the hashed terms that occur in it: its words, and their first four and
five bytes, which endings don't change. The machine's score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j),     x_i = 1 if term i occurs,

so a pair of terms, such as an insult and the mention of a group, can weigh more, or less,
than both alone.

Which terms are features is decided by counts over all labelled training rows: those whose
likelihood ratio with the label is ``least_ratio`` or more, a fixed level of significance, so
their number follows the rows and not a cap (it is at most the number of hash buckets, which
also bounds the broadcast weights). The weights are fitted by Adam on a bounded sample of the
rows: ``max_rows`` rows, the first by a hash of the id. Small samples get more epochs, so that
there are ``least_steps`` steps at least, and a stronger decay. Scoring is one pass over the
texts.

Cases: null and empty texts have no terms and get sigmoid(w0); without training rows, or with
one label only, all scores are the share of toxic rows (0 without rows); rows without a label
aren't trained on; repeated labels of an id count as its largest; repeated documents count
each; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm import vec

BUCKETS_BITS = 24
#: Rows of the label table that may be broadcast (16 bytes each); larger ones are joined by a shuffle.
FEW = 1_000_000


@dataclass(frozen=True)
class Settings:
    #: A term's G statistic; 10.83 is exceeded by one unrelated term in a thousand.
    least_ratio: float = 10.83
    min_docs: int = 4
    max_rows: int = 20_000
    factors: int = 8
    epochs: int = 15
    batch: int = 128
    rate: float = 0.02
    least_steps: int = 600
    decay: float = 2e-3
    #: Added to ``decay``, divided by the number of rows.
    row_decay: float = 8.0
    seed: int = 7


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, hashed term) of all terms, each once a text, and the number of texts."""
    words = vec.Words(*vec.text_bytes(texts), separators=vec.NOT_ALNUM)
    raw = np.concatenate([vec.LOWER[words.raw], np.zeros(8, dtype=np.uint8)])
    size = words.end - words.start
    kinds = [words.hash]
    for n in (4, 5):
        h = np.full(len(size), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(257) + np.where(j < size, raw[words.start + j], 0).astype(np.uint64)
        kinds.append(vec.mix(h))
    doc = np.tile(words.doc, len(kinds)).astype(np.uint64)
    both = np.unique((doc << np.uint64(BUCKETS_BITS)) | (np.concatenate(kinds) >> np.uint64(64 - BUCKETS_BITS)))
    return (both >> np.uint64(BUCKETS_BITS)).astype(np.int64), (both & np.uint64((1 << BUCKETS_BITS) - 1)).astype(np.int64), words.n


def _counts(train: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many training texts a term occurs. train: (_text, _label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BUCKETS_BITS), dtype=np.int32)
        for part in vec.chunks(batches, "_text"):
            doc, term, _ = _terms(part.column("_text"))
            label = part.column("_label").to_numpy(zero_copy_only=False)[doc]
            for y in (0, 1):
                at, n = np.unique(term[label == y], return_counts=True)
                held[y, at] += n.astype(np.int32)
        at = np.flatnonzero(held.any(axis=0))
        for a in range(0, len(at), 1 << 16):
            i = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(held[1, i], pa.int64()), pa.array(held[0, i], pa.int64())], names=["term", "toxic", "clean"])

    return train.mapInArrow(run, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _choose(counts: DataFrame, n_toxic: int, n_clean: int, settings: Settings) -> np.ndarray:
    """The terms whose likelihood ratio with the label is large enough, sorted."""
    a, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n = float(n_toxic + n_clean)

    def part(x: Column, row: Column, all_: float) -> Column:
        return F.when(x > 0, x * F.log(x * n / (row * all_))).otherwise(0.0)

    has, lacks = a + c, F.lit(n) - a - c
    ratio = part(a, has, float(n_toxic)) + part(c, has, float(n_clean)) + part(n_toxic - a, lacks, float(n_toxic)) + part(n_clean - c, lacks, float(n_clean))
    rows = counts.where((F.col("toxic") + F.col("clean") >= settings.min_docs) & (2 * ratio >= settings.least_ratio)).select("term").toPandas()  # at most 2^24 numbers
    return np.sort(rows["term"].to_numpy(dtype=np.int64))


def _features(texts: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, place of the term in chosen) and the number of texts."""
    doc, term, n = _terms(texts)
    if not len(chosen):
        return doc[:0], term[:0], n
    at = np.minimum(np.searchsorted(chosen, term), len(chosen) - 1)
    keep = chosen[at] == term
    return doc[keep], at[keep], n


@dataclass
class Machine:
    """A fitted factorization machine."""

    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        if not len(self.terms):
            return np.full(n, self.w0)
        z = self.w0 + np.bincount(doc, weights=self.w[at], minlength=n)
        for k in range(self.v.shape[1]):
            x = self.v[at, k]
            z += 0.5 * (np.bincount(doc, weights=x, minlength=n) ** 2 - np.bincount(doc, weights=x * x, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def gradient(p: np.ndarray, w0: float, rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the mean logistic loss over some rows, by p (weights, then factors) and w0."""
    used, place = np.unique(np.concatenate(rows), return_inverse=True)
    x = np.zeros((len(rows), len(used)))
    x[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), place] = 1.0
    w, v = p[used, 0], p[used, 1:]
    sums = x @ v
    z = w0 + x @ w + 0.5 * ((sums**2).sum(axis=1) - x @ (v**2).sum(axis=1))
    e = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) / len(rows)
    linear = x.T @ e
    g = np.zeros_like(p)
    g[used] = np.column_stack([linear, x.T @ (e[:, None] * sums) - linear[:, None] * v])
    return g, float(e.sum())


def fit(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Machine:
    """Adam on the logistic loss; rows hold places in ``terms``."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not len(terms) or share in (0.0, 1.0):
        return Machine(terms[:0], share, np.zeros(0), np.zeros((0, settings.factors)))
    rng = np.random.default_rng(settings.seed)
    d, k, n = len(terms), settings.factors, len(rows)
    at = np.concatenate(rows).astype(np.int64)
    cut = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    p = np.zeros((d, k + 1))
    p[:, 1:] = rng.normal(0, 0.02, (d, k))
    w0, m0, s0 = np.log(share / (1 - share)), 0.0, 0.0
    m, s, t = np.zeros_like(p), np.zeros_like(p), 0
    decay = settings.decay + settings.row_decay / n
    for _ in range(max(settings.epochs, -(-settings.least_steps * settings.batch // n))):
        order = rng.permutation(n)
        for a in range(0, n, settings.batch):
            b = order[a : a + settings.batch]
            g, g0 = gradient(p, w0, [at[cut[i] : cut[i + 1]] for i in b], labels[b])
            t += 1
            m = 0.9 * m + 0.1 * g
            s = 0.999 * s + 0.001 * g * g
            p -= settings.rate * ((m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8) + decay * p)
            m0, s0 = 0.9 * m0 + 0.1 * g0, 0.999 * s0 + 0.001 * g0 * g0
            w0 -= settings.rate * (m0 / (1 - 0.9**t)) / (np.sqrt(s0 / (1 - 0.999**t)) + 1e-8)
    return Machine(terms, float(w0), p[:, 0].copy(), p[:, 1:].copy())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Machine:
    """Fits a machine to the labelled documents."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    few = labels.count() <= FEW
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known) if few else known, "_id")
    texts = rows.select("_text", "_label")
    n = {r._label: r.n for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two labels
    chosen = _choose(_counts(texts), n.get(1, 0), n.get(0, 0), settings) if n.get(1) and n.get(0) else np.zeros(0, dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vec.chunks(batches, "_text"):
            doc, at, size = _features(part.column("_text"), shared.value)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=size))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(np.int32)))], names=["_id", "_label", "at"])

    kind = docs.schema[id_col].dataType.simpleString()
    total = sum(n.values())
    if total > settings.max_rows:
        # Hashes below a bound hold the first ``max_rows`` rows and few more; if ids repeat so that they don't, all rows are sorted.
        bound = -(1 << 63) + int(1.2 * settings.max_rows / total * (1 << 64))
        low = rows.where(F.xxhash64("_id") <= bound) if bound < 1 << 63 else rows
        rows = low if low.select("_id").limit(settings.max_rows).count() == settings.max_rows else rows
    sample = rows.mapInArrow(run, f"_id {kind}, _label int, at array<int>").orderBy(F.xxhash64("_id"), "_id").limit(settings.max_rows).select("_label", "at").toArrow()  # max_rows rows
    lists = sample["at"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    places = lists.flatten().to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return fit(chosen, [places[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], sample["_label"].to_numpy().astype(float), settings)


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vec.chunks(batches, "_text"):
            score = shared.value.score(*_features(part.column("_text"), shared.value.terms))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(score.astype(float)), pa.array((score >= threshold).astype(np.int32))], names=["_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from two thirds of the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out)
    return score_toxicity(docs, train(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
