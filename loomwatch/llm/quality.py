"""Quality rules: compression bands beside plain word and line counts.

The verdict comes from zstandard ratios (compressed bytes / bytes). Repetitive text
compresses far better than prose, random or encoded text far worse; both limits depend on
the text's length, since short inputs compress badly. Ratios are taken of the whole text
and of fixed chunks, so that a long document that is junk in most of its length fails even
if its whole ratio looks usual.

Everything is per row: no shuffle, no state, memory bounded by one Arrow batch.

Cases: a null or empty text has zero counts, fails the base rule and isn't kept. Repeated
rows are judged each for itself. Other columns aren't read by ``quality_report`` and are
passed through by ``keep_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomwatch.llm import vec
from loomwatch.llm.shared import map_arrow

SYMBOLS = vec.table(b"#*$%&|<>")
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " n_bytes long, ratio double, bad_chunks long, n_chunks long, kept boolean"
)


@dataclass(frozen=True)
class CompressionBands:
    """Limits of zstandard ratios. ``bands``: (texts below so many bytes, least ratio, largest ratio)."""

    bands: tuple[tuple[int, float, float], ...] = (
        (256, 0.20, 2.00),
        (1024, 0.25, 0.85),
        (4096, 0.20, 0.80),
        (16384, 0.16, 0.75),
        (1 << 62, 0.12, 0.70),
    )
    chunk: int = 4096
    chunk_band: tuple[float, float] = (0.15, 0.80)
    #: A document fails if more than this share of its whole chunks is outside ``chunk_band``.
    bad_share: float = 0.5
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        return next((lo, hi) for below, lo, hi in self.bands if size < below)


def _repeat_words(hashes: np.ndarray, k: int = 3) -> int:
    """Words inside k-word windows that occur twice or more."""
    if len(hashes) <= k:
        return 0
    w = vec.windows(hashes, k)
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), dtype=bool)
    for j in range(k):
        covered[j : j + len(w)] |= twice
    return int(covered.sum())


def _dup_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _judge(texts: pa.Array, bands: CompressionBands) -> dict[str, np.ndarray]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=bands.level).compress
    raw, offsets = vec.text_bytes(texts)
    words = vec.Words(raw, offsets, lower=False)
    n = words.n
    out = {
        "n_words": words.count.astype(np.int64),
        "word_chars": words.code_points(),
        "n_symbols": vec.per_text(SYMBOLS[raw], offsets),
        "n_dup_lines": np.fromiter((_dup_lines(x) for x in texts.to_pylist()), dtype=np.int64, count=n),
        "n_repeat_words": np.fromiter((_repeat_words(words.hash[a:b]) for a, b in zip(words.at, words.at[1:], strict=False)), dtype=np.int64, count=n),
        "n_bytes": np.diff(offsets).astype(np.int64),
    }
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    ratio, bad, chunks, fits = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    data = memoryview(np.ascontiguousarray(raw))
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if a == b:
            continue
        ratio[i] = len(compress(data[a:b])) / (b - a)
        lo, hi = bands.limits(b - a)
        fits[i] = lo <= ratio[i] <= hi
        for c in range(a, b - bands.chunk + 1, bands.chunk):  # what is left over is judged with the whole
            chunks[i] += 1
            bad[i] += not bands.chunk_band[0] <= len(compress(data[c : c + bands.chunk])) / bands.chunk <= bands.chunk_band[1]
    out |= {"ratio": ratio, "bad_chunks": bad, "n_chunks": chunks}
    out["kept"] = ~out["base_failed"] & fits & (bad <= bands.bad_share * chunks)
    return out


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: CompressionBands = CompressionBands()) -> DataFrame:
    """A row for each document: its counts, ratios and verdict (columns of ``SCHEMA``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vec.chunks(batches, "_text"):
            found = _judge(part.column("_text"), bands)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(found[x.strip()]) for x in names)], names=["_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text").mapInArrow(run, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id_col)


def keep_quality(docs: DataFrame, text_col: str = "text", bands: CompressionBands = CompressionBands()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vec.chunks(batches, text_col):
            yield part.filter(pa.array(_judge(part.column(text_col), bands)["kept"]))

    return map_arrow(docs, run, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject."""
    return keep_quality(docs)


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL: dict[str, str] = {}
