"""A training-data pipeline: each stage gets all documents that the stage before kept.

All stages but the last return the columns of ``documents``; the last adds token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwatch.llm.decontaminate import decontamination_stage
from loomwatch.llm.jaccard import jaccard_stage
from loomwatch.llm.line_dedup import line_dedup_stage
from loomwatch.llm.pieces import sentencepiece_stage
from loomwatch.llm.quality import quality_stage
from loomwatch.llm.shared import remove, settled

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Compression ratios and token ids have no SQL; ``tests/llm/test_pipeline.py`` compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if number:
            remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
