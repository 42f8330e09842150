"""The nearest vectors of each query vector, exactly: blocks of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast and held by a task together.
BLOCK = 1024
#: Blocks of queries that are broadcast, and rows of a block where there are more.
FEW, ROWS = 8, 20_000
#: Rows that are multiplied at once.
PART = 4096
FOUND = ["query_id", "id", "cosine"]


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of their query: the highest scores, of equal ones the least ids."""
    order = np.lexsort((ids, -score, query))
    first = np.searchsorted(query[order], query[order], side="left")
    return order[np.arange(len(order)) - first < k]


def _fold(names: np.ndarray, q: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]], k: int, digits: int) -> list[np.ndarray]:
    """(query, id, cosine) of the k best of each query over all parts (ids, unit vectors)."""
    held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
    for ids, e in parts:
        if not len(names) or not len(ids):
            continue
        score = np.round(q @ e.T, digits)
        score[(names[:, None] == ids[None, :]) | ~np.isfinite(score)] = -np.inf
        least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(names), -np.inf)
        a, b = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        new = [np.concatenate([h, x]) for h, x in zip(held, (names[a], ids[b], score[a, b]), strict=True)]
        keep = _best(*new, k)
        held = [x[keep] for x in new]
    return held


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6, block: int = BLOCK, few: int = FEW, rows_block: int = ROWS) -> DataFrame:
    """(query_id, rank, id, cosine): of each query the k vectors with the highest cosine (rounded), itself excluded; ties by id. Ids are whole numbers.

    Up to ``few`` blocks of queries are broadcast, one after the other, and each task keeps k rows of a block's queries, whatever it reads. More
    queries meet the rows in pairs of blocks that a shuffle deals out; then too only k rows of a query leave a pair. A vector of length zero, or null,
    is near to nothing."""
    only = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where("e IS NOT NULL")
    rows, asked = only(vectors), only(queries)
    n = max(1, -(-asked.count() // block))
    found = _broadcast(rows, asked, n, k, digits) if n <= few else _dealt(rows, asked, n, max(1, -(-rows.count() // rows_block)), k, digits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "cosine")


def _broadcast(rows: DataFrame, asked: DataFrame, n: int, k: int, digits: int) -> DataFrame:
    def of_block(i: int) -> DataFrame:
        table = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).toArrow()  # about ``block`` rows
        shared = rows.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), _unit(table["e"])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART))
            held = _fold(*shared.value, ((p.column(0).to_numpy(), _unit(p.column(1))) for p in parts), k, digits)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=FOUND)

        return rows.mapInArrow(run, "query_id long, id long, cosine double")

    return reduce(DataFrame.unionByName, [of_block(i) for i in range(n)])


def _dealt(rows: DataFrame, asked: DataFrame, n: int, m: int, k: int, digits: int) -> DataFrame:
    """n blocks of queries times m blocks of rows. Rows are dealt by where they stand, so many of one id don't meet in one block."""
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda count: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int")
    left = asked.withColumn("i", own(n)).withColumn("j", every(m))
    right = rows.withColumn("j", own(m)).withColumn("i", every(n))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, e = b["id"].to_numpy(), _unit(b["e"])
        held = _fold(a["id"].to_numpy(), _unit(a["e"]), ((ids[at : at + PART], e[at : at + PART]) for at in range(0, len(ids), PART)), k, digits)
        return pa.table([pa.array(x) for x in held], names=FOUND)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "query_id long, id long, cosine double")


def _unit(lists) -> np.ndarray:
    """Vectors as rows of length one; zero vectors become no numbers."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if not len(lists):
        return np.zeros((0, 0))
    e = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return e / np.sqrt((e * e).sum(axis=1, keepdims=True))
