"""Rows meet at the keys that they share, and each pair of them once, in blocks that numpy compares as a whole.

A key's rows are cut into spans of time and, where a span has many, into parts by their ids' hashes. A meeting is a pair of parts (or one
part with itself) in a span and the next one. Each row goes to the meetings of its part, so what is shuffled grows with the
rows times a key's parts, and no pair is. Keys of few rows are packed together. A meeting's rows, four parts at most, are
what a task holds; its pairs are made a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from loomwatch.shared import written

#: Rows of a part; keys of so many rows or fewer are packed, and so many rows make a pack.
PART, SMALL, PACK = 4096, 64, 512
#: Rows on each side of a block, and pairs that a task makes.
BLOCK, TASK_PAIRS = 1024, 100_000_000


def dealt(rows: DataFrame, key: str, id_col: str, span: Column, crossed: bool | None = None, part: int | None = None, task_pairs: int | None = None) -> GroupedData:
    """Rows once for each meeting that they go to, grouped by ``meeting`` from the shuffle on: with ``later`` (of the later span), ``second``
    (of the second part) and ``crossed`` (of two parts). Rows that meet no other are left out.

    span: the whole number of a row's span. crossed: only meetings of two parts, or only those of one."""
    rows = rows.withColumn("own", span)
    keys = rows.groupBy(key, "own").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("n"), F.ceil(F.max("n") / (part or PART)).cast("int").alias("parts"), F.sum(F.col("n") * F.col("n")).alias("pairs"), F.collect_set("own").alias("spans"))
    keys = keys.where("n > 1").withColumn("small", F.col("n") <= SMALL)
    keys = written(keys.where("parts > 1 AND NOT small") if crossed else keys, "meeting-keys")
    few, pairs = keys.agg(F.sum(F.when(F.col("small"), F.col("n"))), F.sum("pairs")).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(pairs or 0) // (task_pairs or TASK_PAIRS)))
    of = rows.join(keys.drop("n", "pairs"), key).withColumn("part", F.pmod(F.xxhash64(id_col), "parts").cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    every = every if crossed is None else F.filter(every, lambda q: (q != F.col("part")) if crossed else (q == F.col("part")))
    at = lambda s: F.transform(every, lambda q: F.struct(s.alias("span"), F.least("part", q).alias("low"), F.greatest("part", q).alias("high")))
    before = F.when(F.array_contains("spans", F.col("own") - 1), at(F.col("own") - 1)).otherwise(F.filter(at(F.col("own")), lambda x: F.lit(False)))
    alone = F.array(F.struct(F.col("own").alias("span"), F.lit(0).alias("low"), F.lit(0).alias("high")))
    of = of.withColumn("_m", F.explode(F.when(F.col("small"), alone).otherwise(F.concat(at(F.col("own")), before))))
    pack = F.concat(F.lit("p"), F.pmod(F.xxhash64(key), F.lit(-(-(few or 1) // PACK))).cast("string"))
    meeting = F.when(F.col("small"), pack).otherwise(F.concat_ws("\x1f", F.lit("k"), key, "_m.span", "_m.low", "_m.high"))
    marks = {"meeting": meeting, "later": F.col("own") > F.col("_m.span"), "second": F.col("part") > F.col("_m.low"), "crossed": F.col("_m.low") < F.col("_m.high")}
    return of.withColumns(marks).drop("own", "part", "parts", "spans", "small", "_m").repartition(tasks, "meeting").groupBy("meeting")


def held(batches: Iterator[pa.RecordBatch], id_col: str) -> pa.Table:
    """The rows of a meeting by id."""
    table = pa.Table.from_batches(list(batches))
    return table.take(pc.sort_indices(table[id_col])).combine_chunks()


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers, null as -1."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def blocks(table: pa.Table, id_col: str, key: str, order: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, ok): places of rows of ``held``, and which pairs of them are due here: of one key, the lesser id on the left, no pair twice.

    order: rows of a block stand by it, so that what is made for one row is much like what is made for the next."""
    flags = [table[c].to_numpy().astype(np.int64) for c in ("later", "second")]
    kind, crossed = flags[0] * 2 + flags[1], table["crossed"][0].as_py()
    name, by = codes(table[key]), table[order].to_numpy()
    ids = table[id_col].combine_chunks()
    rank = np.concatenate([[0], np.cumsum(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))])
    cut = [at + np.argsort(by[at : at + BLOCK], kind="stable") for at in range(0, len(rank), BLOCK)]
    parts = [[(k, x[kind[x] == k]) for k in range(4) if (kind[x] == k).any()] for x in cut]
    for i, left in enumerate(parts):
        for right in parts[i:]:
            for k, a in left:
                for m, b in right:
                    if k & m & 2 or crossed and not (k ^ m) & 1:
                        continue
                    x, y = rank[a], rank[b]
                    ok = x[:, None] < y[None, :] if x.max() >= y.min() else np.ones((len(a), len(b)), dtype=bool)
                    if name[0] != name[-1] or (name != name[0]).any():
                        ok &= name[a][:, None] == name[b][None, :]
                    yield a, b, ok


class Sets:
    """Sets of strings, one a row, of which members in common are counted."""

    def __init__(self, column: pa.ChunkedArray, without: pa.ChunkedArray | None = None) -> None:
        """without: of each row a member that isn't counted."""
        lists = column.combine_chunks()
        row, member = pc.list_parent_indices(lists), pc.list_flatten(lists)
        if without is not None:
            keep = pc.not_equal(member, without.combine_chunks().take(row))
            row, member = row.filter(keep), member.filter(keep)
        self.code = member.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.start = np.searchsorted(row.to_numpy(zero_copy_only=False), np.arange(len(lists) + 1))

    def _of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.start[rows + 1] - self.start[rows]
        return np.repeat(np.arange(len(rows)), n), self.code[np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """How many members each of these rows have in common, or nothing if none have any."""
        (i, x), (j, y) = self._of(a), self._of(b)
        if not len(x) or not len(y):
            return None
        order = np.argsort(y, kind="stable")
        j, y = j[order], y[order]
        first = np.searchsorted(y, x, side="left")
        n = np.searchsorted(y, x, side="right") - first
        total = int(n.sum())
        if not total:
            return None
        if total <= 4 * len(a) * len(b):
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(total)
            return np.bincount(np.repeat(i, n) * len(b) + j[at], minlength=len(a) * len(b)).reshape(len(a), len(b))
        both, out = np.intersect1d(x, y), np.zeros((len(a), len(b)), dtype=np.float32)
        for at in range(0, len(both), BLOCK):
            some = both[at : at + BLOCK]
            one, two = (np.zeros((len(r), len(some)), dtype=np.float32) for r in (a, b))
            for m, p, c in ((one, i, x), (two, j, y)):
                in_ = np.isin(c, some)
                m[p[in_], np.searchsorted(some, c[in_])] = 1
            out += one @ two.T
        return out.astype(np.int64)
