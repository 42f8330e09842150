"""Keyed state of streams as a table in hash buckets, of which a batch reads and writes only those its keys fall in.

Rows are Parquet files under ``data/v=<version>/_b=<bucket>``. A manifest says for each bucket which version of it
counts; a batch writes new versions of its buckets and then renames a new manifest into place, so readers see all of
a batch or nothing, and a batch that failed on its way is written again by the next attempt. A batch whose number is
committed already changes nothing. One writer at a time; the file system must rename files atomically (HDFS, local disks).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Folder:
    """Files that the driver itself lists, writes and removes: manifests and the names of buckets."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(name))) if self.exists(name) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def text(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a new file in one step: it's there whole or not at all."""
        made = f"{name}.{uuid.uuid4().hex}.made"
        stream = self.fs.create(self._at(made))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self.fs.rename(self._at(made), self._at(name)):
            self.remove(made)
            raise RuntimeError(f"{self.path}/{name} was written by another one")

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class StateTable:
    """Rows by key. ``by``: the keys whose hash is the bucket, by default all."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path, list(keys), list(by or keys), buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.folder = Folder(spark, path)

    def version(self) -> int:
        """Of the last commit; -1 if there is none."""
        return max((int(x[:-5]) for x in self.folder.names("manifests") if x.endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows."""
        version = self.version() if version is None else version
        return {int(b): v for b, v in json.loads(self.folder.text(f"manifests/{version:012d}.json")).items()} if version >= 0 else {}

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in self.by]), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall in: at most ``buckets`` numbers reach the driver."""
        return sorted(r.b for r in rows.select(self.bucket_of().alias("b")).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of some buckets, or all."""
        held = self.manifest(version)
        paths = [f"{self.path}/data/v={held[b]}/_b={b}" for b in (sorted(held) if buckets is None else buckets) if b in held]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows whose values of ``keys``' columns (``by`` and perhaps more of the keys) are among these; only their buckets are read."""
        names = [c for c in self.keys if c in keys.columns]
        wanted = keys.select(*names).distinct()
        return self.read(self.buckets_of(wanted)).join(wanted, names, "left_semi")

    def apply(self, batch: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None) -> list[int]:
        """Replaces the rows of the batch's buckets by fold(those rows, batch), and says which buckets these are.

        The batch has the columns of ``by`` at least, rows without one of them are left out; fold may give rows of these buckets
        only. number: of the batch; one that is committed already is left alone."""
        last = self.version()
        number = last + 1 if number is None else number
        if number <= last:
            return []
        batch = batch.dropna(subset=self.by).persist()
        try:
            touched = self.buckets_of(batch)
            held, data = self.manifest(last), f"data/v={number}"
            if touched:
                rows = fold(self.read(touched, last), batch).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
                rows.withColumn("_b", self.bucket_of()).repartition(len(touched), "_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/{data}")
                made = {int(x[3:]) for x in self.folder.names(data) if x.startswith("_b=")}
                if odd := sorted(made - set(touched)):
                    raise ValueError(f"rows of buckets that the batch doesn't touch: {odd}")
                held = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(made, number)
            self.folder.put(f"manifests/{number:012d}.json", json.dumps(held, sort_keys=True))
        finally:
            batch.unpersist()
        return touched

    def put(self, rows: DataFrame, number: int | None = None, seq: str | None = None) -> list[int]:
        """Rows replace those of their keys; of several with one key the last by ``seq`` counts, or any."""
        names = [f.name for f in self.schema]

        def fold(old: DataFrame, new: DataFrame) -> DataFrame:
            new = new.dropna(subset=self.keys)
            one = new.groupBy(*self.keys).agg(F.max_by(F.struct(*names), seq).alias("_r")).select("_r.*") if seq else new.select(*names).dropDuplicates(self.keys)
            return old.join(one.select(*self.keys), self.keys, "left_anti").unionByName(one)

        return self.apply(rows, fold, number)

    def delete(self, keys: DataFrame, number: int | None = None) -> list[int]:
        """Rows of these keys (columns as in ``get``) go."""
        names = [c for c in self.keys if c in keys.columns]
        return self.apply(keys.select(*names).distinct(), lambda old, gone: old.join(gone, names, "left_anti"), number)

    def sink(self, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda batch, number: self.apply(batch, fold, number) and None

    def clean(self, keep: int = 1) -> list[int]:
        """Removes manifests but the last ``keep``, and the buckets' versions that none of these names; says which versions went whole."""
        numbers = sorted(int(x[:-5]) for x in self.folder.names("manifests") if x.endswith(".json"))
        kept = numbers[-keep:]
        needed = {(v, b) for n in kept for b, v in self.manifest(n).items()}
        gone = []
        for n in numbers[:-keep]:
            self.folder.remove(f"manifests/{n:012d}.json")
        for x in self.folder.names("data"):
            v = int(x[2:])
            if v > kept[-1]:  # being written
                continue
            held = [b for b in self.folder.names(f"data/{x}") if b.startswith("_b=")]
            for b in held:
                if (v, int(b[3:])) not in needed:
                    self.folder.remove(f"data/{x}/{b}")
            if not any((v, int(b[3:])) in needed for b in held):
                self.folder.remove(f"data/{x}")
                gone.append(v)
        return gone


def nodes_table(spark: SparkSession, path: str, schema: str, keys: list[str], last: list[str], first: list[str] = (), buckets: int = 64) -> tuple[StateTable, Callable[[DataFrame, int], None]]:
    """A node table and its sink, which folds micro-batches (with ``seq``) in by ``upsert_nodes``."""
    from loomwatch.operators.graph import upsert_nodes

    table = StateTable(spark, path, schema, keys, buckets=buckets)
    return table, table.sink(lambda old, batch: upsert_nodes(old, batch, keys, last, first))
