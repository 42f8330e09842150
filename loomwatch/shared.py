"""Where operators keep what all executors must see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session in one process, as in tests, may do without: it gets a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is not None:
        return path
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomwatch-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Tables that ``written`` made and that weren't removed, of the innermost ``settled`` of this thread; other threads have their own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which also cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made."""
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        _delete(df.sparkSession, folder)
        if made := _made.get():
            made[:] = [p for p in made if p.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``written(make(), name)``; the tables that ``make`` wrote itself, which only that one needed, are deleted. Those of other threads, and of
    whoever called this, stay."""
    outer, mine = _made.get(), []
    token = _made.set(mine)
    try:
        df = make()
        out_path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(out_path)
        for path in mine:
            _delete(df.sparkSession, path)
    finally:
        _made.reset(token)
    if outer is not None:
        outer.append(out_path)
    return df.sparkSession.read.schema(df.schema).parquet(out_path)
