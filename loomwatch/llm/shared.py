"""What operators of this subpackage share: the folder that all executors see, and row-wise Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwatch.shared import remove, settled, shared_dir, written

__all__ = ["map_arrow", "remove", "settled", "shared_dir", "written"]


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for any column names: that one can't read names with dots."""
    names = df.columns
    safe = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema.fields)])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=safe.names)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks, which need the memory

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(inner, safe).toDF(*schema.names)
