"""Helpers the operators share: reading tables, appending columns; staging in the shared folder is the library's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from msgloom.sources.staging import discard, shared_folder, staged

__all__ = ["append_columns", "discard", "fresh", "named", "shared_folder", "slices", "staged", "table"]

#: Bounds of what a Python task holds at once: rows and bytes of one slice of an Arrow batch.
SLICE_ROWS = 1024
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with a number the first such name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    k = 0
    while (found := f"{name}_{k}" if k else name).lower() in taken:
        k += 1
    return found


def named(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{n}`") for n in names]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS rows and about SLICE_BYTES bytes; a larger row stands alone."""
    rows = batch.num_rows
    step = rows
    if rows:
        step = int(max(1, min(SLICE_ROWS, rows * SLICE_BYTES // max(1, batch.nbytes))))
    for start in range(0, rows, step or 1):
        yield batch.slice(start, step)


def append_columns(df: DataFrame, inputs: list[str], ddl: str, make: Callable, into: str | None = None) -> DataFrame:
    """``df`` with the columns of ``ddl`` added, without a shuffle; with ``into`` as one struct column of that name.

    ``make()`` runs once a task and returns a function from the input columns (lists of
    Python values) to one list a new column. A column of ``df`` that has the name of a
    new one is replaced; a caller that must keep it gives a fresh name as ``into``.
    """
    added = StructType.fromDDL(ddl)
    fields = added.fields if into is None else [StructField(into, added)]
    new = {f.name.lower() for f in fields}
    used = [c for c in df.columns if c.lower() not in new or c in inputs]
    # by place, as a map over batches takes no names with dots
    base = df.select(*(column.alias(f"c{k}") for k, column in enumerate(named(used))))
    keep = [k for k, c in enumerate(used) if c.lower() not in new]
    places = [used.index(c) for c in inputs]
    schema = StructType([df.schema[used[k]] for k in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        step = make()
        for batch in batches:
            for part in slices(batch):
                got = step(*(part.column(k).to_pylist() for k in places))
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(got, kinds, strict=True)]
                if into is not None:
                    made = [pa.StructArray.from_arrays(made, names=added.names)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + made, names=schema.names)
        # the worker goes on to other tasks
        del step
        pa.default_memory_pool().release_unused()

    return base.mapInArrow(run, schema)
