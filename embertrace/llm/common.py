"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from embertrace.session import shared_dir

SLICE_ROWS = 1000  # rows of text a Python task holds as Python objects at once


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``. A null id counts as empty text, so its fold is 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder for written tables, below the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/embertrace-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: later steps neither recompute it nor
    depend on an executor that holds it."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], most: int, column: str = "text", rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts have at most ``most`` bytes together; a longer text is a
    slice by itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def schema_with(docs: DataFrame, more: str) -> StructType:
    """The schema of ``docs`` with further columns."""
    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])
