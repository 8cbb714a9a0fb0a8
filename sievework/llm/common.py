"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.session import raw_table, scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_table(spark, sf_dir, "documents")


# Rows of megabytes: Parquet would look at the size of a row group only every 100
# rows or more, and both its writer and its reader hold one in memory.
WIDE = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4, "parquet.page.size.row.check.min": 1}


def saved(df: DataFrame, name: str, codec: str = "zstd", wide: bool = False) -> DataFrame:
    """Writes to the shared folder and reads back, so that later steps neither
    compute ``df`` again nor depend on the executors that did. ``wide``: in small
    row groups, for rows of megabytes."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).options(**WIDE if wide else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SENT = 50_000


def counted(made: DataFrame) -> DataFrame:
    """A stored table as one side of a join: with more than SENT rows it is dealt.
    Spark would go by its compressed files, and what it sends whole takes the driver
    many times their size."""
    return made if made.limit(SENT + 1).count() <= SENT else made.hint("merge")


def release_memory() -> None:
    """Gives freed memory back to the system. Spark keeps Python workers from stage
    to stage, and what each stage has freed but kept would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_MODEL: dict[tuple, Any] = {}


def one_model(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, once in each worker process. A worker holds one model
    at a time: that of an earlier stage goes before the next is built, and what
    building took is given back, so that no stage pays for the others' models."""
    if key not in _MODEL:
        _MODEL.clear()
        release_memory()
        _MODEL[key] = build()
        release_memory()
    return _MODEL[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that Python copies stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release_memory()


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold at most ``most`` bytes of a text column,
    or one longer text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, upto - at)
            at = upto
    release_memory()


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the wanted columns, whatever else the table holds."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(),
    "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat ``name type, ...`` text; types may be arrays."""
    fields = []
    for field in ddl.split(","):
        name, kind = field.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append((name, pa.list_(_ARROW[inner]) if kind.startswith("array<") else _ARROW[kind]))
    return pa.schema(fields)


def arrow_rows(ddl: str, columns: list) -> pa.RecordBatch:
    """A record batch of column values in the order of ``ddl``."""
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
