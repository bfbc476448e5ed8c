"""Shared tables and Arrow plumbing of the subpackage."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

__all__ = ["shared_dir", "new_folder", "written", "table", "on_arrow", "small_batches", "require", "leave_out", "partitions_for", "id_column"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder (zstd) and read back: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; local Python workers are told where the package lies."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; extra ones never reach a shuffle and cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Hold the session's Arrow batches at 8 MB, which bounds what a task and its Python worker keep at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b").removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def _returning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, memory that the C allocator holds free goes back to the system (glibc only).

    Freed arrays otherwise stay with a worker that Spark keeps for the next tasks.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        if trim is not None:
            trim(0)


def on_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose results may be lists of columns in the order of ``schema``."""
    small_batches(df.sparkSession)
    kinds = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in T._parse_datatype_string(schema).fields])

    def run(batches):
        for out in fn(_returning(batches)):
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == k.type else pa.array(x, k.type) for x, k in zip(out, kinds, strict=True)], schema=kinds)

    return df.mapInArrow(run, schema)


def id_column(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of ``counts`` ids each, little-endian unsigned 32-bit.

    Made from buffers: ``pa.array`` never lets go of the memory views that it is given.
    """
    edge = pa.py_buffer(np.append(0, 4 * np.cumsum(counts)).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, edge, pa.py_buffer(flat.astype("<u4").tobytes())])


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "float": pa.float32(), "short": pa.int16()}[
        {"bigint": "long", "int": "integer", "smallint": "short"}.get(kind.simpleString(), kind.simpleString())]


def leave_out(documents: DataFrame, ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The documents whose doc_id is not among ``ids``. Up to ``most`` ids (16 MB) are broadcast, so the texts stay where they are."""
    ids = ids.select(F.col("doc_id").alias("__doc"))
    ids = F.broadcast(ids) if ids.count() <= most else ids
    return documents.join(ids, documents["doc_id"].eqNullSafe(ids["__doc"]), "left_anti")


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    """Partitions so that none gets more than ``per_partition`` rows of evenly spread keys."""
    return max(least, -(-int(rows) // per_partition))

