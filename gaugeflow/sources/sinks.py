"""Output layouts."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("station_id", "year")) -> None:
    """One folder per partition value; only the partitions in ``df`` are replaced.

    Rows are grouped by partition before writing so that a folder gets few files; adaptive
    execution splits the partitions that are too large.
    """
    (df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def write_texts(files: DataFrame, folder: str) -> DataFrame:
    """One text file below ``folder`` per row (``name``, ``content``); a table of the names and their bytes.

    Each task writes its own files under a name of its attempt and renames them, so a repeated task
    leaves the same files. Rows must fit a task; split long contents over several names.
    """

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (content or "").encode()
                with store.open_output_stream(f"{root}/.{name}.{attempt}") as out:
                    out.write(data)
                store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return materialise(files.select("name", "content").mapInArrow(run, "name string, bytes long"), "text-files")


def unfinished(keys: DataFrame, done: DataFrame, by: tuple[str, ...] = ("station_id", "year")) -> DataFrame:
    """Keys whose output does not exist yet."""
    return keys.join(done.select(*by).distinct(), list(by), "left_anti")


def prediction_layout(df: DataFrame) -> DataFrame:
    """The fixed five columns: amounts not negative, missing outputs null, single precision."""
    cols = []
    for c in ("p_rain", "y_hat", "q90"):
        v = F.col(c) if c in df.columns else F.lit(None)
        if c == "y_hat":
            v = F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))
        cols.append(v.cast("float").alias(c))
    return df.select("station_id", "minute", *cols)


def write_predictions(df: DataFrame, root: str, bench: str, model: str, split: str) -> str:
    """Forecasts of one model and split; an empty split still leaves a readable file."""
    path = f"{root.rstrip('/')}/bench={bench}/model={model}/split={split}"
    prediction_layout(df).write.mode("overwrite").parquet(path)
    return path
