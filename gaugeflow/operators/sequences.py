"""Windows for sequence models: scaling, construction and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rain import is_rain_like, rain_rate_transform
from .channels import ALL_CHANNELS
from .halo import CHUNK, Slices


def sequence_channels(df: DataFrame) -> list[str]:
    """Input channels: all but the reporting flag, plus any radar columns, in a fixed order."""
    extra = sorted(c for c in df.columns if c.startswith(("radar_", "nowcast_")))
    return [c for c in ALL_CHANNELS if c != "rain_avail" and c in df.columns] + extra


def channel_scaler(df: DataFrame, channels: list[str]) -> DataFrame:
    """One row: mean and population deviation of every channel that is not rain, over all finite rows.

    A deviation below 1e-6 counts as 1.
    """
    aggs = []
    for c in channels:
        if not is_rain_like(c):
            v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
            sd = F.stddev_pop(v)
            aggs += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{c}__mean"), F.when(sd > 1e-6, sd).otherwise(F.lit(1.0)).alias(f"{c}__std")]
    return df.agg(*aggs)


def scaled(df: DataFrame, channels: list[str], scaler: DataFrame) -> DataFrame:
    """Channels on the network's scale; the scaler is a single row."""
    s = F.col("scale_")
    j = df.withColumn("scale_", scaler.select(F.struct(*scaler.columns)).scalar())
    cols = {c: rain_rate_transform(c, F.col(c)) if is_rain_like(c)
            else rain_rate_transform(c, F.col(c), s[f"{c}__mean"], s[f"{c}__std"]) for c in channels}
    return j.withColumns(cols).select(*df.columns)


def sequence_windows(df: DataFrame, channels: list[str], length: int, slices: Slices = Slices(), wanted: Column | None = None,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """The last ``length`` rows x channels block of each wanted row of a dense series; rows with less history drop out.

    A slice of a series is gathered once (its size is fixed by the slicing) and only the blocks of
    wanted rows are cut out of it, so a sparse training sample does not pay for the other rows.
    """
    s = slices
    cols = list(dict.fromkeys([*s.keys, s.order, *keep]))
    want = F.col(CHUNK) == s.number()
    if wanted is not None:
        want = want & F.coalesce(wanted, F.lit(False))
    item = F.struct(F.col(s.order).alias("at"), want.alias("want"), F.array(*[F.col(c).cast("float") for c in channels]).alias("x"),
                    F.struct(*[c for c in cols if c not in s.keys]).alias("row"))
    d = s.widen(df, length - 1).groupBy(*s.keys, CHUNK).agg(F.sort_array(F.collect_list(item)).alias("s_"))
    ends = F.filter(F.sequence(F.lit(length - 1), F.size("s_") - 1), lambda i: F.get("s_", i)["want"])
    block = lambda i: F.struct(F.get("s_", i)["row"].alias("row"), F.transform(F.slice("s_", i - length + 2, length), lambda e: e["x"]).alias("x"))
    d = d.where(F.size("s_") >= length).select(*s.keys, F.explode(F.transform(ends, block)).alias("b"))
    return d.select(*s.keys, *[F.col("b.row")[c].alias(c) for c in cols if c not in s.keys], F.col("b.x").alias("x"))


def batch_window_predict(windows: DataFrame, model: Callable[[np.ndarray], pd.DataFrame]) -> DataFrame:
    """Score blocks with any Python model: array (n, length, channels) in, p_rain / y_hat / q90 out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.stack(v) for v in pdf["x"]]).astype("float32")
                yield pd.concat([pdf[["station_id", "minute"]].reset_index(drop=True), model(x).reset_index(drop=True)], axis=1)

    return windows.select("station_id", "minute", "x").mapInPandas(run, "station_id string, minute long, p_rain double, y_hat double, q90 double")
