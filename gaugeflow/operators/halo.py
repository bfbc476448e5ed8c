"""Time-sliced windows.

A window partitioned by station alone puts a whole station into one task. These helpers slice
every station by time and copy the few neighbouring rows each slice needs (its halo), so frames
of bounded length give the same result as on the unsliced series while the largest window
partition stays ``chunk + back + ahead`` rows, whatever share of the data one station holds.
Running totals that reach back without bound go through ``prefix_over_chunks``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..clock import floor_div

CHUNK = "chunk_"


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Spread few rows over all tasks because each is about to become many.

    The explicit number keeps adaptive execution from merging the small partitions again: it sizes
    them by the rows before the expansion.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the planner's own size estimate allows broadcasting ``df`` (driver-side, no job)."""
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


@dataclass(frozen=True)
class Slices:
    """How series are cut: ``chunk`` ticks per slice along ``order``, within ``keys``."""

    chunk: int = 10_080
    keys: tuple[str, ...] = ("station_id",)
    order: str = "minute"

    def number(self) -> Column:
        return floor_div(F.col(self.order), self.chunk)

    def widen(self, df: DataFrame, back: int = 0, ahead: int = 0) -> DataFrame:
        """Copy each row to every slice that can see it."""
        first = floor_div(F.col(self.order) - F.lit(ahead), self.chunk)
        last = floor_div(F.col(self.order) + F.lit(back), self.chunk)
        return df.withColumn(CHUNK, F.explode(F.sequence(first, last)))

    def own(self, df: DataFrame) -> DataFrame:
        """Drop the halo copies again."""
        return df.where(F.col(CHUNK) == self.number()).drop(CHUNK)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(self.order)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def frame(self, back: int, ahead: int = 0) -> WindowSpec:
        return self.window().rowsBetween(-back, ahead)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK)


def last_seen(s: Slices, flag: Column) -> Column:
    """Index of the latest tick at or before the row where ``flag`` holds (null if none)."""
    return F.last(F.when(flag, F.col(s.order)), ignorenulls=True).over(s.running())


def age_since(s: Slices, flag: Column, cap: int) -> Column:
    """Ticks since ``flag`` last held, at most ``cap``; ``cap`` if it never did."""
    seen = last_seen(s, flag)
    return F.coalesce(F.least(F.col(s.order) - seen, F.lit(cap)), F.lit(cap)).cast("long")


def carry_forward(s: Slices, value: Column, limit: int) -> Column:
    """Latest non-null value not older than ``limit`` ticks."""
    seen = F.last(F.when(value.isNotNull(), F.struct(F.col(s.order).alias("m"), value.alias("v"))),
                  ignorenulls=True).over(s.running())
    return F.when(F.col(s.order) - seen["m"] <= limit, seen["v"])


def add_rolling_sums(df: DataFrame, s: Slices, specs: Sequence[tuple[str, Column, int]],
                     digits: int = 9) -> DataFrame:
    """Sums over the last ``w`` rows as differences of one running total per distinct value.

    Spark re-adds a sliding frame for every row; the difference costs two lookups instead.
    Rounding removes the floating noise of the subtraction (gauges report 0.01 mm).
    """
    totals, sums = {}, {}
    for i, (_, value, _) in enumerate(specs):
        if str(value) not in totals:
            totals[str(value)] = f"total_{i}_"
            sums[f"total_{i}_"] = F.sum(F.coalesce(value, F.lit(0))).over(s.running())
    df = df.withColumns(sums)
    w = s.window()
    cols = {}
    for name, value, width in specs:
        total = totals[str(value)]
        cols[name] = F.round(F.col(total) - F.coalesce(F.lag(total, width).over(w), F.lit(0)), digits)
    return df.withColumns(cols).drop(*totals.values())


def rows_in_frame(s: Slices, width: int) -> Column:
    """How many rows the frame of the last ``width`` ticks holds (dense series)."""
    first = F.first(s.order).over(s.running())
    return F.least(F.col(s.order) - first + 1, F.lit(width))


def prefix_over_chunks(df: DataFrame, s: Slices, totals: dict[str, Column],
                       combine: dict[str, Column]) -> DataFrame:
    """Per slice, a value carried in from all earlier slices of the same series.

    ``totals`` are aggregates per slice; ``combine`` maps output names to expressions over the
    slice rows ordered by time (one short row per slice: a few hundred for years of minutes).
    """
    return (df.withColumn(CHUNK, s.number())
            .groupBy(*s.keys, CHUNK).agg(*[c.alias(n) for n, c in totals.items()])
            .select(*s.keys, CHUNK, *[c.alias(n) for n, c in combine.items()]))


def earlier_chunks(s: Slices) -> WindowSpec:
    return (Window.partitionBy(*s.keys).orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1))
