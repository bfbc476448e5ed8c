"""From cleaned readings to validated one-minute rain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..clock import floor_div
from ..params import TruthParams
from .halo import CHUNK, Slices, earlier_chunks, prefix_over_chunks, spread
from .quality import MET

TRUTH_COLUMNS = ("station_id", "minute", "p1_obs", "p10_obs", "precip", "valid", *MET)


def coalesce_overlap(primary: DataFrame, secondary: DataFrame, p: TruthParams = TruthParams()) -> DataFrame:
    """Fill gaps of the primary one-minute series from a second, range-checked one; keep both grids."""
    other = secondary.select("station_id", "minute",
                             F.when(F.col("precip_past1min").between(0.0, p.p1_max_mm), F.col("precip_past1min")).alias("other_"))
    return (primary.join(other, ["station_id", "minute"], "full")
            .withColumn("precip_past1min", F.coalesce("precip_past1min", "other_")).drop("other_"))


def minute_grid(readings: DataFrame, chunk: int = 10_080, block: int = 10, shared: bool = False) -> DataFrame:
    """Dense ticks per station from the block holding its first reading to the end of its last.

    Each station's span is first cut into slices, the slices are spread over the cluster and only
    then filled with ticks, so a long series is generated by many tasks. ``shared`` uses the span
    of the whole network for every station (the common axis of the neighbour operators).
    """
    first, last = F.min("minute"), F.max("minute")
    spans = readings.groupBy("station_id").agg(first.alias("a"), last.alias("b"))
    if shared:
        total = readings.agg(F.struct(first.alias("a"), last.alias("b"))).scalar()
        spans = spans.withColumn("all_", total).select("station_id", "all_.*")
    spans = spans.select("station_id", (floor_div(F.col("a"), block) * block).alias("a"),
                         (F.ceil(F.col("b") / block) * block).alias("b"))
    slices = spread(spans.withColumn("c", F.explode(F.sequence(floor_div(F.col("a"), chunk), floor_div(F.col("b"), chunk)))),
                    "station_id", "c")
    return slices.select("station_id", F.explode(F.sequence(
        F.greatest(F.col("a"), F.col("c") * chunk), F.least(F.col("b"), F.col("c") * chunk + chunk - 1))).alias("minute"))


def minute_union_grid(series: DataFrame) -> DataFrame:
    """All ticks any station reports, for every station."""
    ticks = series.select("minute").distinct()
    edges = ticks.agg(F.struct(F.min("minute").alias("a"), F.max("minute").alias("b"))).scalar()
    stations = series.select("station_id").distinct().withColumn("all_", edges).select("station_id", "all_.*")
    days = stations.withColumn("c", F.explode(F.sequence(floor_div(F.col("a"), 1440), floor_div(F.col("b"), 1440))))
    dense = (spread(days, "station_id", "c")
             .select("station_id", F.explode(F.sequence(F.greatest(F.col("a"), F.col("c") * 1440),
                                                        F.least(F.col("b"), F.col("c") * 1440 + 1439))).alias("minute")))
    return dense.join(ticks, "minute", "left_semi").select("station_id", "minute")


def place_on_grid(readings: DataFrame, chunk: int = 10_080, p: TruthParams = TruthParams(), shared: bool = False) -> DataFrame:
    """Readings on the dense grid; 10-minute totals count only at the end of a block.

    Readings off the tick never reach this point: sources either drop or floor them.
    """
    grid = minute_grid(readings, chunk, p.block, shared)
    out = grid.join(readings, ["station_id", "minute"], "left")
    for name in ("precip_past1min", "precip_past10min", *MET):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    at_end = F.pmod(F.col("minute"), F.lit(p.block)) == 0
    return out.select("station_id", "minute", F.col("precip_past1min").alias("p1_obs"),
                      F.when(at_end, F.col("precip_past10min")).alias("p10_obs"), *MET)


def tip_harmonise(df: DataFrame, col: str = "p1_obs", tip: float = 0.1, slices: Slices = Slices()) -> DataFrame:
    """Re-express rain as whole tips: a tip falls when the running total crosses a multiple of ``tip``.

    The running total spans the whole series; each slice starts from the total carried in.
    """
    s = slices
    value = F.coalesce(F.col(col), F.lit(0.0))
    carried = prefix_over_chunks(df, s, {"sum_": F.sum(value)},
                                 {"before_": F.coalesce(F.sum("sum_").over(earlier_chunks(s)), F.lit(0.0))})
    out = df.withColumn(CHUNK, s.number()).join(carried, [*s.keys, CHUNK])

    def tips(total):
        return F.floor(total / F.lit(tip) + F.lit(1e-6))

    out = out.withColumn("tips_", tips(F.col("before_") + F.sum(value).over(s.running())))
    before = F.coalesce(F.lag("tips_").over(s.window()), tips(F.col("before_")))
    return (out.withColumn("new_", F.when(F.col(col).isNotNull(), (F.col("tips_") - before) * F.lit(tip)))
            .withColumn(col, F.col("new_")).drop("new_", "tips_", "before_", CHUNK))


def whole_tips(total, tip: float):
    """Totals rounded to whole tips, halves to even."""
    return F.bround(total / F.lit(tip)) * F.lit(tip)


def mass_balance_window(df: DataFrame, block: int = 10) -> DataFrame:
    """Per block labelled by its last tick: reported ticks, their sum, the block total."""
    win = floor_div(F.col("minute") + F.lit(block - 1), block)
    return (df.groupBy("station_id", win.alias("win")).agg(
        F.count("p1_obs").alias("n1"), F.coalesce(F.sum("p1_obs"), F.lit(0.0)).alias("s1"),
        F.max(F.when(F.pmod(F.col("minute"), F.lit(block)) == 0, F.col("p10_obs"))).alias("p10")))


def dense_regime(df: DataFrame, p: TruthParams = TruthParams(), slices: Slices = Slices(), widened: bool = False) -> DataFrame:
    """Adds ``dense``: share of reported ticks in the centred frame, shorter at the series' edges.

    The share is a difference of running counts, not a re-counted frame.
    """
    s, half = slices, p.dense_half
    if not widened:
        df = s.widen(df, half, half)
    w = s.window()
    df = df.withColumn("seen_", F.count("p1_obs").over(s.running()))
    first, last = F.min(s.order).over(s.whole()), F.max(s.order).over(s.whole())
    upto = F.coalesce(F.lead("seen_", half).over(w), F.max("seen_").over(s.whole()))
    before = F.coalesce(F.lag("seen_", half + 1).over(w), F.lit(0))
    rows = F.least(last - F.col(s.order), F.lit(half)) + F.least(F.col(s.order) - first, F.lit(half)) + 1
    df = df.withColumn("dense", (upto - before) / rows).drop("seen_")
    return df if widened else s.own(df)


def validate_truth(grid: DataFrame, p: TruthParams = TruthParams(), slices: Slices = Slices(), target: bool = False) -> DataFrame:
    """Validated rain per tick from gridded readings (``place_on_grid`` after ``tip_harmonise``).

    Everything happens inside one slicing: a block's numbers sit on its last tick, the verdict is
    handed back to the block's earlier ticks by a short forward frame. One shuffle, one sort.
    ``target`` adds the columns of ``next_minute_target`` in the same pass.
    """
    s, block = slices, p.block
    df = dense_regime(s.widen(grid, p.dense_half + block, p.dense_half + block + int(target)), p, s, widened=True)
    frame = s.frame(block - 1)
    at_end = F.pmod(F.col("minute"), F.lit(block)) == 0
    total, n1 = F.col("p10_obs"), F.col("n1_")
    df = df.withColumns({"n1_": F.count("p1_obs").over(frame),
                         "s1_": F.coalesce(F.sum("p1_obs").over(frame), F.lit(0.0))})
    tol = F.greatest(F.lit(p.mass_tol_abs_mm), F.lit(p.mass_tol_rel) * F.coalesce(total, F.lit(0.0)))
    good = (F.when(total.isNull(), (n1 >= block) & (F.col("dense") >= p.dense_share))
            .when(total == 0, F.col("s1_") <= p.dry_tol_mm)
            .otherwise((n1 >= 1) & (F.abs(F.col("s1_") - total) <= tol)))
    df = df.withColumn("good_", F.when(at_end, good))
    df = df.withColumn("valid", F.coalesce(F.max("good_").over(s.frame(0, block - 1)), F.lit(False)))
    df = df.withColumn("precip", F.when(F.col("valid"), F.coalesce("p1_obs", F.lit(0.0))))
    df = df.withColumn("valid", F.col("valid").cast("int"))
    if target:
        return s.own(_with_target(df, s)).select(*TRUTH_COLUMNS, "target", "target_valid")
    return s.own(df).select(*TRUTH_COLUMNS)


def _with_target(df: DataFrame, s: Slices) -> DataFrame:
    w = s.window()
    follows = F.lead("minute").over(w) == F.col("minute") + 1
    df = df.withColumns({"target": F.when(follows, F.lead("precip").over(w)),
                         "target_valid": F.when(follows, F.lead("valid").over(w))})
    return df.withColumn("target_valid", F.coalesce("target_valid", F.lit(0)))


def next_minute_target(truth: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """Adds ``target`` and ``target_valid``: validated rain of the following tick.

    A tick equi-join partner would be a second shuffle; a lead inside slices is not.
    """
    return slices.own(_with_target(slices.widen(truth, 0, 1), slices))


def scan_truth_slice(truth: DataFrame, station_id: str, start: int, end: int, columns: list[str]) -> DataFrame:
    """One station between two ticks, chosen columns only; both reach the scan."""
    return (truth.where((F.col("station_id") == station_id) & (F.col("minute") >= start) & (F.col("minute") < end))
            .select("minute", *columns))


