"""Cleaning of raw readings, yearly quality numbers and the gates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..clock import Clock
from ..params import GateParams, TruthParams

MET = ("temp_dry", "humidity", "wind_speed", "wind_dir", "cloud_cover")

# Plausible ranges (both ends kept) and the code for an obscured sky.
MET_RANGES = {"temp_dry": (-45.0, 45.0), "humidity": (0.0, 100.0), "wind_speed": (0.0, 60.0),
              "wind_dir": (0.0, 360.0), "cloud_cover": (0.0, 100.0)}
SKY_OBSCURED, OVERCAST = 112, 100.0


def range_clean(df: DataFrame, p: TruthParams = TruthParams()) -> DataFrame:
    """Values outside their range become null; rows stay."""
    ranges = {"precip_past1min": (0.0, p.p1_max_mm), "precip_past10min": (0.0, p.p10_max_mm), **MET_RANGES}
    cols = {}
    for name, (lo, hi) in ranges.items():
        if name in df.columns:
            value = F.col(name)
            if name == "cloud_cover":
                value = F.when(value == SKY_OBSCURED, F.lit(OVERCAST)).otherwise(value)
            cols[name] = F.when(value.between(lo, hi), value)
    return df.withColumns(cols)


def dedup_first_nonnull(df: DataFrame, keys: tuple[str, ...] = ("station_id", "minute"), seq: str = "seq",
                        last: bool = False) -> DataFrame:
    """One row per key: per column the first (or last) non-null value in ``seq`` order.

    ``seq`` may repeat across files only if it is a struct of (file, row); the pick is then the
    same whatever partitions the rows come from. Partial results combine before the shuffle.
    """
    pick = F.max_by if last else F.min_by
    values = [c for c in df.columns if c not in keys and c != seq]
    return df.groupBy(*keys).agg(*[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in values])


def quality_by_year(truth: DataFrame, clock: Clock, year: Column | None = None) -> DataFrame:
    """Quality numbers per station and year of a truth table."""
    year = clock.year(F.col("minute")) if year is None else year
    rainy = F.col("p10_obs") > 0
    n = F.count(F.lit(1))
    return (truth.groupBy("station_id", year.alias("year")).agg(
        n.alias("minutes"),
        F.avg(F.col("valid").cast("double")).alias("valid_frac"),
        (F.count("p1_obs") / n).alias("p1_frac"),
        F.count(F.when(rainy, 1)).alias("rain_windows"),
        F.avg(F.when(rainy, F.col("valid").cast("double"))).alias("rain_coverage"),
        F.sum("precip").alias("precip_"), F.sum("p10_obs").alias("p10_"),
        F.count(F.when(F.col("precip") > 0, 1)).alias("wet_minutes"),
        (F.count("temp_dry") / n * 10).alias("met_frac"))
        .select("station_id", "year", "minutes", "valid_frac", "p1_frac", "rain_windows", "rain_coverage",
                F.when(F.col("p10_") > 0, F.coalesce("precip_", F.lit(0.0)) / F.col("p10_")).alias("mass_ratio"),
                "wet_minutes", F.coalesce("precip_", F.lit(0.0)).alias("precip_mm"), "met_frac"))


def quality_gate(quality: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """Adds ``ok``: the station-year may enter a benchmark."""
    lo, hi = p.mass_ratio_range
    ok = ((F.col("valid_frac") >= p.min_valid_frac) & (F.col("rain_windows") >= p.min_rain_windows)
          & (F.coalesce("rain_coverage", F.lit(0.0)) >= p.min_rain_coverage)
          & F.coalesce(F.col("mass_ratio").between(lo, hi), F.lit(False)))
    return quality.withColumn("ok", ok)


def quality_by_calendar_year(gated: DataFrame) -> DataFrame:
    """Network summary per year over the (small) station-year table."""
    return gated.groupBy("year").agg(
        F.count_distinct("station_id").alias("stations"), F.sum(F.col("ok").cast("long")).alias("ok_station_years"),
        F.percentile("rain_coverage", F.lit(0.5)).alias("median_rain_coverage"),
        F.percentile("mass_ratio", F.lit(0.5)).alias("median_mass_ratio"),
        F.sum("wet_minutes").alias("wet_minutes"))


def needed_station_years(gated: DataFrame, periods: list[tuple[int, int]], clock: Clock,
                         year: Column | None = None) -> DataFrame:
    """Passing station-years whose year some split touches; split ends are exclusive.

    ``periods`` are (start, end) ticks of the splits, a handful of configured pairs.
    """
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b - 1).alias("b")) for a, b in periods])
    to_year = clock.year if year is None else year
    wanted = F.exists(spans, lambda s: F.col("year").between(to_year(s["a"]), to_year(s["b"])))
    return gated.where(F.col("ok") & wanted).select("station_id", "year")
