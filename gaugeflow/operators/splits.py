"""Parts of a benchmark, scored rows, training weights and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..clock import Clock, floor_div
from ..functions.rain import hash01
from ..params import SampleParams
from .halo import Slices, last_seen


def split_parts(gated: DataFrame, split: str, start: int, end: int, year_bounds) -> DataFrame:
    """Station-year slices of a split. ``year_bounds(year)`` gives the first tick of a year and of the next."""
    lo, hi = year_bounds(F.col("year"))
    return (gated.where("ok").select(
        "station_id", "year", F.concat_ws("-", F.lit(split), F.col("year")).alias("part"),
        F.greatest(F.lit(start), lo).cast("long").alias("start"), F.least(F.lit(end), hi).cast("long").alias("end"))
        .where("start < end"))


def part_history_join(channels: DataFrame, parts: DataFrame, pad: int = 240, radar: DataFrame | None = None,
                      chunk: int = 10_080) -> DataFrame:
    """Channel rows of each part with ``pad`` ticks of history before it; ``in_period`` marks the part itself.

    The range condition becomes an equi-join: each part lists the time slices it touches, so a
    station with much data spreads over its slices.
    """
    spans = parts.withColumn("c_", F.explode(F.sequence(floor_div(F.col("start") - pad, chunk),
                                                        floor_div(F.col("end") - 1, chunk))))
    rows = channels.drop("year").withColumn("c_", floor_div(F.col("minute"), chunk))
    out = (rows.join(spans, ["station_id", "c_"])
           .where((F.col("minute") >= F.col("start") - pad) & (F.col("minute") < F.col("end"))).drop("c_"))
    if radar is not None:
        out = out.join(radar, ["station_id", "minute"], "left")
    return out.withColumn("in_period", F.col("minute") >= F.col("start")).drop("start", "end")


def valid_part_filter(parts: DataFrame, targets: DataFrame, min_rows: int = 60, chunk: int = 10_080) -> DataFrame:
    """Parts with enough valid targets inside their own period."""
    inside = part_history_join(targets.select("station_id", "minute", "target_valid").where("target_valid > 0"), parts, 0, None, chunk)
    enough = inside.groupBy("station_id", "part").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= min_rows)
    return parts.join(enough, ["station_id", "part"], "left_semi").select(*parts.columns)


def is_scored() -> Column:
    return F.col("in_period") & (F.col("target_valid") > 0)


def eval_rows(df: DataFrame) -> DataFrame:
    """Rows inside their period whose next tick has a valid target."""
    return df.where(is_scored())


def evaluation_index(df: DataFrame, clock: Clock = Clock()) -> DataFrame:
    return eval_rows(df).select("station_id", "minute", F.col("target").alias("y_true"), F.col("rain_rt").alias("rain_now"),
                                clock.day_number(F.col("minute")).alias("day"))


def sample_weights(df: DataFrame, p: SampleParams = SampleParams(), slices: Slices = Slices()) -> DataFrame:
    """Adds ``w``: 1 near rain, 1/keep for a kept share of other rows, 0 for the rest and unscored rows.

    The keep decision depends on station, tick and seed alone.
    """
    s = slices
    wide = s.widen(df, p.context)
    near_now = F.coalesce(F.col("rain_signal") > 0, F.lit(False))
    if "nb_max" in df.columns:
        near_now = near_now | F.coalesce(F.col("nb_max") > 0, F.lit(False))
    wide = s.own(wide.withColumn("seen_", last_seen(s, near_now)))
    near = F.coalesce(F.col(s.order) - F.col("seen_") < p.context, F.lit(False)) | F.coalesce(F.col("target") > 0, F.lit(False))
    kept = hash01(F.col("station_id"), F.col(s.order), F.lit(p.seed)) < p.dry_keep_frac
    w = F.when(near, F.lit(1.0)).when(kept, F.lit(1.0 / p.dry_keep_frac)).otherwise(F.lit(0.0))
    return wide.withColumn("w", F.when(F.coalesce(is_scored(), F.lit(False)), w).otherwise(F.lit(0.0))).drop("seen_")


def day_hash_sample(df: DataFrame, frac: float, clock: Clock = Clock(), day: Column | None = None) -> DataFrame:
    """A fixed share of days; all of them when none would be chosen."""
    day = clock.day_number(F.col("minute")) if day is None else day
    df = df.withColumn("day_in_", F.pmod(day * F.lit(2654435761), F.lit(1000)) < int(1000 * frac))
    found = df.agg(F.coalesce(F.max("day_in_"), F.lit(False))).scalar()
    return df.where(F.col("day_in_") | ~found).drop("day_in_")


def uniform_row_cap(df: DataFrame, cap: int, keys: tuple[str, ...] = ("station_id", "minute"), seed: int = 42) -> DataFrame:
    """A uniform subset of about ``cap`` rows when there are more; the choice ignores order and partitions."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.where(hash01(*[F.col(k) for k in keys], F.lit(seed)) * total < cap)


def val_fit_select_split(index: DataFrame) -> DataFrame:
    """Adds ``fits``: the earlier half of the days (rounded down) fits hybrids, the rest selects.

    Only the distinct days (bounded by the calendar) are gathered.
    """
    days = (index.select("day").distinct().agg(F.sort_array(F.collect_list("day")).alias("d_"))
            .select(F.when(F.size("d_") >= 2, F.element_at("d_", (F.size("d_") / 2).cast("int")))))
    return index.withColumn("fits", F.coalesce(F.col("day") <= days.scalar(), F.lit(False)))
