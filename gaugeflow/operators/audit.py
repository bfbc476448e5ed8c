"""How much a careless rain truth flatters a forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .halo import Slices, rows_in_frame
from .verify import ratio


def naive_truth_variants(df: DataFrame, slices: Slices = Slices(), block: int = 10) -> DataFrame:
    """Adds ``zero_filled`` and ``spread``: gaps as 0, and block totals spread evenly over their ticks.

    A tick takes its share from the latest total that covers it; a block cut by the start of the
    series is divided by the ticks it has.
    """
    s = slices
    d = s.widen(df, block, block)
    d = d.withColumn("share_", F.when(F.col("p10_obs").isNotNull(), F.col("p10_obs") / rows_in_frame(s, block)))
    d = d.withColumn("spread", F.coalesce(F.last("share_", ignorenulls=True).over(s.frame(0, block - 1)), F.lit(0.0)))
    return s.own(d).withColumn("zero_filled", F.coalesce("p1_obs", F.lit(0.0))).drop("share_")


def pair_aggregates(now: Column, nxt: Column, usable: Column, prefix: str = "") -> list[Column]:
    """CSI, POD, FAR and RMSE of "the next value equals this one" as aggregates."""
    n = lambda c: F.count(F.when(usable & c, 1))
    wet_now, wet_next = now > 0, nxt > 0
    gap = nxt - now
    return [ratio(n(wet_now & wet_next), n(wet_now | wet_next)).alias(prefix + "csi"),
            ratio(n(wet_now & wet_next), n(wet_next)).alias(prefix + "pod"),
            ratio(n(wet_now & ~wet_next), n(wet_now)).alias(prefix + "far"),
            F.sqrt(F.avg(F.when(usable, gap * gap))).alias(prefix + "rmse")]


def with_next(df: DataFrame, columns: list[str], slices: Slices = Slices()) -> DataFrame:
    """Adds ``next_<c>``: the value of the following row."""
    s = slices
    d = s.widen(df, 0, 1)
    return s.own(d.withColumns({f"next_{c}": F.lead(c).over(s.window()) for c in columns}))


def persistence_pair_scores(truth: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """Per station, on ticks where this and the next value are both validated."""
    d = with_next(truth.select("station_id", "minute", "precip", "valid"), ["precip", "valid"], slices)
    both = (F.col("valid") > 0) & (F.col("next_valid") > 0)
    return d.groupBy("station_id").agg(*pair_aggregates(F.col("precip"), F.col("next_precip"), both))


def leakage_audit(truth: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """Per station: what the naive truths hide and how persistence scores under each truth."""
    d = naive_truth_variants(truth, slices)
    d = with_next(d, ["precip", "valid", "zero_filled", "spread"], slices)
    ours = (F.col("valid") > 0) & (F.col("next_valid") > 0)
    any_pair = F.col("next_zero_filled").isNotNull()
    wet = (F.col("valid") > 0) & F.coalesce(F.col("precip") > 0, F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("minutes"), F.avg(F.col("valid").cast("double")).alias("valid_frac"),
        n(wet).alias("our_wet_minutes"), n(wet & (F.col("zero_filled") == 0)).alias("wet_labelled_dry"),
        n(F.col("p1_obs").isNull()).alias("filled_with_zero"),
        F.coalesce(F.sum(F.when(F.col("valid") > 0, F.col("precip"))), F.lit(0.0)).alias("mm_ours"),
        F.sum("zero_filled").alias("mm_naive"),
        *pair_aggregates(F.col("precip"), F.col("next_precip"), ours, "ours_"),
        *pair_aggregates(F.col("zero_filled"), F.col("next_zero_filled"), any_pair, "naive_"),
        *pair_aggregates(F.col("spread"), F.col("next_spread"), any_pair, "spread_"))


def leakage_summary(audit: DataFrame) -> DataFrame:
    """Network summary over the per-station rows."""
    median = lambda c: F.percentile(c, F.lit(0.5))
    return audit.agg(
        F.count(F.lit(1)).alias("stations"),
        (F.sum("wet_labelled_dry") / F.greatest(F.sum("our_wet_minutes"), F.lit(1))).alias("share_wet_labelled_dry"),
        median("ours_csi").alias("csi_ours"), median("naive_csi").alias("csi_naive"), median("spread_csi").alias("csi_spread"))
