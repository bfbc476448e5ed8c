"""Tabular features from channels. The prefix letter names the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import FeatureParams
from .channels import NEIGHBOUR
from .halo import CHUNK, Slices, add_rolling_sums, age_since, last_seen, rows_in_frame

# The 21 columns of the comparison feature set.
LEGACY_FEATURES = (
    "P_lag0", "P_lag1", "P_lag2", "P_lag3", "P_lag5", "P_lag9", "P_sum10", "P_sum30", "P_sum60",
    "M_temp", "M_rh", "M_cloud", "M_wind_speed", "M_wind_u", "M_wind_v", "M_temp_d30", "M_rh_d30",
    "T_hour_sin", "T_hour_cos", "T_lat", "T_lon")

MET_CHANNELS = ("temp", "rh", "wind_speed", "wind_u", "wind_v", "cloud", "dewpoint_dep", "met_age")
MET_DIFFS = ("temp", "rh", "wind_speed", "dewpoint_dep")
PLACE_CHANNELS = ("hour_sin", "hour_cos", "doy_sin", "doy_cos", "lat", "lon")


def feature_group_select(df: DataFrame, groups: tuple[str, ...], keep: tuple[str, ...] = ("station_id", "minute")) -> DataFrame:
    """Columns of the named groups; the scan below reads nothing else."""
    return df.select(*keep, *[c for c in df.columns if c not in keep and c.split("_", 1)[0] in groups])


def lag_features(df: DataFrame, s: Slices, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Lags and short slopes of rain, the previous total, half-hour and hour changes of the weather."""
    w = s.window()
    lag = lambda c, k: F.lag(c, k).over(w)
    cols: dict[str, Column] = {f"P_lag{k}": F.col("rain_rt") if k == 0 else lag("rain_rt", k) for k in range(p.lags)}
    cols["P_slope3"] = F.col("rain_rt") - lag("rain_rt", 3)
    cols["P_p10_prev"] = lag("p10_last", 10)
    if "P_sum5" in df.columns:
        cols["P_slope10"] = F.col("P_sum5") - lag("P_sum5", 5)
    for c in MET_DIFFS:
        if c in df.columns:
            cols[f"M_{c}_d30"] = F.col(c) - lag(c, 30)
            cols[f"M_{c}_d60"] = F.col(c) - lag(c, 60)
    return df.withColumns(cols)


def rolling_stats(df: DataFrame, s: Slices, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Sums and wet shares over the configured frames, maxima over 10 and 30; short frames allowed."""
    wet = (F.col("rain_rt") > 0).cast("long")
    specs = [(f"P_sum{w}", F.col("rain_rt"), w) for w in p.roll_windows]
    specs += [(f"wet_{w}_", wet, w) for w in p.roll_windows]
    df = add_rolling_sums(df, s, specs)
    cols = {f"P_wetfrac{w}": F.col(f"wet_{w}_") / rows_in_frame(s, w) for w in p.roll_windows}
    cols["P_max10"] = F.max("rain_rt").over(s.frame(9))
    cols["P_max30"] = F.max("rain_rt").over(s.frame(29))
    return df.withColumns(cols).drop(*[f"wet_{w}_" for w in p.roll_windows])


def time_since_and_runs(df: DataFrame, s: Slices, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Ticks since rain and lengths of the current wet and dry runs; a run may start at the first row."""
    wet = F.col("rain_rt") > 0
    before = F.first(s.order).over(s.running()) - 1

    def run(here: Column, other: Column, cap: int) -> Column:
        length = F.col(s.order) - F.coalesce(last_seen(s, other), before)
        return F.when(here, F.least(length, F.lit(cap))).otherwise(F.lit(0)).cast("long")

    return df.withColumns({"P_mins_since_rain": age_since(s, wet, p.since_cap),
                           "P_wet_run": run(wet, ~wet, p.wet_run_cap), "P_dry_run": run(~wet, wet, p.dry_run_cap)})


def open_spell_carry(df: DataFrame, s: Slices) -> DataFrame:
    """Per slice, the rain of the wet spell still open when the slice begins."""
    dry = F.col("rain_rt") <= 0
    own = df.select(*s.keys, s.order, "rain_rt").withColumn(CHUNK, s.number())
    own = own.withColumn("total_", F.sum("rain_rt").over(s.running()))
    sums = own.groupBy(*s.keys, CHUNK).agg(
        F.max("total_").alias("all_"), F.max(F.when(dry, F.col("total_"))).alias("upto_dry_"))
    # A slice without a dry tick passes on what came in plus all of its rain; any other slice
    # passes on the rain after its last dry tick. "resets" counts the latter.
    by_time = Window.partitionBy(*s.keys).orderBy(CHUNK)
    upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("resets_", F.count("upto_dry_").over(upto))
    out = F.col("all_") - F.coalesce("upto_dry_", F.lit(0.0))
    island = Window.partitionBy(*s.keys, "resets_").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("open_", F.sum(out).over(island))
    return sums.select(*s.keys, CHUNK, F.coalesce(F.lag("open_").over(by_time), F.lit(0.0)).alias("carry_"))


def spell_accumulation(df: DataFrame, s: Slices, carry: DataFrame) -> DataFrame:
    """Adds the rain of the current wet spell, wherever the spell began.

    Within a slice it is a difference of running totals; a spell older than the slice and its halo
    starts from the carried amount.
    """
    df = df.join(carry, [*s.keys, CHUNK], "left")
    dry = F.col("rain_rt") <= 0
    df = df.withColumn("total_", F.sum("rain_rt").over(s.running()))
    at_dry = F.last(F.when(dry, F.col("total_")), ignorenulls=True).over(s.running())
    outside = F.max(F.when(F.col(s.order) < F.col(CHUNK) * s.chunk, F.col("total_"))).over(s.running())
    from_carry = F.col("total_") - F.coalesce(outside, F.lit(0.0)) + F.coalesce("carry_", F.lit(0.0))
    value = F.when(dry, F.lit(0.0)).otherwise(F.round(F.coalesce(F.col("total_") - at_dry, from_carry), 9))
    return df.withColumn("P_spell_accum", value).drop("total_", "carry_")


def neighbour_trends(df: DataFrame, s: Slices) -> DataFrame:
    """Half-hour extremes and means of the neighbours and the change of the outer upwind rain."""
    cols = {"N_nb_max_roll30": F.max("nb_max").over(s.frame(29)),
            "N_nb_wet_frac_roll30": F.avg("nb_wet_frac").over(s.frame(29)),
            "N_upwind_r1_d10": F.col("nb_upwind_r1") - F.lag("nb_upwind_r1", 10).over(s.window())}
    return df.withColumns(cols)


def build_features(channels: DataFrame, p: FeatureParams = FeatureParams(), slices: Slices = Slices(),
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """All features in channel order; radar columns, when present, become the R and S groups.

    Slices are widened by the longest look-back once; every frame shares that one sort.
    """
    s = slices
    back = max(p.since_cap, p.dry_run_cap, p.wet_run_cap, 60) + max(p.roll_windows)
    df = spell_accumulation(s.widen(channels, back), s, open_spell_carry(channels, s))
    df = time_since_and_runs(rolling_stats(df, s, p), s, p)
    df = lag_features(df, s, p)
    has_nb = "nb_max" in channels.columns
    if has_nb:
        df = neighbour_trends(df, s)
    df = s.own(df)
    names = [f"P_lag{k}" for k in range(p.lags)]
    for w in p.roll_windows:
        names += [f"P_sum{w}", f"P_wetfrac{w}"]
    names += ["P_max10", "P_max30", "P_mins_since_rain", "P_wet_run", "P_dry_run", "P_spell_accum", "P_slope3", "P_slope10"]
    cols = [F.col(n) for n in names]
    cols += [F.col("p10_last").alias("P_p10_last"), F.col("p10_age").alias("P_p10_age"), F.col("P_p10_prev"),
             F.col("rain_signal").alias("P_signal")]
    cols += [F.col(c).alias(f"M_{c}") for c in MET_CHANNELS]
    for c in MET_DIFFS:
        cols += [F.col(f"M_{c}_d30"), F.col(f"M_{c}_d60")]
    cols += [F.col(c).alias(f"T_{c}") for c in PLACE_CHANNELS]
    if has_nb:
        cols += [F.col(c).alias(f"N_{c}") for c in NEIGHBOUR]
        cols += [F.col(c) for c in ("N_nb_max_roll30", "N_nb_wet_frac_roll30", "N_upwind_r1_d10")]
    cols += [F.col(c).alias(f"R_{c}") for c in channels.columns if c.startswith("radar_")]
    cols += [F.col(c).alias(f"S_{c}") for c in channels.columns if c.startswith("nowcast_")]
    return df.select(*s.keys, s.order, *[c for c in keep if c not in (*s.keys, s.order)], *cols)
