"""Weather-network views over the given tables, as DataFrames.

One hour of ``events`` stands for one tick, 25 users form one station (so the network grows with
the table) and every vector of ``embeddings`` is one 8 x 8 radar image. All rows are used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.clock import Clock
from gaugeflow.models import hybrids
from gaugeflow.operators import channels, features, neighbours, quality, radar, splits, stations, truth, verify
from gaugeflow.operators.halo import Slices
from gaugeflow.params import EvalParams, GateParams, RadarParams
from gaugeflow.session import materialise

CLOCK = Clock(tick_s=3600, origin_s=1_704_067_200)  # tick 0 = 2024-01-01 00:00 UTC
SLICES = Slices(chunk=240)
LONG_SLICES = Slices(chunk=720)  # for the day-long look-back of the features
SPLITS = {"train": (0, 360), "val": (360, 540), "test": (540, 721)}
GATE = GateParams(min_valid_frac=0.3, min_rain_windows=5, min_rain_coverage=0.5, mass_ratio_range=(0.5, 1.25))
EVAL = EvalParams(intensity_mmh=(12.0, 40.0), bootstrap=200, min_coverage=0.85)
RADAR = RadarParams(latency=1, tolerance=2, max_lead=5, windows=(3, 5, 7), size=8, tile=4, tile_step=2)

# Stand-in forecasts: name, probability, amount, upper quantile.
MODELS = (
    ("zero", "0", "0", "0"), ("persistence", "CASE WHEN rain_rt > 0 THEN 1 ELSE 0 END", "rain_rt", "rain_rt"),
    ("moving_average", "P_wetfrac10", "P_sum10 / 10", None), ("kalman_ll", "P_wetfrac30", "P_sum30 / 30", "P_max30"),
    ("lgbm_hurdle", "0.6D * P_wetfrac5 + 0.4D * P_wetfrac60", "0.5D * rain_rt + 0.05D * P_sum10", "P_max10"),
    ("A__logistic_hurdle", "P_sum5 / 2", "P_sum5 / 5", None),
    ("hyb_stack", "0.5D * P_wetfrac10 + 0.5D * P_wetfrac60", "P_sum60 / 60", None),
    ("gru", "P_wetfrac60", "0.3D * P_max10", "P_max30"), ("tcn", "P_wetfrac5", "0.2D * P_max10", None))


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(build):
    """A view that feeds many checks: written once per session to the shared folder and read back.

    The same thing the batch plan does with its truth, channel and forecast tables.
    """
    name = build.__name__.removeprefix("build_")

    def read(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _STORED:
            _STORED[key] = materialise(build(self), name)
        return _STORED[key]

    return property(read)


class Proxy:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def stations(self) -> DataFrame:
        k = self.table("events").select(F.floor(F.col("user_id") / 25).cast("long").alias("k")).distinct()
        return k.selectExpr(
            "lpad(CAST(k AS STRING), 5, '0') AS station_id",
            "9.0D + ((k * 37) % 11) * 0.09D + ((k div 77) % 40) * 1.1D AS lon",
            "55.6D + ((k * 53) % 7) * 0.07D - ((k div 3080) % 50) * 1.0D AS lat")

    @cached_property
    def raw(self) -> DataFrame:
        return self.table("events").selectExpr(
            "lpad(CAST(user_id div 25 AS STRING), 5, '0') AS station_id",
            "timestampdiff(HOUR, timestamp_ntz'2024-01-01', ts) AS minute", "event_id AS seq",
            "CASE WHEN event_id % 97 = 0 THEN -999999D WHEN value > 60 THEN floor((value - 60) / 20) * 0.1D ELSE 0D END AS precip_past1min",
            "CASE WHEN event_type = 'error' THEN value % 60 - 15 END AS temp_dry",
            "CASE WHEN event_type = 'signup' THEN value % 101 END AS humidity",
            "CASE WHEN event_type = 'click' THEN value % 20 END AS wind_speed",
            "CASE WHEN event_type = 'purchase' THEN CAST((event_id * 37) % 360 AS DOUBLE) END AS wind_dir",
            "CASE WHEN event_id % 53 = 0 THEN 112D WHEN event_id % 7 = 0 THEN value % 120 END AS cloud_cover")

    @cached_property
    def ded(self) -> DataFrame:
        return quality.dedup_first_nonnull(quality.range_clean(self.raw))

    def build_obs(self) -> DataFrame:
        grid = truth.place_on_grid(self.ded, SLICES.chunk).drop("p10_obs")
        block = Window.partitionBy("station_id", "block")
        return (grid.withColumn("block", F.ceil(F.col("minute") / 10))
                .withColumn("sum_", F.coalesce(F.sum("p1_obs").over(block), F.lit(0.0)))
                .withColumn("n_", F.col("block") + F.col("station_id").cast("long"))
                .withColumn("p10_obs", F.when((F.col("minute") % 10 == 0) & (F.col("n_") % 11 != 0), F.round(
                    F.col("sum_") + F.when(F.col("n_") % 7 == 0, 1.0).otherwise(0.0), 1)))
                .select("station_id", "minute", "p1_obs", "p10_obs", *quality.MET))

    obs = stored(build_obs)

    @cached_property
    def truth(self) -> DataFrame:
        return truth.validate_truth(self.obs, slices=SLICES)

    def build_targets(self) -> DataFrame:
        return truth.validate_truth(self.obs, slices=SLICES, target=True)

    targets = stored(build_targets)

    def build_own_channels(self) -> DataFrame:
        return channels.station_channels(self.obs, self.stations, CLOCK, slices=SLICES)

    own_channels = stored(build_own_channels)

    @cached_property
    def pairs(self) -> DataFrame:
        return stations.station_pair_table(self.stations)

    def build_profile(self) -> DataFrame:
        return neighbours.neighbour_profile(self.pairs, self.stations)

    profile = stored(build_profile)

    def build_channels(self) -> DataFrame:
        wide = neighbours.neighbour_aggregates(self.own_channels, self.profile, payload=list(channels.OWN))
        return neighbours.neighbour_trend(wide, SLICES)

    channels = stored(build_channels)

    @cached_property
    def gated(self) -> DataFrame:
        yearly = quality.quality_by_year(self.truth, CLOCK, F.floor(F.col("minute") / 360).cast("long"))
        return quality.quality_gate(yearly, GATE)

    @cached_property
    def parts(self) -> DataFrame:
        return splits.split_parts(self.gated, "test", 500, 721, lambda y: (y * 360, (y + 1) * 360))

    @cached_property
    def part_rows(self) -> DataFrame:
        rows = (self.channels.select("station_id", "minute", "rain_rt", "rain_signal", "nb_max")
                .join(self.targets.select("station_id", "minute", "target", "target_valid"), ["station_id", "minute"]))
        return splits.part_history_join(rows, self.parts, 30, None, SLICES.chunk)

    def build_rolled(self) -> DataFrame:
        df = features.rolling_stats(SLICES.widen(self.own_channels.select("station_id", "minute", "rain_rt", "rain_avail"), 60), SLICES)
        return SLICES.own(df)

    rolled = stored(build_rolled)

    def build_index(self) -> DataFrame:
        split = F.when(F.col("minute") < 540, "val").otherwise("test")
        return (self.targets.where("target_valid = 1 AND minute >= 360")
                .select("station_id", "minute", F.col("target").alias("y_true"), F.coalesce("p1_obs", F.lit(0.0)).alias("rain_now"),
                        F.floor(F.col("minute") / 12).cast("long").alias("day"), split.alias("split")))

    index = stored(build_index)

    def build_preds(self) -> DataFrame:
        items = []
        for model, p, y, q in MODELS:
            ok = "rain_avail = 1" if model == "gru" else "rain_avail = 0" if model == "tcn" else "true"
            r = lambda e: f"round(CAST({e} AS DOUBLE), 6)"
            items.append(f"CASE WHEN {ok} THEN named_struct('model', '{model}', 'p_rain', {r(p)}, 'y_hat', {r(y)}, "
                         f"'q90', {r(q) if q else 'CAST(NULL AS DOUBLE)'}) END")
        rows = self.rolled.where("minute >= 360").select("station_id", "minute", F.explode(F.expr(f"array({', '.join(items)})")).alias("f"))
        return rows.where("f is not null").select("f.model", "station_id", "minute", "f.p_rain", "f.y_hat", "f.q90")

    preds = stored(build_preds)

    @cached_property
    def thresholds(self) -> DataFrame:
        val = verify.index_prediction_join(self.index.where("split = 'val'"), self.preds)
        return verify.tuned_thresholds(val, EVAL)

    def build_scored(self) -> DataFrame:
        rows = verify.kept_predictions(self.index.where("split = 'test'"), self.preds, EVAL.min_coverage)
        return rows.join(self.thresholds, "model")

    scored = stored(build_scored)

    @cached_property
    def images(self) -> DataFrame:
        raw = F.transform("embedding", lambda e: F.when(F.abs(e.cast("double")) < 0.02, 0).when(e.cast("double") > 0.12, 255)
                          .otherwise(F.floor(64 + F.abs(e.cast("double")) * 200).cast("int")))
        return self.table("embeddings").select((F.floor(F.col("vec_id") / 3) * 4).cast("long").alias("scan"), (F.col("vec_id") % 3).alias("site"),
                                               F.lit(0).alias("geom_id"), raw.alias("raw"))

    @cached_property
    def geometries(self) -> DataFrame:
        """One map grid per radar site that occurs in the images, around a station of the network."""
        site = self.images.select("site", "geom_id").distinct()
        return site.selectExpr("site", "geom_id", "160 AS nx", "160 AS ny", "0.5D AS xscale", "0.5D AS yscale", "9.9D + site * 0.3D AS ll_lon",
                               "55.7D AS ll_lat", "10.5D + site * 0.3D AS lon0", "56.1D AS lat0")

    @cached_property
    def shape(self) -> DataFrame:
        return self.images.select("site", "geom_id").distinct().withColumns({"nx": F.lit(8), "ny": F.lit(8)})

    def build_cell_map(self) -> DataFrame:
        shape = self.shape
        cell = shape.withColumn("pixel", F.explode(F.sequence(F.lit(0), F.lit(63))))
        r, c = F.floor(F.col("pixel") / 8), F.col("pixel") % 8
        at = lambda a, b, d: F.when(F.col("site") == 0, a).when(F.col("site") == 1, b).otherwise(d)
        return cell.select("site", "geom_id", "pixel", r.alias("row"), c.cast("long").alias("col"),
                           F.sqrt(F.pow(r - at(1, 6, 3), F.lit(2)) + F.pow(c - at(1, 2, 6), F.lit(2))).alias("dist_km"))

    cell_map = stored(build_cell_map)

    def build_comp(self) -> DataFrame:
        return radar.nearest_site_composite(radar.image_pixels(self.images, self.shape), self.cell_map)

    comp = stored(build_comp)

    @cached_property
    def st_px(self) -> DataFrame:
        return self.stations.selectExpr("station_id", "2 + CAST(station_id AS BIGINT) % 4 AS row", "2 + (CAST(station_id AS BIGINT) * 3) % 4 AS col")

    def build_scanstat(self) -> DataFrame:
        return radar.pixel_window_stats(self.comp, self.st_px, RADAR)

    scanstat = stored(build_scanstat)

    def blended(self, at: DataFrame) -> DataFrame:
        """Rows of scans and stations with the cell of the station and its motion."""
        t = lambda c: F.explode(F.filter(F.array(*[F.lit(x).cast("long") for x in (0, 2, 4)]), lambda o: (F.col(c) >= o) & (F.col(c) < o + 4)))
        mean = F.avg(F.coalesce("rain", F.lit(0.0)))
        tiles = (self.comp.withColumn("r0", t("row")).withColumn("c0", t("col")).groupBy("scan", "r0", "c0").agg(mean.alias("m")).where("m > 1.5")
                 .selectExpr("scan", "r0 + 2D AS tile_r", "c0 + 2D AS tile_c", "round(m * 0.05D - 0.2D, 6) AS vy", "round(0.3D - m * 0.04D, 6) AS vx"))
        whole = self.comp.select("scan").distinct().selectExpr("scan", "0.1D AS vy", "-0.1D * ((scan div 4) % 3) AS vx")
        px = self.st_px
        px = F.broadcast(px) if px.count() <= radar.MOST_SENT else px  # else the rows of all scans would travel to their stations
        return radar.motion_blend(at.join(px, "station_id"), tiles, whole, RADAR)

    def build_moving(self) -> DataFrame:
        return self.blended(self.scanstat.select("scan", "station_id"))

    moving = stored(build_moving)

    def build_adv(self) -> DataFrame:
        """A row without a scan or a station has no statistics either."""
        return radar.advect_nowcast(self.comp, self.moving, RADAR).where("scan IS NOT NULL AND station_id IS NOT NULL")

    adv = stored(build_adv)

    def build_scanfeat(self) -> DataFrame:
        """The statistics ride along through the motion and the upstream reads, so nothing is joined by scan and station."""
        stats = [c for c in self.scanstat.columns if c not in ("scan", "station_id")]
        rows = radar.advect_nowcast(self.comp, self.blended(self.scanstat), RADAR).where("scan IS NOT NULL AND station_id IS NOT NULL")
        return rows.select("scan", "station_id", "row", "col", "adv", "radar_motion_v", "radar_motion_u", *stats)

    scanfeat = stored(build_scanfeat)

    def build_tab(self) -> DataFrame:
        """Training table of the small models: a few features, target, weight."""
        lag1 = SLICES.own(SLICES.widen(self.rolled, 1).withColumn("P_lag1", F.coalesce(F.lag("rain_rt").over(SLICES.window()), F.lit(0.0))))
        return (lag1.join(self.targets.select("station_id", "minute", "target", "target_valid"), ["station_id", "minute"])
                .select("station_id", "minute", F.col("rain_rt").alias("P_lag0"), "P_lag1", "P_sum10", "P_wetfrac10", F.lit(1).alias("month"),
                        (F.col("minute") % 24).alias("hour"), F.col("target").alias("y"), (1.0 + F.col("minute") % 2).alias("w"), "target_valid"))

    tab = stored(build_tab)

    def build_wide_tab(self) -> DataFrame:
        """All features with target, weight and the current rain, as the fitted models take them."""
        f = features.build_features(self.channels, slices=LONG_SLICES)
        t = self.targets.where("target_valid = 1").select("station_id", "minute", F.col("target").alias("y"), F.coalesce("p1_obs", F.lit(0.0)).alias("rain_now"))
        return f.join(t, ["station_id", "minute"]).withColumn("w", F.lit(1.0))

    wide_tab = stored(build_wide_tab)

    @cached_property
    def fit_rows(self) -> DataFrame:
        return verify.index_prediction_join(self.index.where("split = 'val'"), self.preds)

    def build_cal_rows(self) -> DataFrame:
        return hybrids.calibration(self.fit_rows).apply(self.fit_rows, "p_rain", "p_cal")

    cal_rows = stored(build_cal_rows)
