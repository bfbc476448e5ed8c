"""The whole benchmark as one driver program: readings to scored forecasts.

Steps stay lazy; tables that feed several later steps (truth, channels, features, forecasts) are
written to the shared folder once and read back.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..clock import Clock
from ..models.loop import fit_predict_loop
from ..operators import channels, features, neighbours, quality, resample, splits, stations, truth, verify
from ..operators.halo import Slices
from ..params import ChannelParams, EvalParams, FeatureParams, GateParams, SampleParams, TruthParams
from ..session import materialise


@dataclass(frozen=True)
class Benchmark:
    """Configuration of a run. ``periods`` maps split names to (start, end) ticks."""

    periods: dict[str, tuple[int, int]]
    clock: Clock = Clock()
    slices: Slices = Slices()
    truth: TruthParams = TruthParams()
    gate: GateParams = GateParams()
    channels: ChannelParams = ChannelParams()
    features: FeatureParams = FeatureParams()
    sampling: SampleParams = SampleParams()
    evaluation: EvalParams = EvalParams()

    # ------------------------------------------------------------------ data
    def truth_table(self, readings: DataFrame) -> DataFrame:
        """``readings``: station_id, minute, seq and raw columns."""
        clean = quality.dedup_first_nonnull(quality.range_clean(readings, self.truth))
        for name in ("precip_past1min", "precip_past10min"):
            if name not in clean.columns:
                clean = clean.withColumn(name, F.lit(None).cast("double"))
        if self.truth.tip_mm > 0:
            # tips depend on reported values alone, so they are formed before gaps become rows
            clean = truth.tip_harmonise(clean, "precip_past1min", self.truth.tip_mm, self.slices)
            clean = clean.withColumn("precip_past10min", truth.whole_tips(F.col("precip_past10min"), self.truth.tip_mm))
        # each station on its own span: quality and density must not count minutes before or after it
        grid = truth.place_on_grid(clean, self.slices.chunk, self.truth)
        return materialise(truth.validate_truth(grid, self.truth, self.slices, target=True), "truth")

    def gated(self, truth_table: DataFrame, year=None) -> DataFrame:
        return quality.quality_gate(quality.quality_by_year(truth_table, self.clock, year), self.gate)

    def channel_table(self, truth_table: DataFrame, station_table: DataFrame) -> DataFrame:
        pairs = stations.station_pair_table(station_table, max(self.channels.rings_km))
        profile = materialise(neighbours.neighbour_profile(pairs, station_table, self.channels), "pairs")
        own = channels.station_channels(truth_table, station_table, self.clock, self.channels, self.slices)
        wide = neighbours.neighbour_aggregates(own, profile, self.channels, list(channels.OWN))
        out = neighbours.neighbour_trend(wide, self.slices)
        return materialise(out.join(truth_table.select("station_id", "minute", "target", "target_valid"), ["station_id", "minute"]), "channels")

    def split_table(self, channel_table: DataFrame, gated: DataFrame, split: str, year_bounds) -> DataFrame:
        """Features of a split with target, weight and current rain; training rows are the weighted ones."""
        start, end = self.periods[split]
        parts = splits.split_parts(gated, split, start, end, year_bounds)
        parts = splits.valid_part_filter(parts, channel_table, self.sampling.min_part_rows, self.slices.chunk)
        rows = splits.part_history_join(channel_table, parts, self.channels.pad, None, self.slices.chunk)
        s = replace(self.slices, keys=("station_id", "part"))
        rows = splits.sample_weights(rows, self.sampling, s)
        keep = ("target", "target_valid", "in_period", "w", "rain_rt")
        feats = features.build_features(rows, self.features, s, keep)
        feats = splits.eval_rows(feats).withColumns({
            "y": F.col("target"), "rain_now": F.col("rain_rt"), "month": self.clock.month(F.col("minute")), "hour": self.clock.hour(F.col("minute"))})
        return materialise(feats.drop("target", "target_valid", "in_period", "rain_rt"), split)

    # ------------------------------------------------------------------ models and scores
    def forecasts(self, train: DataFrame, val: DataFrame, test: DataFrame, models: Iterable, allow_failed: bool = False) -> tuple[DataFrame, dict[str, str]]:
        """Forecasts of all models. Each is tried; then a failed one is an error, as scores of the rest would look like the whole report."""
        preds, failed = fit_predict_loop(models, train.where("w > 0"), val.where("w > 0"), {"val": val, "test": test})
        if preds is None:
            raise RuntimeError(f"no model could be fitted: {failed}")
        if failed and not allow_failed:
            raise RuntimeError(f"models failed: {failed}")
        return preds, failed

    def index(self, table: DataFrame) -> DataFrame:
        return table.select("station_id", "minute", F.col("y").alias("y_true"), "rain_now", self.clock.day_number(F.col("minute")).alias("day"))

    def evaluate(self, val: DataFrame, test: DataFrame, preds: DataFrame) -> dict[str, DataFrame]:
        p = self.evaluation
        of = lambda s: preds.where(F.col("split") == s).drop("split")
        thresholds = materialise(verify.tuned_thresholds(verify.index_prediction_join(self.index(val), of("val")), p), "thresholds")
        index = self.index(test)
        scored = materialise(verify.kept_predictions(index, of("test"), p.min_coverage).join(thresholds, "model"), "scored")
        scores = materialise(verify.model_scores(scored, p), "scores")
        stats = materialise(resample.day_sufficient_stats(scored), "days")
        replicates = materialise(resample.draw_scores(stats, resample.day_draws(stats, p.bootstrap, p.seed)), "replicates")
        pairs = resample.model_pairs(stats, verify.leaderboard(scores).where("best_overall").select("model"))
        pairwise = resample.paired_bootstrap(replicates, pairs).join(resample.diebold_mariano(stats, pairs), ["model_a", "model_b"])
        tables = verify.report_tables(scores, pairwise, thresholds, verify.model_coverage(index, of("test")), p.min_coverage)
        tables["intervals"] = resample.block_bootstrap_ci(replicates, p.reference)
        tables["reliability"] = verify.reliability_table(scored, ["model"])
        tables["by_station_and_month"] = verify.scores_by_station_and_month(scored, self.clock.month(F.col("minute")))
        return tables

    def run(self, readings: DataFrame, station_table: DataFrame, models: Iterable, year_bounds, year=None, allow_failed: bool = False) -> dict[str, DataFrame]:
        """The report's tables; one of them, ``failed``, names the models that are not in the others (none, unless ``allow_failed``)."""
        truth_table = self.truth_table(readings)
        gated = self.gated(truth_table, year)
        chans = self.channel_table(truth_table, station_table)
        train, val, test = (self.split_table(chans, gated, s, year_bounds) for s in ("train", "val", "test"))
        preds, failed = self.forecasts(train, val, test, models, allow_failed)
        tables = self.evaluate(val, test, preds)
        tables["failed"] = readings.sparkSession.createDataFrame(sorted(failed.items()), "model string, error string")
        return tables
