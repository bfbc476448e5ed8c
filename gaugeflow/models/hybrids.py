"""Forecasts built from other forecasts. All are fitted on the earlier half of the validation days.

Rows are long: model, station_id, minute, y_true, rain_now, p_rain, y_hat.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.halo import Slices
from ..operators.truth import minute_grid
from ..operators.verify import KEYS, ratio, tune_threshold
from ..session import materialise
from .fitted import assemble
from .isotonic import IsotonicCalibrator
from .sequential import LinearFilter, filter_likelihood_search

MIN_ROWS, MIN_WET = 100, 5  # fixed values: fewer rows or wet rows are not fitted


def enough(rows: DataFrame) -> bool:
    n, wet = rows.select(*KEYS, "y_true").dropDuplicates(list(KEYS)).agg(F.count(F.lit(1)), F.count(F.when(F.col("y_true") > 0, 1))).first()
    return n >= MIN_ROWS and MIN_WET <= wet < n


# ----------------------------------------------------------------------------- residual correction
def residual_series(rows: DataFrame, chunk: int = 10_080) -> DataFrame:
    """Forecast residuals on the dense ticks between a station's first and last row, gaps as 0."""
    keys = rows.select("station_id", "minute", (F.col("y_true") - F.col("y_hat")).alias("z"))
    return (minute_grid(keys, chunk, block=1).join(keys, ["station_id", "minute"], "left")
            .withColumn("z", F.coalesce("z", F.lit(0.0))))


def residual_correction(rows: DataFrame, model: LinearFilter, slices: Slices = Slices()) -> DataFrame:
    """Adds the filtered residual to ``y_hat``; the row at t uses residuals up to t-1 only."""
    ahead = model.forecast(residual_series(rows, slices.chunk), "z", None, "corr_", slices)
    ahead = ahead.select("station_id", (F.col("minute") + 1).alias("minute"), "corr_")
    return (rows.join(ahead, list(KEYS), "left")
            .withColumn("y_hat", F.greatest(F.col("y_hat") + F.coalesce("corr_", F.lit(0.0)), F.lit(0.0))).drop("corr_"))


class ResidualHybrid:
    """One model's amounts corrected by a filter on its residuals; the probability is an isotonic map of the corrected amount.

    The filter (unless given) and the map are fitted on the rows of ``fit``.
    """

    def __init__(self, model: LinearFilter | None = None, slices: Slices = Slices(), block: int = 7 * 1440):
        self.model, self.slices, self.block = model, slices, block

    def fit(self, rows: DataFrame) -> "ResidualHybrid":
        if self.model is None:
            dense = residual_series(rows, self.slices.chunk).withColumn("cut_", F.floor(F.col("minute") / self.block))
            series = F.sort_array(F.collect_list(F.struct("minute", "z")))
            blocks = dense.groupBy("station_id", "cut_").agg(series.alias("s_")).where("size(s_) > 1").select(F.col("s_")["z"].alias("z"))
            self.model = filter_likelihood_search(blocks, "kalman_x").filter
        self.cal = IsotonicCalibrator().fit(residual_correction(rows, self.model, self.slices), "y_hat", F.col("y_true") > 0)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.cal.apply(residual_correction(rows, self.model, self.slices), "y_hat", "p_rain")


# ----------------------------------------------------------------------------- switch
def calibration(fit: DataFrame) -> IsotonicCalibrator:
    """A map from raw to calibrated probability for every model, fitted side by side."""
    return IsotonicCalibrator().fit(fit, "p_rain", F.col("y_true") > 0, curve="model")


def regime_choice(fit: DataFrame, score: str = "p_cal") -> DataFrame:
    """One row: the model with the best CSI (of calibrated probabilities) when dry now and the one with the lowest RMSE when wet now."""
    dry = fit.where("rain_now = 0")
    thr = tune_threshold(dry, ["model"], F.coalesce(score, F.lit(0.0)), F.col("y_true") > 0)
    obs, fc = F.col("y_true") > 0, F.coalesce(score, F.lit(0.0)) >= F.col("threshold")
    n = lambda c: F.count(F.when(c, 1))
    csi = dry.join(F.broadcast(thr), "model").groupBy("model").agg(ratio(n(obs & fc), n(obs | fc)).alias("csi"))
    e = F.col("y_hat") - F.col("y_true")
    rmse = fit.where("rain_now > 0").groupBy("model").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    both = csi.join(rmse, "model", "full")
    return both.agg(F.min_by("model", F.struct(-F.coalesce("csi", F.lit(-1.0)), F.col("model"))).alias("best_dry"),
                    F.min_by("model", F.struct(F.coalesce("rmse", F.lit(float("inf"))), F.col("model"))).alias("best_wet"))


def regime_switch(rows: DataFrame, choice: DataFrame) -> DataFrame:
    """Forecast, with the calibrated probability ``p_cal``, of the chosen model for the row's regime. The choice is a single row."""
    pick = lambda m, wet: F.struct(F.col(m).alias("model"), F.lit(wet).alias("wet_"))
    picks = choice.select(F.explode(F.array(pick("best_dry", False), pick("best_wet", True))).alias("c")).select("c.*")
    return (rows.withColumn("wet_", F.col("rain_now") > 0).join(F.broadcast(picks), ["model", "wet_"])
            .select(*KEYS, F.lit("hyb_regime").alias("model"), F.col("p_cal").alias("p_rain"), "y_hat"))


# ----------------------------------------------------------------------------- stack
def wide_rows(rows: DataFrame, models: list[str], p: str = "p_rain") -> DataFrame:
    """One row per station and minute that every model predicts, with the models' columns in order."""
    aggs = [F.count_distinct(F.when(F.col("model").isin(models), F.col("model"))).alias("models_"), F.max("y_true").alias("y_true"), F.max("rain_now").alias("rain_now")]
    for i, m in enumerate(models):
        here = F.col("model") == m
        aggs += [F.coalesce(F.max(F.when(here, F.col(p))), F.lit(0.0)).alias(f"p{i}"),
                 F.coalesce(F.max(F.when(here, F.col("y_hat"))), F.lit(0.0)).alias(f"y{i}")]
    return rows.groupBy(*KEYS).agg(*aggs).where(F.col("models_") == len(models)).drop("models_")


def gram(wide: DataFrame, k: int) -> DataFrame:
    """Sums of products of k amounts with each other and with the truth, in one row."""
    aggs = [F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    return wide.agg(*aggs, *[F.sum(F.col(f"y{i}") * F.col("y_true")).alias(f"c{i}") for i in range(k)])


def nonneg_stack_weights(wide: DataFrame, k: int) -> list[float]:
    """Non-negative least squares from the sums: the best subset whose plain solution is positive.

    With a handful of models every subset can be tried on the driver.
    """
    row = gram(wide, k).first()
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    c = np.array([row[f"c{i}"] or 0.0 for i in range(k)])
    best, weights = 0.0, np.zeros(k)
    for size in range(1, k + 1):
        for idx in map(list, combinations(range(k), size)):
            w = np.linalg.lstsq(g[np.ix_(idx, idx)], c[idx], rcond=None)[0]
            gain = 2 * w @ c[idx] - w @ g[np.ix_(idx, idx)] @ w
            if (w >= 0).all() and gain > best + 1e-12:
                best, weights = gain, np.zeros(k)
                weights[idx] = w
    return weights.tolist()


class StackedEnsemble:
    """Logistic blend of calibrated probabilities and the wet-now flag, non-negative blend of amounts."""

    def __init__(self, models: list[str]):
        self.models = models

    def fit(self, rows: DataFrame) -> "StackedEnsemble":
        """Raises ValueError on too few or only dry or wet rows; a loop over models records that and goes on."""
        if not enough(rows):
            raise ValueError(f"too few rows to stack {len(self.models)} models")
        rows = rows.where(F.col("model").isin(self.models))
        common = rows.join(wide_rows(rows, self.models).select(*KEYS), list(KEYS), "left_semi")
        self.cal = calibration(common)
        wide = materialise(self._wide(common), "stack")
        data = self._z(wide).withColumn("label", (F.col("y_true") > 0).cast("double"))
        self.clf = LogisticRegression(regParam=1.0 / wide.count(), standardization=False, maxIter=500).fit(data)
        self.weights = nonneg_stack_weights(wide, len(self.models))
        return self

    def _wide(self, rows: DataFrame) -> DataFrame:
        return wide_rows(self.cal.apply(rows, "p_rain", "p_cal"), self.models, "p_cal")

    def _z(self, wide: DataFrame) -> DataFrame:
        """Calibrated probabilities and the wet-now flag as one vector."""
        return assemble(wide.withColumn("zwet", (F.col("rain_now") > 0).cast("double")), [*[f"p{i}" for i in range(len(self.models))], "zwet"])

    def predict(self, rows: DataFrame) -> DataFrame:
        d = self.clf.transform(self._z(self._wide(rows.where(F.col("model").isin(self.models)))))
        y = F.lit(0.0)
        for i, w in enumerate(self.weights):
            y = y + F.lit(w) * F.col(f"y{i}")
        return d.select(*KEYS, F.lit("hyb_stack").alias("model"), vector_to_array("probability")[1].alias("p_rain"), y.alias("y_hat"))


