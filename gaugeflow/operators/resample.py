"""Uncertainty from days: block bootstrap and the Diebold-Mariano test.

Rows are folded to one row per model and day first; everything after works on days, of which the
calendar bounds the number.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.rain import hash01
from .halo import spread
from .verify import ratio


def day_sufficient_stats(df: DataFrame) -> DataFrame:
    obs, fc = F.col("y_true") > 0, F.col("p_rain") >= F.col("thr_rain")
    e = F.col("y_hat") - F.col("y_true")
    n = lambda c: F.count(F.when(c, 1))
    return df.groupBy("model", "day").agg(F.sum(e * e).alias("sse"), F.count(F.lit(1)).alias("n"), n(obs & fc).alias("hits"),
                                          n(obs & ~fc).alias("misses"), n(~obs & fc).alias("false_alarms"))


def day_draws(stats: DataFrame, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """How often each day is drawn in each replicate; the same for all models."""
    days = (stats.select("day").distinct().agg(F.sort_array(F.collect_list("day")).alias("days_"))
            .withColumn("n_", F.size("days_")).where("n_ > 0"))
    draws = days.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    slots = (spread(draws, "draw")
             .withColumn("slot_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1))))
    pick = F.floor(hash01(F.col("draw"), F.col("slot_"), F.lit(seed)) * F.col("n_")).cast("int")
    return (slots.select("draw", F.element_at("days_", pick + 1).alias("day"))
            .groupBy("draw", "day").agg(F.count(F.lit(1)).alias("times")))


def draw_scores(stats: DataFrame, draws: DataFrame) -> DataFrame:
    """RMSE and CSI of each model in each replicate."""
    t = F.col("times")
    sums = draws.join(stats, "day").groupBy("draw", "model").agg(*[F.sum(t * F.col(c)).alias(c) for c in ("sse", "n", "hits", "misses", "false_alarms")])
    return sums.select("draw", "model", F.sqrt(ratio(F.col("sse"), F.col("n"))).alias("rmse"),
                       ratio(F.col("hits"), F.col("hits") + F.col("misses") + F.col("false_alarms")).alias("csi"))


def _interval(value, name: str) -> list:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return [q[0].alias(name + "_lo"), q[1].alias(name + "_hi")]


def block_bootstrap_ci(scores: DataFrame, reference: str = "persistence") -> DataFrame:
    """Central 95 % of RMSE, CSI, skill and CSI gap to the reference over the replicates."""
    ref = scores.where(F.col("model") == reference).select("draw", F.col("rmse").alias("r_"), F.col("csi").alias("c_"))
    j = scores.join(ref, "draw")
    aggs = (_interval(F.col("rmse"), "rmse") + _interval(F.col("csi"), "csi")
            + _interval(1 - ratio(F.col("rmse"), F.col("r_")), "skill") + _interval(F.col("csi") - F.col("c_"), "dcsi_vs_ref"))
    return j.groupBy("model").agg(*aggs)


def model_pairs(models: DataFrame, focus: DataFrame) -> DataFrame:
    """(focus model, other model) with different names; the model names are a short list."""
    others = models.agg(F.collect_set("model")).scalar()
    a = focus.select(F.col("model").alias("model_a")).distinct().withColumn("others_", others)
    return a.select("model_a", F.explode("others_").alias("model_b")).where("model_a <> model_b")


def paired_bootstrap(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean and interval of CSI and RMSE differences of pairs over common replicates."""
    side = lambda x: scores.select("draw", F.col("model").alias("model_" + x), F.col("rmse").alias("rmse_" + x),
                                   F.coalesce("csi", F.lit(0.0)).alias("csi_" + x))
    j = pairs.join(side("a"), "model_a").join(side("b"), ["model_b", "draw"])
    d_csi, d_rmse = F.col("csi_a") - F.col("csi_b"), F.col("rmse_a") - F.col("rmse_b")
    return j.groupBy("model_a", "model_b").agg(F.avg(d_csi).alias("d_csi_mean"), *_interval(d_csi, "d_csi"),
                                               F.avg(d_rmse).alias("d_rmse_mean"), *_interval(d_rmse, "d_rmse"))


@F.pandas_udf(DoubleType())
def two_sided_p(stat: pd.Series) -> pd.Series:
    return stat.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x is not None and x == x else None)


def diebold_mariano(stats: DataFrame, pairs: DataFrame, max_lag: int = 7) -> DataFrame:
    """Test of equal mean daily loss: Newey-West variance with Bartlett weights, null below ten days."""
    loss = stats.select("model", "day", ratio(F.col("sse"), F.col("n")).alias("loss"))
    j = (pairs.join(loss.select(F.col("model").alias("model_a"), "day", F.col("loss").alias("a_")), "model_a")
         .join(loss.select(F.col("model").alias("model_b"), "day", F.col("loss").alias("b_")), ["model_b", "day"]))
    pair = Window.partitionBy("model_a", "model_b")
    j = j.withColumn("d_", F.col("a_") - F.col("b_")).where("d_ is not null")
    j = j.withColumn("c_", F.col("d_") - F.avg("d_").over(pair))
    w = pair.orderBy("day")
    j = j.withColumns({f"l{k}_": F.col("c_") * F.lag("c_", k).over(w) for k in range(1, max_lag + 1)})
    n = F.count(F.lit(1))
    var = F.sum(F.col("c_") * F.col("c_")) / n
    for k in range(1, max_lag + 1):
        var = var + F.lit(2 * (1 - k / (max_lag + 1))) * F.coalesce(F.sum(f"l{k}_"), F.lit(0.0)) / n
    out = j.groupBy("model_a", "model_b").agg(n.alias("n_"), F.avg("d_").alias("m_"), var.alias("v_"))
    stat = F.when((F.col("n_") >= 10) & (F.col("v_") > 0), F.col("m_") / F.sqrt(F.when(F.col("v_") > 0, F.col("v_")) / F.col("n_")))
    return out.select("model_a", "model_b", stat.alias("dm_stat")).withColumn("p_value", two_sided_p("dm_stat"))
