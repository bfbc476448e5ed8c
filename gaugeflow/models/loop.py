"""Fitting and predicting many models, importance of inputs and the stopping experiment."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import TRANSFER_PREFIX
from ..functions.rain import hash01
from ..operators.verify import ratio, tune_threshold
from ..session import materialise
from .fitted import BoostedHurdle, assemble

log = logging.getLogger(__name__)


def fit_predict_loop(models: Iterable, train: DataFrame, val: DataFrame, splits: dict[str, DataFrame],
                     transfer: dict[str, DataFrame] | None = None,
                     sink: Callable[[str, str, DataFrame], None] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Fit each model, predict every split; a failing model is recorded and never stops the rest.

    ``transfer`` splits (another benchmark) are predicted under the transfer prefix. Every prediction is
    written to the shared folder inside its model's ``try``; a model that fails on any split has none.
    The union of the written ones is returned, or None if there are none; a ``sink`` also gets each, once
    all splits of its model are written. Callers must look at the failures: the union alone does not tell them.
    """
    out: list[DataFrame] = []
    failed: dict[str, str] = {}
    for model in models:
        made: list[DataFrame] = []
        try:
            fitted = model.fit(train, val)
            jobs = [(fitted.name, s, df) for s, df in splits.items()]
            jobs += [(TRANSFER_PREFIX + fitted.name, s, df) for s, df in (transfer or {}).items()]
            for name, split, df in jobs:
                pred = fitted.predict(df).select(F.lit(name).alias("model"), F.lit(split).alias("split"), "station_id", "minute", "p_rain", "y_hat", "q90")
                pred = materialise(pred, "forecast")  # a failure at run time shows here, inside the try
                made.append(pred)
            if sink is not None:
                for (name, split, _), pred in zip(jobs, made, strict=True):
                    sink(name, split, pred)
            out += made
        except Exception as err:  # one model must not stop the others
            log.warning("model %s failed: %s", getattr(model, "name", model), err)
            failed[str(getattr(model, "name", model))] = str(err)
    return reduce(DataFrame.unionByName, out) if out else None, failed


def importance_by_regime(model: BoostedHurdle, rows: DataFrame, bucket_rows: int = 20_000, seed: int = 0) -> DataFrame:
    """Permutation importance of the rain classifier for all, dry-now and wet-now rows.

    All rows count; wet and dry ones have equal weight in total. Every row borrows one input at a time
    from another row of its hash bucket (about ``bucket_rows`` rows, so the buckets grow in number with
    the table); the rise of the weighted log loss is the importance. All inputs are scored in one job.
    """
    wet = F.col("y") > 0
    n_wet, n = rows.agg(F.count(F.when(wet, 1)), F.count(F.lit(1))).first()
    buckets, n_dry = max(1, -(-n // bucket_rows)), n - n_wet
    data = assemble(rows, model.names).select("station_id", "minute", "rain_now", wet.alias("wet"), vector_to_array("features").alias("x"))
    data = materialise(data.withColumn("weight_", F.when(F.col("wet"), 1.0 / max(n_wet, 1)).otherwise(1.0 / max(n_dry, 1))), "importance-rows")
    bucket = F.floor(hash01(F.col("station_id"), F.col("minute"), F.lit(seed + 1)) * buckets).cast("int")
    data = data.withColumn("b", bucket)
    rank = lambda s: F.row_number().over(Window.partitionBy("b").orderBy(hash01(F.col("station_id"), F.col("minute"), F.lit(s)), "station_id", "minute"))
    own = data.withColumn("r", rank(seed + 2))
    other = data.select("b", F.col("x").alias("x2"), rank(seed + 3).alias("r"))
    j = own.join(other, ["b", "r"]).withColumn("f", F.explode(F.sequence(F.lit(-1), F.lit(len(model.names) - 1))))
    mixed = F.transform("x", lambda v, i: F.when(i == F.col("f"), F.element_at("x2", i + 1)).otherwise(v))
    scored = model.clf.transform(j.withColumn("features", array_to_vector(mixed)))
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-12)), F.lit(1 - 1e-12))
    scored = scored.withColumn("loss", -F.ln(F.when(F.col("wet"), p).otherwise(1 - p)))
    regimes = F.array(F.lit("all"), F.when(F.col("rain_now") > 0, "wet_now").otherwise("dry_now"))
    loss = scored.withColumn("regime", F.explode(regimes)).groupBy("regime", "f").agg((F.sum(F.col("loss") * F.col("weight_")) / F.sum("weight_")).alias("loss"))
    base = loss.where("f = -1").select("regime", F.col("loss").alias("base_"))
    names = F.array(*[F.lit(n) for n in model.names])
    out = loss.where("f >= 0").join(base, "regime").select("regime", F.element_at(names, F.col("f") + 1).alias("feature"),
                                                           (F.col("loss") - F.col("base_")).alias("importance"))
    return out.withColumn("group", F.split("feature", "_", 2)[0])


def csi_at(rows: DataFrame, score: Column, thr: Column | float) -> float | None:
    obs, fc = F.col("y") > 0, score >= thr
    n = lambda c: F.count(F.when(c, 1))
    return rows.agg(ratio(n(obs & fc), n(obs | fc))).first()[0]


def tuning_leak_experiment(train: DataFrame, val: DataFrame, test: DataFrame, rounds: int = 50, depth: int = 5,
                           groups: tuple[str, ...] | None = None) -> dict[str, float | int]:
    """Test CSI of the same booster stopped and tuned on validation rows versus on the test rows."""
    out: dict[str, float | int] = {}
    for name, stop in (("val", val), ("test", test.withColumn("w", F.lit(1.0)))):
        m = BoostedHurdle(f"stop_{name}", groups=groups, quantile=False, rounds=rounds, depth=depth).fit(train, stop)
        scored = m.predict(test).select("y", "p_rain").withColumn("k", F.lit(1))
        if name == "val":
            t = tune_threshold(m.predict(val).withColumn("k", F.lit(1)), ["k"], F.col("p_rain"), F.col("y") > 0).first()["threshold"]
            csi = csi_at(scored, F.col("p_rain"), F.lit(t))
        else:
            grid = [0.05 + i * 0.025 for i in range(37)]
            obs, n = F.col("y") > 0, lambda c: F.count(F.when(c, 1))
            row = scored.agg(*[ratio(n(obs & (F.col("p_rain") >= g)), n(obs | (F.col("p_rain") >= g))) for g in grid]).first()
            csi = max((v for v in row if v is not None), default=None)
        out[f"csi_test_when_tuned_on_{name}"] = csi
        out[f"trees_when_tuned_on_{name}"] = m.clf.getNumTrees
    return out
