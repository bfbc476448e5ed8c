"""Golden scores, thresholds, resampling and link attenuation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import link
from gaugeflow.operators import links, resample, verify
from gaugeflow.params import LinkParams


def test_contingency_scores(spark):
    df = spark.createDataFrame([("m", o, f) for o, f in zip([1, 1, 0, 0, 1], [1, 0, 1, 0, 1])], "model string, o int, f int")
    r = verify.categorical_scores(verify.contingency(df, ["model"], F.col("o") > 0, F.col("f") > 0)).first()
    assert (r["pod"], r["far"], r["csi"]) == pytest.approx((2 / 3, 1 / 3, 1 / 2))


def test_threshold_separates(spark):
    rng = np.random.default_rng(0)
    obs = rng.random(2000) < 0.1
    score = np.where(obs, 0.7, 0.2) + rng.normal(0, 0.05, 2000)
    df = spark.createDataFrame([("m", float(s), bool(o)) for s, o in zip(score, obs)], "model string, s double, o boolean")
    thr = verify.tune_threshold(df, ["model"], F.col("s"), F.col("o")).first()["threshold"]
    assert 0.3 < thr < 0.65
    flat = spark.createDataFrame([("m", 0.3, True), ("m", 0.3, False)], "model string, s double, o boolean")
    assert verify.tune_threshold(flat, ["model"], F.col("s"), F.col("o")).first()["threshold"] == 0.5


def test_threshold_and_ranks_match_brute_force(spark):
    rng = random.Random(5)
    rows = [("m", rng.choice([0.0, 0.0, 0.0, rng.random(), round(rng.random(), 1)]), rng.random() < 0.3) for _ in range(700)]
    df = spark.createDataFrame(rows, "model string, s double, o boolean")
    ranks = {r["score"]: r for r in verify.ranked_scores(df, ["model"], F.col("s"), F.col("o")).collect()}
    s = np.array([r[1] for r in rows])
    o = np.array([r[2] for r in rows])
    for v, r in ranks.items():
        assert r["below"] == (s < v).sum() and r["pos_below"] == o[s < v].sum() and r["n"] == (s == v).sum()
    cand = np.unique(np.quantile(s, np.linspace(0.5, 0.9999, 200)))
    cand = cand[cand > 0]
    csi = [(o & (s >= c)).sum() / (o | (s >= c)).sum() for c in cand]
    got = verify.tune_threshold(df, ["model"], F.col("s"), F.col("o")).first()["threshold"]
    assert got == pytest.approx(cand[int(np.argmax(csi))])


def test_reliability_edges(spark):
    df = spark.createDataFrame([("m", p, 1.0) for p in (0.0, 0.3, 0.29, 1.0, 1.7)], "model string, p_rain double, y_true double")
    assert {r["bin"]: r["n"] for r in verify.reliability_table(df, ["model"]).collect()} == {0: 1, 3: 1, 2: 1, 9: 2}


def test_diebold_mariano(spark):
    rng = np.random.default_rng(2)
    rows = [(m, d, float(x), 1) for m, mean in (("a", 1.0), ("b", 1.3)) for d, x in enumerate(rng.normal(mean, 0.1, 200))]
    stats = spark.createDataFrame(rows, "model string, day long, sse double, n long")
    pairs = spark.createDataFrame([("a", "b")], "model_a string, model_b string")
    r = resample.diebold_mariano(stats, pairs).first()
    assert r["dm_stat"] < 0 and r["p_value"] < 0.01
    short = resample.diebold_mariano(stats.where("day < 9"), pairs).first()
    assert short["dm_stat"] is None and short["p_value"] is None


def test_draws_use_every_slot_and_are_shared(spark):
    stats = spark.createDataFrame([(m, d, 1.0, 1, 1, 0, 0) for m in "ab" for d in range(12)],
                                  "model string, day long, sse double, n long, hits long, misses long, false_alarms long")
    draws = resample.day_draws(stats, 40)
    assert {r[0] for r in draws.groupBy("draw").agg(F.sum("times")).select(F.col("sum(times)")).collect()} == {12}
    assert draws.count() < 40 * 12


def test_power_law_constants():
    for f, pol, k, a in ((10, "H", 0.01217, 1.2571), (20, "V", 0.09611, 0.9847), (30, "H", 0.2403, 0.9485)):
        got = link.power_law(f, pol)
        assert got[0] == pytest.approx(k, rel=2e-3) and got[1] == pytest.approx(a, rel=2e-3)


def test_attenuation_grows_and_starts_at_zero(spark):
    rain = spark.createDataFrame([(float(r),) for r in (-1, 0, 1, 5, 10, 50, 100)], "mmh double").withColumn("k", F.lit(1))
    lat = spark.createDataFrame([(1, 56.0)], "k int, lat_deg double")
    out = links.with_attenuation(rain.withColumn("mm", F.col("mmh") / 60), lat, ["k"], {"db": "mm"}, LinkParams())
    for s in LinkParams().scenarios:
        v = [r["db"] for r in out.where(F.col("scenario") == s["name"]).orderBy("mmh").collect()]
        assert v[0] == v[1] == 0 and all(b > a for a, b in zip(v[1:], v[2:]))
    k, a = link.power_law(38, "V")
    r = spark.range(1).select(link.terrestrial_path_attenuation(F.lit(100.0), F.lit(k), F.lit(a), F.lit(38.0), F.lit(5.0))).first()[0]
    assert 0 < r < k * 100 ** a * 5


def test_null_rows_never_score(spark):
    df = spark.createDataFrame([("m", None, 1.0, 0.5), ("m", 0.4, 0.0, None)], "model string, q90 double, y_true double, p_rain double")
    assert verify.pinball(df, ["model"]).first()["pinball_q90"] is None
    assert math.isclose(verify.average_precision(df, ["model"]).first()["pr_auc"], 1.0)
