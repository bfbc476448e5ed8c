"""Hand-worked rain windows, cleaning, tips and slicing."""

import random

from pyspark.sql import functions as F

from gaugeflow.operators import quality, truth
from gaugeflow.operators.halo import Slices

OBS = "station_id string, minute long, p1_obs double, p10_obs double, temp_dry double, humidity double, wind_speed double, wind_dir double, cloud_cover double"


def obs(spark, n, p1, p10, sid="00001"):
    return spark.createDataFrame([(sid, m, p1.get(m), p10.get(m), None, None, None, None, None) for m in range(n)], OBS)


def by_minute(df):
    return {r["minute"]: r for r in df.collect()}


def test_window_rules(spark):
    p1 = {12: 0.2, 13: 0.3, 22: 0.1, 41: 0.1}
    p10 = {10: 0.0, 20: 0.5, 30: 1.0, 40: 0.0, 50: 0.0}
    for chunk in (10_080, 20):
        t = by_minute(truth.validate_truth(obs(spark, 61, p1, p10), slices=Slices(chunk)))
        assert all(t[m]["valid"] == 1 for m in range(11, 21))
        assert abs(sum(t[m]["precip"] for m in range(11, 21)) - 0.5) < 1e-9 and t[14]["precip"] == 0
        assert all(t[m]["valid"] == 0 and t[m]["precip"] is None for m in range(21, 31))
        assert all(t[m]["valid"] == 1 for m in range(41, 51))


def test_dense_window_without_total(spark):
    t = by_minute(truth.validate_truth(obs(spark, 11, {m: 0.4 if m == 5 else 0.0 for m in range(0, 11)}, {})))
    assert all(t[m]["valid"] == 1 for m in range(1, 11))
    assert abs(sum(t[m]["precip"] for m in range(1, 11)) - 0.4) < 1e-9


def test_sentinels_and_cloud_code(spark):
    df = spark.createDataFrame([(1, -999999.0, 112.0), (2, 0.2, 101.0), (3, 5.0, 50.0)], "minute long, precip_past1min double, cloud_cover double")
    rows = by_minute(quality.range_clean(df))
    assert rows[1]["precip_past1min"] is None and rows[1]["cloud_cover"] == 100.0
    assert rows[2]["cloud_cover"] is None and rows[3]["precip_past1min"] == 5.0


def test_tips(spark):
    vals = [0.03, 0.04, None, 0.05, 0.0, 0.2]
    for chunk in (10_080, 2):
        df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "station_id string, minute long, p1_obs double")
        out = by_minute(truth.tip_harmonise(df, slices=Slices(chunk)))
        assert out[2]["p1_obs"] is None
        assert abs(sum(out[i]["p1_obs"] or 0 for i in out) - 0.3) < 1e-9
        whole = spark.createDataFrame([("a", i, round(0.1 * (i % 4), 1)) for i in range(9)], "station_id string, minute long, p1_obs double")
        same = by_minute(truth.tip_harmonise(whole, slices=Slices(chunk)))
        assert all(abs(same[i]["p1_obs"] - 0.1 * (i % 4)) < 1e-9 for i in range(9))


def test_slices_do_not_change_truth(spark):
    rng = random.Random(3)
    p1 = {m: rng.choice([0.0, 0.0, 0.1, 0.3]) for m in range(600) if rng.random() < 0.7}
    p10 = {m: round(sum(p1.get(k, 0) for k in range(m - 9, m + 1)) + rng.choice([0, 0, 1]), 1) for m in range(0, 600, 10) if rng.random() < 0.8}
    a, b = (by_minute(truth.next_minute_target(truth.validate_truth(obs(spark, 600, p1, p10), slices=s), s)) for s in (Slices(), Slices(50)))
    assert a == b
    assert by_minute(truth.validate_truth(obs(spark, 600, p1, p10), slices=Slices(50), target=True)) == a


def test_first_nonnull_is_per_column(spark):
    df = spark.createDataFrame([("a", 1, 3, 0.5, None), ("a", 1, 1, None, 7.0), ("a", 1, 2, 0.2, 8.0)],
                               "station_id string, minute long, seq int, precip_past1min double, temp_dry double")
    r = quality.dedup_first_nonnull(df).first()
    assert (r["precip_past1min"], r["temp_dry"]) == (0.2, 7.0)


def test_grid_is_generated_by_many_tasks(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 100_003, 1.0)], "station_id string, minute long, v double")
    g = truth.minute_grid(df, 1000)
    assert g.count() == 100_011
    assert g.groupBy(F.spark_partition_id()).count().count() > 1
