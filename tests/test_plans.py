"""Shape of the physical plans and the driver contract."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.proxies import RADAR, SLICES, Proxy
from gaugeflow.operators import radar, truth
from gaugeflow.operators.halo import Slices
from gaugeflow.params import RadarParams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

ROW_LEVEL = ("persistence_csi_by_station", "dedup_first_nonnull", "validate_truth", "tip_harmonise", "next_minute_target", "dense_regime", "quality_by_year",
             "station_pair_table", "station_channels", "all_channels", "build_features", "part_history_join", "sample_weights", "index_prediction_join",
             "common_row_intersection", "contingency", "average_precision", "scores_by_station_and_month", "attenuation_scores", "leakage_audit",
             "nearest_site_composite", "pixel_window_stats", "motion_blend", "advect_nowcast", "asof_scan_to_minute", "radar_minute_channels",
             "climatology_forecast", "sequence_windows", "ingest_upsert", "late_data_cutoff", "rain_rate_transform", "uniform_row_cap")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_cross_join_and_no_single_task_window(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if "Window [" in line:  # the list after the expressions is the partitioning, not an order
            assert not re.search(r"Window \[.*\], \[[^\]]*ASC[^\]]*\]$", line) or line.count("], [") >= 2, line


def test_no_window_is_partitioned_by_station_alone(spark):
    for name in ("validate_truth", "station_channels", "next_minute_target", "dense_regime", "asof_scan_to_minute", "rolling_stats"):
        plan = plan_of(entry.queries()[name](spark, SF))
        assert "Window" in plan
        for line in plan.splitlines():
            keys = re.search(r"\], \[(station_id#\d+[^\]]*)\]", line) if "Window [" in line else None
            assert keys is None or "," in keys.group(1), line


def test_truth_is_one_shuffle_and_one_sort(spark):
    plan = plan_of(entry.queries()["validate_truth"](spark, SF))
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and len(re.findall(r"\bSort\b", plan)) == 1


def test_composite_expands_inside_the_task(spark):
    plan = plan_of(entry.queries()["composite_from_images"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(scan", plan)) == 1
    assert not re.search(r"Exchange hashpartitioning\(scan#\d+L, row", plan)


def test_radar_windows_are_read_from_bands(spark):
    for name in ("pixel_window_stats", "advect_nowcast"):
        plan = plan_of(entry.queries()[name](spark, SF))
        assert not re.search(r"Exchange hashpartitioning\((scan#\d+L, )?row", plan), name
    view = Proxy(spark, SF)
    plan = plan_of(radar.pixel_window_stats(view.comp, view.st_px, RADAR))
    assert len(re.findall(r"Exchange hashpartitioning\(scan#\d+L, band", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning\(scan", plan)) == 1
    plan = plan_of(radar.advect_nowcast(view.comp, view.moving, RADAR))
    assert len(re.findall(r"Exchange hashpartitioning\(scan#\d+L, band", plan)) == 2  # cells and reads, nothing else by cell


def test_slice_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("a", m, 0.1, 1, 2.0) for m in range(50)], "station_id string, minute long, precip double, valid int, temp_dry double")
    df.write.parquet(str(tmp_path / "t"))
    out = truth.scan_truth_slice(spark.read.parquet(str(tmp_path / "t")), "a", 10, 20, ["precip"])
    plan = plan_of(out)
    assert "temp_dry" not in plan and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(minute,10\)", plan) and out.count() == 10


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) > 120 and len(q) >= 138


def test_stations_reach_scans_without_a_shuffle_by_band(spark, monkeypatch):
    """All scans of a band would come into one task."""
    view = Proxy(spark, SF)
    rows = lambda: sorted(tuple(r) for r in radar.pixel_window_stats(view.comp, view.st_px, RADAR).select("scan", "station_id", "radar_r_mean5").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(radar.pixel_window_stats(view.comp, view.st_px, RADAR))
        assert not re.search(r"Exchange hashpartitioning\(band#\d+L?, \d+\)", plan)
        want = rows()
        monkeypatch.setattr(radar, "MOST_SENT", 0)
        monkeypatch.setattr(radar, "PART", 2)
        plan = plan_of(radar.pixel_window_stats(view.comp, view.st_px, RADAR))
        assert not re.search(r"Exchange hashpartitioning\(band#\d+L?, \d+\)", plan) and rows() == want and want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upstream_reads_of_one_band_need_no_join(spark):
    """Every row of a station and scan stays one row: no row a lead, no second shuffle to put them together."""
    view = Proxy(spark, SF)
    plan = plan_of(radar.advect_nowcast(view.comp, view.moving, RADAR))
    assert "Join" not in plan and not re.search(r"Exchange hashpartitioning\(scan#\d+L, station_id", plan)
    odd = view.moving.limit(3).unionByName(view.moving.selectExpr("scan", "CAST(NULL AS STRING) AS station_id", "row", "col", "vy", "vx").limit(1))
    odd = odd.unionByName(view.moving.selectExpr("CAST(NULL AS BIGINT) AS scan", "station_id", "row", "col", "vy", "vx").limit(1))
    got = radar.advect_nowcast(view.comp, odd.unionByName(odd), RADAR).collect()
    assert len(got) == 10 and all(len(r.adv) == RADAR.max_lead for r in got)
    assert all(v is None for r in got if r.scan is None or r.station_id is None for v in r.adv)


def test_slices_of_scans_are_dealt_by_a_stated_number(spark):
    """Adaptive execution sizes tasks by packed bytes; rows of scans unpack to many times that."""
    view = Proxy(spark, SF)
    scans = view.scanstat.select("station_id", "scan", "radar_r_mean5")
    by_scan = Slices(SLICES.chunk, order="scan")
    for out in (radar.scan_trend(scans, by_scan, "radar_r_mean5"), radar.asof_scan_to_minute(view.obs.select("station_id", "minute"), scans, RADAR, SLICES)):
        assert re.search(r"Exchange hashpartitioning\(station_id#\d+, chunk_#\d+L?, \d+\), REPARTITION_BY_NUM", plan_of(out))


def radar_rows(spark, scans=6, stations=5):
    """Cells, stations at scans and vectors of a few scans; one scan has no tile, one no vector at all."""
    comp = spark.createDataFrame([(4 * s, r, c, float((s + r * c) % 5) if (r + c + s) % 7 else None) for s in range(scans) for r in range(8) for c in range(8)], "scan long, row long, col long, rain double")
    at = spark.createDataFrame([(4 * s, f"s{k}", 2 + k % 4, 2 + 3 * k % 4, 0.5 * k, k) for s in range(scans) for k in range(stations)], "scan long, station_id string, row long, col long, stat double, more int")
    tiles = spark.createDataFrame([(4 * s, 2.0, 2.0 * t, 0.1 * s, -0.2) for s in range(scans - 2) for t in range(2)], "scan long, tile_r double, tile_c double, vy double, vx double")
    whole = spark.createDataFrame([(4 * s, 0.1, -0.1 * s) for s in range(scans - 1)], "scan long, vy double, vx double")
    return comp, at, tiles, whole


def test_rows_of_scans_stay_where_they_are_for_the_motion(spark, monkeypatch):
    """Vectors go to the rows; past the bound they are joined by scan, with the same rows."""
    _, at, tiles, whole = radar_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = radar.motion_blend(at, tiles, whole, RADAR)
        assert "Exchange hashpartitioning" not in plan_of(d)
        want = sorted(map(tuple, d.collect()))
        monkeypatch.setattr(radar, "MOST_VECTORS", 0)
        d = radar.motion_blend(at, tiles, whole, RADAR)
        assert "Exchange hashpartitioning" in plan_of(d) and sorted(map(tuple, d.collect())) == want and len(want) == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("size", [8, 96])
def test_rows_of_a_band_travel_packed(spark, monkeypatch, size):
    """Packed, loose or both, the reads are the same, with all other columns."""
    comp, at, tiles, whole = radar_rows(spark)
    p = RadarParams(max_lead=5, size=size, tile=4, tile_step=2)
    moving = radar.motion_blend(at, tiles, whole, p)
    odd = moving.unionByName(moving.where("station_id = 's1'").withColumn("station_id", F.lit(None).cast("string"))).unionByName(moving.where("scan = 8").withColumn("vy", F.lit(None).cast("double")))
    got = []
    for most in (1, 3, 10 ** 9):
        monkeypatch.setattr(radar, "PACKED", most)
        d = radar.advect_nowcast(comp, odd, p)
        got.append(sorted(map(repr, d.select(sorted(d.columns)).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 41 and "stat=2.0" in "".join(got[0])


def test_statistics_of_scans_are_not_joined_again(spark):
    view = Proxy(spark, SF)
    view.scanstat, view.comp  # noqa: B018
    built = []
    original, radar_reads = view.build_scanfeat, radar.advect_nowcast
    radar.advect_nowcast = lambda comp, moving, p: built.append(moving.columns) or radar_reads(comp, moving, p)
    try:
        plan = plan_of(original())
    finally:
        radar.advect_nowcast = radar_reads
    assert "radar_r_mean5" in built[0] and "SortMergeJoin" not in plan


def test_scans_that_no_minute_meets_do_not_travel(spark):
    """Neither those after the last minute nor those too old for the first; the trend still sees the scan before."""
    minutes = spark.createDataFrame([("a", m) for m in range(100, 110)], "station_id string, minute long")
    scans = spark.createDataFrame([("a", s, float(s), [float(s)] * 5) for s in range(0, 400, 3) if not 90 < s < 101], "station_id string, scan long, radar_r_mean11 double, adv array<double>")
    by = Slices(chunk=20)
    d = radar.asof_scan_to_minute(minutes, scans, RADAR, by)
    assert "Subquery" in plan_of(d)
    want = {m: max((s for s in range(0, 400, 3) if not 90 < s < 101 and m - 3 <= s <= m - 1), default=None) for m in range(100, 110)}
    assert {r["minute"]: r["scan"] for r in d.collect()} == want and None in want.values()
    got = {r["minute"]: (r["radar_r_mean11"], r["radar_trend11"]) for r in radar.radar_minute_channels(minutes, scans, RADAR, by).collect()}
    assert got[103] == (102.0, 12.0) and got[106] == (105.0, 3.0) and got[100] == (None, None)
    assert radar.asof_scan_to_minute(minutes.limit(0), scans, RADAR, by).count() == 0
