"""Sources, sinks and the live stream over small files."""

import json

from pyspark.sql import functions as F

from gaugeflow.clock import Clock
from gaugeflow.models import baselines
from gaugeflow.operators import neighbours, stations
from gaugeflow.sources import catalog, sinks, text_tables
from gaugeflow.streaming import live


def test_station_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "06123_10min.csv").write_text("time,precip_past10min,precip_past1min\n2024-01-01T00:00:00Z,0.5,0.1\nnonsense,1,1\n2024-01-01 00:01:00+00:00,bad,NaN\n2024-01-01T00:00:00Z,,0.9\n")
    (tmp_path / "06124_10min.csv").write_text('time,"temp_dry"\n2024-01-01T00:10:00Z,"3.5"\n')
    rows = {(r["station_id"], r["time"].minute, r["precip_past1min"]): r for r in text_tables.read_station_csv(spark, str(tmp_path)).collect()}
    assert len(rows) == 4
    assert rows[("06123", 0, 0.1)]["precip_past10min"] == 0.5
    assert rows[("06123", 1, None)]["precip_past10min"] is None
    assert rows[("06124", 10, None)]["temp_dry"] == 3.5
    man = {r["station_id"]: r for r in text_tables.source_manifest(spark, str(tmp_path)).collect()}
    assert man["06123"]["has_1min"] and not man["06124"]["has_1min"]
    assert man["06123"]["columns"] == "precip_past10min|precip_past1min" and man["06123"]["rows"] == 4
    assert man["06123"]["first"] == man["06123"]["last"] == "2024-01-01T00:00:00Z"


def test_overlap_folders(spark, tmp_path):
    for day in ("01", "02"):
        d = tmp_path / "station_id=6123.0" / day
        d.mkdir(parents=True)
        (d / "x.csv").write_text(f"time,precip_past1min\n2024-01-{day}T00:00:00Z,0.0\n")
    rows = text_tables.read_dense_overlap(spark, str(tmp_path)).collect()
    assert {r["station_id"] for r in rows} == {"06123"} and len(rows) == 2


def test_published_metrics(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,csi,pod\nx,0.2,0.5\ny,0.4,\n")
    got = {r["metric"]: (round(r["mean"], 6), r["rows"]) for r in text_tables.published_metric_summary(spark, str(tmp_path)).collect()}
    assert got == {"csi": (0.3, 2), "pod": (0.5, 2)}


def test_api_json(spark, tmp_path):
    f = lambda p, t, v: {"properties": {"parameterId": p, "observed": t, "stationId": "06123", "value": v}}
    doc = {"features": [f("temp_dry", "t1", 1.0), f("temp_dry", "t1", 2.0), f("visibility", "t1", 9.0), f("humidity", "t2", 50.0)]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = {r["time"]: r for r in catalog.observation_api_json(spark, str(tmp_path)).collect()}
    assert got["t1"]["temp_dry"] == 2.0 and got["t1"]["humidity"] is None and got["t2"]["humidity"] == 50.0


def test_scan_names(spark, tmp_path):
    for n in ("ekxr20250701_1210.h5", "eksm20250701_1210.h5", "readme.txt"):
        (tmp_path / n).write_text("x")
    r = catalog.scan_file_catalog(catalog.list_files(spark, str(tmp_path))).collect()
    assert len(r) == 1 and set(r[0]["files"]) == {"ekxr", "eksm"} and r[0]["scan_time"].hour == 12


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2020), ("b", 2, 2020)], "station_id string, minute long, year int")
    sinks.write_partitioned(df, str(tmp_path / "t"))
    sinks.write_partitioned(df.where("station_id = 'a'").withColumn("minute", F.col("minute") + 10), str(tmp_path / "t"))
    assert sorted(r["minute"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2, 11]
    p = sinks.write_predictions(df.where("false").withColumn("y_hat", F.lit(-1.0)), str(tmp_path), "A", "zero", "test")
    assert spark.read.parquet(p).count() == 0 and spark.read.parquet(p).columns == ["station_id", "minute", "p_rain", "y_hat", "q90"]
    left = sinks.unfinished(df, spark.read.parquet(str(tmp_path / "t")).where("station_id = 'a'"))
    assert [r["station_id"] for r in left.collect()] == ["b"]


def test_stream_equals_batch(spark, tmp_path):
    """Overlapping polls, late fields and an unknown station: the state and forecast match one batch."""
    st = spark.createDataFrame([("00001", 9.0, 55.9), ("00002", 9.2, 56.0)], "station_id string, lon double, lat double")
    prof = neighbours.neighbour_profile(stations.station_pair_table(st), st)
    clock, base = Clock(), 1_704_067_200
    records = [{"station_id": s, "time": f"2024-01-01T00:{m:02d}:30Z", "precip_past1min": round(0.1 * ((m + k) % 3), 1), "temp_dry": 5.0 + m}
               for k, s in enumerate(("1", "00002", "99999")) for m in range(30)]
    polls = [[r for r in records if lo <= int(r["time"][14:16]) < hi] for lo, hi in ((0, 12), (8, 20), (15, 30))]
    feed = tmp_path / "feed"
    feed.mkdir()
    for i, rows in enumerate(polls):
        (feed / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
    svc = live.LiveNowcast(spark, str(tmp_path / "live"), st, prof, baselines.moving_average, clock)
    stream = spark.readStream.schema(live.RECORD_SCHEMA).option("maxFilesPerTrigger", 1).json(str(feed))
    svc.start(stream, available_now=True).awaitTermination()
    all_at_once = spark.read.schema(live.RECORD_SCHEMA).json(str(feed)).withColumn("seq", F.monotonically_increasing_id())
    want = live.ingest_records(all_at_once, st, clock)
    assert {tuple(r) for r in svc.state(2).collect()} == {tuple(r) for r in want.collect()}
    last = svc.forecasts().where("epoch = 2").drop("epoch")
    batch = live.rolling_history_forecast(want, st, prof, baselines.moving_average, clock=clock)
    got, ref = ({r["station_id"]: r for r in d.collect()} for d in (last, batch))
    assert got.keys() == ref.keys() == {"00001", "00002"}
    for s in got:
        assert got[s]["p_rain"] == ref[s]["p_rain"] and got[s]["issue_minute"] == base // 60 + 29
        assert got[s]["input_age_min"] == 0 and got[s]["warning"] is False and len(got[s]["attenuation_db"]) == 4
    svc.handle(all_at_once.drop("seq").where("station_id = '1'"), 3)
    assert {tuple(r) for r in svc.state(3).collect()} == {tuple(r) for r in want.collect()}
    assert svc._stored() == [(0, 2), (0, 3)]
    svc.handle(all_at_once.drop("seq").where("station_id = '1'"), 5)  # an epoch that skips a number
    assert {tuple(r) for r in svc.state(5).collect()} == {tuple(r) for r in want.collect()}
    # a service with a new progress folder: epochs start at 0 again, the state goes on
    again = live.LiveNowcast(spark, str(tmp_path / "live"), st, prof, baselines.moving_average, clock, progress="progress-2")
    late = spark.createDataFrame([("2", "2024-01-01T00:30:10Z", 0.7)], "station_id string, time string, precip_past1min double")
    late = late.select("station_id", F.to_timestamp("time").alias("time") if dict(stream.dtypes)["time"] == "timestamp" else F.col("time"), "precip_past1min")
    again._enter_run()
    again.handle(late, 0)
    assert again.run == 1 and again.state(0).count() == want.count() + 1
    assert live.LiveNowcast(spark, str(tmp_path / "live"), st, prof, baselines.moving_average, clock, progress="progress-2")._enter_run() == 1
    again.handle(late, 0)  # replayed
    assert again.state(0).count() == want.count() + 1 and again.forecasts().select("run", "epoch").distinct().count() == 6


def test_watermarked_dedup(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = [{"station_id": "1", "time": f"2024-01-01T00:{m:02d}:00Z", "precip_past1min": 0.1} for m in (1, 1, 2)]
    (feed / "a.json").write_text("\n".join(map(json.dumps, rows)))
    s = live.drop_resent(spark.readStream.schema(live.RECORD_SCHEMA).json(str(feed)))
    q = s.writeStream.format("memory").queryName("resent").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("resent").count() == 2


def test_streamed_scores_equal_the_replay(spark, tmp_path):
    """Truth that comes later than its forecast, re-sent and invalid truth, a forecast without any; restart in between."""
    at = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    issued = [{"station_id": s, "valid_time": at(m), "rain_mm_next_minute": 0.1 * (m % 4)} for s in ("a", "b") for m in range(90)]
    rain = [{"station_id": s, "time": at(m), "valid": int(m % 5 > 0), "precip": 0.1 * (m % 3)} for s in ("a", "b") for m in range(90) if not (s == "b" and 20 <= m < 30)]
    minute = lambda r: int(r.get("valid_time", r.get("time"))[11:13]) * 60 + int(r.get("valid_time", r.get("time"))[14:16])
    feeds = {"f": issued, "t": rain}
    for name in feeds:
        (tmp_path / name).mkdir()

    def feed(k, lo, hi):
        for name, rows in feeds.items():
            late = 5 if name == "t" else 0
            chosen = [r for r in rows if lo - late <= minute(r) < hi - late]
            (tmp_path / name / f"{k}.json").write_text("\n".join(map(json.dumps, chosen + chosen[:3])))  # some are sent again

    kinds = {"f": "station_id string, valid_time timestamp, rain_mm_next_minute double", "t": "station_id string, time timestamp, valid int, precip double"}

    def run():
        f, t = (spark.readStream.schema(kinds[n]).option("maxFilesPerTrigger", 1).json(str(tmp_path / n)) for n in "ft")
        out = live.score_stream(f, t, "20 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    feed(0, 0, 30), feed(1, 30, 60)
    run()
    feed(2, 60, 90)
    run()  # a restart: the state of the first run is found again
    got = spark.read.parquet(str(tmp_path / "out"))
    rows = {(r["station_id"], r["valid_time"].minute + 60 * r["valid_time"].hour): r for r in got.collect()}
    assert len(rows) == got.count()
    valid = {(r["station_id"], minute(r)): r["precip"] for r in rain if r["valid"] and minute(r) < 85}
    assert {k: r["observed"] for k, r in rows.items() if r["observed"] is not None} == valid
    assert {("a", 20), ("b", 21), ("b", 28)} <= {k for k, r in rows.items() if r["observed"] is None}
    clock = Clock()
    forecasts = spark.read.schema(kinds["f"]).json(str(tmp_path / "f")).distinct().withColumn("valid_minute", clock.index(F.col("valid_time")))
    truth = spark.read.schema(kinds["t"]).json(str(tmp_path / "t")).distinct().withColumn("minute", clock.index(F.col("time")))
    want = live.replay_scoring(forecasts, truth).first()
    mean = got.agg(F.count("observed"), F.avg("error_mm")).first()
    assert mean[0] == want["scored"] and abs(mean[1] - want["mae_mm"]) < 1e-12


def test_quoted_commas_and_headers_alone(spark, tmp_path):
    (tmp_path / "00001_a.csv").write_text('time,"wind, dir",precip_past1min\n2024-01-01T00:00:00Z,"1,5",0.3\n"2024-01-01T00:01:00Z",2,0.4\n')
    (tmp_path / "00002_b.csv").write_text("time,precip_past10min\n")
    rows = {str(r["time"])[-8:-3]: r["precip_past1min"] for r in text_tables.read_station_csv(spark, str(tmp_path)).collect()}
    assert rows == {"00:00": 0.3, "00:01": 0.4}
    seen = {r["station_id"]: (r["rows"], r["columns"], r["first"]) for r in text_tables.source_manifest(spark, str(tmp_path)).collect()}
    assert seen["00001"][0] == 2 and seen["00002"] == (0, "precip_past10min", None)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.csv").write_text("model,csi,far\na,0.5,0.1\nb,0.7,\n")
    (tmp_path / "m" / "y.csv").write_text("model,csi\n")
    got = {(r["file"], r["metric"]): (r["mean"], r["rows"]) for r in text_tables.published_metric_summary(spark, str(tmp_path / "m")).collect()}
    assert got == {("x.csv", "csi"): (0.6, 2), ("x.csv", "far"): (0.1, 2), ("y.csv", "csi"): (None, 0)}
