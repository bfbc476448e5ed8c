"""Nothing at or before t changes when the data after t changes, and slicing never shows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.clock import Clock
from gaugeflow.operators import channels, features, neighbours, radar, stations
from gaugeflow.operators.halo import Slices
from gaugeflow.params import RadarParams

N, CUT, START = 300, 200, 28_000_000


def observations(spark, late_seed):
    rows = []
    for sid in range(1, 5):
        early, late = random.Random(sid), random.Random(late_seed * 100 + sid)
        for m in range(N):
            r = early if m <= CUT else late
            rain = (r.choice([0.1, 0.2, 0.3]) if r.random() < 0.2 else 0.0) if r.random() < 0.7 else None
            ten = m % 10 == 0
            met = lambda lo, hi: r.uniform(lo, hi) if ten else None
            rows.append((f"{sid:05d}", START + m, rain, r.choice([0.0, 0.4]) if ten else None, met(0, 20), met(40, 100), met(0, 12), met(0, 360), met(0, 100)))
    return spark.createDataFrame(rows, "station_id string, minute long, p1_obs double, p10_obs double, temp_dry double, humidity double, wind_speed double, wind_dir double, cloud_cover double")


def table(spark):
    return spark.createDataFrame([("00001", 9.0, 55.9), ("00002", 9.2, 56.0), ("00003", 9.4, 56.1), ("00004", 9.1, 56.05)], "station_id string, lon double, lat double")


def build(spark, seed, chunk):
    s, t = Slices(chunk), table(spark)
    own = channels.station_channels(observations(spark, seed), t, Clock(), slices=s)
    prof = neighbours.neighbour_profile(stations.station_pair_table(t), t)
    chan = neighbours.neighbour_trend(neighbours.neighbour_aggregates(own, prof, payload=list(channels.OWN)), s)
    return features.build_features(chan, slices=s)


def same(a, b):
    a, b = ({(r["station_id"], r["minute"]): r for r in d.collect()} for d in (a, b))
    assert a.keys() == b.keys() and a
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == y or (x is not None and y is not None and abs(x - y) <= 1e-9 * max(1, abs(x)))


def test_features_do_not_see_the_future(spark):
    a, b = build(spark, 1, 10_080), build(spark, 2, 10_080)
    assert len(a.columns) == 2 + 72
    same(a.where(F.col("minute") <= START + CUT), b.where(F.col("minute") <= START + CUT))


def test_slicing_does_not_change_features(spark):
    same(build(spark, 1, 10_080), build(spark, 1, 100))


def test_wet_spell_longer_than_a_slice(spark):
    df = spark.createDataFrame([("a", m, 0.0 if m in (3, 90) else 0.1) for m in range(100)], "station_id string, minute long, rain_rt double")
    s = Slices(10)
    out = s.own(features.spell_accumulation(s.widen(df, 2), s, features.open_spell_carry(df, s)))
    got = {r["minute"]: r["P_spell_accum"] for r in out.collect()}
    run = 0.0
    for m in range(100):
        run = 0.0 if m in (3, 90) else run + 0.1
        assert got[m] == pytest.approx(run)


def test_scan_visible_only_after_latency(spark):
    minutes = spark.createDataFrame([("a", m) for m in range(120)], "station_id string, minute long")
    scans = spark.createDataFrame([("a", t, float(t), [float(t)] * 25) for t in range(0, 60, 10)], "station_id string, scan long, radar_r_mean11 double, adv array<double>")
    for chunk in (10_080, 50):
        got = {r["minute"]: r for r in radar.radar_minute_channels(minutes, scans, RadarParams(), Slices(chunk)).collect()}
        assert all(got[m]["radar_age_min"] is None for m in range(5)) and got[5]["radar_age_min"] == 5
        assert got[14]["radar_age_min"] == 14 and got[15]["radar_age_min"] == 5
        assert got[95]["radar_age_min"] == 45 and got[96]["radar_age_min"] is None
        assert got[15]["radar_trend11"] == 10.0


def test_ring_edge_and_lonely_station(spark):
    pairs = spark.createDataFrame([("a", "b", 25.0, 10.0)], "station_id string, neighbour_id string, dist_km double, bearing_deg double")
    st = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 0.0)], "station_id string, lon double, lat double")
    sig = spark.createDataFrame([(s, 1, 0.4, 2.0, 0.0) for s in "abc"], "station_id string, minute long, rain_signal double, wind_u double, wind_v double")
    got = {r["station_id"]: r for r in neighbours.neighbour_aggregates(sig, neighbours.neighbour_profile(pairs, st)).collect()}
    assert got["a"]["nb_r0_N"] == 0 and got["a"]["nb_r1_N"] == pytest.approx(0.4)
    assert got["a"]["nb_upwind_r0"] == got["a"]["nb_upwind_r1"] == pytest.approx(0.4)
    assert got["a"]["regional_wind_u"] == 2.0
    assert got["c"]["regional_wind_u"] == 0.0 and got["c"]["nb_mean"] == 0.0


def test_neighbour_columns_equal_a_loop_over_pairs(spark, monkeypatch):
    """Any cut into blocks and minutes, gaps, unknown signals and winds, a repeated row; no row per pair is made."""
    def refuse(*_, **__):
        raise AssertionError("a row per pair and minute")

    monkeypatch.setattr(neighbours, "neighbour_signal_join", refuse)
    rng = random.Random(3)
    pts = [(f"s{i}", 9.0 + rng.random() * 1.6, 55.5 + rng.random() * 0.8) for i in range(14)] + [("far", 30.0, 10.0), ("nowhere", None, None)]
    st = spark.createDataFrame(pts, "station_id string, lon double, lat double")
    some = lambda v: None if rng.random() < 0.3 else v
    rows = [(s, m, some(rng.choice([0.0, 0.0, 0.5, 2.0])), some(rng.gauss(0, 3)), some(rng.gauss(0, 3)), rng.randint(0, 9))
            for s, *_ in pts for m in range(-7, 12) if rng.random() < 0.8]
    rows += [(r[0], r[1], 1.0, 2.0, None, 20) for r in rows[:3]] + [("unlisted", 1, 1.0, 1.0, 1.0, 1)]
    sig = spark.createDataFrame(rows, "station_id string, minute long, rain_signal double, wind_u double, wind_v double, tag int")
    pairs = stations.station_pair_table(st)
    prof = neighbours.neighbour_profile(pairs, st)
    static = {}
    for r in prof.where("NOT is_self").collect():
        static.setdefault(r["station_id"], []).append(r)
    at = {}
    for r in rows:
        at.setdefault((r[0], r[1]), []).append(r)
    want = {}
    for (s, m), own in at.items():
        if s == "unlisted":
            continue
        near = [(p, r) for p in static.get(s, ()) for r in at.get((p["neighbour_id"], m), ())]
        blow = ([r for p, r in near if p["dist_km"] <= 60] + own) if s in static else []
        mean = lambda v: sum(v) / len(v) if v else None
        u, v = mean([r[3] for r in blow if r[3] is not None]), mean([r[4] for r in blow if r[4] is not None])
        windy = u is not None and v is not None and u * u + v * v > 0.01
        n, out = len(static.get(s, ())), {"tag": max(r[5] for r in own), "regional_wind_u": u or 0.0, "regional_wind_v": v or 0.0}
        for i, name in enumerate(channels.CELLS):
            cell = [p for p in static.get(s, ()) if p["cell"] == i]
            out[name] = sum(r[2] or 0.0 for p, r in near if p["cell"] == i) / len(cell) if cell else 0.0
        out["nb_max"] = max([r[2] or 0.0 for _, r in near], default=0.0)
        out["nb_mean"] = sum(r[2] or 0.0 for _, r in near) / n if n else 0.0
        out["nb_wet_frac"] = sum((r[2] or 0.0) > 0 for _, r in near) / n if n else 0.0
        out["nb_nearest"] = sum(r[2] or 0.0 for p, r in near if p["nearest"])
        for ring in ("r0", "r1"):
            here = [(p, r) for p, r in near if p[f"in_{ring}"]]
            k = [max(math.cos(math.radians(p["bearing_deg"]) - math.atan2(u, v) - math.pi), 0.0) if windy else 0.0 for p, _ in here]
            count = sum(p[f"in_{ring}"] for p in static.get(s, ()))
            plain = sum(r[2] or 0.0 for _, r in here) / count if count else 0.0
            out[f"nb_upwind_{ring}"] = sum(w * (r[2] or 0.0) for w, (_, r) in zip(k, here)) / sum(k) if sum(k) > 0 else plain
        want[s, m] = out
    for most, minutes, step in ((20_000, 240, 500_000), (5, 3, 40)):
        for name, value in (("PAIRS_A_BLOCK", most), ("MINUTES_A_GROUP", minutes), ("VALUES_AT_ONCE", step)):
            monkeypatch.setattr(neighbours, name, value)
        prof = neighbours.neighbour_profile(pairs, st)
        assert most > 5 or prof.select("block").distinct().count() > 6
        got = {(r["station_id"], r["minute"]): r.asDict() for r in neighbours.neighbour_aggregates(sig, prof, payload=["tag"]).collect()}
        assert got.keys() == want.keys()
        for key, out in want.items():
            assert {c: got[key][c] for c in out} == pytest.approx(out, abs=1e-9), key


def test_salted_and_broadcast_joins_agree(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_A_TASK", 100)
    t = table(spark)
    own = channels.station_channels(observations(spark, 1), t, Clock())
    prof = neighbours.neighbour_profile(stations.station_pair_table(t), t)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = []
    for value in ("1g", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
        out.append({tuple(r) for r in neighbours.neighbour_signal_join(own, prof, ["rain_signal"]).select("station_id", "minute", "neighbour_id", "rain_signal").collect()})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert out[0] == out[1] and out[0]


def test_pair_cells_miss_nobody(spark):
    rng = random.Random(1)
    pts = [(f"{i:05d}", rng.uniform(-180, 180), rng.choice([rng.uniform(-89, 89), rng.uniform(54, 56)])) for i in range(60)]
    pts += [(f"{100 + i:05d}", 179.9 if i % 2 else -179.9, 10 + 0.1 * i) for i in range(6)] + [(f"{200 + i:05d}", 60.0 * i, 89.8) for i in range(6)]
    df = spark.createDataFrame(pts, "station_id string, lon double, lat double")
    got = {(r[0], r[1]) for r in stations.station_pair_table(df, 400.0).select("station_id", "neighbour_id").collect()}
    import math
    want = set()
    for a, lo1, la1 in pts:
        for b, lo2, la2 in pts:
            p1, p2, dl = math.radians(la1), math.radians(la2), math.radians(lo2 - lo1)
            h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
            if a != b and 2 * 6371 * math.asin(min(1, math.sqrt(h))) <= 400:
                want.add((a, b))
    assert got == want and want
