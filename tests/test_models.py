"""Recursions against their explicit loops, radar motion, calibration and fitting."""

import math
import random
import types

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GeneralizedLinearRegression
from pyspark.sql import functions as F

from checks import q_models
from gaugeflow.models import baselines, boosting, fitted, hybrids, isotonic, loop, sequential
from gaugeflow.operators import radar, sequences
from gaugeflow.operators.halo import Slices
from gaugeflow.params import RadarParams
from gaugeflow.plans.batch import Benchmark


def series(spark, values, name="z"):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], f"station_id string, minute long, {name} double")


@pytest.mark.parametrize("chunk", [10_080, 17])
def test_filter_equals_loop(spark, chunk):
    z = np.random.default_rng(0).random(200)
    for model in (sequential.LocalLevel(-3.0, -0.7), sequential.DampedTrend(-3.0, -5.0, -0.7, 1.0), sequential.DrivenLevel(-3.0, -0.7, 1.0)):
        f, _ = model.settled()
        got = [r["z_next"] for r in f.forecast(series(spark, z), slices=Slices(chunk)).orderBy("minute").collect()]
        x, want = np.zeros(len(f.k)), []
        for v in z:
            x = f.a @ x + f.k * (v - f.h @ x)
            want.append(f.h @ x)
        assert np.allclose(got, want, atol=1e-8)


def test_filter_with_inputs(spark):
    rng = np.random.default_rng(1)
    z, u = rng.random(60), rng.random((60, 2))
    df = spark.createDataFrame([("a", i, float(z[i]), u[i].tolist()) for i in range(60)], "station_id string, minute long, z double, u array<double>")
    f = sequential.LinearFilter([[0.9]], [0.4], [1.0], [0.2, -0.1])
    got = [r["z_next"] for r in f.forecast(df, "z", "u", slices=Slices(7)).orderBy("minute").collect()]
    x, want = 0.0, []
    for i in range(60):
        x = 0.9 * x + 0.4 * (z[i] - x) + u[i] @ [0.2, -0.1]
        want.append(x)
    assert np.allclose(got, want, atol=1e-8)


def test_gain_solves_riccati():
    q, r = 0.05, 0.5
    k, s = sequential.steady_gain(np.eye(1), np.array([[q]]), r, np.array([1.0]))
    p = (q + math.sqrt(q * q + 4 * q * r)) / 2
    assert s == pytest.approx(p + r) and k[0] == pytest.approx(p / (p + r))
    for decay in (1.0, 0.7, 0.01):
        k, s = sequential.steady_gain(np.array([[decay]]), np.array([[q]]), r, np.array([1.0]))
        assert sequential.level_gain(decay, q, r) == pytest.approx((k[0], s), rel=1e-9)


def test_search_prefers_the_generating_noise(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(0, 1.0, 400))
    z = x + rng.normal(0, 0.1, 400)
    blocks = spark.createDataFrame([(z.tolist(),)], "z array<double>")
    best = sequential.filter_likelihood_search(blocks, "kalman_ll")
    assert best.model.log_drift > best.model.log_noise
    u = np.stack([np.ones(400), rng.random(400)], 1)
    y = np.zeros(400)
    for t in range(399):
        y[t + 1] = 0.8 * y[t] + u[t] @ [0.1, 0.7] + rng.normal(0, 0.05)
    driven = spark.createDataFrame([(y.tolist(), u.tolist())], "z array<double>, u array<array<double>>")
    got = sequential.filter_likelihood_search(driven, "kalman_x", "z", "u", 2)
    assert got.weights[1] > 0.2


def test_search_meets_the_closed_form(spark):
    """On pairs of values the best gain is a regression slope and the variance its mean squared residual."""
    rng = np.random.default_rng(5)
    z0 = rng.normal(0, 1, 500)
    z1 = 0.6 * z0 + rng.normal(0, 0.3, 500)
    blocks = spark.createDataFrame([([float(a), float(b)],) for a, b in zip(z0, z1)], "z array<double>")
    got = sequential.filter_likelihood_search(blocks, "kalman_ll")
    k = z0 @ z1 / (z0 @ z0)
    v = ((z1 - k * z0) ** 2).mean()
    assert got.filter.k[0] == pytest.approx(k, rel=1e-4) and got.variance == pytest.approx(v, rel=1e-4)
    assert got.loss == pytest.approx(0.5 * (math.log(2 * math.pi * v) + 1), abs=1e-8)


@pytest.mark.parametrize("kind", list(sequential.KINDS))
def test_search_ends_at_a_minimum(spark, kind):
    """The loss by a plain loop is the reported one, and no neighbour in any parameter is lower."""
    rng = np.random.default_rng(6)
    u = np.stack([np.ones(300), rng.random(300)], 1)
    x, slope, z = 0.0, 0.0, []
    for t in range(300):
        z.append(x + rng.normal(0, 0.2))
        slope = 0.7 * slope + rng.normal(0, 0.1)
        x = 0.9 * x + slope + (u[t] @ [0.05, 0.3] if kind == "kalman_x" else 0) + rng.normal(0, 0.2)
    z = np.array(z)
    m = 2 if kind == "kalman_x" else 0
    cut = [(z[:200].tolist(), u[:200].tolist()), (z[200:].tolist(), u[200:].tolist())]
    got = sequential.filter_likelihood_search(spark.createDataFrame(cut, "z array<double>, u array<array<double>>"), kind, "z", "u" if m else None, m)

    def loss(theta, weights):
        f, s = sequential.KINDS[kind](*theta).settled(np.vstack([weights, np.zeros((1 if kind == "kalman_llt" else 0, m))]) if m else None)
        errors = []
        for zs, us in ((z[:200], u[:200]), (z[200:], u[200:])):
            state = np.zeros(len(f.k))
            for t in range(len(zs) - 1):
                state = f.f @ state + f.k * zs[t] + (f.b @ us[t] if m else 0)
                errors.append(zs[t + 1] - f.h @ state)
        return 0.5 * (math.log(2 * math.pi * s) + np.mean(np.square(errors)) / s)

    theta, weights = np.array([getattr(got.model, f) for f in got.model.__dataclass_fields__]), np.array(got.weights)
    assert loss(theta, weights) == pytest.approx(got.loss, abs=1e-9)
    for axis in range(len(theta) + m):
        for sign in (1, -1):
            step = np.zeros(len(theta) + m)
            step[axis] = sign * 0.05
            assert loss(theta + step[: len(theta)], weights + step[len(theta):]) >= got.loss - 1e-6


@pytest.mark.parametrize("chunk", [10_080, 13])
def test_regime_filter(spark, chunk):
    rain = [0.0] * 50 + [0.3] * 20 + [0.0] * 30
    m = sequential.RegimeModel()
    got = m.filter_forecast(series(spark, rain, "rain_rt"), slices=Slices(chunk)).orderBy("minute").collect()
    assert all(abs(sum(r["regime"]) - 1) < 1e-6 for r in got)
    assert got[60]["p_rain"] > got[10]["p_rain"]
    state, want = m.prior, []
    for e in m.likelihood(np.array(rain)):
        a = state * e / (state * e).sum()
        state = a @ m.move
        want.append(float(state @ (1 - m.p_zero)))
    assert np.allclose([r["p_rain"] for r in got], want, atol=1e-8)


def whole_series_sums(model, rain):
    """Expectation step over one series by the plain recursions."""
    like, n, k = model.likelihood(rain), len(rain), model.k
    a, norm, ahead = np.empty((n, k)), np.empty(n), model.prior
    for t in range(n):
        norm[t] = (ahead * like[t]).sum()
        a[t] = ahead * like[t] / norm[t]
        ahead = a[t] @ model.move
    b, moves = np.ones((n, k)), np.zeros((k, k))
    for t in range(n - 1, 0, -1):
        b[t - 1] = model.move @ (like[t] * b[t]) / norm[t]
        moves += a[t - 1][:, None] * model.move * (like[t] * b[t])[None, :] / norm[t]
    g = a * b
    wet, log = g * (rain > 0)[:, None], np.log(np.where(rain > 0, rain, 1))[:, None]
    return np.concatenate([moves.ravel(), g[0], g.sum(0), (g - wet).sum(0), wet.sum(0), (wet * log).sum(0), (wet * log**2).sum(0), [np.log(norm).sum(), 1]])


def wet_series(seed, n):
    rng = np.random.default_rng(seed)
    return np.where(rng.random(n) < 0.1 + 0.6 * (np.sin(np.arange(n) / 9) > 0.6), rng.choice([0.1, 0.2, 0.7], n), 0.0)


@pytest.mark.parametrize("chunk", [1000, 17, 1])
def test_expectation_sees_whole_series(spark, chunk):
    """Slices of any length, one of them a single tick, give the sums of the uncut series."""
    lengths = {"a": 103, "b": 1, "c": 17, "d": 40}
    rows = [(s, i, float(v)) for k, (s, n) in enumerate(lengths.items()) for i, v in enumerate(wet_series(k, n))]
    cut = sequential.stretches(spark.createDataFrame(rows, "station_id string, minute long, rain_rt double"), Slices(chunk))
    m = sequential.RegimeModel()
    want = sum(whole_series_sums(m, wet_series(k, n)) for k, n in enumerate(lengths.values()))
    assert np.allclose(m.expectation(cut), want, atol=1e-8)


def test_em_raises_the_likelihood(spark):
    rows = [(s, i, float(v)) for s in range(6) for i, v in enumerate(wet_series(s, 120))]
    cut = sequential.stretches(spark.createDataFrame(rows, "station_id long, minute long, rain_rt double"), Slices(50))
    m = sequential.RegimeModel().fit(cut, 5)
    assert len(m.loglik) == 5 and all(b >= a - 1e-6 for a, b in zip(m.loglik, m.loglik[1:]))
    assert list(m.p_zero) == sorted(m.p_zero, reverse=True) and np.allclose(m.move.sum(1), 1)
    nothing = sequential.RegimeModel().fit(cut.limit(0), 2)
    assert nothing.loglik == [] and (nothing.move == sequential.RegimeModel().move).all()


def test_motion_sign_and_size(spark):
    p = RadarParams(size=64, tile=64, tile_step=64, min_wet=0.02)
    rng = np.random.default_rng(0)
    block = rng.random((20, 20)) * 5 + 1
    rows = [(t, int(r + dr), int(c + dc), float(block[r, c])) for t, dr, dc in ((0, 20, 24), (10, 26, 20)) for r in range(20) for c in range(20)]
    comp = spark.createDataFrame(rows, "scan long, row long, col long, rain double")
    tiles, whole = radar.tile_motion(comp, p)
    for v in (tiles.first(), whole.first()):
        assert v["scan"] == 10 and abs(v["vy"] - 0.6) < 0.15 and abs(v["vx"] + 0.4) < 0.15
    gap = comp.withColumn("scan", F.col("scan") * 4)
    assert radar.tile_motion(gap, p)[0].count() == 0


def test_bounded_search_equals_the_exhaustive_one(spark):
    """Noise, a moved block whose coarse picture points elsewhere, and lone pixels; squares of any side give the same vectors."""
    p = RadarParams(size=24, tile=12, tile_step=6, min_wet=0.0, min_peak=0.0, global_min_wet=0.0, max_speed=0.7)
    rng = np.random.default_rng(11)
    noise = rng.random((24, 24)) * (rng.random((24, 24)) < 0.3)
    block = rng.random((5, 5)) + 0.5
    later = np.zeros((24, 24))
    later[9:14, 6:11] = block
    later[0:9, 0:24:2] = 0.8
    earlier = np.zeros((24, 24))
    earlier[6:11, 8:13] = block
    earlier[12:21, 1:24:2] = 0.9
    lone = np.zeros((24, 24))
    lone[3, 4] = lone[20, 22] = 1.0
    fields = [noise, np.roll(noise, (2, -3), (0, 1)), earlier, later, lone, np.roll(lone, 1, 0), noise * 0]
    comp = spark.createDataFrame([(10 * t, r, c, float(f[r, c])) for t, f in enumerate(fields) for r in range(24) for c in range(24)], "scan long, row long, col long, rain double").cache()
    rows = lambda dfs: [sorted(tuple(round(v, 7) for v in r) for r in d.collect()) for d in dfs]
    want = rows(radar.tile_motion(comp, p, 1))
    assert len(want[0]) > 10 and len(want[1]) >= 4
    for coarse in (3, 4):
        assert rows(radar.tile_motion(comp, p, coarse)) == want


@pytest.mark.parametrize("coarse", [2, 3, 5])
def test_bounds_hold_every_score(coarse):
    p = RadarParams(size=17, max_speed=0.6)
    rng = np.random.default_rng(coarse)
    cells = []
    for _ in range(2):
        row, col = np.nonzero((rng.random((17, 17)) < 0.5) & (np.add.outer(np.arange(17), np.arange(17)) < 14))
        cells.append([row, col, rng.random(len(row)) + 0.1])
    pair, ruled_out = radar._Pair(*cells, 10, p, coarse), 0
    for tile, r, c in ((8, 0, 0), (8, 5, 3), (8, 2, 4), (17, 0, 0)):
        start, bound = pair.bounds(r, c, tile)
        dy, dx, score = pair.scores(r, c, tile, *(d.ravel() for d in np.mgrid[-6:7, -6:7]))
        assert len(score) > 50
        ruled_out += int((bound < score.max()).sum())
        square = lambda d: np.searchsorted(start, d, "right") - 1  # noqa: B023, E731
        assert (score <= bound[square(dy), square(dx)] + 1e-8).all()
        best = pair.best(r, c, tile)
        assert best[2] == score.max()
    assert ruled_out


def test_motion_is_dealt_by_scans_and_only_when_asked_for(spark):
    """No job runs before a result is read, and pairs of small fields are not merged into a task by their few bytes."""
    p = RadarParams(size=8, tile=4, tile_step=2)
    rows = [(t, r, c, float(1 + (r + c + t) % 3)) for t in range(0, 400, 10) for r in range(8) for c in range(8)]
    comp = spark.createDataFrame(rows, "scan long, row long, col long, rain double")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    tiles, whole = radar.tile_motion(comp, p)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    assert tiles.count() > 0 and whole.rdd.getNumPartitions() == 8 and whole.count() == 39


@pytest.mark.parametrize("band", [64, 5])
def test_bands_equal_windows_cut_by_hand(spark, band, monkeypatch):
    """Unknown and missing cells, stations at the edges and beyond, windows and upstream cells over the border of a band."""
    monkeypatch.setattr(radar, "BAND", band)
    p = RadarParams(size=20, windows=(3, 5, 9), max_lead=4)
    rng = np.random.default_rng(3)
    field = {(t, r, c): None if rng.random() < 0.3 else float(rng.random() * (rng.random() < 0.5)) for t in (0, 5) for r in range(20) for c in range(20) if rng.random() < 0.9 and not (t == 5 and r > 9)}
    comp = spark.createDataFrame([(*k, v) for k, v in field.items()], "scan long, row long, col long, rain double")
    spots = [("a", 0, 0), ("b", 19, 19), ("c", 10, 4), ("d", 5, 19), ("e", 9, 9)]
    got = {(r["scan"], r["station_id"]): r.asDict() for r in radar.pixel_window_stats(comp, spark.createDataFrame(spots, "station_id string, row long, col long"), p).collect()}
    want = 0
    for t in (0, 5):
        for s, y, x in spots:
            for k in p.windows:
                cells = [(r, c) for r in range(max(y - k // 2, 0), min(y + k // 2, 19) + 1) for c in range(max(x - k // 2, 0), min(x + k // 2, 19) + 1)]
                known = [field[t, r, c] for r, c in cells if field.get((t, r, c)) is not None]
                row = got.get((t, s))
                if row is None:
                    assert not any((t, r, c) in field for r, c in cells)
                    continue
                want += k == 9
                expected = (np.mean(known), max(known), sum(v > p.wet_mmh for v in known) / len(cells)) if known else (None,) * 3
                assert tuple(row[f"radar_{n}{k}"] for n in ("r_mean", "r_max", "wetfrac")) == (expected if not known else pytest.approx(expected))
                if k == 9:
                    assert row["radar_nodata9"] == pytest.approx(1 - len(known) / len(cells)) and row["radar_r_pix"] == field.get((t, y, x))
    assert want == len(got)
    moves = [(t, s, y, x, float(rng.normal()) * 2, float(rng.normal()) * 2) for t in (0, 5) for s, y, x in spots]
    moving = spark.createDataFrame(moves, "scan long, station_id string, row long, col long, vy double, vx double")
    for r in radar.advect_nowcast(comp, moving, p).collect():
        for lead, v in enumerate(r["adv"], 1):
            y, x = round(r["row"] + r["radar_motion_v"] * lead), round(r["col"] - r["radar_motion_u"] * lead)
            near = [field.get((r["scan"], y + i, x + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)] if 1 <= y <= 18 and 1 <= x <= 18 else []
            near = [q for q in near if q is not None]
            assert v == (pytest.approx(np.mean(near)) if near else None)


def test_grid_map_finds_the_radar_pixel(spark):
    g = spark.createDataFrame([("s", 0, 40, 40, 1.0, 1.0, 10.28, 55.92, 10.6, 56.1)],
                              "site string, geom_id int, nx int, ny int, xscale double, yscale double, ll_lon double, ll_lat double, lon0 double, lat0 double")
    m = radar.site_grid_map(g, half_km=15.0)
    near = m.orderBy("dist_km").first()
    assert abs(near["row"] - 14.5) <= 1 and abs(near["col"] - 14.5) <= 1 and near["dist_km"] < 1
    rows = {(r["row"], r["col"]): r["pixel"] for r in m.collect()}
    assert rows[(10, 11)] - rows[(10, 10)] == 1 and rows[(11, 10)] - rows[(10, 10)] == 40


def test_image_with_wrong_shape_is_skipped(spark):
    g = spark.createDataFrame([("s", 0, 2, 2)], "site string, geom_id int, nx int, ny int")
    im = spark.createDataFrame([(1, "s", 0, [0, 255, 100, 100]), (2, "s", 0, [1, 2, 3])], "scan long, site string, geom_id int, raw array<int>")
    out = {r["pixel"]: r["rain"] for r in radar.image_pixels(im, g).collect()}
    assert len(out) == 4 and out[0] == 0 and out[1] is None and out[2] > 0


def test_isotonic_is_monotone_and_clipped(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(x / 100, float(rng.random() < x / 100)) for x in range(100)] + [(5.0, 1.0), (None, 0.0)], "s double, o double")
    cal = isotonic.IsotonicCalibrator().fit(df.where("s < 1"), "s", F.col("o"))
    got = [r["p"] for r in cal.apply(df, "s", "p").orderBy("s").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(got, got[1:])) and 0 <= min(got) and max(got) <= 1


def pool_adjacent(points):
    stack = []
    for x, s, w in points:
        stack.append([x, x, s, w])
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            _, hi, s1, w1 = stack.pop()
            stack[-1] = [stack[-1][0], hi, stack[-1][2] + s1, stack[-1][3] + w1]
    return [(lo, hi, s / w) for lo, hi, s, w in stack]


@pytest.mark.parametrize("fan", [2, 8])
def test_isotonic_merge_equals_one_stack(spark, fan):
    """Rising, falling, flat, saw-toothed and noisy curves side by side, cut into many partitions."""
    rng = np.random.default_rng(fan)
    x = np.arange(400)
    shapes = {"up": x, "down": -x, "flat": rng.random(400), "saw": x % 50 - x / 40, "noisy": x / 100 + rng.normal(0, 1, 400), None: np.sin(x / 30)}
    rows = [(c, float(i), float(v), float(1 + i % 3)) for c, vs in shapes.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "c string, x double, y double, w double")
    got = isotonic.levels(isotonic.pooled(df, F.col("x"), F.col("y"), F.col("w"), F.col("c")), fan).collect()
    for c, vs in shapes.items():
        want = pool_adjacent([(float(i), float(v) * (1 + i % 3), 1.0 + i % 3) for i, v in enumerate(vs)])
        mine = sorted((r["lo"], r["hi"], r["value"]) for r in got if r["curve"] == c)
        assert [m[:2] for m in mine] == [w[:2] for w in want], c
        assert np.allclose([m[2] for m in mine], [w[2] for w in want])


def test_isotonic_in_pieces_and_by_curve(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(c, float(x), float(rng.random() < x / 50)) for c in ("a", "b") for x in range(50) for _ in range(5)]
    df = spark.createDataFrame([*rows, ("z", 3.0, 1.0), ("a", None, 0.0), ("a", 99.0, 1.0), ("a", 7.5, 0.0)], "model string, s double, o double")
    cal = isotonic.IsotonicCalibrator().fit(df.where("model <> 'z'"), "s", F.col("o"), curve="model")
    want = sorted(map(str, cal.apply(df, "s", "p").collect()))
    assert sum(r["p"] is None for r in cal.apply(df, "s", "p").collect()) == 1
    monkeypatch.setattr(isotonic, "PIECE", 3)
    assert sorted(map(str, cal.apply(df, "s", "p").collect())) == want


def test_isotonic_without_rows(spark):
    df = spark.createDataFrame([], "s double, o double")
    assert isotonic.IsotonicCalibrator().fit(df, "s", F.col("o")).apply(df, "s", "p").count() == 0


def test_nonneg_weights(spark):
    rng = np.random.default_rng(0)
    y = rng.random((300, 3))
    truth = y @ [0.7, 0.0, 0.4] - 0.3 * y[:, 1]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(y, truth)], "y0 double, y1 double, y2 double, y_true double")
    w = np.array(hybrids.nonneg_stack_weights(df, 3))
    assert (w >= 0).all() and w[1] == 0
    ref, _, _, _ = np.linalg.lstsq(y[:, [0, 2]], truth, rcond=None)
    assert np.allclose(w[[0, 2]], ref, atol=1e-6)


def test_singular_least_squares_is_minimum_norm(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0), (2.0, 4.0, 6.0, 1.0)], "a double, b double, y double, w double")
    r = baselines.weighted_least_squares(df, F.col("a"), F.col("b"), F.col("y"), F.col("w")).first()
    assert (r["coef_a"], r["coef_b"]) == pytest.approx((0.6, 1.2))


@pytest.mark.parametrize("bins", [2, 256])
def test_leaf_quantiles_are_exact(spark, bins):
    rng = np.random.default_rng(bins)
    rows = [(float(k), float(v), float(w)) for k, n in enumerate((0, 1, 7, 300, 40)) for v, w in zip(rng.choice([rng.random(), 0.0, 0.1, 1e9, -3.0], n) if k % 2 else rng.normal(0, 1, n), rng.integers(0, 4, n) + 0.5)]
    got = boosting.leaf_quantiles(spark.createDataFrame(rows, "leaf double, r double, w double"), 5, 0.9, bins)
    for k in range(5):
        mine = sorted((v, w) for leaf, v, w in rows if leaf == k)
        want, total, upto = 0.0, sum(w for _, w in mine), 0.0
        for v, w in mine:
            upto += w
            if upto >= 0.9 * total * (1 - 1e-12):
                want = v
                break
        assert got[k] == want


@pytest.fixture(scope="module")
def skewed_amounts(spark):
    """Amounts with many zeros whose mean and spread bend with two inputs; half for validation."""
    rng = np.random.default_rng(8)
    a, b = rng.random(1600), rng.random(1600)
    wet = rng.random(1600) < 0.15 + 0.65 * (abs(a - 0.5) < 0.2)
    y = np.where(wet, np.round(rng.gamma(1.0 + 3 * (b > 0.5) * (abs(a - 0.5) < 0.2), 0.4), 1), 0.0)
    rows = [(float(p), float(q), float(v), 1.0 + i % 2, i % 2 == 1) for i, (p, q, v) in enumerate(zip(a, b, y))]
    return fitted.assemble(spark.createDataFrame(rows, "a double, b double, y double, w double, is_val boolean"), ["a", "b"]).cache()


def held_out(df, loss, value):
    return df.where("is_val").agg(F.sum(F.col("w") * loss.loss(F.col("y"), value)) / F.sum("w")).first()[0]


def test_pinball_boosting_beats_one_tree(spark, skewed_amounts):
    df, loss = skewed_amounts, boosting.Pinball(0.9)
    m = boosting.Booster(loss, rounds=12, depth=3, step=0.3).fit(df)
    assert len(m.trees) >= 3 and all(b < a for a, b in zip(m.losses, m.losses[1:]))
    assert held_out(m.predict(df, "q"), loss, F.col("q")) == pytest.approx(m.losses[-1])
    tree = DecisionTreeRegressor(labelCol="y", weightCol="w", maxDepth=3, leafCol="leaf").fit(df.where("NOT is_val"))
    values = boosting.leaf_quantiles(tree.transform(df.where("NOT is_val")).select("leaf", F.col("y").alias("r"), "w"), tree.numNodes // 2 + 1, 0.9)
    assert m.losses[-1] < held_out(tree.transform(df), loss, boosting._of(values))


def test_tweedie_boosting_beats_the_linear_model(spark, skewed_amounts):
    df, loss = skewed_amounts, boosting.Tweedie(1.3)
    m = boosting.Booster(loss, rounds=12, depth=3, step=0.3).fit(df)
    assert len(m.trees) >= 3 and all(b < a for a, b in zip(m.losses, m.losses[1:]))
    assert held_out(m.predict(df, "mu"), loss, F.log("mu")) == pytest.approx(m.losses[-1])
    glm = GeneralizedLinearRegression(family="tweedie", variancePower=1.3, linkPower=0.0, labelCol="y", weightCol="w", regParam=1e-3).fit(df.where("NOT is_val"))
    assert m.losses[-1] < held_out(glm.transform(df), loss, F.log("prediction"))


def test_hurdle_models_learn(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        wet = rng.random() < 0.4
        x = rng.gauss(1.0 if wet else -1.0, 0.5)
        rows.append(("a", i, x, rng.random(), 0.3 if wet and x > 1 else 0.1 if wet else 0.0, 1.0, 0.0))
    df = spark.createDataFrame(rows, "station_id string, minute long, P_a double, N_b double, y double, w double, rain_now double")
    for m in (fitted.LogisticHurdle(), fitted.BoostedHurdle(rounds=5, depth=3), fitted.TweedieAmount(rounds=5, depth=3, step=0.5)):
        out = m.fit(df, df).predict(df)
        wet, dry = out.where("y > 0").agg(F.avg("p_rain")).first()[0], out.where("y = 0").agg(F.avg("p_rain")).first()[0]
        assert wet > dry + 0.3 and out.agg(F.min("y_hat")).first()[0] >= 0
    assert out.count() == 600


def test_sequences_do_not_depend_on_slices(spark):
    df = series(spark, range(50), "rain_rt")
    a, b = ({r["minute"]: r["x"] for r in sequences.sequence_windows(df, ["rain_rt"], 6, s).collect()} for s in (Slices(), Slices(9)))
    assert a == b and min(a) == 5 and a[7] == [[float(i)] for i in range(2, 8)]


def test_only_wanted_sequences_are_built(spark):
    df = series(spark, range(40), "rain_rt").withColumn("w", F.col("minute") % 7)
    got = sequences.sequence_windows(df, ["rain_rt"], 5, Slices(8), F.col("w") == 0, ("w",)).collect()
    assert sorted(r["minute"] for r in got) == [7, 14, 21, 28, 35]
    assert all([v[0] for v in r["x"]] == [float(i) for i in range(r["minute"] - 4, r["minute"] + 1)] and r["w"] == 0 for r in got)


def test_image_attributes_count(spark):
    im = spark.createDataFrame([(1, "s", 0, [100, 7, 9], 1.0, -60.0, 7.0, 9.0), (2, "s", 0, [100, 255, 0], None, None, None, None)],
                               "scan long, site string, geom_id int, raw array<int>, gain double, offset double, nodata double, undetect double")
    out = {(r["scan"], r["pixel"]): r["rain"] for r in radar.image_pixels(im).collect()}
    assert abs(out[1, 0] - (10 ** (40 / 10) / 200) ** (1 / 1.6)) < 1e-9 and out[1, 1] is None and out[1, 2] == 0
    assert abs(out[2, 0] - (10 ** (18 / 10) / 200) ** (1 / 1.6)) < 1e-9 and out[2, 1] is None and out[2, 2] == 0


def test_composite_is_the_same_at_any_map_size(spark):
    cells = [("a", 0, 0, 0, 0, 1.0), ("a", 0, 0, 1, 1, 1.0), ("b", 0, 0, 1, 0, 0.5), ("b", 0, 1, 1, 1, 2.0), ("a", 0, 1, 0, 3, 1.0)]
    grid = spark.createDataFrame(cells, "site string, geom_id int, row long, col long, pixel int, dist_km double")
    im = spark.createDataFrame([(1, "a", 0, [100, 120, 0]), (1, "b", 0, [255, 90]), (2, "a", 0, [0, 1]), (2, "b", 0, [110, 100])], "scan long, site string, geom_id int, raw array<int>")
    sets = [sorted(map(tuple, d.select("scan", "row", "col", "rain").collect())) for d in (
        radar.composite_from_images(im, grid), radar.composite_from_images(im, grid, most=0), radar.nearest_site_composite(radar.image_pixels(im), grid))]
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) == 6
    shape = spark.createDataFrame([("a", 0, 3, 1), ("b", 0, 2, 1)], "site string, geom_id int, nx int, ny int")
    assert {r["scan"] for r in radar.composite_from_images(im, grid, shape).where("col = 0").collect()} == {1}


def test_a_failing_model_does_not_stop_the_others(spark):
    class Good:
        name = "good"

        def fit(self, train, val):
            return self

        def predict(self, df):
            return df.selectExpr("station_id", "minute", "1D AS p_rain", "0D AS y_hat", "CAST(NULL AS DOUBLE) AS q90")

    class Bad(Good):
        name = "bad"

        def predict(self, df):  # fails when it runs, not when it is planned
            return df.selectExpr("station_id", "minute", "CAST(raise_error('no') AS DOUBLE) AS p_rain", "0D AS y_hat", "CAST(NULL AS DOUBLE) AS q90")

    rows = spark.createDataFrame([("1", 5)], "station_id string, minute long")
    preds, failed = loop.fit_predict_loop([Bad(), Good()], rows, rows, {"test": rows})
    assert [r["model"] for r in preds.collect()] == ["good"] and list(failed) == ["bad"]
    assert loop.fit_predict_loop([Bad()], rows, rows, {"test": rows})[0] is None


@pytest.mark.parametrize("n", [1, 31, 32, 33, 200])
def test_filter_runs_equal_the_loop(n):
    rng = np.random.default_rng(n)
    f = sequential.LinearFilter([[1.0, 0.8], [0.0, 0.8]], [0.4, 0.1], [1.0, 0.0])
    push, x, want = rng.normal(size=(n, 2)), np.array([0.5, -0.2]), []
    for p in push:
        x = f.f @ x + p
        want.append(x)
    assert np.allclose(f.states(push, np.array([0.5, -0.2])), want, atol=1e-10)


def test_recursions_are_dealt_by_tasks_not_by_bytes(spark, monkeypatch):
    """Slices of short series stay in many tasks, and the regimes' chains make no call a series."""
    rows = spark.createDataFrame([(f"s{i}", m, float(m % 3)) for i in range(40) for m in range(20 + i % 2)], "station_id string, minute long, z double")
    got = sequential.LinearFilter([[0.9]], [0.3], [1.0]).forecast(rows, slices=Slices(chunk=5))
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    model = sequential.RegimeModel()
    want = sum(model.expected(np.array([[float(m % 3) for m in range(20 + i % 2)]])) for i in range(40))

    def refuse(*_, **__):
        raise AssertionError("a call a series")

    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", refuse)
    v = model.expectation(sequential.stretches(rows.withColumnRenamed("z", "rain_rt"), Slices(chunk=5)))
    assert np.allclose(v, want, rtol=1e-9)


def test_a_failed_model_is_an_error_of_the_report(spark, monkeypatch):
    """The report of the others must not look like the whole one, and no forecast of a failed model reaches the sink."""
    class Late:
        name = "late"

        def fit(self, train, val):
            return self

        def predict(self, df):  # fails on the last split only
            return df.selectExpr("station_id", "minute", "CAST(if(minute > 7, raise_error('no'), 1) AS DOUBLE) AS p_rain", "0D AS y_hat", "CAST(NULL AS DOUBLE) AS q90")

    rows = [spark.createDataFrame([("1", m, 0.1, 1.0)], "station_id string, minute long, P_lag0 double, w double") for m in (5, 8)]
    models, sunk = [baselines.Simple("persistence"), Late()], []
    _, failed = loop.fit_predict_loop(models, rows[0], rows[0], {"val": rows[0], "test": rows[1]}, sink=lambda name, split, _: sunk.append((name, split)))
    assert list(failed) == ["late"] and sunk == [("persistence", "val"), ("persistence", "test")]
    bench = Benchmark({"train": (0, 5), "val": (5, 8), "test": (8, 9)})
    with pytest.raises(RuntimeError, match="late"):
        bench.forecasts(rows[0], *rows, models)
    monkeypatch.setattr(Benchmark, "truth_table", lambda self, readings: readings)
    monkeypatch.setattr(Benchmark, "gated", lambda self, table, year=None: table)
    monkeypatch.setattr(Benchmark, "channel_table", lambda self, table, stations: table)
    monkeypatch.setattr(Benchmark, "split_table", lambda self, chans, gated, split, bounds: rows[split == "test"])
    monkeypatch.setattr(Benchmark, "evaluate", lambda self, val, test, preds: {"all": preds})
    with pytest.raises(RuntimeError, match="late"):
        bench.run(rows[0], rows[0], models, None)
    tables = bench.run(rows[0], rows[0], models, None, allow_failed=True)
    assert [r["model"] for r in tables["failed"].collect()] == ["late"] and {r["model"] for r in tables["all"].collect()} == {"persistence"}
    assert bench.run(rows[0], rows[0], models[:1], None)["failed"].count() == 0


def training_rows(spark):
    rng = random.Random(5)
    rows = [("a", i, rng.gauss(1.0 if i % 3 else -1.0, 0.5), 0.2 if i % 3 else 0.0, 1.0, 0.0) for i in range(400)]
    return spark.createDataFrame(rows, "station_id string, minute long, P_a double, y double, w double, rain_now double")


@pytest.mark.parametrize("fit", [lambda d: fitted.BoostedHurdle(rounds=2, depth=2).fit(d, d), lambda d: fitted.TweedieAmount(rounds=2, depth=2).fit(d, d),
                                 lambda d: loop.tuning_leak_experiment(d, d, d, rounds=2, depth=2)])
def test_boosted_models_have_no_bound_on_training_rows(spark, monkeypatch, fit):
    def refuse(*_, **__):
        raise AssertionError("training rows are thinned")

    monkeypatch.setattr(fitted, "uniform_row_cap", refuse, raising=False)
    fit(training_rows(spark))


def test_every_tree_sees_all_training_rows(spark):
    """The model whose inputs are ranked, too: no tree is fitted on a share of the rows."""
    df = training_rows(spark)
    m = fitted.BoostedHurdle(quantile=False, rounds=3, depth=2).fit(df, df)
    for model, rows in ((m.clf, 400), (m.reg, df.where("y > 0").count())):
        assert [t._java_obj.rootNode().impurityStats().count() for t in model.trees] == [rows] * len(model.trees)


def test_regime_query_runs_to_its_own_end(spark, monkeypatch):
    """The query stops by the model's rule, as the library does, not after a few rounds."""
    rows = [(s, i, float(v)) for s in ("a", "b") for i, v in enumerate(wet_series(ord(s), 90))]
    models, fit = [], sequential.RegimeModel.fit
    monkeypatch.setattr(sequential.RegimeModel, "fit", lambda self, *a, **k: models.append(self) or fit(self, *a, **k))
    view = types.SimpleNamespace(own_channels=spark.createDataFrame(rows, "station_id string, minute long, rain_rt double"))
    got = q_models.regime_em(view).first()
    line = models[0].loglik
    assert got["loglik"] == line[-1] and (len(line) == 30 or line[-1] - line[-2] < 1e-8 * abs(line[-1]))
