"""Checks: forecasts and sequence data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gaugeflow.functions import rain
from gaugeflow.models import baselines, boosting, fitted, hybrids, loop, sequential
from gaugeflow.models.isotonic import IsotonicCalibrator, levels, pooled
from gaugeflow.operators import sequences, verify
from gaugeflow.session import materialise

from .oracle import isotonic
from .proxies import SLICES
from .q_splits import sql_hash
from .registry import query

OUT = "p_rain y_hat q90"


def tab_train(p):
    return p.tab.where("target_valid = 1 AND minute < 360")


def three_way(p):
    t = p.wide_tab
    return t.where("minute < 360"), t.where("minute >= 360 AND minute < 540"), t.where("minute >= 540")


@query("baseline_zero_persistence_ma", """
SELECT 'zero' AS model, station_id, minute, 0 AS p_rain, 0 AS y_hat, 0 AS q90 FROM tab
UNION ALL SELECT 'persistence', station_id, minute, (P_lag0>0)::INT, P_lag0, P_lag0 FROM tab
UNION ALL SELECT 'moving_average', station_id, minute, P_wetfrac10, P_sum10/10, NULL FROM tab""", dbl=OUT)
def baseline_zero_persistence_ma(p):
    parts = [f(p.tab).select(F.lit(n).alias("model"), "station_id", "minute", *OUT.split()) for n, f in (
        ("zero", baselines.zero), ("persistence", baselines.persistence), ("moving_average", baselines.moving_average))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("climatology_table", "SELECT * FROM clim", dbl="mean_amount wet_share")
def climatology_table(p):
    return baselines.climatology_table(tab_train(p))


LOOKUP = """SELECT t.station_id, t.minute, coalesce(c.mean_amount,o.mean_amount) AS mean_amount, coalesce(c.wet_share,o.wet_share) AS wet_share
FROM tab t LEFT JOIN (SELECT * FROM clim WHERE NOT overall) c ON c.month=t.month AND c.hour=t.hour, (SELECT * FROM clim WHERE overall) o"""


@query("climatology_lookup", LOOKUP, dbl="mean_amount wet_share")
def climatology_lookup(p):
    return baselines.climatology_lookup(p.tab, climatology_table(p)).select("station_id", "minute", "mean_amount", "wet_share")


@query("climatology_forecast", f"SELECT station_id, minute, wet_share AS p_rain, mean_amount AS y_hat, NULL::DOUBLE AS q90 FROM ({LOOKUP})", dbl=OUT)
def climatology_forecast(p):
    return baselines.climatology(p.tab, climatology_table(p)).select("station_id", "minute", *OUT.split())


WLS = """SELECT station_id, (bb*ay-ab*b_y)/(aa*bb-ab*ab) AS coef_a, (aa*b_y-ab*ay)/(aa*bb-ab*ab) AS coef_b FROM (
 SELECT station_id, sum(w*P_lag0*P_lag0) AS aa, sum(w*P_lag0*P_sum10/10) AS ab, sum(w*P_sum10*P_sum10/100) AS bb, sum(w*P_lag0*y) AS ay, sum(w*P_sum10/10*y) AS b_y FROM tab_train GROUP BY 1)"""


@query("weighted_least_squares", WLS, dbl="coef_a coef_b")
def weighted_least_squares(p):
    return baselines.weighted_least_squares(tab_train(p), F.col("P_lag0"), F.col("P_sum10") / 10.0, F.col("y"), F.col("w"), ["station_id"])


@query("persistence_decay", "SELECT station_id, minute, greatest(0, coef_a*P_lag0+coef_b*P_sum10/10) AS y_hat FROM tab, (" + WLS.replace("station_id, ", "").replace(" GROUP BY 1", "") + ")", dbl="y_hat")
def persistence_decay(p):
    return baselines.PersistenceDecay().fit(tab_train(p)).predict(p.tab).select("station_id", "minute", "y_hat")


@query("log_observation", "SELECT station_id, minute, ln(1+100*greatest(coalesce(p1_obs,0),0)) AS z FROM obs", dbl="z")
def log_observation(p):
    return p.obs.select("station_id", "minute", rain.log_observation(F.col("p1_obs")).alias("z"))


@query("exogenous_inputs", "SELECT station_id, minute, 1.0 AS u0, ln(1+10*nb_upwind_r0) AS u1, ln(1+10*nb_upwind_r1) AS u2, ln(1+10*nb_max) AS u3, ln(1+10*nb_mean) AS u4, "
       "ln(1+10*CASE WHEN p10_age<=9 THEN p10_last ELSE 0 END) AS u5, ln(1+10*rain_signal) AS u6, coalesce((rh-80)/20,0) AS u7 FROM channels",
       dbl=" ".join(f"u{i}" for i in range(8)))
def exogenous_inputs(p):
    u = rain.exogenous_inputs(*[F.col(c) for c in ("nb_upwind_r0", "nb_upwind_r1", "nb_max", "nb_mean", "p10_last", "p10_age", "rain_signal", "rh")])
    return p.channels.select("station_id", "minute", *[c.alias(f"u{i}") for i, c in enumerate(u)])


@query("hurdle_expectation", "SELECT station_id, minute, P_wetfrac10*greatest(P_sum10/10-0.05,0) AS y_hat FROM tab", dbl="y_hat")
def hurdle_expectation(p):
    return p.tab.select("station_id", "minute", rain.hurdle_expectation(F.col("P_wetfrac10"), F.col("P_sum10") / 10 - 0.05).alias("y_hat"))


def z_rows(p):
    return log_observation(p)


@query("linear_filter_forecast", """
SELECT a.station_id, a.minute, sum(0.3*pow(0.7::DOUBLE, a.minute-b.minute)*b.z) AS z_next FROM (SELECT station_id, minute, ln(1+100*greatest(coalesce(p1_obs,0),0)) AS z FROM obs) b
JOIN obs a ON a.station_id=b.station_id AND a.minute>=b.minute GROUP BY 1,2""", dbl="z_next")
def linear_filter_forecast(p):
    f = sequential.LinearFilter([[1.0]], [0.3], [1.0])
    return f.forecast(z_rows(p), slices=SLICES).select("station_id", "minute", "z_next")


def filter_blocks(p):
    keep = p.channels.select("station_id", "minute", "rain_rt", "nb_max", "nb_mean", "rain_signal")
    rows = z_rows(p).join(keep, ["station_id", "minute"]).withColumn("part", F.lit("train"))
    rows = rows.withColumn("u", F.array(F.lit(1.0), *[F.log1p(10 * F.coalesce(c, F.lit(0.0))) for c in ("nb_max", "nb_mean", "rain_signal")]))
    return sequential.rain_weighted_blocks(rows, None, 168, 24, values=("z", "u"))


@query("filter_likelihood_search")
def filter_likelihood_search(p):
    """All three kinds over all blocks; at the optimum the innovation variance is the mean squared error."""
    blocks = materialise(filter_blocks(p), "blocks")
    found = {k: sequential.filter_likelihood_search(blocks, k, "z", "u" if k == "kalman_x" else None, 4) for k in sequential.KINDS}
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(f.loss).alias("loss"), F.lit(f.variance).alias("variance"), F.lit(float(f.filter.k[0])).alias("gain"),
                     F.lit(sum(f.weights)).alias("weights")) for k, f in found.items()]
    return blocks.agg(F.count(F.lit(1)).alias("blocks")).select("blocks", F.inline(F.array(*rows)))


PAIRS = "SELECT a.z AS z0, b.z AS z1 FROM (SELECT station_id, minute, ln(1+100*greatest(coalesce(p1_obs,0),0)) AS z FROM obs) a JOIN (SELECT station_id, minute, ln(1+100*greatest(coalesce(p1_obs,0),0)) AS z FROM obs) b ON a.station_id=b.station_id AND b.minute=a.minute+1 AND a.minute%2=0"


@query("filter_closed_form", f"SELECT n, k AS gain, v AS variance, 0.5*(ln(2*pi()*v)+1) AS loss FROM (SELECT count(*) AS n, k, sum((z1-k*z0)**2)/count(*) AS v FROM ({PAIRS}), (SELECT sum(z0*z1)/sum(z0*z0) AS k FROM ({PAIRS})) GROUP BY k)",
       dbl="gain variance loss", digits=5)
def filter_closed_form(p):
    """The search where the answer is known: on pairs of ticks the gain is a regression slope, the variance its mean squared residual."""
    rows = z_rows(p).withColumn("pair", F.floor(F.col("minute") / 2))
    pairs = rows.groupBy("station_id", "pair").agg(F.sort_array(F.collect_list(F.struct("minute", "z"))).alias("s_")).where("size(s_) = 2").select(F.col("s_")["z"].alias("z"))
    found = sequential.filter_likelihood_search(pairs, "kalman_ll")
    return pairs.agg(F.count(F.lit(1)).alias("n")).withColumns({"gain": F.lit(float(found.filter.k[0])), "variance": F.lit(found.variance), "loss": F.lit(found.loss)})


def rain_weighted(p):
    rows = z_rows(p).join(p.own_channels.select("station_id", "minute", "rain_rt"), ["station_id", "minute"]).withColumn("part", F.lit("train"))
    n = p.stations.count() * 2
    return sequential.rain_weighted_blocks(rows, n, 168, 24)


@query("rain_weighted_blocks", f"""
SELECT station_id, 'train' AS part, block, n AS rows, wet FROM (SELECT *, -ln(greatest({sql_hash('station_id', "'train'", 'block', "'42'")},1e-12))/(wet+1) AS k FROM (
 SELECT station_id, (minute-min_)//168 AS block, count(*) AS n, count(*) FILTER (rain_rt>0) AS wet FROM (SELECT *, min(minute) OVER (PARTITION BY station_id) AS min_ FROM chan) GROUP BY 1,2) WHERE n=168)
ORDER BY k LIMIT (SELECT 2*count(*) FROM stations)""")
def rain_weighted_blocks(p):
    return rain_weighted(p).drop("z")


G3 = [[0.98 if i == j else 0.01 for j in range(3)] for i in range(3)]


def _regime_steps() -> tuple[str, str, list[str]]:
    """Rows with the likelihood of each regime, the filter's unscaled step, and the regimes' amounts."""
    p0, mu, sg = (0.995, 0.5225, 0.05), [math.log(0.02), math.log(0.02 * 0.4) / 2, math.log(0.4)], (0.5, 0.7, 0.9)
    like = [f"((CASE WHEN rain_rt>0 THEN {1 - p0[i]!r}*exp(-0.5*pow((ln(CASE WHEN rain_rt>0 THEN rain_rt ELSE 1 END)-({mu[i]!r}))/{sg[i]},2))/({sg[i]}*sqrt(2*pi())) ELSE {p0[i]} END)::DOUBLE)" for i in range(3)]
    rows = f"SELECT station_id, minute, rain_rt, row_number() OVER (PARTITION BY station_id ORDER BY minute) AS i, count(*) OVER (PARTITION BY station_id) AS n, {', '.join(f'{e} AS e{k}' for k, e in enumerate(like))} FROM chan"
    step = ", ".join(f"({'+'.join(f'r.a{k}*{G3[k][j]}' for k in range(3))})*l.e{j} AS b{j}" for j in range(3))
    nxt = [f"({'+'.join(f'a{k}*{G3[k][j]}' for k in range(3))})" for j in range(3)]
    wet = "+".join(f"{nxt[j]}*{1 - p0[j]!r}" for j in range(3))
    amount = "+".join(f"{nxt[j]}*{(1 - p0[j]) * math.exp(mu[j] + sg[j] ** 2 / 2)!r}" for j in range(3))
    return rows, step, [wet, amount]


def _regime_sql() -> str:
    """The filter written as a recursion over the ticks, all stations at once."""
    rows, step, (wet, amount) = _regime_steps()
    return f"""
SELECT station_id, minute, {wet} AS p_rain, {amount} AS y_hat, a0 AS p_dry FROM (
 WITH RECURSIVE l AS MATERIALIZED ({rows}), r AS (
  SELECT station_id, minute, i, e0/(e0+e1+e2) AS a0, e1/(e0+e1+e2) AS a1, e2/(e0+e1+e2) AS a2 FROM l WHERE i=1
  UNION ALL SELECT station_id, minute, i, b0/(b0+b1+b2), b1/(b0+b1+b2), b2/(b0+b1+b2) FROM (SELECT l.station_id, l.minute, l.i, {step} FROM r JOIN l ON l.station_id=r.station_id AND l.i=r.i+1))
 SELECT * FROM r)"""


def _expectation_sql() -> str:
    """Forward and backward recursions over all ticks of a station, and the sums of the expectation step."""
    rows, step, _ = _regime_steps()
    back = [f"({'+'.join(f'{G3[j][k]}*l.e{k}*q.t{k}' for k in range(3))})" for j in range(3)]
    both = [f"r.a{j}*q.t{j}/({'+'.join(f'r.a{k}*q.t{k}' for k in range(3))})" for j in range(3)]
    joint = [[f"r.a{j}*{G3[j][k]}*l.e{k}*q.t{k}" for k in range(3)] for j in range(3)]
    whole = "+".join(x for row in joint for x in row)
    moves = ", ".join(f"sum({joint[j][k]}/({whole})) AS m{j}{k}" for j in range(3) for k in range(3))
    return f"""
SELECT * FROM (
 WITH RECURSIVE l AS MATERIALIZED ({rows}), r AS (
  SELECT station_id, i, e0/(e0+e1+e2) AS a0, e1/(e0+e1+e2) AS a1, e2/(e0+e1+e2) AS a2, ln((e0+e1+e2)/3) AS ll FROM l WHERE i=1
  UNION ALL SELECT station_id, i, b0/(b0+b1+b2), b1/(b0+b1+b2), b2/(b0+b1+b2), ln(b0+b1+b2) FROM (SELECT l.station_id, l.i, {step} FROM r JOIN l ON l.station_id=r.station_id AND l.i=r.i+1)),
 q AS (
  SELECT station_id, i, 1::DOUBLE AS t0, 1::DOUBLE AS t1, 1::DOUBLE AS t2 FROM l WHERE i=n
  UNION ALL SELECT station_id, i, t0/(t0+t1+t2), t1/(t0+t1+t2), t2/(t0+t1+t2) FROM (SELECT l.station_id, l.i-1 AS i, {', '.join(f'{b} AS t{j}' for j, b in enumerate(back))} FROM q JOIN l ON l.station_id=q.station_id AND l.i=q.i WHERE l.i>1)),
 g AS (SELECT rain_rt, r.i, ll, {', '.join(f'{b} AS g{j}' for j, b in enumerate(both))} FROM r JOIN q ON q.station_id=r.station_id AND q.i=r.i JOIN l ON l.station_id=r.station_id AND l.i=r.i)
 SELECT * FROM (SELECT sum(ll) AS loglik, {', '.join(f'sum(g{j}) AS occ{j}, sum(CASE WHEN rain_rt>0 THEN 0 ELSE g{j} END) AS dry{j}, sum(CASE WHEN i=1 THEN g{j} ELSE 0 END) AS first{j}' for j in range(3))} FROM g),
  (SELECT {moves} FROM r JOIN q ON q.station_id=r.station_id AND q.i=r.i+1 JOIN l ON l.station_id=r.station_id AND l.i=r.i+1))"""


@query("regime_filter", _regime_sql(), dbl="p_rain y_hat p_dry")
def regime_filter(p):
    d = sequential.RegimeModel().filter_forecast(p.own_channels.select("station_id", "minute", "rain_rt"), slices=SLICES)
    return d.select("station_id", "minute", "p_rain", "y_hat", F.col("regime")[0].alias("p_dry"))


EXPECTED = [f"m{i}{j}" for i in range(3) for j in range(3)] + [f"{n}{i}" for n in ("first", "occ", "dry") for i in range(3)] + ["loglik"]


@query("regime_expectation", _expectation_sql(), dbl=" ".join(EXPECTED), digits=4)
def regime_expectation(p):
    """One expectation step over whole series, cut into slices that are chained in both directions."""
    v = sequential.RegimeModel().expectation(sequential.stretches(p.own_channels, SLICES))
    return p.spark.range(1).select(*[F.lit(float(x)).alias(n) for n, x in zip(EXPECTED, [*v[:18], v[-2]])])


@query("regime_em")
def regime_em(p):
    rows = sequential.stretches(p.own_channels, SLICES)
    m = sequential.RegimeModel().fit(rows)
    return rows.agg(F.count(F.lit(1)).alias("stretches")).withColumns({"loglik": F.lit(m.loglik[-1]), **{f"p_zero_{i}": F.lit(float(v)) for i, v in enumerate(m.p_zero)}})


@query("residual_correction", "SELECT station_id, minute, y_hat FROM corrected", dbl="y_hat")
def residual_correction(p):
    rows = p.fit_rows.where("model = 'lgbm_hurdle'")
    return hybrids.residual_correction(rows, sequential.LinearFilter([[0.9]], [0.3], [1.0]), SLICES).select("station_id", "minute", "y_hat")


@query("residual_hybrid")
def residual_hybrid(p):
    """Filter fitted on the residuals of the earlier half of the validation days, applied to all of them, with its own probability."""
    rows = p.fit_rows.where("model = 'lgbm_hurdle'")
    return hybrids.ResidualHybrid(slices=SLICES, block=168).fit(rows.where("minute < 450")).predict(rows).select("station_id", "minute", "p_rain", "y_hat")


@query("regime_choice", "SELECT * FROM choice")
def regime_choice(p):
    return hybrids.regime_choice(p.cal_rows)


@query("regime_switch", "SELECT station_id, minute, 'hyb_regime' AS model, p_cal AS p_rain, y_hat FROM cal_rows, choice WHERE model=CASE WHEN rain_now>0 THEN best_wet ELSE best_dry END", dbl="p_rain y_hat")
def regime_switch(p):
    return hybrids.regime_switch(p.cal_rows, hybrids.regime_choice(p.cal_rows))


AMOUNT_POINTS = "(SELECT model, coalesce(y_hat,0) AS x, count(*)::DOUBLE AS w, sum((y_true>0)::INT)::DOUBLE AS s FROM fit_rows GROUP BY 1,2)"


@query("isotonic_calibration", f"SELECT f.model, station_id, minute, y_hat, p_cal FROM fit_rows f JOIN ({isotonic(AMOUNT_POINTS)}) l ON l.model=f.model AND l.x=coalesce(y_hat,0)", dbl="y_hat p_cal")
def isotonic_calibration(p):
    cal = IsotonicCalibrator().fit(p.fit_rows, "y_hat", F.col("y_true") > 0, curve="model")
    return cal.apply(p.fit_rows, "y_hat", "p_cal").select("model", "station_id", "minute", "y_hat", "p_cal")


@query("isotonic_levels", "SELECT model AS curve, min(x) AS lo, max(x) AS hi, p_cal AS value, sum(w) AS weight FROM (SELECT * FROM cal_levels JOIN cal_points USING (model, x)) GROUP BY 1, 4", dbl="lo hi value weight")
def isotonic_levels(p):
    return levels(pooled(p.fit_rows, F.coalesce("p_rain", F.lit(0.0)), F.col("y_true") > 0, F.lit(1.0), F.col("model")))


@query("stacked_ensemble")
def stacked_ensemble(p):
    """All models that predict every row (two of the nine share none)."""
    models = ["zero", "persistence", "moving_average", "kalman_ll", "lgbm_hurdle", "A__logistic_hurdle", "hyb_stack"]
    return hybrids.StackedEnsemble(models).fit(p.fit_rows.where("minute < 450")).predict(p.fit_rows)


@query("nonneg_stack_gram", "SELECT sum(a.y_hat*a.y_hat) AS g0_0, sum(a.y_hat*b.y_hat) AS g0_1, sum(b.y_hat*b.y_hat) AS g1_1, sum(a.y_hat*a.y_true) AS c0, sum(b.y_hat*a.y_true) AS c1 "
       "FROM fit_rows a JOIN fit_rows b ON a.station_id=b.station_id AND a.minute=b.minute AND a.model='persistence' AND b.model='kalman_ll'", dbl="g0_0 g0_1 g1_1 c0 c1")
def nonneg_stack_gram(p):
    return hybrids.gram(hybrids.wide_rows(p.fit_rows, ["persistence", "kalman_ll"]), 2)


@query("nonneg_stack_weights", """
WITH g AS (SELECT sum(a.y_hat*a.y_hat) AS aa, sum(a.y_hat*b.y_hat) AS ab, sum(b.y_hat*b.y_hat) AS bb, sum(a.y_hat*a.y_true) AS ca, sum(b.y_hat*a.y_true) AS cb
  FROM fit_rows a JOIN fit_rows b ON a.station_id=b.station_id AND a.minute=b.minute AND a.model='persistence' AND b.model='kalman_ll'),
w AS (SELECT *, aa*bb-ab*ab>0 AND ca*bb-cb*ab>=0 AND cb*aa-ca*ab>=0 AS two, ca*ca/nullif(aa,0)>=coalesce(cb*cb/nullif(bb,0),0) AS first_ FROM g)
SELECT CASE WHEN two THEN (ca*bb-cb*ab)/(aa*bb-ab*ab) WHEN first_ THEN ca/aa ELSE 0 END AS w_persistence,
  CASE WHEN two THEN (cb*aa-ca*ab)/(aa*bb-ab*ab) WHEN first_ OR bb=0 THEN 0 ELSE cb/bb END AS w_kalman_ll FROM w""", dbl="w_persistence w_kalman_ll")
def nonneg_stack_weights(p):
    """Two models, whose solution SQL can state: both weights, or the better model alone."""
    w = hybrids.nonneg_stack_weights(hybrids.wide_rows(p.fit_rows, ["persistence", "kalman_ll"]), 2)
    return p.spark.createDataFrame([w], "w_persistence double, w_kalman_ll double")


@query("logistic_hurdle")
def logistic_hurdle(p):
    train, val, test = three_way(p)
    return fitted.LogisticHurdle(("P", "T")).fit(train, val).predict(test).select("station_id", "minute", *OUT.split())


@query("boosted_hurdle")
def boosted_hurdle(p):
    train, val, test = three_way(p)
    return fitted.BoostedHurdle(rounds=6).fit(train, val).predict(test).select("station_id", "minute", *OUT.split())


@query("leaf_quantiles", """
SELECT CAST(station_id AS INT) AS station, min(y) FILTER (upto >= 0.9*total*(1-1e-12)) AS q90 FROM (
 SELECT station_id, y, sum(w) OVER (PARTITION BY station_id ORDER BY y) AS upto, sum(w) OVER (PARTITION BY station_id) AS total FROM tab_train) GROUP BY 1""", dbl="q90", long="station")
def leaf_quantiles(p):
    """Weighted 0.9 quantile of the amount per station, by the refined counts that the boosted quantile uses for its leaves."""
    rows = tab_train(p).select(F.col("station_id").cast("int").alias("leaf"), F.col("y").alias("r"), "w")
    n = rows.agg(F.max("leaf")).first()[0] + 1
    there = rows.select("leaf").distinct()
    return there.select(F.col("leaf").alias("station"), boosting._of(boosting.leaf_quantiles(rows, n, 0.9)).alias("q90"))


@query("tweedie_start_and_slopes", """
SELECT station_id, minute, y*pow(m, -0.3)-pow(m, 0.7) AS slope, pow(m, 0.7)/0.7+y*pow(m, -0.3)/0.3 AS loss FROM tab_train, (SELECT sum(w*y)/sum(w) AS m FROM tab_train)""", dbl="slope loss")
def tweedie_start_and_slopes(p):
    """The first round's target: slope and deviance part at the best constant."""
    loss, rows = boosting.Tweedie(1.3), tab_train(p)
    f = F.lit(loss.start(rows))
    return rows.select("station_id", "minute", loss.slope(F.col("y"), f).alias("slope"), loss.loss(F.col("y"), f).alias("loss"))


@query("tweedie_amount")
def tweedie_amount(p):
    train, val, test = three_way(p)
    return fitted.TweedieAmount(rounds=8).fit(train, val).predict(test).select("station_id", "minute", *OUT.split())


LOOP_SQL = " UNION ALL ".join(f"SELECT '{pre}{m}' AS model, 'test' AS split, t.station_id, t.minute, {v} FROM tab t, (SELECT sum(y*w)/sum(w) AS m, sum((y>0)::INT*w)/sum(w) AS s FROM tab_train) o "
                              "LEFT JOIN (SELECT hour, sum(y*w)/sum(w) AS cm, sum((y>0)::INT*w)/sum(w) AS cs FROM tab_train GROUP BY 1) c ON c.hour=t.hour WHERE t.minute>=540"
                              for pre in ("", "A__") for m, v in (
    ("zero", "0.0 AS p_rain, 0.0 AS y_hat, 0.0 AS q90"), ("climatology", "coalesce(cs,o.s) AS p_rain, coalesce(cm,o.m) AS y_hat, NULL AS q90"),
    ("persistence", "(P_lag0>0)::INT AS p_rain, P_lag0 AS y_hat, P_lag0 AS q90"), ("moving_average", "P_wetfrac10 AS p_rain, P_sum10/10 AS y_hat, NULL AS q90")))


class Broken:
    name = "broken"

    def fit(self, train, val):
        raise ValueError("a model that cannot be fitted")


@query("fit_predict_loop", LOOP_SQL, dbl=OUT)
def fit_predict_loop(p):
    test = p.tab.where("minute >= 540")
    models = [baselines.Simple("zero"), Broken(), *[baselines.Simple(n) for n in ("climatology", "persistence", "moving_average")]]
    out, failed = loop.fit_predict_loop(models, tab_train(p), tab_train(p), {"test": test}, {"test": test})
    assert list(failed) == ["broken"]
    return out


def importance(p):
    train, val, test = three_way(p)
    return loop.importance_by_regime(fitted.BoostedHurdle(groups=("P",), quantile=False, rounds=3, depth=3).fit(train, val), test)


@query("importance_by_regime")
def importance_by_regime(p):
    return importance(p)


@query("top_importances")
def top_importances(p):
    return verify.top_importances(importance(p))


@query("tuning_leak_experiment")
def tuning_leak_experiment(p):
    train, val, test = three_way(p)
    res = loop.tuning_leak_experiment(train, val, test, rounds=3, depth=3, groups=("P",))
    return test.agg(F.count(F.lit(1)).alias("rows")).withColumns({k: F.lit(v) for k, v in res.items()})


SEQ = ["rain_rt", "p10_last", "temp", "hour_sin"]


@query("channel_scaler", "SELECT avg(temp) AS temp__mean, stddev_pop(temp) AS temp__std, avg(hour_sin) AS hour_sin__mean, stddev_pop(hour_sin) AS hour_sin__std FROM chan",
       dbl="temp__mean temp__std hour_sin__mean hour_sin__std")
def channel_scaler(p):
    return sequences.channel_scaler(p.own_channels, SEQ)


@query("rain_rate_transform", "SELECT station_id, minute, ln(1+100*rain_rt)/3 AS rain_rt, ln(1+10*p10_last)/3 AS p10_last, coalesce((temp-(SELECT avg(temp) FROM chan))/(SELECT stddev_pop(temp) FROM chan),0) AS temp, "
       "(hour_sin-(SELECT avg(hour_sin) FROM chan))/(SELECT stddev_pop(hour_sin) FROM chan) AS hour_sin FROM chan", dbl=" ".join(SEQ))
def rain_rate_transform(p):
    df = p.own_channels.select("station_id", "minute", *SEQ)
    return sequences.scaled(df, SEQ, sequences.channel_scaler(df, SEQ))


@query("sequence_windows", "SELECT station_id, minute, x FROM (SELECT station_id, minute, count(*) OVER w AS n, list([rain_rt, p10_last]) OVER w AS l, "
       "array_to_string(list(rain_rt::DECIMAL(9,3)) OVER w, ',')||'|'||array_to_string(list(p10_last::DECIMAL(9,3)) OVER w, ',') AS x FROM chan WINDOW w AS (PARTITION BY station_id ORDER BY minute ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n=5")
def sequence_windows(p):
    d = sequences.sequence_windows(p.own_channels, ["rain_rt", "p10_last"], 5, SLICES)
    flat = lambda i: F.concat_ws(",", F.transform("x", lambda v: v[i].cast("double").cast("decimal(9,3)").cast("string")))
    return d.select("station_id", "minute", F.concat_ws("|", flat(0), flat(1)).alias("x"))


def mean_model(x: np.ndarray) -> pd.DataFrame:
    wet = (x[:, :, 0] > 0).mean(1)
    return pd.DataFrame({"p_rain": wet.astype(float), "y_hat": x[:, :, 0].mean(1).astype(float), "q90": x[:, :, 0].max(1).astype(float)})


@query("batch_window_predict", "SELECT * FROM (SELECT station_id, minute, avg((rain_rt>0)::INT) OVER w AS p_rain, avg(rain_rt) OVER w AS y_hat, max(rain_rt) OVER w AS q90, count(*) OVER w AS n "
       "FROM chan WINDOW w AS (PARTITION BY station_id ORDER BY minute ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n=5".replace("SELECT * FROM", "SELECT station_id, minute, p_rain, y_hat, q90 FROM", 1), dbl=OUT)
def batch_window_predict(p):
    return sequences.batch_window_predict(sequences.sequence_windows(p.own_channels, ["rain_rt", "p10_last"], 5, SLICES), mean_model)
