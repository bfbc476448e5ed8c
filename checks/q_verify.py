"""Checks: joins of index and forecasts, scores, rankings, resampling, links and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gaugeflow.functions import link, names
from gaugeflow.operators import audit, links, resample, verify
from gaugeflow.params import LinkParams

from .proxies import EVAL, SLICES
from .registry import query

LINK = LinkParams()


@query("index_prediction_join", "SELECT i.station_id, i.minute, y_true, rain_now, day, split, model, p_rain, y_hat, q90 FROM idx i JOIN preds p ON p.station_id=i.station_id AND p.minute=i.minute",
       dbl="y_true rain_now p_rain y_hat q90")
def index_prediction_join(p):
    return verify.index_prediction_join(p.index, p.preds)


@query("distinct_keys", "SELECT DISTINCT model, station_id, minute FROM preds")
def distinct_keys(p):
    return verify.distinct_keys(p.preds.unionByName(p.preds))


@query("model_coverage", "SELECT model, count(*) AS rows, count(*)/(SELECT count(*) FROM idx)::DOUBLE AS coverage FROM preds p JOIN idx i "
       "ON i.station_id=p.station_id AND i.minute=p.minute GROUP BY 1", dbl="coverage")
def model_coverage(p):
    return verify.model_coverage(p.index, p.preds)


@query("common_row_intersection", "SELECT station_id, minute, y_true, rain_now, day FROM common", dbl="y_true rain_now")
def common_row_intersection(p):
    return verify.common_row_intersection(p.index.where("split = 'test'"), p.preds, EVAL.min_coverage).drop("split")


@query("model_wide_pivot", "SELECT station_id, minute, max(p_rain) FILTER (model='persistence') AS persistence__p_rain, max(y_hat) FILTER (model='persistence') AS persistence__y_hat, "
       "max(p_rain) FILTER (model='gru') AS gru__p_rain, max(y_hat) FILTER (model='gru') AS gru__y_hat FROM preds GROUP BY 1,2",
       dbl="persistence__p_rain persistence__y_hat gru__p_rain gru__y_hat")
def model_wide_pivot(p):
    return verify.model_wide_pivot(p.preds, ["persistence", "gru"])


@query("contingency", "SELECT model, h AS hits, m AS misses, f AS false_alarms, c AS correct_neg FROM cells", dbl="hits misses false_alarms correct_neg")
def contingency(p):
    return verify.contingency(p.scored, ["model"], F.col("y_true") > 0, F.col("p_rain") >= F.col("thr_rain"))


@query("categorical_scores", "SELECT * FROM cats", dbl="pod far csi fbias ets hss")
def categorical_scores(p):
    return verify.categorical_scores(contingency(p)).drop("hits", "misses", "false_alarms", "correct_neg")


@query("continuous_scores", "SELECT * EXCLUDE (rows) FROM errs", dbl="rmse mae bias corr rmse_wet mae_wet")
def continuous_scores(p):
    return verify.continuous_scores(p.scored, ["model"])


@query("tune_threshold", "SELECT * FROM thr", dbl="thr_rain thr_ge12 thr_ge40")
def tune_threshold(p):
    return p.thresholds


@query("brier", "SELECT model, avg((least(greatest(p_rain,0),1)-CASE WHEN y_true>0 THEN 1 ELSE 0 END)**2) AS brier FROM scored GROUP BY 1", dbl="brier")
def brier(p):
    return verify.brier(p.scored, ["model"])


@query("average_precision", """
SELECT model, CASE WHEN max(tot)>0 AND max(tot)<max(n) THEN sum(pos*tp/ge)/max(tot) END AS pr_auc FROM (
 SELECT model, pos, sum(pos) OVER d AS tp, sum(k) OVER d AS ge, sum(pos) OVER g AS tot, sum(k) OVER g AS n FROM (
  SELECT model, p_rain, count(*) FILTER (y_true>0) AS pos, count(*) AS k FROM scored GROUP BY 1,2)
 WINDOW d AS (PARTITION BY model ORDER BY p_rain DESC), g AS (PARTITION BY model)) GROUP BY 1""", dbl="pr_auc")
def average_precision(p):
    return verify.average_precision(p.scored, ["model"])


@query("pinball", "SELECT model, CASE WHEN count(q90)=count(*) THEN avg(greatest(0.9*(y_true-q90),-0.1*(y_true-q90))) END AS pinball_q90 FROM scored GROUP BY 1", dbl="pinball_q90")
def pinball(p):
    return verify.pinball(p.scored, ["model"])


@query("reliability_table", "SELECT model, (" + "+".join(f"(q>={i}/10.0::DOUBLE)::INT" for i in range(1, 10)) + ") AS bin, avg(q) AS p_mean, avg((y_true>0)::INT) AS obs_freq, count(*) AS n "
       "FROM (SELECT *, least(greatest(p_rain,0),1) AS q FROM scored) GROUP BY 1,2", dbl="p_mean obs_freq", long="bin")
def reliability_table(p):
    return verify.reliability_table(p.scored, ["model"])


def _c(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


def _cats(o: str, f: str, pre: str, suf: str, keys=("csi", "pod", "far")) -> str:
    h, m, x = _c(f"({o}) AND ({f})"), _c(f"({o}) AND NOT ({f})"), _c(f"NOT ({o}) AND ({f})")
    s = {"csi": f"{h}/nullif({h}+{m}+{x},0)::DOUBLE", "pod": f"{h}/nullif({h}+{m},0)::DOUBLE", "far": f"{x}/nullif({h}+{x},0)::DOUBLE"}
    return ", ".join(f"{s[k]} AS {pre}{k}{suf}" for k in keys)


COND = ["onset_pod", "onset_far", "onset_csi", "cessation_pod", "cessation_csi", "rmse_wet_now"] + [
    f"{k}_ge{t}" for t in (12, 40) for k in ("csi", "pod", "far")]


@query("conditional_scores", f"""
SELECT o.*, c.* EXCLUDE (model), w.* EXCLUDE (model) FROM
 (SELECT model, {_cats('y_true>0', 'p_rain>=thr_rain', 'onset_', '')} FROM scored WHERE rain_now=0 GROUP BY 1) o
JOIN (SELECT model, {_cats('y_true<=0', 'p_rain<thr_rain', 'cessation_', '', ('csi', 'pod'))}, sqrt(avg((y_hat-y_true)**2)) AS rmse_wet_now FROM scored WHERE rain_now>0 GROUP BY 1) c ON c.model=o.model
JOIN (SELECT model, {_cats('y_true*60>=12', 'y_hat>=thr_ge12', '', '_ge12')}, {_cats('y_true*60>=40', 'y_hat>=thr_ge40', '', '_ge40')} FROM scored GROUP BY 1) w ON w.model=o.model""",
       dbl=" ".join(COND))
def conditional_scores(p):
    return verify.conditional_scores(p.scored, EVAL)


ST_SQL = f"""
SELECT model, station_id, NULL::BIGINT AS month, true AS by_station, {_cats('y_true>0', 'p_rain>=thr_rain', '', '')}, sqrt(avg((y_hat-y_true)**2)) AS rmse FROM scored GROUP BY 1,2
UNION ALL SELECT model, NULL, minute//60, false, {_cats('y_true>0', 'p_rain>=thr_rain', '', '')}, sqrt(avg((y_hat-y_true)**2)) FROM scored GROUP BY 1,3"""


def by_station(p):
    return verify.scores_by_station_and_month(p.scored, F.floor(F.col("minute") / 60))


@query("scores_by_station_and_month", ST_SQL, dbl="csi pod far rmse")
def scores_by_station_and_month(p):
    return by_station(p)


@query("station_score_summary", "SELECT model, " + ", ".join(
    f"quantile_cont({c},0.5) AS {c}_median, quantile_cont({c},0.75)-quantile_cont({c},0.25) AS {c}_iqr" for c in ("rmse", "csi", "pod", "far"))
    + f" FROM ({ST_SQL}) WHERE by_station GROUP BY 1", dbl=" ".join(f"{c}_median {c}_iqr" for c in ("rmse", "csi", "pod", "far")))
def station_score_summary(p):
    return verify.station_score_summary(by_station(p))


@query("skill_vs_reference", "SELECT model, rmse, skill_rmse FROM board", dbl="rmse skill_rmse")
def skill_vs_reference(p):
    return verify.skill_vs_reference(verify.continuous_scores(p.scored, ["model"])).select("model", "rmse", "skill_rmse")


def board(p):
    return verify.model_scores(p.scored, EVAL)


@query("leaderboard", """
SELECT model, csi_rain, skill_rmse, deployable, model=(SELECT arg_max(model,(csi_rain,skill_rmse,model)) FROM board) AS best_overall,
  model=(SELECT arg_max(model,(csi_rain,skill_rmse,model)) FROM board WHERE NOT (model LIKE 'A\\_\\_%' ESCAPE '\\' OR model LIKE 'hyb%' OR model LIKE 'kalman%' OR model LIKE 'hmm%')) AS best_deployable
FROM (SELECT *, NOT (model LIKE 'A\\_\\_%' ESCAPE '\\' OR model LIKE 'hyb%' OR model LIKE 'kalman%' OR model LIKE 'hmm%') AS deployable FROM board)""",
       dbl="csi_rain skill_rmse")
def leaderboard(p):
    return verify.leaderboard(board(p))


FAMILY_SQL = """CASE WHEN n LIKE 'samba%' THEN 'SAMBA (deep SSM)' WHEN n LIKE 'mamba%' OR n LIKE 's4d%' THEN 'deep SSM'
 WHEN n LIKE 'kalman%' OR n LIKE 'hmm%' THEN 'classical SSM' WHEN n LIKE 'gru%' OR n LIKE 'tcn%' OR n LIKE 'patchtst%' THEN 'deep (non-SSM)'
 WHEN n LIKE 'lgbm%' OR n LIKE 'gbm%' THEN 'gradient boosting' WHEN n LIKE 'hyb%' THEN 'hybrid' WHEN n LIKE 'logistic%' THEN 'linear' ELSE 'baseline' END"""


@query("model_family", f"SELECT model, count(*) AS n, {FAMILY_SQL.replace('n LIKE', 'm LIKE')} AS family FROM (SELECT model, regexp_replace(model,'^A__','') AS m FROM preds) GROUP BY model, m")
def model_family(p):
    return p.preds.groupBy("model", names.model_family(F.col("model")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("best_per_family", f"""
SELECT model, min(slot) AS slot FROM (SELECT 'persistence' AS model, 0 AS slot UNION ALL SELECT arg_max(model,(csi_rain,model)), 1 FROM board
 UNION ALL SELECT arg_max(model,(csi_rain,model)), slot FROM (SELECT *, list_position(['SAMBA (deep SSM)','classical SSM','gradient boosting','deep SSM','deep (non-SSM)'], {FAMILY_SQL})+1 AS slot
  FROM (SELECT *, regexp_replace(model,'^A__','') AS n FROM board)) WHERE slot>1 GROUP BY slot) GROUP BY 1""", long="slot")
def best_per_family(p):
    return verify.best_per_family(board(p))


@query("peak_station_day", """
SELECT minute, station_id, day, y_true, rain_now, split FROM idx WHERE (station_id, day) = (SELECT (station_id, day) FROM idx GROUP BY station_id, day ORDER BY round(sum(y_true),9) DESC, station_id, day LIMIT 1)""",
       dbl="y_true rain_now")
def peak_station_day(p):
    return verify.peak_station_day(p.index)


@query("day_sufficient_stats", "SELECT * FROM daily", dbl="sse")
def day_sufficient_stats(p):
    return resample.day_sufficient_stats(p.scored)


def replicates(p):
    stats = resample.day_sufficient_stats(p.scored)
    return stats, resample.draw_scores(stats, resample.day_draws(stats, EVAL.bootstrap, EVAL.seed))


def _q(e: str, n: str) -> str:
    return f"quantile_cont({e},0.025) AS {n}_lo, quantile_cont({e},0.975) AS {n}_hi"


@query("block_bootstrap_ci", f"SELECT a.model, {_q('a.rmse', 'rmse')}, {_q('a.csi', 'csi')}, {_q('1-a.rmse/r.rmse', 'skill')}, {_q('a.csi-r.csi', 'dcsi_vs_ref')} "
       "FROM replicates a JOIN replicates r ON r.draw=a.draw AND r.model='persistence' GROUP BY 1",
       dbl="rmse_lo rmse_hi csi_lo csi_hi skill_lo skill_hi dcsi_vs_ref_lo dcsi_vs_ref_hi")
def block_bootstrap_ci(p):
    return resample.block_bootstrap_ci(replicates(p)[1])


@query("paired_bootstrap", f"SELECT a.model AS model_a, b.model AS model_b, avg(coalesce(a.csi,0)-coalesce(b.csi,0)) AS d_csi_mean, {_q('coalesce(a.csi,0)-coalesce(b.csi,0)', 'd_csi')}, "
       f"avg(a.rmse-b.rmse) AS d_rmse_mean, {_q('a.rmse-b.rmse', 'd_rmse')} FROM replicates a JOIN replicates b ON b.draw=a.draw AND b.model<>a.model WHERE a.model LIKE 'kalman%' GROUP BY 1,2",
       dbl="d_csi_mean d_csi_lo d_csi_hi d_rmse_mean d_rmse_lo d_rmse_hi")
def paired_bootstrap(p):
    stats, rep = replicates(p)
    return resample.paired_bootstrap(rep, resample.model_pairs(stats, stats.where("model like 'kalman%'")))


@query("report_tables", f"""
SELECT 'leaderboard' AS part, model, NULL AS other, csi_rain AS value FROM board UNION ALL SELECT 'metrics', model, NULL, rmse FROM board
UNION ALL SELECT 'pairwise', a.model, b.model, avg(coalesce(a.csi,0)-coalesce(b.csi,0)) FROM replicates a JOIN replicates b ON b.draw=a.draw AND b.model<>a.model WHERE a.model LIKE 'kalman%' GROUP BY a.model, b.model
UNION ALL SELECT 'thresholds', model, NULL, thr_rain FROM thr
UNION ALL SELECT 'excluded', model, NULL, count(*)/(SELECT count(*) FROM idx)::DOUBLE AS c FROM preds p JOIN idx i ON i.station_id=p.station_id AND i.minute=p.minute GROUP BY model HAVING c<{EVAL.min_coverage}""",
       dbl="value")
def report_tables(p):
    """One figure of every table of the report, in one long table."""
    tables = verify.report_tables(board(p), paired_bootstrap(p), p.thresholds, verify.model_coverage(p.index, p.preds), EVAL.min_coverage)
    figure = {"leaderboard": "csi_rain", "metrics": "rmse", "pairwise": "d_csi_mean", "thresholds": "thr_rain", "excluded": "coverage"}
    rows = [t.select(F.lit(k).alias("part"), F.col("model_a" if k == "pairwise" else "model").alias("model"),
                     (F.col("model_b") if k == "pairwise" else F.lit(None).cast("string")).alias("other"), F.col(figure[k]).alias("value")) for k, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("diebold_mariano", "SELECT model_a, model_b, CASE WHEN n>=10 AND v>0 THEN m/sqrt(v/n) END AS dm_stat FROM (SELECT model_a, model_b, count(*) AS n, any_value(m) AS m, sum(c*c)/count(*)"
       + "".join(f"+2*(1-{k}/8.0)*coalesce(sum(c*l{k}),0)/count(*)" for k in range(1, 8)) + " AS v FROM (SELECT *, " + ", ".join(f"lag(c,{k}) OVER w AS l{k}" for k in range(1, 8))
       + " FROM (SELECT a.model AS model_a, b.model AS model_b, a.day, a.sse/a.n-b.sse/b.n-avg(a.sse/a.n-b.sse/b.n) OVER g AS c, avg(a.sse/a.n-b.sse/b.n) OVER g AS m "
       "FROM daily a JOIN daily b ON b.day=a.day AND b.model<>a.model WINDOW g AS (PARTITION BY a.model, b.model)) WINDOW w AS (PARTITION BY model_a, model_b ORDER BY day)) GROUP BY 1,2)",
       dbl="dm_stat")
def diebold_mariano(p):
    stats = resample.day_sufficient_stats(p.scored)
    return resample.diebold_mariano(stats, resample.model_pairs(stats, stats)).drop("p_value")


# ----------------------------------------------------------------------------- links
def _curve(f: float, table) -> str:
    terms, m, c = table
    return "(" + "+".join(f"({a}*exp(-pow((log10({f})-({b}))/({w}),2)))" for a, b, w in terms) + f"+({m})*log10({f})+({c}))"


def _law(s: dict) -> tuple[str, str]:
    kh, kv, ah, av = (_curve(s["f_ghz"], t) for t in (link.K_H, link.K_V, link.ALPHA_H, link.ALPHA_V))
    kh, kv = f"pow(10,{kh})", f"pow(10,{kv})"
    tilt = {"H": 0, "V": 90, "circular": 45}[s["pol"]]
    x = f"(pow(cos(radians({s.get('elevation_deg', 0)})),2)*cos(2*radians({tilt})))"
    k = f"(({kh}+{kv}+({kh}-{kv})*{x})/2)"
    return k, f"(({kh}*{ah}+{kv}*{av}+({kh}*{ah}-{kv}*{av})*{x})/(2*{k}))"


def _scenarios_sql() -> str:
    rows = []
    for s in LINK.scenarios:
        k, a = _law(s)
        rows.append(f"SELECT '{s['name']}' AS scenario, {s['f_ghz']}::DOUBLE AS f, '{s['pol']}' AS pol, {k}::DOUBLE AS k, {a}::DOUBLE AS alpha, "
                    f"{s.get('d_km', 'NULL')}::DOUBLE AS d, {s.get('elevation_deg', 'NULL')}::DOUBLE AS el, {s.get('station_height_km', 'NULL')}::DOUBLE AS hs")
    return " UNION ALL ".join(rows)


def _att(rain: str, lat: str) -> str:
    """Attenuation of scenario columns f, k, alpha, d, el, hs at ``rain`` mm/h."""
    g = f"(k*pow({rain},alpha))"
    den = f"(0.477*pow(d,0.633)*pow(CASE WHEN {rain}>0 THEN {rain} ELSE 1 END,0.073*alpha)*pow(f,0.123)-10.579*(1-exp(-0.024*d)))"
    terr = f"{g}*d*CASE WHEN {den}>0 THEN least(1/{den},2.5) ELSE 2.5 END"
    lg = "((2.6-hs)/sin(radians(el))*cos(radians(el)))"
    rh = f"(1/(1+0.78*sqrt({lg}*{g}/f)-0.38*(1-exp(-2*{lg}))))"
    lr = f"(CASE WHEN degrees(atan2(2.6-hs,{lg}*{rh}))>el THEN {lg}*{rh}/cos(radians(el)) ELSE (2.6-hs)/sin(radians(el)) END)"
    v = f"(1/(1+sqrt(sin(radians(el)))*(31*(1-exp(-(el/(1+CASE WHEN abs({lat})<36 THEN 36-abs({lat}) ELSE 0 END))))*sqrt({lr}*{g})/pow(f,2)-0.45)))"
    return f"CASE WHEN d IS NOT NULL THEN {terr} WHEN {rain}>0 THEN {g}*{lr}*{v} ELSE 0 END"


def rainy(p):
    return p.targets.where("target is not null").select("station_id", "minute", "target")


@query("specific_attenuation", f"SELECT station_id, minute, scenario, k*pow(60*target,alpha) AS db_per_km FROM targets, ({_scenarios_sql()}) WHERE target IS NOT NULL", dbl="db_per_km")
def specific_attenuation(p):
    s = F.col("s")
    return (rainy(p).withColumn("s", F.explode(link.scenario_array(LINK.scenarios)))
            .select("station_id", "minute", s["scenario"].alias("scenario"), link.specific_attenuation(60 * F.col("target"), s["k"], s["alpha"]).alias("db_per_km")))


@query("terrestrial_path_attenuation", f"SELECT station_id, minute, scenario, {_att('(60*target)', '56.0')} AS db FROM targets, ({_scenarios_sql()}) WHERE target IS NOT NULL AND d IS NOT NULL", dbl="db")
def terrestrial_path_attenuation(p):
    s = F.col("s")
    return (rainy(p).withColumn("s", F.explode(link.scenario_array([x for x in LINK.scenarios if "d_km" in x])))
            .select("station_id", "minute", s["scenario"].alias("scenario"),
                    link.terrestrial_path_attenuation(60 * F.col("target"), s["k"], s["alpha"], s["f_ghz"], s["d_km"]).alias("db")))


@query("slant_path_attenuation", f"SELECT t.station_id, minute, scenario, {_att('(60*target)', '(lat-25)')} AS db FROM targets t JOIN stations s ON s.station_id=t.station_id, ({_scenarios_sql()}) WHERE target IS NOT NULL AND d IS NULL", dbl="db")
def slant_path_attenuation(p):
    s = F.col("s")
    return (rainy(p).join(p.stations, "station_id").withColumn("s", F.explode(link.scenario_array([x for x in LINK.scenarios if "d_km" not in x])))
            .select("station_id", "minute", s["scenario"].alias("scenario"),
                    link.slant_path_attenuation(60 * F.col("target"), s["k"], s["alpha"], s["f_ghz"], s["elevation_deg"], F.col("lat") - 25,
                                                F.lit(2.6), s["station_height_km"]).alias("db")))


@query("scenario_attenuation", f"SELECT t.station_id, minute, scenario, {_att('(60*target)', 'lat')} AS db FROM targets t JOIN stations s ON s.station_id=t.station_id, ({_scenarios_sql()}) WHERE target IS NOT NULL", dbl="db")
def scenario_attenuation(p):
    return links.with_attenuation(rainy(p), p.stations.select("station_id", F.col("lat").alias("lat_deg")), ["station_id"], {"db": "target"}).select("station_id", "minute", "scenario", "db")


@query("station_latitude_lookup", "SELECT model, quantile_cont(coalesce(lat,56.0::DOUBLE),0.5) AS lat_deg FROM scored c LEFT JOIN stations s ON s.station_id=c.station_id GROUP BY 1", dbl="lat_deg")
def station_latitude_lookup(p):
    return links.station_latitude_lookup(p.scored, p.stations, ["model"])


@query("scenario_reference_table", f"SELECT station_id, scenario, f AS f_ghz, pol, k, alpha, {_att('10.0::DOUBLE', 'lat')} AS a_db_at_10mmh, {_att('50.0::DOUBLE', 'lat')} AS a_db_at_50mmh FROM stations, ({_scenarios_sql()})",
       dbl="f_ghz k alpha a_db_at_10mmh a_db_at_50mmh")
def scenario_reference_table(p):
    return links.scenario_reference_table(p.stations)


ATT_COLS = ["rmse_db", "mae_db", "bias_db", "rmse_db_when_fading", "corr"] + [f"{k}_{m}dB{s}" for m in (3, 5, 10) for k, s in (
    ("pod", ""), ("far", ""), ("csi", ""), ("pod", "_q90"), ("csi", "_q90"))]


def _margin(m: int) -> str:
    q = f"coalesce(a_q>={m},false)"
    pq = _cats(f"a_obs>={m}", q, "", f"_{m}dB_q90", ("pod", "csi")).split(", ")
    return (_cats(f"a_obs>={m}", f"a_hat>={m}", "", f"_{m}dB") + f", count(*) FILTER (a_obs>={m}) AS events_{m}dB, "
            + ", ".join(f"CASE WHEN count(a_q)=count(*) THEN {x.rsplit(' AS ', 1)[0]} END AS {x.rsplit(' AS ', 1)[1]}" for x in pq))


@query("attenuation_scores", f"""
SELECT model, scenario, sqrt(avg((a_hat-a_obs)**2)) AS rmse_db, avg(abs(a_hat-a_obs)) AS mae_db, avg(a_hat-a_obs) AS bias_db,
 sqrt(avg((a_hat-a_obs)**2) FILTER (a_obs>0.1)) AS rmse_db_when_fading, CASE WHEN stddev_pop(a_obs)>0 AND stddev_pop(a_hat)>0 THEN corr(a_obs,a_hat) END AS corr,
 {_margin(3)}, {_margin(5)}, {_margin(10)}
FROM (SELECT c.model, scenario, {_att('(60*y_true)', 'l.lat')} AS a_obs, {_att('(60*greatest(y_hat,0))', 'l.lat')} AS a_hat, CASE WHEN q90 IS NOT NULL THEN {_att('(60*greatest(q90,0))', 'l.lat')} END AS a_q
 FROM scored c JOIN (SELECT model, quantile_cont(lat,0.5) AS lat FROM scored x JOIN stations s ON s.station_id=x.station_id GROUP BY 1) l ON l.model=c.model, ({_scenarios_sql()}))
GROUP BY 1,2""", dbl=" ".join(ATT_COLS))
def attenuation_scores(p):
    return links.attenuation_scores(p.scored, p.stations)


# ----------------------------------------------------------------------------- audit
NAIVE_SQL = """
SELECT o.station_id, o.minute, o.p1_obs, o.precip, o.valid, coalesce(o.p1_obs,0) AS zero_filled, coalesce(x.share,0) AS spread FROM truth o LEFT JOIN (
 SELECT t.station_id, g.minute, arg_max(t.p10_obs/t.n, t.minute) AS share FROM (SELECT a.station_id, a.minute, a.p10_obs, (SELECT count(*) FROM grid g WHERE g.station_id=a.station_id AND g.minute BETWEEN a.minute-9 AND a.minute) AS n
  FROM truth a WHERE a.p10_obs IS NOT NULL) t JOIN grid g ON g.station_id=t.station_id AND g.minute BETWEEN t.minute-9 AND t.minute GROUP BY 1,2) x
ON x.station_id=o.station_id AND x.minute=o.minute"""


@query("naive_truth_variants", f"SELECT station_id, minute, zero_filled, spread FROM ({NAIVE_SQL})", dbl="zero_filled spread")
def naive_truth_variants(p):
    return audit.naive_truth_variants(p.truth, SLICES).select("station_id", "minute", "zero_filled", "spread")


def _pairs_sql(x: str, ok: str, pre: str) -> str:
    return (_cats(f"{ok} AND n_{x}>0", f"{ok} AND {x}>0", pre, "") .replace("NOT (", "NOT (")
            + f", sqrt(avg((n_{x}-{x})**2) FILTER ({ok})) AS {pre}rmse")


@query("persistence_pair_scores", "SELECT station_id, " + _pairs_sql("precip", "ok", "") + " FROM (SELECT *, lead(precip) OVER w AS n_precip, coalesce(valid=1 AND lead(valid) OVER w=1,false) AS ok "
       "FROM truth WINDOW w AS (PARTITION BY station_id ORDER BY minute)) WHERE ok GROUP BY 1", dbl="csi pod far rmse")
def persistence_pair_scores(p):
    return audit.persistence_pair_scores(p.truth, SLICES)


AUDIT_SQL = f"""
SELECT station_id, count(*) AS minutes, avg(valid) AS valid_frac, count(*) FILTER (valid=1 AND precip>0) AS our_wet_minutes,
 count(*) FILTER (valid=1 AND precip>0 AND zero_filled=0) AS wet_labelled_dry, count(*) FILTER (p1_obs IS NULL) AS filled_with_zero,
 coalesce(sum(precip) FILTER (valid=1),0) AS mm_ours, sum(zero_filled) AS mm_naive,
 {_pairs_sql('precip', 'ours', 'ours_')}, {_pairs_sql('zero_filled', 'both_', 'naive_')}, {_pairs_sql('spread', 'both_', 'spread_')}
FROM (SELECT *, lead(precip) OVER w AS n_precip, lead(zero_filled) OVER w AS n_zero_filled, lead(spread) OVER w AS n_spread,
  coalesce(valid=1 AND lead(valid) OVER w=1,false) AS ours, lead(zero_filled) OVER w IS NOT NULL AS both_ FROM ({NAIVE_SQL}) WINDOW w AS (PARTITION BY station_id ORDER BY minute)) GROUP BY 1"""
AUDIT_DBL = "valid_frac mm_ours mm_naive " + " ".join(f"{t}_{k}" for t in ("ours", "naive", "spread") for k in ("csi", "pod", "far", "rmse"))


@query("leakage_audit", AUDIT_SQL, dbl=AUDIT_DBL)
def leakage_audit(p):
    return audit.leakage_audit(p.truth, SLICES)


@query("leakage_summary", f"SELECT count(*) AS stations, sum(wet_labelled_dry)/greatest(sum(our_wet_minutes),1) AS share_wet_labelled_dry, quantile_cont(ours_csi,0.5) AS csi_ours, "
       f"quantile_cont(naive_csi,0.5) AS csi_naive, quantile_cont(spread_csi,0.5) AS csi_spread FROM ({AUDIT_SQL})", dbl="share_wet_labelled_dry csi_ours csi_naive csi_spread")
def leakage_summary(p):
    return audit.leakage_summary(audit.leakage_audit(p.truth, SLICES))


