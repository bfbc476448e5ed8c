"""The same views as common table expressions for the SQL side, in dependency order."""

CTES: dict[str, str] = {}

CTES["stations"] = """
SELECT lpad(CAST(k AS VARCHAR),5,'0') AS station_id,
  9.0::DOUBLE+((k*37)%11)*0.09::DOUBLE+((k//77)%40)*1.1::DOUBLE AS lon,
  55.6::DOUBLE+((k*53)%7)*0.07::DOUBLE-((k//3080)%50)*1.0::DOUBLE AS lat
FROM (SELECT DISTINCT user_id//25 AS k FROM events)"""

CTES["raw"] = """
SELECT lpad(CAST(user_id//25 AS VARCHAR),5,'0') AS station_id,
  date_diff('hour', TIMESTAMP '2024-01-01', ts) AS minute, event_id AS seq,
  CASE WHEN event_id%97=0 THEN -999999::DOUBLE WHEN value>60 THEN floor((value-60)/20)*0.1::DOUBLE ELSE 0::DOUBLE END AS precip_past1min,
  CASE WHEN event_type='error' THEN value%60-15 END AS temp_dry,
  CASE WHEN event_type='signup' THEN value%101 END AS humidity,
  CASE WHEN event_type='click' THEN value%20 END AS wind_speed,
  CASE WHEN event_type='purchase' THEN CAST((event_id*37)%360 AS DOUBLE) END AS wind_dir,
  CASE WHEN event_id%53=0 THEN 112::DOUBLE WHEN event_id%7=0 THEN value%120 END AS cloud_cover
FROM events"""

CTES["clean"] = """
SELECT station_id, minute, seq,
  CASE WHEN precip_past1min BETWEEN 0 AND 5 THEN precip_past1min END AS precip_past1min,
  CASE WHEN temp_dry BETWEEN -45 AND 45 THEN temp_dry END AS temp_dry,
  CASE WHEN humidity BETWEEN 0 AND 100 THEN humidity END AS humidity,
  CASE WHEN wind_speed BETWEEN 0 AND 60 THEN wind_speed END AS wind_speed,
  CASE WHEN wind_dir BETWEEN 0 AND 360 THEN wind_dir END AS wind_dir,
  CASE WHEN cloud_cover=112 THEN 100 WHEN cloud_cover BETWEEN 0 AND 100 THEN cloud_cover END AS cloud_cover
FROM raw"""

CTES["ded"] = "SELECT station_id, minute, " + ", ".join(
    f"arg_min({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    for c in ("precip_past1min", "temp_dry", "humidity", "wind_speed", "wind_dir", "cloud_cover")
) + " FROM clean GROUP BY station_id, minute"

CTES["grid"] = """
SELECT station_id, unnest(range(a, b+1)) AS minute FROM (
  SELECT station_id, (min(minute)//10)*10 AS a, ((max(minute)+9)//10)*10 AS b FROM ded GROUP BY station_id)"""

CTES["obs"] = """
SELECT station_id, minute, p1_obs,
  CASE WHEN minute%10=0 AND n%11<>0 THEN round(coalesce(s,0) + CASE WHEN n%7=0 THEN 1.0 ELSE 0 END, 1) END AS p10_obs,
  temp_dry, humidity, wind_speed, wind_dir, cloud_cover
FROM (SELECT g.station_id, g.minute, d.precip_past1min AS p1_obs, temp_dry, humidity, wind_speed, wind_dir, cloud_cover,
    (g.minute+9)//10 + CAST(g.station_id AS BIGINT) AS n,
    sum(d.precip_past1min) OVER (PARTITION BY g.station_id, (g.minute+9)//10) AS s
  FROM grid g LEFT JOIN ded d ON d.station_id=g.station_id AND d.minute=g.minute)"""

CTES["win"] = """
SELECT station_id, (minute+9)//10 AS win, count(p1_obs) AS n1, coalesce(sum(p1_obs),0) AS s1,
  max(p10_obs) FILTER (WHERE minute%10=0) AS p10 FROM obs GROUP BY 1,2"""

CTES["dense"] = """
SELECT station_id, minute, avg(CASE WHEN p1_obs IS NULL THEN 0.0 ELSE 1.0 END)
  OVER (PARTITION BY station_id ORDER BY minute ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING) AS dense FROM obs"""

CTES["verdict"] = """
SELECT w.station_id, w.win, CASE WHEN p10 IS NULL THEN n1>=10 AND d.dense>=0.9 WHEN p10=0 THEN s1<=0.11
    ELSE n1>=1 AND abs(s1-p10)<=greatest(0.21,0.2*p10) END AS good
FROM win w JOIN dense d ON d.station_id=w.station_id AND d.minute=w.win*10"""

CTES["truth"] = """
SELECT o.station_id, o.minute, o.p1_obs, o.p10_obs, CASE WHEN v.good THEN coalesce(o.p1_obs,0) END AS precip,
  CASE WHEN v.good THEN 1 ELSE 0 END AS valid, temp_dry, humidity, wind_speed, wind_dir, cloud_cover
FROM obs o JOIN verdict v ON v.station_id=o.station_id AND v.win=(o.minute+9)//10"""

CTES["targets"] = """
SELECT *, lead(precip) OVER w AS target, coalesce(lead(valid) OVER w, 0) AS target_valid
FROM truth WINDOW w AS (PARTITION BY station_id ORDER BY minute)"""

_FFILL = "last_value({c} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY minute ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)"
_SEEN = "minute - max(CASE WHEN {c} THEN minute END) OVER (PARTITION BY station_id ORDER BY minute)"

CTES["filled"] = f"""
SELECT station_id, minute, coalesce(p1_obs,0) AS rain_rt, CASE WHEN p1_obs IS NULL THEN 0.0 ELSE 1.0 END AS rain_avail,
  coalesce({_FFILL.format(c='p10_obs')},0) AS p10_last,
  coalesce(least(60, {_SEEN.format(c='p10_obs IS NOT NULL')}),60) AS p10_age,
  {_FFILL.format(c='temp_dry')} AS temp, {_FFILL.format(c='humidity')} AS rh, {_FFILL.format(c='wind_speed')} AS ws,
  {_FFILL.format(c='wind_dir')} AS wd, {_FFILL.format(c='cloud_cover')}/100 AS cloud,
  coalesce(least(120, {_SEEN.format(c='temp_dry IS NOT NULL OR humidity IS NOT NULL OR wind_speed IS NOT NULL')}),120) AS met_age,
  sum(coalesce(p1_obs,0)) OVER (PARTITION BY station_id ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS sum10
FROM obs"""

CTES["chan"] = """
SELECT f.station_id, minute, rain_rt, rain_avail, p10_last, p10_age,
  greatest(sum10, CASE WHEN p10_age<=9 THEN p10_last ELSE 0 END) AS rain_signal, temp, rh, ws AS wind_speed,
  -ws*sin(radians(wd)) AS wind_u, -ws*cos(radians(wd)) AS wind_v, cloud,
  temp - 243.12*g/(17.62-g) AS dewpoint_dep, met_age,
  sin(2*pi()*(minute%24)/24) AS hour_sin, cos(2*pi()*(minute%24)/24) AS hour_cos,
  sin(2*pi()*(1+minute//24)/365.25) AS doy_sin, cos(2*pi()*(1+minute//24)/365.25) AS doy_cos, s.lat, s.lon
FROM (SELECT *, ln(greatest(least(rh,100),1)/100)+17.62*temp/(243.12+temp) AS g0,
    CASE WHEN rh IS NULL THEN NULL ELSE ln(greatest(least(rh,100),1)/100)+17.62*temp/(243.12+temp) END AS g FROM filled) f
LEFT JOIN stations s ON s.station_id=f.station_id"""

CTES["pairs"] = """
SELECT * FROM (SELECT a.station_id, b.station_id AS neighbour_id,
  2*6371.0*asin(least(1,sqrt(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) AS dist_km,
  fmod(degrees(atan2(sin(radians(b.lon-a.lon))*cos(radians(b.lat)),
    cos(radians(a.lat))*sin(radians(b.lat))-sin(radians(a.lat))*cos(radians(b.lat))*cos(radians(b.lon-a.lon))))+360,360) AS bearing_deg
 FROM stations a JOIN stations b ON a.station_id<>b.station_id) WHERE dist_km<=60"""

CTES["heard"] = """
SELECT p.station_id, c.minute, p.neighbour_id, dist_km, bearing_deg, CAST(floor((bearing_deg+45)/90) AS INT)%4 AS q,
  c.rain_signal AS s, c.wind_u AS u, c.wind_v AS v FROM pairs p JOIN chan c ON c.station_id=p.neighbour_id"""

CTES["wind"] = """
SELECT station_id, minute, u, v, coalesce(u*u+v*v>0.01,false) AS blows, fmod(degrees(atan2(u,v))+180,360) AS wind_from FROM (
 SELECT station_id, minute, avg(u) AS u, avg(v) AS v FROM (SELECT station_id, minute, u, v FROM heard UNION ALL
  SELECT station_id, minute, wind_u, wind_v FROM chan WHERE station_id IN (SELECT station_id FROM pairs)) GROUP BY 1,2)"""

CTES["nb0"] = "SELECT c.station_id, c.minute, " + ", ".join(
    f"coalesce(avg(s) FILTER (WHERE q={q} AND dist_km{'<25' if r == 0 else '>=25'}),0) AS nb_r{r}_{n}"
    for r in (0, 1) for q, n in enumerate("NESW")) + """,
  coalesce(max(s),0) AS nb_max, coalesce(avg(s),0) AS nb_mean, coalesce(avg(CASE WHEN s>0 THEN 1.0 WHEN s IS NOT NULL THEN 0 END),0) AS nb_wet_frac,
  coalesce(arg_min(s, dist_km),0) AS nb_nearest,
  coalesce(sum(k*s) FILTER (WHERE dist_km<=25)/nullif(sum(k) FILTER (WHERE dist_km<=25),0), avg(s) FILTER (WHERE dist_km<=25), 0) AS nb_upwind_r0,
  coalesce(sum(k*s) FILTER (WHERE dist_km>=25)/nullif(sum(k) FILTER (WHERE dist_km>=25),0), avg(s) FILTER (WHERE dist_km>=25), 0) AS nb_upwind_r1,
  coalesce(max(wu),0) AS regional_wind_u, coalesce(max(wv),0) AS regional_wind_v
FROM chan c LEFT JOIN (SELECT h.*, w.u AS wu, w.v AS wv,
    CASE WHEN blows THEN greatest(0, cos(radians(bearing_deg-wind_from))) ELSE 0 END AS k
  FROM heard h JOIN wind w ON w.station_id=h.station_id AND w.minute=h.minute) x ON x.station_id=c.station_id AND x.minute=c.minute
GROUP BY 1,2"""

CTES["nb"] = """
SELECT *, nb_max - coalesce(lag(nb_max,10) OVER (PARTITION BY station_id ORDER BY minute),0) AS nb_max_trend10 FROM nb0"""

CTES["channels"] = "SELECT c.*, nb.* EXCLUDE (station_id, minute) FROM chan c JOIN nb ON nb.station_id=c.station_id AND nb.minute=c.minute"


def _roll(fn: str, w: int) -> str:
    return f"{fn} OVER (PARTITION BY station_id ORDER BY minute ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


CTES["hist"] = """
SELECT station_id, minute, rain_rt, last_wet, last_dry, coalesce(least(1440, minute-last_wet),1440) AS P_mins_since_rain,
  CASE WHEN rain_rt>0 THEN least(600, minute-coalesce(last_dry, first-1)) ELSE 0 END AS P_wet_run,
  CASE WHEN rain_rt>0 THEN 0 ELSE least(1440, minute-coalesce(last_wet, first-1)) END AS P_dry_run,
  CASE WHEN rain_rt>0 THEN sum(rain_rt) OVER (PARTITION BY station_id, spell ORDER BY minute) ELSE 0 END AS P_spell_accum
FROM (SELECT station_id, minute, rain_rt, max(CASE WHEN rain_rt>0 THEN minute END) OVER w AS last_wet,
    max(CASE WHEN rain_rt<=0 THEN minute END) OVER w AS last_dry, sum(CASE WHEN rain_rt<=0 THEN 1 ELSE 0 END) OVER w AS spell,
    min(minute) OVER (PARTITION BY station_id) AS first
  FROM chan WINDOW w AS (PARTITION BY station_id ORDER BY minute))"""

CTES["roll"] = "SELECT station_id, minute, " + ", ".join(
    f"{_roll('sum(rain_rt)', w)} AS P_sum{w}, {_roll('avg(CASE WHEN rain_rt>0 THEN 1.0 ELSE 0 END)', w)} AS P_wetfrac{w}"
    for w in (5, 10, 30, 60)) + f", {_roll('max(rain_rt)', 10)} AS P_max10, {_roll('max(rain_rt)', 30)} AS P_max30 FROM chan"

CTES["lags"] = "SELECT station_id, minute, " + ", ".join(f"lag(rain_rt,{k}) OVER w AS P_lag{k}" for k in range(10)) + """,
  rain_rt - lag(rain_rt,3) OVER w AS P_slope3, lag(p10_last,10) OVER w AS P_p10_prev, """ + ", ".join(
    f"{c} - lag({c},30) OVER w AS M_{c}_d30, {c} - lag({c},60) OVER w AS M_{c}_d60" for c in ("temp", "rh", "wind_speed", "dewpoint_dep")
) + " FROM chan WINDOW w AS (PARTITION BY station_id ORDER BY minute)"

CTES["feats"] = """
SELECT c.station_id, c.minute, """ + ", ".join(f"P_lag{k}" for k in range(10)) + ", " + ", ".join(
    f"P_sum{w}, P_wetfrac{w}" for w in (5, 10, 30, 60)) + """, P_max10, P_max30, P_mins_since_rain, P_wet_run, P_dry_run, P_spell_accum,
  P_slope3, P_sum5 - lag(P_sum5,5) OVER w AS P_slope10, p10_last AS P_p10_last, p10_age AS P_p10_age, P_p10_prev, rain_signal AS P_signal,
  """ + ", ".join(f"{c} AS M_{c}" for c in ("temp", "rh", "wind_speed", "wind_u", "wind_v", "cloud", "dewpoint_dep", "met_age")) + ", " + ", ".join(
    f"M_{c}_d30, M_{c}_d60" for c in ("temp", "rh", "wind_speed", "dewpoint_dep")) + ", " + ", ".join(
    f"{c} AS T_{c}" for c in ("hour_sin", "hour_cos", "doy_sin", "doy_cos", "lat", "lon")) + ", " + ", ".join(
    f"{c} AS N_{c}" for c in [f"nb_r{r}_{q}" for r in (0, 1) for q in "NESW"] + ["nb_max", "nb_mean", "nb_wet_frac", "nb_nearest",
    "nb_max_trend10", "nb_upwind_r0", "nb_upwind_r1", "regional_wind_u", "regional_wind_v"]) + """,
  max(nb_max) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS N_nb_max_roll30,
  avg(nb_wet_frac) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS N_nb_wet_frac_roll30,
  nb_upwind_r1 - lag(nb_upwind_r1,10) OVER w AS N_upwind_r1_d10
FROM channels c JOIN hist h ON h.station_id=c.station_id AND h.minute=c.minute
  JOIN roll r ON r.station_id=c.station_id AND r.minute=c.minute JOIN lags l ON l.station_id=c.station_id AND l.minute=c.minute
WINDOW w AS (PARTITION BY c.station_id ORDER BY c.minute)"""

CTES["yearly"] = """
SELECT station_id, minute//360 AS year, count(*) AS minutes, avg(valid) AS valid_frac, count(p1_obs)/count(*)::DOUBLE AS p1_frac,
  count(*) FILTER (p10_obs>0) AS rain_windows, avg(valid) FILTER (p10_obs>0) AS rain_coverage,
  CASE WHEN sum(p10_obs)>0 THEN coalesce(sum(precip),0)/sum(p10_obs) END AS mass_ratio, count(*) FILTER (precip>0) AS wet_minutes,
  coalesce(sum(precip),0) AS precip_mm, count(temp_dry)/count(*)::DOUBLE*10 AS met_frac FROM truth GROUP BY 1,2"""

CTES["gated"] = """
SELECT *, valid_frac>=0.3 AND rain_windows>=5 AND coalesce(rain_coverage,0)>=0.5 AND coalesce(mass_ratio BETWEEN 0.5 AND 1.25,false) AS ok
FROM yearly"""

CTES["parts"] = """
SELECT * FROM (SELECT station_id, year, 'test-'||year AS part, greatest(500, year*360) AS start, least(721,(year+1)*360) AS "end" FROM gated WHERE ok)
WHERE start<"end" """

CTES["part_rows"] = """
SELECT c.station_id, c.minute, p.year, p.part, c.rain_rt, c.rain_signal, c.nb_max, t.target, t.target_valid, c.minute>=p.start AS in_period
FROM channels c JOIN targets t ON t.station_id=c.station_id AND t.minute=c.minute
JOIN parts p ON p.station_id=c.station_id AND c.minute>=p.start-30 AND c.minute<p."end" """

CTES["idx"] = """
SELECT c.station_id, c.minute, target AS y_true, rain_rt AS rain_now, c.minute//24 AS day, CASE WHEN c.minute<540 THEN 'val' ELSE 'test' END AS split
FROM chan c JOIN targets t ON t.station_id=c.station_id AND t.minute=c.minute WHERE target_valid=1 AND c.minute>=360"""

_MODELS = [
    ("zero", "0", "0", "0"), ("persistence", "CASE WHEN rain_rt>0 THEN 1 ELSE 0 END", "rain_rt", "rain_rt"),
    ("moving_average", "P_wetfrac10", "P_sum10/10", None), ("kalman_ll", "P_wetfrac30", "P_sum30/30", "P_max30"),
    ("lgbm_hurdle", "0.6*P_wetfrac5+0.4*P_wetfrac60", "0.5*rain_rt+0.05*P_sum10", "P_max10"),
    ("A__logistic_hurdle", "P_sum5/2", "P_sum5/5", None), ("hyb_stack", "0.5*P_wetfrac10+0.5*P_wetfrac60", "P_sum60/60", None),
    ("gru", "P_wetfrac60", "0.3*P_max10", "P_max30"), ("tcn", "P_wetfrac5", "0.2*P_max10", None)]

CTES["preds"] = " UNION ALL ".join(
    f"SELECT '{m}' AS model, r.station_id, r.minute, round(CAST({p} AS DOUBLE),6) AS p_rain, round(CAST({y} AS DOUBLE),6) AS y_hat, "
    + (f"round(CAST({q} AS DOUBLE),6)" if q else "NULL::DOUBLE")
    + " AS q90 FROM roll r JOIN chan c ON c.station_id=r.station_id AND c.minute=r.minute WHERE r.minute>=360"
    + (" AND rain_avail=1" if m == "gru" else " AND rain_avail=0" if m == "tcn" else "") for m, p, y, q in _MODELS)

CTES["kept"] = """
SELECT model FROM preds p JOIN idx i ON i.station_id=p.station_id AND i.minute=p.minute WHERE split='test'
GROUP BY model HAVING count(*) >= 0.85*(SELECT count(*) FROM idx WHERE split='test')"""

CTES["common"] = """
SELECT * FROM idx WHERE split='test' AND (station_id, minute) IN (SELECT (station_id, minute) FROM preds WHERE model IN (SELECT model FROM kept)
 GROUP BY station_id, minute HAVING count(*) = (SELECT count(*) FROM kept))"""

CTES["val_rows"] = """
SELECT p.model, i.*, p_rain, y_hat, q90 FROM idx i JOIN preds p ON p.station_id=i.station_id AND p.minute=i.minute WHERE split='val'"""


def tuned(score: str, event: str, name: str, rows: str = "val_rows", by: str = "model") -> str:
    """Best-CSI threshold per group written out over sorted arrays of scores."""
    return f"""
SELECT s.{by}, CASE WHEN s.kinds<2 OR s.pos=0 THEN 0.5 ELSE c.thr END AS {name} FROM
 (SELECT {by}, count(DISTINCT {score}) AS kinds, count(*) FILTER (WHERE {event}) AS pos FROM {rows} GROUP BY 1) s
LEFT JOIN (SELECT {by}, arg_min(thr, (-(CASE WHEN thr>0 THEN 1 ELSE 0 END), -csi, thr)) AS thr FROM (
  SELECT t.{by}, t.thr, coalesce(count(*) FILTER (WHERE ({event}) AND {score}>=t.thr)/nullif(count(*) FILTER (WHERE ({event}) OR {score}>=t.thr),0)::DOUBLE,0) AS csi
  FROM (SELECT DISTINCT {by}, a[lo+1]+(a[hi+1]-a[lo+1])*(h-lo) AS thr FROM (
    SELECT {by}, a, h, CAST(floor(h) AS BIGINT) AS lo, CAST(ceil(h) AS BIGINT) AS hi FROM (
     SELECT {by}, a, (CASE WHEN j=199 THEN 0.9999::DOUBLE ELSE 0.5::DOUBLE+j*((0.9999::DOUBLE-0.5::DOUBLE)/199) END)*(len(a)-1) AS h FROM
      (SELECT {by}, list({score} ORDER BY {score}) AS a FROM {rows} WHERE {score} IS NOT NULL GROUP BY 1), (SELECT unnest(range(0,200)) AS j)))) t
  JOIN {rows} r ON r.{by}=t.{by} GROUP BY 1,2) GROUP BY 1) c ON c.{by}=s.{by}"""


CTES["thr_a"] = tuned("p_rain", "y_true>0", "thr_rain")
CTES["thr_b"] = tuned("y_hat", "y_true*60>=12", "thr_ge12")
CTES["thr_c"] = tuned("y_hat", "y_true*60>=40", "thr_ge40")
CTES["thr"] = "SELECT a.model, thr_rain, thr_ge12, thr_ge40 FROM thr_a a JOIN thr_b b ON a.model=b.model JOIN thr_c c ON a.model=c.model"

CTES["scored"] = """
SELECT p.model, i.*, coalesce(p_rain,0) AS p_rain, coalesce(y_hat,0) AS y_hat, q90, thr_rain, thr_ge12, thr_ge40
FROM common i JOIN preds p ON p.station_id=i.station_id AND p.minute=i.minute JOIN thr t ON t.model=p.model WHERE p.model IN (SELECT model FROM kept)"""

CTES["cells"] = """
SELECT model, count(*) FILTER (y_true>0 AND p_rain>=thr_rain)::DOUBLE AS h, count(*) FILTER (y_true>0 AND p_rain<thr_rain)::DOUBLE AS m,
  count(*) FILTER (y_true<=0 AND p_rain>=thr_rain)::DOUBLE AS f, count(*) FILTER (y_true<=0 AND p_rain<thr_rain)::DOUBLE AS c FROM scored GROUP BY 1"""

CTES["errs"] = """
SELECT model, count(*) AS rows, sqrt(avg((y_hat-y_true)**2)) AS rmse, avg(abs(y_hat-y_true)) AS mae, avg(y_hat-y_true) AS bias,
  CASE WHEN stddev_pop(y_true)>0 AND stddev_pop(y_hat)>0 THEN corr(y_true,y_hat) END AS corr,
  sqrt(avg((y_hat-y_true)**2) FILTER (y_true>0)) AS rmse_wet, avg(abs(y_hat-y_true)) FILTER (y_true>0) AS mae_wet FROM scored GROUP BY 1"""

CTES["cats"] = """
SELECT model, h/nullif(h+m,0) AS pod, f/nullif(h+f,0) AS far, h/nullif(h+m+f,0) AS csi, (h+f)/nullif(h+m,0) AS fbias,
  (h-r)/nullif(h+m+f-r,0) AS ets, (h+c-x)/nullif(h+m+f+c-x,0) AS hss FROM (
  SELECT *, (h+m)*(h+f)/(h+m+f+c) AS r, ((h+m)*(h+f)+(c+m)*(c+f))/(h+m+f+c) AS x FROM cells)"""

CTES["board"] = """
SELECT e.model, rmse, csi AS csi_rain, 1-rmse/(SELECT rmse FROM errs WHERE model='persistence') AS skill_rmse FROM errs e JOIN cats c ON c.model=e.model"""

CTES["daily"] = """
SELECT model, day, sum((y_hat-y_true)**2) AS sse, count(*) AS n, count(*) FILTER (y_true>0 AND p_rain>=thr_rain) AS hits,
  count(*) FILTER (y_true>0 AND p_rain<thr_rain) AS misses, count(*) FILTER (y_true<=0 AND p_rain>=thr_rain) AS false_alarms FROM scored GROUP BY 1,2"""

CTES["draws"] = """
SELECT b AS draw, d[1+CAST(floor(CAST('0x'||substr(md5(b||'|'||s||'|42'),1,8) AS BIGINT)/4294967296.0*len(d)) AS INT)] AS day, count(*) AS times
FROM (SELECT d, b, unnest(range(0,len(d))) AS s FROM (SELECT d, unnest(range(0,200)) AS b FROM (SELECT list(DISTINCT day ORDER BY day) AS d FROM daily)))
GROUP BY 1,2"""

CTES["replicates"] = """
SELECT draw, model, sqrt(sum(times*sse)/sum(times*n)) AS rmse, sum(times*hits)/nullif(sum(times*(hits+misses+false_alarms)),0) AS csi
FROM draws d JOIN daily s ON s.day=d.day GROUP BY 1,2"""

CTES["idx"] = CTES["idx"].replace("c.minute//24 AS day", "c.minute//12 AS day")

CTES["px"] = """
SELECT (vec_id//3)*4 AS scan, vec_id%3 AS site, i//8 AS row, i%8 AS col, CASE WHEN raw=255 THEN NULL WHEN raw=0 THEN 0 WHEN r<0.05 THEN 0 ELSE r END AS rain
FROM (SELECT *, pow(pow(10,(0.5*raw-32)/10)/200,1/1.6) AS r FROM (SELECT vec_id, i,
  CASE WHEN abs(x)<0.02 THEN 0 WHEN x>0.12 THEN 255 ELSE CAST(floor(64+abs(x)*200) AS INT) END AS raw
  FROM (SELECT vec_id, unnest(range(0,64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)))"""

CTES["comp"] = """
SELECT scan, row, col, arg_min(rain, (dist, site)) FILTER (WHERE rain IS NOT NULL) AS rain FROM (
 SELECT px.*, sqrt(pow(row-CASE site WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 3 END,2)+pow(col-CASE site WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 6 END,2)) AS dist FROM px)
GROUP BY 1,2,3"""

CTES["st_px"] = "SELECT station_id, 2+CAST(station_id AS BIGINT)%4 AS row, 2+(CAST(station_id AS BIGINT)*3)%4 AS col FROM stations"

CTES["scanstat"] = "SELECT c.scan, s.station_id, max(rain) FILTER (c.row=s.row AND c.col=s.col) AS radar_r_pix, " + ", ".join(
    f"avg(rain) FILTER ({d}) AS radar_r_mean{k}, max(rain) FILTER ({d}) AS radar_r_max{k}, CASE WHEN count(rain) FILTER ({d})>0 THEN count(*) FILTER ({d} AND rain>0.1)/(count(*) FILTER ({d}))::DOUBLE END AS radar_wetfrac{k}"
    for k, d in ((k, f"abs(c.row-s.row)<={k // 2} AND abs(c.col-s.col)<={k // 2}") for k in (3, 5, 7))
) + """, count(*) FILTER (rain IS NULL)/count(*)::DOUBLE AS radar_nodata7
FROM comp c JOIN st_px s ON abs(c.row-s.row)<=3 AND abs(c.col-s.col)<=3 GROUP BY 1,2"""

CTES["tiles"] = """
SELECT scan, t.r0+2.0::DOUBLE AS tile_r, t.c0+2.0::DOUBLE AS tile_c, round(avg(coalesce(rain,0))*0.05-0.2,6) AS vy, round(0.3-avg(coalesce(rain,0))*0.04,6) AS vx
FROM comp c JOIN (SELECT r0, c0 FROM (SELECT unnest([0,2,4]) AS r0), (SELECT unnest([0,2,4]) AS c0)) t
  ON c.row>=t.r0 AND c.row<t.r0+4 AND c.col>=t.c0 AND c.col<t.c0+4 GROUP BY scan, t.r0, t.c0 HAVING avg(coalesce(rain,0))>1.5"""

CTES["whole"] = "SELECT scan, 0.1::DOUBLE AS vy, -0.1::DOUBLE*((scan//4)%3) AS vx FROM comp GROUP BY 1"

CTES["moving"] = """
SELECT x.*, CASE WHEN t.sw IS NULL THEN w.vy ELSE (t.sy+0.05*w.vy)/(t.sw+0.05) END AS vy, CASE WHEN t.sw IS NULL THEN w.vx ELSE (t.sx+0.05*w.vx)/(t.sw+0.05) END AS vx
FROM (SELECT scan, station_id, row, col FROM (SELECT DISTINCT scan FROM comp), st_px) x
LEFT JOIN whole w ON w.scan=x.scan
LEFT JOIN (SELECT t.scan, s.station_id, sum(k) AS sw, sum(k*vy) AS sy, sum(k*vx) AS sx FROM (
  SELECT t.*, s.station_id, exp(-(pow(tile_r-row,2)+pow(tile_c-col,2))/22500) AS k FROM tiles t, st_px s) t JOIN st_px s ON s.station_id=t.station_id GROUP BY 1,2) t
 ON t.scan=x.scan AND t.station_id=x.station_id"""

CTES["adv"] = """
SELECT m.scan, m.station_id, l.lead, CASE WHEN rr BETWEEN 1 AND 6 AND cc BETWEEN 1 AND 6 THEN
  (SELECT avg(rain) FROM comp c WHERE c.scan=m.scan AND abs(c.row-rr)<=1 AND abs(c.col-cc)<=1) END AS rain
FROM (SELECT m.*, lead, CAST(round_even(row-vy*lead,0) AS BIGINT) AS rr, CAST(round_even(col-vx*lead,0) AS BIGINT) AS cc FROM moving m, (SELECT unnest(range(1,6)) AS lead)) m
JOIN (SELECT unnest(range(1,6)) AS lead) l ON l.lead=m.lead"""

CTES["scanfeat"] = """
SELECT s.*, s.radar_r_mean5-coalesce(lag(s.radar_r_mean5) OVER w, NULL) AS d5, -m.vy AS radar_motion_v, m.vx AS radar_motion_u, a.adv
FROM scanstat s JOIN moving m ON m.scan=s.scan AND m.station_id=s.station_id
JOIN (SELECT scan, station_id, list(rain ORDER BY lead) AS adv FROM adv GROUP BY 1,2) a ON a.scan=s.scan AND a.station_id=s.station_id
WINDOW w AS (PARTITION BY s.station_id ORDER BY s.scan)"""

CTES["near_scan"] = """
SELECT station_id, minute, CASE WHEN minute-(scan+1)<=2 THEN scan END AS scan FROM (
 SELECT g.station_id, g.minute, x.scan FROM grid g ASOF LEFT JOIN (SELECT station_id, scan, scan+1 AS avail FROM scanstat) x ON x.station_id=g.station_id AND x.avail<=g.minute)"""

CTES["tab"] = """
SELECT r.station_id, r.minute, c.rain_rt AS P_lag0, coalesce(lag(c.rain_rt) OVER (PARTITION BY r.station_id ORDER BY r.minute),0) AS P_lag1, P_sum10, P_wetfrac10,
  1 AS month, r.minute%24 AS hour, t.target AS y, 1.0+r.minute%2 AS w, t.target_valid
FROM roll r JOIN chan c ON c.station_id=r.station_id AND c.minute=r.minute JOIN targets t ON t.station_id=r.station_id AND t.minute=r.minute"""

CTES["tab_train"] = "SELECT * FROM tab WHERE target_valid=1 AND minute<360"

CTES["clim"] = """
SELECT month, hour, sum(y*w)/sum(w) AS mean_amount, sum((y>0)::INT*w)/sum(w) AS wet_share, false AS overall FROM tab_train GROUP BY 1,2
UNION ALL SELECT NULL, NULL, sum(y*w)/sum(w), sum((y>0)::INT*w)/sum(w), true FROM tab_train"""

CTES["fit_rows"] = """
SELECT p.model, i.station_id, i.minute, y_true, rain_now, p_rain, y_hat FROM idx i JOIN preds p ON p.station_id=i.station_id AND p.minute=i.minute WHERE split='val'"""


def isotonic(points: str) -> str:
    """Isotonic values of points (model, x, s, w) by the max-min formula over all runs of points."""
    return f"""
SELECT model, x, max(lo) AS p_cal FROM (
 SELECT j.model, k.x, min((k.cs-j.cs+j.s)/(k.cw-j.cw+j.w)) OVER (PARTITION BY j.model, j.i ORDER BY k.i DESC) AS lo
 FROM (SELECT *, sum(w) OVER c AS cw, sum(s) OVER c AS cs, row_number() OVER c AS i FROM {points} WINDOW c AS (PARTITION BY model ORDER BY x)) j
 JOIN (SELECT *, sum(w) OVER c AS cw, sum(s) OVER c AS cs, row_number() OVER c AS i FROM {points} WINDOW c AS (PARTITION BY model ORDER BY x)) k ON k.model=j.model AND k.i>=j.i)
GROUP BY 1,2"""


CTES["cal_points"] = "SELECT model, coalesce(p_rain,0) AS x, count(*)::DOUBLE AS w, sum((y_true>0)::INT)::DOUBLE AS s FROM fit_rows GROUP BY 1,2"
CTES["cal_levels"] = isotonic("cal_points")
CTES["cal_rows"] = "SELECT f.*, p_cal FROM fit_rows f JOIN cal_levels l ON l.model=f.model AND l.x=coalesce(f.p_rain,0)"

CTES["dry_rows"] = "SELECT * FROM cal_rows WHERE rain_now=0"
CTES["dry_thr"] = tuned("p_cal", "y_true>0", "threshold", "dry_rows")

CTES["choice"] = """
SELECT (SELECT arg_min(model,(-csi,model)) FROM (SELECT r.model, count(*) FILTER (y_true>0 AND p_cal>=threshold)/nullif(count(*) FILTER (y_true>0 OR p_cal>=threshold),0)::DOUBLE AS csi
  FROM dry_rows r JOIN dry_thr t ON t.model=r.model GROUP BY 1)) AS best_dry,
 (SELECT arg_min(model,(rmse,model)) FROM (SELECT model, sqrt(avg((y_hat-y_true)**2)) AS rmse FROM fit_rows WHERE rain_now>0 GROUP BY 1)) AS best_wet"""

CTES["corrected"] = """
SELECT a.station_id, a.minute, a.y_true, greatest(0, a.y_hat+coalesce((SELECT sum(0.3*pow(0.6::DOUBLE, a.minute-1-b.minute)*(b.y_true-b.y_hat)) FROM fit_rows b
 WHERE b.model='lgbm_hurdle' AND b.station_id=a.station_id AND b.minute<a.minute),0)) AS y_hat FROM fit_rows a WHERE model='lgbm_hurdle'"""
