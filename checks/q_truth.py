"""Checks: cleaning, grid, truth and quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions import names
from gaugeflow.operators import quality, stations, truth
from gaugeflow.params import StationParams

from .proxies import CLOCK, SLICES
from .registry import query

MET_SQL = "temp_dry humidity wind_speed wind_dir cloud_cover"

FLAGSHIP_SQL = """
SELECT station_id, count(*) AS n, count(*) FILTER (y>0 AND r>0) AS hits, count(*) FILTER (y>0 AND r<=0) AS misses,
  count(*) FILTER (y<=0 AND r>0) AS false_alarms,
  count(*) FILTER (y>0 AND r>0)/nullif(count(*) FILTER (y>0 OR r>0),0)::DOUBLE AS csi
FROM (SELECT station_id, target AS y, coalesce(p1_obs,0) AS r FROM targets WHERE target_valid=1) GROUP BY 1"""


@query("persistence_csi_by_station", FLAGSHIP_SQL, dbl="csi")
def persistence_csi_by_station(p):
    y, r = F.col("target") > 0, F.coalesce("p1_obs", F.lit(0.0)) > 0
    n = lambda c: F.count(F.when(c, 1))
    return (p.build_targets().where("target_valid = 1").groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), n(y & r).alias("hits"), n(y & ~r).alias("misses"), n(~y & r).alias("false_alarms"),
        F.try_divide(n(y & r), n(y | r)).alias("csi")))


@query("range_clean", "SELECT * FROM clean", dbl=f"precip_past1min {MET_SQL}")
def range_clean(p):
    return quality.range_clean(p.raw)


@query("dedup_first_nonnull", "SELECT * FROM ded", dbl=f"precip_past1min {MET_SQL}")
def dedup_first_nonnull(p):
    return p.ded


@query("minute_grid", "SELECT * FROM grid")
def minute_grid(p):
    return truth.minute_grid(p.ded, SLICES.chunk)


@query("minute_union_grid", """
SELECT s.station_id, m.minute FROM (SELECT DISTINCT station_id FROM ded) s, (SELECT DISTINCT minute FROM ded) m""")
def minute_union_grid(p):
    return truth.minute_union_grid(p.ded)


@query("coalesce_overlap", """
SELECT coalesce(a.station_id,b.station_id) AS station_id, coalesce(a.minute,b.minute) AS minute,
  coalesce(a.p, CASE WHEN b.p BETWEEN 0 AND 5 THEN b.p END) AS precip_past1min
FROM (SELECT station_id, minute, precip_past1min AS p FROM ded) a FULL JOIN
  (SELECT station_id, minute+3 AS minute, max(temp_dry)/10 AS p FROM ded WHERE temp_dry IS NOT NULL GROUP BY 1,2) b
ON a.station_id=b.station_id AND a.minute=b.minute""", dbl="precip_past1min")
def coalesce_overlap(p):
    second = (p.ded.where("temp_dry is not null").groupBy("station_id", (F.col("minute") + 3).alias("minute"))
              .agg((F.max("temp_dry") / 10).alias("precip_past1min")))
    return truth.coalesce_overlap(p.ded.select("station_id", "minute", "precip_past1min"), second)


@query("mass_balance_window", "SELECT * FROM win", dbl="s1 p10")
def mass_balance_window(p):
    return truth.mass_balance_window(p.obs)


@query("dense_regime", "SELECT * FROM dense", dbl="dense")
def dense_regime(p):
    return truth.dense_regime(p.obs, slices=SLICES).select("station_id", "minute", "dense")


@query("validate_truth", "SELECT * FROM truth", dbl=f"p1_obs p10_obs precip {MET_SQL}", long="valid")
def validate_truth(p):
    return p.truth


@query("tip_harmonise", """
SELECT station_id, minute, CASE WHEN v IS NOT NULL THEN (tips - lag(tips,1,0.0) OVER (PARTITION BY station_id ORDER BY minute))*0.1::DOUBLE END AS fine,
  round_even(p10_obs*1.7::DOUBLE/0.1::DOUBLE,0)*0.1::DOUBLE AS total
FROM (SELECT station_id, minute, p10_obs, p1_obs*0.37::DOUBLE AS v, floor(sum(coalesce(p1_obs*0.37::DOUBLE,0)) OVER (PARTITION BY station_id ORDER BY minute)/0.1::DOUBLE+1e-6) AS tips FROM obs)""",
       dbl="fine total")
def tip_harmonise(p):
    fine = p.obs.select("station_id", "minute", (F.col("p1_obs") * 0.37).alias("fine"),
                        truth.whole_tips(F.col("p10_obs") * 1.7, 0.1).alias("total"))
    return truth.tip_harmonise(fine, "fine", 0.1, SLICES)


@query("next_minute_target", "SELECT station_id, minute, target, target_valid FROM targets", dbl="target", long="target_valid")
def next_minute_target(p):
    return truth.next_minute_target(p.truth, SLICES).select("station_id", "minute", "target", "target_valid")


@query("scan_truth_slice", "SELECT minute, precip, valid FROM truth WHERE station_id='00000' AND minute>=100 AND minute<400",
       dbl="precip", long="valid")
def scan_truth_slice(p):
    return truth.scan_truth_slice(p.truth, "00000", 100, 400, ["precip", "valid"])


QUALITY_DBL = "valid_frac p1_frac rain_coverage mass_ratio precip_mm met_frac"


@query("quality_by_year", "SELECT * FROM yearly", dbl=QUALITY_DBL)
def quality_by_year(p):
    return quality.quality_by_year(p.truth, CLOCK, F.floor(F.col("minute") / 360).cast("long"))


@query("quality_gate", "SELECT * FROM gated", dbl=QUALITY_DBL)
def quality_gate(p):
    return p.gated


@query("quality_by_calendar_year", """
SELECT year, count(DISTINCT station_id) AS stations, count(*) FILTER (ok) AS ok_station_years,
  quantile_cont(rain_coverage,0.5) AS median_rain_coverage, quantile_cont(mass_ratio,0.5) AS median_mass_ratio,
  sum(wet_minutes) AS wet_minutes FROM gated GROUP BY 1""",
       dbl="median_rain_coverage median_mass_ratio", long="wet_minutes")
def quality_by_calendar_year(p):
    return quality.quality_by_calendar_year(p.gated)


@query("needed_station_years", """
SELECT station_id, year FROM gated WHERE ok AND year IN (SELECT unnest(range(400//360, (720-1)//360+1)))""")
def needed_station_years(p):
    return quality.needed_station_years(p.gated, [(400, 720)], CLOCK, lambda m: F.floor(m / 360).cast("long"))


@query("normalize_station_id", """
SELECT raw_id, CASE WHEN length(d)>=5 THEN d ELSE lpad(d,5,'0') END AS station_id FROM (
 SELECT raw_id, regexp_replace(regexp_replace(trim(raw_id),'\\.0$',''),'\\D+','','g') AS d FROM (
  SELECT DISTINCT CASE event_id%4 WHEN 0 THEN ' '||user_id||'.0' WHEN 1 THEN 'DK-'||user_id WHEN 2 THEN user_id||'123456' ELSE CAST(user_id AS VARCHAR) END AS raw_id FROM events))""")
def normalize_station_id(p):
    ids = p.table("events").selectExpr(
        "CASE event_id % 4 WHEN 0 THEN ' ' || user_id || '.0' WHEN 1 THEN 'DK-' || user_id "
        "WHEN 2 THEN user_id || '123456' ELSE CAST(user_id AS STRING) END AS raw_id").distinct()
    return ids.withColumn("station_id", names.normalize_station_id(F.col("raw_id")))


@query("station_metadata_union", """
SELECT coalesce(a.station_id,b.station_id) AS station_id, CASE WHEN a.station_id IS NOT NULL THEN a.lon ELSE b.lon END AS lon,
  CASE WHEN a.station_id IS NOT NULL THEN a.lat ELSE b.lat END AS lat, a.name
FROM (SELECT station_id, lon, lat, 'S'||station_id AS name FROM stations WHERE CAST(station_id AS INT)%3<>0) a
FULL JOIN (SELECT station_id, lon+1 AS lon, lat FROM stations) b ON a.station_id=b.station_id""", dbl="lon lat")
def station_metadata_union(p):
    third = F.col("station_id").cast("int") % 3 == 0
    first = p.stations.select("station_id", F.when(~third, F.col("lon")).alias("lon"), "lat",
                              F.concat(F.lit("S"), "station_id").alias("name"))
    second = p.stations.select(F.concat("station_id", F.lit(".0")).alias("station_id"), (F.col("lon") + 1).alias("lon"), "lat")
    return stations.station_metadata_union(first, second)


@query("select_stations", """
SELECT DISTINCT station_id FROM raw WHERE station_id NOT LIKE '00004%' AND station_id IN (
 SELECT station_id FROM stations WHERE lon BETWEEN 9.05 AND 9.85 AND lat BETWEEN 54.4 AND 58)""")
def select_stations(p):
    return stations.select_stations(p.raw, p.stations, StationParams(exclude_prefixes=("00004",), bbox=(9.05, 54.4, 9.85, 58.0)))


@query("union_series", """
SELECT station_id, minute, precip_past1min, NULL::DOUBLE AS p10_obs FROM ded UNION ALL SELECT station_id, minute, NULL, p10_obs FROM obs WHERE p10_obs IS NOT NULL""",
       dbl="precip_past1min p10_obs")
def union_series(p):
    return (p.ded.select("station_id", "minute", "precip_past1min")
            .unionByName(p.obs.where("p10_obs is not null").select("station_id", "minute", "p10_obs"), allowMissingColumns=True))
