"""Checks: live ingest, state, forecast, records and the whole benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.models import baselines
from gaugeflow.params import EvalParams, SampleParams
from gaugeflow.plans.batch import Benchmark
from gaugeflow.sources import catalog, sinks
from gaugeflow.streaming import live

from .proxies import CLOCK, GATE, SLICES, SPLITS, stored
from .registry import query

FIELDS = ("precip_past1min", "temp_dry", "humidity", "wind_speed", "wind_dir", "cloud_cover")
LAST = "SELECT station_id, minute, " + ", ".join(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in FIELDS)
STATE = LAST.replace(", arg_max(temp_dry", ", NULL::DOUBLE AS precip_past10min, arg_max(temp_dry", 1) + " FROM clean GROUP BY 1,2"
DBL = "precip_past1min precip_past10min temp_dry humidity wind_speed wind_dir cloud_cover"


def ingest(p, rows=None):
    return live.ingest_records(p.raw if rows is None else rows, p.stations, CLOCK)


def state(p):
    """State after two batches: the first half of the readings, then all of them again."""
    return live.upsert(ingest(p, p.raw.where("minute < 400")), ingest(p))


class Live:
    """The state as the service finds it: a stored table."""

    def __init__(self, p):
        self.spark, self.dir, self.p = p.spark, p.dir, p

    def build_state(self):
        return state(self.p)

    table = stored(build_state)


@query("ingest_upsert", STATE, dbl=DBL)
def ingest_upsert(p):
    return ingest(p)


@query("stateful_event_dedup", STATE, dbl=DBL)
def stateful_event_dedup(p):
    return state(p)


@query("late_data_cutoff", f"SELECT s.* FROM ({STATE}) s JOIN (SELECT station_id, max(minute)-270 AS a FROM raw GROUP BY 1) m ON m.station_id=s.station_id AND s.minute>=m.a", dbl=DBL)
def late_data_cutoff(p):
    return live.late_data_cutoff(Live(p).table)


@query("staleness_flag", f"SELECT station_id, (SELECT max(minute) FROM raw)-max(minute) FILTER (WHERE precip_past1min IS NOT NULL) AS input_age_min, "
       f"coalesce((SELECT max(minute) FROM raw)-max(minute) FILTER (WHERE precip_past1min IS NOT NULL)>10,true) AS warning FROM ({STATE}) GROUP BY 1")
def staleness_flag(p):
    s = Live(p).table
    return live.staleness_flag(s, live.latest_tick(s))


@query("rolling_history_forecast", f"""
SELECT g.station_id, n AS issue_minute, n+1 AS valid_minute, avg((coalesce(p1,0)>0)::INT) AS p_rain, sum(coalesce(p1,0))/10 AS rain_mm_next_minute
FROM (SELECT station_id, n, unnest(range(n-9,n+1)) AS minute FROM (SELECT DISTINCT station_id, (SELECT max(minute) FROM raw) AS n FROM raw)) g
LEFT JOIN (SELECT station_id, minute, precip_past1min AS p1 FROM ({STATE})) s ON s.station_id=g.station_id AND s.minute=g.minute GROUP BY 1,2""", dbl="p_rain rain_mm_next_minute")
def rolling_history_forecast(p):
    out = live.rolling_history_forecast(Live(p).table, p.stations, p.profile, baselines.moving_average, clock=CLOCK, slices=SLICES)
    return out.select("station_id", "issue_minute", "valid_minute", "p_rain", "rain_mm_next_minute")


@query("replay_scoring", """
SELECT count(*) AS forecasts, count(precip) FILTER (valid=1) AS scored, avg(abs(p-precip)) FILTER (valid=1) AS mae_mm
FROM (SELECT t.station_id, t.minute+1 AS vm, coalesce(p1_obs,0) AS p FROM truth t) f LEFT JOIN truth o ON o.station_id=f.station_id AND o.minute=f.vm""", dbl="mae_mm")
def replay_scoring(p):
    f = p.targets.select("station_id", (F.col("minute") + 1).alias("valid_minute"), F.coalesce("p1_obs", F.lit(0.0)).alias("rain_mm_next_minute"))
    return live.replay_scoring(f, p.targets)


@query("records_from_rows", "SELECT station_id, minute, (p1_obs IS NOT NULL)::INT+(p10_obs IS NOT NULL)::INT+(temp_dry IS NOT NULL)::INT+(humidity IS NOT NULL)::INT+(wind_speed IS NOT NULL)::INT"
       "+(wind_dir IS NOT NULL)::INT+(cloud_cover IS NOT NULL)::INT+2 AS fields, p1_obs AS p1 FROM truth", dbl="p1", long="fields")
def records_from_rows(p):
    r = catalog.records_from_rows(p.targets, CLOCK)
    return r.select("station_id", "minute", F.size(F.json_object_keys("record")).alias("fields"), F.get_json_object("record", "$.precip_past1min").cast("double").alias("p1"))


@query("scan_file_catalog", "SELECT minute, count(DISTINCT site) AS n_sites FROM (SELECT date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) AS minute, event_type AS site FROM events WHERE event_type IN ('view','click')) GROUP BY 1")
def scan_file_catalog(p):
    site = F.when(F.col("event_type") == "view", "ekxr").when(F.col("event_type") == "click", "eksm").otherwise("other")
    paths = p.table("events").select(F.concat(F.lit("/a/b/"), site, F.date_format("ts", "yyyyMMdd_HHmm"), F.lit("."), F.col("event_id")).alias("path"))
    c = catalog.scan_file_catalog(paths)
    return c.select((F.timestamp_diff("MINUTE", F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("scan_time"))).alias("minute"), "n_sites")


@query("prediction_layout", "SELECT model, station_id, minute, p_rain, greatest(y_hat-0.1,0) AS y_hat, q90 FROM preds", dbl="p_rain y_hat q90", digits=4)
def prediction_layout(p):
    rows = p.preds.withColumn("y_hat", F.col("y_hat") - 0.1).withColumn("station_id", F.concat("model", F.lit("|"), "station_id"))
    d = sinks.prediction_layout(rows)
    key = F.split("station_id", "\\|")
    return d.select(key[0].alias("model"), key[1].alias("station_id"), "minute", *[F.col(c).cast("double").alias(c) for c in ("p_rain", "y_hat", "q90")])


def half_years(y):
    return y * 360, (y + 1) * 360


def benchmark():
    return Benchmark(SPLITS, CLOCK, SLICES, gate=GATE, sampling=SampleParams(dry_keep_frac=0.5, context=4, min_part_rows=20),
                     evaluation=EvalParams(intensity_mmh=(12.0, 40.0), bootstrap=50))


@query("benchmark_report")
def benchmark_report(p):
    models = [baselines.Simple(n) for n in ("zero", "climatology", "persistence", "moving_average")] + [baselines.PersistenceDecay()]
    readings = p.obs.withColumnsRenamed({"p1_obs": "precip_past1min", "p10_obs": "precip_past10min"}).withColumn("seq", F.lit(0))
    tables = benchmark().run(readings, p.stations, models, half_years, F.floor(F.col("minute") / 360).cast("long"))
    return tables["leaderboard"].join(tables["intervals"], "model")


