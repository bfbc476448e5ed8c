"""Checks: the readings written as files of the feeds' layouts, read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugeflow.session import shared_dir
from gaugeflow.sources import catalog, sinks, text_tables

from .proxies import CLOCK
from .registry import query

FIELDS = ("precip_past1min", "temp_dry", "humidity", "wind_speed", "wind_dir", "cloud_cover")
ODD = ("wind_dir", "precip_past1min", "temp_dry", "humidity", "wind_speed")  # other order, no cloud cover
TEN_DAYS = 240


def folder(p, name):
    return f"{shared_dir(p.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stamp():
    return F.date_format(CLOCK.time(F.col("minute")), "yyyy-MM-dd'T'HH:mm:ssXXX")


def chunk():
    return F.floor(F.col("minute") / TEN_DAYS)


def line(columns):
    return F.concat_ws(",", stamp(), *[F.coalesce(F.col(c).cast("double").cast("string"), F.lit("")) for c in columns])


def station_files(p):
    """A file per station and ten days; every second one has other columns."""
    odd = chunk() % 2 == 1
    text = F.when(odd, line(ODD)).otherwise(line(FIELDS))
    head = F.when(F.col("chunk") % 2 == 1, F.lit(",".join(("time", *ODD)))).otherwise(F.lit(",".join(("time", *FIELDS))))
    groups = p.raw.groupBy("station_id", chunk().alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("minute", "seq", text.alias("line")))).alias("lines"))
    files = groups.select(F.format_string("%s_%03d.csv", "station_id", "chunk").alias("name"), F.concat_ws("\n", head, F.col("lines.line")).alias("content"))
    sinks.write_texts(files, path := folder(p, "station-csv"))
    return path


def overlap_folders(p):
    """Readings without rain in folders by station."""
    rows = p.raw.where("precip_past1min = 0").select("station_id", stamp().alias("time"), "precip_past1min").repartition(8, "station_id")
    rows.write.partitionBy("station_id").option("header", "true").csv(path := folder(p, "overlap"))
    return path


@query("read_station_csv", f"""
SELECT station_id, minute, precip_past1min, temp_dry, humidity, wind_speed, wind_dir, CASE WHEN (minute//{TEN_DAYS})%2=0 THEN cloud_cover END AS cloud_cover FROM raw""",
       dbl=" ".join(FIELDS))
def read_station_csv(p):
    rows = text_tables.read_station_csv(p.spark, station_files(p))
    return rows.select("station_id", CLOCK.index(F.col("time")).cast("long").alias("minute"), *FIELDS)


@query("read_dense_overlap", "SELECT station_id, minute, precip_past1min FROM raw WHERE precip_past1min=0", dbl="precip_past1min")
def read_dense_overlap(p):
    rows = text_tables.read_dense_overlap(p.spark, overlap_folders(p))
    return rows.select("station_id", CLOCK.index(F.col("time")).cast("long").alias("minute"), "precip_past1min")


@query("source_manifest", f"""
SELECT station_id, CASE WHEN bool_or((minute//{TEN_DAYS})%2=1) THEN '{'|'.join(ODD)}' ELSE '{'|'.join(FIELDS)}' END AS columns, true AS has_1min,
  min(minute) AS first, max(minute) AS last, count(*) AS rows, bool_or(precip_past1min=0)::INT AS overlap_files FROM raw GROUP BY station_id""", long="overlap_files")
def source_manifest(p):
    m = text_tables.source_manifest(p.spark, station_files(p), overlap_folders(p))
    at = lambda c: CLOCK.index(text_tables.utc_time(F.col(c))).cast("long").alias(c)
    return m.select("station_id", "columns", "has_1min", at("first"), at("last"), "rows", "overlap_files")


@query("observation_api_json", "SELECT station_id, minute, " + ", ".join(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in FIELDS) + " FROM raw GROUP BY 1,2",
       dbl=" ".join(FIELDS))
def observation_api_json(p):
    one = lambda name, value: F.struct(F.struct(F.lit(name).alias("parameterId"), stamp().alias("observed"), F.col("station_id").alias("stationId"), value.alias("value")).alias("properties"))
    found = F.filter(F.array(*[one(c, F.col(c).cast("double")) for c in FIELDS], one("visibility", F.lit(1.0))), lambda f: f["properties"]["value"].isNotNull())
    groups = p.raw.groupBy("station_id", chunk().alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("minute", "seq", found.alias("f")))).alias("rows"))
    files = groups.select(F.format_string("%s_%03d.json", "station_id", "chunk").alias("name"), F.to_json(F.struct(F.flatten(F.col("rows.f")).alias("features"))).alias("content"))
    sinks.write_texts(files, path := folder(p, "observations"))
    rows = catalog.observation_api_json(p.spark, path)
    return rows.select("station_id", CLOCK.index(text_tables.utc_time(F.col("time"))).cast("long").alias("minute"), *FIELDS)


@query("published_metric_summary", """
WITH g AS (SELECT station_id, minute%4 AS m, count(*)/100.0::DOUBLE AS csi, CASE WHEN count(*)%2=0 THEN (max(seq)%10)/10.0::DOUBLE END AS other FROM raw GROUP BY 1,2)
SELECT station_id||'.csv' AS file, 'csi' AS metric, avg(csi) AS mean, count(*) AS rows FROM g GROUP BY station_id
UNION ALL SELECT station_id||'.csv', CASE WHEN CAST(station_id AS BIGINT)%2=0 THEN 'pod' ELSE 'far' END, avg(other), count(*) FROM g GROUP BY station_id""", dbl="mean")
def published_metric_summary(p):
    g = p.raw.groupBy("station_id", (F.col("minute") % 4).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("top"))
    csi, other = (F.col("n") / 100.0).cast("string"), F.coalesce(F.when(F.col("n") % 2 == 0, F.col("top") % 10 / 10.0).cast("string"), F.lit(""))
    even = F.col("station_id").cast("long") % 2 == 0
    rows = g.select("station_id", "m", F.when(even, F.concat_ws(",", "m", csi, other)).otherwise(F.concat_ws(",", "m", other, csi)).alias("line"))
    head = F.when(even, F.lit("model,csi,pod")).otherwise(F.lit("model,far,csi"))
    files = rows.groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct("m", "line"))).alias("lines"))
    sinks.write_texts(files.select(F.concat("station_id", F.lit(".csv")).alias("name"), F.concat_ws("\n", head, F.col("lines.line")).alias("content")), path := folder(p, "metrics"))
    return text_tables.published_metric_summary(p.spark, path)


@query("partitioned_parquet_sink", "SELECT station_id, minute, CASE WHEN minute//360=1 THEN p1_obs+1 ELSE p1_obs END AS p1_obs, minute//360 AS year FROM obs", dbl="p1_obs")
def partitioned_parquet_sink(p):
    """All years written, one of them replaced."""
    rows = p.obs.select("station_id", "minute", "p1_obs", F.floor(F.col("minute") / 360).cast("long").alias("year"))
    path = folder(p, "sink")
    sinks.write_partitioned(rows, path)
    sinks.write_partitioned(rows.where("year = 1").withColumn("p1_obs", F.col("p1_obs") + 1), path)
    return p.spark.read.schema(rows.schema).parquet(path).select("station_id", "minute", "p1_obs", "year")
