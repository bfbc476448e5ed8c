"""Radar file names, observation JSON and the record format of the live service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..clock import Clock
from .text_tables import READING_COLUMNS

SCAN_NAME = r"^(ek[a-z]{2})(\d{8})_(\d{4})\."  # fixed value: <site><yyyymmdd>_<hhmm>.

FEATURE_SCHEMA = ("features array<struct<properties: struct<parameterId: string, observed: string, stationId: string, value: double>>>")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below a folder, contents not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def scan_file_catalog(paths: DataFrame) -> DataFrame:
    """One row per scan time with a map from site to path; other names are skipped."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda i: F.regexp_extract(name, SCAN_NAME, i)
    hits = paths.select("path", part(1).alias("site"), F.concat(part(2), part(3)).alias("stamp")).where("site <> ''")
    hits = hits.withColumn("scan_time", F.try_to_timestamp("stamp", F.lit("yyyyMMddHHmm"))).where("scan_time is not null")
    one = hits.groupBy("scan_time", "site").agg(F.max("path").alias("path"))
    return one.groupBy("scan_time").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("site", "path")))).alias("files"),
                                        F.count(F.lit(1)).alias("n_sites"))


def observation_api_json(spark: SparkSession, path: str, station: Column | None = None) -> DataFrame:
    """Features of observation files as one record per station and time; unknown parameters are ignored, the last value wins."""
    raw = spark.read.schema(FEATURE_SCHEMA).option("multiLine", "true").json(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("at", "f"))
    props = F.col("f.properties")
    rows = rows.where(props["parameterId"].isin(*READING_COLUMNS))
    order = F.struct("file", "at")
    picks = [F.max_by(F.when(props["parameterId"] == c, props["value"]), F.when(props["parameterId"] == c, order)).alias(c) for c in READING_COLUMNS]
    return (rows.groupBy((props["stationId"] if station is None else station).alias("station_id"), props["observed"].alias("time"))
            .agg(*picks, F.max(order).alias("seq")))


def records_from_rows(truth: DataFrame, clock: Clock = Clock()) -> DataFrame:
    """Wide rows as sparse JSON records without the null fields."""
    names = {"p1_obs": "precip_past1min", "p10_obs": "precip_past10min"}
    fields = [F.col(c).alias(names.get(c, c)) for c in truth.columns if names.get(c, c) in READING_COLUMNS]
    time = F.date_format(clock.time(F.col("minute")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return truth.select("station_id", "minute", F.to_json(F.struct("station_id", time.alias("time"), *fields), {"ignoreNullFields": "true"}).alias("record"))
