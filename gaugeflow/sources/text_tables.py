"""Many small delimited files whose columns differ from file to file.

A fixed CSV schema matches by position, so files with other column sets would be misread. Each
file's header (one row per file) is joined back on the path, lines go through Spark's CSV parser and
values are picked by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_station_id
from ..functions.rain import not_nan
from ..session import materialise

READING_COLUMNS = ("precip_past1min", "precip_past10min", "temp_dry", "humidity", "wind_speed", "wind_dir", "cloud_cover")

# Score columns a published metrics file may have.
METRIC_COLUMNS = ("precision", "recall", "f1", "pr_auc", "csi", "pod", "far")


def _lines(spark: SparkSession, path: str | list[str], recursive: bool) -> DataFrame:
    """Lines with ``file``, ``size`` and ``seq``: path, byte offset of the read block, then the order inside the block."""
    lines = (spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                     F.col("_metadata.file_block_start").alias("at_")).withColumn("id_", F.monotonically_increasing_id())
             .where(F.length(F.trim("value")) > 0))
    return lines.withColumn("seq", F.struct("file", "at_", "id_")).drop("at_", "id_")


def _cells(line: str, width: int) -> Column:
    """Values of a line as Spark's CSV parser reads them: quotes hold commas together."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    row = F.from_csv(line, schema, {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return F.array(*[F.trim(row[f"c{i}"]) for i in range(width)])


def read_headers(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """One row per file, data or not: ``file``, ``size``, ``head_`` (its place), ``names``."""
    heads = (_lines(spark, path, recursive).where(F.col("seq.at_") == 0).groupBy("file", "size")
             .agg(F.min("seq").alias("head_"), F.min_by("value", "seq").alias("h_")))
    heads = materialise(heads, "headers")  # a row per file: scanned once for the widest header and for the join
    width = heads.agg(F.max(F.size(F.split("h_", ",")))).first()[0] or 1
    return heads.select("file", "size", "head_", F.filter(_cells("h_", width), lambda c: c.isNotNull()).alias("names"), F.lit(width).alias("width_"))


def read_named_lines(spark: SparkSession, path: str | list[str], recursive: bool = False, heads: DataFrame | None = None) -> DataFrame:
    """Lines with ``file``, ``size``, ``seq`` (place in the file), ``names`` and ``cells``.

    Rows stand in ``seq`` as they do in the files, whatever partitions the blocks land in. The
    headers, one row per file, are joined back on the path; a file may be read by many tasks.
    """
    heads = read_headers(spark, path, recursive) if heads is None else heads
    first = heads.select("width_").first()
    lines = _lines(spark, path, recursive).join(heads.select("file", "head_", "names"), "file").where(F.col("seq") > F.col("head_"))
    return lines.select("file", "size", "seq", "names", _cells("value", first["width_"] if first else 1).alias("cells"))


def named(name: str) -> Column:
    at = F.array_position("names", name)
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def number(name: str) -> Column:
    """Text to double; anything else, NaN included, is null."""
    return not_nan(named(name).try_cast("double"))


def station_from_name(file: Column) -> Column:
    return F.substring(F.regexp_extract(file, r"([^/]+)$", 1), 1, 5)


def station_from_folder(file: Column) -> Column:
    return normalize_station_id(F.regexp_extract(F.url_decode(file), r"station_id=([^/]+)/", 1))


def utc_time(text: Column) -> Column:
    """Timestamp of an ISO text; without a zone it is UTC, whatever the session's zone. Junk is null."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(F.trim(text), F.lit("Z"))))


def _readings(lines: DataFrame, station: Column, columns: tuple[str, ...]) -> DataFrame:
    time = utc_time(named("time"))
    return (lines.select(station.alias("station_id"), time.alias("time"), "seq", *[number(c).alias(c) for c in columns])
            .where("time is not null"))


def read_station_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Readings of one file per station; unparsable times drop, bad numbers become null."""
    return _readings(read_named_lines(spark, path), station_from_name(F.col("file")), READING_COLUMNS)


def read_dense_overlap(spark: SparkSession, path: str) -> DataFrame:
    """Explicit-zero one-minute rain from nested folders named station_id=<id>."""
    return _readings(read_named_lines(spark, path, True), station_from_folder(F.col("file")), ("precip_past1min",))


def source_manifest(spark: SparkSession, path: str, overlap_path: str | None = None) -> DataFrame:
    """Per station file: size, columns, first and last time in file order, rows, overlap files. Files of a header alone have no rows."""
    heads = read_headers(spark, path)
    data = read_named_lines(spark, path, heads=heads).groupBy("file").agg(
        F.min_by(named("time"), "seq").alias("first"), F.max_by(named("time"), "seq").alias("last"), F.count(F.lit(1)).alias("n_"), F.min("seq").alias("from_"), F.max("seq").alias("to_"))
    both = heads.join(data, "file", "left")
    out = both.groupBy(station_from_name(F.col("file")).alias("station_id")).agg(
        (F.max("size") / 1e6).alias("size_mb"), F.max(F.array_join(F.slice("names", F.lit(2), F.size("names")), "|")).alias("columns"),
        F.bool_or(F.array_contains("names", "precip_past1min")).alias("has_1min"),
        F.min_by("first", "from_").alias("first"), F.max_by("last", "to_").alias("last"), F.coalesce(F.sum("n_"), F.lit(0)).alias("rows"))
    if overlap_path is None:
        return out.withColumn("overlap_files", F.lit(0).cast("long"))
    files = read_headers(spark, overlap_path, True)
    n = files.groupBy(station_from_folder(F.col("file")).alias("station_id")).agg(F.count_distinct("file").alias("overlap_files"))
    return out.join(n, "station_id", "left").withColumn("overlap_files", F.coalesce("overlap_files", F.lit(0)))


def published_metric_summary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per metrics file: mean of each known column it has, and its row count; a file of a header alone has null means."""
    heads = read_headers(spark, path)
    name = F.regexp_extract("file", r"([^/]+)$", 1).alias("file")
    listed = heads.select("file", F.explode(F.array_intersect(F.array(*map(F.lit, METRIC_COLUMNS)), "names")).alias("metric"))
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), number(c).alias("v")) for c in METRIC_COLUMNS])
    values = (read_named_lines(spark, path, heads=heads).select("file", F.explode(pairs).alias("p"))
              .groupBy("file", "p.metric").agg(F.avg("p.v").alias("mean"), F.count(F.lit(1)).alias("rows")))
    return listed.join(values, ["file", "metric"], "left").select(name, "metric", "mean", F.coalesce("rows", F.lit(0)).alias("rows"))
