"""Station table, selection and neighbour pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..clock import floor_div
from ..functions.geo import bearing_deg, haversine_km
from ..functions.names import normalize_station_id
from ..params import StationParams


def station_metadata_union(*sources: DataFrame) -> DataFrame:
    """Coordinate tables in order of priority; the first one that has coordinates wins per id."""
    tagged = None
    for rank, source in enumerate(sources):
        part = source.withColumn("rank_", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    values = [c for c in tagged.columns if c not in ("station_id", "rank_", "seq")]
    order = F.struct("rank_", *(["seq"] if "seq" in tagged.columns else []), *[c for c in values])
    return (tagged.withColumn("station_id", normalize_station_id(F.col("station_id")))
            .where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
            .groupBy("station_id").agg(F.min_by(F.struct(*values), order).alias("s"))
            .select("station_id", "s.*"))


def select_stations(available: DataFrame, stations: DataFrame, p: StationParams = StationParams()) -> DataFrame:
    """Ids that pass the include list, the prefix rule and the closed bounding box."""
    lon0, lat0, lon1, lat1 = p.bbox
    keep = F.lit(True)
    if p.include:
        keep = keep & F.col("station_id").isin(*p.include)
    for prefix in p.exclude_prefixes:
        keep = keep & ~F.col("station_id").startswith(prefix)
    inside = stations.where(F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1)).where(keep)
    return available.select("station_id").where(keep).distinct().join(inside.select("station_id"), "station_id", "left_semi")


def station_pair_table(stations: DataFrame, max_km: float = 60.0) -> DataFrame:
    """Directed pairs of different stations at most ``max_km`` apart.

    Stations are binned into latitude bands and longitude cells at least ``max_km`` wide; a
    station only meets the ones in its own and the adjacent cells (equi-join on the cell), never
    the whole table. Longitude cells are sized per band, for the latitude nearest the pole that
    the neighbouring band reaches.
    """
    band_deg = max_km / 111.0
    bands = int(math.ceil(180.0 / band_deg))
    s = stations.select("station_id", "lon", "lat").withColumn("band_", F.floor((F.col("lat") + 90.0) / band_deg))

    def cells_in(band):
        edge = F.greatest(F.abs(band * band_deg - 90.0), F.abs((band + 1) * band_deg - 90.0)) + band_deg
        width = F.lit(max_km / 110.0) / F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-6))
        return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("long")

    n = cells_in(F.col("band_"))
    left = s.withColumn("cell_", F.pmod(F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / 360.0 * n), n))
    probe = (s.select(F.col("station_id").alias("neighbour_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"),
                      F.explode(F.sequence(F.col("band_") - 1, F.col("band_") + 1)).alias("band_"))
             .where(F.col("band_").between(0, bands)))
    m = cells_in(F.col("band_"))
    centre = F.floor(F.pmod(F.col("lon2"), F.lit(360.0)) / 360.0 * m)
    probe = (probe.withColumn("cell_", F.explode(F.array_distinct(F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(centre + d, m))))))
    dist = haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return (left.join(probe, ["band_", "cell_"])
            .where(F.col("station_id") != F.col("neighbour_id"))
            .withColumn("dist_km", dist).where(F.col("dist_km") <= max_km)
            .select("station_id", "neighbour_id", "dist_km",
                    bearing_deg(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("bearing_deg")))


def pair_profile(pairs: DataFrame, rings_km: tuple[float, float] = (25.0, 60.0)) -> DataFrame:
    """Pairs with their ring, quadrant and the static counts every minute's means divide by."""
    inner, outer = rings_km
    ring = F.when(F.col("dist_km") < inner, 0).when(F.col("dist_km") <= outer, 1)
    quadrant = F.pmod(floor_div(F.col("bearing_deg") + 45.0, 90), F.lit(4))
    w = Window.partitionBy("station_id")
    cell = Window.partitionBy("station_id", "cell")
    return (pairs.withColumn("cell", (ring * 4 + quadrant).cast("int"))
            .withColumn("in_r0", F.col("dist_km") <= inner)
            .withColumn("in_r1", F.col("dist_km").between(inner, outer))
            .withColumn("n_cell", F.count(F.lit(1)).over(cell))
            .withColumn("n_all", F.count(F.lit(1)).over(w))
            .withColumn("n_r0", F.sum(F.col("in_r0").cast("long")).over(w))
            .withColumn("n_r1", F.sum(F.col("in_r1").cast("long")).over(w))
            .withColumn("nearest", F.col("neighbour_id") == F.min_by("neighbour_id", F.struct("dist_km", "neighbour_id")).over(w)))
