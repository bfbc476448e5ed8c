"""What the stations around a station see.

``signals`` is the own-channel table on the shared grid of the network. The static pair profile lists
each station as its own partner too, so own columns travel along and need no second join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..clock import floor_div
from ..params import ChannelParams
from .channels import CELLS
from .halo import Slices, fits_broadcast, spread
from .stations import pair_profile

ROWS_A_TASK = 1_000_000  # signals of one partner that a task joins with its pairs
BLOCK_DEG = 1.0  # stations of one such square share a block
PAIRS_A_BLOCK = 20_000
MINUTES_A_GROUP = 240
VALUES_AT_ONCE = 500_000  # signals heard that a task holds side by side

SIGNALS = ("rain_signal", "wind_u", "wind_v")
PAIR = ("station_id", "neighbour_id", "bearing_deg", "cell", "in_r0", "in_r1", "n_cell", "n_all", "n_r0", "n_r1", "nearest", "is_self", "gives_wind")
HEARD = (*CELLS, "nb_max", "nb_mean", "nb_wet_frac", "nb_nearest", "nb_upwind_r0", "nb_upwind_r1", "regional_wind_u", "regional_wind_v")


def neighbour_profile(pairs: DataFrame, stations: DataFrame, p: ChannelParams = ChannelParams()) -> DataFrame:
    """Pair profile plus one row per station for itself. Static and small: write it once and reuse it."""
    prof = (pair_profile(pairs, p.rings_km).withColumn("is_self", F.lit(False))
            .withColumn("gives_wind", F.col("dist_km") <= p.wind_radius_km))
    counts = prof.groupBy("station_id").agg(*[F.max(c).alias(c) for c in ("n_all", "n_r0", "n_r1")])
    own = (stations.select("station_id").join(counts, "station_id", "left")
           .withColumns({"neighbour_id": F.col("station_id"), "is_self": F.lit(True), "gives_wind": F.col("n_all").isNotNull()}))
    return prof.unionByName(own, allowMissingColumns=True).join(station_blocks(stations, prof), "station_id")


def station_blocks(stations: DataFrame, pairs: DataFrame) -> DataFrame:
    """A block per station: near ones together, at most about ``PAIRS_A_BLOCK`` pairs in one."""
    spot = lambda c: F.floor(F.min(c) / BLOCK_DEG).alias(f"{c}_")
    held = pairs.groupBy("station_id").agg(F.count(F.lit(1)).alias("pairs_"))
    upto = Window.partitionBy("lon_", "lat_").orderBy("station_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (stations.groupBy("station_id").agg(spot("lon"), spot("lat")).join(held, "station_id", "left")
            .withColumn("part_", F.floor(F.sum(F.coalesce("pairs_", F.lit(0)) + 1).over(upto) / PAIRS_A_BLOCK))
            .select("station_id", F.xxhash64("lon_", "lat_", "part_").alias("block")))


def neighbour_signal_join(signals: DataFrame, profile: DataFrame, values: list[str], payload: list[str] = ()) -> DataFrame:
    """One row per (station, minute, partner) with the partner's ``values``.

    Small profile: the signals are spread by minute first, the join is a broadcast and everything
    downstream (per station and minute) needs no further shuffle. Larger profile: equi-join on
    the partner and a salt, as many as the partner with most signals needs.
    """
    own = [F.struct(*payload).alias("own_")] if payload else []
    sig = signals.select(F.col("station_id").alias("neighbour_id"), "minute", *values, *own)
    if fits_broadcast(profile):
        out = spread(sig, "minute").join(profile, "neighbour_id")
    else:
        most = signals.groupBy("station_id").count().agg(F.max("count")).first()[0] or 0
        salts = max(1, -(-most // ROWS_A_TASK))
        salted = profile.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = (sig.withColumn("salt_", F.pmod(F.col("minute"), F.lit(salts)).cast("int"))
               .join(salted, ["neighbour_id", "salt_"]).drop("salt_"))
    if payload:
        out = out.withColumn("own_", F.when(F.col("is_self"), F.col("own_")))
    return out


def neighbour_aggregates(signals: DataFrame, profile: DataFrame, p: ChannelParams = ChannelParams(),
                         payload: list[str] = ()) -> DataFrame:
    """Ring, quadrant, upwind and regional wind columns per station and minute.

    A missing signal counts as no rain. Means divide by the static number of partners. Signals travel
    once to every block of near stations that hears them, never once per pair; a task folds the pairs
    of one block over some minutes at a time.
    """
    bucket = F.coalesce(floor_div(F.col("minute"), MINUTES_A_GROUP), F.lit(-1 << 40)).alias("bucket_")
    heard_in = profile.groupBy("block", "neighbour_id").agg(F.max("is_self").alias("is_own"))
    sig = signals.select(F.col("station_id").alias("neighbour_id"), "minute", bucket, *[F.col(c).alias(f"{c}_") for c in SIGNALS],
                         F.struct(*payload).alias("own_") if payload else F.lit(None).alias("own_"))
    own = [F.when(F.col("is_own"), F.col("own_")[c]).alias(f"own_{i}") for i, c in enumerate(payload)]
    copies = sig.join(heard_in, "neighbour_id").select("block", "bucket_", "is_own", "neighbour_id", "minute", *[f"{c}_" for c in SIGNALS], *own)
    buckets = signals.select(bucket).distinct().agg(F.collect_list("bucket_"))  # bounded by the calendar
    pairs = (profile.withColumn("buckets_", buckets.scalar())
             .select(F.col("block").alias("at_block"), F.explode("buckets_").alias("at_bucket"), *[F.col(c).alias(c) for c in PAIR]))
    sides = [spread(d, *k).groupBy(*k) for d, k in ((copies, ("block", "bucket_")), (pairs, ("at_block", "at_bucket")))]
    keys = ["station_id", "minute"] if payload else ["minute", "station_id"]
    schema = T.StructType([signals.schema[c] for c in (*keys, *payload)] + [T.StructField(c, T.DoubleType()) for c in HEARD])

    def fold(sig: pa.Table, pairs: pa.Table) -> pa.Table:
        rows, columns = heard(sig, pairs, len(payload))
        got = sig.take(pa.array(rows))
        made = {"station_id": got["neighbour_id"], "minute": got["minute"]}
        out = [made[k] for k in keys] + [got[f"own_{i}"] for i in range(len(payload))] + [pa.array(columns[c]) for c in HEARD]
        return pa.table(out, names=[*keys, *payload, *HEARD])

    return sides[0].cogroup(sides[1]).applyInArrow(fold, schema)


def segment_starts(key: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)


def folded(how: np.ufunc, x: np.ndarray, key: np.ndarray, width: int, empty: float = 0.0) -> np.ndarray:
    """Fold the last axis, whose entries are sorted by ``key``, to one entry per key."""
    out = np.full((*x.shape[:-1], width), empty)
    starts = segment_starts(key)
    if len(starts):
        out[..., key[starts]] = how.reduceat(x, starts, axis=-1)
    return out


def per_station(value: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """The largest known ``value`` per key, 0 without one."""
    out = np.zeros(width)
    np.maximum.at(out, key, np.nan_to_num(value))
    return out


def share(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quotient, 0 where there is nothing to divide by."""
    return np.where(n > 0, a / np.where(n > 0, n, 1.0), 0.0)


def heard(sig: pa.Table, pairs: pa.Table, payload: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """What the stations of one block see: one row of ``sig`` per own station and minute, and its columns.

    Signals lie on a grid of minutes and partners; repeated rows of a partner and minute lie on further layers.
    """
    ids, own_ids = pairs["neighbour_id"].unique(), pairs["station_id"].unique()
    number = lambda c, known: np.asarray(pc.fill_null(pc.index_in(c, value_set=known), -1))
    doubles = lambda t, c: t[c].cast(pa.float64()).to_numpy()
    flag = lambda c: pc.fill_null(pairs[c], False).to_numpy()
    minutes, t = np.unique(pc.fill_null(sig["minute"], -(1 << 62)).to_numpy(), return_inverse=True)
    who = number(sig["neighbour_id"], ids)
    place = t * len(ids) + who
    order = np.argsort(place, kind="stable")
    starts = segment_starts(place[order])
    layer = np.empty(len(place), int)
    layer[order] = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
    shape = (int(layer.max(initial=0)) + 1, len(minutes), len(ids))

    def grid(value: np.ndarray, empty) -> np.ndarray:
        out = np.full(shape, empty, value.dtype)
        out[layer, t, who] = value
        return out

    there = grid(np.ones(len(place), bool), False)
    rain = grid(pc.fill_null(sig["rain_signal_"], 0.0).to_numpy(), 0.0)
    wind = [(grid(sig[c].is_valid().to_numpy(), False), grid(pc.fill_null(sig[c], 0.0).to_numpy(), 0.0)) for c in ("wind_u_", "wind_v_")]

    me, them, n = number(pairs["station_id"], own_ids), number(pairs["neighbour_id"], ids), len(own_ids)
    cell = np.where(pairs["cell"].is_valid().to_numpy(), pc.fill_null(pairs["cell"], len(CELLS)).to_numpy(), len(CELLS))
    by = np.lexsort((cell, me))
    me, them, cell, bearing = me[by], them[by], cell[by], doubles(pairs, "bearing_deg")[by]
    is_self, blown, nearest, in_ring = flag("is_self")[by], flag("gives_wind")[by], flag("nearest")[by], [flag(f"in_r{r}")[by] for r in (0, 1)]
    n_all, *n_ring = [per_station(doubles(pairs, c)[by], me, n) for c in ("n_all", "n_r0", "n_r1")]
    slot = me * (len(CELLS) + 1) + cell
    n_cell = per_station(doubles(pairs, "n_cell")[by], slot, n * (len(CELLS) + 1))
    other, blown, nearest = np.flatnonzero(~is_self), np.flatnonzero(blown), np.flatnonzero(nearest)
    rings = [np.flatnonzero(r & ~is_self) for r in in_ring]

    found = {c: np.zeros((len(minutes), n)) for c in HEARD}
    step = max(1, VALUES_AT_ONCE // max(1, shape[0] * len(me)))
    for a in range(0, len(minutes), step):
        at = slice(a, a + step)
        here, s = there[:, at], rain[:, at]
        add = lambda x, pick, width=n, key=me: folded(np.add, x, key[pick], width).sum(0)
        heard_s = s[..., them[other]]
        cells = share(add(heard_s, other, n * (len(CELLS) + 1), slot), n_cell).reshape(-1, n, len(CELLS) + 1)
        for i, name in enumerate(CELLS):
            found[name][at] = cells[..., i]
        top = folded(np.maximum, np.where(here[..., them[other]], heard_s, -np.inf), me[other], n, -np.inf).max(0)
        found["nb_max"][at] = np.where(np.isneginf(top), 0.0, top)
        found["nb_mean"][at] = share(add(heard_s, other), n_all)
        found["nb_wet_frac"][at] = share(add(((heard_s > 0) | np.isnan(heard_s)).astype(float), other), n_all)
        found["nb_nearest"][at] = add(s[..., them[nearest]], nearest)
        mean = []
        for known, value in wind:
            count = add(known[:, at][..., them[blown]].astype(float), blown)
            with np.errstate(invalid="ignore"):
                mean.append(np.where(count > 0, add(value[:, at][..., them[blown]], blown) / count, np.nan))
            mean.append(count > 0)
        u, has_u, v, has_v = mean
        found["regional_wind_u"][at], found["regional_wind_v"][at] = np.where(has_u, u, 0.0), np.where(has_v, v, 0.0)
        blows = has_u & has_v & ~(u * u + v * v <= 0.01)
        come_from = np.mod(np.degrees(np.arctan2(u, v)) + 180.0, 360.0)
        for r, pick in enumerate(rings):
            facing = np.cos(np.radians(bearing[pick] - come_from[:, me[pick]]))
            w = np.where(blows[:, me[pick]], np.maximum(facing, 0.0), 0.0)
            w = np.where(here[..., them[pick]], w, 0.0)
            ring_s = s[..., them[pick]]
            weight, plain = add(w, pick), share(add(ring_s, pick), n_ring[r])
            leans = ~(weight <= 0)
            found[f"nb_upwind_r{r}"][at] = np.where(leans, add(w * ring_s, pick) / np.where(leans, weight, 1.0), plain)

    rows = np.flatnonzero(pc.fill_null(sig["is_own"], False).to_numpy())
    if shape[0] > 1:
        rows = largest_of_repeats(sig, rows, place, payload)
    seat = number(ids, own_ids)[who[rows]]
    return rows, {c: v[t[rows], seat] for c, v in found.items()}


def largest_of_repeats(sig: pa.Table, rows: np.ndarray, place: np.ndarray, payload: int) -> np.ndarray:
    """Of own rows that repeat a station and minute the one whose payload sorts last."""
    columns = [sig[f"own_{i}"].take(pa.array(rows)).to_pylist() for i in range(payload)]
    size = [tuple((v is not None, v != v, 0 if v is None or v != v else v) for v in row) for row in zip(*columns)] or [()] * len(rows)
    best: dict[int, int] = {}
    for k, at in enumerate(place[rows]):
        if at not in best or size[k] > size[best[at]]:
            best[at] = k
    return rows[np.array(list(best.values()), int)]


def neighbour_trend(df: DataFrame, slices: Slices = Slices(), widened: bool = False) -> DataFrame:
    """Adds the ten-tick change of the highest neighbour signal; a missing past counts as 0."""
    s = slices
    if not widened:
        df = s.widen(df, 10)
    df = df.withColumn("nb_max_trend10", F.col("nb_max") - F.coalesce(F.lag("nb_max", 10).over(s.window()), F.lit(0.0)))
    return df if widened else s.own(df)
