"""Causal per-minute inputs: row t uses readings made at or before t only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..clock import Clock
from ..functions import meteo
from ..params import ChannelParams
from .halo import Slices, add_rolling_sums, age_since, carry_forward

OWN = ("rain_rt", "rain_avail", "p10_last", "p10_age", "rain_signal", "temp", "rh", "wind_speed", "wind_u", "wind_v",
       "cloud", "dewpoint_dep", "met_age", "hour_sin", "hour_cos", "doy_sin", "doy_cos", "lat", "lon")
QUADRANTS = ("N", "E", "S", "W")
CELLS = tuple(f"nb_r{ring}_{q}" for ring in (0, 1) for q in QUADRANTS)
NEIGHBOUR = (*CELLS, "nb_max", "nb_mean", "nb_wet_frac", "nb_nearest", "nb_max_trend10",
             "nb_upwind_r0", "nb_upwind_r1", "regional_wind_u", "regional_wind_v")
ALL_CHANNELS = (*OWN, *NEIGHBOUR)


def rain_signal(sum10: Column, p10_last: Column, p10_age: Column) -> Column:
    """Best live estimate of the last ten minutes: the rolling sum or a recent total, whichever is larger."""
    recent = F.when(p10_age <= 9, F.coalesce(p10_last, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.greatest(F.coalesce(sum10, F.lit(0.0)), recent)


def station_channels(obs: DataFrame, stations: DataFrame, clock: Clock = Clock(), p: ChannelParams = ChannelParams(),
                     slices: Slices = Slices()) -> DataFrame:
    """The 19 own channels of every station on its dense grid (one shuffle, one sort)."""
    s = slices
    df = s.widen(obs, max(p.met_age_cap, p.p10_age_cap, 10))
    df = df.withColumn("rain_rt", F.coalesce("p1_obs", F.lit(0.0)))
    met_seen = F.col("temp_dry").isNotNull() | F.col("humidity").isNotNull() | F.col("wind_speed").isNotNull()
    carried = {name: carry_forward(s, F.col(src), p.met_max_age) for name, src in
               (("temp", "temp_dry"), ("rh", "humidity"), ("ws_", "wind_speed"), ("wd_", "wind_dir"), ("cc_", "cloud_cover"))}
    df = df.withColumns({
        **carried,
        "p10_last": F.coalesce(carry_forward(s, F.col("p10_obs"), p.p10_max_age), F.lit(0.0)),
        "p10_age": age_since(s, F.col("p10_obs").isNotNull(), p.p10_age_cap),
        "met_age": age_since(s, met_seen, p.met_age_cap)})
    df = s.own(add_rolling_sums(df, s, [("sum10_", F.col("rain_rt"), 10)]))
    u, v = meteo.wind_components(F.col("ws_"), F.col("wd_"))
    df = df.withColumns({
        "rain_avail": F.col("p1_obs").isNotNull().cast("double"),
        "rain_signal": rain_signal(F.col("sum10_"), F.col("p10_last"), F.col("p10_age")),
        "wind_speed": F.col("ws_"), "wind_u": u, "wind_v": v, "cloud": F.col("cc_") / 100.0,
        "dewpoint_dep": meteo.dewpoint_depression(F.col("temp"), F.col("rh")),
        **meteo.calendar_encoding(F.col("minute"), clock)})
    return (df.join(stations.select("station_id", "lat", "lon"), "station_id", "left")
            .select("station_id", "minute", *OWN))
