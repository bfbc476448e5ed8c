"""Checks: pairs, channels, neighbours and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions import geo, meteo
from gaugeflow.operators import channels, features, halo, neighbours

from .proxies import CLOCK, LONG_SLICES, SLICES
from .registry import query

OWN_DBL = ("rain_rt rain_avail p10_last rain_signal temp rh wind_speed wind_u wind_v cloud dewpoint_dep "
           "hour_sin hour_cos doy_sin doy_cos lat lon")
NB_DBL = " ".join(channels.NEIGHBOUR)


def widened(p, back=60):
    return SLICES.widen(p.own_channels, back)


@query("haversine_km", "SELECT a.station_id, b.station_id AS other, 2*6371.0*asin(least(1,sqrt(pow(sin(radians(b.lat-a.lat)/2),2)"
       "+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) AS km FROM raw r JOIN stations a ON a.station_id=r.station_id "
       "JOIN stations b ON CAST(b.station_id AS BIGINT)=CAST(a.station_id AS BIGINT)+1 GROUP BY ALL", dbl="km")
def haversine_km(p):
    a = p.raw.select("station_id").distinct().join(p.stations, "station_id")
    b = p.stations.selectExpr("lpad(CAST(CAST(station_id AS BIGINT) - 1 AS STRING), 5, '0') AS station_id", "station_id AS other", "lon AS lon2", "lat AS lat2")
    return a.join(b, "station_id").select("station_id", "other", geo.haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("km"))


@query("bearing_deg", "SELECT station_id, neighbour_id, bearing_deg FROM pairs", dbl="bearing_deg")
def bearing_deg(p):
    return p.pairs.select("station_id", "neighbour_id", "bearing_deg")


@query("station_pair_table", "SELECT * FROM pairs", dbl="dist_km bearing_deg")
def station_pair_table(p):
    return p.pairs


@query("wind_components", "SELECT station_id, minute, -wind_speed*sin(radians(wind_dir)) AS u, -wind_speed*cos(radians(wind_dir)) AS v FROM ded", dbl="u v")
def wind_components(p):
    u, v = meteo.wind_components(F.col("wind_speed"), F.col("wind_dir"))
    return p.ded.select("station_id", "minute", u.alias("u"), v.alias("v"))


@query("dewpoint_depression", "SELECT station_id, minute, dewpoint_dep FROM chan", dbl="dewpoint_dep")
def dewpoint_depression(p):
    return p.build_own_channels().select("station_id", "minute", "dewpoint_dep")


@query("calendar_encoding", "SELECT minute, sin(2*pi()*(minute%24)/24) AS hour_sin, cos(2*pi()*(minute%24)/24) AS hour_cos, "
       "sin(2*pi()*(1+minute//24)/365.25) AS doy_sin, cos(2*pi()*(1+minute//24)/365.25) AS doy_cos FROM raw", dbl="hour_sin hour_cos doy_sin doy_cos")
def calendar_encoding(p):
    return p.raw.select("minute", *[c.alias(n) for n, c in meteo.calendar_encoding(F.col("minute"), CLOCK).items()])


@query("ffill_limited", "SELECT station_id, minute, temp, rh FROM filled", dbl="temp rh")
def ffill_limited(p):
    df = SLICES.widen(p.obs, 30)
    return SLICES.own(df.withColumns({"temp": halo.carry_forward(SLICES, F.col("temp_dry"), 30),
                                      "rh": halo.carry_forward(SLICES, F.col("humidity"), 30)})).select("station_id", "minute", "temp", "rh")


@query("age_since_observation", "SELECT station_id, minute, p10_age, met_age FROM filled")
def age_since_observation(p):
    return p.build_own_channels().select("station_id", "minute", "p10_age", "met_age")


@query("rain_signal", "SELECT station_id, minute, rain_signal FROM chan", dbl="rain_signal")
def rain_signal(p):
    return p.build_own_channels().select("station_id", "minute", "rain_signal")


@query("station_channels", "SELECT * FROM chan", dbl=OWN_DBL)
def station_channels(p):
    return p.build_own_channels()


@query("neighbour_signal_join", "SELECT station_id, minute, neighbour_id, dist_km, s AS rain_signal FROM heard", dbl="dist_km rain_signal")
def neighbour_signal_join(p):
    return (neighbours.neighbour_signal_join(p.own_channels, p.profile, ["rain_signal"]).where(~F.col("is_self"))
            .select("station_id", "minute", "neighbour_id", "dist_km", "rain_signal"))


@query("neighbour_ring_quadrant_aggregate", "SELECT station_id, minute, nb_r0_N, nb_r0_E, nb_r0_S, nb_r0_W, nb_r1_N, nb_r1_E, nb_r1_S, nb_r1_W, "
       "nb_max, nb_mean, nb_wet_frac, nb_nearest FROM nb0", dbl=" ".join(channels.CELLS) + " nb_max nb_mean nb_wet_frac nb_nearest")
def neighbour_ring_quadrant_aggregate(p):
    return (neighbours.neighbour_aggregates(p.own_channels, p.profile)
            .select("station_id", "minute", *channels.CELLS, "nb_max", "nb_mean", "nb_wet_frac", "nb_nearest"))


@query("upwind_weighted_mean", "SELECT station_id, minute, nb_upwind_r0, nb_upwind_r1 FROM nb0", dbl="nb_upwind_r0 nb_upwind_r1")
def upwind_weighted_mean(p):
    return neighbours.neighbour_aggregates(p.own_channels, p.profile).select("station_id", "minute", "nb_upwind_r0", "nb_upwind_r1")


@query("regional_wind_mean", "SELECT station_id, minute, regional_wind_u, regional_wind_v FROM nb0", dbl="regional_wind_u regional_wind_v")
def regional_wind_mean(p):
    return neighbours.neighbour_aggregates(p.own_channels, p.profile).select("station_id", "minute", "regional_wind_u", "regional_wind_v")


@query("all_channels", "SELECT * FROM channels", dbl=OWN_DBL + " " + NB_DBL)
def all_channels(p):
    return p.build_channels()


LAG_NAMES = [f"P_lag{k}" for k in range(10)] + ["P_slope3", "P_p10_prev"] + [
    f"M_{c}_{d}" for c in features.MET_DIFFS for d in ("d30", "d60")]


@query("lag_features", f"SELECT station_id, minute, {', '.join(LAG_NAMES)} FROM lags", dbl=" ".join(LAG_NAMES))
def lag_features(p):
    return SLICES.own(features.lag_features(widened(p, 60), SLICES)).select("station_id", "minute", *LAG_NAMES)


ROLL_NAMES = [f"P_{k}{w}" for w in (5, 10, 30, 60) for k in ("sum", "wetfrac")] + ["P_max10", "P_max30"]


@query("rolling_stats", "SELECT * FROM roll", dbl=" ".join(ROLL_NAMES))
def rolling_stats(p):
    return SLICES.own(features.rolling_stats(widened(p, 60), SLICES)).select("station_id", "minute", *ROLL_NAMES)


@query("time_since_and_runs", "SELECT station_id, minute, P_mins_since_rain, P_wet_run, P_dry_run FROM hist")
def time_since_and_runs(p):
    return LONG_SLICES.own(features.time_since_and_runs(LONG_SLICES.widen(p.own_channels, 1500), LONG_SLICES)).select("station_id", "minute", "P_mins_since_rain", "P_wet_run", "P_dry_run")


@query("spell_accumulation", "SELECT station_id, minute, P_spell_accum FROM hist", dbl="P_spell_accum")
def spell_accumulation(p):
    carry = features.open_spell_carry(p.own_channels, SLICES)
    return SLICES.own(features.spell_accumulation(widened(p, 1), SLICES, carry)).select("station_id", "minute", "P_spell_accum")


@query("neighbour_trends", "SELECT station_id, minute, N_nb_max_trend10, N_nb_max_roll30, N_nb_wet_frac_roll30, N_upwind_r1_d10 FROM feats",
       dbl="N_nb_max_trend10 N_nb_max_roll30 N_nb_wet_frac_roll30 N_upwind_r1_d10")
def neighbour_trends(p):
    df = SLICES.own(features.neighbour_trends(SLICES.widen(p.channels, 30), SLICES))
    return df.select("station_id", "minute", F.col("nb_max_trend10").alias("N_nb_max_trend10"), "N_nb_max_roll30", "N_nb_wet_frac_roll30", "N_upwind_r1_d10")


def feature_frame(p):
    return features.build_features(p.channels, slices=LONG_SLICES)


@query("build_features", "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in (
    "P_mins_since_rain", "P_wet_run", "P_dry_run", "P_p10_age", "M_met_age")) + ") FROM feats", dbl=" ".join(
    LAG_NAMES + ROLL_NAMES + ["P_spell_accum", "P_slope10", "P_p10_last", "P_signal"] + [f"M_{c}" for c in features.MET_CHANNELS if c != "met_age"]
    + [f"T_{c}" for c in features.PLACE_CHANNELS] + [f"N_{c}" for c in channels.NEIGHBOUR]
    + ["N_nb_max_roll30", "N_nb_wet_frac_roll30", "N_upwind_r1_d10"]))
def build_features(p):
    return feature_frame(p)


@query("feature_group_select", "SELECT station_id, minute, T_hour_sin, T_hour_cos, T_doy_sin, T_doy_cos, T_lat, T_lon FROM feats",
       dbl="T_hour_sin T_hour_cos T_doy_sin T_doy_cos T_lat T_lon")
def feature_group_select(p):
    return features.feature_group_select(feature_frame(p), ("T",))


