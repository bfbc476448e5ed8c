"""From rain forecasts to link attenuation and its verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.link import scenario_array, scenario_attenuation
from ..params import LinkParams
from .verify import correlation, score_columns, table_counts


def station_latitude_lookup(df: DataFrame, stations: DataFrame, by: list[str], p: LinkParams = LinkParams()) -> DataFrame:
    """Median station latitude over the rows of each group; unknown stations count with the default.

    The median is taken over the few distinct latitudes with their frequencies.
    """
    n = df.groupBy(*by, "station_id").agg(F.count(F.lit(1)).alias("n_"))
    lat = n.join(stations.select("station_id", "lat"), "station_id", "left")
    return lat.groupBy(*by).agg(F.percentile(F.coalesce("lat", F.lit(p.default_lat)), F.lit(0.5), F.col("n_")).alias("lat_deg"))


def with_attenuation(df: DataFrame, lat: DataFrame, by: list[str], values: dict[str, str], p: LinkParams = LinkParams()) -> DataFrame:
    """One row per input row and scenario, with the attenuation of each named amount.

    ``lat`` has one row per group (a model or a station), so it is sent along; the rows stay where they are.
    """
    out = df.join(F.broadcast(lat), by).withColumn("s_", F.explode(scenario_array(p.scenarios)))
    cols = {name: scenario_attenuation(F.col(src), F.col("s_"), F.col("lat_deg"), p.rain_height_km) for name, src in values.items()}
    return out.withColumns({**cols, "scenario": F.col("s_")["scenario"]}).drop("s_")


def attenuation_scores(df: DataFrame, stations: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """Error in dB and fade-margin exceedance skill per model and scenario."""
    lat = station_latitude_lookup(df, stations, ["model"], p)
    df = df.withColumn("y_hat", F.coalesce("y_hat", F.lit(0.0)))
    a = with_attenuation(df, lat, ["model"], {"a_obs": "y_true", "a_hat": "y_hat", "a_q": "q90"}, p)
    a = a.withColumn("a_q", F.when(F.col("q90").isNotNull(), F.col("a_q")))
    obs, hat, q = F.col("a_obs"), F.col("a_hat"), F.col("a_q")
    e = hat - obs
    aggs = [F.sqrt(F.avg(e * e)).alias("rmse_db"), F.avg(F.abs(e)).alias("mae_db"), F.avg(e).alias("bias_db"),
            F.sqrt(F.avg(F.when(obs > 0.1, e * e))).alias("rmse_db_when_fading"),
            correlation(obs, hat).alias("corr"),
            (F.count(q) == F.count(F.lit(1))).alias("has_q_")]
    cols = ["model", "scenario", "rmse_db", "mae_db", "bias_db", "rmse_db_when_fading", "corr"]
    for m in p.margins_db:
        event = obs >= m
        aggs += table_counts(event, hat >= m, None, f"_{m}") + table_counts(event, F.coalesce(q >= m, F.lit(False)), None, f"_q{m}")
        aggs.append(F.count(F.when(event, 1)).alias(f"events_{m}dB"))
        s, t = score_columns(f"_{m}"), score_columns(f"_q{m}")
        cols += [s["pod"].alias(f"pod_{m}dB"), s["far"].alias(f"far_{m}dB"), s["csi"].alias(f"csi_{m}dB"), F.col(f"events_{m}dB"),
                 F.when(F.col("has_q_"), t["pod"]).alias(f"pod_{m}dB_q90"), F.when(F.col("has_q_"), t["csi"]).alias(f"csi_{m}dB_q90")]
    return a.groupBy("model", "scenario").agg(*aggs).select(*cols)


def scenario_reference_table(places: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """Coefficients and attenuation at 10 and 50 mm/h of each configured link at each place."""
    s, lat = F.col("s"), F.coalesce("lat", F.lit(p.default_lat))
    at = lambda mmh: scenario_attenuation(F.lit(mmh / 60.0), s, lat, p.rain_height_km)
    return (places.withColumn("s", F.explode(scenario_array(p.scenarios)))
            .select("station_id", "s.scenario", "s.f_ghz", "s.pol", "s.k", "s.alpha", at(10.0).alias("a_db_at_10mmh"), at(50.0).alias("a_db_at_50mmh")))
