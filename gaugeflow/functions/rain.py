"""Rain transforms, reflectivity conversion and deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100.0  # fixed value: gauge resolution of 0.01 mm


def not_nan(x: Column) -> Column:
    """NaN becomes null; nothing past a source may hold NaN."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def finite_or_zero(x: Column) -> Column:
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(x.isNull() | bad, F.lit(0.0)).otherwise(x)


def log_observation(mm: Column, div: float = 1.0) -> Column:
    """log1p(100 * rain / div) with null and negative rain counted as none."""
    return F.log1p(F.lit(SCALE) * F.greatest(F.coalesce(mm.cast("double"), F.lit(0.0)), F.lit(0.0)) / F.lit(div))


def exogenous_inputs(nb_upwind_r0: Column, nb_upwind_r1: Column, nb_max: Column, nb_mean: Column,
                     p10_last: Column, p10_age: Column, rain_signal: Column, rh: Column) -> list[Column]:
    """The eight inputs of the driven filter, log-scaled like its observation."""
    recent = F.when(p10_age <= 9, p10_last).otherwise(F.lit(0.0))
    return [F.lit(1.0), log_observation(nb_upwind_r0, 10.0), log_observation(nb_upwind_r1, 10.0),
            log_observation(nb_max, 10.0), log_observation(nb_mean, 10.0), log_observation(recent, 10.0),
            log_observation(rain_signal, 10.0), F.coalesce((rh - 80.0) / 20.0, F.lit(0.0))]


def is_rain_like(name: str) -> bool:
    """Channels scaled as rain amounts rather than standardised."""
    return (name in ("rain_rt", "p10_last", "rain_signal", "nb_max", "nb_mean", "nb_nearest",
                     "nb_upwind_r0", "nb_upwind_r1")
            or name.startswith(("nb_r", "radar_r", "nowcast_")))


def rain_rate_transform(name: str, value: Column, mean: Column | None = None, std: Column | None = None) -> Column:
    """Network input scaling: log for rain amounts, z-score otherwise, zero for anything not finite."""
    value = value.cast("double")
    if not is_rain_like(name):
        return finite_or_zero((value - mean) / std)
    if name.startswith(("radar_r", "nowcast_")):
        value = value / 60.0
    div = 10.0 if name in ("p10_last", "rain_signal") or name.startswith("nb_") else 1.0
    return finite_or_zero(log_observation(value, div) / 3.0)


#: The usual scaling of stored radar values and the usual reflectivity relation.
RADAR_USUAL = {"gain": 0.5, "offset": -32.0, "nodata": 255.0, "undetect": 0.0, "zr_a": 200.0, "zr_b": 1.6}


def reflectivity_to_rain(raw: Column, **attributes: float | Column) -> Column:
    """Rain rate in mm/h from a stored radar value; no echo is 0, unknown is null.

    ``attributes``: gain, offset, nodata, undetect, zr_a, zr_b, as numbers or as columns of the image.
    """
    unknown = set(attributes) - set(RADAR_USUAL)
    if unknown:
        raise TypeError(f"no such attribute: {sorted(unknown)}")
    at = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in (RADAR_USUAL | attributes).items()}
    dbz = at["gain"] * raw + at["offset"]
    rate = F.pow(F.pow(F.lit(10.0), dbz / 10.0) / at["zr_a"], 1.0 / at["zr_b"])
    return (F.when(raw == at["nodata"], F.lit(None).cast("double"))
            .when(raw == at["undetect"], F.lit(0.0))
            .when(rate < 0.05, F.lit(0.0))
            .otherwise(rate))


def hurdle_expectation(p: Column, amount: Column) -> Column:
    """Probability of rain times its amount, never negative."""
    return p * F.greatest(amount, F.lit(0.0))


def hash01(*parts: Column) -> Column:
    """A draw in [0,1) that depends only on its inputs, not on partitions or order."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
