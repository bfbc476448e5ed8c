"""Rain attenuation of radio links (ITU-R P.838-3, P.530 and P.618).

Coefficients of a link depend on its frequency, polarisation and elevation only, so they are
computed once per scenario and enter the plan as literals of a small scenario table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ITU-R P.838-3 tables 1-4, rows (a, b, c), then slope m and intercept.
K_H = (((-5.33980, -0.10008, 1.13098), (-0.35351, 1.26970, 0.45400),
        (-0.23789, 0.86036, 0.15354), (-0.94158, 0.64552, 0.16817)), -0.18961, 0.71147)
K_V = (((-3.80595, 0.56934, 0.81061), (-3.44965, -0.22911, 0.51059),
        (-0.39902, 0.73042, 0.11899), (0.50167, 1.07319, 0.27195)), -0.16398, 0.63297)
ALPHA_H = (((-0.14318, 1.82442, -0.55187), (0.29591, 0.77564, 0.19822), (0.32177, 0.63773, 0.13164),
            (-5.37610, -0.96230, 1.47828), (16.1721, -3.29980, 3.43990)), 0.67849, -1.95537)
ALPHA_V = (((-0.07771, 2.33840, -0.76284), (0.56727, 0.95545, 0.54039), (-0.20238, 1.14520, 0.26809),
            (-48.2991, 0.791669, 0.116226), (48.5833, 0.791459, 0.116479)), -0.053739, 0.83433)
TILT_DEG = {"H": 0.0, "V": 90.0, "circular": 45.0}


def power_law(f_ghz: float, pol: str | float = "V", elevation_deg: float = 0.0) -> tuple[float, float]:
    """(k, alpha) of gamma = k R^alpha for one link."""
    log_f = math.log10(f_ghz)

    def curve(table):
        rows, slope, intercept = table
        return slope * log_f + intercept + math.fsum(a * math.exp(-((log_f - b) / c) ** 2) for a, b, c in rows)

    k_h, k_v = 10 ** curve(K_H), 10 ** curve(K_V)
    ka_h, ka_v = k_h * curve(ALPHA_H), k_v * curve(ALPHA_V)
    tilt = TILT_DEG[pol] if pol in TILT_DEG else float(pol)
    mix = math.cos(math.radians(elevation_deg)) ** 2 * math.cos(2 * math.radians(tilt))
    k = (k_h + k_v + (k_h - k_v) * mix) / 2
    return k, (ka_h + ka_v + (ka_h - ka_v) * mix) / (2 * k)


def specific_attenuation(rain_mmh: Column, k: Column, alpha: Column) -> Column:
    """dB per km."""
    return k * F.pow(F.greatest(rain_mmh, F.lit(0.0)), alpha)


def terrestrial_path_attenuation(rain_mmh: Column, k: Column, alpha: Column, f_ghz: Column, d_km: Column) -> Column:
    """dB over a terrestrial link; the distance factor is capped at 2.5."""
    rain = F.greatest(rain_mmh, F.lit(0.0))
    base = F.when(rain > 0, rain).otherwise(F.lit(1.0))
    denom = (F.lit(0.477) * F.pow(d_km, F.lit(0.633)) * F.pow(base, F.lit(0.073) * alpha) * F.pow(f_ghz, F.lit(0.123))
             - F.lit(10.579) * (F.lit(1.0) - F.exp(F.lit(-0.024) * d_km)))
    factor = F.when(denom > 0, F.least(F.lit(1.0) / F.when(denom > 0, denom), F.lit(2.5))).otherwise(F.lit(2.5))
    return specific_attenuation(rain, k, alpha) * d_km * factor


def slant_path_attenuation(rain_mmh: Column, k: Column, alpha: Column, f_ghz: Column, elevation_deg: Column,
                           lat_deg: Column, rain_height_km: Column, station_height_km: Column) -> Column:
    """dB over an earth-space path below the rain height."""
    rain = F.greatest(rain_mmh, F.lit(0.0))
    theta = F.radians(elevation_deg)
    depth = rain_height_km - station_height_km
    ground = depth / F.tan(theta)
    gamma = specific_attenuation(rain, k, alpha)
    shrink_h = F.lit(1.0) / (F.lit(1.0) + F.lit(0.78) * F.sqrt(ground * gamma / f_ghz)
                             - F.lit(0.38) * (F.lit(1.0) - F.exp(F.lit(-2.0) * ground)))
    zeta = F.degrees(F.atan2(depth, ground * shrink_h))
    length = F.when(zeta > elevation_deg, ground * shrink_h / F.cos(theta)).otherwise(depth / F.sin(theta))
    chi = F.greatest(F.lit(36.0) - F.abs(lat_deg), F.lit(0.0))
    shrink_v = F.lit(1.0) / (F.lit(1.0) + F.sqrt(F.sin(theta)) * (
        F.lit(31.0) * (F.lit(1.0) - F.exp(-elevation_deg / (F.lit(1.0) + chi)))
        * F.sqrt(length * gamma) / (f_ghz * f_ghz) - F.lit(0.45)))
    return F.when((rain > 0) & (depth > 0), gamma * length * shrink_v).otherwise(F.lit(0.0))


def scenario_attenuation(mm_per_min: Column, s: Column, lat_deg: Column, rain_height_km: float) -> Column:
    """dB for a one-minute amount under scenario struct ``s`` (see ``scenario_array``)."""
    rain = F.lit(60.0) * F.greatest(mm_per_min, F.lit(0.0))
    return (F.when(s["d_km"].isNotNull(),
                   terrestrial_path_attenuation(rain, s["k"], s["alpha"], s["f_ghz"], s["d_km"]))
            .otherwise(slant_path_attenuation(rain, s["k"], s["alpha"], s["f_ghz"], s["elevation_deg"], lat_deg,
                                              F.lit(float(rain_height_km)), s["station_height_km"])))


def scenario_array(scenarios) -> Column:
    """The configured links as an array of structs, to be exploded next to each row."""
    def item(s):
        path = "d_km" in s
        k, alpha = power_law(s["f_ghz"], s.get("pol", "V" if path else "circular"), s.get("elevation_deg", 0.0))
        null = F.lit(None).cast("double")
        return F.struct(
            F.lit(s["name"]).alias("scenario"), F.lit(float(s["f_ghz"])).alias("f_ghz"),
            F.lit(str(s.get("pol"))).alias("pol"), F.lit(k).alias("k"), F.lit(alpha).alias("alpha"),
            (F.lit(float(s["d_km"])) if path else null).alias("d_km"),
            (null if path else F.lit(float(s["elevation_deg"]))).alias("elevation_deg"),
            (null if path else F.lit(float(s.get("station_height_km", 0.05)))).alias("station_height_km"))
    return F.array(*[item(s) for s in scenarios])
