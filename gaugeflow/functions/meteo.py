"""Weather and calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..clock import Clock

# Magnus formula over water, solar year, hours per day.
MAGNUS_A, MAGNUS_B = 17.62, 243.12
YEAR_DAYS, DAY_HOURS = 365.25, 24.0


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """East and north movement of the air for a wind blowing from ``direction`` degrees."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def wind_from_deg(u: Column, v: Column) -> Column:
    """Direction the air comes from."""
    return F.pmod(F.degrees(F.atan2(u, v)) + F.lit(180.0), F.lit(360.0))


def dewpoint_depression(temp: Column, humidity: Column) -> Column:
    """Temperature minus dew point; null if either input is null."""
    rh = F.when(humidity.isNotNull(), F.greatest(F.least(humidity, F.lit(100.0)), F.lit(1.0)))
    gamma = F.ln(rh / 100.0) + F.lit(MAGNUS_A) * temp / (F.lit(MAGNUS_B) + temp)
    return temp - F.lit(MAGNUS_B) * gamma / (F.lit(MAGNUS_A) - gamma)


def calendar_encoding(minute: Column, clock: Clock) -> dict[str, Column]:
    """Sine and cosine of the time of day and of the day of the year."""
    day = F.lit(2 * math.pi) * clock.hour_of_day(minute) / F.lit(DAY_HOURS)
    year = F.lit(2 * math.pi) * clock.day_of_year(minute) / F.lit(YEAR_DAYS)
    return {"hour_sin": F.sin(day), "hour_cos": F.cos(day), "doy_sin": F.sin(year), "doy_cos": F.cos(year)}
