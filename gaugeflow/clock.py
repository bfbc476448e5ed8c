"""Minute index arithmetic.

Tables carry ``minute``: a bigint index of clock ticks (default: minutes since the epoch, UTC).
All frames, ages and windows are integer arithmetic on it, so no operator depends on a session
time zone and no operator hard-codes the length of a tick.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def floor_div(value: Column, n: int) -> Column:
    """Integer division rounding down, also for negative values."""
    return F.floor(value / F.lit(n)).cast("long")


@dataclass(frozen=True)
class Clock:
    """Maps tick indices to calendar values: ``seconds = origin_s + minute * tick_s``."""

    tick_s: int = 60
    origin_s: int = 0

    @property
    def ticks_per_day(self) -> int:
        return DAY_SECONDS // self.tick_s

    def seconds(self, minute: Column) -> Column:
        return minute * F.lit(self.tick_s) + F.lit(self.origin_s)

    def time(self, minute: Column) -> Column:
        return F.timestamp_seconds(self.seconds(minute))

    def index(self, time: Column) -> Column:
        """Tick that contains ``time``."""
        return floor_div(F.unix_seconds(time) - F.lit(self.origin_s), self.tick_s)

    def on_tick(self, time: Column) -> Column:
        """True where ``time`` lies exactly on a tick."""
        micros = F.unix_micros(time) - F.lit(self.origin_s * 1_000_000)
        return F.pmod(micros, F.lit(self.tick_s * 1_000_000)) == 0

    def date(self, minute: Column) -> Column:
        return F.date_from_unix_date(floor_div(self.seconds(minute), DAY_SECONDS).cast("int"))

    def day_number(self, minute: Column) -> Column:
        return floor_div(self.seconds(minute), DAY_SECONDS)

    def hour_of_day(self, minute: Column) -> Column:
        """Hour as a fraction, 0 <= h < 24."""
        return F.pmod(self.seconds(minute), F.lit(DAY_SECONDS)) / F.lit(3600.0)

    def hour(self, minute: Column) -> Column:
        return F.floor(self.hour_of_day(minute)).cast("int")

    def month(self, minute: Column) -> Column:
        return F.month(self.date(minute))

    def year(self, minute: Column) -> Column:
        return F.year(self.date(minute))

    def day_of_year(self, minute: Column) -> Column:
        return F.dayofyear(self.date(minute))
