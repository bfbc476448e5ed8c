"""Identifier clean-up and model families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFER_PREFIX = "A__"

# Name prefixes of each model family, first match wins.
FAMILIES = (
    ("SAMBA (deep SSM)", ("samba",)),
    ("deep SSM", ("mamba", "s4d")),
    ("classical SSM", ("kalman", "hmm")),
    ("deep (non-SSM)", ("gru", "tcn", "patchtst")),
    ("gradient boosting", ("lgbm", "gbm")),
    ("hybrid", ("hyb",)),
    ("linear", ("logistic",)),
)


def normalize_station_id(raw: Column) -> Column:
    """Digits only, padded to five; longer ids keep all their digits."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(raw.cast("string")), r"\.0$", ""), r"\D+", "")
    return F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0"))


def base_name(model: Column) -> Column:
    return F.regexp_replace(model, "^" + TRANSFER_PREFIX, "")


def model_family(model: Column) -> Column:
    name = base_name(model)
    out = F.lit("baseline")
    for label, prefixes in reversed(FAMILIES):
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | name.startswith(prefix)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def deployable(model: Column) -> Column:
    """Neither transferred, hybrid nor classical state-space."""
    bad = F.lit(False)
    for prefix in (TRANSFER_PREFIX, "hyb", "kalman", "hmm"):
        bad = bad | model.startswith(prefix)
    return ~bad
