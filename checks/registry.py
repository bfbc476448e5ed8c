"""Registry of the check queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle import CTES
from .proxies import Proxy

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that summation order cannot show; -0 becomes 0."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def _needed(sql: str) -> list[str]:
    """Views the query reads, each with the views it reads itself, in dependency order."""
    wanted, texts = set(), [sql]
    for name in reversed(CTES):
        if any(re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text) for text in texts):
            wanted.add(name)
            texts.append(CTES[name])
    return [name for name in CTES if name in wanted]


def oracle(body: str, dbl: str = "", long: str = "", digits: int = 6) -> str:
    """Wrap a query with the fixture views it uses and the same rounding as ``tidy``."""
    ctes = [f"{n} AS ({CTES[n]})" for n in _needed(body)]
    replace = [f"round(CAST({c} AS DOUBLE),{digits})+0.0 AS {c}" for c in dbl.split()]
    replace += [f"CAST({c} AS BIGINT) AS {c}" for c in long.split()]
    head = f"SELECT * REPLACE ({', '.join(replace)}) FROM ({body})" if replace else body
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + head


def query(name: str, sql: str | None = None, dbl: str = "", long: str = "", digits: int = 6):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # local Python workers look for the package where the driver found it
            spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
            return tidy(fn(Proxy(spark, sf_dir)), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, dbl, long, digits)
        return fn

    return register
