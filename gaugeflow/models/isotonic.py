"""Isotonic regression whose fit is a stack of pooled blocks that can be merged.

Scores are pooled to distinct values and put in order by a range partitioning; each partition streams
its values through a stack of blocks, joining neighbours while their means fall. Neighbouring stacks
merge by the same rule, several at a time, level by level. Before each level two numbers per partition
(its first and last mean) tell which blocks can still change: a block that no mean to the left exceeds and
none to the right undercuts is settled and stays where it is, so only contested blocks travel. Many
curves (one per model) are fitted side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BLOCKS = "curve string, part int, lo double, hi double, s double, w double"
#: Stacks that one task merges at a level, and levels of a curve that are sent to the tasks at once (24 bytes each).
FAN, PIECE = 8, 1 << 20


def pooled(df: DataFrame, score: Column, target: Column, weight: Column, curve: Column) -> DataFrame:
    """Weighted sums per distinct score of each curve; rows without positive weight are left out."""
    rows = df.select(curve.cast("string").alias("curve"), score.cast("double").alias("lo"), target.cast("double").alias("t"), weight.cast("double").alias("w"))
    return rows.where("w > 0 AND t IS NOT NULL").groupBy("curve", "lo").agg(F.sum(F.col("t") * F.col("w")).alias("s"), F.sum("w").alias("w"))


class _Stack:
    """Blocks (lo, hi, sum, weight) with rising means."""

    def __init__(self):
        self.blocks: list[tuple[float, float, float, float]] = []

    def push(self, lo: float, hi: float, s: float, w: float) -> None:
        blocks = self.blocks
        while blocks and blocks[-1][2] * w >= s * blocks[-1][3]:
            first, _, more_s, more_w = blocks.pop()
            lo, s, w = first, s + more_s, w + more_w
        blocks.append((lo, hi, s, w))


def _stream(batches: Iterator[pd.DataFrame], part: int | None) -> Iterator[pd.DataFrame]:
    """Stacks of the curves and parts that follow each other in ``batches``; one stack is held at a time."""
    key, stack = None, _Stack()

    def out():
        frame = pd.DataFrame(stack.blocks, columns=["lo", "hi", "s", "w"])
        frame.insert(0, "curve", key[0])
        frame.insert(1, "part", np.int32(key[1]))
        return frame

    for pdf in batches:
        parts = pdf["part"].tolist() if part is None else [part] * len(pdf)
        for curve, p, lo, hi, s, w in zip(pdf["curve"].tolist(), parts, pdf["lo"].tolist(), pdf["hi"].tolist(), pdf["s"].tolist(), pdf["w"].tolist(), strict=True):
            if (curve, p) != key:
                if key is not None:
                    yield out()
                key, stack = (curve, p), _Stack()
            stack.push(lo, hi, s, w)
    if key is not None:
        yield out()


def levels(points: DataFrame, fan: int = FAN) -> DataFrame:
    """The isotonic fit of each curve: (curve, lo, hi, value, weight), one row per level."""
    spark = points.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = points.select("curve", "lo", F.col("lo").alias("hi"), "s", "w").repartitionByRange(n, "curve", "lo").sortWithinPartitions("curve", "lo")
    blocks = ordered.mapInPandas(lambda batches: _stream(batches, TaskContext.get().partitionId()), BLOCKS)
    mean = F.col("s") / F.col("w")
    done: list[DataFrame] = []
    while True:
        blocks = materialise(blocks, "blocks")
        # one row per curve and partition
        ends = blocks.groupBy("curve", "part").agg(F.min(mean).alias("first_"), F.max(mean).alias("last_"))
        line = Window.partitionBy("curve").orderBy("part")
        before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
        marks = ends.select("curve", "part", F.max("last_").over(before).alias("left_"), F.min("first_").over(after).alias("right_"),
                            F.floor((F.row_number().over(line) - 1) / fan).cast("int").alias("next_"))
        marks = marks.withColumnRenamed("curve", "curve_").withColumnRenamed("part", "part_")
        marked = blocks.join(F.broadcast(marks), F.col("curve").eqNullSafe(F.col("curve_")) & (F.col("part") == F.col("part_")))
        settled = (mean >= F.coalesce("left_", F.lit(float("-inf")))) & (mean <= F.coalesce("right_", F.lit(float("inf"))))
        done.append(marked.where(settled).select("curve", "lo", "hi", mean.alias("value"), F.col("w").alias("weight")))
        contested = marked.where(~settled).select("curve", F.col("next_").alias("part"), "lo", "hi", "s", "w")
        if contested.isEmpty():
            break
        blocks = contested.repartition("curve", "part").sortWithinPartitions("curve", "part", "lo").mapInPandas(lambda batches: _stream(batches, None), BLOCKS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialise(out, "levels")


def _look_up(known, first: bool):
    """Values of the broadcast levels; scores below a later piece keep what an earlier one gave."""

    def value(x: pd.Series, c: pd.Series, old: pd.Series) -> pd.Series:
        got = old.to_numpy(dtype=float, na_value=np.nan).copy()
        for name, (at, values) in known.value.items():
            mine = c.isna().to_numpy() if name is None else (c == name).to_numpy(dtype=bool, na_value=False)
            mine &= np.ones(len(x), bool) if first else x.to_numpy() >= at[0]
            got[mine] = np.interp(x.to_numpy()[mine], at, values)
        return pd.Series(got)

    return F.pandas_udf(value, "double")


class IsotonicCalibrator:
    """Monotone map from a score to a probability (or amount), constant outside the fitted range, linear between levels.

    With ``curve`` every value of that column has a map of its own; rows of a curve that was not fitted get null.
    A null score counts as 0.
    """

    def __init__(self, upper: float | None = 1.0):
        self.upper = upper

    def fit(self, df: DataFrame, score: str, target: Column, weight: Column | None = None, curve: str | None = None) -> "IsotonicCalibrator":
        self.curve = curve
        self.levels = levels(pooled(df, F.coalesce(F.col(score), F.lit(0.0)), target, F.lit(1.0) if weight is None else weight, self._curve()))
        return self

    def _curve(self) -> Column:
        return F.lit("") if self.curve is None else F.col(self.curve).cast("string")

    def _pieces(self) -> Iterator[tuple[dict, bool]]:
        """Levels of all curves, at most ``PIECE`` at a time, each with the edge of the piece before; whether it is the first."""
        line = Window.partitionBy("curve").orderBy("lo")
        bounds = self.levels.groupBy("curve").count().collect()
        whole = sum(r["count"] for r in bounds) <= PIECE
        if whole:
            rows = self.levels.select("curve", "lo", "hi", "value").collect()
            curves: dict = {}
            for r in sorted(rows, key=lambda r: (r["curve"] is not None, r["curve"], r["lo"])):
                curves.setdefault(r["curve"], []).append((r["lo"], r["hi"], r["value"]))
            yield {c: np.array(v) for c, v in curves.items()}, True
            return
        numbered = materialise(self.levels.withColumn("piece", F.floor((F.row_number().over(line) - 1) / PIECE)), "pieces")
        for b in bounds:
            own, last = numbered.where(F.col("curve").eqNullSafe(b["curve"])), None
            for k in range(-(-b["count"] // PIECE)):
                got = np.array(sorted((r["lo"], r["hi"], r["value"]) for r in own.where(F.col("piece") == k).select("lo", "hi", "value").collect()))
                held = got if last is None else np.vstack([last, got])
                yield {b["curve"]: held}, last is None
                last = got[-1:]

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        """Adds ``out``. Levels go to the tasks in pieces of bounded size; a row is worked on by the piece its score falls in."""
        spark = df.sparkSession
        data = df.withColumns({"cal_x_": F.coalesce(F.col(score), F.lit(0.0)).cast("double"), "cal_c_": self._curve(), out: F.lit(None).cast("double")})
        for curves, first in self._pieces():
            known = spark.sparkContext.broadcast({c: (v[:, :2].reshape(-1), np.repeat(v[:, 2], 2)) for c, v in curves.items()})
            data = data.withColumn(out, _look_up(known, first)("cal_x_", "cal_c_", out))
        v = F.greatest(F.when(~F.isnan(out), F.col(out)), F.lit(0.0))
        v = v if self.upper is None else F.least(v, F.lit(self.upper))
        return data.withColumn(out, F.when(F.col(out).isNotNull() & ~F.isnan(out), v)).drop("cal_x_", "cal_c_")
