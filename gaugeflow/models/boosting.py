"""Gradient boosting with losses that Spark's boosted trees lack: pinball (a quantile) and Tweedie deviance.

Each round fits one Spark ML regression tree to the loss's negative gradient, then gives every leaf the
constant that is best for the loss itself: a weighted quantile of the residuals, or the closed form of the
Tweedie deviance. Leaf values come from grouped sums (at most leaves x bins rows leave the tasks); rows,
features and margins stay tables. Rounds end when the loss on validation rows no longer falls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BINS = 256


def _of(values: list[float], leaf: str = "leaf") -> Column:
    """The entry of a short list that belongs to the row's leaf."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(leaf).cast("int") + 1)


def leaf_quantiles(rows: DataFrame, leaves: int, tau: float, bins: int = BINS) -> list[float]:
    """Exact weighted quantile of ``r`` in every leaf: the smallest value whose weights up to it reach the share ``tau``.

    Columns: leaf, r, w. Every pass counts the weights of equal bins between two values of the data and keeps the bin that
    holds the quantile, until it holds one value; a leaf may hold any share of the rows. An empty leaf gives 0.
    """
    ends = {int(r["leaf"]): r for r in rows.groupBy("leaf").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum("w").alias("w")).collect()}
    low, high = [[ends[k][c] if k in ends else 0.0 for k in range(leaves)] for c in ("lo", "hi")]
    need = [tau * ends[k]["w"] * (1 - 1e-12) if k in ends else 0.0 for k in range(leaves)]
    open_ = [k for k in range(leaves) if low[k] < high[k]]
    while open_:
        lo, hi = _of(low), _of(high)
        bin_ = F.least(F.floor((F.col("r") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
        inside = rows.where(F.col("leaf").cast("int").isin(open_) & (F.col("r") >= lo) & (F.col("r") <= hi))
        got: dict[int, list] = {}
        for r in inside.groupBy("leaf", bin_.alias("bin")).agg(F.sum("w").alias("w"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect():
            got.setdefault(int(r["leaf"]), []).append((r["bin"], r["w"], r["lo"], r["hi"]))
        for k in open_:
            line = sorted(got[k])
            for i, (_, w, a, b) in enumerate(line):
                if w >= need[k] or i == len(line) - 1:
                    low[k], high[k] = a, b
                    break
                need[k] -= w
        open_ = [k for k in open_ if low[k] < high[k]]
    return low


@dataclass(frozen=True)
class Pinball:
    """Loss whose best constant is the ``tau`` quantile."""

    tau: float = 0.9

    def start(self, rows: DataFrame) -> float:
        return leaf_quantiles(rows.select(F.lit(0).alias("leaf"), F.col("y").alias("r"), "w"), 1, self.tau)[0]

    def slope(self, y: Column, f: Column) -> Column:
        return F.when(y > f, self.tau).otherwise(self.tau - 1.0)

    def leaves(self, rows: DataFrame, count: int) -> list[float]:
        return leaf_quantiles(rows.select("leaf", (F.col("y") - F.col("f")).alias("r"), "w"), count, self.tau)

    def loss(self, y: Column, f: Column) -> Column:
        return F.greatest(self.tau * (y - f), (self.tau - 1.0) * (y - f))

    def value(self, f: Column) -> Column:
        return f


@dataclass(frozen=True)
class Tweedie:
    """Deviance of amounts with a mass at zero; the margin is the logarithm of the mean. 1 < power < 2."""

    power: float = 1.3
    most: float = 4.0

    def start(self, rows: DataFrame) -> float:
        wy, w = rows.agg(F.sum(F.col("w") * F.col("y")), F.sum("w")).first()
        return math.log(max((wy or 0.0) / max(w or 0.0, 1e-300), 1e-12))

    def slope(self, y: Column, f: Column) -> Column:
        return y * F.exp((1 - self.power) * f) - F.exp((2 - self.power) * f)

    def leaves(self, rows: DataFrame, count: int) -> list[float]:
        f = F.col("f")
        up, down = F.sum(F.col("w") * F.col("y") * F.exp((1 - self.power) * f)), F.sum(F.col("w") * F.exp((2 - self.power) * f))
        out = [0.0] * count
        for r in rows.groupBy("leaf").agg(up.alias("up"), down.alias("down")).collect():
            best = math.log(r["up"] / r["down"]) if r["up"] > 0 and r["down"] > 0 else -self.most
            out[int(r["leaf"])] = min(max(best, -self.most), self.most)
        return out

    def loss(self, y: Column, f: Column) -> Column:
        return F.exp((2 - self.power) * f) / (2 - self.power) - y * F.exp((1 - self.power) * f) / (1 - self.power)

    def value(self, f: Column) -> Column:
        return F.exp(f)


class Booster:
    """Trees fitted one after the other on columns ``features``, ``y``, ``w`` and ``is_val``."""

    def __init__(self, loss: Pinball | Tweedie, rounds: int = 50, depth: int = 5, step: float = 0.1, seed: int = 42, keep: int = 5):
        self.loss, self.rounds, self.depth, self.step, self.seed, self.keep = loss, rounds, depth, step, seed, keep

    def fit(self, data: DataFrame) -> "Booster":
        """``losses`` has the validation loss before the first round and after every round kept."""
        state = materialise(data.where("w > 0").select("features", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), "is_val"), "boost")
        own = state.where("NOT is_val")
        self.first = float(self.loss.start(own))
        self.trees: list = []
        y, f = F.col("y"), F.col("f")
        mean_loss = F.sum(F.col("w") * self.loss.loss(y, f)) / F.sum("w")
        state = state.withColumn("f", F.lit(self.first))
        self.losses = [self._validate(state, mean_loss)]
        for k in range(self.rounds):
            own = state.where("NOT is_val")
            tree = DecisionTreeRegressor(labelCol="slope", weightCol="w", maxDepth=self.depth, seed=self.seed + k).fit(own.withColumn("slope", self.loss.slope(y, f)))
            tree = tree.setLeafCol("leaf").setPredictionCol("")
            values = self.loss.leaves(tree.transform(own).select("leaf", "y", "f", "w"), tree.numNodes // 2 + 1)
            ahead = self._grown(state, "f", tree, values)
            if (k + 1) % self.keep == 0:  # the margins of some rounds are written, the next ones build on them
                ahead = materialise(ahead, "boost")
            loss = self._validate(ahead, mean_loss)
            if loss is not None and not loss < self.losses[-1]:
                break
            state = ahead
            self.trees.append((tree, values))
            self.losses.append(loss)
        return self

    @staticmethod
    def _validate(state: DataFrame, mean_loss: Column) -> float | None:
        return state.where("is_val").agg(mean_loss).first()[0]

    def _grown(self, df: DataFrame, out: str, tree, values: list[float]) -> DataFrame:
        return tree.transform(df).withColumn(out, F.col(out) + self.step * _of(values)).drop("leaf")

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Adds ``out``, the predicted quantile or mean, to rows with ``features``."""
        df = df.withColumn(out, F.lit(self.first))
        for tree, values in self.trees:
            df = self._grown(df, out, tree, values)
        return df.withColumn(out, self.loss.value(F.col(out)))
