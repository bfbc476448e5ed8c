"""Reference forecasts as projections and small aggregates.

Input frames carry features, ``month`` and ``hour`` where needed, and for fitting ``y`` and ``w``.
Every model gives ``p_rain``, ``y_hat`` and ``q90``.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.verify import ratio

OUTPUTS = ("p_rain", "y_hat", "q90")


def outputs(p: Column | None, y: Column | None, q: Column | None = None) -> dict[str, Column]:
    """The common forecast columns; amounts are never negative, missing outputs are null."""
    null = F.lit(None).cast("double")
    floor = lambda c: null if c is None else F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return {"p_rain": null if p is None else p.cast("double"), "y_hat": floor(y), "q90": floor(q)}


def zero(df: DataFrame) -> DataFrame:
    return df.withColumns(outputs(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def persistence(df: DataFrame) -> DataFrame:
    r = F.col("P_lag0")
    return df.withColumns(outputs((r > 0).cast("double"), r, r))


def moving_average(df: DataFrame) -> DataFrame:
    return df.withColumns(outputs(F.col("P_wetfrac10"), F.col("P_sum10") / 10.0))


def climatology_table(train: DataFrame) -> DataFrame:
    """Weighted mean amount and wet share per (month, hour) and, with null keys, overall; one scan."""
    m, h = F.col("month"), F.col("hour")
    w, y = F.col("w"), F.col("y")
    share = lambda v: ratio(F.sum(v * w), F.sum(w))
    return train.groupingSets([[m, h], []], m, h).agg(share(y).alias("mean_amount"), share((y > 0).cast("double")).alias("wet_share"),
                                                      (F.grouping("month") == 1).alias("overall"))


def climatology_lookup(df: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``mean_amount`` and ``wet_share`` of the row's month and hour, the overall values if unseen.

    The table has at most 12 x 24 + 1 rows, so broadcasting it is bounded by the calendar.
    """
    overall = table.where("overall").select(F.struct("mean_amount", "wet_share")).scalar()
    out = df.withColumn("all_", overall).join(F.broadcast(table.where("NOT overall").drop("overall")), ["month", "hour"], "left")
    return out.withColumns({c: F.coalesce(c, f"all_.{c}") for c in ("mean_amount", "wet_share")}).drop("all_")


def climatology(df: DataFrame, table: DataFrame) -> DataFrame:
    out = climatology_lookup(df, table)
    return out.withColumns(outputs(F.col("wet_share"), F.col("mean_amount"))).drop("wet_share", "mean_amount")


def weighted_least_squares(train: DataFrame, a: Column, b: Column, y: Column, w: Column, by: list[str] = ()) -> DataFrame:
    """Coefficients of y ~ ca * a + cb * b without intercept, from one set of sums.

    Singular systems get the minimum-norm solution, as a pseudo-inverse would give.
    """
    s = lambda c: F.sum(w * c)
    t = train.groupBy(*by).agg(s(a * a).alias("aa"), s(a * b).alias("ab"), s(b * b).alias("bb"), s(a * y).alias("ay"), s(b * y).alias("by_"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    trace = F.col("aa") + F.col("bb")
    regular = det > 1e-12 * trace * trace
    safe = F.when(regular, det)
    # rank one: all mass lies on one direction, so X'y / trace is already the minimum-norm solution
    ca = F.when(regular, (F.col("bb") * F.col("ay") - F.col("ab") * F.col("by_")) / safe).otherwise(F.coalesce(F.try_divide("ay", trace), F.lit(0.0)))
    cb = F.when(regular, (F.col("aa") * F.col("by_") - F.col("ab") * F.col("ay")) / safe).otherwise(F.coalesce(F.try_divide("by_", trace), F.lit(0.0)))
    return t.select(*by, ca.alias("coef_a"), cb.alias("coef_b"))


class PersistenceDecay:
    """Decayed amount by least squares, probability by a logistic fit on three wetness inputs."""

    name = "persistence_decay"
    inputs = ("z_now", "z_share", "z_prev")

    def _z(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"z_now": (F.col("P_lag0") > 0).cast("double"), "z_share": F.coalesce("P_wetfrac10", F.lit(0.0)),
                               "z_prev": F.coalesce((F.col("P_lag1") > 0).cast("double"), F.lit(0.0))})

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> "PersistenceDecay":
        row = weighted_least_squares(train, F.col("P_lag0"), F.col("P_sum10") / 10.0, F.col("y"), F.col("w")).first()
        self.coef = (row["coef_a"], row["coef_b"])
        total = train.agg(F.sum("w")).first()[0]
        data = VectorAssembler(inputCols=list(self.inputs), outputCol="features").transform(self._z(train)).withColumn("label", (F.col("y") > 0).cast("double"))
        # one penalty unit in total, on inputs as they are
        self.clf = LogisticRegression(weightCol="w", regParam=1.0 / total, standardization=False, maxIter=500).fit(data)
        return self

    def amount(self) -> Column:
        return F.lit(self.coef[0]) * F.col("P_lag0") + F.lit(self.coef[1]) * F.col("P_sum10") / 10.0

    def predict(self, df: DataFrame) -> DataFrame:
        d = self.clf.transform(VectorAssembler(inputCols=list(self.inputs), outputCol="features").transform(self._z(df)))
        d = d.withColumns(outputs(vector_to_array("probability")[1], self.amount()))
        return d.drop("features", "rawPrediction", "probability", "prediction", *self.inputs)


class Simple:
    """Fit-free or table-based reference behind the common fit / predict contract."""

    def __init__(self, name: str):
        self.name = name

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> "Simple":
        if self.name == "climatology":
            self.table = climatology_table(train)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.name == "climatology":
            return climatology(df, self.table)
        return {"zero": zero, "persistence": persistence, "moving_average": moving_average}[self.name](df)
