"""Forecast verification.

Frames are long: one row per (model, station_id, minute) with ``y_true``, ``rain_now``, ``p_rain``,
``y_hat`` and ``q90``. Every score is a grouped aggregate with partial sums before the shuffle;
rank-based scores first fold rows to distinct scores and then rank those by one range partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import deployable, model_family
from ..params import EvalParams
from ..session import materialise

KEYS = ("station_id", "minute")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


# ----------------------------------------------------------------------------- rows to score
def distinct_keys(preds: DataFrame) -> DataFrame:
    return preds.select("model", *KEYS).dropDuplicates()


def index_prediction_join(index: DataFrame, preds: DataFrame) -> DataFrame:
    """Scored rows with each model's forecast."""
    return index.join(preds, list(KEYS))


def model_coverage(index: DataFrame, preds: DataFrame) -> DataFrame:
    """Share of the index each model predicts."""
    total = index.agg(F.count(F.lit(1))).scalar()
    hit = (distinct_keys(preds).join(index.select(*KEYS), list(KEYS), "left_semi")
           .groupBy("model").agg(F.count(F.lit(1)).alias("rows")))
    return hit.select("model", "rows", ratio(F.col("rows"), total).alias("coverage"))


def complete_forecasts(index: DataFrame, preds: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """Forecasts of sufficiently complete models on the index rows all of them predict.

    The join brings every forecast of a row together, so counting the models of a row needs no
    further shuffle; the kept models themselves are a handful of rows.
    """
    kept = model_coverage(index, preds).where(F.col("coverage") >= min_coverage).select("model")
    rows = index_prediction_join(index, preds.join(kept, "model", "left_semi"))
    have = F.size(F.collect_set("model").over(Window.partitionBy(*KEYS)))
    return rows.withColumn("have_", have).where(F.col("have_") == kept.agg(F.count(F.lit(1))).scalar()).drop("have_")


def common_row_intersection(index: DataFrame, preds: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """Index rows that every sufficiently complete model predicts."""
    return complete_forecasts(index, preds, min_coverage).select(*index.columns).dropDuplicates(list(KEYS))


def kept_predictions(index: DataFrame, preds: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """The forecasts of the kept models on the common rows, missing outputs as 0."""
    return complete_forecasts(index, preds, min_coverage).withColumns(
        {"p_rain": F.coalesce("p_rain", F.lit(0.0)), "y_hat": F.coalesce("y_hat", F.lit(0.0))})


def model_wide_pivot(preds: DataFrame, models: list[str]) -> DataFrame:
    """Forecasts side by side; names are given, so no pass to find them."""
    aggs = []
    for m in models:
        here = F.col("model") == m
        aggs += [F.max(F.when(here, F.col("p_rain"))).alias(f"{m}__p_rain"), F.max(F.when(here, F.col("y_hat"))).alias(f"{m}__y_hat")]
    return preds.groupBy(*KEYS).agg(*aggs)


# ----------------------------------------------------------------------------- contingency
def table_counts(obs: Column, fc: Column, weight: Column | None = None, suffix: str = "") -> list[Column]:
    """Weighted cells of the 2 x 2 table as aggregates."""
    one = F.lit(1.0) if weight is None else weight.cast("double")
    cell = lambda c: F.coalesce(F.sum(F.when(c, one)), F.lit(0.0))
    return [cell(obs & fc).alias("hits" + suffix), cell(obs & ~fc).alias("misses" + suffix),
            cell(~obs & fc).alias("false_alarms" + suffix), cell(~obs & ~fc).alias("correct_neg" + suffix)]


def contingency(df: DataFrame, by: list[str], obs: Column, fc: Column, weight: Column | None = None) -> DataFrame:
    return df.groupBy(*by).agg(*table_counts(obs, fc, weight))


def score_columns(suffix: str = "", prefix: str = "", out: str = "") -> dict[str, Column]:
    """POD, FAR, CSI, frequency bias, ETS and HSS from the cells; null where undefined."""
    h, m, f, c = (F.col(n + suffix) for n in ("hits", "misses", "false_alarms", "correct_neg"))
    n = h + m + f + c
    by_chance = ratio((h + m) * (h + f), n)
    expected = ratio((h + m) * (h + f) + (c + m) * (c + f), n)
    scores = {"pod": ratio(h, h + m), "far": ratio(f, h + f), "csi": ratio(h, h + m + f), "fbias": ratio(h + f, h + m),
              "ets": ratio(h - by_chance, h + m + f - by_chance), "hss": ratio(h + c - expected, n - expected)}
    return {prefix + k + out: v for k, v in scores.items()}


def categorical_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns(score_columns())


# ----------------------------------------------------------------------------- amounts and probabilities
def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation, null when either side is constant."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread))


def error_columns(y: Column, yhat: Column) -> list[Column]:
    e = yhat - y
    wet = y > 0
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
            correlation(y, yhat).alias("corr"),
            F.sqrt(F.avg(F.when(wet, e * e))).alias("rmse_wet"), F.avg(F.when(wet, F.abs(e))).alias("mae_wet")]


def continuous_scores(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*error_columns(F.col("y_true"), F.col("y_hat")))


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def brier_column(p: Column, obs: Column) -> Column:
    gap = clipped(p) - obs.cast("double")
    return F.avg(gap * gap)


def brier(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(brier_column(F.col("p_rain"), F.col("y_true") > 0).alias("brier"))


def pinball_column(q: Column, y: Column, tau: float = 0.9) -> Column:
    """Quantile loss, only where every row of the group has the quantile."""
    d = y - q
    loss = F.avg(F.greatest(F.lit(tau) * d, F.lit(tau - 1) * d))
    return F.when(F.count(q) == F.count(F.lit(1)), loss)


def pinball(df: DataFrame, by: list[str], tau: float = 0.9) -> DataFrame:
    return df.groupBy(*by).agg(pinball_column(F.col("q90"), F.col("y_true"), tau).alias("pinball_q90"))


def reliability_table(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Forecast and observed share per probability bin; 1 belongs to the last bin.

    The bin counts the edges a value has reached, so values on an edge fall like the literals do.
    """
    p = clipped(F.col("p_rain"))
    edges = [i / bins for i in range(1, bins)]
    reached = F.lit(0)
    for edge in edges:
        reached = reached + (p >= edge).cast("int")
    return (df.groupBy(*by, reached.alias("bin")).agg(
        F.avg(p).alias("p_mean"), F.avg((F.col("y_true") > 0).cast("double")).alias("obs_freq"), F.count(F.lit(1)).alias("n")))


# ----------------------------------------------------------------------------- rank-based scores
def ranked_scores(df: DataFrame, by: list[str], score: Column, event: Column) -> DataFrame:
    """Distinct scores per group with their counts and the counts below them.

    One range partitioning by group and score puts the distinct scores in order; it is written, so that every reader sees
    the same partitions. Totals per group and partition give the offsets, and a window never holds more than a partition.
    """
    rows = df.select(*by, score.cast("double").alias("score"), event.alias("event_")).where("score is not null")
    seen = rows.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_").cast("long")).alias("pos"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(seen.repartitionByRange(parts, *by, "score").withColumn("part_", F.spark_partition_id()), "ranks")
    totals = placed.groupBy(*by, "part_").agg(F.sum("n").alias("bn_"), F.sum("pos").alias("bp_"))
    before = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    offsets = totals.select(*by, "part_", F.coalesce(F.sum("bn_").over(before), F.lit(0)).alias("on_"),
                            F.coalesce(F.sum("bp_").over(before), F.lit(0)).alias("op_"),
                            F.sum("bn_").over(group).alias("total"), F.sum("bp_").over(group).alias("total_pos"))
    inside = Window.partitionBy(*by, "part_").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumns({"upto_": F.sum("n").over(inside), "pos_upto_": F.sum("pos").over(inside)})
    return (ranked.join(offsets, [*by, "part_"])
            .withColumns({"below": F.col("on_") + F.col("upto_") - F.col("n"), "pos_below": F.col("op_") + F.col("pos_upto_") - F.col("pos")})
            .select(*by, "score", "n", "pos", "below", "pos_below", "total", "total_pos"))


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Area under the stepwise precision-recall curve; null when only one class occurs."""
    r = ranked_scores(df, by, F.coalesce("p_rain", F.lit(0.0)), F.col("y_true") > 0)
    precision = (F.col("total_pos") - F.col("pos_below")) / (F.col("total") - F.col("below"))
    both = (F.max("total_pos") > 0) & (F.max("total_pos") < F.max("total"))
    return r.groupBy(*by).agg(F.when(both, F.sum(F.col("pos") * precision) / F.max("total_pos")).alias("pr_auc"))


def tune_threshold(df: DataFrame, by: list[str], score: Column, event: Column, n_grid: int = 200) -> DataFrame:
    """Threshold per group with the best CSI among exact score quantiles; 0.5 without a usable choice.

    The counts at a candidate follow from the ranks of the two order statistics around it, so no
    second pass over the rows is needed.
    """
    lo_q, hi_q = 0.5, 0.9999
    step = (hi_q - lo_q) / (n_grid - 1)
    grid = F.array(*[F.lit(hi_q if j == n_grid - 1 else lo_q + j * step) for j in range(n_grid)])
    r = ranked_scores(df, by, score, event).withColumn("last_", (F.col("total") - 1).cast("double"))
    top = F.col("below") + F.col("n")
    first = F.floor((F.try_divide(F.col("below") - 1, F.col("last_")) - lo_q) / step) - 1
    last = F.ceil((F.try_divide(top, F.col("last_")) - lo_q) / step) + 1
    probes = (r.where("total > 1")
              .withColumns({"a_": F.greatest(first, F.lit(0)).cast("int"), "b_": F.least(last, F.lit(n_grid - 1)).cast("int")})
              .where("a_ <= b_").withColumn("j", F.explode(F.sequence("a_", "b_")))
              .withColumn("h_", F.element_at(grid, F.col("j") + 1) * F.col("last_")))
    within = lambda k: (k >= F.col("below")) & (k < top)
    low, high = within(F.floor("h_")), within(F.ceil("h_"))
    pick = lambda c, v: F.max(F.when(c, v))
    at_least, pos_at_least = F.col("total") - F.col("below"), F.col("total_pos") - F.col("pos_below")
    cand = (probes.where(low | high).groupBy(*by, "j").agg(
        F.max("h_").alias("h"), F.max("total_pos").alias("events"),
        pick(low, F.col("score")).alias("v0"), pick(high, F.col("score")).alias("v1"),
        pick(low, at_least).alias("n0"), pick(high, at_least).alias("n1"),
        pick(low, pos_at_least).alias("p0"), pick(high, pos_at_least).alias("p1"))
        .withColumn("thr", F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("h") - F.floor("h"))))
    on_low = F.col("thr") <= F.col("v0")
    cand = cand.withColumns({"rows_": F.when(on_low, F.col("n0")).otherwise(F.col("n1")),
                             "hits_": F.when(on_low, F.col("p0")).otherwise(F.col("p1"))})
    csi = F.coalesce(F.try_divide(F.col("hits_"), F.col("events") + F.col("rows_") - F.col("hits_")), F.lit(0.0))
    cand = cand.withColumn("rank_", F.struct(csi.alias("csi"), (-F.col("thr")).alias("low_first")))
    best = cand.groupBy(*by).agg(F.max_by("thr", F.when(F.col("thr") > 0, F.col("rank_"))).alias("pos_"),
                                 F.max_by("thr", "rank_").alias("any_"))
    state = r.groupBy(*by).agg(F.count(F.lit(1)).alias("kinds_"), F.max("total_pos").alias("events_"))
    usable = (F.col("kinds_") >= 2) & (F.col("events_") > 0)
    return (state.join(best, by, "left")
            .select(*by, F.when(usable, F.coalesce("pos_", "any_")).otherwise(F.lit(0.5)).alias("threshold")))


def tuned_thresholds(val: DataFrame, p: EvalParams = EvalParams()) -> DataFrame:
    """Per model: threshold on the probability and one on the amount per intensity level.

    All of them are tuned in one pass: each row lists its scores, the kind joins the group.
    """
    kinds = [("thr_rain", F.col("p_rain"), F.col("y_true") > 0)]
    kinds += [(threshold_name(level), F.col("y_hat"), F.col("y_true") * 60 >= level) for level in p.intensity_mmh]
    item = lambda k: F.struct(F.lit(k[0]).alias("kind"), k[1].cast("double").alias("s"), k[2].alias("e"))
    long = val.select("model", F.explode(F.array(*[item(k) for k in kinds])).alias("x")).select("model", "x.*")
    tuned = tune_threshold(long, ["model", "kind"], F.col("s"), F.col("e"), p.n_grid)
    return tuned.groupBy("model").agg(*[F.max(F.when(F.col("kind") == k[0], F.col("threshold"))).alias(k[0]) for k in kinds])


def threshold_name(level: float) -> str:
    return f"thr_ge{level:g}".replace(".", "_")


# ----------------------------------------------------------------------------- combined tables
def conditional_scores(df: DataFrame, p: EvalParams = EvalParams()) -> DataFrame:
    """Onset (dry now), cessation (wet now, event inverted), intensity levels and the error when wet now.

    ``df`` carries the tuned thresholds; one aggregate serves all parts.
    """
    obs, fc, dry = F.col("y_true") > 0, F.col("p_rain") >= F.col("thr_rain"), F.col("rain_now") == 0
    yes = F.lit(1.0)
    aggs = table_counts(obs, fc, F.when(dry, yes), "_on") + table_counts(~obs, ~fc, F.when(~dry, yes), "_ce")
    names = {}
    for level in p.intensity_mmh:
        tag = threshold_name(level).removeprefix("thr")
        aggs += table_counts(F.col("y_true") * 60 >= level, F.col("y_hat") >= F.col(threshold_name(level)), None, tag)
        names[tag] = tag
    e = F.col("y_hat") - F.col("y_true")
    aggs.append(F.sqrt(F.avg(F.when(~dry, e * e))).alias("rmse_wet_now"))
    out = df.groupBy("model").agg(*aggs)
    cols = {}
    on, ce = score_columns("_on"), score_columns("_ce")
    cols.update({"onset_pod": on["pod"], "onset_far": on["far"], "onset_csi": on["csi"],
                 "cessation_pod": ce["pod"], "cessation_csi": ce["csi"]})
    for tag in names:
        s = score_columns(tag)
        cols.update({f"{k}{tag}": s[k] for k in ("csi", "pod", "far")})
    return out.select("model", *[c.alias(n) for n, c in cols.items()], "rmse_wet_now")


def scores_by_station_and_month(df: DataFrame, month: Column) -> DataFrame:
    """CSI, POD, FAR and RMSE per model for each station and for each month, in one scan."""
    obs, fc = F.col("y_true") > 0, F.col("p_rain") >= F.col("thr_rain")
    e = F.col("y_hat") - F.col("y_true")
    df = df.select("model", "station_id", month.cast("long").alias("month"), obs.alias("o_"), fc.alias("f_"), (e * e).alias("se_"))
    m, st, mo = F.col("model"), F.col("station_id"), F.col("month")
    counts = df.groupingSets([[m, st], [m, mo]], m, st, mo).agg(
        F.grouping("month").alias("by_station"), *table_counts(F.col("o_"), F.col("f_")), F.sqrt(F.avg("se_")).alias("rmse"))
    s = score_columns()
    return counts.select("model", "station_id", "month", (F.col("by_station") == 1).alias("by_station"), s["csi"].alias("csi"),
                         s["pod"].alias("pod"), s["far"].alias("far"), "rmse")


def station_score_summary(by_station: DataFrame) -> DataFrame:
    """Median and interquartile range over stations (one row per station and model)."""
    aggs = []
    for c in ("rmse", "csi", "pod", "far"):
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [q[1].alias(f"{c}_median"), (q[2] - q[0]).alias(f"{c}_iqr")]
    return by_station.where("by_station").groupBy("model").agg(*aggs)


def skill_vs_reference(scores: DataFrame, reference: str = "persistence") -> DataFrame:
    """1 - RMSE / RMSE of the reference (the first model by name when the reference is absent)."""
    ref = scores.agg(F.coalesce(F.max(F.when(F.col("model") == reference, F.col("rmse"))), F.min_by("rmse", "model")))
    return scores.withColumn("skill_rmse", 1 - ratio(F.col("rmse"), ref.scalar()))


def model_scores(df: DataFrame, p: EvalParams = EvalParams()) -> DataFrame:
    """The main table: all scores per model from one aggregate, plus the rank-based and conditional ones."""
    obs, fc = F.col("y_true") > 0, F.col("p_rain") >= F.col("thr_rain")
    main = df.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), *error_columns(F.col("y_true"), F.col("y_hat")), *table_counts(obs, fc),
        brier_column(F.col("p_rain"), obs).alias("brier"), pinball_column(F.col("q90"), F.col("y_true")).alias("pinball_q90"),
        F.max("thr_rain").alias("threshold_rain"))
    cats = {k + "_rain": v for k, v in score_columns().items()}
    main = (main.withColumns({**cats, "family": model_family(F.col("model"))}).drop("hits", "misses", "false_alarms", "correct_neg"))
    main = skill_vs_reference(main, p.reference)
    return main.join(average_precision(df, ["model"]), "model").join(conditional_scores(df, p), "model")


# ----------------------------------------------------------------------------- rankings
def leaderboard(scores: DataFrame) -> DataFrame:
    """Models by CSI, then skill, flagged as best overall and best deployable (a few dozen rows)."""
    ranked = scores.withColumn("deployable", deployable(F.col("model"))).withColumn(
        "key_", F.struct(F.coalesce("csi_rain", F.lit(-1.0)), F.coalesce("skill_rmse", F.lit(float("-inf"))), "model"))
    best = ranked.agg(F.struct(F.max_by("model", "key_").alias("overall"),
                               F.max_by("model", F.when(F.col("deployable"), F.col("key_"))).alias("deployable")))
    return (ranked.withColumn("best_", best.scalar()).orderBy(F.col("key_").desc())
            .select("model", "csi_rain", "skill_rmse", "deployable", (F.col("model") == F.col("best_.overall")).alias("best_overall"),
                    F.coalesce(F.col("model") == F.col("best_.deployable"), F.lit(False)).alias("best_deployable")))


def best_per_family(scores: DataFrame, reference: str = "persistence") -> DataFrame:
    """Reference, overall best and best of each listed family, each model once, in that order."""
    # Families analysed after the reference and the overall best.
    families = ("SAMBA (deep SSM)", "classical SSM", "gradient boosting", "deep SSM", "deep (non-SSM)")
    fam = model_family(F.col("model"))
    slot = F.array_position(F.array(*[F.lit(f) for f in families]), fam) + 1
    key = F.struct(F.coalesce(F.col("csi_rain"), F.lit(-1.0)), F.col("model"))
    picks = (scores.where(F.col("model") == reference).select("model", F.lit(0).cast("long").alias("slot"))
             .unionByName(scores.agg(F.max_by("model", key).alias("model")).select("model", F.lit(1).cast("long").alias("slot")))
             .unionByName(scores.where(slot > 1).groupBy(slot.alias("slot")).agg(F.max_by("model", key).alias("model")).select("model", "slot")))
    return picks.groupBy("model").agg(F.min("slot").alias("slot")).orderBy("slot")


def peak_station_day(df: DataFrame, value: str = "y_true") -> DataFrame:
    """The ordered series of the station-day with the largest total."""
    top = (df.groupBy("station_id", "day").agg(F.sum(value).alias("total_")).where("total_ > 0")
           .orderBy(F.desc("total_"), "station_id", "day").limit(1))
    return df.join(top, ["station_id", "day"], "left_semi").orderBy("minute")


def top_importances(importance: DataFrame, n: int = 12) -> DataFrame:
    return importance.where("regime = 'all'").orderBy(F.desc("importance"), "feature").limit(n).select("feature", "importance")


def report_tables(scores: DataFrame, pairs: DataFrame, thresholds: DataFrame, coverage: DataFrame, min_coverage: float = 0.9) -> dict[str, DataFrame]:
    """The tables of an evaluation report, ready for the sink."""
    return {"leaderboard": leaderboard(scores), "metrics": scores, "pairwise": pairs, "thresholds": thresholds,
            "excluded": coverage.where(F.col("coverage") < min_coverage)}
