"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule votes good, bad or abstains. Votes are folded to counts of vote patterns (at most
3**rules rows, whatever the corpus), and expectation-maximisation over the patterns estimates how
often each rule votes good, bad or not at all among good documents and among each kind of bad ones
(a kind per rule, since documents are bad in different ways), and so the rules' accuracies. The
posterior probability of good decides. Everything is DataFrame expressions; the driver holds only the estimates between
rounds.

Words are runs of characters other than \\x20 and \\x09-\\x0D. A null text has none. Documents failing the
base rule (too few words, too many words in repeated 5-word windows) are never kept, but vote.
Repeated rows vote once each; an empty table gives no rows; other columns are ignored by
``features`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import leave_out, require, written

SPACE = r"\x09-\x0D\x20"


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions on the features, valid in Spark and DuckDB alike; neither: abstain."""

    name: str
    bad: str
    good: str = "false"


RULES = (
    Rule("symbols", "n_symbols * 10 > n_words"),
    Rule("repeats", "n_repeat_words * 5 > n_words"),
    Rule("lines", "n_dup_lines * 10 > n_lines * 3"),
    Rule("capitals", "n_upper * 10 > word_chars * 3"),
    Rule("shouting", "n_bangs * 10 > n_words"),
    Rule("length", "word_chars * 2 < n_words * 5 OR word_chars > n_words * 12", "word_chars >= n_words * 3 AND word_chars <= n_words * 9"),
    Rule("variety", "n_words >= 50 AND n_distinct * 6 < n_words", "n_distinct * 5 > n_words * 2"),
    Rule("sentences", "n_words >= 30 AND n_stops = 0", "n_stops * 50 > n_words AND n_stops * 3 < n_words"),
)
ROUNDS = 20
#: Start, as shares of bad and of good votes: in good documents, in bad documents of another kind, in bad documents of the
#: rule's own kind; and the share of good documents. The start counts as WEIGHT documents; a share stays within EDGE of 0 and 1. No
#: rule is taken to vote bad on more than FALSE of the good documents: without that bound, one large kind of bad documents can pass as good ones.
IN_GOOD, IN_BAD, IN_OWN, PRIOR, WEIGHT, EDGE, FALSE = (0.001, 0.9), (0.2, 0.6), (0.9, 0.05), 0.85, 10.0, 0.0005, 0.005


def features(documents: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use, over whole texts."""
    d = require(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("trimmed", F.expr(r"trim(BOTH ' \t\n\u000b\f\r' FROM text)"))
    d = d.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", f"[{SPACE}]+")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    count = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]+", "")).cast("long")
    d = d.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), count(r"#*$%&|<>").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), count(r"\p{Lu}").alias("n_upper"),
        count("!").alias("n_bangs"), count(".,").alias("n_stops"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)]))
    d = d.withColumn("grams", F.when(F.size("words") >= 6, grams).otherwise(F.array().cast("array<bigint>")))
    return d.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), _covered("grams")).otherwise(F.lit(0)).cast("long")).drop("words", "grams")


def _covered(grams: str) -> Column:
    """Words inside windows found twice or more: windows sorted by hash, equal neighbours, their places in order, gaps of five at most.

    An aggregate over one element names a value that is used several times.
    """
    return F.expr(f"""
        aggregate(array(sort_array(transform({grams}, (h, i) -> struct(h AS h, i AS i)))), 0, (n, s) ->
          aggregate(array(sort_array(transform(filter(s, (x, k) -> (k > 0 AND get(s, k - 1).h = x.h) OR get(s, k + 1).h = x.h), x -> x.i))), 0, (m, p) ->
            aggregate(transform(p, (x, k) -> IF(k = 0, 5, least(5, x - get(p, k - 1)))), 0, (a, x) -> a + x)))""")


def votes(d: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The features with ``votes``: per rule 0 bad, 1 good, 2 abstains."""
    return d.withColumn("votes", F.array(*[F.expr(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 ELSE 2 END") for r in rules]))


#: For each class of documents (good first, then one bad kind per rule) its share and, per rule, the shares of bad and good votes.
Model = list[tuple[float, list[tuple[float, float]]]]


def start(rules: tuple[Rule, ...] = RULES) -> Model:
    def of(r: Rule, shares: tuple[float, float]) -> tuple[float, float]:
        return shares[0], 0.0 if r.good == "false" else shares[1]

    bad = [((1 - PRIOR) / len(rules), [of(r, IN_OWN if r is own else IN_BAD) for r in rules]) for own in rules]
    return [(PRIOR, [of(r, IN_GOOD) for r in rules]), *bad]


def class_weights(model: Model) -> Column:
    """Joint probability of ``votes`` and each class, an array in the order of the classes; a factor per rule in the rules' order.

    ``votes`` holds per rule 0 for bad, 1 for good, 2 for none.
    """
    value = lambda x: min(1 - EDGE, max(EDGE, x))
    table = F.array(*[F.struct(F.lit(share).alias("share"), F.array(*[F.array(*map(F.lit, (value(b), value(g), value(1 - b - g)))) for b, g in of]).alias("q")) for share, of in model])
    return F.transform(table, lambda c: F.aggregate(F.zip_with(c["q"], F.col("votes"), lambda q, v: F.get(q, v)), c["share"], lambda a, x: a * x))


def posterior(model: Model) -> Column:
    """Probability of good given the votes."""
    return F.aggregate(F.array(class_weights(model)), F.lit(0.0), lambda _, w: F.get(w, F.lit(0)) / F.aggregate(w, F.lit(0.0), lambda a, x: a + x))


def estimate(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the patterns of votes."""
    patterns = written(voted.groupBy("votes").count(), "vote-patterns").coalesce(1)
    first = start(rules)
    model = first
    for _ in range(rounds):
        weighted = patterns.select("votes", "count", class_weights(model).alias("w"))
        shared = weighted.select("votes", F.posexplode(F.transform("w", lambda x: x * F.col("count") / F.aggregate("w", F.lit(0.0), lambda a, y: a + y))).alias("k", "p"))
        sums = shared.select("k", "p", F.posexplode("votes").alias("j", "v")).groupBy("k", "j", "v").agg(F.sum("p").alias("p"))
        s = {(r.k, r.j, r.v): r.p for r in sums.collect()}  # classes x rules x 3 rows
        if not s:
            break
        held = [sum(s.get((k, 0, v), 0.0) for v in (0, 1, 2)) for k in range(len(model))]
        share = lambda k, j, v, s=s, held=held: min(FALSE if (k, v) == (0, 0) else 1.0, (s.get((k, j, v), 0.0) + WEIGHT * first[k][1][j][v]) / (held[k] + WEIGHT))
        model = [(held[k] / sum(held), [(share(k, j, 0), share(k, j, 1)) for j in range(len(rules))]) for k in range(len(model))]
    return model


def accuracies(model: Model, rules: tuple[Rule, ...] = RULES) -> dict[str, tuple[float, float]]:
    """Per rule: probability that a document it votes bad on is bad, and that one it votes good on is good."""
    out = {}
    for j, r in enumerate(rules):
        bad, good = [sum(share * of[j][v] for share, of in model) for v in (0, 1)]
        right = model[0][0] * model[0][1][j][1]
        out[r.name] = ((bad - model[0][0] * model[0][1][j][0]) / bad if bad else 1.0, right / good if good else 1.0)
    return out


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 10, most_repeated: int = 20, threshold: float = 0.5) -> DataFrame:
    """Features and votes of every document with base_failed, p_good and kept."""
    voted = written(votes(features(documents), rules), "quality")
    model = estimate(voted, rules)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("p_good", posterior(model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(documents: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. Rows of one id are kept or dropped together."""
    rejected = judge(documents, **options).groupBy("doc_id").agg(F.min("kept").alias("kept")).where("NOT kept")
    return leave_out(documents, written(rejected.select("doc_id"), "rejected"))
