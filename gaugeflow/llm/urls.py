"""URL filters: rules by host and path, and a tree of path templates with labelled purity for the rest.

The tree grows level by level over distinct (host, path) with their counts. On a level, the branches
of a node (host and template so far) are its next segments. A segment stays a literal branch when it
has at least ``least`` pages and its share of bad labels differs from its siblings' by more than chance
(two-proportion test), however large the host; numbers, dates, ids, rare segments and branches that do
not differ are merged into the wildcard ``*``. Segments below ``depth`` are one tail ``**``. A template is rejected when its share of
bad labels, smoothed towards the share over all pages, reaches ``reject``.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
``#`` or the end. A null url or one without ``://`` has neither and falls under no rule; its template
is the empty one.

Nulls: a null page id is kept and has no label. Null labels do not count. Repeated pages count as
often as they come; several labels of a page count as bad if one is. Empty tables give no rows, and
without labels no template is rejected. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import require, written


@dataclass(frozen=True)
class Rule:
    """``rule`` is host and path, like ``example.com/en/``; it fits the host and all its subdomains."""

    rule: str
    verdict: str


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    parts = require(pages, "page_id", "url").select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", "^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return parts.select("page_id", F.translate(host, upper, upper.lower()).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))


def longest_rule(rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. Rules are a list of the caller's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        host, slash, path = r.rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


#: Segments that number things: digits alone, dates, and hexadecimal ids of eight or more characters with a digit.
VARIABLE = r"^([0-9]+|[0-9]{1,4}[-_.][0-9]{1,2}([-_.][0-9]{1,4})?|(?=.*[0-9])[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"


def templates(paths: DataFrame, depth: int = 6, least: int = 20, z: float = 2.58) -> DataFrame:
    """host, path, template. paths: host, path, n, labelled, bad, one row for each host and path."""
    state = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    for level in range(depth):
        state = written(state, "url-tree")
        here = state.where(F.size("segments") > level).withColumn("segment", F.get("segments", F.lit(level)))
        branches = here.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        branches = written(branches, "url-branches")
        if not branches.head(1):
            break
        nodes = branches.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")])
        other, other_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.col("all_bad") / F.col("all_labelled")
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / other))
        differs = (F.col("labelled") > 0) & (other > 0) & (F.abs(F.col("bad") / F.col("labelled") - other_bad / other) > z * error)
        frequent = (F.col("n") >= least) & ~F.col("segment").rlike(VARIABLE)
        kept = branches.join(nodes, ["host", "template"]).where(frequent & differs).select("host", "template", "segment", F.lit(True).alias("literal"))
        named = state.withColumn("segment", F.get("segments", F.lit(level))).join(kept, ["host", "template", "segment"], "left")
        step = F.when(F.size("segments") <= level, "").when(F.col("literal"), F.concat(F.lit("/"), F.col("segment"))).otherwise("/*")
        state = named.withColumn("template", F.concat("template", step)).drop("segment", "literal")
    tail = F.when(F.size("segments") > depth, "/**").otherwise("")
    return state.select("host", "path", "n", "labelled", "bad", F.concat("template", tail).alias("template"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], reject: float = 0.5, smoothing: float = 10.0, **tree) -> DataFrame:
    """page_id, host, path, rule, template, p_bad (smoothed share of bad labels), verdict (allow or block).

    labels: page_id, bad (boolean).
    """
    split = written(split_url(pages), "urls")
    bad = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    marked = split.join(bad, "page_id", "left")
    paths = marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree_of = written(templates(paths, **tree), "url-templates")
    usual = tree_of.agg(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0))).first()[0] or 0.0
    purity = tree_of.groupBy("host", "template").agg(((F.sum("bad") + smoothing * usual) / (F.sum("labelled") + smoothing)).alias("p_bad"))
    verdicts = tree_of.select("host", "path", "template").join(purity, ["host", "template"])
    out = split.join(verdicts, ["host", "path"], "left").withColumn("fit", longest_rule(rules))
    method = F.when(F.col("p_bad") >= reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), "template", "p_bad", F.coalesce(F.col("fit.verdict"), method).alias("verdict"))
