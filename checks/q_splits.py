"""Checks: parts, samples, targets and sets of days."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.operators import splits
from gaugeflow.params import SampleParams

from .proxies import CLOCK, SLICES
from .registry import query

SAMPLE = SampleParams(dry_keep_frac=0.3, context=4)


def sql_hash(*parts: str) -> str:
    text = "||'|'||".join(parts)
    return f"CAST('0x'||substr(md5({text}),1,8) AS BIGINT)/4294967296.0"


@query("split_parts", "SELECT * FROM parts")
def split_parts(p):
    return p.parts


@query("part_history_join", "SELECT * FROM part_rows", dbl="rain_rt rain_signal nb_max target", long="target_valid")
def part_history_join(p):
    return p.part_rows


@query("valid_part_filter", """
SELECT p.* FROM parts p WHERE (SELECT count(*) FROM targets t WHERE t.station_id=p.station_id AND t.minute>=p.start AND t.minute<p."end" AND target_valid>0)>=60""")
def valid_part_filter(p):
    return splits.valid_part_filter(p.parts, p.targets, 60, SLICES.chunk)


@query("eval_rows", "SELECT station_id, minute, target AS y_true, rain_rt AS rain_now, 19723+minute//24 AS day FROM part_rows WHERE in_period AND target_valid>0",
       dbl="y_true rain_now")
def eval_rows(p):
    return splits.evaluation_index(p.part_rows, CLOCK)


@query("sample_weights", f"""
SELECT station_id, minute, part, CASE WHEN NOT (in_period AND target_valid>0) THEN 0 WHEN near OR coalesce(target>0,false) THEN 1
  WHEN {sql_hash('station_id', 'minute', "'42'")}<0.3 THEN 1/0.3 ELSE 0 END AS w
FROM (SELECT *, max(rain_signal>0 OR nb_max>0) OVER (PARTITION BY station_id, part ORDER BY minute ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near FROM part_rows)""",
       dbl="w")
def sample_weights(p):
    s = type(SLICES)(SLICES.chunk, ("station_id", "part"))
    return splits.sample_weights(p.part_rows, SAMPLE, s).select("station_id", "minute", "part", "w")


@query("day_hash_sample", "SELECT station_id, minute FROM targets WHERE ((19723+minute//24)*2654435761)%1000<300")
def day_hash_sample(p):
    return splits.day_hash_sample(p.targets, 0.3, CLOCK).select("station_id", "minute")


@query("uniform_row_cap", f"""
SELECT station_id, minute FROM targets WHERE {sql_hash('station_id', 'minute', "'42'")}*(SELECT count(*) FROM targets)<1000""")
def uniform_row_cap(p):
    return splits.uniform_row_cap(p.targets, 1000).select("station_id", "minute")


@query("val_fit_select_split", """
SELECT station_id, minute, day, coalesce(day <= (SELECT list(DISTINCT day ORDER BY day)[len(list(DISTINCT day))//2] FROM idx WHERE split='val'),false) AS fits
FROM idx WHERE split='val'""")
def val_fit_select_split(p):
    return splits.val_fit_select_split(p.index.where("split = 'val'")).select("station_id", "minute", "day", F.col("fits"))
