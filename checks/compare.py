"""Run check queries on Spark and their SQL on DuckDB and compare all rows.

    python -m checks.compare 0.01 [name-part ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from gaugeflow.session import get_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False, name=None):
        out.append(tuple(None if v is None or v is pd.NA or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v
                         if isinstance(v, (str, bool)) else (int(v) if hasattr(v, "__int__") else str(v)) for v in row))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, int):
        return abs(a - b) <= 2e-5 * max(1.0, abs(a))
    return a == b


def compare(spark, con, sf_dir, name, run, sql):
    start = time.time()
    got = run(spark, sf_dir)
    schema = {f.name: f.dataType.simpleString() for f in got.schema}
    got = got.toPandas()
    took = time.time() - start
    if sql is None:
        return f"rows={len(got)} (rows only)", took, True
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", took, False
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", took, False
    for g, w in zip(rows_of(got), rows_of(want)):
        if not all(close(a, b) for a, b in zip(g, w)):
            return f"value {dict(zip(sorted(got.columns), g))} != {w}", took, False
    kinds = {c: str(t) for c, t in want.dtypes.items()}
    odd = [c for c, t in schema.items() if ("int" in t) != ("int" in kinds[c].lower()) and len(want) and not want[c].isna().any()]
    return f"rows={len(got)} ok" + (f" TYPE {[(c, schema[c], kinds[c]) for c in odd]}" if odd else ""), took, True


def main():
    import importlib

    entry = importlib.import_module("__spark_entry__")
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    parts = sys.argv[2:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            text, took, ok = compare(spark, con, sf_dir, name, run, oracles.get(name))
        except Exception as err:  # report and go on with the next query
            text, took, ok = f"ERROR {type(err).__name__}: {str(err)[:600]}", 0.0, False
        print(f"{'OK  ' if ok else 'FAIL'} {name:34s} {took:6.2f}s {text}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
