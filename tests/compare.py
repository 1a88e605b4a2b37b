"""Runs a registered query and its SQL twin on the same tables and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    df = query(spark, sf_dir)
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL gives {len(want)}; e.g. {got[:2]} / {want[:2]}"
    if not got:
        return "no rows"
    for g, w in zip(got, want):
        if [kind(x) for x in g] != [kind(x) for x in w] or g != w:
            return f"{sorted(got_cols)}\n  spark {g}\n  sql   {w}"
    return None


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    from tilewright.session import RECOMMENDED_CONF
    b = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1]
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark, con = session(), duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or qs:
        t0 = time.time()
        try:
            if name in sqls:
                diff = compare(spark, con, name, qs[name], sqls[name], sf_dir)
                state = "ok" if diff is None else f"DIFF {diff}"
            else:
                state = f"rows only: {qs[name](spark, sf_dir).count()}"
        except Exception as e:
            state = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        bad += not (state == "ok" or state.startswith("rows"))
        print(f"{name:28s} {time.time() - t0:6.1f}s {state}", flush=True)
    print("failed", bad, flush=True)
