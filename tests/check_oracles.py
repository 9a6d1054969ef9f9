"""Run the registered queries beside their SQL on one folder of tables: python tests/check_oracles.py [sf] [names...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(partitions: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("evenhand-check")
             .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def differs(one: pd.DataFrame, two: pd.DataFrame) -> str | None:
    """Why two results differ, whatever the order of rows and columns; None if they do not."""
    if sorted(one.columns) != sorted(two.columns):
        return f"columns {sorted(one.columns)} / {sorted(two.columns)}"
    if len(one) != len(two):
        return f"rows {len(one)} / {len(two)}"
    columns = sorted(one.columns)
    rows = []
    for df in (one, two):
        values = [[None if pd.isna(v) else (v.item() if hasattr(v, "item") else v) for v in df[c].astype(object)]
                  for c in columns]
        rows.append(sorted(zip(*values), key=repr))
    for a, b in zip(*rows):
        if any(type(x) is not type(y) or x != y for x, y in zip(a, b)):
            return f"{dict(zip(columns, a))} / {dict(zip(columns, b))}"
    return None


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), database(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf)
            types = {f.name: f.dataType.simpleString() for f in got.schema.fields}
            got = got.toPandas()
            seconds = time.time() - start
            if name not in oracles:
                print(f"rows  {name} {len(got)} {seconds:.1f}s", flush=True)
                continue
            made = con.execute(oracles[name])
            why = differs(got, made.df())
            if why is None and len(got) == 0:
                why = "no rows"
            print("FAIL " if why else "ok   ", name, len(got), f"{seconds:.1f}s", why or "", flush=True)
            bad += bool(why)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print("ERROR", name, str(e)[:600], flush=True)
    print("bad:", bad)
