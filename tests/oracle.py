"""Runs queries beside their SQL in DuckDB: python tests/oracle.py SF NAME..."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canon(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def differences(spark, name: str, sf_dir: str) -> tuple[int, int, list, list]:
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((repr([canon(x) for x in r]) for r in df.select(*cols).collect()))
    rel = duck(sf_dir).execute(e.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols, (names, cols)
    at = [names.index(c) for c in cols]
    theirs = sorted(repr([canon(r[i]) for i in at]) for r in rel.fetchall())
    from collections import Counter

    a, b = Counter(mine), Counter(theirs)
    return len(mine), len(theirs), list((a - b).elements())[:5], list((b - a).elements())[:5]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as e

    names = sys.argv[2:] or list(e.oracle_sql())
    for n in names:
        t = time.time()
        try:
            if n in e.oracle_sql():
                x, y, a, b = differences(spark, n, f"/root/testdata/{sys.argv[1]}")
                print("OK  " if not a and not b and x == y else "DIFF", n, x, y, f"{time.time() - t:.1f}s", a, b, flush=True)
            else:
                print("rows", n, e.queries()[n](spark, f"/root/testdata/{sys.argv[1]}").count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print("FAIL", n, str(x)[:1500], flush=True)
