"""Runs registered queries beside their SQL: python tests/compare.py SF_DIR [KEY...]."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, floats rounded, rows sorted."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(5) + 0.0
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: x if x is None else str(x))
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """What differs, or nothing."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} and {len(sql_rows)} rows"
    kinds = {c: (spark_rows[c].dtype.kind, sql_rows[c].dtype.kind) for c in spark_rows.columns}
    if odd := {c: k for c, k in kinds.items() if k[0] != k[1]}:
        return f"kinds {odd}"
    a, b = canonical(spark_rows), canonical(sql_rows)
    for c in a.columns:
        x, y = a[c], b[c]
        if str(x.dtype).startswith("float"):  # whole numbers must be equal
            bad = ~(((x.astype(float) - y.astype(float)).abs() <= 2e-5 * (1 + x.astype(float).abs())) | (x.isna() & y.isna()))
        else:
            bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            return f"{c}: {int(bad.sum())} values, as {x[bad].iloc[0]!r} and {y[bad].iloc[0]!r}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master(os.environ.get("COMPARE_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = oracle(sys.argv[1]), entry.oracle_sql()
    for key, query in entry.queries().items():
        if sys.argv[2:] and key not in sys.argv[2:] or not sys.argv[2:] and key not in sql:
            continue
        began, rows = time.time(), ()
        try:
            rows = query(spark, sys.argv[1]).toPandas()
            said = difference(rows, con.execute(sql[key]).df()) if key in sql else "no SQL"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{key}: {said or 'equal'} ({len(rows)} rows, {time.time() - began:.1f} s)", flush=True)
