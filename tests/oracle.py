"""Run registered queries against their SQL in DuckDB and compare every value.

``python tests/oracle.py SF_DIR [name part ...]`` prints one line per query.
"""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def spark_session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("voltlattice-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _kinds(table):
    def kind(t):
        text = str(t)
        return "timestamp" if text.startswith("timestamp") else text.replace("large_", "")
    return {f.name: kind(f.type) for f in table.schema}


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*columns))


def compare(spark, con, fn, sql, sf_dir):
    """('ok' or a description of the first difference, number of rows)."""
    ours = fn(spark, sf_dir).toArrow()
    theirs = con.sql(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} != {sorted(theirs.column_names)}", ours.num_rows
    a, b = _kinds(ours), _kinds(theirs)
    if a != b:
        return f"types differ: { {n: (a[n], b[n]) for n in a if a[n] != b[n]} }", ours.num_rows
    x, y = _rows(ours), _rows(theirs)
    if x != y:
        first = next(((i, j) for i, j in zip(x, y) if i != j), (x[-1:], y[-1:]))
        wrong = sum(1 for i, j in zip(x, y) if i != j)
        return f"{len(x)} rows vs {len(y)}, {wrong} differ, e.g. {first}", ours.num_rows
    return "ok", ours.num_rows


def main(sf_dir, parts):
    import __spark_entry__ as entry

    spark, con = spark_session(), connection(sf_dir)
    sql = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                verdict, rows = compare(spark, con, fn, sql[name], sf_dir)
            else:
                verdict, rows = "rows only", fn(spark, sf_dir).toArrow().num_rows
        except Exception as error:
            verdict, rows = f"ERROR {type(error).__name__}: {str(error)[:1500]}", -1
        if verdict not in ("ok", "rows only"):
            bad.append(name)
        print(f"{name:38s} {time.time() - start:6.1f}s {rows:8d} {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
