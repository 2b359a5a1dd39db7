"""Compare registered queries with their DuckDB SQL, as the driver does: columns by name, rows in any order."""

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, f, sql, sf):
    df = f(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        diff = [(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:2]
        return f"{len(got[1])} and {len(want[1])} rows; first differences {diff}"
    return f"" if got[1] else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    from tessera.plans import catalog

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    want = sys.argv[1:]
    for name, f in catalog.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            sql = catalog.oracle_sql().get(name)
            if sql:
                said = compare(spark, con, name, f, sql, sf)
            else:
                said = "" if f(spark, sf).count() else "no rows"
        except Exception as e:
            said = str(e).split("JVM stacktrace")[0][:700]
        print(f"{'ok  ' if not said else 'FAIL'} {name} {time.time() - t:.1f} {said}", flush=True)
