"""Run queries against their SQL oracles: python tests/check_oracles.py SF_DIR [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus: int = 8):
    import tempfile

    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("geoaffinity")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="geoaffinity-tests-"))
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v

    return [columns[i] for i in order], sorted(
        (tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = canonical([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0]}"
    types = {c: {type(v) for v in col if v is not None}
             for c, col in zip(got[0], zip(*got[1]))}
    other = {c: {type(v) for v in col if v is not None}
             for c, col in zip(want[0], zip(*want[1]))}
    return None if types == other else f"types {types} != {other}"


def main():
    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    oracles, failed = oracle_sql(), []
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        label = "ok" if problem is None else f"FAIL {problem}"
        print(f"{name:28s} {time.time() - start:6.1f}s {'S' if name in oracles else 'R'} {label}", flush=True)
        failed += [name] if problem else []
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
