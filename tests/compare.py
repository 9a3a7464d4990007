"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAME_TYPE = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"}, "date": {"DATE"},
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


sql_seconds = 0.0


def _sort_key(row):
    return tuple((v is None, str(v)) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Problems of a Spark result against the SQL: columns, types, row count, values."""
    started = time.time()
    cursor = con.execute(sql)
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    duck_names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    global sql_seconds
    sql_seconds = time.time() - started
    spark_types = dict(df.dtypes)
    problems = []
    if sorted(spark_types) != sorted(duck_names):
        return [f"columns {sorted(spark_types)} != {sorted(duck_names)}"]
    for name, kind in spark_types.items():
        if duck_types[name].split("(")[0] not in SAME_TYPE.get(kind, set()):
            problems.append(f"type of {name}: {kind} / {duck_types[name]}")
    names = sorted(spark_types)
    actual = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_sort_key)
    order = [duck_names.index(n) for n in names]
    wanted = sorted((tuple(r[i] for i in order) for r in expected), key=_sort_key)
    if len(actual) != len(wanted):
        problems.append(f"rows {len(actual)} != {len(wanted)}")
    wrong = [(a, w) for a, w in zip(actual, wanted) if a != w]
    if wrong:
        close = all(
            x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9))
            for a, w in wrong for x, y in zip(a, w)
        )
        problems.append(f"{len(wrong)} rows differ{' (in the last digits only)' if close else ''}; first: {wrong[0]} in {names}")
    return problems


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    import workload

    spark, con = session(int(os.environ.get("BENCH_CPUS", "8"))), duck(sf_dir)
    names, bad = argv[1:] or list(workload.QUERIES), 0
    for name in names:
        q, started = workload.QUERIES[name], time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.sql:
                problems = differences(df, con, q.sql)
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started - sql_seconds:.1f}s sql {sql_seconds:.1f}s {'; '.join(problems)}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
