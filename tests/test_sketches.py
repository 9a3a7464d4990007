"""Mergeable sketches against exact answers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cloakframe.operators import detect, sketches

EVENT = "ts timestamp, file_type string, size_bytes long, duration_seconds double, success boolean"


def _events(spark, n, seed=1):
    r = random.Random(seed)
    rows = [
        (dt.datetime(2024, 1, 1 + r.randrange(5), r.randrange(24)), r.choice(["txt", "txt", "txt", None, "xlsx"]), r.choice([0, 10**6, 2 * 10**6, 10**8, None]),
         r.choice([None, 1.0, r.lognormvariate(0, 2), r.lognormvariate(0, 2)]), r.choice([True, True, True, False, None]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, EVENT), rows


def test_merged_parts_are_within_their_bound(spark):
    events, rows = _events(spark, 6000)
    parts = [sketches.job_sketches(events.where(F.hash("duration_seconds") % 3 == i)) for i in (-2, -1, 0, 1, 2)]
    stored = parts[0]
    for part in parts[1:]:
        stored = stored.unionByName(part)
    got = sketches.sketched_durations(stored, "file_type", shares={"p01": 0.01, "p50": 0.5, "p99": 0.99}).collect()
    assert {r["file_type"] for r in got} == {"txt", "xlsx", None}
    for r in got:
        mine = sorted(x[3] for x in rows if x[1] == r["file_type"] and x[4] and x[3] is not None)
        assert r["n_jobs"] == len(mine) and r["min_duration"] == mine[0] and r["max_duration"] == mine[-1]
        assert r["n_events"] == sum(x[1] == r["file_type"] for x in rows) and r["n_failed"] == sum(x[1] == r["file_type"] and not x[4] for x in rows)
        for name, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99)):
            below, upto = sum(x < r[name] for x in mine) / len(mine), sum(x <= r[name] for x in mine) / len(mine)
            assert below - sketches.RANK_ERROR <= q <= upto + sketches.RANK_ERROR
    ranks = sketches.sketched_ranks(stored, F.lit(1.0), "file_type").collect()
    for r in ranks:
        mine = [x[3] for x in rows if x[1] == r["file_type"] and x[4] and x[3] is not None]
        assert abs(r["share"] - sum(x <= 1.0 for x in mine) / len(mine)) <= sketches.RANK_ERROR


def test_no_successful_job_and_no_event(spark):
    events, _ = _events(spark, 50)
    (none,) = sketches.sketched_durations(sketches.job_sketches(events.withColumn("success", F.lit(False))).withColumn("all", F.lit(1)), "all").collect()
    assert none["n_jobs"] == 0 and none["p50"] is None and none["n_failed"] == 50
    assert sketches.sketched_durations(sketches.job_sketches(events.limit(0)), "file_type").count() == 0


def test_distinct_values(spark):
    values = spark.range(60_000).select((F.col("id") % 20_000).cast("string").alias("original"), (F.col("id") % 7).alias("day"))
    values = values.unionByName(spark.range(500).select(F.lit("hot").alias("original"), F.lit(1).cast("long").alias("day"))).unionByName(
        spark.range(9).select(F.lit(None).cast("string").alias("original"), F.lit(2).cast("long").alias("day"))
    )
    parts = sketches.value_sketches(values, "day")
    (got,) = sketches.approximate_distinct(parts).collect()
    assert got["n_matches"] == 60_500 and abs(got["n_values"] - 20_001) <= 0.02 * 20_001


def test_rollup_is_one_aggregate(spark):
    found = spark.createDataFrame([("a", "p", 0.95), ("a", "p", 0.5), ("a", "q", 0.9), ("b", "q", 0.3), (None, "q", 1.0)], "doc_id string, pattern string, confidence double")
    out = detect.summary_rollup(found)
    got = {(r["level"], r["doc_id"], r["pattern"]): (r["total_matches"], r["avg_confidence"], r["high_confidence"]) for r in out.collect()}
    assert got["all", None, None] == (5, 0.73, 3) and got["pattern", None, "q"] == (3, 0.73, 2) and got["document", "a", None] == (3, 0.78, 2)
    assert got["document_pattern", None, "q"] == (1, 1.0, 1) and got["document", None, None] == (1, 1.0, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Expand [") == 1
