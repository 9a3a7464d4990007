"""The filter of known keys, and texts that it keeps out of the join."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import restore
from cloakframe.operators.known import key_filter


def test_it_denies_no_key_that_is_there(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") % 3).cast("string").alias("s"))
    known = key_filter(keys, ["s", "k"])
    assert known.size == 1 << 19
    assert keys.where(~known.might_hold(F.col("s"), F.col("k"))).count() == 0
    other = keys.select(F.concat(F.lit("x"), "k").alias("k"), "s")
    assert other.where(known.might_hold(F.col("s"), F.col("k"))).count() < 0.03 * 20_000
    assert keys.where(known.might_hold(F.lit(None).cast("string"), F.col("k"))).count() == 0


def test_none_beyond_its_largest_size_and_for_no_keys(spark):
    assert key_filter(spark.range(10_000).select(F.col("id").alias("k")), ["k"], filter_bytes=4096) is None
    none = key_filter(spark.createDataFrame([], "k string"), ["k"])
    assert spark.range(5).where(none.might_hold(F.col("id").cast("string"))).count() == 0
    some = key_filter(spark.createDataFrame([(None,), ("a",)], "k string"), ["k"])
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "v string")
    assert [r["v"] for r in df.where(some.might_hold(F.col("v"))).collect()] == ["a"]


@pytest.mark.parametrize("scope_col", [None, "s"])
def test_same_result_with_and_without(spark, scope_col):
    rows = [(i, "s%d" % (i % 2), f"bel [TEL-{i:03d}] of [TEL-{i + 1:03d}] weg") for i in range(300)] + [(1, "s0", None), (None, None, "[TEL-005]"), (7, "s1", "niets"), (9, "s0", " ".join(f"[TEL-{i:03d}]" for i in range(90, 20, -1)))]
    docs = spark.createDataFrame(rows, "id long, s string, redacted string")
    mapping = spark.createDataFrame([("s%d" % (i % 2), "phone", f"[TEL-{i:03d}]", f"06-{i:08d}") for i in range(0, 60, 2)], "scope_id string, kind string, placeholder string, original string")
    key = lambda r: str(tuple(r))
    with_it = restore.restore_corpus(docs, mapping, "id", scope_col=scope_col, skip_unknown=True)
    assert sorted(with_it.collect(), key=key) == sorted(restore.restore_corpus(docs, mapping, "id", scope_col=scope_col).collect(), key=key)


def test_unknown_tokens_cost_no_exchange(spark):
    docs = spark.range(2000).select("id", F.concat(F.lit("bel [TEL-"), F.lpad("id", 5, "0"), F.lit("]")).alias("redacted"))
    mapping = spark.range(100).select(F.lit("corpus").alias("scope_id"), F.concat(F.lit("[TEL-"), F.lpad("id", 5, "0"), F.lit("]")).alias("placeholder"), F.lit("x").alias("original"))
    out = restore.restore_corpus(docs, mapping, "id", skip_unknown=True)
    assert out.where("restored <> redacted").count() == 100
    known = key_filter(mapping, ["placeholder"])
    token = F.regexp_extract("redacted", r"\[[^\[\]]+\]", 0)
    assert docs.where(known.might_hold(token)).count() < 100 + 0.05 * 1900
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "Subquery" in plan
