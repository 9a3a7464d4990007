"""Many reversible columns at once against one after the other."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import columns, restore, wide


def _wide(spark, n=200):
    rows = [(i, *(None if i % 11 == c else f"{c}-{(i * (c + 3)) % 17}" for c in range(6)), "hot") for i in range(n)] + [(None, *["x"] * 6, "hot")] * 2
    return spark.createDataFrame(rows, "id long, c0 string, c1 string, c2 string, c3 string, c4 string, `c.5` string, extra string")


NAMES = ["c0", "c1", "c2", "c3", "c4", "c.5"]
RULES = [{"id": c, "columnName": c, "reversible": True} if i % 3 else {"id": c, "columnName": c, "preserveUniqueness": True, "replaceWith": "w"} for i, c in enumerate(NAMES)]


@pytest.mark.parametrize("limit", [wide.BROADCAST_BYTES, 0])
def test_as_one_after_the_other(spark, monkeypatch, limit):
    monkeypatch.setattr(wide, "BROADCAST_BYTES", limit)
    df = _wide(spark)
    at_once = columns.mask_table(df, RULES, row_id="id", salt="s")
    each = df
    for rule in RULES:
        each = columns.mask_table(each, [rule], row_id="id", salt="s").table
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(at_once.table.collect(), key=key) == sorted(each.collect(), key=key)
    back = restore.restore_table(at_once.table, at_once.mapping, [c for c in NAMES if c not in ("c0", "c3")])
    assert sorted(back.select("id", "c1", "c2", "c4", "`c.5`", "extra").collect(), key=key) == sorted(df.select("id", "c1", "c2", "c4", "`c.5`", "extra").collect(), key=key)


def test_the_table_is_not_shuffled(spark):
    masked = columns.mask_table(_wide(spark), RULES, row_id="id", salt="s").table
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert plan.count("BroadcastExchange") == 6


def test_beyond_the_limit_it_is_shuffled_once(spark):
    df = _wide(spark)
    lookup = spark.createDataFrame([(c, f"{i}-{k}", f"v{k}") for i, c in enumerate(NAMES) for k in range(17)], "column_name string, key string, value string")
    found = wide.lookup_columns(df, lookup, NAMES, broadcast_bytes=0)
    assert found.columns[-6:] == [wide.found_name(i) for i in range(6)] and found.count() == df.count()
    assert found.where(F.col("c1").isNotNull() & (F.col("c1") != "x") & F.col("_found_1").isNull()).count() == 0


def test_tables_share_the_numbers(spark):
    one = spark.createDataFrame([(1, "b", "q"), (2, "a", "q")], "id long, k string, m string")
    two = spark.createDataFrame([(1, "c"), (2, "b")], "id long, k string")
    rules = [{"columnName": "k", "reversible": True}, {"columnName": "m", "reversible": True}, {"columnName": "none", "reversible": True}]
    out = columns.mask_tables({"t1": one, "t2": two}, rules, row_id="id")
    assert [tuple(r) for r in out.tables["t1"].orderBy("id").collect()] == [(1, "[K-001]", "[M-001]"), (2, "[K-002]", "[M-001]")]
    assert [r["k"] for r in out.tables["t2"].orderBy("id").collect()] == ["[K-003]", "[K-001]"]
    assert out.mapping.count() == 4
