from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import columns, numbering, restore

ROWS = [(1, "Jan", 10.0, datetime(2024, 1, 1)), (2, "Piet", 20.5, datetime(2024, 2, 1)), (3, "Jan", 10.0, None), (4, None, None, datetime(2024, 3, 1)), (5, "Eva", 7.25, datetime(2024, 1, 1))]
SCHEMA = "id long, naam string, prijs double, datum timestamp_ntz"


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _column(table, name):
    return [r[name] for r in table.orderBy("id").collect()]


def _mask(df, *rules, **options):
    return columns.mask_table(df, list(rules), row_id="id", salt="zout", **options)


def test_constant_leaves_nulls(df):
    assert _column(_mask(df, {"columnName": "naam"}).table, "naam") == ["[ANONIEM]"] * 3 + [None, "[ANONIEM]"]


def test_unique_by_first_appearance(df):
    rule = {"columnName": "naam", "replaceWith": "Klant", "preserveUniqueness": True}
    assert _column(_mask(df, rule).table, "naam") == ["Klant1", "Klant2", "Klant1", None, "Klant3"]


@pytest.mark.parametrize("kind", ["replace", "jabber"])
def test_reversible(df, kind):
    rule = {"columnName": "naam", "columnSubtype": "naam van de klant", "anonymizationType": kind, "reversible": True}
    masked = _mask(df, rule)
    assert _column(masked.table, "naam") == ["[NAAM_VAN_DE_KLA-001]", "[NAAM_VAN_DE_KLA-002]", "[NAAM_VAN_DE_KLA-001]", None, "[NAAM_VAN_DE_KLA-003]"]
    back = restore.restore_table(masked.table, masked.mapping, ["naam"])
    assert _column(back, "naam") == [r[1] for r in ROWS]


def test_keyed_jabber_is_repeatable(df):
    rule = {"columnName": "naam", "anonymizationType": "jabber", "preserveUniqueness": True}
    first = _column(_mask(df, rule).table, "naam")
    assert first == _column(_mask(df, rule).table, "naam")
    assert first[0] == first[2] and first[3] is None and len(set(first)) == 4
    assert all(len(v) == 8 and v.isalnum() for v in first if v)


def test_date_offset_and_mapping(df):
    rule = {"columnName": "datum", "columnType": "date", "anonymizationType": "date_offset", "dateOffsetDays": -31}
    masked = _mask(df, rule, reversible_mode=True)
    assert _column(masked.table, "datum")[:3] == [datetime(2023, 12, 1), datetime(2024, 1, 1), None]
    assert ("datum", "2024-01-01 00:00:00", "2023-12-01 00:00:00") in {tuple(r) for r in masked.mapping.collect()}


def _price(strategy, **more):
    return {"columnName": "prijs", "columnType": "number", "anonymizationType": "number_multiply", "priceStrategy": strategy, **more}


def test_multiply(df):
    assert _column(_mask(df, _price("fixed_multiplier", numberMultiplier=1.5)).table, "prijs") == [15.0, 30.75, 15.0, None, 10.88]
    for rule, low, high in [(_price("random_per_price"), 0.15, 0.65), (_price("random_range", randomRangePercent=10), 0.9, 1.1)]:
        new = _column(_mask(df, rule).table, "prijs")
        assert new[0] == new[2] and new[3] is None
        assert all(round(low * o, 2) <= n <= round(high * o, 2) for o, n in zip([r[2] for r in ROWS], new) if o)


@pytest.mark.parametrize("row_id", ["id", None])
def test_shuffle_keeps_the_multiset(spark, row_id):
    rows = [(i, i % 7 if i % 5 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v int")
    out = columns.mask_table(df, [{"columnName": "v", "anonymizationType": "shuffle"}], row_id=row_id, salt="s").table
    after = [r["v"] for r in out.orderBy("id").collect()]
    assert sorted(map(str, after)) == sorted(str(v) for _, v in rows)
    assert sum(a == v for a, (_, v) in zip(after, rows)) < 700


def test_formula_escape(spark):
    cells = ["=1+1", "+1", "-1", "@x", "tekst", " =1", "", None, "'=1"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id long, c string")
    once = columns.escape_all_formulas(df)
    assert _column(once, "c") == ["'=1+1", "'+1", "'-1", "'@x", "tekst", " =1", "", None, "'=1"]
    assert _column(columns.escape_all_formulas(once), "c") == _column(once, "c")


@pytest.mark.parametrize(
    ("cells", "kind"),
    [(["1", "2.5", "3"], "number"), (["1", "2", "3", "x", "5"], "number"), (["1", "x"], "text"), (["2024-01-01", "2024-02-01"], "date"),
     ([None, "", " "], "text"), ([None, "1", "2"], "number"), (["x"] * 20 + ["1"] * 80, "text")],
)
def test_column_type_from_strings(spark, cells, kind):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id long, c string")
    assert columns.column_types(df, "id")["c"] == kind


def test_refused_rules_are_reported(df):
    masked = _mask(
        df,
        {"id": "1", "columnName": "naam", "columnType": "number", "anonymizationType": "number_multiply"},
        {"id": "2", "columnName": "prijs", "columnType": "date", "anonymizationType": "date_offset"},
        {"id": "3", "columnName": "datum", "anonymizationType": "date_offset"},
        {"id": "4", "columnName": "onbekend"},
    )
    assert [r["ruleId"] for r in masked.rejected] == ["1", "2", "3"]
    assert _column(masked.table, "naam") == [r[1] for r in ROWS]


def test_order_and_cell_log(df):
    masked = _mask(df, {"id": "a", "columnName": "naam", "replaceWith": "=x"}, {"id": "b", "columnName": "naam", "replaceWith": "y"}, keep_log=True)
    assert _column(masked.table, "naam")[0] == "y"
    log = {(r["ruleId"], r["originalTermDisplay"], r["replacedWith"]) for r in masked.log.collect()}
    assert log == {("a", "Jan", "'=x"), ("a", "Piet", "'=x"), ("a", "Eva", "'=x"), ("b", "'=x", "y")}
    assert masked.log.count() == 8


def test_tables_share_numbers(spark):
    one = spark.createDataFrame([(1, "b"), (2, "a")], "id long, k string")
    two = spark.createDataFrame([(1, "c"), (2, "b")], "id long, k string")
    out = columns.mask_tables({"t1": one, "t2": two}, [{"columnName": "k", "reversible": True}], row_id="id").tables
    assert _column(out["t1"], "k") == ["[K-001]", "[K-002]"]
    assert _column(out["t2"], "k") == ["[K-003]", "[K-001]"]


def test_ambiguous_values_are_reported_not_guessed(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 5.0)], "id long, p double")
    rule = {"columnName": "p", "columnType": "number", "anonymizationType": "number_multiply", "numberMultiplier": 0.1}
    masked = columns.mask_table(df, [rule], reversible_mode=True)
    assert [r["masked"] for r in restore.ambiguous(masked.mapping).collect()] == ["0.0"]
    back = restore.restore_table(masked.table, masked.mapping, ["p"], types={"p": "double"})
    assert _column(back, "p") == [0.0, 0.0, 5.0]


def test_preview_and_profile(spark):
    df = spark.createDataFrame([(i, f"a{i}@b.nl", "06 1234 5678", "x") for i in range(9)], "id long, m string, t string, ` ` string")
    row = columns.table_preview(df, row_id="id").first()
    assert row["rows"] == 9 and row["columns"][3] == "Column 4" and len(row["preview"]) == 5
    kinds = {r["column_name"]: r["detected_type"] for r in columns.column_pii_profile(df, ["m", "t"]).collect()}
    assert kinds == {"m": "emails", "t": "telefoonnummers"}


# --- numbering at scale, on small data ---------------------------------------


def test_numbers_are_consecutive_over_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).cast("string").alias("g")).repartition(7)
    assert numbering.number_rows(df, ["v"]).where("n <> v + 1").count() == 0
    grouped = numbering.number_rows(df, ["g", "v"], restart_by="g")
    wanted = df.selectExpr("g", "v", "row_number() over (partition by g order by v) as n")
    assert grouped.exceptAll(wanted.select("v", "g", "n").select("v", "g", "n")).count() == 0


def test_running_total(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("v"), (F.col("id") % 11).alias("w"), (F.col("id") % 2).alias("g")).repartition(5)
    out = numbering.running_total(df, ["g", "v"], "w", restart_by="g")
    wanted = df.selectExpr("v", "w", "g", "sum(w) over (partition by g order by v) as running")
    assert out.exceptAll(wanted).count() == 0 and out.count() == 3000


def test_hash_rank_is_a_permutation_whatever_the_buckets(spark):
    df = spark.range(0, 1000)
    a = numbering.hash_rank(df, F.sha2(F.col("id").cast("string"), 256), buckets=3)
    b = numbering.hash_rank(df, F.sha2(F.col("id").cast("string"), 256), buckets=64)
    assert a.exceptAll(b).count() == 0
    assert a.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (1, 1000, 1000)


@pytest.mark.parametrize("weight", ["n", None])
def test_lookup_join_with_a_key_that_holds_a_third(spark, weight):
    hot = "heet"
    rows = spark.range(0, 30000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, hot).when(F.col("id") % 500 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 4000).cast("string"))).alias("k")
    )
    lookup = rows.where("k is not null and k <> 'k7'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v"))
    wanted = rows.join(lookup.select("k", "v"), "k", "left").select("id", "k", "v")
    wide = numbering.lookup_join(rows, lookup if weight else lookup.drop("n"), ["k"], ["v"], weight=weight, row_id="id", broadcast_bytes=0)
    assert wide.exceptAll(wanted).count() == 0 and wide.count() == 30000
    # Without automatic broadcasts every reducer gets its share of the frequent key.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = numbering.lookup_join(rows, lookup if weight else lookup.drop("n"), ["k"], ["v"], weight=weight, row_id="id", broadcast_bytes=0)
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 30000 / 4 * 1.5


def test_frequent_keys_are_split_off_not_cut_off(spark, monkeypatch):
    monkeypatch.setattr(numbering, "FREQUENT_KEYS", 2)
    rows = spark.range(0, 900).select("id", (F.col("id") % 30).alias("k"))
    lookup = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.lit(30).alias("n"))
    out = numbering.lookup_join(rows, lookup, ["k"], ["v"], weight="n", broadcast_bytes=0)
    assert out.where("v = k * 10").count() == 900


def test_numbers_restart_in_many_groups(spark):
    rows = spark.range(0, 6000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 1500).alias("g"), F.col("id"))
    numbered = numbering.number_rows(rows, ["g", "id"], restart_by="g")
    worst = numbered.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m")).where("lo <> 1 or hi <> m")
    assert numbered.count() == 6000 and worst.count() == 0


def test_job_scratch_leaves_nothing(spark):
    from pathlib import Path

    for fail in (False, True):
        try:
            with numbering.job_scratch(spark) as folder:
                assert numbering.stash(spark.range(10)).count() == 10
                assert Path(folder.removeprefix("file:")).exists()
                if fail:
                    raise RuntimeError
        except RuntimeError:
            assert fail
        assert not Path(folder.removeprefix("file:")).exists()
        assert spark.conf.get(numbering._JOB_FOLDER, None) is None


def test_lookup_join_spreads_null_and_unknown_keys(spark):
    rows = spark.range(0, 40000).select(
        "id", F.when(F.col("id") % 5 < 2, None).when(F.col("id") % 5 < 4, "onbekend").otherwise(F.concat(F.lit("k"), F.col("id") % 3000)).alias("k")
    )
    lookup = rows.where("k like 'k%'").groupBy("k").agg(F.max("id").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = numbering.lookup_join(rows, lookup, ["k"], ["v"], row_id="id", broadcast_bytes=0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert joined.where("v is not null").count() == 8000 and sum(sizes) == 40000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_valid_rules_do_not_vanish_when_the_check_fails(spark, monkeypatch):
    from pyspark.errors import PySparkException

    from cloakframe.operators import rules

    class Broken:
        def range(self, *_):
            raise PySparkException("no executor left")

    with pytest.raises(PySparkException):
        rules.plan_rules(Broken(), [{"id": "a", "originalTerm": "klant", "isRegex": True}])


@pytest.mark.parametrize("restart_by", [None, "g"])
def test_few_and_many_distinct_rows_get_the_same_numbers(spark, restart_by):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 501).alias("v")).groupBy("g", "v").count()
    order = ["g", "v"]
    few, many = (numbering.number_distinct(rows, order, restart_by=restart_by, few=n) for n in (10_000, 0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert few.columns == many.columns and dict(few.dtypes)["n"] == dict(many.dtypes)["n"]
    assert numbering.number_distinct(rows.limit(0), order, restart_by=restart_by).count() == 0
