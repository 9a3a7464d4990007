"""Keyed permutations: one value, one pseudonym, and back."""

import time

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.permute import ALPHABET, permute_number, permute_text, restore_number, restore_text
from cloakframe.operators import columns


@pytest.mark.parametrize("limit", [1, 2, 3, 10, 97, 1000, 4099])
def test_numbers_below_a_limit(spark, limit):
    df = spark.range(limit).withColumn("p", permute_number(F.col("id"), limit, "key", "s")).withColumn("b", restore_number(F.col("p"), limit, "key", "s"))
    got = df.collect()
    assert sorted(r["p"] for r in got) == list(range(limit)) and all(r["b"] == r["id"] for r in got)


def test_a_million_numbers_and_large_limits(spark):
    n = 1_000_000
    assert spark.range(0, n, 1, 8).agg(F.count_distinct(permute_number(F.col("id"), n, "key"))).first()[0] == n
    big = (1 << 62) - 57
    df = spark.createDataFrame([(0,), (big - 1,), (1 << 61,), (big,), (-1,), (None,)], "v long")
    got = [r[0] for r in df.select(restore_number(permute_number(F.col("v"), big, "key"), big, "key")).collect()]
    assert got == [0, big - 1, 1 << 61, None, None, None]
    with pytest.raises(ValueError):
        permute_number(F.col("v"), 0, "key")


# What the first version of the network gave for two texts.
HANDED_OUT = [("8A9D38887B03619929A1C3667571E38A0D79", "0tzlYTVs#1pFEOfaAC"), ("F5F9FCC98AEF5B48", "OF7-XdFO")]
TEXTS = ["", "a", "ab", "Jan-Piet", "Jan Jansen, Utrecht 12", "é", "日本", "x" * 333, "=1+1", " ", "\n", None]


@pytest.mark.parametrize("alphabet", [None, ALPHABET, "abé本"])
def test_texts_come_back(spark, alphabet):
    df = spark.createDataFrame([(t,) for t in TEXTS], "v string").withColumn("p", permute_text(F.col("v"), "key", "s", alphabet))
    got = df.withColumn("b", restore_text(F.col("p"), "key", "s", alphabet)).withColumn("w", restore_text(F.col("p"), "other", "s", alphabet)).collect()
    assert [r["b"] for r in got] == TEXTS
    if alphabet != "abé本":  # few of the characters are in it
        assert {r["v"] for r in got if r["p"] == r["v"]} <= {"", None, "é", "日本", " ", "\n", "=1+1", "a"}
        assert got[7]["w"] != got[7]["v"]


def test_all_texts_of_a_length_stay_apart(spark):
    df = spark.range(26**3).select(F.concat(*[F.chr(97 + (F.col("id") / F.lit(26**i)).cast("long") % 26) for i in range(3)]).alias("v"))
    for alphabet in (None, "abcdefghijklmnopqrstuvwxyz"):
        assert df.agg(F.count_distinct(permute_text(F.col("v"), "key", "s", alphabet))).first()[0] == 26**3


def test_only_pseudonyms_are_restored(spark):
    df = spark.createDataFrame([("zz",), ("ABC",), ("",)], "v string")
    assert [r[0] for r in df.select(restore_text(F.col("v"), "key")).collect()] == [None, None, ""]


def test_as_a_column_rule(spark):
    df = spark.createDataFrame([(1, "Jan", 5), (2, "Piet", 7), (3, None, 7), (4, "Jan", 5)], "id long, naam string, nr int")
    rules = [{"columnName": "naam", "anonymizationType": "pseudonym", "columnSubtype": "letters"}, {"columnName": "nr", "anonymizationType": "pseudonym"}, {"columnName": "x", "anonymizationType": "pseudonym"}]
    masked = columns.mask_table(df, rules, salt="s").table
    names = [r["naam"] for r in masked.orderBy("id").collect()]
    assert names[0] == names[3] != "Jan" and len(names[1]) == 4 and names[2] is None
    assert [tuple(r) for r in columns.restore_pseudonyms(masked, rules, "s").orderBy("id").collect()] == [(1, "Jan", "5"), (2, "Piet", "7"), (3, None, "7"), (4, "Jan", "5")]


def test_work_grows_with_the_length(spark):
    """Two texts of 4,000 characters; hashes named inside the lambda of a digit took minutes for them."""
    df = spark.createDataFrame([("x" * 4000,), ("é" * 2000,)], "v string")
    started = time.perf_counter()
    got = df.select(restore_text(permute_text(F.col("v"), "key"), "key")).collect()
    assert [r[0] for r in got] == ["x" * 4000, "é" * 2000] and time.perf_counter() - started < 30


def test_pseudonyms_that_were_handed_out_stay_valid(spark):
    df = spark.createDataFrame([("Customer#000000001",), ("Jan-Piet",)], "v string")
    got = df.select(permute_text(F.col("v"), "zout", "c"), permute_text(F.col("v"), "zout", "c", ALPHABET)).collect()
    assert [tuple(r) for r in got] == HANDED_OUT
