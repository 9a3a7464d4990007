"""Placeholders from keyed state: restarts, repeated values, streams that follow each other."""

import pytest
from pyspark.sql import functions as F

from cloakframe.streaming.jobs import read_stream
from cloakframe.streaming.placeholders import allocate_keyed, read_mapping


@pytest.fixture
def feed(spark, tmp_path):
    folder = str(tmp_path / "in")

    def more(values):
        rows = [(v, i) for i, v in enumerate(values)]
        spark.createDataFrame(rows, "original string, seen long").coalesce(2).write.mode("append").parquet(folder)

    def run(checkpoint, files_per_trigger=None):
        stream = read_stream(spark, folder, "original string, seen long", files_per_trigger=files_per_trigger)
        query = allocate_keyed(stream, str(tmp_path / "map"), str(tmp_path / checkpoint), groups=4, block=3)
        query.awaitTermination()
        got = read_mapping(spark, str(tmp_path / "map"))
        assert got.groupBy("original").count().where("count > 1").count() == 0
        assert got.groupBy("placeholder").count().where("count > 1").count() == 0
        return {r["original"]: r["placeholder"] for r in got.collect()}, query

    return more, run


def test_restart_and_second_stream_agree(feed):
    more, run = feed
    more([f"v{i % 40}" for i in range(200)] + [None, "hot"] + ["hot"] * 500)
    first, _ = run("c1")
    assert len(first) == 41
    more([f"v{i}" for i in range(30, 60)])
    second, _ = run("c1")
    assert len(second) == 61 and {k: second[k] for k in first} == first
    again, _ = run("c1")
    assert again == second
    more(["late", "v3"])
    third, _ = run("c2")  # another checkpoint: all files once more
    assert len(third) == 62 and {k: third[k] for k in second} == second
    numbers = sorted(int(p.split("_")[1][:-1]) for p in third.values())
    assert int(third["late"].split("_")[1][:-1]) == numbers[-1]


def test_many_batches_give_what_one_gives(spark, feed):
    more, run = feed
    for part in range(3):
        more([f"w{i}" for i in range(part * 10, part * 10 + 25)])
    found, _ = run("c1", files_per_trigger=1)
    assert len(found) == 45


def test_values_without_a_stream(spark, tmp_path):
    assert read_mapping(spark, str(tmp_path / "none")).count() == 0
