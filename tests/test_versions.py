"""Tables by version: a stop between any two steps, writers at the same time, readers at an old version."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cloakframe.sinks.versions import VersionedTable

NOW = "timestamp '2024-01-10 12:00:00'"


def _rows(spark, days, n=3, start=0):
    rows = [(start + 10 * d + i, dt.datetime(2024, 1, d, 8 * i), f"2024-01-{d:02d}") for d in days for i in range(n)]
    return spark.createDataFrame(rows, "v long, ts timestamp, dt string")


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), "dt", "ts")


def _values(df):
    return sorted(r["v"] for r in df.collect())


def test_append_read_and_old_versions(spark, table):
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.append(_rows(spark, [1, 2])) == 1
    old = table.read()
    assert table.append(_rows(spark, [2], start=100)) == 2
    assert _values(old) == _values(table.read(1)) == [10, 11, 12, 20, 21, 22]
    assert len(_values(table.read())) == 9
    with pytest.raises(ValueError, match="other columns"):
        table.append(spark.range(1).select(F.col("id").alias("v"), F.current_timestamp().alias("ts"), F.lit("x").alias("dt")))
    assert table.append(_rows(spark, [])) == 2


def test_purge_cuts_one_day_only(spark, table):
    table.append(_rows(spark, [8, 9, 10]))
    before = {x.folder for x in table.manifest()["leaves"] if x.part == "2024-01-10"}
    assert table.purge(F.expr(NOW)) == 2  # limit: the 9th at noon
    assert _values(table.read()) == [92, 100, 101, 102]
    assert before <= {x.folder for x in table.manifest()["leaves"]}  # not written again
    assert table.purge(F.expr(NOW)) == 0 and table.version() == 2


def test_rows_appended_during_a_purge_stay(spark, table, tmp_path, monkeypatch):
    table.append(_rows(spark, [8, 9]))
    other, publish, turns = VersionedTable(spark, str(tmp_path / "t"), "dt", "ts"), table._publish, []

    def interrupted(*args):
        if not turns:
            turns.append(other.append(_rows(spark, [9], start=500)))
        return publish(*args)

    monkeypatch.setattr(table, "_publish", interrupted)
    table.purge(F.expr(NOW))
    assert table.version() == 3 and _values(table.read()) == [92, 590, 591, 592]
    # what came meanwhile is purged in its turn
    assert table.purge(F.expr(NOW)) == 1 and _values(table.read()) == [92, 592]


def test_two_purges_at_once(spark, table, tmp_path, monkeypatch):
    table.append(_rows(spark, [8, 9]))
    other, publish, turns = VersionedTable(spark, str(tmp_path / "t"), "dt", "ts"), table._publish, []

    def interrupted(*args):
        if not turns:
            turns.append(other.purge(F.expr(NOW)))
        return publish(*args)

    monkeypatch.setattr(table, "_publish", interrupted)
    table.purge(F.expr(NOW))
    assert _values(table.read()) == [92]


@pytest.mark.parametrize("step", ["_written", "_publish", "_move"])
@pytest.mark.parametrize("change", ["append", "purge", "remove", "compact"])
def test_a_stop_leaves_old_or_new(spark, tmp_path, monkeypatch, step, change):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, "dt", "ts")
    table.append(_rows(spark, [8, 9]))
    table.append(_rows(spark, [9], start=500))
    run = {"append": lambda t: t.append(_rows(spark, [9], start=900)), "purge": lambda t: t.purge(F.expr(NOW)), "remove": lambda t: t.remove_part("2024-01-09"), "compact": lambda t: t.compact()}[change]

    class Stopped(Exception):
        pass

    def stop(*args):
        raise Stopped

    monkeypatch.setattr(table, step, stop)
    before = _values(table.read())
    if (change, step) == ("remove", "_written"):
        run(table)
    else:
        with pytest.raises(Stopped):
            run(table)
        assert _values(VersionedTable(spark, path, "dt", "ts").read()) == before
    again = VersionedTable(spark, path, "dt", "ts")
    run(again)  # and the change can be made afterwards
    wanted = {"append": sorted([*before, 990, 991, 992]), "purge": [92, 592], "remove": [80, 81, 82], "compact": before}[change]
    assert _values(again.read()) == wanted
    again.vacuum()
    assert _values(again.read()) == wanted


def test_sessions_and_odd_names(spark, tmp_path):
    session = "123e4567-e89b-12d3-a456-426614174000"
    table = VersionedTable(spark, str(tmp_path / "s"), "session_id")
    table.append(spark.createDataFrame([(session, 1), ("a/b=c ü", 2), (None, 3), ("", 4)], "session_id string, v long"))
    assert not table.remove_session("geen") and not table.remove_session("123e4567-e89b-12d3-a456-426614174001")
    assert table.version() == 1
    assert table.remove_session(session) and _values(table.read()) == [2, 3, 4]
    assert table.remove_part("a/b=c ü") and _values(table.read()) == [3, 4]
    with pytest.raises(ValueError, match="retention"):
        table.purge(F.current_timestamp())
