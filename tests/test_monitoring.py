import datetime as dt

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import monitor
from cloakframe.sinks import writers
from cloakframe.sources import logs
from cloakframe.streaming import jobs as streaming

MB = 1024 * 1024
T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
SCHEMA = "ts timestamp, file_type string, size_bytes long, duration_seconds double, entities_found long, success boolean, error string"


def _events(spark, rows):
    """Rows of (seconds after T0, type, size, duration, success)."""
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), t, size, d, 1, ok, None if ok else "stuk") for s, t, size, d, ok in rows], SCHEMA)


@pytest.mark.parametrize(
    ("size", "bracket"), [(0, "<1MB"), (MB - 1, "<1MB"), (MB, "1-10MB"), (10 * MB - 1, "1-10MB"), (10 * MB, ">10MB"), (50 * MB, ">10MB")]
)
def test_brackets(spark, size, bracket):
    assert spark.range(1).select(monitor.size_bracket(F.lit(size)).alias("b")).first()["b"] == bracket


def test_error_rate_and_alert(spark):
    rows = [(i, "xlsx", 1, 1.0, i >= 6) for i in range(100)] + [(i, "pdf", 1, 1.0, True) for i in range(5)] + [(-7200, "csv", 1, 1.0, False)]
    rates = monitor.error_rates(_events(spark, rows), F.lit(T0 + dt.timedelta(seconds=100)))
    by_type = {r["file_type"]: r["error_rate"] for r in rates.collect()}
    assert by_type == {"xlsx": 0.06, "pdf": 0.0, "csv": 0.0, "docx": 0.0, "txt": 0.0}
    assert [r["message"] for r in monitor.error_rate_alerts(rates).collect()] == ["High error rate for xlsx"]


def test_window_end_is_exclusive(spark):
    df = _events(spark, [(0, "csv", 1, 1.0, False), (3600, "csv", 1, 1.0, True)])
    now = F.lit(T0 + dt.timedelta(seconds=3600))
    assert monitor.error_rates(df, now, file_types=["csv"]).first()["error_rate"] == 0.0
    assert {(r["ts"], r["n_jobs"]) for r in monitor.trailing_error_rates(df).collect()} == {(T0, 1), (T0 + dt.timedelta(hours=1), 1)}


def test_trailing_rates_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(0, 20000), rng.choice(["csv", "pdf", "pdf", "pdf"]), 1, 1.0, rng.random() > 0.2) for _ in range(800)]
    got = {(r["file_type"], r["ts"]): (r["n_jobs"], r["n_failed"]) for r in monitor.trailing_error_rates(_events(spark, rows), 17).collect()}
    for s, kind, *_ in rows:
        frame = [ok for s2, k2, _, _, ok in rows if k2 == kind and s - 17 * 60 < s2 <= s]
        assert got[kind, T0 + dt.timedelta(seconds=s)] == (len(frame), frame.count(False))


def test_stats_have_every_bracket(spark):
    df = _events(spark, [(i, "xlsx", 5 * MB, d, True) for i, d in enumerate([5.0, 6.0, 7.0])] + [(9, "xlsx", 5 * MB, 99.0, False)])
    stats = {r["size_bracket"]: (r["avg_duration"], r["min_duration"], r["max_duration"], r["n_jobs"]) for r in monitor.duration_stats(df).collect()}
    assert stats == {"1-10MB": (6.0, 5.0, 7.0, 3), "<1MB": (0.0, 0.0, 0.0, 0), ">10MB": (0.0, 0.0, 0.0, 0)}


@pytest.mark.parametrize(("durations", "p50", "p95"), [([4.0], 4.0, 4.0), ([1.0, 2.0, 3.0, 4.0], 2.0, 3.0), ([5.0] * 10 + [1.0], 5.0, 5.0), ([float(i) for i in range(1, 101)], 50.0, 95.0)])
def test_percentiles(spark, durations, p50, p95):
    row = monitor.duration_percentiles(_events(spark, [(i, "csv", 1, d, True) for i, d in enumerate(durations)])).first()
    assert (row["p50"], row["p95"], row["n_jobs"]) == (p50, p95, len(durations))


def test_duration_alerts(spark):
    df = _events(spark, [(0, "csv", 1, 30.0, True), (1, "csv", 1, 30.5, True), (2, "csv", 1, 60.0, True), (3, "csv", 1, 60.1, False)])
    alerts = monitor.duration_alerts(df)
    assert [r["metric_type"] for r in alerts.orderBy("ts").collect()] == ["duration_warning", "duration_warning", "alert"]
    event = writers.alert_events(alerts.where("metric_type = 'alert'")).first()
    assert event["message"] == "ALERT: Processing duration exceeded 60s (value: 60.100)"


def test_error_table(spark):
    rows = [(i, "csv", 1, 1.0, i > 0) for i in range(100)] + [(i, "pdf", 1, 1.0, i > 9) for i in range(100)] + [(1, "txt", 1, 1.0, True)]
    got = {r["file_type"]: (r["total"], r["failures"], r["status"]) for r in monitor.error_table(_events(spark, rows)).collect()}
    assert got == {"csv": (100, 1, "WARN"), "pdf": (100, 10, "ALERT"), "txt": (1, 0, "OK")}


def test_verdicts(spark):
    verdict = lambda *d: monitor.slow_verdict(_events(spark, [(i, "csv", 1, x, True) for i, x in enumerate(d)])).first()["verdict"]
    assert verdict(1.0).startswith("All operations")
    assert verdict(1.0, 31.0) == "1 operations took >30s (warning threshold)"
    assert verdict(61.0, 31.0) == "1 operations took >60s (alert threshold)"


def test_metric_log(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_metrics(writers.metric_events(_events(spark, [(0, "csv", 5 * MB, 1.2345, True), (1, "pdf", 1, 2.0, False)])), path)
    (tmp_path / "log" / "ruis.json").write_text("dit is geen json\n")
    rows = {r["file_type"]: r for r in logs.read_metrics(spark, path).collect()}
    assert rows["csv"]["duration_seconds"] == 1.23 and rows["csv"]["file_size_mb"] == 5.0 and rows["csv"]["size_bracket"] == "1-10MB"
    assert rows["pdf"]["message"] == "processing_error" and rows["pdf"]["error"] == "stuk"


# --- streams ----------------------------------------------------------------------


def _files(df, folder, n):
    df.repartition(n).write.parquet(str(folder))
    return str(folder)


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    import random

    rng = random.Random(5)
    events = _events(spark, [(rng.randrange(0, 20000), rng.choice(["csv", "pdf"]), 1, 1.0, rng.random() > 0.2) for _ in range(500)])
    folder = _files(events, tmp_path / "in", 4)
    stream = streaming.read_stream(spark, folder, events.schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    streaming.upsert_to(streaming.sliding_error_rate(stream), out, out + "-c").awaitTermination()
    final = streaming.latest(spark.read.parquet(out), ["window_start", "window_end", "file_type"]).select("window_start", "file_type", "n_jobs", "n_failed", "alert")
    batch = streaming.sliding_error_rate(events).select("window_start", "file_type", "n_jobs", "n_failed", "alert")
    assert final.exceptAll(batch).count() == 0 and batch.exceptAll(final).count() == 0


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    hour = 3600
    batches = [[(0, "csv", 1, 1.0, True), (60 * hour, "csv", 1, 1.0, True)], [(61 * hour, "csv", 1, 1.0, False)], [(hour, "laat", 1, 1.0, False), (59 * hour, "op tijd", 1, 1.0, True)]]
    for i, rows in enumerate(batches):
        events = _events(spark, rows)
        events.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        target = folder / f"{i}.parquet"
        target.write_bytes(next((tmp_path / f"b{i}").glob("*.parquet")).read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    out = str(tmp_path / "out")
    stream = streaming.read_stream(spark, str(folder), events.schema, files_per_trigger=1)
    streaming.upsert_to(streaming.sliding_error_rate(stream), out, out + "-c").awaitTermination()
    kinds = {r["file_type"] for r in streaming.latest(spark.read.parquet(out), ["window_start", "window_end", "file_type"]).collect()}
    assert kinds == {"csv", "op tijd"}


def test_placeholders_hold_across_batches_and_repeats(spark, tmp_path):
    values = spark.createDataFrame([(f"v{i % 40}", i) for i in range(400)], "original string, seen long")
    folder = _files(values, tmp_path / "in", 5)
    stream = streaming.read_stream(spark, folder, values.schema, files_per_trigger=1)
    out = str(tmp_path / "map")
    streaming.allocate_stream(stream, out, out + "-c").awaitTermination()
    known = spark.read.schema(streaming.MAPPING_SCHEMA).parquet(out)
    before = {(r["original"], r["placeholder"]) for r in known.collect()}
    assert len(before) == 40 and {p for _, p in before} == {f"[ITEM_{i}]" for i in range(1, 41)}
    # The last batch runs again: its commit is lost, its folder is written once more.
    commits = tmp_path / "map-c" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    (commits / str(last)).unlink()
    crc = commits / f".{last}.crc"
    if crc.exists():
        crc.unlink()
    streaming.allocate_stream(stream, out, out + "-c").awaitTermination()
    spark.catalog.refreshByPath(out)
    again = {(r["original"], r["placeholder"]) for r in spark.read.schema(streaming.MAPPING_SCHEMA).parquet(out).collect()}
    assert again == before


def test_redaction_of_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"bel 06-{12345678 + i} of x{i}@b.nl") for i in range(50)], "doc_id long, text string")
    stream = streaming.read_stream(spark, _files(docs, tmp_path / "in", 3), docs.schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    streaming.append_to(streaming.redact_stream(stream).select("doc_id", "redacted"), out, out + "-c").awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 50 and rows.where("redacted <> 'bel [TEL VERWIJDERD] of [EMAIL VERWIJDERD]'").count() == 0
