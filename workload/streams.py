"""Streams, run to the end of what has arrived; the SQL is the batch answer."""

from pyspark.sql import functions as F

from cloakframe.operators import monitor
from cloakframe.operators.numbering import scratch_path, stash
from cloakframe.sinks import writers
from cloakframe.sources import logs
from cloakframe.streaming import jobs as streaming
from cloakframe.streaming import placeholders

from .inputs import JOBS, JOBS_SQL, SPARK, dialect, sql_redacted, table
from .inputs import jobs as monitoring_jobs
from .registry import query


def _stream(spark, sf, name):
    return streaming.read_table_stream(spark, f"{sf}/{name}.parquet", table(spark, sf, name).schema)


def _job_stream(spark, sf):
    return spark.sql(dialect(JOBS, SPARK).replace("from events", "from {events}"), events=_stream(spark, sf, "events"))


def _appended(spark, stream):
    path = scratch_path(spark, "stream")
    streaming.append_to(stream, path, path + "-checkpoint").awaitTermination()
    return spark.read.parquet(path)


@query("stream_failures", f"select file_type, error, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from {JOBS_SQL} as j where not success")
def stream_failures(spark, sf):
    feed = _appended(spark, streaming.failures(_job_stream(spark, sf)))
    return feed.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "stream_live_feed",
    f"""
    select kind, file_type, message, count(*) as n, round(max(value), 3) as highest from (
      select 'ERROR' as kind, file_type, error as message, null::double as value from {JOBS_SQL} as j where not success
      union all
      select 'ALERT', file_type, 'Processing duration exceeded 60s', round(duration_seconds, 3) from {JOBS_SQL} as j where duration_seconds > 60) as x
    group by all
    """,
)
def stream_live_feed(spark, sf):
    """The metric log as a stream of JSON lines."""
    folder = scratch_path(spark, "metriclog")
    jobs = monitoring_jobs(spark, sf)
    writers.append_metrics(writers.metric_events(jobs), folder)
    writers.append_metrics(writers.alert_events(monitor.duration_alerts(jobs).where("metric_type = 'alert'")), folder)
    lines = spark.readStream.text(folder)
    feed = _appended(spark, streaming.live_feed(logs.parse_metrics(lines)))
    return feed.groupBy("kind", "file_type", "message").agg(F.count("*").alias("n"), F.round(F.max("value"), 3).alias("highest"))


@query(
    "stream_error_rate",
    f"""
    select strftime(w, '%Y-%m-%d %H:%M') as window_start, file_type, count(*) as n_jobs, sum((not success)::int)::bigint as n_failed,
      round(avg((not success)::int), 9) as error_rate, avg((not success)::int) > 0.05 as alert
    from (select *, unnest(list_transform(range(0, 12), lambda i: time_bucket(interval 5 minute, ts) - to_minutes((5 * i)::int))) as w from {JOBS_SQL} as j) as x
    group by all
    """,
)
def stream_error_rate(spark, sf):
    path = scratch_path(spark, "rates")
    rates = streaming.sliding_error_rate(_job_stream(spark, sf))
    streaming.upsert_to(rates, path, path + "-checkpoint").awaitTermination()
    return _rates(spark, path)


def _rates(spark, path):
    final = streaming.latest(spark.read.parquet(path), ["window_start", "window_end", "file_type"])
    return final.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "file_type", "n_jobs", "n_failed",
        F.round("error_rate", 9).alias("error_rate"), "alert",
    )


@query(
    "stream_late_rows",
    f"""
    select strftime(w, '%Y-%m-%d %H:%M') as window_start, file_type, count(*) as n_jobs, sum((not success)::int)::bigint as n_failed,
      round(avg((not success)::int), 9) as error_rate, avg((not success)::int) > 0.05 as alert
    from (select *, unnest(list_transform(range(0, 12), lambda i: time_bucket(interval 5 minute, ts) - to_minutes((5 * i)::int))) as w from {JOBS_SQL} as j) as x
    group by all
    """,
)
def stream_late_rows(spark, sf):
    """All jobs once more, three days too late, in a second run: none of them counts."""
    source, path = scratch_path(spark, "events"), scratch_path(spark, "rates")
    on_time = monitoring_jobs(spark, sf)
    late = on_time.withColumn("ts", F.timestamp_add("DAY", F.lit(-3), "ts"))
    for rows in (on_time, late):
        rows.write.mode("append").parquet(source)
        rates = streaming.sliding_error_rate(streaming.read_stream(spark, source, on_time.schema))
        streaming.upsert_to(rates, path, path + "-checkpoint").awaitTermination()
    return _rates(spark, path)


@query("stream_redact", f"select doc_id, {sql_redacted('text')} as redacted from documents")
def stream_redact(spark, sf):
    return _appended(spark, streaming.redact_stream(_stream(spark, sf, "documents")).select("doc_id", "redacted"))


@query(
    "stream_mapping",
    """
    select 'corpus' as scope_id, 'item' as kind, cast(o_custkey as varchar) as original,
      concat('[ITEM_', cast(row_number() over (order by min(o_orderkey)) as varchar), ']') as placeholder from orders group by o_custkey
    """,
)
def stream_mapping(spark, sf):
    path = scratch_path(spark, "mapping")
    values = _stream(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("original"), F.col("o_orderkey").alias("seen"))
    streaming.allocate_stream(values, path, path + "-checkpoint").awaitTermination()
    return spark.read.schema(streaming.MAPPING_SCHEMA).parquet(path).drop("stream", "batch")


@query(
    "stream_mapping_keyed",
    """
    select cast(o_custkey as varchar) as original, 1::bigint as n_entries, true as kept, 1::bigint as n_originals from orders group by o_custkey
    """,
)
def stream_mapping_keyed(spark, sf):
    """Keyed state: half the orders, a restart with all of them, then a second stream that sees them all again."""
    source, path = scratch_path(spark, "orders"), scratch_path(spark, "mapping")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("original"), F.col("o_orderkey").alias("seen"))
    seen = []
    for part, checkpoint in ((orders.where("seen % 2 = 0"), "-c1"), (orders.where("seen % 2 = 1"), "-c1"), (orders.limit(0), "-c2")):
        part.write.mode("append").parquet(source)
        stream = streaming.read_stream(spark, source, orders.schema)
        placeholders.allocate_keyed(stream, path, path + checkpoint, groups=32).awaitTermination()
        seen.append(stash(placeholders.read_mapping(spark, path)))
    first, _, last = seen
    same = first.select("original", F.col("placeholder").alias("before"))
    others = last.groupBy("placeholder").agg(F.count_distinct("original").alias("n_originals"))
    entries = last.join(same, "original", "left").join(others, "placeholder")
    kept = F.min(F.coalesce(F.col("before") == F.col("placeholder"), F.lit(True)))
    return entries.groupBy("original").agg(F.count("*").alias("n_entries"), kept.alias("kept"), F.max("n_originals").alias("n_originals"))


@query(
    "stream_alerts",
    f"""
    select file_type, case when duration_seconds > 60 then 'alert' else 'duration_warning' end as metric_type, count(*) as n, max(duration_seconds) as slowest
    from {JOBS_SQL} as j where duration_seconds > 30 group by all
    """,
)
def stream_alerts(spark, sf):
    alerts = _appended(spark, monitor.duration_alerts(_job_stream(spark, sf)))
    return alerts.groupBy("file_type", "metric_type").agg(F.count("*").alias("n"), F.max("value").alias("slowest"))


@query("stream_memory_alerts", f"select operation, count(*) as n, max(round(memory_peak_bytes / 1048576.0::double, 1)) as peak_mb from {JOBS_SQL} as j where memory_peak_bytes > 536870912 group by 1")
def stream_memory_alerts(spark, sf):
    alerts = _appended(spark, monitor.memory_alerts(_job_stream(spark, sf)))
    return alerts.groupBy("operation").agg(F.count("*").alias("n"), F.max("memory_peak_mb").alias("peak_mb"))
