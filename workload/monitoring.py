"""Job monitoring on metric events, and totals over rule logs."""

from pyspark.sql import functions as F

from cloakframe.operators import monitor, rules, sketches
from cloakframe.operators.numbering import scratch_path, stash
from cloakframe.plans import text_job
from cloakframe.streaming import jobs as streaming

from .inputs import JOBS_SQL, MESSAGES_SQL, jobs, messages, sql_emails, sql_phones, texts
from .registry import query

NOW = "timestamp '2024-01-20 12:00:00'"
BRACKET = "case when size_bytes < 1048576 then '<1MB' when size_bytes < 10485760 then '1-10MB' else '>10MB' end"


@query("size_brackets", f"select event_id, {BRACKET} as size_bracket from {JOBS_SQL} as j")
def size_brackets(spark, sf):
    return jobs(spark, sf).select("event_id", monitor.size_bracket(F.col("size_bytes")).alias("size_bracket"))


@query(
    "error_rates",
    f"""
    select file_type, count(*) filter (ts > {NOW} - interval 60 minute) as n_jobs,
      coalesce(avg(case when ts > {NOW} - interval 60 minute then (not success)::int end), 0.0) as error_rate from {JOBS_SQL} as j group by file_type
    """,
)
def error_rates(spark, sf):
    return monitor.error_rates(jobs(spark, sf), F.expr(NOW))


def _trailing_sql(minutes):
    frame = f"over (partition by file_type order by t range between {minutes * 60_000_000 - 1} preceding and current row)"
    return f"""
    select distinct file_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, count(*) {frame} as n_jobs, (sum((not success)::int) {frame})::bigint as n_failed,
      round(avg((not success)::int) {frame}, 9) as error_rate
    from (select *, epoch_us(ts) as t from {JOBS_SQL} as j) as x
    """


def _trailing(spark, sf, minutes):
    rates = monitor.trailing_error_rates(jobs(spark, sf), minutes)
    return rates.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "error_rate": F.round("error_rate", 9)})


@query("error_rate_trailing_hour", _trailing_sql(60))
def error_rate_trailing_hour(spark, sf):
    return _trailing(spark, sf, 60)


@query("error_rate_trailing_day", _trailing_sql(24 * 60))
def error_rate_trailing_day(spark, sf):
    return _trailing(spark, sf, 24 * 60)


@query(
    "duration_stats",
    f"""
    select size_bracket, round(avg(duration_seconds), 2) as avg_duration, round(min(duration_seconds), 2) as min_duration, round(max(duration_seconds), 2) as max_duration, count(*) as n_jobs
    from (select *, {BRACKET} as size_bracket from {JOBS_SQL} as j) as x where success group by size_bracket
    """,
)
def duration_stats(spark, sf):
    return monitor.duration_stats(jobs(spark, sf))


@query(
    "duration_percentiles",
    f"""
    select size_bracket, count(*) as n_jobs, round(avg(duration_seconds), 2) as avg_duration, min(duration_seconds) as min_duration, max(duration_seconds) as max_duration,
      list_sort(list(duration_seconds))[greatest(1, floor(count(*) * 0.5)::int)] as p50, list_sort(list(duration_seconds))[greatest(1, floor(count(*) * 0.95)::int)] as p95
    from (select *, {BRACKET} as size_bracket from {JOBS_SQL} as j) as x where success group by size_bracket
    """,
)
def duration_percentiles(spark, sf):
    return monitor.duration_percentiles(jobs(spark, sf))


@query(
    "duration_sketches",
    f"""
    select size_bracket, count(*) as n_jobs, round(avg(duration_seconds), 2) as avg_duration, min(duration_seconds) as min_duration, max(duration_seconds) as max_duration, true as p50_within, true as p95_within
    from (select *, {BRACKET} as size_bracket from {JOBS_SQL} as j) as x where success group by size_bracket
    """,
)
def duration_sketches(spark, sf):
    """Sketches per day, type and bracket, half of them from a stream's batches, merged per bracket; ranks are held against the durations."""
    source, path = scratch_path(spark, "events"), scratch_path(spark, "sketches")
    events = jobs(spark, sf)
    events.where("event_id % 2 = 1").repartition(3).write.parquet(source)
    stream = streaming.read_stream(spark, source, events.schema, files_per_trigger=2)
    sketches.sketch_stream(stream, path, path + "-checkpoint").awaitTermination()
    stored = sketches.job_sketches(events.where("event_id % 2 = 0")).unionByName(spark.read.parquet(path).drop("stream", "batch"))
    found = stash(sketches.sketched_durations(stored, "size_bracket"))
    done = events.where("success").withColumn("size_bracket", monitor.size_bracket(F.col("size_bytes"))).join(F.broadcast(found), "size_bracket")
    # Any rank between those of the smaller values and of the values up to the pick is right.
    share = lambda c: F.count_if(c) / F.count("*")
    within = lambda name, q: ((share(F.col("duration_seconds") < F.col(name)) - sketches.RANK_ERROR <= q) & (share(F.col("duration_seconds") <= F.col(name)) + sketches.RANK_ERROR >= q)).alias(f"{name}_within")
    return done.groupBy("size_bracket", "n_jobs", "avg_duration", found["min_duration"], found["max_duration"]).agg(within("p50", 0.5), within("p95", 0.95))


@query(
    "duration_by_type",
    f"select file_type, round(avg(duration_seconds), 2) as avg_duration, max(duration_seconds) as max_duration, count(*) as n_jobs from {JOBS_SQL} as j where success group by file_type",
)
def duration_by_type(spark, sf):
    return monitor.duration_by_type(jobs(spark, sf))


@query(
    "entity_stats",
    f"select sum(entities_found)::bigint as total_entities, round(avg(entities_found), 1) as avg_entities, max(entities_found) as max_entities from {JOBS_SQL} as j where success",
)
def entity_stats(spark, sf):
    return monitor.entity_stats(jobs(spark, sf))


@query(
    "memory_stats",
    f"select round(avg(round(memory_peak_bytes / 1048576.0::double, 1)), 1) as avg_peak_mb, max(round(memory_peak_bytes / 1048576.0::double, 1)) as max_peak_mb from {JOBS_SQL} as j",
)
def memory_stats(spark, sf):
    from cloakframe.sinks import writers

    return monitor.memory_stats(writers.memory_events(jobs(spark, sf)))


@query(
    "slow_verdict",
    f"""
    select n_slow, n_very_slow, case when n_very_slow > 0 then concat(cast(n_very_slow as varchar), ' operations took >60s (alert threshold)')
      when n_slow > 0 then concat(cast(n_slow as varchar), ' operations took >30s (warning threshold)') else 'All operations completed within acceptable time' end as verdict
    from (select count(*) filter (duration_seconds > 30) as n_slow, count(*) filter (duration_seconds > 60) as n_very_slow from {JOBS_SQL} as j where success) as x
    """,
)
def slow_verdict(spark, sf):
    return monitor.slow_verdict(jobs(spark, sf))


@query(
    "error_status",
    f"""
    select file_type, total, failures, round(failures / total, 3) as error_rate,
      case when round(failures / total, 3) > 0.05 then 'ALERT' when round(failures / total, 3) > 0 then 'WARN' else 'OK' end as status
    from (select file_type, count(*) as total, sum((not success)::int)::bigint as failures from {JOBS_SQL} as j group by file_type) as x
    """,
)
def error_status(spark, sf):
    return monitor.error_table(jobs(spark, sf))


@query(
    "bracket_summary",
    f"select {BRACKET} as size_bracket, count(*) as n_jobs, round(avg(duration_seconds), 2) as avg_duration, max(duration_seconds) as max_duration from {JOBS_SQL} as j where success group by 1",
)
def bracket_summary(spark, sf):
    return monitor.bracket_summary(jobs(spark, sf))


@query(
    "duration_alerts",
    f"""
    select file_type, {BRACKET} as size_bracket, case when duration_seconds > 60 then 'alert' else 'duration_warning' end as metric_type,
      case when duration_seconds > 60 then 'Processing duration exceeded 60s' else 'processing_slow' end as message,
      case when duration_seconds > 60 then round(duration_seconds, 3) else round(duration_seconds, 2) end as value from {JOBS_SQL} as j where duration_seconds > 30
    """,
)
def duration_alerts(spark, sf):
    return monitor.duration_alerts(jobs(spark, sf)).drop("ts")


@query(
    "memory_alerts",
    f"select operation, 'memory_warning' as metric_type, round(memory_peak_bytes / 1048576.0::double, 1) as memory_peak_mb from {JOBS_SQL} as j where memory_peak_bytes > 536870912",
)
def memory_alerts(spark, sf):
    return monitor.memory_alerts(jobs(spark, sf)).drop("ts")


@query(
    "error_rate_alerts",
    f"""
    select file_type, round(avg((not success)::int), 9) as error_rate, count(*) as n_jobs, 'High error rate for ' || file_type as message from {JOBS_SQL} as j
    where ts > {NOW} - interval 600 minute group by file_type having avg((not success)::int) > 0.05
    """,
)
def error_rate_alerts(spark, sf):
    alerts = monitor.error_rate_alerts(monitor.error_rates(jobs(spark, sf), F.expr(NOW), 600))
    return alerts.withColumn("error_rate", F.round("error_rate", 9))


@query(
    "slowest_jobs",
    f"select event_id, duration_seconds, file_type, size_bytes, entities_found from {JOBS_SQL} as j where success order by duration_seconds desc, event_id limit 10",
)
def slowest_jobs(spark, sf):
    return monitor.slowest_jobs(jobs(spark, sf), tie_break="event_id").select(
        "event_id", "duration_seconds", "file_type", "size_bytes", "entities_found"
    )


# --- totals over rule logs ------------------------------------------------------

_P, _E = f"len({sql_phones('text')})::bigint", f"len({sql_emails('text')})::bigint"
LOG_RULES = [{"id": "m1", "originalTerm": "status", "replacementTerm": "[S]"}, {"id": "m2", "originalTerm": "URGENT", "replacementTerm": "!"}]
LOG_COUNTS = f"(select doc_id, {_P} as p, {_E} as e, len(regexp_extract_all(text, '(?i)status')) + len(regexp_extract_all(text, '(?i)urgent')) as m from {MESSAGES_SQL} as t)"


def _logs(spark, sf):
    return rules.explode_log(text_job.redact_texts(messages(spark, sf), LOG_RULES), "doc_id")


@query(
    "job_totals",
    f"select sum(p)::bigint as total_phones, sum(e)::bigint as total_emails, sum(m)::bigint as total_manual_replacements, (sum(p) + sum(e) + sum(m))::bigint as total_items from {LOG_COUNTS} as c",
)
def job_totals(spark, sf):
    return monitor.job_totals(_logs(spark, sf))


@query("entities_per_file", f"select doc_id, (p + e + m)::bigint as entities_found from {LOG_COUNTS} as c")
def entities_per_file(spark, sf):
    return monitor.entities_per_file(_logs(spark, sf), "doc_id")


@query(
    "logs_split",
    f"""
    select 'auto' as part, count(*) as n from (select 1 from {LOG_COUNTS} as c where p > 0 union all select 1 from {LOG_COUNTS} as c where e > 0) as a
    union all
    select 'manual', count(*) from (select 1 from {MESSAGES_SQL} as t where regexp_matches(text, '(?i)status') union all select 1 from {MESSAGES_SQL} as t where regexp_matches(text, '(?i)urgent')) as m
    """,
)
def logs_split(spark, sf):
    auto, manual = monitor.split_logs(_logs(spark, sf))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(auto, "auto").unionByName(count(manual, "manual"))


@query(
    "first_manual_logs",
    f"""
    with m as (select doc_id, 'm1' as rule from {MESSAGES_SQL} as t where regexp_matches(text, '(?i)status')
      union all select doc_id, 'm2' from {MESSAGES_SQL} as t where regexp_matches(text, '(?i)urgent'))
    select doc_id, rule as "ruleId", (select count(*) - 5 from m) as n_more from m order by doc_id, rule limit 5
    """,
)
def first_manual_logs(spark, sf):
    first, more = monitor.first_logs(monitor.split_logs(_logs(spark, sf))[1], ["doc_id", "ruleId"])
    return first.select("doc_id", "ruleId", more.scalar().alias("n_more"))


@query("conversation_totals", f"""
    select role, sum(len({sql_phones('text')}))::bigint as phones, sum(len({sql_emails('text')}))::bigint as emails,
      sum(len({sql_phones('text')}) + len({sql_emails('text')}))::bigint as total_items from conversations group by role
    """)
def conversation_totals(spark, sf):
    return monitor.report_totals(text_job.redact_texts(texts(spark, sf, "conversations")), "role")
