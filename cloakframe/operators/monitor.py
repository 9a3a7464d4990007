"""Job monitoring over metric events.

An event has ``ts, file_type, size_bytes, duration_seconds, entities_found,
success, error``; memory events have ``operation, memory_peak_bytes``.
All reports group by a handful of keys, with partial sums in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from .numbering import running_total, stash

MICROS_PER_MINUTE = 60_000_000
# Slices of a trailing window: five minutes for an hour, two hours for a day.  Each total is sent to
# so many slices; sixty cost more than twice the time on the supplied events.
SLICES = 12


def size_bracket(size_bytes: Column) -> Column:
    small, medium, large = cat.SIZE_BRACKETS
    return F.when(size_bytes < cat.SMALL_BYTES, small).when(size_bytes < cat.MEDIUM_BYTES, medium).otherwise(large)


def failed(success: Column) -> Column:
    return (~success).cast("int")


def error_rates(events: DataFrame, now: Column, window_minutes: int = 60, file_types: list[str] | None = None) -> DataFrame:
    """Share of failures per file type, strictly newer than ``now`` minus the window.

    The time filter reaches the scan, so old row groups are not read.  The
    ``file_types`` (by default those a job can have) without a recent event
    report 0.0.
    """
    recent = events.where(F.col("ts") > F.timestamp_add("MINUTE", F.lit(-window_minutes), now))
    rates = recent.groupBy("file_type").agg(
        F.count("*").alias("n_jobs"), F.avg(failed(F.col("success"))).alias("error_rate")
    )
    expected = events.sparkSession.createDataFrame([(t,) for t in file_types or cat.MONITORED_TYPES], "file_type string")
    return rates.join(expected, "file_type", "full").fillna({"n_jobs": 0, "error_rate": 0.0})


def trailing_error_rates(events: DataFrame, window_minutes: int = 60) -> DataFrame:
    """Error rate of the trailing window at every event: ``(t - window, t]`` per file type.

    Time is cut into ``SLICES`` slices per window.  The window at ``t`` is what the
    slice of ``t`` holds up to ``t``, plus the slices between, less what the slice of
    ``t - window`` holds up to there.  Ordered work is per type and fine slice; the
    slices between are sums of slice totals, each of which is sent ahead to the
    slices that it counts for.
    """
    width = window_minutes * MICROS_PER_MINUTE
    fine = width // SLICES
    moments = (
        events.groupBy("file_type", F.unix_micros("ts").alias("t"))
        .agg(F.count("*").alias("n"), F.sum(failed(F.col("success"))).alias("f"))
    )
    def point(at, n, f, sign) -> Column:
        return F.struct(F.floor(at / fine).alias("slice"), at.alias("at"), n.alias("n"), f.alias("f"), F.lit(sign).alias("sign"))

    t, nothing = F.col("t"), F.lit(0).cast("long")
    points = F.array(point(t, F.col("n"), F.col("f"), 1), point(t - width, nothing, nothing, -1))
    up_to = Window.partitionBy("file_type", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edges = moments.select("file_type", "t", F.inline(points)).select(
        "file_type", "t", *[(F.col("sign") * F.sum(c).over(up_to)).alias(c) for c in ("n", "f")]
    )
    totals = moments.groupBy("file_type", F.floor(t / fine).alias("slice")).agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    ahead = F.explode(F.sequence(F.col("slice") + 1, F.col("slice") + SLICES)).alias("later")
    between = totals.select("file_type", ahead, "n", "f").groupBy("file_type", F.col("later").alias("slice")).agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    inner = moments.select("file_type", "t", F.floor(t / fine).alias("slice")).join(between, ["file_type", "slice"]).select("file_type", "t", "n", "f")
    parts = edges.union(inner)
    return parts.groupBy("file_type", "t").agg(F.sum("n").alias("n_jobs"), F.sum("f").alias("n_failed")).select(
        "file_type",
        F.timestamp_micros("t").alias("ts"),
        "n_jobs",
        "n_failed",
        (F.col("n_failed") / F.col("n_jobs")).alias("error_rate"),
    )


def _brackets(spark) -> DataFrame:
    return spark.createDataFrame([(i, b) for i, b in enumerate(cat.SIZE_BRACKETS)], "bracket_order int, size_bracket string")


def duration_stats(events: DataFrame) -> DataFrame:
    """Average, least and greatest duration of successful jobs per size bracket; zeros where none."""
    stats = events.where("success").groupBy(size_bracket(F.col("size_bytes")).alias("size_bracket")).agg(
        *[F.round(fn("duration_seconds"), 2).alias(f"{label}_duration") for label, fn in (("avg", F.avg), ("min", F.min), ("max", F.max))],
        F.count("*").alias("n_jobs"),
    )
    brackets = _brackets(events.sparkSession).select("size_bracket")
    zeros = {"avg_duration": 0.0, "min_duration": 0.0, "max_duration": 0.0, "n_jobs": 0}
    return brackets.join(stats, "size_bracket", "left").fillna(zeros)


def bracket_summary(events: DataFrame) -> DataFrame:
    """Count, average and longest duration of successes, brackets without any left out."""
    return events.where("success").groupBy(size_bracket(F.col("size_bytes")).alias("size_bracket")).agg(
        F.count("*").alias("n_jobs"),
        F.round(F.avg("duration_seconds"), 2).alias("avg_duration"),
        F.max("duration_seconds").alias("max_duration"),
    )


def duration_percentiles(events: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Exact order statistics per bracket: element ``int(n * q)``, 1-based, at least the first.

    Durations are reduced to a histogram first; its running total per bracket
    locates each wanted element, so no bracket is ever gathered in one place.
    """
    wanted = shares or {"p50": 0.5, "p95": 0.95}
    jobs = events.where("success").select(size_bracket(F.col("size_bytes")).alias("size_bracket"), "duration_seconds")
    totals = jobs.groupBy("size_bracket").agg(
        F.count("*").alias("n_jobs"),
        F.round(F.avg("duration_seconds"), 2).alias("avg_duration"),
        F.min("duration_seconds").alias("min_duration"),
        F.max("duration_seconds").alias("max_duration"),
    )
    histogram = jobs.groupBy("size_bracket", "duration_seconds").agg(F.count("*").alias("n"))
    placed = running_total(histogram, ["size_bracket", "duration_seconds"], "n", restart_by="size_bracket")
    # One row per bracket: three rows at most.
    ranked = placed.join(F.broadcast(totals), "size_bracket")
    picks = []
    for label, q in wanted.items():
        position = F.greatest(F.lit(1), F.floor(F.col("n_jobs") * F.lit(q)))
        picks.append(F.min(F.when(F.col("running") >= position, F.col("duration_seconds"))).alias(label))
    return ranked.groupBy("size_bracket", "n_jobs", "avg_duration", "min_duration", "max_duration").agg(*picks)


def duration_by_type(events: DataFrame) -> DataFrame:
    return events.where("success").groupBy("file_type").agg(
        F.round(F.avg("duration_seconds"), 2).alias("avg_duration"),
        F.max("duration_seconds").alias("max_duration"),
        F.count("*").alias("n_jobs"),
    )


def entity_stats(events: DataFrame) -> DataFrame:
    return events.where("success").agg(
        F.sum("entities_found").alias("total_entities"),
        F.round(F.avg("entities_found"), 1).alias("avg_entities"),
        F.max("entities_found").alias("max_entities"),
    )


def memory_stats(events: DataFrame) -> DataFrame:
    return events.where("metric_type = 'memory'").agg(
        F.round(F.avg("memory_peak_mb"), 1).alias("avg_peak_mb"), F.max("memory_peak_mb").alias("max_peak_mb")
    )


def slow_verdict(events: DataFrame) -> DataFrame:
    counts = events.where("success").agg(
        F.count_if(F.col("duration_seconds") > cat.DURATION_WARNING_SECONDS).alias("n_slow"),
        F.count_if(F.col("duration_seconds") > cat.DURATION_ALERT_SECONDS).alias("n_very_slow"),
    )
    return counts.withColumn(
        "verdict",
        F.when(F.col("n_very_slow") > 0, F.format_string(cat.VERDICT_ALERT, "n_very_slow"))
        .when(F.col("n_slow") > 0, F.format_string(cat.VERDICT_WARNING, "n_slow"))
        .otherwise(F.lit(cat.VERDICT_GOOD)),
    )


def error_table(events: DataFrame) -> DataFrame:
    """Total, failures, rate and status per file type."""
    counted = events.groupBy("file_type").agg(
        F.count("*").alias("total"), F.sum(failed(F.col("success"))).alias("failures")
    )
    rate = F.round(F.col("failures") / F.col("total"), 3)
    return counted.withColumn("error_rate", rate).withColumn(
        "status",
        F.when(F.col("error_rate") > cat.ERROR_RATE_THRESHOLD, "ALERT").when(F.col("error_rate") > 0, "WARN").otherwise("OK"),
    )


def duration_alerts(events: DataFrame) -> DataFrame:
    """Rows for jobs over the warning or alert duration; works on a stream as well."""
    d = F.col("duration_seconds")
    return events.where(d > cat.DURATION_WARNING_SECONDS).select(
        "ts",
        "file_type",
        size_bracket(F.col("size_bytes")).alias("size_bracket"),
        F.when(d > cat.DURATION_ALERT_SECONDS, "alert").otherwise("duration_warning").alias("metric_type"),
        F.when(d > cat.DURATION_ALERT_SECONDS, cat.DURATION_ALERT)
        .otherwise(cat.DURATION_WARNING)
        .alias("message"),
        F.when(d > cat.DURATION_ALERT_SECONDS, F.round(d, 3)).otherwise(F.round(d, 2)).alias("value"),
    )


def memory_alerts(events: DataFrame) -> DataFrame:
    """Memory events above the threshold."""
    peak = F.col("memory_peak_bytes")
    return events.where(peak > cat.MEMORY_WARNING_BYTES).select(
        "ts",
        "operation",
        F.lit("memory_warning").alias("metric_type"),
        F.round(peak / F.lit(1024.0 * 1024.0), 1).alias("memory_peak_mb"),
    )


def error_rate_alerts(rates: DataFrame, threshold: float = cat.ERROR_RATE_THRESHOLD) -> DataFrame:
    return rates.where(F.col("error_rate") > threshold).withColumn(
        "message", F.format_string(cat.ERROR_RATE_ALERT, "file_type")
    )


def slowest_jobs(events: DataFrame, n: int = 10, tie_break: str = "ts") -> DataFrame:
    """Top-n report: a per-task heap of n rows, merged; no global sort."""
    return events.where("success").orderBy(F.desc("duration_seconds"), tie_break).limit(n)


# --- totals over rule logs ---------------------------------------------------

AUTO_RULES = [cat.PHONE_LOG[0], cat.EMAIL_LOG[0]]


def is_auto(rule_id: Column) -> Column:
    return rule_id.isin(AUTO_RULES)


def job_totals(logs: DataFrame) -> DataFrame:
    """Phones, e-mails and manual replacements over all logs, and their sum."""
    rule, count = F.col("ruleId"), F.col("count")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, count)), F.lit(0))

    totals = logs.agg(
        total(rule == cat.PHONE_LOG[0]).alias("total_phones"),
        total(rule == cat.EMAIL_LOG[0]).alias("total_emails"),
        total(~is_auto(rule)).alias("total_manual_replacements"),
    )
    return totals.withColumn("total_items", F.col("total_phones") + F.col("total_emails") + F.col("total_manual_replacements"))


def entities_per_file(logs: DataFrame, file_col: str) -> DataFrame:
    return logs.groupBy(file_col).agg(F.sum("count").alias("entities_found"))


def report_totals(reports: DataFrame, by: str, report_col: str = "report") -> DataFrame:
    """Sum of the per-run reports of each file."""
    r = F.col(report_col)
    return reports.groupBy(by).agg(
        F.sum(r["phone_numbers"]["count"]).alias("phones"),
        F.sum(r["emails"]["count"]).alias("emails"),
        F.sum(r["total_items"]).alias("total_items"),
    )


def split_logs(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Automatic and manual entries; the logs are written once, so that the job behind them runs once."""
    logs = stash(logs)
    return logs.where(is_auto(F.col("ruleId"))), logs.where(~is_auto(F.col("ruleId")))


def first_logs(logs: DataFrame, order_by: list[str], n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The first n entries and, as one row, how many more there are."""
    more = logs.agg(F.greatest(F.count("*") - F.lit(n), F.lit(0)).alias("n_more"))
    return logs.orderBy(*order_by).limit(n), more
