"""Writers for texts, tables, mappings, logs and metric events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..operators.columns import escape_all_formulas, escape_header
from ..operators.mapping import encrypt_mapping
from ..operators.monitor import size_bracket


def write_texts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_table_csv(df: DataFrame, path: str, mode: str = "errorifexists", escape: bool = True) -> None:
    """CSV that spreadsheet programs open as UTF-8: every file starts with a byte order mark."""
    out = escape_all_formulas(df) if escape else df
    names = [escape_header(c) if escape else c for c in out.columns]
    if names:
        names[0] = "\ufeff" + names[0]
    writer = out.toDF(*names).write.mode(mode).option("header", "true").option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    writer.option("emptyValue", "").csv(path)


def write_mapping(mapping: DataFrame, path: str, key=None, mode: str = "append") -> None:
    """Mapping table; originals are encrypted when a key is given."""
    (mapping if key is None else encrypt_mapping(mapping, key)).write.mode(mode).parquet(path)


def write_rule_log(logs: DataFrame, path: str) -> None:
    logs.write.mode("append").parquet(path)


def audit_events(df: DataFrame, action: str, session_id: Column, ts: Column, **details: Column) -> DataFrame:
    """``(ts, session_id, action, details)``; details that are NULL are left out."""
    if action not in cat.AUDIT_ACTIONS:
        raise ValueError(f"unknown audit action: {action}")
    entries = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in details.items()]
    return df.select(
        ts.alias("ts"),
        session_id.alias("session_id"),
        F.lit(action).alias("action"),
        F.map_from_entries(F.array_compact(F.array(*entries))).alias("details"),
    )


def audit_line(keys: list[str]) -> Column:
    """Text form of an audit event, with the given detail keys in order."""
    parts = [F.concat(F.lit(f"{k}="), F.try_element_at("details", F.lit(k))) for k in keys]
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat_ws(" ", stamp, F.concat(F.lit("[SESSION:"), "session_id", F.lit("]")), "action", *parts)


def append_audit(events: DataFrame, path: str) -> None:
    """Append to the audit table, one folder per day.

    ``rebalance`` gathers a day into few files and splits a day that is too big for one.
    """
    dated = events.withColumn("dt", F.to_date("ts")).hint("rebalance", "dt")
    dated.write.mode("append").partitionBy("dt").parquet(path)


def metric_events(jobs: DataFrame) -> DataFrame:
    """Metric event rows from finished jobs: size bracket, megabytes, rounded durations."""
    return jobs.select(
        F.col("ts").alias("timestamp"),
        F.lit("INFO").alias("level"),
        F.lit("metrics").alias("logger"),
        F.when(F.col("success"), "processing_complete").otherwise("processing_error").alias("message"),
        F.lit("processing").alias("metric_type"),
        "file_type",
        size_bracket(F.col("size_bytes")).alias("size_bracket"),
        F.round("duration_seconds", 2).alias("duration_seconds"),
        F.round(F.col("size_bytes") / F.lit(1024.0 * 1024.0), 2).alias("file_size_mb"),
        "entities_found",
        "success",
        "error",
    )


def memory_events(jobs: DataFrame) -> DataFrame:
    """Memory event rows: peak and current in megabytes."""
    megabytes = lambda c: F.round(F.col(c) / F.lit(1024.0 * 1024.0), 1)
    return jobs.select(
        F.col("ts").alias("timestamp"),
        F.lit("memory_usage").alias("message"),
        F.lit("memory").alias("metric_type"),
        "operation",
        megabytes("memory_peak_bytes").alias("memory_peak_mb"),
        megabytes("memory_current_bytes").alias("memory_current_mb"),
    )


def alert_events(alerts: DataFrame) -> DataFrame:
    """Metric event rows for ``(ts, file_type, size_bracket, message, value)`` alerts."""
    value = F.round("value", 3)
    return alerts.select(
        F.col("ts").alias("timestamp"),
        F.lit("CRITICAL").alias("level"),
        F.lit("metrics").alias("logger"),
        F.format_string(cat.ALERT_LINE, "message", value).alias("message"),
        F.lit("alert").alias("metric_type"),
        "file_type",
        "size_bracket",
        F.col("message").alias("alert_message"),
        value.alias("alert_value"),
    )


def append_metrics(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def output_name(file_id: Column, original_name: Column, ts: Column) -> Column:
    """``{file_id}_{base}_ann_{HHMM}.{ext}``."""
    stamp = F.date_format(ts, "HHmm")
    base = F.regexp_replace(original_name, r"\.[^.]*$", "")
    ext = F.when(F.contains(original_name, F.lit(".")), F.concat(F.lit("."), F.substring_index(original_name, ".", -1)))
    return F.concat(file_id, F.lit("_"), base, F.lit("_ann_"), stamp, F.coalesce(ext, F.lit("")))


def display_name(output: Column) -> Column:
    """Output name without the file id in front."""
    return F.regexp_replace(output, r"^[^_]+_", "")
