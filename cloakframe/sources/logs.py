"""Readers for metric events and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = (
    "timestamp timestamp, level string, logger string, message string, metric_type string, file_type string, "
    "size_bracket string, duration_seconds double, file_size_mb double, entities_found bigint, success boolean, "
    "error string, error_rate double, memory_peak_mb double, memory_current_mb double, operation string, "
    "alert_message string, alert_value double"
)
AUDIT_LINE = r"^(\S+) \[SESSION:([^\]]*)\] (\S+) ?(.*)$"
# Keys of an audit line whose values hold no spaces; ``error`` runs to the end.
AUDIT_KEYS = ["file", "type", "rules_applied", "mappings", "encrypted", "mappings_applied"]


def read_metrics(spark: SparkSession, path: str, metric_type: str | None = "processing") -> DataFrame:
    """Metric events from JSON lines; lines that are no JSON are left out."""
    events = spark.read.schema(METRIC_SCHEMA).json(path).where(F.col("metric_type").isNotNull())
    return events.where(F.col("metric_type") == metric_type) if metric_type else events


def parse_metrics(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Metric events from a column of log lines, e.g. of a stream."""
    parsed = lines.select(F.from_json(F.col(line_col), METRIC_SCHEMA).alias("event")).select("event.*")
    return parsed.where(F.col("metric_type").isNotNull())


def parse_audit(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``(ts, session_id, action, details)`` from audit lines; ``unparsed_audit`` has the others.

    Files may hold spaces or be nameless; a value ends where the next known key
    begins.  Old lines carry a literal ``%f`` for the fraction of the second.
    """
    line, head = F.col(line_col), AUDIT_LINE
    whole = F.regexp_extract(line, head, 4)
    rest = F.regexp_replace(whole, r"(?:^| )error=.*$", "")
    stamp = F.regexp_replace(F.regexp_extract(line, head, 1), r"\.%f", "")
    next_key = "(?= (?:" + "|".join(AUDIT_KEYS + ["error"]) + ")=|$)"

    def value(key: str) -> Column:
        found = F.regexp_extract(rest, rf"(?:^| ){key}=(.*?){next_key}", 1)
        return F.when(rest.rlike(rf"(?:^| ){key}="), F.struct(F.lit(key).alias("key"), found.alias("value")))

    error = F.regexp_extract(whole, r"(?:^| )error=(.*)$", 1)
    pairs = F.array_compact(
        F.array(
            *[value(k) for k in AUDIT_KEYS],
            F.when(error != "", F.struct(F.lit("error").alias("key"), error.alias("value"))),
        )
    )
    return lines.where(line.rlike(head)).select(
        stamp.try_cast("timestamp").alias("ts"),
        F.regexp_extract(line, head, 2).alias("session_id"),
        F.regexp_extract(line, head, 3).alias("action"),
        F.map_from_entries(pairs).alias("details"),
    )


def unparsed_audit(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``(line, error)``: the lines that ``parse_audit`` cannot read; empty ones do not count."""
    line = F.col(line_col)
    return lines.where(~line.rlike(AUDIT_LINE) & (F.trim(line) != "")).select(
        line.alias("line"), F.lit("no audit line").alias("error")
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return parse_audit(spark.read.text(path))
