"""Mergeable sketches beside the exact reports: kept per day, merged when somebody asks.

An exact percentile reads every duration again; a KLL sketch of a day, type and size
bracket is some kilobytes once, and merging the days of a year reads only those.  The same
holds for distinct values and HLL sketches.  Sketches of a stream's batches merge with
those of a table, so a batch adds rows and reads nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .monitor import failed, size_bracket

# Of KLL: the normalised rank of a quantile is off by less than RANK_ERROR (one-sided, 99 %).
KLL_K = 800
RANK_ERROR = 0.005
# Of HLL: 2^14 registers, standard error 0.8 %; an estimate is within 2 % with 98 % confidence.
HLL_LOG_K = 14
GROUP = ["day", "file_type", "size_bracket"]


def job_sketches(events: DataFrame) -> DataFrame:
    """Per day, file type and size bracket: counts, sum and extremes of durations of successful jobs, and their sketch.

    Partial sketches are merged, so a type that holds most of the events is no single task.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))
    duration = F.when(ok, F.col("duration_seconds"))
    return events.groupBy(F.to_date("ts").alias("day"), "file_type", size_bracket(F.col("size_bytes")).alias("size_bracket")).agg(
        F.count("*").alias("n_events"), F.sum(failed(ok)).alias("n_failed"), F.count(duration).alias("n_jobs"), F.sum(duration).alias("total_duration"),
        F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"), F.kll_sketch_agg_double(duration, F.lit(KLL_K)).alias("durations"),
    )


def merge_job_sketches(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Sketch rows of any days, batches and tables merged to one per group."""
    return sketches.groupBy(*by).agg(
        F.sum("n_events").alias("n_events"), F.sum("n_failed").alias("n_failed"), F.sum("n_jobs").alias("n_jobs"), F.sum("total_duration").alias("total_duration"),
        F.min("min_duration").alias("min_duration"), F.max("max_duration").alias("max_duration"), F.kll_merge_agg_double("durations", F.lit(KLL_K)).alias("durations"),
    )


def sketched_durations(sketches: DataFrame, *by: str | Column, shares: dict[str, float] | None = None) -> DataFrame:
    """Counts and mean exactly, percentiles within ``RANK_ERROR`` of their rank; NULL without a successful job."""
    merged = merge_job_sketches(sketches, *by)
    names = [c for c in merged.columns if c not in ("n_events", "n_failed", "total_duration", "durations", "n_jobs", "min_duration", "max_duration")]
    some = F.col("n_jobs") > 0
    picks = [F.when(some, F.kll_sketch_get_quantile_double("durations", F.lit(q))).alias(n) for n, q in (shares or {"p50": 0.5, "p95": 0.95}).items()]
    mean = F.round(F.col("total_duration") / F.col("n_jobs"), 2).alias("avg_duration")
    return merged.select(*names, "n_events", "n_failed", "n_jobs", mean, "min_duration", "max_duration", *picks)


def sketched_ranks(sketches: DataFrame, value: Column, *by: str | Column) -> DataFrame:
    """Share of successful jobs that took ``value`` seconds or less."""
    merged = merge_job_sketches(sketches, *by)
    rank = F.when(F.col("n_jobs") > 0, F.kll_sketch_get_rank_double("durations", value.cast("double")))
    return merged.withColumn("share", rank).drop("durations")


def value_sketches(values: DataFrame, *by: str | Column, value_col: str = "original") -> DataFrame:
    """Distinct-count sketches of values, and how many there were."""
    return values.groupBy(*by).agg(F.count(value_col).alias("n_matches"), F.hll_sketch_agg(F.col(value_col).cast("string"), HLL_LOG_K).alias("distinct"))


def approximate_distinct(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Estimated distinct values of merged sketches, within 2 %; an opt-in beside the exact profile."""
    merged = sketches.groupBy(*by).agg(F.sum("n_matches").alias("n_matches"), F.hll_union_agg("distinct").alias("distinct"))
    return merged.withColumn("n_values", F.hll_sketch_estimate("distinct")).drop("distinct")


def sketch_stream(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the sketches of every batch to a table; a batch that runs again overwrites its own folder."""
    from ..streaming.jobs import ONCE, stream_name

    own = stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        job_sketches(batch).write.mode("overwrite").parquet(f"{path}/stream={own}/batch={batch_id}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).foreachBatch(write).start()
