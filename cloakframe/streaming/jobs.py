"""Streams: the batch expressions on ``readStream``, plus state where it is needed."""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import catalogue as cat
from ..operators.mapping import allocate
from ..operators.monitor import failed
from ..plans.text_job import redact_texts

MAPPING_SCHEMA = "scope_id string, kind string, placeholder string, original string, stream string, batch bigint"
# Default trigger: run what has arrived and stop.  Give ``{"processingTime": "1 minute"}`` for a live stream.
ONCE = {"availableNow": True}


def stream_name(checkpoint: str) -> str:
    """Name of the stream that owns a checkpoint, the same after a restart."""
    return f"s{zlib.crc32(checkpoint.encode()):08x}"


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """What streams have written to a path so far, None before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """One table as a stream, whether its path is a file or a folder of files.

    The path is given as a pattern that only it fits: a stream takes a plain path for a
    folder, and a filter on file names would skip the files of a table that is one.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}")


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Exactly-once append of a stateless stream."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE)).start(path)
    )


def upsert_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Changed groups of an aggregation, one folder per batch.

    A batch that runs again overwrites its own folder, so nothing is doubled.  The
    path belongs to one checkpoint: a stream with another one is refused, since its
    counts would start anew and hide those that are there.
    """
    own = stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        there = _written(batch.sparkSession, path, "stream string, batch bigint")
        if there is not None and not there.where(F.col("stream") != own).isEmpty():
            raise ValueError(f"{path} was written by a stream with another checkpoint")
        batch.write.mode("overwrite").parquet(f"{path}/stream={own}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE)).foreachBatch(write).start()
    )


def latest(table: DataFrame, keys: list[str], batch_col: str = "batch") -> DataFrame:
    """Last state of every group written by ``upsert_to``."""
    rest = [c for c in table.columns if c not in keys and c not in (batch_col, "stream")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), batch_col).alias("_last")).select(*keys, "_last.*")


def failures(events: DataFrame) -> DataFrame:
    """Live feed of failed jobs."""
    return events.where(~F.col("success")).select(
        "ts", F.coalesce("file_type", F.lit("unknown")).alias("file_type"), F.coalesce("error", F.lit("unknown")).alias("error")
    )


def live_feed(metrics: DataFrame) -> DataFrame:
    """Failed jobs and alerts out of parsed metric events, as they arrive."""
    is_alert = F.col("metric_type") == "alert"
    unknown = F.lit("unknown")
    return metrics.where(is_alert | ~F.coalesce("success", F.lit(True))).select(
        "timestamp",
        F.when(is_alert, "ALERT").otherwise("ERROR").alias("kind"),
        F.coalesce("file_type", unknown).alias("file_type"),
        F.when(is_alert, F.coalesce("alert_message", unknown)).otherwise(F.coalesce("error", unknown)).alias("message"),
        F.when(is_alert, F.coalesce("alert_value", F.lit(0.0))).alias("value"),
    )


def sliding_error_rate(events: DataFrame, window: str = "60 minutes", slide: str = "5 minutes", lateness: str = "24 hours") -> DataFrame:
    """Error rate per file type over a sliding window, with the alert flag.

    State older than the lateness is dropped, and so are rows that come later.
    """
    rates = (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window, slide).alias("w"), "file_type")
        .agg(F.count("*").alias("n_jobs"), F.sum(failed(F.col("success"))).alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_jobs")
    return rates.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "file_type", "n_jobs", "n_failed",
        rate.alias("error_rate"), (rate > cat.ERROR_RATE_THRESHOLD).alias("alert"),
    )


def redact_stream(documents: DataFrame, rules: list | None = None, **options) -> DataFrame:
    """Documents redacted as they arrive; stateless."""
    return redact_texts(documents, rules, **options)


def allocate_stream(
    values: DataFrame, mapping_path: str, checkpoint: str, prefix: str = "ITEM", trigger: dict | None = None
) -> StreamingQuery:
    """One placeholder per value across all batches, and across streams that follow each other.

    ``values`` has ``original`` and ``seen``.  Each batch sees all entries on disk but
    those of its own folder and later ones of its stream, numbers what is new and
    writes a folder of its own; a batch that runs again writes the same folder again.
    A mapping has one writer at a time.
    """
    own = stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _written(spark, mapping_path, MAPPING_SCHEMA)
        if known is None:
            known = spark.createDataFrame([], MAPPING_SCHEMA)
        known = known.where((F.coalesce("stream", F.lit("")) != own) | (F.col("batch") < batch_id))
        allocate(batch, known, prefix).write.mode("overwrite").parquet(f"{mapping_path}/stream={own}/batch={batch_id}")

    return (
        values.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).foreachBatch(write).start()
    )
