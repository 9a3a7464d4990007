"""Removing stored rows: sessions and what is older than the retention period, by partition folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..functions.validators import is_canonical_uuid
from ..operators.admission import newer_than
from ..operators.numbering import remove_folder, stash


def remove_session(spark: SparkSession, path: str, session_id: str, session_col: str = "session_id") -> bool:
    """Delete the folder of one session from a table partitioned by session.

    An id that is no canonical UUID removes nothing.  True if the folder was there.
    """
    canonical = spark.range(1).select(is_canonical_uuid(F.lit(session_id)).alias("ok")).first()["ok"]
    return bool(canonical) and remove_folder(spark, f"{path}/{session_col}={session_id}")


def purge(spark: SparkSession, path: str, ts_col: str, now: Column, hours: int = cat.RETENTION_HOURS, day_col: str = "dt") -> int:
    """Remove rows older than the retention period from a table partitioned by day; the number of days touched.

    Days that are too old as a whole lose their folder; a day that the limit cuts is
    written again from a copy in the scratch folder.  Other days are not read: only
    the first and last time of a day are, and there is one row per day.
    """
    table = spark.read.parquet(path)
    cutoff = F.timestamp_add("HOUR", F.lit(-hours), now)
    days = table.groupBy(F.col(day_col).cast("string").alias("day")).agg(F.min(ts_col).alias("first"), F.max(ts_col).alias("last"))
    touched = days.where(F.col("first") <= cutoff).select("day", (F.col("last") <= cutoff).alias("whole")).collect()
    for row in touched:
        if row["whole"]:
            remove_folder(spark, f"{path}/{day_col}={row['day']}")
    cut = [row["day"] for row in touched if not row["whole"]]
    if cut:
        kept: DataFrame = newer_than(table.where(F.col(day_col).cast("string").isin(cut)), ts_col, now, hours)
        kept = stash(kept)  # its own files are about to be replaced
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path)
    return len(touched)
