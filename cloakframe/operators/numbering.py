"""Distributed numbering, ranking, running totals and skew-safe lookups.

None of these sends a whole table or a whole group through one task:

* ``number_rows`` and ``running_total`` range-partition the rows, write them
  once, and add each partition's offset;
* ``hash_rank`` ranks by a uniform digest, so its buckets are even whatever the
  data look like;
* ``lookup_join`` splits off the most frequent keys of the rows, and NULL keys, before it shuffles.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A lookup side up to this many bytes of keys and values is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
# Bytes of keys and values, or of text, that a task of a keyed exchange gets.
TASK_BYTES = 32 * 1024 * 1024
# Keys treated as frequent.  Any other key holds less than 1/1000 of the rows.
FREQUENT_KEYS = 1000
# Rows that one sort may number.
FEW_ROWS = 100_000
_POSITION_BITS = 33
# Where a local session without spark.checkpoint.dir keeps its folder.
_LOCAL_FOLDER = "spark.cloakframe.local.dir"
# Folder of the job at hand, see ``job_scratch``.
_JOB_FOLDER = "spark.cloakframe.job.dir"


def quoted(*names: str) -> list[Column]:
    """Columns by name, whatever the names hold: dots, spaces, back-ticks."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables, as the session names it.

    Only a local session may fall back on a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_FOLDER, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set(_LOCAL_FOLDER, tempfile.mkdtemp(prefix="cloakframe-"))
    return spark.conf.get(_LOCAL_FOLDER)


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A new path in the shared folder, or in that of the job at hand; it does not exist yet."""
    folder = spark.conf.get(_JOB_FOLDER, None) or f"{shared_folder(spark)}/cloakframe"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a folder in whatever store it lies; False if there was none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def job_scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all intermediate tables written inside, removed at the end, after a failure too.

    Write the job's output inside as well: results are lazy and may read the folder.
    Originals in plain text then outlive no job.
    """
    outer = spark.conf.get(_JOB_FOLDER, None)
    folder = f"{shared_folder(spark)}/cloakframe/job-{uuid.uuid4().hex}"
    spark.conf.set(_JOB_FOLDER, folder)
    try:
        yield folder
    finally:
        spark.conf.set(_JOB_FOLDER, outer) if outer else spark.conf.unset(_JOB_FOLDER)
        remove_folder(spark, folder)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, survives the loss of executors, fixes the outcome of
    partition-dependent columns and gives the planner the real size.
    """
    path = scratch_path(df.sparkSession, "stash")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranged(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Rows in global order: ``_part`` then ``_pos`` within it."""
    position_mask = F.lit((1 << _POSITION_BITS) - 1)
    return stash(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_pos": F.monotonically_increasing_id().bitwiseAND(position_mask),
            }
        )
    )


def _offsets(per_part: DataFrame, restart_by: str | None) -> DataFrame:
    """``_offset``: sum of ``_size`` over the partitions before each one, less ``_first``.

    There is one row per partition (and group), never per data row; each group has
    a window of its own, so groups may be as many as they like.
    """
    keys = [F.col(restart_by)] if restart_by else [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")
    group = [F.col(restart_by).alias("_group")] if restart_by else []
    return per_part.select(*group, F.col("_part").alias("_in"), offset.alias("_offset"))


def _with_offsets(placed: DataFrame, offsets: DataFrame, restart_by: str | None) -> DataFrame:
    """Only offsets without groups, one per partition, are broadcast; others if the engine finds them small."""
    if restart_by is None:
        return placed.join(F.broadcast(offsets), F.col("_part") == F.col("_in"))
    return placed.join(offsets, (F.col("_part") == F.col("_in")) & F.col(restart_by).eqNullSafe(F.col("_group")))


def number_rows(
    df: DataFrame, order_by: list[str], name: str = "n", start: int = 1, restart_by: str | None = None
) -> DataFrame:
    """Consecutive numbers in the order of ``order_by`` (which should be unique).

    With ``restart_by`` (the first ordering column) the numbers restart per group,
    however many groups there are and however many rows a group has.
    """
    placed = _ranged(df, order_by)
    keys = [restart_by] if restart_by else []
    # A group may start in the middle of a partition: ``_first`` is its place there.
    per_part = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_size"), F.min("_pos").alias("_first"))
    offsets = _offsets(per_part, restart_by)
    numbered = _with_offsets(placed, offsets, restart_by)
    number = F.col("_offset") + F.col("_pos") + F.lit(start)
    return numbered.select(*df.columns, number.cast("long").alias(name))


def number_distinct(
    df: DataFrame, order_by: list[str], name: str = "n", restart_by: str | None = None, few: int = FEW_ROWS
) -> DataFrame:
    """``number_rows`` for rows that an aggregate has to make first, e.g. distinct values.

    They are written once.  Up to ``few`` of them are numbered in one sort; more are
    ranged like any rows.  The numbers are the same.
    """
    rows = stash(df)
    if rows.count() > few:
        return number_rows(rows, order_by, name, restart_by=restart_by)
    keys = [F.col(restart_by)] if restart_by else [F.lit(0)]
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)).cast("long"))


def running_total(
    df: DataFrame, order_by: list[str], weight: str, name: str = "running", restart_by: str | None = None
) -> DataFrame:
    """Inclusive running sum of ``weight`` in the order of ``order_by`` (unique)."""
    placed = _ranged(df, order_by)
    keys = [restart_by] if restart_by else []
    per_part = placed.groupBy(*keys, "_part").agg(F.sum(weight).alias("_size"), F.lit(0).alias("_first"))
    offsets = _offsets(per_part, restart_by)
    within = Window.partitionBy("_part", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_within", F.sum(weight).over(within))
    return _with_offsets(summed, offsets, restart_by).select(
        *df.columns, (F.col("_offset") + F.col("_within")).alias(name)
    )


def hash_rank(df: DataFrame, digest: Column, name: str = "rank", buckets: int | None = None) -> DataFrame:
    """Rank of each row by a hex digest that is unique per row.

    A bucket is a slice of the digest space.  Digests are uniform, so buckets
    hold equal shares; the bucket count follows the session's shuffle setting
    and does not change the result.
    """
    spark = df.sparkSession
    if buckets is None:
        buckets = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    fraction = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    keyed = df.withColumn("_digest", digest).withColumn("_bucket", F.floor(fraction * buckets).cast("int"))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    # At most ``buckets`` rows, so one window and one broadcast are fine.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest"))
    return (
        keyed.withColumn("_within", within)
        # Every bucket has its offset; a left join spares a filter that would hash twice.
        .join(F.broadcast(offsets), "_bucket", "left")
        .withColumn(name, F.col("_offset") + F.col("_within"))
        .drop("_digest", "_bucket", "_within", "_offset")
    )


def lookup_bytes(lookup: DataFrame, columns: list[str]) -> int:
    """Bytes that the given columns would take in a broadcast."""
    width = sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) + 16 for c in quoted(*columns)), F.lit(0))
    return lookup.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()["b"]


def dealt(df: DataFrame, size: int, *keys) -> DataFrame:
    """Rows dealt by key to as many tasks as ``size`` bytes ask for, so that a task's share does not grow with the table.

    The engine's own number of tasks is fixed, and small partitions are merged into fewer; what
    fits into one task is left to it.
    """
    tasks = -(-size // TASK_BYTES)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    values: list[str],
    weight: str | None = None,
    row_id: str | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Left join on unique keys that no frequent key can unbalance.

    A lookup of checked small size is broadcast.  Otherwise the ``FREQUENT_KEYS``
    most frequent keys of the rows, known to the lookup or not, are looked up by
    broadcast.  Their rows, and rows with a NULL key, go through the shuffle of
    the remaining join without a key, spread by ``row_id``.  Every row is kept.
    The rows themselves are counted; ``weight`` only keeps older calls valid.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    wanted = lookup.select(*keys, *values)
    lookup_size = lookup_bytes(wanted, keys + values)
    if lookup_size <= limit:
        return rows.join(F.broadcast(wanted), keys, "left").select(*quoted(*rows.columns), *values)
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    size = lookup_size + lookup_bytes(rows, keys + ([row_id] if row_id else []))
    top = rows.where(~no_key).groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1")
    top = stash(top.orderBy(F.col("_rows").desc(), *keys).limit(FREQUENT_KEYS).select(*keys))
    # At most FREQUENT_KEYS rows, whatever the lookup holds.
    found = wanted.join(F.broadcast(top), keys)
    frequent = top.join(found, keys, "left").select(
        *keys, F.lit(True).alias("_frequent"), *[F.col(v).alias(f"_top_{v}") for v in values]
    )
    marked = rows.join(F.broadcast(frequent), keys, "left")
    spread = F.pmod(F.xxhash64(*quoted(*([row_id] if row_id else rows.columns))), F.lit(4096)).cast("int")
    is_frequent = F.col("_frequent").isNotNull() | no_key
    keyed = marked.withColumns(
        {f"_key_{k}": F.when(is_frequent, F.lit(None)).otherwise(F.col(k)) for k in keys}
        | {"_salt": F.when(is_frequent, spread).otherwise(F.lit(0))}
    )
    # Always 0, but no literal: the optimizer would take that out of the join's keys, and all rows without a key into one task.
    zero = F.pmod(F.hash(*keys), F.lit(1))
    rest = wanted.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], zero.alias("_salt"),
        *[F.col(v).alias(f"_rest_{v}") for v in values],
    )
    places = [f"_key_{k}" for k in keys] + ["_salt"]
    joined = dealt(keyed, size, *places).join(rest, places, "left")
    return joined.select(
        *quoted(*rows.columns), *[F.coalesce(f"_top_{v}", f"_rest_{v}").alias(v) for v in values]
    )
