"""Placeholders on a stream from keyed state: a batch costs what it brings, not what the mapping holds.

Values are dealt to key groups by hash.  A group keeps the numbers of its values in a state
store, looked up by value, and hands out new ones from blocks of its own: block b of group
g is the (b * groups + g)-th of all blocks, so no two groups ever meet.  Numbers therefore
have gaps.  A restart finds its state in the checkpoint; a stream with another checkpoint
takes over what earlier ones have written as initial state, once, and counts on behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.mapping import last_number, suffix_number
from .jobs import ONCE, _written, stream_name

ENTRY = "scope_id string, kind string, placeholder string, original string"
GROUPS = 256
BLOCK = 16
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """All entries that streams have written to a path; empty before the first batch."""
    there = _written(spark, path, ENTRY)
    # A batch that ran again has written the same entries again.
    return spark.createDataFrame([], ENTRY) if there is None else there.select("scope_id", "kind", "placeholder", "original").distinct()


def group_of(original, groups: int):
    return F.pmod(F.xxhash64(original), F.lit(groups)).cast("int")


class _Allocator(StatefulProcessor):
    """State of a key group: the number of each value, and how many numbers it has given out."""

    def __init__(self, prefix: str, scope: str, groups: int, block: int, start: int):
        self.prefix, self.scope, self.groups, self.block, self.start = prefix, scope, groups, block, start

    def init(self, handle) -> None:
        self.known = handle.getMapState("known", "original string", "number long")
        self.given = handle.getValueState("given", "n long")

    def _number(self, group: int, n: int) -> int:
        block, place = divmod(n, self.block)
        return self.start + (block * self.groups + group) * self.block + place + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}
        for frame in rows:
            for original, seen in zip(frame["original"], frame["seen"], strict=True):
                first[original] = min(seen, first.get(original, seen))
        given = self.given.get()[0] if self.given.exists() else 0
        # Nothing was given out and nothing taken over: no value is known, and none is asked for.
        unknown = not given and not self.start
        new = [o for o in sorted(first, key=lambda o: (first[o], o)) if unknown or not self.known.containsKey((o,))]
        entries = []
        for n, original in enumerate(new, start=given):
            number = self._number(int(key[0]), n)
            self.known.updateValue((original,), (number,))
            entries.append((self.scope, "item", f"[{self.prefix}_{number}]", original))
        if new:
            self.given.update((given + len(new),))
        yield pd.DataFrame(entries, columns=["scope_id", "kind", "placeholder", "original"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for original, number in zip(initialState["original"], initialState["number"], strict=True):
            self.known.updateValue((original,), (int(number),))

    def close(self) -> None:
        pass


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A value's first row of every Arrow batch, so that a frequent value costs its group a row per batch."""
    for batch in batches:
        if batch.num_rows:
            grouped = pa.Table.from_batches([batch]).group_by("original").aggregate([("seen", "min")])
            yield from pa.table([grouped.column("original"), grouped.column("seen_min")], names=["original", "seen"]).to_batches()


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, while a query starts."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _start(spark: SparkSession, mapping_path: str, checkpoint: str) -> int:
    """Highest number before the stream's first batch; written beside its checkpoint, so that restarts agree."""
    path = f"{checkpoint.rstrip('/')}-start"
    there = _written(spark, path, "start bigint")
    if there is None:
        spark.createDataFrame([(last_number(read_mapping(spark, mapping_path)),)], "start bigint").write.mode("overwrite").parquet(path)
        there = _written(spark, path, "start bigint")
    return there.first()["start"]


def allocate_keyed(
    values: DataFrame, mapping_path: str, checkpoint: str, prefix: str = "ITEM", scope: str = "corpus", groups: int = GROUPS, block: int = BLOCK,
    trigger: dict | None = None,
) -> StreamingQuery:
    """One placeholder per value across all batches, restarts, and streams that follow each other.

    ``values`` is a stream with ``original`` and ``seen``; NULL originals get none.  New
    entries are appended to a folder of the stream below ``mapping_path``; read them with
    ``read_mapping``.  ``groups`` and ``block`` belong to the checkpoint and must not change
    while it is used.  A mapping has one writer at a time.
    """
    spark = values.sparkSession
    start = _start(spark, mapping_path, checkpoint)
    own = stream_name(checkpoint)
    # Entries of other streams, with the number of each; this stream's are in its state.
    earlier = _written(spark, mapping_path, ENTRY + ", stream string")
    number = suffix_number(F.col("placeholder"))
    if earlier is None:
        earlier = spark.createDataFrame([], ENTRY + ", stream string")
    earlier = earlier.where((F.col("stream") != own) & (F.col("scope_id") == scope) & (number <= start))
    earlier = earlier.groupBy("original").agg(F.min(number).alias("number")).withColumn("_group", group_of("original", groups))
    asked = values.where(F.col("original").isNotNull()).select(F.col("original").cast("string").alias("original"), F.col("seen").cast("long").alias("seen"))
    asked = asked.mapInArrow(_once_per_task, "original string, seen long").withColumn("_group", group_of("original", groups))
    with _state_store(spark):
        entries = asked.groupBy("_group").transformWithStateInPandas(
            _Allocator(prefix, scope, groups, block, start), outputStructType=ENTRY, outputMode="Append", timeMode="None",
            initialState=earlier.groupBy("_group"),
        )
        return (
            entries.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ONCE)).start(f"{mapping_path}/stream={own}")
        )
