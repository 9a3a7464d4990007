"""Permutations within groups of any size, by two keyed orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keyed_digest
from .numbering import number_rows, quoted


def permuted(df: DataFrame, moves: Column, group: list[str], place: list[str], value: str, salt) -> DataFrame:
    """``df`` with ``value`` permuted within each group among the rows for which ``moves`` holds.

    ``place`` is unique per row.  Rows are numbered by one keyed digest of their place and
    values by another; equal numbers of a group meet in a join.  Numbering is distributed,
    so a group may hold most of the rows.
    """
    name = F.to_json(F.struct(*quoted(*group)))
    where = F.to_json(F.struct(*quoted(*place)))
    stay = df.where(~F.coalesce(moves, F.lit(False)))
    moving = df.where(moves).withColumn("_among", name)
    slots = number_rows(moving.withColumn("_slot", keyed_digest(where, salt, "slot")), ["_among", "_slot"], "_turn", restart_by="_among")
    given = moving.select("_among", quoted(value)[0].alias("_given"), keyed_digest(where, salt, "value").alias("_draw"))
    given = number_rows(given, ["_among", "_draw"], "_turn", restart_by="_among").select("_among", "_turn", "_given")
    moved = slots.join(given, ["_among", "_turn"]).withColumn(value, F.col("_given"))
    return moved.select(*quoted(*df.columns)).unionByName(stay)
