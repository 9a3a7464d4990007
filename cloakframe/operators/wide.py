"""Many columns of a table against one lookup: cells travel as narrow rows, the table at most once.

A lookup per column would read the table's rows, whole, through a join per column.  Here the
cells of all columns are one table ``(row, column, key)``, which meets the lookup in one
join that frequent values do not unbalance; what it finds is gathered per row again.  A
lookup of checked small size is broadcast, and then the table is not shuffled at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import BROADCAST_BYTES, lookup_bytes, lookup_join, number_distinct, quoted, stash


def narrow_cells(df: DataFrame, columns: list[str], *keep) -> DataFrame:
    """``(…keep, column_name, key)``: a row per cell that is not NULL, as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c)[0].cast("string").alias("key")) for c in columns])
    kept = df.select(*keep).columns
    return df.select(*keep, F.explode(cells).alias("_cell")).select(*kept, "_cell.*").where("key is not null")


def number_columns(frames: list[DataFrame], columns: list[str], row_order) -> DataFrame:
    """``(column_name, key, n)``: the distinct values of every column, numbered by first appearance.

    Tables share the numbering, in table order; ``row_order`` gives the Column that orders
    a table's rows.  One exchange of narrow rows and one sort, for however many columns.
    """
    parts = [
        narrow_cells(df, [c for c in columns if c in df.columns], F.struct(F.lit(i).alias("table"), row_order.alias("row")).alias("_at"))
        for i, df in enumerate(frames) if any(c in df.columns for c in columns)
    ]
    values = reduce(DataFrame.unionByName, parts).groupBy("column_name", "key").agg(F.min("_at").alias("first"))
    return number_distinct(values, ["column_name", "first", "key"], "n", restart_by="column_name").select("column_name", "key", "n")


def found_name(i: int) -> str:
    return f"_found_{i}"


def lookup_columns(df: DataFrame, lookup: DataFrame, columns: list[str], broadcast_bytes: int | None = None) -> DataFrame:
    """Adds ``_found_0``, ``_found_1`` … : the ``value`` of ``lookup (column_name, key, value)`` for each column's cell.

    A cell that is NULL or unknown finds NULL; every row is kept once.  ``lookup`` has a
    row per column and key, and is read more than once: give a written table.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    wanted = lookup.where(F.col("column_name").isin(columns)).select("column_name", "key", "value")
    if lookup_bytes(wanted, ["column_name", "key", "value"]) <= limit:
        out = df
        for i, column in enumerate(columns):
            own = wanted.where(F.col("column_name") == column).select(F.col("key").alias(f"_key_{i}"), F.col("value").alias(found_name(i)))
            out = out.join(F.broadcast(own), quoted(column)[0].cast("string") == F.col(f"_key_{i}"), "left").drop(f"_key_{i}")
        return out
    rows = stash(df.withColumn("_row", F.monotonically_increasing_id()))
    found = lookup_join(narrow_cells(rows, columns, "_row"), wanted, ["column_name", "key"], ["value"], row_id="_row", broadcast_bytes=limit)
    each = [F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(found_name(i)) for i, c in enumerate(columns)]
    gathered = found.where("value is not null").groupBy("_row").agg(*each)
    return rows.join(gathered, "_row", "left").drop("_row")
