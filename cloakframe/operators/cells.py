"""Column rules on cells in long form: every file, sheet and column of a job at once.

A row is a cell ``(path, part, row_idx, col_idx, header, text)``.  Whatever needs other cells
is one pass for all columns: types are counted per column of a sheet, values are numbered
per header by first appearance over all files, permutations draw ranks within a column of a
sheet.  No column, sheet or file is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import (
    REQUIRED_TYPE, ColumnRule, escape_formula, is_numbered, masked_value, mostly, numbered_name, numbered_placeholder, parse_column_rules, rejection, value_kinds,
)
from .keyed_order import permuted
from .numbering import lookup_join, number_rows, stash

PLACE = ["path", "part", "row_idx", "col_idx"]
NO_SUCH_COLUMN = "No file has a column '%s'"
_TYPES = ("number", "date", "text")


@dataclass
class MaskedCells:
    """``cells`` with ``redacted`` (NULL where no rule ran) and what was done.

    ``mapping``: ``(scope_id, kind, placeholder, original)``; kind ``column`` for the
    placeholders of a header, ``cell`` for one cell.  ``rejected``: ``(path, part, column,
    ruleId, reason)``.  ``logs``: ``(path, ruleId, appliedPattern, n)``.
    """

    cells: DataFrame
    mapping: DataFrame | None
    rejected: DataFrame
    logs: DataFrame


def ruled(cell_header: Column, rules: list) -> Column:
    """Whether some rule names the header."""
    names = sorted({r.column_name for r in parse_column_rules(rules)})
    return F.coalesce(cell_header.isin(names), F.lit(False)) if names else F.lit(False)


def _judged(cells: DataFrame, rules: list[ColumnRule]) -> tuple[DataFrame, DataFrame]:
    """Cells with ``_type`` of their column where a rule asks for it, and the columns' types."""
    asking = sorted({r.column_name for r in rules if r.anonymization_type in REQUIRED_TYPE})
    counted = cells.groupBy("path", "part", "header").agg(*value_kinds(F.when(F.col("header").isin(asking), F.col("text"))))
    types = stash(counted.select("path", "part", "header", mostly().alias("_type")))
    if not asking:
        return cells.withColumn("_type", F.lit("text")), types
    lookup = types.select(F.col("path").alias("_path"), F.col("part").alias("_part"), F.col("header").alias("_header"), "_type")
    keyed = cells.withColumns({"_path": F.col("path"), "_part": F.col("part"), "_header": F.when(F.col("header").isin(asking), F.col("header"))})
    joined = lookup_join(keyed, lookup, ["_path", "_part", "_header"], ["_type"])
    return joined.withColumn("_type", F.coalesce("_type", F.lit("text"))).drop("_path", "_part", "_header"), types


def _runs(rule: ColumnRule) -> Column:
    """Whether the rule runs on a cell's column."""
    fits = [t for t in _TYPES if rejection(rule, t) is None]
    return (F.col("header") == rule.column_name) & F.col("_type").isin(fits)


def _rejected(cells: DataFrame, types: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """A row per rule and column that it does not fit, and per rule whose column no file has."""
    spark = cells.sparkSession
    refusals = [(r.column_name, r.id, t, rejection(r, t)) for r in rules for t in _TYPES if rejection(r, t)]
    refused = spark.createDataFrame(refusals, "header string, ruleId string, _type string, reason string")
    unfit = types.join(F.broadcast(refused), ["header", "_type"]).select("path", "part", F.col("header").alias("column"), "ruleId", "reason")
    named = spark.createDataFrame([(r.column_name, r.id, NO_SUCH_COLUMN % r.column_name) for r in rules], "column string, ruleId string, reason string")
    known = types.select(F.col("header").alias("column")).distinct()
    none = F.lit(None).cast("string")
    missing = named.join(known, "column", "left_anti").select(none.alias("path"), none.alias("part"), "column", "ruleId", "reason")
    return unfit.unionByName(missing)


def _numbered(cells: DataFrame, rules: list[ColumnRule]) -> tuple[DataFrame, DataFrame]:
    """Number the current values of all the rules' columns in one pass; cells with ``_n``, and the numbers."""
    runs = reduce(Column.__or__, [_runs(r) for r in rules])
    keyed = cells.withColumns({"_key": F.when(runs & F.col("_new").isNotNull(), F.col("header")), "_value": F.col("_new")})
    first = F.min(F.struct(*PLACE)).alias("first")
    values = keyed.where("_key is not null").groupBy("_key", "_value").agg(first)
    numbers = number_rows(values, ["_key", "first", "_value"], "_n", restart_by="_key").select("_key", "_value", "_n")
    numbers = stash(numbers)
    return lookup_join(keyed, numbers, ["_key", "_value"], ["_n"]).drop("_value"), numbers


def _layers(rules: list[ColumnRule]) -> list[list[ColumnRule]]:
    """Rules in order; rules of one layer are on different columns."""
    depth: dict[str, int] = {}
    layers: list[list[ColumnRule]] = []
    for rule in rules:
        at = depth[rule.column_name] = depth.get(rule.column_name, -1) + 1
        layers += [[] for _ in range(at + 1 - len(layers))]
        layers[at].append(rule)
    return layers


def mask_cells(cells: DataFrame, rules: list, salt, reversible: bool = False, escape: bool = True) -> MaskedCells:
    """All kinds of column rules on cells; shuffles first, then the others in list order per column.

    ``cells`` holds data cells only, no header row.  A NULL cell stays NULL and is in no
    log.  A column keeps one numbering over all files; a shuffle stays within a column of a
    sheet and permutes the cells that hold a value.  Where a rule does not fit a column, or
    no file has its column, it is listed in ``rejected`` and runs on no cell.  With ``reversible`` the
    mapping restores every masked cell: by header and placeholder where a numbered
    placeholder is the column's only rule, else by the cell's place.
    """
    parsed = parse_column_rules(rules)
    ordered = [r for r in parsed if r.anonymization_type == "shuffle"] + [r for r in parsed if r.anonymization_type != "shuffle"]
    columns = cells.columns
    out, types = _judged(cells.where(F.col("header").isNotNull()), parsed)
    out = out.withColumns({"_new": F.col("text"), "_hits": F.array().cast("array<int>")})
    mappings, spoken = [], set()
    several = {r.column_name for r in parsed if sum(o.column_name == r.column_name for o in parsed) > 1}
    for layer in _layers(ordered):
        shuffled = [r for r in layer if r.anonymization_type == "shuffle"]
        numbered = [r for r in layer if is_numbered(r)]
        if shuffled:
            moves = reduce(Column.__or__, [_runs(r) for r in shuffled]) & F.col("_new").isNotNull()
            out = permuted(out, moves, ["path", "part", "header"], PLACE, "_new", salt)
        if numbered:
            out, numbers = _numbered(out, numbered)
            for rule in numbered:
                if rule.reversible and rule.column_name not in several:
                    spoken.add(rule.column_name)
                    own = numbers.where(F.col("_key") == rule.column_name).withColumnRenamed("_n", "n")
                    mappings.append(own.select(column_scope(F.col("_key")).alias("scope_id"), F.lit("column").alias("kind"), numbered_placeholder(rule).alias("placeholder"), F.col("_value").alias("original")))
            out = out.withColumnRenamed("_n", "n")
        new, hits = F.col("_new"), F.col("_hits")
        for rule in layer:
            if rule in shuffled:
                value = F.col("_new")
            elif rule in numbered:
                value = numbered_placeholder(rule) if rule.reversible else numbered_name(rule)
            else:
                value = masked_value(rule, F.col("_new"), T.StringType(), salt)
            if escape and rule.anonymization_type not in REQUIRED_TYPE:  # a number may be negative
                value = escape_formula(value)
            runs = _runs(rule) & F.col("_new").isNotNull()
            new = F.when(runs, value).otherwise(new)
            hits = F.when(runs, F.concat(F.col("_hits"), F.array(F.lit(ordered.index(rule))))).otherwise(hits)
        out = out.withColumns({"_new": new, "_hits": hits}).drop("n", "_key")
    hit = F.size("_hits") > 0
    # Several lazy results come from here, and ranks are not drawn twice.
    done = stash(out.select(*columns, F.when(hit, F.col("_new")).alias("redacted"), "_hits"))
    listed = cells.sparkSession.createDataFrame([(i, r.id, r.column_name) for i, r in enumerate(ordered)], "_hit int, ruleId string, appliedPattern string")
    counted = done.select("path", F.explode("_hits").alias("_hit")).groupBy("path", "_hit").agg(F.count("*").alias("n"))
    logs = counted.join(F.broadcast(listed), "_hit").select("path", "ruleId", "appliedPattern", "n")
    if reversible:
        by_place = done.where(hit & ~F.col("header").isin(sorted(spoken)) if spoken else hit)
        mappings.append(by_place.select(cell_scope().alias("scope_id"), F.lit("cell").alias("kind"), F.col("redacted").alias("placeholder"), F.col("text").alias("original")))
    mapping = reduce(DataFrame.unionByName, mappings) if mappings else None
    return MaskedCells(done.drop("_hits"), mapping, _rejected(cells, types, parsed), logs)


def column_scope(header: Column) -> Column:
    """Scope of a header's placeholders in a mapping."""
    return F.concat(F.lit("column|"), header)


def cell_scope() -> Column:
    """Scope of one cell in a mapping."""
    return F.concat_ws("|", F.lit("cell"), *[F.col(c).cast("string") for c in PLACE])


def restore_masked_cells(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds ``restored`` to cells with ``redacted``, from a mapping of ``mask_cells``; other cells keep their text.

    Cells meet entries of their own place in one join, placeholders of their header in
    another that frequent values do not unbalance.
    """
    entries = mapping.where(F.col("kind").isin("cell", "column")).groupBy("kind", "scope_id", "placeholder").agg(F.min("original").alias("original"))
    entries = stash(entries)
    by_place = entries.where("kind = 'cell'").select(F.col("scope_id").alias("_scope"), F.col("placeholder").alias("_shown"), F.col("original").alias("_own"))
    placed = cells.withColumn("_scope", cell_scope()).join(by_place, "_scope", "left")
    own = F.when(F.col("_shown").eqNullSafe(F.col("redacted")), F.col("_own"))
    placed = placed.withColumn("_own", own).drop("_shown", "_scope")
    by_header = entries.where("kind = 'column'").select(F.col("scope_id").alias("_header"), F.col("placeholder").alias("_token"), F.col("original").alias("_value"))
    asks = F.when(F.col("_own").isNull() & F.col("header").isNotNull(), F.col("redacted"))
    keyed = placed.withColumns({"_header": column_scope(F.col("header")), "_token": asks})
    joined = lookup_join(keyed, by_header, ["_header", "_token"], ["_value"])
    return joined.withColumn("restored", F.coalesce("_own", "_value", "redacted")).select(*cells.columns, "restored")
