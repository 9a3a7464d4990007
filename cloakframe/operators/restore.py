"""Putting originals back into redacted texts and masked tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PLACEHOLDER_TOKEN, each_value, rewrite_tokens
from .known import key_filter
from .mapping import latest_entries, originals_by_scope
from .numbering import dealt, lookup_bytes, lookup_join, quoted, stash
from .wide import found_name, lookup_columns


def restore_with_pairs(text: Column, pairs: Column) -> Column:
    """Restore from a small array of ``(placeholder, original)`` in the row; exact literal replacement."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["placeholder"], p["original"]))


# Different tokens of a text that are held against the filter of known ones.
TESTED_TOKENS = 8
# Entries of a driver-side mapping; each is an expression of its own.
MOST_PAIRS = 500


def restore_with_dict(text: Column, mapping: dict[str, str]) -> Column:
    """Restore from a small driver-side mapping, whatever its placeholders look like.

    More than ``MOST_PAIRS`` entries are refused; ``restore_cells`` takes a mapping of any size.
    """
    if len(mapping) > MOST_PAIRS:
        raise ValueError(f"{len(mapping)} entries; restore_cells takes a mapping of any size")
    restored = text
    for placeholder, original in mapping.items():
        restored = F.replace(restored, F.lit(placeholder), F.lit(original))
    return restored


def _restore_by_map(text: Column, originals: Column) -> Column:
    return F.when(originals.isNull(), text).otherwise(
        rewrite_tokens(text, PLACEHOLDER_TOKEN, lambda token: F.coalesce(originals[token], token))
    )


def _with_tokens(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Texts that hold a placeholder, and those that pass through without a join."""
    marked = F.coalesce(F.col(text_col).rlike(PLACEHOLDER_TOKEN), F.lit(False))
    return df.where(marked), df.where(~marked)


def _finish(joined: DataFrame, untouched: DataFrame, text_col: str, output_col: str) -> DataFrame:
    restored = joined.withColumn(output_col, _restore_by_map(F.col(text_col), F.col("_originals")))
    return restored.select(*untouched.columns, output_col).unionByName(untouched.withColumn(output_col, F.col(text_col)))


def restore_documents(df: DataFrame, mapping: DataFrame, id_col: str, text_col: str = "redacted", output_col: str = "restored") -> DataFrame:
    """Restore with document-scoped mappings: one join on the document id.

    Of several entries for a placeholder the latest counts, see ``latest_entries``.
    """
    marked, untouched = _with_tokens(df, text_col)
    # The entries of one document, so no larger than the document.
    per_document = originals_by_scope(mapping)
    joined = marked.join(per_document, F.col(id_col).cast("string") == F.col("scope_id"), "left")
    return _finish(joined, untouched, text_col, output_col)


def restore_corpus(
    df: DataFrame, mapping: DataFrame, id_col: str, text_col: str = "redacted", output_col: str = "restored", scope_col: str | None = None,
    skip_unknown: bool = False,
) -> DataFrame:
    """Restore with one corpus-wide mapping of any size, or one per ``scope_col`` (e.g. a session).

    Only the distinct tokens of each document meet the mapping, never the texts;
    a token that stands in a third of all documents is looked up by broadcast.
    Documents may share an id; of several entries for a placeholder the latest counts.
    ``skip_unknown`` is for corpora in which most tokens are in no mapping: one more pass
    over the mapping builds a filter of its keys, and texts without a token that
    passes it, like tokens that do not, are not shuffled (see ``known``).  A text with more
    than ``TESTED_TOKENS`` different tokens is looked up in any case.
    """
    marked, untouched = _with_tokens(df, text_col)
    in_text = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(PLACEHOLDER_TOKEN), F.lit(0)))
    known = key_filter(mapping, ["scope_id", "placeholder"] if scope_col else ["placeholder"]) if skip_unknown else None
    if known:
        of_scope = [F.col(scope_col).cast("string")] if scope_col else []
        # The number keeps the tests behind the projection, so that tokens are listed once.  Nothing
        # between the two makes rows of the columns, so the filter's bits are not copied.
        listed = df.withColumns({"_tokens": in_text, "_bits": known.bits, "_turn": F.monotonically_increasing_id()})
        here = replace(known, bits=F.col("_bits"))
        some = F.size("_tokens") > TESTED_TOKENS
        for i in range(TESTED_TOKENS):
            some = some | here.might_hold(*of_scope, F.get("_tokens", F.lit(i)))
        some = F.coalesce(some, F.lit(False))
        marked, untouched = (listed.where(c & (F.col("_turn") >= 0)).drop("_tokens", "_bits", "_turn") for c in (some, ~some))
    scope = [F.col(scope_col).cast("string").alias("scope_id")] if scope_col else []
    # A key of the row's own: documents with a NULL id, or with the same one, stay apart.
    marked = marked.withColumn("_document", F.xxhash64(id_col, text_col, *([scope_col] if scope_col else [])))
    tokens = each_value(marked, in_text, "placeholder", "_document", *scope)
    if known:
        tokens = tokens.where(known.might_hold(*[F.col(c) for c in (["scope_id"] if scope_col else [])], F.col("placeholder")))
    keys = ["scope_id", "placeholder"] if scope_col else ["placeholder"]
    found = lookup_join(tokens, latest_entries(mapping, keys), keys, ["original"], row_id="_document")
    size = lookup_bytes(df, [text_col])
    per_document = (
        dealt(found.where(F.col("original").isNotNull()), size, "_document")
        .groupBy("_document")
        # A set: rows that repeat a document repeat its tokens.
        .agg(F.map_from_entries(F.collect_set(F.struct("placeholder", "original"))).alias("_originals"))
    )
    return _finish(dealt(marked, size, "_document").join(per_document, "_document", "left"), untouched, text_col, output_col)


def unambiguous(mapping: DataFrame) -> DataFrame:
    """Masked values of each column that stand for exactly one original."""
    return (
        mapping.groupBy("column_name", "masked")
        .agg(F.min("original").alias("original"), F.count_distinct("original").alias("_n"))
        .where("_n = 1")
        .drop("_n")
    )


def ambiguous(mapping: DataFrame) -> DataFrame:
    """Masked values that cannot be undone, because several originals gave them."""
    return (
        mapping.groupBy("column_name", "masked")
        .agg(F.count_distinct("original").alias("n_originals"))
        .where("n_originals > 1")
    )


def restore_table(
    df: DataFrame, mapping: DataFrame, columns: list[str], row_id: str | None = None, types: dict[str, str] | None = None
) -> DataFrame:
    """Exact-match restore of masked columns from ``(column_name, original, masked)``.

    A value with no entry, or with more than one possible original, stays as it
    is.  A restored column keeps its type; ``types`` names another one, e.g.
    ``{"price": "double"}``.  A cell that does not fit the type is an error, never
    a NULL.
    """
    usable = stash(unambiguous(mapping).select("column_name", F.col("masked").alias("key"), F.col("original").alias("value")))
    out = lookup_columns(df, usable, columns)
    restored = {}
    for i, column in enumerate(columns):
        text = F.coalesce(F.col(found_name(i)), quoted(column)[0].cast("string"))
        target = (types or {}).get(column, df.schema[column].dataType.simpleString())
        restored[column] = text if target == "string" else _cast_or_fail(text, target, column)
    return out.withColumns(restored).select(*quoted(*df.columns)) if columns else df


def _cast_or_fail(value: Column, target: str, column: str) -> Column:
    cast = value.try_cast(target)
    misfit = F.raise_error(F.concat(F.lit(f"column {column}: a restored value is no {target}: "), value))
    return F.when(value.isNotNull() & cast.isNull(), misfit.cast(target)).otherwise(cast)


def restore_string_cells(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Literal restore inside every string column, for a small driver-side mapping."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: restore_with_dict(quoted(c)[0], mapping) for c in strings})


def restore_cells(df: DataFrame, mapping: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Restore placeholders that stand among other text in string cells, from a mapping of any size.

    All columns share one join: only the distinct tokens of a row meet the mapping.
    ``mapping`` has ``placeholder`` and ``original``; of several entries the latest
    counts.  NULL cells and cells without a known token stay as they are.
    """
    strings = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    cells = F.concat_ws("\n", *quoted(*strings))
    marked, untouched = _with_tokens(df.withColumn("_cells", cells), "_cells")
    marked = marked.withColumn("_document", F.xxhash64("_cells"))
    in_cells = F.array_distinct(F.regexp_extract_all("_cells", F.lit(PLACEHOLDER_TOKEN), F.lit(0)))
    tokens = each_value(marked, in_cells, "placeholder", "_document").distinct()
    found = lookup_join(tokens, latest_entries(mapping, ["placeholder"]), ["placeholder"], ["original"], row_id="_document")
    per_row = (
        found.where(F.col("original").isNotNull())
        .groupBy("_document")
        .agg(F.map_from_entries(F.collect_set(F.struct("placeholder", "original"))).alias("_originals"))
    )
    joined = marked.join(per_row, "_document", "left")
    restored = joined.withColumns({c: _restore_by_map(quoted(c)[0], F.col("_originals")) for c in strings})
    every = quoted(*df.columns)
    return restored.select(*every).unionByName(untouched.select(*every))


def number_if_changed(before: Column, after: Column) -> Column:
    """Restored spreadsheet cell as a number, where it changed and is one."""
    return F.when(after != before, after.try_cast("double"))
