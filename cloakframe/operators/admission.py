"""Admission of files, names and payloads: checks that give reasons, never exceptions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalogue as cat
from ..functions.validators import is_canonical_uuid

MB = 1024 * 1024


def extension(filename: Column) -> Column:
    """Lower-cased part after the last dot; NULL without a dot."""
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1)))


def file_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in cat.FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(ext, F.lit(""))), F.lit("unknown"))


def _megabytes(size: Column) -> Column:
    return size / F.lit(float(MB))


def reject_reason(filename: Column, size: Column, max_bytes: int = cat.MAX_FILE_BYTES) -> Column:
    """Why a file is refused, or NULL."""
    ext = extension(filename)
    return (
        F.when(filename.isNull() | (filename == ""), F.lit(cat.NO_FILE))
        .when(ext.isNull(), F.lit(cat.NO_EXTENSION))
        .when(~ext.isin(cat.ALLOWED_EXTENSIONS), F.format_string(cat.TYPE_REFUSED, ext))
        .when(
            size > max_bytes,
            F.format_string(cat.TOO_LARGE, _megabytes(size), F.lit(max_bytes // MB)),
        )
        .when(size == 0, F.lit(cat.FILE_EMPTY))
    )


def size_warning(size: Column) -> Column:
    """Warning text for large files, or NULL."""
    band = F.when(size < cat.VERY_LARGE_FILE_BYTES, cat.LARGE_FILE_TIME).otherwise(cat.VERY_LARGE_FILE_TIME)
    return F.when(size > cat.LARGE_FILE_BYTES, F.format_string(cat.LARGE_FILE_WARNING, _megabytes(size), band))


def magic_type(content: Column) -> Column:
    """File family by its first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head == "504B0304", "zip").otherwise("text")


def magic_agrees(content: Column, ext: Column) -> Column:
    family = F.when(ext == "pdf", "pdf").when(ext.isin("docx", "xlsx"), "zip").otherwise("text")
    return magic_type(content) == family


def is_utf8(content: Column) -> Column:
    """Whole content, not only its head."""
    return F.is_valid_utf8(content.cast("string"))


def encoding_warning(content: Column) -> Column:
    return F.when(~is_utf8(content), F.lit(cat.ENCODING_WARNING))


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, Latin-1 otherwise; a leading byte order mark is dropped."""
    text = F.when(is_utf8(content), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


@F.pandas_udf(T.StringType())
def _fold_accents(names: pd.Series) -> pd.Series:
    return names.map(
        lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii"), na_action="ignore"
    )


def sanitize_filename(filename: Column, max_length: int = 255) -> Column:
    """ASCII letters, digits and ``._-`` only; inner dots become ``_``; length capped, extension kept."""
    # Only names with other characters go through Python.
    plain = F.when(filename.rlike(r"^[\x00-\x7F]*$"), filename).otherwise(_fold_accents(filename))
    flat = F.regexp_replace(F.trim(F.replace(plain, F.lit("/"), F.lit(" "))), r"\s+", "_")
    safe = F.regexp_replace(F.regexp_replace(flat, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")
    stem = F.regexp_replace(safe, r"\.[^.]*$", "")
    ext = F.substring_index(safe, ".", -1)
    dotted = F.contains(safe, F.lit("."))
    one_dot = F.when(dotted, F.concat(F.replace(stem, F.lit("."), F.lit("_")), F.lit("."), ext)).otherwise(safe)
    short_stem = F.substr(F.regexp_replace(one_dot, r"\.[^.]*$", ""), F.lit(1), F.lit(max_length - 1) - F.length(ext))
    shortened = F.when(dotted, F.concat(short_stem, F.lit("."), ext)).otherwise(F.substring(one_dot, 1, max_length))
    return F.when(F.length(one_dot) > max_length, shortened).otherwise(one_dot)


def json_depth(value: Column) -> Column:
    """Deepest nesting of objects and arrays, from the brackets outside of strings."""
    brackets = F.regexp_replace(F.regexp_replace(value, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    return F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("open"), F.lit(0).alias("deepest")),
        lambda acc, ch: F.struct(
            (acc["open"] + F.when(ch.isin("[", "{"), 1).when(ch.isin("]", "}"), -1).otherwise(0)).alias("open"),
            F.greatest(acc["deepest"], acc["open"] + F.when(ch.isin("[", "{"), 1).otherwise(0)).alias("deepest"),
        ),
        lambda acc: acc["deepest"],
    )


def json_problem(value: Column, required: list[str], max_depth: int = cat.MAX_JSON_DEPTH) -> Column:
    """Why a JSON payload is refused, or NULL."""
    keys = F.json_object_keys(value)
    problem = F.when(value.isNull() | keys.isNull(), F.lit(cat.NOT_AN_OBJECT))
    for name in required:
        problem = problem.when(~F.array_contains(keys, name), F.lit(cat.FIELD_MISSING % name))
    return problem.when(
        json_depth(value) > max_depth, F.lit(cat.JSON_TOO_DEEP % max_depth)
    )


def with_admission(
    files: DataFrame, name_col: str = "name", size_col: str = "length", content_col: str | None = None, check_magic: bool = False
) -> DataFrame:
    """Adds ``extension, file_type, error, warnings, accepted`` to a file catalogue.

    ``error`` may already hold a parser's complaint; admission reasons come first.
    """
    name, size = F.col(name_col), F.col(size_col)
    out = files.withColumns({"extension": extension(name), "file_type": file_type(extension(name))})
    reason = reject_reason(name, size)
    if content_col and check_magic:
        disagrees = ~magic_agrees(F.col(content_col), F.col("extension"))
        reason = F.coalesce(
            reason, F.when(disagrees, F.format_string(cat.CONTENT_DISAGREES, "extension"))
        )
    earlier = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    warnings = [size_warning(size)]
    if content_col:
        warnings.append(F.when(F.col("extension").isin("txt", "csv", "md"), encoding_warning(F.col(content_col))))
    return (
        out.withColumn("error", F.coalesce(reason, earlier))
        .withColumn("warnings", F.array_compact(F.array(*warnings)))
        .withColumn("accepted", F.col("error").isNull())
    )


def admission_summary(admitted: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of accepted and refused files and whether the batch succeeded in part."""
    counted = admitted.groupBy(*([by] if by else [])).agg(
        F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_rejected")
    )
    return counted.withColumn("partial_success", (F.col("n_accepted") > 0) & (F.col("n_rejected") > 0))


def selected_sheets(chosen: Column, existing: Column) -> Column:
    """Chosen sheets that exist, all of them when none was chosen; error when none is left."""
    kept = F.when(chosen.isNull(), existing).otherwise(
        F.filter(chosen, lambda name: F.array_contains(existing, name))
    )
    return F.when(F.size(kept) > 0, kept).otherwise(
        F.raise_error(F.lit(cat.NO_VALID_SHEETS)).cast("array<string>")
    )


def has_formula(cells: DataFrame, by: tuple[str, ...] = ("path", "sheet"), rows: int = 10) -> DataFrame:
    """Whether the first rows of each sheet hold a formula cell."""
    return cells.where(F.col("row_idx") <= rows).groupBy(*by).agg(F.bool_or(F.col("type") == "f").alias("has_formulas"))


def newer_than(df: DataFrame, ts_col: str, now: Column, hours: int = cat.RETENTION_HOURS) -> DataFrame:
    """Rows strictly newer than ``now`` minus the retention period."""
    return df.where(F.col(ts_col) > F.timestamp_add("HOUR", F.lit(-hours), now))


def of_session(df: DataFrame, session_id: str, session_col: str = "session_id") -> DataFrame:
    """Rows of one session; on a table partitioned by session only its files are read."""
    return df.where(F.col(session_col) == session_id)


def without_session(df: DataFrame, session_id: str, session_col: str = "session_id") -> DataFrame:
    """Everything but one session; an id that is no canonical UUID removes nothing."""
    return df.where(~is_canonical_uuid(F.lit(session_id)) | (F.col(session_col) != session_id))
