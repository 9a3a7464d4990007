"""Readers for texts, tables and file catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..operators.admission import decode_text
from .csv_cells import read_csv_split


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``path, text``; line breaks kept."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text")
    )


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_texts_any_encoding(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """As ``read_texts``, with Latin-1 for files that are not UTF-8."""
    return read_binary(spark, path, glob).select("path", decode_text(F.col("content")).alias("text"))


def read_table_csv(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """CSV with a header row and quoted line breaks; a byte order mark is dropped.

    Cells keep their spaces.  One file is read by many tasks (see ``csv_cells``), but for
    one with quoted line breaks *and* a ``schema``, which the built-in reader takes whole.
    ``multi_line=False`` is for files without quoted line breaks.
    """
    if multi_line and schema is None:
        return read_csv_split(spark, path)
    reader = spark.read.option("header", "true").option("multiLine", multi_line).option("escape", '"')
    reader = reader.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    df = (reader.schema(schema) if schema else reader).csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.removeprefix("\ufeff"))


def file_catalogue(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name, extension, size and time of every file; contents are not read."""
    files = read_binary(spark, path, glob).select("path", "modificationTime", "length")
    name = file_name(F.col("path"))
    return files.withColumns(
        {"name": name, "extension": F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))}
    )


def with_original_name(files: DataFrame, metadata: DataFrame, id_col: str, default: Column | str = cat.UNKNOWN_NAME) -> DataFrame:
    """Left join with ``(id, original_name)``; a missing name becomes the default."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return files.join(metadata.select(id_col, "original_name"), id_col, "left").withColumn(
        "original_name", F.coalesce("original_name", fallback)
    )


def with_selected_sheets(files: DataFrame, selections: DataFrame, id_col: str) -> DataFrame:
    """Left join with ``(id, selected)``; NULL stands for all sheets."""
    return files.join(selections.select(id_col, "selected"), id_col, "left")
