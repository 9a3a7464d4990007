"""CSV as cells: whole files of a file job, and large files cut into ranges that many tasks read.

A quoted cell may hold line breaks, so a range of a large file does not show whether it
starts inside quotes.  It does once the quotation marks of all ranges before it are counted:
an odd number means inside.  ``read_csv_split`` counts them in one narrow pass, and in a
second one every task joins physical lines to records by the running parity from its
range's state on.  What a record has in two ranges meets by a join of at most two rows per
range.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import dropwhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalogue as cat

CELL_SCHEMA = "path string, row_idx int, col_idx int, header string, value string, error string"
_CELLS_PER_BATCH = 50_000
_DELIMITERS = (",", ";", "\t")
# Ranges of one call, so that their states fit the driver; at 128 MB each that is 120 TB.
MOST_RANGES = 1_000_000


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def delimiter_of(text: str) -> str:
    """The candidate that occurs most in the first line, outside quotes; a comma if none does."""
    first = text.split("\n", 1)[0]
    bare = "".join(first.split('"')[::2])
    return max(_DELIMITERS, key=bare.count)


def _file_cells(content: bytes) -> Iterator[tuple[int, int, str | None, str | None]]:
    text = _decoded(content)
    headers: list[str] = []
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(text), strict=True)
    for row_idx, row in enumerate((r for r in rows if r), start=1):
        if row_idx == 1:
            headers = [name if name else f"Column {i}" for i, name in enumerate(row, start=1)]
        for col_idx, value in enumerate(row, start=1):
            header = headers[col_idx - 1] if col_idx <= len(headers) else f"Column {col_idx}"
            yield row_idx, col_idx, header, value or None


def read_csv_cells(files: DataFrame) -> DataFrame:
    """Cells of CSV files ``(path, content)``: ``path, row_idx, col_idx, header, value, error``.

    Row 1 holds the headers.  UTF-8 with or without a byte order mark, else Latin-1; comma,
    semicolon or tab.  An empty cell is NULL; a row with more cells than headers goes on
    with ``Column n``.  A file that is no CSV is one row with its error.
    """
    schema = pa.schema([("path", pa.string()), ("row_idx", pa.int32()), ("col_idx", pa.int32()), ("header", pa.string()), ("value", pa.string()), ("error", pa.string())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    # Whole before any of it goes out: a file is masked as a table or not at all.
                    for cell in list(_file_cells(content.as_py() or b"")):
                        yield (path, *cell, None)
                except csv.Error as e:
                    yield path, None, None, None, None, cat.UNREADABLE % ("CSV", e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for cell in cells(batches):
            held.append(cell)
            if len(held) == _CELLS_PER_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, CELL_SCHEMA)


def csv_lines(cells: DataFrame, value_col: str) -> DataFrame:
    """Cells back to lines: ``(path, row_idx, line)``, quoted where needed; a cell that is missing is empty."""
    quote = F.concat(F.lit('"'), F.replace(F.col(value_col), F.lit('"'), F.lit('""')), F.lit('"'))
    shown = F.coalesce(F.when(F.col(value_col).rlike('[",;\t\r\n]|^ | $'), quote).otherwise(F.col(value_col)), F.lit(""))
    row = cells.groupBy("path", "row_idx").agg(F.sort_array(F.collect_list(F.struct("col_idx", shown.alias("v")))).alias("c"))
    return row.select("path", "row_idx", F.array_join(F.transform("c", lambda x: x["v"]), ",").alias("line"))


# --- large files ---------------------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def _odd_starts(spark: SparkSession, path: str) -> dict[tuple[str, int], bool]:
    """Per range whether it starts inside quotes."""
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = _lines(spark, path).groupBy("path", "start").agg((F.sum(marks) % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.select("path", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside")).limit(MOST_RANGES + 1).collect()
    if len(rows) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges; read the files in several calls")
    return {(r["path"], r["start"]): r["inside"] for r in rows}


def _records(batches: Iterator[pa.RecordBatch], inside_at: dict[tuple[str, int], bool]) -> Iterator[tuple[str, int, str, list[str]]]:
    """``(path, start, kind, records)``: whole records of every range, and its open ends.

    A ``head`` ends a record of an earlier range, a ``tail`` begins one that the range does
    not end, ``through`` is a range inside one record.
    """
    at, inside, held, continues = None, False, [], False
    for batch in batches:
        keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()))
        odd = np.asarray(pc.count_substring(batch.column("value"), '"'), np.int64) % 2
        values = batch.column("value").to_pylist()
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if keys[a] != at:
                if held:
                    yield *at, "through" if continues else "tail", ["\n".join(held)]
                at, inside, held = keys[a], inside_at[keys[a]], []
                continues = inside
            after = (np.cumsum(odd[a:b]) + inside) % 2 == 1
            done, begin = [], a
            for end in (np.flatnonzero(~after) + a + 1).tolist():  # the lines at which a record ends
                record = "\n".join([*held, *values[begin:end]])
                held, begin = [], end
                if continues:
                    yield *at, "head", [record]
                    continues = False
                else:
                    done.append(record)
            if done:
                yield *at, "whole", done
            held += values[begin:b]
            inside = bool(after[-1])
    if held:
        yield *at, "through" if continues else "tail", ["\n".join(held)]


def _parsed(records: list[str], width: int) -> list[pa.Array]:
    """Columns of some records, as strings; an empty cell is NULL, quoted or not.

    A row of another width has NULL for what it lacks and loses what it has too much.
    """
    names, odd = [str(i) for i in range(width)], []
    filled = [r for r in (r.removesuffix("\r") for r in records) if r]
    if not filled:
        return [pa.array([], pa.string())] * width
    data = "\n".join([*filled, ""]).encode()

    def other_width(row: pacsv.InvalidRow) -> str:
        odd.append((row.actual_columns, row.text))
        return "skip"

    table = pacsv.read_csv(
        io.BytesIO(data),
        read_options=pacsv.ReadOptions(column_names=names, block_size=len(data) + 1, use_threads=False),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=other_width),
        convert_options=pacsv.ConvertOptions(
            column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True, quoted_strings_can_be_null=True, null_values=[""]
        ),
    )
    columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], pa.string()) for c in table.columns]
    for n, text in odd:
        row = _parsed([text], n)[:width]
        columns = [pa.concat_arrays([c, row[i] if i < len(row) else pa.nulls(1, pa.string())]) for i, c in enumerate(columns)]
    return columns


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names as the built-in reader gives them, without a byte order mark."""
    names = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path).columns
    return [n.removeprefix("\ufeff") if i == 0 else n for i, n in enumerate(names)]


def read_csv_split(spark: SparkSession, path: str) -> DataFrame:
    """String columns of CSV files with a header row, read in ranges by many tasks.

    As the built-in reader with ``multiLine``, for files whose quotation marks are all
    doubled or around whole cells: quoted line breaks, blank lines left out, NULL for an
    empty cell.  Compressed files are one range each; no file is an error of the reader.
    """
    names = header_of(spark, path)
    width = len(names)
    inside_at = _odd_starts(spark, path)
    cells = [f"c{i}" for i in range(width)]
    strings = lambda columns: T.StructType([T.StructField(c, T.StringType()) for c in columns])
    arrow = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("open", pa.string()), *((c, pa.string()) for c in cells)])
    spark_schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), *strings(["kind", "open", *cells]).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headed = set()  # files whose header this task has passed
        for where, start, kind, records in _records(batches, inside_at):
            if start == 0 and where not in headed and kind in ("whole", "tail"):
                records = [*dropwhile(lambda r: not r.strip(), records)]
                if not records:
                    continue
                headed.add(where)
                kind = "header" if kind == "tail" else kind
                records = records if kind == "header" else records[1:]
            columns = _parsed(records, width) if kind == "whole" else [pa.nulls(1, pa.string())] * width
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([
                pa.array([where] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([kind] * n, pa.string()),
                pa.nulls(n, pa.string()) if kind == "whole" else pa.array(records, pa.string()), *columns,
            ], schema=arrow)

    pieces = _lines(spark, path).mapInArrow(run, spark_schema)
    torn = pieces.where("kind <> 'whole'").select("path", "start", "kind", "open")
    begins = F.when(F.col("kind").isin("tail", "header"), 1).otherwise(0)
    # At most two rows per range: what ends there comes before what begins there.
    torn = torn.withColumn("record", F.sum(begins).over(Window.partitionBy("path").orderBy("start", begins)))
    lines = torn.groupBy("path", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "open"))), lambda x: x["open"]), "\n").alias("line"),
        F.max(F.col("kind") == "header").alias("header"),
    )

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(_parsed(batch.column("line").to_pylist(), width), names=cells)

    mended = lines.where("not header").select("line").mapInArrow(mend, strings(cells))
    return pieces.where("kind = 'whole'").select(*cells).unionByName(mended).toDF(*names)
