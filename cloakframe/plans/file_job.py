"""Jobs over a table of files: texts, Word documents, workbooks and CSV in, results, logs, errors and totals out, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..operators.admission import decode_text, extension, file_type
from ..operators.cells import mask_cells, restore_masked_cells, ruled
from ..operators.numbering import stash
from ..operators.redact import mapping_rows
from ..operators.restore import restore_documents
from ..operators.rules import RULE_LOG_TYPE
from ..sources.csv_cells import read_csv_cells
from ..sources.office import read_docx_runs, read_xlsx_cells
from .restore_job import open_mapping, restore_audit
from .text_job import redact_texts, route_by_type

# A piece of a file: its place, the header of a data cell, and its text before and after.
PIECE = ["path", "part", "place", "header", "text", "redacted", "rule_log"]
_MAPPING = ["scope_id", "kind", "placeholder", "original"]


@dataclass
class FileJob:
    """``pieces`` of every readable file, ``results`` and ``logs`` per file, ``mapping`` if reversible.

    ``rejected`` lists the column rules that did not run: ``(path, part, column, ruleId, reason)``.
    """

    pieces: DataFrame
    results: DataFrame
    logs: DataFrame
    mapping: DataFrame | None
    rejected: DataFrame | None = None

    def totals(self) -> DataFrame:
        """``(file_type, status, n_files, n_items)``."""
        return self.results.groupBy("file_type", "status").agg(F.count("*").alias("n_files"), F.sum("n_items").alias("n_items"))


@dataclass
class RestoredFiles:
    """``pieces`` with ``restored``; ``audit`` rows per file."""

    pieces: DataFrame
    audit: DataFrame


def _place(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.lpad(p.cast("string"), 9, "0") for p in parts])


def _place_number(i: int) -> Column:
    return F.get(F.split("place", "/"), F.lit(i)).try_cast("int")


def read_pieces(files: DataFrame) -> DataFrame:
    """``(path, file_type, part, place, header, text, error)`` of every file of ``(path, content)``.

    A text is one piece, a Word document one per run, a workbook and a CSV file one per
    cell; a file that cannot be read, or of a kind that is not supported, is one row with
    its error.
    """
    typed = files.withColumn("file_type", file_type(extension(F.substring_index("path", "/", -1))))
    routes = route_by_type(typed)
    none = F.lit(None).cast("string")
    is_csv = F.coalesce(extension(F.substring_index("path", "/", -1)) == "csv", F.lit(False))
    texts = routes["text"].where("file_type = 'txt'").select(
        "path", F.lit("body").alias("part"), F.lit("").alias("place"), none.alias("header"), decode_text(F.col("content")).alias("text"), none.alias("error")
    )
    runs = read_docx_runs(routes["text"].where("file_type = 'docx'")).select(
        "path", "part", _place(F.col("para_idx"), F.col("run_idx")).alias("place"), none.alias("header"), "text", "error"
    )
    data_header = F.when(F.col("row_idx") > 1, F.col("header")).alias("header")
    cell_place = _place(F.col("row_idx"), F.col("col_idx")).alias("place")
    cells = read_xlsx_cells(routes["table"].where(~is_csv)).select(
        "path", F.col("sheet").alias("part"), cell_place, data_header, F.col("value").alias("text"), "error"
    )
    lines = read_csv_cells(routes["table"].where(is_csv)).select(
        "path", F.lit("csv").alias("part"), cell_place, data_header, F.col("value").alias("text"), "error"
    )
    other = routes["unsupported"].select("path", none.alias("part"), none.alias("place"), none.alias("header"), none.alias("text"), "error")
    kinds = file_type(extension(F.substring_index("path", "/", -1)))
    return texts.unionByName(runs).unionByName(cells).unionByName(lines).unionByName(other).withColumn("file_type", kinds)


def _as_cells(pieces: DataFrame) -> DataFrame:
    return pieces.withColumns({"row_idx": _place_number(0), "col_idx": _place_number(1)})


def process_files(
    files: DataFrame, rules: list | None = None, column_rules: list | None = None, salt="", reversible: bool = False, names: DataFrame | None = None
) -> FileJob:
    """Redact every file of ``(path, content)``.

    ``rules`` are text rules for every piece; ``column_rules`` of all kinds mask the cells
    of workbooks and CSV files by their header (see ``mask_cells``), and no text rule touches
    a cell that they masked.  A rule that does not fit a column, or whose column no file
    has, is in ``rejected``; the cells it should have masked are redacted as text.  ``names``
    may give ``(path, original_name)``.  A file that fails is an error row in ``results`` and
    holds up no other file.  With ``reversible`` placeholders of texts restart in every
    piece, and the mapping holds masked cells too, so ``restore_files`` brings back
    everything.
    """
    read = read_pieces(files)
    good = read.where("error is null")
    masked = None
    if column_rules:
        read = stash(read)  # files are opened once, and masked cells are told from the others by what was done
        good = read.where("error is null")
        named = ruled(F.col("header"), column_rules)
        masked = mask_cells(_as_cells(good.where(named)), column_rules, salt, reversible)
        left = masked.cells.where("redacted is null").select(*good.columns)
        good = good.where(~named).unionByName(left)
    good = redact_texts(good, rules, reversible=reversible)
    items = F.col("report.phone_numbers.count") + F.col("report.emails.count")
    done = good.groupBy("path").agg(F.sum(items).cast("long").alias("n_items"))
    if masked:
        cells = masked.cells.where("redacted is not null").groupBy("path").agg(F.count("*").alias("n_cells"))
        done = done.join(cells, "path", "full")
    else:
        done = done.withColumn("n_cells", F.lit(0).cast("long"))
    failed = read.where("error is not null").groupBy("path").agg(F.max("error").alias("error"))
    listed = files.select("path").distinct()
    if names is not None:
        listed = listed.join(names, "path", "left")
    else:
        listed = listed.withColumn("original_name", F.substring_index("path", "/", -1))
    results = listed.join(done, "path", "left").join(failed, "path", "left").select(
        "path", F.coalesce("original_name", F.lit(cat.UNKNOWN_NAME)).alias("original_name"),
        file_type(extension(F.substring_index("path", "/", -1))).alias("file_type"),
        F.when(F.col("error").isNull(), "anonymized").otherwise("error").alias("status"), "error",
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"),
    )
    logs = good.select("path", F.explode(F.col("rule_log").cast(RULE_LOG_TYPE)).alias("e")).groupBy("path", "e.ruleId", "e.appliedPattern")
    logs = logs.agg(F.sum("e.count").alias("n"))
    mapping = mapping_rows(good.withColumn("piece", _piece()), "piece").select(*_MAPPING) if reversible else None
    pieces, rejected = good.select(*PIECE), None
    if masked:
        logs, rejected = logs.unionByName(masked.logs), masked.rejected
        by_rule = masked.cells.where("redacted is not null").withColumn("rule_log", F.array().cast(RULE_LOG_TYPE))
        pieces = pieces.unionByName(by_rule.select(*PIECE))
        if masked.mapping is not None:
            mapping = masked.mapping if mapping is None else mapping.unionByName(masked.mapping)
    return FileJob(pieces, results, logs, mapping, rejected)


def _piece() -> Column:
    """Name of a piece among all pieces of all files."""
    return F.concat_ws("|", "path", "part", "place")


def restore_files(pieces: DataFrame, mapping: DataFrame) -> DataFrame:
    """``pieces`` with ``restored``: texts, runs and cells alike, tokens inside a cell included.

    Originals of masked cells come back as they were, whatever rule masked them.
    """
    in_texts = ~F.col("kind").isin("cell", "column")
    named = pieces.withColumn("piece", _piece())
    texts = restore_documents(named, mapping.where(in_texts), "piece", output_col="_text").drop("piece")
    cells = _as_cells(texts).withColumn("redacted", F.col("_text"))
    restored = restore_masked_cells(cells, mapping.where(~in_texts))
    return restored.withColumn("redacted", F.col("_text")).select(*pieces.columns, "restored")


def restore_file_set(pieces: DataFrame, mapping: DataFrame, session_id: Column, ts: Column, key=None, names: DataFrame | None = None) -> RestoredFiles:
    """Everything of a reversible job back: mapping opened with its key, pieces of all kinds restored, audit rows written.

    ``audit`` has START, MAPPING_LOADED and COMPLETE rows per file.  A wrong key is an error.
    """
    plain = open_mapping(mapping, key)
    loaded = plain.agg(F.count("*").alias("n_mappings"))  # one row
    listed = pieces.select("path").distinct()
    if names is None:
        listed = listed.withColumn("original_name", F.substring_index("path", "/", -1))
    else:
        listed = listed.join(names, "path", "left").withColumn("original_name", F.coalesce("original_name", F.lit(cat.UNKNOWN_NAME)))
    listed = listed.withColumn("file_type", file_type(extension(F.substring_index("path", "/", -1)))).join(F.broadcast(loaded))
    encrypted = dict(mapping.dtypes)["original"] == "binary"
    audit = restore_audit(listed, session_id, ts, "original_name", "file_type", F.col("n_mappings"), encrypted)
    return RestoredFiles(restore_files(pieces, plain), audit)
