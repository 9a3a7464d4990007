"""Text and cells out of office files, one task per batch of files.

The input is a DataFrame ``(path, content)``, e.g. from the ``binaryFile``
source.  Files are admitted up to a fixed size, zipped and unzipped, so one file fits a
task.  A file that cannot be read gives one row with ``error`` and never fails the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import groupby
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as cat

RUN_SCHEMA = "path string, part string, para_idx int, run_idx int, text string, error string"
TEXT_SCHEMA = "path string, text string, error string"
CELL_SCHEMA = (
    "path string, sheet string, sheet_idx int, row_idx int, col_idx int, header string, "
    "value string, type string, error string"
)
# Rows and characters that a task hands on at once.
ROWS_PER_BATCH, CHARS_PER_BATCH = 20_000, 4_000_000
# Bytes that the entries of one file may have unzipped, all together.  An entry never yields
# more than its header states, so the headers are enough to judge by.
MOST_UNZIPPED = 512 * 1024 * 1024
TOO_LARGE = "%s is too large when unzipped (%d MB, at most %d MB)"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _open(content: bytes, kind: str) -> zipfile.ZipFile:
    if bytes(content[:4]) == b"\xd0\xcf\x11\xe0":  # an encrypted file sits in an OLE container
        raise ValueError(cat.PASSWORD_PROTECTED % kind)
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ValueError(cat.NO_VALID_ZIP % kind) from None
    size = sum(entry.file_size for entry in z.infolist())
    if size > MOST_UNZIPPED:
        raise ValueError(TOO_LARGE % (kind, size >> 20, MOST_UNZIPPED >> 20))
    return z


def _run_text(run) -> str:
    signs = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-"}
    return "".join((node.text or "") if node.tag == W + "t" else signs.get(node.tag, "") for node in run)


def _docx_runs(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """``(part, paragraph, run, text)``: body, then tables, headers and footers."""
    with _open(content, cat.WORD_FILE) as z:
        names = z.namelist()
        parts = [("body", "word/document.xml")] + [
            (kind, n) for kind in ("header", "footer") for n in sorted(names) if re.fullmatch(rf"word/{kind}\d*\.xml", n)
        ]
        for kind, name in parts:
            root = ElementTree.fromstring(z.read(name))
            top = root.find(W + "body") if kind == "body" else root
            label = kind if kind == "body" else name.removeprefix("word/").removesuffix(".xml")
            groups = [(label, top.findall(W + "p"))]
            in_cells = [p for p in top.findall(f"{W}tbl/{W}tr/{W}tc/{W}p")]
            groups.append((f"{label}_table", in_cells))
            for group, paragraphs in groups:
                for i, paragraph in enumerate(paragraphs):
                    runs = paragraph.findall(W + "r")
                    # An empty paragraph still is a line.
                    for j, text in enumerate([_run_text(r) for r in runs] or [""]):
                        yield group, i, j, text


def _docx_text(content: bytes) -> Iterator[tuple[str]]:
    body = (run for run in _docx_runs(content) if run[0] == "body")
    yield ("\n".join("".join(run[3] for run in paragraph) for _, paragraph in groupby(body, key=lambda run: run[1])),)


def _column_number(reference: str) -> int:
    number = 0
    for ch in reference:
        if not ch.isalpha():
            break
        number = number * 26 + ord(ch.upper()) - 64
    return number


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    custom = {
        int(n.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", ""))
        for n in root.iter(S + "numFmt")
    }
    shows_date = lambda f: 14 <= f <= 22 or 45 <= f <= 47 or bool(re.search("[dmyhs]", custom.get(f, ""), re.I))
    styles = root.find(S + "cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else []) if shows_date(int(xf.get("numFmtId", 0)))}


def _cell(c, shared: list[str], date_styles: set[int]) -> tuple[str | None, str]:
    kind = c.get("t", "n")
    formula, value = c.find(S + "f"), c.find(S + "v")
    if formula is not None:
        return "=" + (formula.text or ""), "f"
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(S + "t")), "s"
    if value is None or value.text is None:
        return None, "n"
    if kind == "s":
        return shared[int(value.text)], "s"
    if kind in ("str", "e"):
        return value.text, "s"
    if kind == "b":
        return ("true" if value.text == "1" else "false"), "b"
    if kind == "d":
        return value.text.replace("T", " "), "d"
    if int(c.get("s", 0)) in date_styles:
        return str(datetime(1899, 12, 30) + timedelta(days=float(value.text))), "d"
    return value.text, "n"


def _xlsx_cells(content: bytes) -> Iterator[tuple]:
    """``(sheet, sheet_idx, row, col, header, value, type)`` of the cells that hold a value."""
    with _open(content, cat.EXCEL_FILE) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in root.findall(S + "si")]
        date_styles = _date_styles(z)
        targets = {
            rel.get("Id"): rel.get("Target").lstrip("/")
            for rel in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        }
        workbook = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for sheet_idx, sheet in enumerate(workbook.iter(S + "sheet")):
            target = targets[sheet.get(R + "id")]
            headers: dict[int, str] = {}
            with z.open(target if target.startswith("xl/") else "xl/" + target) as stream:
                row_idx = 0
                for _, element in ElementTree.iterparse(stream):
                    if element.tag != S + "row":
                        continue
                    row_idx = int(element.get("r", row_idx + 1))
                    for position, c in enumerate(element.findall(S + "c"), start=1):
                        col = _column_number(c.get("r", "")) or position
                        value, kind = _cell(c, shared, date_styles)
                        if row_idx == 1:
                            headers[col] = value if value is not None else f"Column {col}"
                        if value is not None:
                            yield sheet.get("name"), sheet_idx, row_idx, col, headers.get(col), value, kind
                    element.clear()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number of rows and of characters."""
    batch, chars = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), schema)], schema=schema)

    for row in rows:
        batch.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(batch) == ROWS_PER_BATCH or chars >= CHARS_PER_BATCH:
            yield made()
            batch, chars = [], 0
    if batch:
        yield made()


def _parser(read, schema: str, kind: str):
    """mapInArrow function: the rows of each file, or one row with the error."""
    width = len(_names(schema)) - 2
    arrow = pa.schema([(f.split()[0], pa.int32() if f.endswith(" int") else pa.string()) for f in schema.split(", ")])

    def rows(batches):
        for batch in batches:
            # One file is a Python value at a time, whatever the batch holds.
            for path, held in zip(batch.column(0), batch.column(1), strict=True):
                path, content = path.as_py(), held.as_py()
                try:
                    for row in read(content):
                        yield (path, *row, None)
                except ValueError as e:
                    yield (path, *[None] * width, str(e))
                except Exception as e:  # malformed XML, missing parts, ...
                    yield (path, *[None] * width, cat.UNREADABLE % (kind, e))

    return lambda batches: _batches(rows(batches), arrow)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def read_docx_runs(files: DataFrame) -> DataFrame:
    """Runs of DOCX files: ``path, part, para_idx, run_idx, text, error``."""
    return files.select("path", "content").mapInArrow(_parser(_docx_runs, RUN_SCHEMA, cat.WORD_FILE), RUN_SCHEMA)


def read_docx_texts(files: DataFrame) -> DataFrame:
    """Body text per DOCX file, paragraphs joined by line breaks: ``path, text, error``."""
    return files.select("path", "content").mapInArrow(_parser(_docx_text, TEXT_SCHEMA, cat.WORD_FILE), TEXT_SCHEMA)


def read_xlsx_cells(files: DataFrame) -> DataFrame:
    """Cells of XLSX files in long form; row 1 holds the headers."""
    return files.select("path", "content").mapInArrow(_parser(_xlsx_cells, CELL_SCHEMA, cat.EXCEL_FILE), CELL_SCHEMA)


def only_sheets(cells: DataFrame, sheets: list[str] | None) -> DataFrame:
    """Cells of the chosen sheets (error rows are kept); None keeps all."""
    return cells if sheets is None else cells.where(F.col("sheet").isin(sheets) | F.col("error").isNotNull())


def cells_to_table(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed rows ``(path, sheet, row_idx, …)`` for sheets that share a layout.

    ``columns`` maps header to type.  Of columns with the same header the last wins.
    """
    values = [
        F.max_by(F.when(F.col("header") == name, F.col("value")), F.when(F.col("header") == name, F.col("col_idx")))
        .try_cast(data_type)
        .alias(name)
        for name, data_type in columns.items()
    ]
    return cells.where("row_idx > 1 and error is null").groupBy("path", "sheet", "row_idx").agg(*values)


def sheet_previews(cells: DataFrame, rows: int = 5) -> DataFrame:
    """Per sheet: row count, column names and the first data rows as strings.

    Only the header and the first rows are gathered; the count needs no rows.
    """
    header = (F.col("row_idx") == 1) & F.col("header").isNotNull()
    shown = F.col("row_idx").between(2, rows + 1)
    heads = cells.where("error is null").groupBy("path", "sheet", "sheet_idx").agg(
        F.greatest(F.max("row_idx") - 1, F.lit(0)).alias("rows"),
        F.sort_array(F.collect_list(F.when(header, F.struct("col_idx", "header")))).alias("heads"),
        F.collect_list(F.when(shown, F.struct("row_idx", "col_idx", "value"))).alias("cells"),
        F.max(F.when(shown, F.col("row_idx"))).alias("last"),
    )
    lines = F.transform(
        F.sequence(F.lit(2), F.col("last")),
        lambda r: F.transform(
            "heads",
            lambda h: F.coalesce(
                F.get(F.transform(F.filter("cells", lambda c: (c["row_idx"] == r) & (c["col_idx"] == h["col_idx"])), lambda c: c["value"]), F.lit(0)),
                F.lit(""),
            ),
        ),
    )
    return heads.select(
        "path", "sheet", "sheet_idx", "rows", F.transform("heads", lambda h: h["header"]).alias("columns"),
        F.when(F.col("last").isNull(), F.array().cast("array<array<string>>")).otherwise(lines).alias("preview"),
    )


def read_status(parsed: DataFrame) -> DataFrame:
    """``(path, valid, error)`` per file."""
    return parsed.groupBy("path").agg(F.max("error").alias("error")).select(
        "path", F.col("error").isNull().alias("valid"), "error"
    )


def quarantine(files: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable files, and refused ones with their error."""
    judged = files.join(status, "path")
    return judged.where("valid").drop("valid", "error"), judged.where("not valid").drop("valid")
