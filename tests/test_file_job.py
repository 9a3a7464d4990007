"""Jobs over files: no ruled cell leaves unmasked, and everything comes back."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.cells import mask_cells
from cloakframe.operators.mapping import encrypt_mapping
from cloakframe.plans.file_job import process_files, restore_file_set, restore_files
from workload.files import docx_bytes, xlsx_bytes


def _files(spark, files):
    return spark.createDataFrame([(k, v.encode() if isinstance(v, str) else v) for k, v in files.items()], "path string, content binary")


def _cells(df, value="redacted"):
    return {(r["path"], r["place"]): r[value] for r in df.collect()}


CSV = "naam,salaris,datum,mail\r\nJan Jansen,100,2024-01-01,j@x.nl\r\nPiet,=1+1,geen,\r\nJan Jansen,-3.5,2024-02-28,p@x.nl\r\nPiet,7,2024-12-31,\r\n"


def test_csv_is_masked_by_its_headers(spark):
    rules = [
        {"id": "a", "columnName": "naam", "replaceWith": "[N]"},
        {"id": "b", "columnName": "datum", "columnType": "date", "anonymizationType": "date_offset", "dateOffsetDays": 1},
    ]
    job = process_files(_files(spark, {"a.csv": "naam,salaris\nJan Jansen,100\n", "b.csv": "x;naam\n1;Eva\n"}), column_rules=rules)
    got = _cells(job.pieces)
    assert got["a.csv", "000000002/000000001"] == "[N]" and got["b.csv", "000000002/000000002"] == "[N]"
    assert got["a.csv", "000000001/000000001"] == "naam" and got["a.csv", "000000002/000000002"] == "100"
    assert {(r["path"], r["n"]) for r in job.logs.where("ruleId = 'a'").collect()} == {("a.csv", 1), ("b.csv", 1)}
    assert {r["original_name"]: (r["status"], r["n_cells"]) for r in job.results.collect()} == {"a.csv": ("anonymized", 1), "b.csv": ("anonymized", 1)}
    (refused,) = job.rejected.collect()
    assert (refused["ruleId"], refused["path"], refused["column"]) == ("b", None, "datum") and "datum" in refused["reason"]


def test_every_rule_kind(spark):
    rules = [
        {"id": "n", "columnName": "naam", "reversible": True},
        {"id": "s", "columnName": "salaris", "columnType": "number", "anonymizationType": "number_multiply", "numberMultiplier": 2},
        {"id": "d", "columnName": "datum", "columnType": "date", "anonymizationType": "date_offset", "dateOffsetDays": 2},
    ]
    got = _cells(process_files(_files(spark, {"a.csv": CSV, "b.xlsx": xlsx_bytes({"t": [["naam"], ["Piet"], ["Eva"]]})}), column_rules=rules).pieces)
    column = lambda c: [got["a.csv", f"{r:09d}/{c:09d}"] for r in (2, 3, 4, 5)]
    assert column(1) == ["[NAAM-001]", "[NAAM-002]", "[NAAM-001]", "[NAAM-002]"]  # one numbering over all files
    assert [got["b.xlsx", f"{r:09d}/000000001"] for r in (2, 3)] == ["[NAAM-002]", "[NAAM-003]"]
    assert column(2) == ["200.0", "=1+1", "-7.0", "14.0"] and column(3) == ["2024-01-03", "geen", "2024-03-01", "2025-01-02"]
    assert column(4)[0] == "[EMAIL VERWIJDERD]" and column(4)[1] is None


def test_a_refused_rule_leaves_the_cell_to_the_text_rules(spark):
    rules = [{"id": "d", "columnName": "mail", "columnType": "date", "anonymizationType": "date_offset"}]
    job = process_files(_files(spark, {"a.csv": CSV}), column_rules=rules)
    assert _cells(job.pieces)["a.csv", "000000002/000000004"] == "[EMAIL VERWIJDERD]"
    assert [(r["path"], r["part"], r["column"], r["ruleId"]) for r in job.rejected.collect()] == [("a.csv", "csv", "mail", "d")]


def test_everything_comes_back(spark):
    files = {
        "a.csv": CSV, "b.xlsx": xlsx_bytes({"t": [["naam", "salaris"], ["Piet", 5], ["Eva", 7.25], ["[NAAM-001]", None]]}),
        "c.txt": "Bel 06-12345678 of mail j@x.nl", "d.docx": docx_bytes("Bel 06-12345678\nweg", "voet j@x.nl"), "e.csv": 'a,b\n"open', "f.pdf": "%PDF",
    }
    rules = [
        {"id": "n", "columnName": "naam", "reversible": True}, {"id": "s", "columnName": "salaris", "anonymizationType": "shuffle"},
        {"id": "d", "columnName": "datum", "replaceWith": "=x"}, {"id": "d2", "columnName": "datum", "anonymizationType": "jabber"},
    ]
    job = process_files(_files(spark, files), column_rules=rules, reversible=True, salt="s")
    assert _cells(job.pieces)["a.csv", "000000002/000000003"] != "2024-01-01"
    for r in restore_files(job.pieces, job.mapping).collect():
        assert r["restored"] == r["text"], r
    sealed = encrypt_mapping(job.mapping, "0123456789abcdef")
    back = restore_file_set(job.pieces, sealed, F.lit("s"), F.current_timestamp(), key="0123456789abcdef")
    assert back.pieces.where("not restored <=> text").count() == 0
    assert back.audit.groupBy("action").count().collect() and back.audit.count() == 12
    with pytest.raises(Exception, match="wrong key"):
        restore_file_set(job.pieces, sealed, F.lit("s"), F.current_timestamp(), key="fedcba9876543210").pieces.collect()
    assert {r["path"]: r["status"] for r in job.results.collect()} == {k: "error" if k in ("e.csv", "f.pdf") else "anonymized" for k in files}


def test_shuffle_stays_in_its_column_and_keeps_the_values(spark):
    rows = [("p" if i % 3 else "q", "s", i, 1, "v", None if i % 10 == 0 else f"w{i % 7}") for i in range(2, 300)]
    cells = spark.createDataFrame(rows, "path string, part string, row_idx int, col_idx int, header string, text string")
    out = mask_cells(cells, [{"id": "v", "columnName": "v", "anonymizationType": "shuffle"}], "zout").cells.collect()
    assert len(out) == len(rows)
    for path in "pq":
        assert sorted(r["redacted"] for r in out if r["path"] == path and r["text"]) == sorted(r["text"] for r in out if r["path"] == path and r["text"])
    assert any(r["redacted"] != r["text"] for r in out) and all(r["redacted"] is None for r in out if r["text"] is None)


def test_no_cells_and_no_rules(spark):
    cells = spark.createDataFrame([], "path string, part string, row_idx int, col_idx int, header string, text string")
    done = mask_cells(cells, [{"id": "v", "columnName": "v"}], "zout")
    assert done.cells.count() == 0 and done.logs.count() == 0 and [r["ruleId"] for r in done.rejected.collect()] == ["v"]
    assert process_files(_files(spark, {"a.csv": CSV}), column_rules=[]).rejected is None
