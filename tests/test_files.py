import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import text as text_functions
from cloakframe.functions.validators import is_canonical_uuid
from cloakframe.operators import admission, columns, mapping, restore
from cloakframe.sinks import writers
from cloakframe.sources import config, files, logs, office
from workload.files import docx_bytes, xlsx_bytes

MB = 1024 * 1024


def _admit(spark, rows):
    df = spark.createDataFrame(rows, "name string, length long")
    return {r["name"]: r for r in admission.with_admission(df).collect()}


def test_admission_reasons(spark):
    got = _admit(spark, [("", 5), ("zonder", 5), ("a.exe", 5), ("leeg.txt", 0), ("groot.csv", 50 * MB + 1), ("rand.csv", 50 * MB), ("A.TXT", 5)])
    assert got[""]["error"] == "Geen bestand gevonden"
    assert got["zonder"]["error"] == "Bestand heeft geen extensie"
    assert got["a.exe"]["error"] == "Bestandstype .exe niet toegestaan"
    assert got["leeg.txt"]["error"] == "Bestand is leeg"
    assert got["groot.csv"]["error"].startswith("Bestand te groot (50.0MB). Maximum toegestaan is 50MB.")
    assert got["rand.csv"]["accepted"] and got["A.TXT"]["accepted"]


@pytest.mark.parametrize(("size", "band"), [(5 * MB, None), (5 * MB + 1, "10-30"), (20 * MB - 1, "10-30"), (20 * MB, "30-60")])
def test_size_warning(spark, size, band):
    warnings = _admit(spark, [("a.csv", size)])["a.csv"]["warnings"]
    assert warnings == [] if band is None else band in warnings[0]


@pytest.mark.parametrize(
    ("ext", "kind"), [("md", "txt"), ("txt", "txt"), ("csv", "xlsx"), ("xlsx", "xlsx"), ("docx", "docx"), ("pdf", "pdf"), ("exe", "unknown"), (None, "unknown")]
)
def test_file_type(values, ext, kind):
    assert values(ext, admission.file_type) == kind


@pytest.mark.parametrize(
    ("name", "safe"),
    [("verslag.txt", "verslag.txt"), ("kwaad.php.txt", "kwaad_php.txt"), ("../../etc/passwd", "etc_passwd"), ("mijn  bestand é.docx", "mijn_bestand_e.docx"),
     ("a\\b.txt", "ab.txt"), ("x" * 300 + ".txt", "x" * 251 + ".txt"), ("y" * 300, "y" * 255), ("...", "")],
)
def test_sanitized_names(values, name, safe):
    assert values(name, admission.sanitize_filename) == safe


@pytest.mark.parametrize(
    ("value", "ok"),
    [("123e4567-e89b-12d3-a456-426614174000", True), ("123E4567-E89B-12D3-A456-426614174000", False), ("123e4567e89b12d3a456426614174000", False), ("", False), (None, False)],
)
def test_uuid(values, value, ok):
    assert values(value, is_canonical_uuid) is ok


@pytest.mark.parametrize(
    ("payload", "problem"),
    [('{"a": 1, "b": "x"}', None), ('{"a": 1}', "Required field 'b' ontbreekt"), ("[1]", "Data moet een object zijn"), (None, "Data moet een object zijn"),
     ('{"a": "[[[[[[[[[[[[[", "b": "\\"{{{{{{{{{{{{"}', None), ('{"b": 0, "a": ' + "[" * 9 + "]" * 9 + "}", None),
     ('{"b": 0, "a": ' + "[" * 10 + "]" * 10 + "}", "JSON te diep genest (max 10 levels)")],
)
def test_payloads(values, payload, problem):
    assert values(payload, lambda c: admission.json_problem(c, ["a", "b"])) == problem


@pytest.mark.parametrize(("size", "shown"), [(0, "0 Bytes"), (1, "1 Bytes"), (1536, "1.5 KB"), (MB, "1 MB"), (5 * 1024 * MB, "5 GB")])
def test_human_size(spark, size, shown):
    assert spark.range(1).select(text_functions.human_size(F.lit(size)).alias("x")).first()["x"] == shown


def test_encodings(spark):
    df = spark.createDataFrame([("﻿café".encode(),), ("café".encode("latin-1"),)], "content binary")
    rows = df.select(admission.is_utf8(F.col("content")).alias("ok"), admission.decode_text(F.col("content")).alias("t"), admission.encoding_warning(F.col("content")).alias("w")).collect()
    assert [(r["ok"], r["t"], r["w"] is None) for r in rows] == [(True, "café", True), (False, "café", False)]


def test_csv_with_mark_and_signs(spark, tmp_path):
    rows = [("é ö ü", "Ω, \"x\"", "regel 1\nregel 2"), (" rand ", "Привет", "=1+1"), ("日本", None, "-5")]
    df = spark.createDataFrame(rows, "`=naam` string, b string, c string")
    path = str(tmp_path / "out")
    writers.write_table_csv(df.coalesce(1), path)
    part = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbf'=naam,")
    back = files.read_table_csv(spark, path)
    assert back.columns == ["'=naam", "b", "c"]
    assert [tuple(r) for r in back.collect()] == [rows[0], (" rand ", "Привет", "'=1+1"), ("日本", None, "'-5")]


def test_texts_keep_line_breaks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿een\ntwee\n".encode())
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_texts_any_encoding(spark, str(tmp_path)).collect()}
    assert texts == {"a.txt": "een\ntwee\n", "b.md": "café"}
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "een\ntwee\n"
    catalogue = files.file_catalogue(spark, str(tmp_path))
    assert {(r["name"], r["extension"], r["length"]) for r in catalogue.collect()} == {("a.txt", "txt", 12), ("b.md", "md", 4)}
    assert "content" not in catalogue.columns


def test_docx(spark):
    good = docx_bytes("een\n\ndrie <x> & y", "voet")
    df = spark.createDataFrame([("a.docx", good), ("b.docx", good[:40]), ("c.docx", b"geen zip"), ("d.docx", b"\xd0\xcf\x11\xe0rest")], "path string, content binary")
    runs = office.read_docx_runs(df)
    texts = {r["path"]: r["text"] for r in office.read_docx_texts(df).where("error is null").collect()}
    assert texts == {"a.docx": "een\n\ndrie <x> & y"}
    assert [r["text"] for r in runs.where("part = 'footer1'").collect()] == ["voet"]
    status = {r["path"]: (r["valid"], r["error"]) for r in office.read_status(runs).collect()}
    assert status["a.docx"] == (True, None)
    assert status["c.docx"] == (False, "Word document is corrupt (geen valide ZIP)")
    assert "wachtwoord" in status["d.docx"][1] and not status["b.docx"][0]
    ok, bad = office.quarantine(df, office.read_status(runs))
    assert [r["path"] for r in ok.collect()] == ["a.docx"] and bad.count() == 3


def test_docx_with_broken_xml(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document")
    df = spark.createDataFrame([("x.docx", out.getvalue())], "path string, content binary")
    assert office.read_docx_runs(df).first()["error"].startswith("Word document kan niet worden gelezen")


def test_xlsx(spark):
    book = xlsx_bytes({"een": [["nr", "naam", "nr"], [1, "a", 10], [2, None, 20]], "leeg": [["nr"]], "f": [["x"], ["=A1"]]})
    df = spark.createDataFrame([("b.xlsx", book), ("stuk.xlsx", b"PK")], "path string, content binary")
    cells = office.read_xlsx_cells(df)
    table = office.cells_to_table(office.only_sheets(cells, ["een"]), {"nr": "long", "naam": "string"})
    assert {(r["row_idx"], r["nr"], r["naam"]) for r in table.collect()} == {(2, 10, "a"), (3, 20, None)}
    formulas = {r["sheet"]: r["has_formulas"] for r in admission.has_formula(cells.where("error is null")).collect()}
    assert formulas == {"een": False, "leeg": False, "f": True}
    previews = {r["sheet"]: r for r in office.sheet_previews(cells).collect()}
    assert previews["een"]["preview"] == [["1", "a", "10"], ["2", "", "20"]] and previews["leeg"]["rows"] == 0
    assert previews["leeg"]["preview"] == []
    assert cells.where("error is not null").count() == 1


def test_sheet_selection(spark):
    df = spark.createDataFrame([(["b", "x"], ["a", "b"]), (None, ["a", "b"])], "chosen array<string>, existing array<string>")
    kept = df.select(admission.selected_sheets(F.col("chosen"), F.col("existing")).alias("s")).collect()
    assert [r["s"] for r in kept] == [["b"], ["a", "b"]]
    none = spark.createDataFrame([(["x"], ["a"])], df.schema).select(admission.selected_sheets(F.col("chosen"), F.col("existing")).alias("s"))
    with pytest.raises(Exception, match="No valid sheets"):
        none.collect()


def test_audit_lines(spark):
    lines = [
        "2024-01-02T03:04:05.%fZ [SESSION:s1] ANONYMIZE_START file=mijn bestand.txt type=text",
        "2024-01-02T03:04:06.123456Z [SESSION:s1] ANONYMIZE_ERROR file=a.txt error=kan niet: type=x niet lezen",
        "2024-01-02T03:04:07Z [SESSION:s1] MAPPING_SAVED mappings=15 encrypted=true",
        "ruis",
    ]
    rows = logs.parse_audit(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["action"] for r in rows] == ["ANONYMIZE_START", "ANONYMIZE_ERROR", "MAPPING_SAVED"]
    assert rows[0]["details"] == {"file": "mijn bestand.txt", "type": "text"}
    assert rows[1]["details"]["error"] == "kan niet: type=x niet lezen"
    assert rows[2]["details"] == {"mappings": "15", "encrypted": "true"}
    assert rows[1]["ts"] == dt.datetime(2024, 1, 2, 3, 4, 6, 123456)


def test_audit_actions_are_known(spark):
    with pytest.raises(ValueError):
        writers.audit_events(spark.range(1), "IETS", F.lit("s"), F.current_timestamp())


def test_output_names(spark):
    df = spark.createDataFrame([("id1", "mijn.rapport.docx"), ("id2", "kaal")], "f string, n string")
    named = df.select(writers.output_name(F.col("f"), F.col("n"), F.lit(dt.datetime(2024, 1, 1, 9, 5))).alias("o"))
    out = [r["o"] for r in named.collect()]
    assert out == ["id1_mijn.rapport_ann_0905.docx", "id2_kaal_ann_0905"]
    assert [r["x"] for r in named.select(writers.display_name(F.col("o")).alias("x")).collect()] == ["mijn.rapport_ann_0905.docx", "kaal_ann_0905"]


def test_rules_from_json_have_defaults(spark):
    df = spark.createDataFrame([(2, '{"id": "b", "columnName": "c"}'), (1, '{"originalTerm": "x", "isRegex": true}')], "n int, value string")
    text = config.as_text_rules(config.text_rules(df, order_col="n"))
    assert [(r.original_term, r.is_regex) for r in text] == [("x", True), ("", False)]
    column = config.as_column_rules(config.column_rules(df, order_col="n"))[1]
    assert column == columns.ColumnRule(id="b", column_name="c", random_range_percent=10.0)


def test_too_many_rules_and_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(config, "MOST_RULES", 2)
    monkeypatch.setattr(config, "MOST_PATTERNS", 1)
    rules = config.text_rules(spark.createDataFrame([(i, '{"originalTerm": "x"}') for i in range(3)], "n int, value string"), order_col="n")
    with pytest.raises(ValueError, match="more than 2 rules"):
        config.as_text_rules(rules)
    with pytest.raises(ValueError, match="more than 1 patterns"):
        config.as_registry(config.registry_table(spark))
    with pytest.raises(ValueError, match="more than 1 patterns"):
        config.annotate_findings(spark.createDataFrame([("email",)], "pattern string"), config.registry_table(spark))


# --- mappings -------------------------------------------------------------------


def _mapping(spark, n=5):
    return spark.createDataFrame([("corpus", "item", f"[ITEM_{i}]", f"waarde {i}") for i in range(1, n + 1)], "scope_id string, kind string, placeholder string, original string")


def test_encryption_and_wrong_key(spark):
    known = _mapping(spark)
    sealed = mapping.encrypt_mapping(known, "0123456789abcdef")
    assert dict(sealed.dtypes)["original"] == "binary"
    assert mapping.decrypt_mapping(sealed, "0123456789abcdef").exceptAll(known).count() == 0
    with pytest.raises(Exception, match="wrong key"):
        mapping.decrypt_mapping(sealed, "fedcba9876543210").collect()


def test_numbers_go_on(spark):
    known = _mapping(spark, 3)
    values = spark.createDataFrame([("nieuw", 5), ("waarde 2", 1), ("eerder", 2), ("nieuw", 9)], "original string, seen long")
    new = mapping.allocate(values, known).collect()
    assert {(r["original"], r["placeholder"]) for r in new} == {("eerder", "[ITEM_4]"), ("nieuw", "[ITEM_5]")}
    assert mapping.last_number(known.limit(0)) == 0


@pytest.mark.parametrize(("placeholder", "number"), [("[ITEM_123]", 123), ("[TEL-001]", None), ("[NAAM_X-2]", None), ("x", None)])
def test_counter_recovery(values, placeholder, number):
    assert values(placeholder, mapping.suffix_number) == number


def test_json_forms(spark):
    exported = mapping.export_json(_mapping(spark))
    text = exported.first()["json"]
    assert '"total_items":5' in text and '"version":"1.0"' in text
    assert mapping.load_json(exported, "json", "scope_id").count() == 5
    parts = mapping.export_json(_mapping(spark, 500), entries_per_object=50)
    assert parts.count() > 1 and mapping.load_json(parts, "json").select("placeholder").distinct().count() == 500
    sealed = spark.createDataFrame([(text,), ("gAAAAABk",)], "v string").select(mapping.is_encrypted(F.col("v")).alias("e"))
    assert [r["e"] for r in sealed.collect()] == [False, True]


def test_restored_cell_becomes_a_number(spark):
    df = spark.createDataFrame([("[P_1]", "12.5"), ("x", "x"), ("[N_1]", "Jan")], "a string, b string")
    assert [r[0] for r in df.select(restore.number_if_changed(F.col("a"), F.col("b"))).collect()] == [12.5, None, None]


def test_a_small_file_that_unzips_large_is_an_error_row(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("word/document.xml", "w", force_zip64=True) as entry:
        for _ in range(1024):
            entry.write(bytes(1 << 20))
    assert out.tell() < 2 << 20
    bomb = spark.createDataFrame([("b.docx", out.getvalue()), ("a.docx", docx_bytes("goed"))], "path string, content binary")
    (bad,) = office.read_docx_runs(bomb).where("error is not null").collect()
    assert bad["path"] == "b.docx" and "1024 MB" in bad["error"]
    (sheet,) = office.read_xlsx_cells(bomb.where("path = 'b.docx'")).collect()
    assert "too large" in sheet["error"]
    assert office.read_docx_texts(bomb).where("error is null").collect()[0]["text"] == "goed"


@pytest.mark.parametrize("batch", [False, True])
def test_originals_by_scope_as_latest_entries(spark, batch):
    rows = [("d1", "[A-1]", "x", 1), ("d1", "[A-1]", "a", 2), ("d1", "[B-1]", "q", 1), ("d1", "[A-1]", "x", 1), ("d2", "[A-1]", "z", 5), (None, "[A-1]", "n", 1)]
    df = spark.createDataFrame(rows, "scope_id string, placeholder string, original string, batch long")
    df = df if batch else df.drop("batch")
    wanted = {(r["scope_id"], r["placeholder"]): r["original"] for r in mapping.latest_entries(df).collect()}
    got = {(r["scope_id"], k): v for r in mapping.originals_by_scope(df).collect() for k, v in r["_originals"].items()}
    assert got == wanted


def test_a_long_driver_side_mapping_is_refused(spark):
    with pytest.raises(ValueError, match="restore_cells"):
        restore.restore_with_dict(F.lit("x"), {f"[A_{i}]": "y" for i in range(501)})


def test_sessions(spark):
    a, b = "123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456-426614174001"
    df = spark.createDataFrame([(a, 1), (b, 2)], "session_id string, v int")
    assert [r["v"] for r in admission.of_session(df, a).collect()] == [1]
    assert [r["v"] for r in admission.without_session(df, a).collect()] == [2]
    assert admission.without_session(df, "geen").count() == 2


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from cloakframe.operators import numbering

    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default=None):
            return self.folder if key == "spark.checkpoint.dir" else default

    class Session:
        def __init__(self, folder):
            self.conf = Conf(folder)
            self.sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        numbering.shared_folder(Session(None))
    assert numbering.shared_folder(Session("hdfs:///gedeeld")) == "hdfs:///gedeeld"
