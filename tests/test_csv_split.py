"""Quoted CSV cut into ranges against the built-in reader that takes a file whole."""

import random

import pytest

from cloakframe.sources import csv_cells
from cloakframe.sources.files import read_table_csv


def _whole(spark, path):
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    df = reader.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].removeprefix("﻿"))


def _same(spark, path):
    found, wanted = csv_cells.read_csv_split(spark, path), _whole(spark, path)
    assert found.columns == wanted.columns
    key = lambda r: tuple((x is not None, x or "") for x in r)
    assert sorted(map(key, found.collect())) == sorted(map(key, wanted.collect()))


def _cell(r):
    kind = r.random()
    if kind < 0.2:
        return ""
    if kind < 0.3:
        return '""'
    text = "".join(r.choice(["a", "é", " ", "日本", "x1", ";"]) for _ in range(r.randrange(1, 8)))
    if kind < 0.6:
        return text
    return '"' + "".join(r.choice([text, ",", "\n", '""', "\n\n", " "]) for _ in range(r.randrange(1, 5))) + '"'


@pytest.mark.parametrize(("seed", "end", "size"), [(1, "\n", 64), (2, "\r\n", 200), (3, "\n", 37), (4, "\n", 100_000)])
def test_same_as_read_whole(spark, tmp_path, seed, end, size):
    r = random.Random(seed)
    for i in range(2):
        rows = ["﻿naam," + '"van\nwie",' * (seed % 2) + "b,c"] + [",".join(_cell(r) for _ in range(3 + seed % 2)) for _ in range(120)]
        rows[7:7] = ["", "alleen", "1,2,3,4,5,6"]
        (tmp_path / f"{i}.csv").write_bytes((end.join(rows) + (end if i else "")).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        if size < 1000:
            assert csv_cells._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        _same(spark, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_header_only_and_long_cell(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert read_table_csv(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "l.csv").write_text('a,b\n1,"' + "regel\n" * 5000 + '"\n2,x\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = read_table_csv(spark, str(tmp_path / "l.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["a"], len(r["b"])) for r in found) == [("1", 30_000), ("2", 1)]


def test_cells_of_files(spark):
    files = spark.createDataFrame(
        [("a.csv", "﻿naam;stad\nJan;\"Den\n Haag; z\"\n;x;y\n".encode()), ("b.csv", b"n\xe9\n1\n"), ("leeg.csv", b""), ("kapot.csv", b'a,b\n"x')],
        "path string, content binary",
    )
    got = {(r["path"], r["row_idx"], r["col_idx"]): (r["header"], r["value"], r["error"]) for r in csv_cells.read_csv_cells(files).collect()}
    assert got["a.csv", 2, 2] == ("stad", "Den\n Haag; z", None) and got["a.csv", 3, 1] == ("naam", None, None) and got["a.csv", 3, 3] == ("Column 3", "y", None)
    assert got["b.csv", 2, 1] == ("né", "1", None)
    assert got["kapot.csv", None, None][2] and len([k for k in got if k[0] == "kapot.csv"]) == 1
    assert not [k for k in got if k[0] == "leeg.csv"]


def test_lines_of_cells(spark):
    cells = spark.createDataFrame([("p", 1, 1, "a"), ("p", 1, 2, 'x "y"'), ("p", 2, 1, None), ("p", 2, 2, "1,2")], "path string, row_idx int, col_idx int, v string")
    assert [r["line"] for r in csv_cells.csv_lines(cells, "v").orderBy("row_idx").collect()] == ['a,"x ""y"""', ',"1,2"']
