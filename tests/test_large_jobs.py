"""Work that a job does once, and tasks whose share does not grow with the table."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import columns, mapping, monitor, numbering, redact, restore
from workload.inputs import TASK_ROWS, spread


def _plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_narrow_table_is_dealt_by_its_rows(spark):
    rows = 40 * TASK_ROWS
    assert spread(spark.range(0, rows, 1, 2), most=4).rdd.getNumPartitions() == 40


def test_heavy_filter_stays_behind_the_exchange(spark, capsys):
    found = spread(spark.range(0, 10, 1, 1).select(F.col("id").cast("string").alias("text"))).where(F.col("text").rlike("[3-5]"))
    plan = _plan(found, capsys)
    assert plan.index("RLIKE") < plan.index("Exchange")  # nearer to the result
    assert found.count() == 3


def test_logs_are_split_from_one_run(spark):
    logs = spark.createDataFrame([("auto_phone", 1), ("m1", 2), (None, 3), ("auto_email", 4)], "ruleId string, count long")
    auto, manual = monitor.split_logs(logs)
    assert auto.inputFiles() and manual.inputFiles()
    assert sorted(r["count"] for r in auto.collect()) == [1, 4]
    assert [r["count"] for r in manual.collect()] == [2]


def test_value_is_decrypted_once(spark, capsys):
    key = F.lit("0123456789abcdef")
    known = spark.createDataFrame([("d", "[TEL-001]", "0612345678"), ("d", "[TEL-002]", None)], "scope_id string, placeholder string, original string")
    opened = mapping.decrypt_mapping(mapping.encrypt_mapping(known, key), key)
    opened.explain(True)
    assert capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical")[0].count("aesDecrypt") == 1
    assert sorted(opened.collect()) == sorted(known.collect())
    wrong = mapping.decrypt_mapping(mapping.encrypt_mapping(known, key), F.lit("fedcba9876543210"))
    with pytest.raises(Exception, match="wrong key"):
        wrong.collect()


def test_empty_rows_meet_a_large_lookup(spark):
    lookup = spark.createDataFrame([("a", "1")], "k string, v string")
    rows = spark.createDataFrame([], "k string, i int")
    assert numbering.lookup_join(rows, lookup, ["k"], ["v"], broadcast_bytes=0).count() == 0


def test_rows_of_frequent_keys_are_spread(spark, capsys):
    lookup = spark.createDataFrame([(str(i), i) for i in range(100)], "k string, v int")
    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "7").otherwise((F.col("id") % 120).cast("string")).alias("k"))
    joined = numbering.lookup_join(rows, lookup, ["k"], ["v"], row_id="id", broadcast_bytes=0)
    joined.explain("simple")
    exchanges = [x for x in capsys.readouterr().out.splitlines() if "hashpartitioning(_key_k" in x]
    assert exchanges and all("_salt" in x for x in exchanges)
    assert joined.where("v = 7").count() == 509 and joined.count() == 1000


def test_join_of_documents_is_dealt_by_their_bytes(spark, capsys, monkeypatch):
    monkeypatch.setattr(numbering, "TASK_BYTES", 1000)
    monkeypatch.setattr(numbering, "BROADCAST_BYTES", 0)
    rows = [(i if i % 5 else None, f"bel 06-{i % 40:08d} of mail k{i % 30}@x.nl, {i}") for i in range(200)] + [(7, None), (7, "geen"), (1, "bel 06-00000001")] * 2
    docs = spark.createDataFrame(rows, "id long, text string")
    redacted, known = redact.redact_corpus(docs, "id")
    # More tasks than the engine would choose: the bytes of the texts decide.
    assert "REPARTITION_BY_NUM" in _plan(redacted, capsys)
    assert redacted.where("redacted like '%[TEL-%[EMAIL-%'").count() == 200
    back = restore.restore_corpus(redacted, known, "id")
    assert "REPARTITION_BY_NUM" in _plan(back, capsys)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(map(tuple, back.select("id", "restored").collect()), key=key) == sorted(rows, key=key)


@pytest.mark.parametrize("shuffled", [[], [{"columnName": "Tel.nr", "anonymizationType": "shuffle"}]])
def test_odd_headers_meet_a_large_lookup(spark, monkeypatch, shuffled):
    rows = [(i, f"{i}", None if i % 9 == 0 else f"k{i % 30}@x.nl", "x") for i in range(100)]
    df = spark.createDataFrame(rows, "`rij.nr` long, `Tel.nr` string, `e-mail adres` string, `a.b` string")
    odd = [*shuffled, {"columnName": "e-mail adres", "reversible": True}, {"columnName": "a.b"}]
    run = lambda: sorted(map(tuple, columns.mask_table(df, odd, row_id="rij.nr", salt="zout").table.collect()))
    small = run()
    monkeypatch.setattr(numbering, "BROADCAST_BYTES", 0)
    assert run() == small and len(small) == 100
