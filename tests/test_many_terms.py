"""The automaton over many literal rules against the rules one after the other."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import many_terms, rules
from cloakframe.operators.many_terms import Terms, fold


def _run(spark, texts, rule_list, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = rules.apply_rules(df, rule_list, **options).orderBy("id").collect()
    return [(r["redacted"], [(e["ruleId"], e["originalTermDisplay"], e["appliedPattern"], e["replacedWith"], e["count"]) for e in r["rule_log"]]) for r in out]


def _both(spark, texts, rule_list):
    assert _run(spark, texts, rule_list, chained=0, many=1) == _run(spark, texts, rule_list, chained=0, many=10**9)


def _random_rules(seed, n, replacements):
    r = random.Random(seed)
    pieces = ["a", "ab", "b", "ba", "İ", "ß", "K", "ſ", "É", "é", " ", ".", "$", "\\", "[", "x y", "日"]
    return [
        {"id": f"r{i}", "originalTerm": "".join(r.choice(pieces) for _ in range(r.randrange(1, 4))), "replacementTerm": r.choice(replacements),
         "caseSensitive": r.random() < 0.4, "removeInsteadOfReplace": r.random() < 0.2}
        for i in range(n)
    ]


TEXTS = ["", None, "abab ABBA aab", "ß SS ss K k K ſ s S", "İ i I ı é É", "x y X Y.x$\\ [日]", "a" * 50, "abba" * 30 + "É", "no match 12"]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("replacements", [["[N]", "<M>"], ["a", "ba", "b.", "", "$1", "\\", "É"]])
def test_same_as_one_after_the_other(spark, seed, replacements):
    _both(spark, TEXTS, _random_rules(seed, 14, replacements))


def test_regex_rules_and_skipped_rules_between(spark):
    more = _random_rules(9, 6, ["[N]", "c"])
    regex = [{"id": "x1", "originalTerm": "a+", "isRegex": True, "replacementTerm": "Q"}, {"id": "x2", "originalTerm": "(", "isRegex": True}, {"id": "x3", "originalTerm": "", "isRegex": True}]
    _both(spark, TEXTS, [regex[2], *more[:3], regex[1], *more[3:], *regex, *_random_rules(10, 4, ["z"])])


def test_a_removal_can_make_a_later_match():
    terms = Terms([("1", "", "", "", "1", "", True), ("2", "", "", "", "xy", "Z", True), ("3", "", "", "", "y", "w", True)])
    assert terms.apply("x1y y") == ("Z w", [(0, 1), (1, 1), (2, 1)])


def test_portions_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(many_terms, "AUTOMATON_CHARS", 12)
    _both(spark, TEXTS, _random_rules(4, 12, ["a", "[N]", "b"]))


def test_case_folding_of_every_character(spark):
    """As the engine compares: two characters match if their folds agree."""
    odd = [c for c in map(chr, range(0x80, 0x2C2F)) if fold(c) != c]
    df = spark.createDataFrame([("q" + c, "q" + fold(c)) for c in odd], "c string, f string")
    assert df.where("not regexp_like(c, concat('(?iU)', f))").collect() == []
    assert _run(spark, ["ẞß"], [{"originalTerm": "ß", "replacementTerm": "x"}], chained=0, many=1)[0][0] == "ẞx"
    _both(spark, ["ẞß K k İ i ı"], [{"originalTerm": t, "replacementTerm": f"[{i}]"} for i, t in enumerate(["ß", "ẞ", "İ", "K"])])


def test_five_thousand_terms_cost_little():
    r = random.Random(1)
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    names = [name() for _ in range(5000)]
    texts = [" ".join(name() for _ in range(60)) + " " + r.choice(names[:50]) for _ in range(1500)]
    spent = {}
    for n in (50, 5000):
        terms = Terms([(str(i), t, t, "[N]", t, "[N]", False) for i, t in enumerate(names[:n])])
        started = time.process_time()
        assert all(terms.apply(t)[1] for t in texts)
        spent[n] = time.process_time() - started
    assert spent[5000] < 3 * spent[50]


def test_a_task_holds_one_automaton_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(many_terms, "AUTOMATON_CHARS", 8)
    df = spark.createDataFrame([(1, "aap noot mies"), (2, None)], "id long, text string")
    listed = [(f"r{i}", term, term, new, term, new, False) for i, (term, new) in enumerate([("aap", "1"), ("noot", "2"), ("mies", "aap")])]
    out = many_terms.apply_terms(df, listed, F.col("text"), "out")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1
    got = {r["id"]: r["out"] for r in out.collect()}
    assert got[1]["text"] == "1 2 aap" and [e["ruleId"] for e in got[1]["log"]] == ["r0", "r1", "r2"] and got[2]["text"] is None


@pytest.mark.parametrize("chars", [many_terms.AUTOMATON_CHARS, 12])
def test_a_table_of_rules_is_the_list_of_them(spark, monkeypatch, chars):
    monkeypatch.setattr(many_terms, "AUTOMATON_CHARS", chars)
    listed = [*_random_rules(4, 30, ["a", "[N]", "b", "É"]), {"id": "e", "originalTerm": ""}, *_random_rules(5, 10, ["[N]"])]
    names = ["id", "originalTerm", "replacementTerm", "caseSensitive", "removeInsteadOfReplace"]
    rows = [(i, *(r.get(n) for n in names)) for i, r in enumerate(listed)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "`n.r` long, id string, originalTerm string, replacementTerm string, caseSensitive boolean, removeInsteadOfReplace boolean")
    assert _run(spark, TEXTS, table, order_by=["n.r"]) == _run(spark, TEXTS, listed, chained=0, many=1)


def test_rules_of_a_table_stay_off_the_driver(spark, monkeypatch):
    """The driver sees packed portions only, one at a time."""
    monkeypatch.setattr(many_terms, "AUTOMATON_CHARS", 2000)
    table = spark.range(5000).selectExpr("id as n", "concat('r', id) as id", "concat('Klant', id, '@') as originalTerm", "'[K]' as replacementTerm")
    sent, rows = [], []
    collect = type(table).collect
    share = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: sent.append(value) or share(sc, value))
    monkeypatch.setattr(type(table), "collect", lambda df: rows.append(collect(df)) or rows[-1])
    out = rules.apply_rules(spark.range(0, 6000, 100).selectExpr("id", "concat('mail klant', id, '@x') as text"), table, order_by=["n"])
    monkeypatch.undo()
    assert len(sent) > 10 and max(map(len, sent)) < 20_000 and max(map(len, rows)) <= 1
    assert {(r["id"], r["redacted"], len(r["rule_log"])) for r in out.collect()} == {(i, "mail [K]x" if i < 5000 else f"mail klant{i}@x", int(i < 5000)) for i in range(0, 6000, 100)}


def test_texts_are_held_in_groups(spark, monkeypatch):
    monkeypatch.setattr(many_terms, "AUTOMATON_CHARS", 8)
    monkeypatch.setattr(many_terms, "HELD_CHARS", 500)
    monkeypatch.setattr(many_terms, "ROW_CHARS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = [None if i % 11 == 0 else f"aap noot {i} mies" for i in range(300)]
        _both(spark, texts, [{"id": f"r{i}", "originalTerm": t, "replacementTerm": n} for i, (t, n) in enumerate([("aap", "1"), ("noot", "2"), ("mies", "aap")])])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rule_and_no_regex_in_a_table(spark):
    none = spark.createDataFrame([], "n long, originalTerm string, isRegex boolean")
    assert _run(spark, ["abc", None], none, order_by=["n"]) == [("abc", []), (None, [])]
    regex = spark.createDataFrame([(1, "a+", True)], none.schema)
    with pytest.raises(ValueError, match="literal"):
        _run(spark, ["abc"], regex, order_by=["n"])
    with pytest.raises(ValueError, match="order_by"):
        _run(spark, ["abc"], none)
