import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import catalogue as cat
from cloakframe.operators import monitor, redact, restore, rules
from cloakframe.plans import text_job
from cloakframe.plans.restore_job import restore_texts


def _apply(spark, text, rule_list, **options):
    df = spark.createDataFrame([(text,)], "text string")
    row = rules.apply_rules(df, rule_list, **options).first()
    return row["redacted"], [(e["ruleId"], e["count"]) for e in row["rule_log"]]


@pytest.mark.parametrize("chained", [40, 0])
class TestRules:
    def test_literal_ignores_case_by_default(self, spark, chained):
        assert _apply(spark, "Jan jan JAN", [{"id": "a", "originalTerm": "jan", "replacementTerm": "X"}], chained=chained) == ("X X X", [("a", 3)])

    def test_case_sensitive(self, spark, chained):
        rule = {"id": "a", "originalTerm": "jan", "replacementTerm": "X", "caseSensitive": True}
        assert _apply(spark, "Jan jan", [rule], chained=chained) == ("Jan X", [("a", 1)])

    def test_literal_with_signs(self, spark, chained):
        rule = {"id": "a", "originalTerm": "a.b*(c)$", "replacementTerm": r"$1\2"}
        assert _apply(spark, "axb a.b*(c)$", [rule], chained=chained) == (r"axb $1\2", [("a", 1)])

    def test_remove(self, spark, chained):
        rule = {"id": "a", "originalTerm": " geheim", "removeInsteadOfReplace": True, "replacementTerm": "niet"}
        df = spark.createDataFrame([("een geheim hier",)], "text string")
        row = rules.apply_rules(df, [rule], chained=chained).first()
        assert row["redacted"] == "een hier"
        assert row["rule_log"][0]["replacedWith"] == "[VERWIJDERD]"

    def test_order_and_counts(self, spark, chained):
        chain = [
            {"id": "1", "originalTerm": "a", "replacementTerm": "b"},
            {"id": "2", "originalTerm": "b", "replacementTerm": "cc"},
            {"id": "3", "originalTerm": "a", "replacementTerm": "z"},
        ]
        assert _apply(spark, "aab", chain, chained=chained) == ("cccccc", [("1", 2), ("2", 3)])

    def test_template(self, spark, chained):
        rule = {"id": "t", "originalTerm": r"(?P<year>\d{4})-(\d\d)", "isRegex": True, "replacementTerm": r"\2/\g<year>$5"}
        assert _apply(spark, "op 2024-03", [rule], chained=chained) == ("op 03/2024$5", [("t", 1)])

    def test_skipped_rules(self, spark, chained):
        bad = [
            {"id": "leeg", "originalTerm": ""},
            {"id": "regex", "originalTerm": "", "isRegex": True},
            {"id": "fout", "originalTerm": "(", "isRegex": True},
            {"id": "java", "originalTerm": "(?(1)a|b)x", "isRegex": True},
        ]
        text, log = _apply(spark, "tekst", bad, chained=chained)
        assert text == "tekst"
        assert {i for i, _ in log} >= {"regex", "fout"} and all(n == 0 for _, n in log) and "leeg" not in dict(log)

    def test_long_text(self, spark, chained):
        text, log = _apply(spark, "geheim " * 10000, [{"id": "g", "originalTerm": "geheim", "replacementTerm": "x"}], chained=chained)
        assert text == "x " * 10000 and log == [("g", 10000)]


def test_filter_on_the_outcome_of_many_rules(spark):
    """A pushed-down filter must not multiply the chain of rules."""
    chain = [{"id": str(i), "originalTerm": f"w{i}x", "replacementTerm": f"w{i + 1}x"} for i in range(30)]
    df = spark.createDataFrame([("w0x",)], "text string")
    out = rules.apply_rules(df, chain).where(F.col("redacted").contains("w30x"))
    assert rules.explode_log(out).count() == 30


def test_default_placeholder():
    filled = rules.fill_default(rules.parse_rules([{"originalTerm": "a"}, {"originalTerm": "b", "removeInsteadOfReplace": True}]))
    assert [r.replacement_term for r in filled] == ["[ANONIEM]", ""]


@pytest.mark.parametrize(
    ("template", "java"), [(r"\1", "$1"), (r"\g<2>0", r"$2\0"), (r"a$b", r"a\$b"), (r"\\", r"\\"), (r"x\n", "x\n"), (r"\g<na_m>1", r"${naUm}\1")]
)
def test_templates(template, java):
    assert rules.java_replacement(template) == java


@pytest.mark.parametrize(
    ("pattern", "ok"),
    [("abc", True), ("a" * 1001, False), ("(?:a)++", False), ("(?:a)**", False), ("(?:a){2,9}", False), ("(", False), (r"\d{4}", True)],
)
def test_lint(spark, pattern, ok):
    assert (rules.lint_pattern(pattern) is None) is ok
    df = spark.createDataFrame([(pattern,)], "p string")
    assert rules.lint_patterns(df, "p").first()["is_valid"] is ok


def test_fixed_counts_are_distinct_in_the_original(spark):
    df = spark.createDataFrame([("06-12345678 en 06-12345678, a@b.nl",)], "text string")
    row = redact.redact_fixed_with_counts(df).first()
    assert (row["phone_count"], row["email_count"]) == (1, 1)
    assert row["redacted"] == "[TEL VERWIJDERD] en [TEL VERWIJDERD], [EMAIL VERWIJDERD]"


def test_placeholders_are_literal(spark):
    df = spark.createDataFrame([("06-12345678",)], "text string")
    assert redact.redact_fixed(df, phone_placeholder=r"$0\1").first()["redacted"] == r"$0\1"


@pytest.mark.parametrize("placeholder", ["[TEL VERWIJDERD]", "", "+31", "(06", "0.0", "-"])
def test_skipping_patterns_changes_nothing(spark, placeholder):
    """Chained replacement equals Python's, whatever the placeholder forms with its neighbours."""
    rng = random.Random(11)
    pieces = ["06", "+3", "1", "+31", "00", "31", "6", " ", "-", ".", "(", ")", "12345678", "1234567", "12", "020", "a", "@", "x.nl"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 20))) for _ in range(4000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["redacted"] for r in redact.redact_fixed(df, phone_placeholder=placeholder).collect()}
    for i, text in enumerate(texts):
        for _, regex in cat.PHONE_PATTERNS:
            text = re.sub(regex, lambda _: placeholder, text)
        for _, regex in cat.EMAIL_PATTERNS:
            text = re.sub(regex, "[EMAIL VERWIJDERD]", text)
        assert got[i] == text, texts[i]


def test_reversible_numbers_and_longest_first(spark):
    df = spark.createDataFrame([("06-12345678, 06-87654321, 06-12345678",)], "text string")
    row = redact.redact_reversible(df).first()
    assert row["redacted"] == "[TEL-001], [TEL-002], [TEL-001]"
    assert [m["placeholder"] for m in row["mapping"]] == ["[TEL-001]", "[TEL-002]"]


TEXTS = [
    (0, "Bel 06-12345678 of mail a@b.nl"), (1, "Nogmaals 06-12345678 en c@d.nl, [TEL-009] blijft"),
    (2, "niets"), (3, "a@b.nl a@b.nl 06-11111111"), (4, ""),
]


@pytest.mark.parametrize("scope", ["document", "corpus"])
def test_restore_undoes_redaction(spark, scope):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    if scope == "document":
        redacted = redact.redact_reversible(df)
        mapping = redact.mapping_rows(redacted, "doc_id")
    else:
        redacted, mapping = redact.redact_corpus(df, "doc_id")
    out = restore_texts(redacted.select("doc_id", "redacted"), mapping, "doc_id", scope=scope)
    assert {r["doc_id"]: r["restored"] for r in out.collect()} == dict(TEXTS)


def test_corpus_scope_is_consistent(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    redacted, mapping = redact.redact_corpus(df, "doc_id")
    by_id = {r["doc_id"]: r["redacted"] for r in redacted.collect()}
    assert by_id[0] == "Bel [TEL-002] of mail [EMAIL-001]"
    assert by_id[3] == "[EMAIL-001] [EMAIL-001] [TEL-001]"
    assert mapping.count() == 4


def test_nothing_is_found_after_redaction(spark):
    from cloakframe.operators import detect

    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    left = redact.redact_fixed(df).select(
        (F.size(detect.find_phones(F.col("redacted"))) + F.size(detect.find_emails(F.col("redacted")))).alias("n")
    )
    assert left.agg(F.sum("n")).first()[0] == 0


def test_job_report_logs_and_totals(spark):
    df = spark.createDataFrame([(1, "06-12345678 geheim GEHEIM a@b.nl")], "doc_id long, text string")
    out = text_job.redact_texts(df, [{"id": "m", "originalTerm": "geheim"}])
    row = out.first()
    assert row["redacted"] == "[TEL VERWIJDERD] [ANONIEM] [ANONIEM] [EMAIL VERWIJDERD]"
    assert [(e["ruleId"], e["count"]) for e in row["rule_log"]] == [("auto_phone", 1), ("auto_email", 1), ("m", 2)]
    totals = monitor.job_totals(rules.explode_log(out, "doc_id")).first()
    assert totals.asDict() == {"total_phones": 1, "total_emails": 1, "total_manual_replacements": 2, "total_items": 4}


def test_job_without_detection(spark):
    df = spark.createDataFrame([("06-12345678",)], "text string")
    row = text_job.redact_texts(df, auto_detect=False).first()
    assert row["redacted"] == "06-12345678" and row["rule_log"] == []


def test_restore_with_small_mapping(values):
    assert values("[A_1] en [A_1]", lambda c: restore.restore_with_dict(c, {"[A_1]": "x$1"})) == "x$1 en x$1"


def test_preview_gives_error_rows(spark):
    df = spark.createDataFrame([(1, "a@b.nl", None), (2, None, "stuk")], "id long, text string, problem string")
    rows = {r["id"]: r for r in text_job.preview_texts(df, "id", error_col="problem").collect()}
    assert rows[1]["report"]["emails"]["count"] == 1 and rows[1]["error"] is None
    assert rows[2]["error"] == "stuk" and rows[2]["report"] is None
