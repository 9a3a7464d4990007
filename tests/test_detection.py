import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import catalogue as cat
from cloakframe.functions import validators
from cloakframe.functions.text import engine_pattern
from cloakframe.operators import detect
from cloakframe.sources import config

CONTACTS = """Contactgegevens:
Telefoon: 06-12345678
Email: jan.devries@example.com
Mobiel: 0612345678, maria.jansen@bedrijf.nl
Tel: +31612345678
Info: info@amsterdam.example.com
Nood: 06 12 34 56 78
"""


@pytest.mark.parametrize(
    "phone",
    ["06-12345678", "0612345678", "+31612345678", "06 12345678", "06 12 34 56 78", "+31 6 12345678", "0031612345678",
     "(06) 12345678", "06.12.34.56.78", "010-1234567", "+31 20 1234567"],
)
def test_accepted_phone_forms(values, phone):
    assert phone in values(f"Bel {phone}.", detect.find_phones)


def test_slash_form_is_no_phone(values):
    assert values("06/12345678", detect.find_phones) == []


def test_contacts(values):
    assert len(values(CONTACTS, detect.find_phones)) == 4
    assert values(CONTACTS, detect.find_emails) == [
        "info@amsterdam.example.com", "jan.devries@example.com", "maria.jansen@bedrijf.nl",
    ]


def test_clean_text(values):
    assert values("Dit is een test zonder gegevens.", detect.find_pii) == []


@pytest.mark.parametrize("bad", ["@example.com", "user@", "user", "user@.com", "user@domain"])
def test_bad_emails(values, bad):
    assert values(bad, detect.find_emails) == []


@pytest.mark.parametrize(
    ("number", "ok"),
    [("123456782", True), ("123-45-6782", True), ("123.45.6782", True), ("123456783", False), ("000000000", False),
     ("999999999", False), ("12345678", False), ("1234567890", False), ("abcdefghi", False), ("", False)],
)
def test_eleven_test(values, number, ok):
    assert values(number, validators.is_valid_bsn) is ok


@pytest.mark.parametrize(
    ("iban", "ok"),
    [("NL91ABNA0417164300", True), ("NL91 ABNA 0417 1643 00", True), ("nl91abna0417164300", True),
     ("DE89370400440532013000", True), ("BE68539007547034", True), ("FR1420041010050500013M02606", True),
     ("NL00FAKE0000000000", False), ("NL99TEST0000000000", False), ("NL91ABNA041716", False),
     ("NL91ABNA04171643001234", False), ("XX91ABNA0417164300", False), ("", False)],
)
def test_mod_97(values, iban, ok):
    assert values(iban, validators.is_valid_iban) is ok


@pytest.mark.parametrize(
    ("code", "ok"),
    [("1012JS", True), ("1012 JS", True), ("9711LM", True), ("1234SA", False), ("1234SD", False), ("1234SS", False),
     ("12345", False), ("123AB", False), ("ABCD12", False)],
)
def test_postal_check(values, code, ok):
    assert values(code, validators.is_valid_postal_code) is ok


def test_detectors_keep_duplicates_and_order(values):
    found = values("123456782 en 123-45-6782 en 123456782, 987654321", detect.detect_bsn)
    assert [(f["match"], f["confidence"]) for f in found] == [("123-45-6782", 1.0), ("123456782", 1.0), ("123456782", 1.0)]


def test_detection_is_case_sensitive_unless_asked(values):
    assert values("nl91abna0417164300", detect.find_ibans) == []
    assert values("nl91abna0417164300", lambda c: detect.find_ibans(c, ignore_case=True)) == ["nl91abna0417164300"]


def test_context_raises_confidence(values):
    near = values("Postcode: 1012JS", detect.find_pii)
    far = values("postcode" + " " * 100 + "1012JS", detect.find_pii)
    assert [f["confidence"] for f in near] == [1.0]
    assert [f["confidence"] for f in far] == [0.9]


def test_context_counts_substrings_unless_whole_words(values):
    text = "hotel 06-12345678"
    count = lambda **o: values(text, lambda c: detect.count_context_words(c, F.lit("06-12345678"), ["tel"], **o))
    assert count() == 1
    assert count(whole_word=True) == 0


def test_summary(spark):
    df = spark.createDataFrame([("Tel 06-12345678, mail a@b.nl, 1012JS",), ("niets",)], "text string")
    rows = detect.auto_detect(df, threshold=0.8).select("summary").collect()
    assert rows[0][0].asDict() == {
        "total_matches": 3, "by_type": {"phone_nl": 1, "email": 1, "postal_code_nl": 1}, "avg_confidence": 0.97, "high_confidence": 3,
    }
    assert rows[1][0].asDict() == {"total_matches": 0, "by_type": {}, "avg_confidence": 0.0, "high_confidence": 0}


def test_disabled_and_unknown_detectors(values):
    registry = {
        "email": {"detector_function": "detect_emails"},
        "phone_nl": {"enabled": False, "detector_function": "detect_phones"},
        "odd": {"detector_function": "nothing"},
    }
    found = values("06-12345678 a@b.nl", lambda c: detect.find_pii(c, registry))
    assert [f["pattern"] for f in found] == ["email"]


def test_registry_round_trip(spark):
    assert config.as_registry(config.registry_table(spark)).keys() == cat.REGISTRY.keys()


def test_report_and_preview(spark):
    df = spark.createDataFrame([("x" * 600 + " a@b.nl c@d.nl",)], "text string")
    row = detect.with_preview(df, max_items=1).first()
    assert row["preview_text"] == "x" * 500
    assert row["report"]["emails"].asDict() == {"count": 2, "preview": ["a@b.nl"], "has_more": True}
    assert row["report"]["total_items"] == 2


def test_sql_functions_agree_with_columns(spark):
    validators.register_sql_functions(spark)
    texts = ["123456782", "NL91ABNA0417164300", "1012JS", "x", CONTACTS]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    for name, function in [
        ("is_valid_bsn", validators.is_valid_bsn), ("is_valid_iban", validators.is_valid_iban),
        ("is_valid_postal_code", validators.is_valid_postal_code), ("find_phones", detect.find_phones),
        ("find_emails", detect.find_emails), ("find_bsns", detect.find_bsns), ("find_ibans", detect.find_ibans),
        ("find_postal_codes", detect.find_postal_codes),
    ]:
        rows = df.select(F.expr(f"{name}(text)").alias("a"), function(text).alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows], name


def _random_text(rng):
    pieces = ["0", "6", "06", "+31", "00", "31", " ", "-", ".", "(", ")", "–", "12345678", "12", "7", "a", "é", "@", "x.nl", "NL91ABNA", "\n"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(1, 24)))


def test_guards_lose_nothing(spark):
    """Guarded detection equals the plain patterns of Python's engine on random text."""
    rng = random.Random(7)
    texts = [_random_text(rng) for _ in range(12000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", detect.find_phones(F.col("text")).alias("p"), detect.find_emails(F.col("text")).alias("e")).collect()

    def plain(text, patterns):
        return sorted({m for _, regex in patterns for m in re.findall(regex, text)})

    hits = 0
    for r in rows:
        text = texts[r["i"]]
        assert r["p"] == plain(text, cat.PHONE_PATTERNS), text
        assert r["e"] == plain(text, cat.EMAIL_PATTERNS), text
        hits += bool(r["p"])
    assert hits > 50


def test_look_ahead_changes_no_pattern():
    for patterns in (cat.PHONE_PATTERNS, cat.BSN_PATTERNS, cat.IBAN_PATTERNS, cat.POSTAL_PATTERNS):
        for _, regex in patterns:
            assert engine_pattern(regex).endswith(regex)


@pytest.mark.parametrize(
    "hostile",
    ["0" * 10000 + "!", "a" * 10000 + "!", "-" * 5000 + "1234567890", " " * 5000 + "1234567890", "06 " * 2500 + "!",
     "." * 5000 + "1234567890", "06123456" * 1000 + "!", "a." * 5000 + "@", "x@" + "a." * 5000],
)
def test_hostile_texts_take_bounded_time(values, hostile):
    started = time.time()
    values(hostile, detect.find_pii)
    assert time.time() - started < 20


@pytest.mark.parametrize("text", ["Ünïcödé ß", "Ελληνικά", "Кириллица", "العربية", "日本語", "😀 👩‍👩‍👧", "a​b", "é"])
def test_other_scripts_are_kept(values, text):
    from cloakframe.operators.redact import replace_emails, replace_phones

    full = f"{text} 06-12345678 {text}"
    assert values(full, lambda c: replace_emails(replace_phones(c))) == f"{text} [TEL VERWIJDERD] {text}"
