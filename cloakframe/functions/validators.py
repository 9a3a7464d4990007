"""Checksum and format predicates as pure Column expressions (JVM-side)."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import catalogue as cat
from .text import engine_pattern


def is_valid_bsn(value: Column) -> Column:
    """Eleven-test on nine digits; formatting is ignored, repdigits are refused."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    # Weights run 9, 8, ..., 2 and the last digit counts -1.
    total = F.aggregate(
        F.split(digits, ""),
        F.struct(F.lit(9).alias("weight"), F.lit(0).alias("total")),
        lambda acc, d: F.struct(
            F.when(acc["weight"] == 2, F.lit(-1)).otherwise(acc["weight"] - 1).alias("weight"),
            (acc["total"] + acc["weight"] * F.coalesce(d.try_cast("int"), F.lit(0))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return digits.rlike(r"^\d{9}$") & ~digits.rlike(r"^(\d)\1{8}$") & (total % 11 == 0)


def is_valid_iban(value: Column) -> Column:
    """Country length and mod-97, as a running remainder so nothing overflows."""
    compact = F.upper(F.regexp_replace(value, r"(?U)\s", ""))
    country = F.substring(compact, 1, 2)
    length_ok = F.lit(False)
    for code, length in cat.IBAN_LENGTHS.items():
        length_ok = length_ok | ((country == code) & (F.length(compact) == length))
    rotated = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    remainder = F.aggregate(
        F.split(rotated, ""),
        F.lit(0),
        lambda acc, ch: F.when(ch.rlike("^[0-9]$"), (acc * 10 + F.coalesce(ch.try_cast("int"), F.lit(0))) % 97)
        .when(ch.rlike("^[A-Z]$"), (acc * 100 + F.ascii(ch) - 55) % 97)
        .otherwise(acc),
    )
    return length_ok & compact.rlike("^[0-9A-Z]+$") & (remainder == 1)


def is_valid_postal_code(value: Column) -> Column:
    """Four digits and two letters that are not reserved."""
    compact = F.upper(F.regexp_replace(value, r"(?U)\s", ""))
    return compact.rlike(r"(?U)^\d{4}\p{L}{2}$") & ~F.substr(compact, F.lit(5)).isin(cat.POSTAL_RESERVED)


def is_canonical_uuid(value: Column) -> Column:
    """Lower-case 8-4-4-4-12 form; NULL and other spellings are False."""
    return F.coalesce(value.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


# SQL forms of the predicates.  They are plain SQL UDFs, which Catalyst inlines.
_SQL_FUNCTIONS = {
    "is_valid_bsn": r"""
        regexp_replace(value, '[^0-9]', '') rlike r'^\d{9}$'
        and not regexp_replace(value, '[^0-9]', '') rlike r'^(\d)\1{8}$'
        and aggregate(
              transform(sequence(1, 9), i ->
                coalesce(try_cast(substr(regexp_replace(value, '[^0-9]', ''), i, 1) as int), 0)
                * if(i = 9, -1, 10 - i)),
              0, (a, x) -> a + x) % 11 = 0""",
    "is_valid_iban": r"""
        length(upper(regexp_replace(value, r'(?U)\s', ''))) =
          element_at(map('NL', 18, 'DE', 22, 'BE', 16, 'FR', 27),
                     substr(upper(regexp_replace(value, r'(?U)\s', '')), 1, 2))
        and upper(regexp_replace(value, r'(?U)\s', '')) rlike '^[0-9A-Z]+$'
        and aggregate(
              split(concat(substr(upper(regexp_replace(value, r'(?U)\s', '')), 5),
                           substr(upper(regexp_replace(value, r'(?U)\s', '')), 1, 4)), ''),
              0, (a, c) -> case when c rlike '^[0-9]$' then (a * 10 + coalesce(try_cast(c as int), 0)) % 97
                                when c rlike '^[A-Z]$' then (a * 100 + ascii(c) - 55) % 97
                                else a end) = 1""",
    "is_valid_postal_code": r"""
        upper(regexp_replace(value, r'(?U)\s', '')) rlike r'(?U)^\d{4}\p{L}{2}$'
        and substr(upper(regexp_replace(value, r'(?U)\s', '')), 5) not in ('SA', 'SD', 'SS')""",
    "is_canonical_uuid": r"""
        coalesce(value rlike '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$', false)""",
}


def _sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_matches(patterns: list[tuple[str, str]]) -> str:
    found = [f"regexp_extract_all(value, {_sql_string(engine_pattern(regex))}, 0)" for _, regex in patterns]
    return f"concat({', '.join(found)})"


def _sql_finders() -> dict[str, str]:
    """Bodies of the finders: distinct sorted phones and e-mails, checked numbers."""
    checked = {
        "find_bsns": ("is_valid_bsn", cat.BSN_PATTERNS),
        "find_ibans": ("is_valid_iban", cat.IBAN_PATTERNS),
        "find_postal_codes": ("is_valid_postal_code", cat.POSTAL_PATTERNS),
    }
    bodies = {
        "find_phones": f"sort_array(array_distinct({_sql_matches(cat.PHONE_PATTERNS)}))",
        "find_emails": f"sort_array(array_distinct({_sql_matches(cat.EMAIL_PATTERNS)}))",
    }
    for name, (check, patterns) in checked.items():
        # A SQL function cannot be called inside a lambda, so its body is written out.
        body = re.sub(r"\bvalue\b", "m", _SQL_FUNCTIONS[check])
        bodies[name] = f"filter({_sql_matches(patterns)}, m -> {body})"
    return bodies


def _sql_find_pii(finders: dict[str, str]) -> str:
    """Body of ``find_pii``: all findings of the default registry with their confidence."""
    finder_of = {
        "detect_phones": ("find_phones", cat.PHONE_CONFIDENCE), "detect_emails": ("find_emails", cat.EMAIL_CONFIDENCE),
        "detect_bsn": ("find_bsns", cat.BSN_CONFIDENCE), "detect_iban": ("find_ibans", cat.IBAN_CONFIDENCE),
        "detect_postal_codes": ("find_postal_codes", cat.POSTAL_CONFIDENCE),
    }
    place = "position(found, value)"
    snippet = (
        f"lower(substr(value, greatest(1, {place} - 50), "
        f"least(length(value), {place} - 1 + 50) - greatest(0, {place} - 1 - 50)))"
    )
    parts = []
    for name, entry in cat.REGISTRY.items():
        finder, base = finder_of[entry["detector_function"]]
        words = ", ".join(_sql_string(w) for w in entry["context_words"])
        raised = min(1.0, base + entry["confidence_boost"])
        parts.append(
            f"transform({finders[finder]}, found -> named_struct('pattern', {_sql_string(name)}, 'match', found, "
            f"'confidence', if(exists(array({words}), w -> contains({snippet}, w)), {raised}D, {base}D)))"
        )
    return f"concat({', '.join(parts)})"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Make the predicates and finders callable from SQL in this session."""
    for name, body in _SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS BOOLEAN "
            f"RETURN coalesce({body}, false)"
        )
    finders = _sql_finders()
    for name, body in finders.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS ARRAY<STRING> RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION find_pii(value STRING) "
        f"RETURNS ARRAY<STRUCT<pattern: STRING, match: STRING, confidence: DOUBLE>> RETURN {_sql_find_pii(finders)}"
    )
    return [*_SQL_FUNCTIONS, *finders, "find_pii"]
