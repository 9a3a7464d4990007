"""Text jobs: report, automatic redaction, user rules, logs and mapping in one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..functions.text import join_paragraphs, split_paragraphs
from ..operators import detect
from ..operators.redact import redact_fixed, redact_reversible, replace_emails, replace_phones
from ..operators.rules import RULE_LOG_TYPE, apply_rules, fill_default, parse_rules


def _auto_entry(fixed: tuple[str, str, str], suffix: str, shown: Column, count: Column) -> Column:
    rule_id, label, pattern = fixed
    return F.when(
        count > 0,
        F.struct(
            F.lit(rule_id).alias("ruleId"),
            F.lit(label + suffix).alias("originalTermDisplay"),
            F.lit(pattern).alias("appliedPattern"),
            shown.alias("replacedWith"),
            count.alias("count"),
        ),
    )


def auto_log(report: Column, reversible: bool, phone_placeholder: str, email_placeholder: str) -> Column:
    """Log entries of the automatic redaction, one per kind that occurs."""
    suffix = cat.REVERSIBLE_SUFFIX if reversible else ""
    phones, emails = report["phone_numbers"]["count"], report["emails"]["count"]

    def shown(count: Column, placeholder: str) -> Column:
        return F.format_string(cat.UNIQUE_PLACEHOLDERS, count) if reversible else F.lit(placeholder)

    return F.array_compact(
        F.array(
            _auto_entry(cat.PHONE_LOG, suffix, shown(phones, phone_placeholder), phones),
            _auto_entry(cat.EMAIL_LOG, suffix, shown(emails, email_placeholder), emails),
        )
    ).cast(RULE_LOG_TYPE)


def redact_texts(
    df: DataFrame,
    rules: list | None = None,
    text_col: str = "text",
    auto_detect: bool = True,
    reversible: bool = False,
    phone_placeholder: str = cat.PHONE_PLACEHOLDER,
    email_placeholder: str = cat.EMAIL_PLACEHOLDER,
    general_placeholder: str = cat.GENERAL_PLACEHOLDER,
) -> DataFrame:
    """Adds ``redacted``, ``report``, ``rule_log`` and, if reversible, ``mapping``.

    The report describes the original text.  Nothing is shuffled, and the same
    plan runs on a stream.
    """
    out = df.withColumn("redacted", F.col(text_col))
    if auto_detect:
        out = detect.with_report(out, text_col)
        if reversible:
            out = redact_reversible(out, text_col, found={"phone": F.col("phones"), "email": F.col("emails")})
        else:
            has_phones = F.size("phones") > 0
            out = redact_fixed(out, text_col, phone_placeholder, email_placeholder, phones_present=has_phones)
        out = out.withColumn("_auto_log", auto_log(F.col("report"), reversible, phone_placeholder, email_placeholder)).drop("phones", "emails")
    else:
        out = out.withColumn("_auto_log", F.array().cast(RULE_LOG_TYPE))
    manual = fill_default(parse_rules(rules or []), general_placeholder)
    out = apply_rules(out, manual, "redacted", "redacted")
    return out.withColumn("rule_log", F.concat("_auto_log", "rule_log")).drop("_auto_log")


def redact_paragraphs(text: Column) -> Column:
    """Fixed redaction paragraph by paragraph, joined again."""
    return join_paragraphs(F.transform(split_paragraphs(text), lambda p: replace_emails(replace_phones(p))))


def redact_runs(runs: DataFrame, rules: list | None = None, **options) -> DataFrame:
    """Redaction of every run of a document on its own; empty runs stay as they are."""
    return redact_texts(runs.where(F.col("error").isNull()), rules, "text", **options)


def preview_texts(documents: DataFrame, id_col: str, text_col: str = "text", error_col: str | None = None, **options) -> DataFrame:
    """Preview row per document; an unreadable document gives an error row."""
    readable = documents.where(F.col(error_col).isNull()) if error_col else documents
    ok = detect.with_preview(readable, text_col, **options).select(
        id_col, "preview_text", "report", F.lit(None).cast("string").alias("error")
    )
    if not error_col:
        return ok
    unreadable = documents.where(F.col(error_col).isNotNull()).select(id_col, F.col(error_col).alias("error"))
    return ok.unionByName(unreadable, allowMissingColumns=True)


def batch_results(processed: DataFrame, failed: DataFrame, id_col: str, name_col: str = "original_name") -> DataFrame:
    """``(id, original_name, status, error)`` for the whole batch."""
    ok = processed.select(id_col, name_col, F.lit("anonymized").alias("status"), F.lit(None).cast("string").alias("error"))
    bad = failed.select(id_col, F.coalesce(name_col, F.lit(cat.UNKNOWN_NAME)).alias(name_col), F.lit("error").alias("status"), "error")
    return ok.unionByName(bad)


def route_by_type(files: DataFrame, type_col: str = "file_type") -> dict[str, DataFrame]:
    """Files for the text plan, the table plan, and those with no plan."""
    kind = F.col(type_col)
    return {
        "text": files.where(kind.isin("txt", "docx")),
        "table": files.where(kind == "xlsx"),
        "unsupported": files.where(~kind.isin("txt", "docx", "xlsx")).withColumn(
            "error", F.format_string(cat.UNSUPPORTED_TYPE, kind)
        ),
    }
