"""Detection: patterns, checksums and context words as Column expressions.

Everything here is a narrow projection.  A document never leaves its row, so a
scan of any size runs without a shuffle; only ``pattern_totals`` aggregates, and
that is a partial aggregation over as many groups as there are patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..functions.text import bind, each_struct, engine_pattern, quote_pattern, regex_flags
from ..functions.validators import is_valid_bsn, is_valid_iban, is_valid_postal_code

# Necessary conditions, cheap first.  A text that fails the guard cannot give a
# finding of the kind, so most texts cost one scan instead of one per pattern.
PHONE_GUARD = (
    r"(?U)\+31[\s\-]?\d|(?=0)\b0(?:0\s?31\s?6|\s*6[\s\)\.–—\-]*\d{2}|\d{1,3}[\s\-\.]\d{6})"
)
# What every match of a pattern holds.  Looking for it is far cheaper than the pattern.
PHONE_LITERALS = {
    "intl_plus_spaced": "+31", "intl_plus": "+31", "landline_intl": "+31", "intl_zero_spaced": "31",
    "intl_zero": "31", "parentheses": "(", "dash": "-", "dots": "6.",
}
BSN_GUARD = r"[0-9]{3}[-.]?[0-9]{2}[-.]?[0-9]{4}"
IBAN_GUARD = r"(?:NL|DE|BE|FR)\d{2}"


def has_phone_shape(text: Column) -> Column:
    return (F.contains(text, F.lit("0")) | F.contains(text, F.lit("+31"))) & text.rlike(PHONE_GUARD)


def has_email_shape(text: Column) -> Column:
    return F.contains(text, F.lit("@"))


def has_shape(text: Column, kinds) -> Column:
    """Whether a text can hold a finding of any of the kinds; cheap, never NULL."""
    tests = {
        "phone": has_phone_shape,
        "email": has_email_shape,
        "bsn": lambda t: t.rlike(BSN_GUARD),
        "iban": lambda t: t.rlike(IBAN_GUARD),
        "postal": lambda t: t.rlike(r"(?U)\d{4}\s?[A-Z]{2}"),
    }
    any_of = F.lit(False)
    for kind in kinds:
        any_of = any_of | F.coalesce(tests[kind](text), F.lit(False))
    return any_of


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def matches_of(text: Column, patterns: list[tuple[str, str]], ignore_case: bool = False) -> Column:
    """All matches, duplicates kept, pattern after pattern."""
    found = [F.regexp_extract_all(text, F.lit(engine_pattern(regex, ignore_case)), F.lit(0)) for _, regex in patterns]
    return found[0] if len(found) == 1 else F.concat(*found)


def matches_by_pattern(text: Column, patterns: list[tuple[str, str]], ignore_case: bool = False) -> Column:
    """``array<struct<name, matches>>``: what each single pattern of a catalogue finds."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.regexp_extract_all(text, F.lit(engine_pattern(regex, ignore_case)), F.lit(0)).alias("matches"),
            )
            for name, regex in patterns
        ]
    )


def _guarded(guard: Column, found: Column) -> Column:
    return F.when(guard, found).otherwise(_empty_strings())


def find_phones(text: Column) -> Column:
    """Distinct phone numbers in code-point order."""
    found = [
        _guarded(F.contains(text, F.lit(PHONE_LITERALS[name])), matches_of(text, [(name, regex)]))
        if name in PHONE_LITERALS
        else matches_of(text, [(name, regex)])
        for name, regex in cat.PHONE_PATTERNS
    ]
    return _guarded(has_phone_shape(text), F.sort_array(F.array_distinct(F.concat(*found))))


def find_emails(text: Column) -> Column:
    """Distinct e-mail addresses in code-point order."""
    found = F.sort_array(F.array_distinct(matches_of(text, cat.EMAIL_PATTERNS)))
    return _guarded(has_email_shape(text), found)


def find_bsns(text: Column) -> Column:
    """Citizen numbers that pass the eleven-test, duplicates kept."""
    return F.filter(_guarded(text.rlike(BSN_GUARD), matches_of(text, cat.BSN_PATTERNS)), is_valid_bsn)


def find_ibans(text: Column, ignore_case: bool = False) -> Column:
    """IBANs with the right length and check digits, duplicates kept."""
    guard = regex_flags(ignore_case) + IBAN_GUARD
    found = matches_of(text, cat.IBAN_PATTERNS, ignore_case)
    return F.filter(_guarded(text.rlike(guard), found), is_valid_iban)


def find_postal_codes(text: Column, ignore_case: bool = False) -> Column:
    """Postal codes without reserved letters, duplicates kept."""
    return F.filter(matches_of(text, cat.POSTAL_PATTERNS, ignore_case), is_valid_postal_code)


def _scored(found: Column, confidence: float) -> Column:
    return F.transform(
        found, lambda m: F.struct(m.alias("match"), F.lit(confidence).cast("double").alias("confidence"))
    )


def detect_phones(text: Column) -> Column:
    return _scored(find_phones(text), cat.PHONE_CONFIDENCE)


def detect_emails(text: Column) -> Column:
    return _scored(find_emails(text), cat.EMAIL_CONFIDENCE)


def detect_bsn(text: Column) -> Column:
    return _scored(find_bsns(text), cat.BSN_CONFIDENCE)


def detect_iban(text: Column, ignore_case: bool = False) -> Column:
    return _scored(find_ibans(text, ignore_case), cat.IBAN_CONFIDENCE)


def detect_postal_codes(text: Column, ignore_case: bool = False) -> Column:
    return _scored(find_postal_codes(text, ignore_case), cat.POSTAL_CONFIDENCE)


# Name -> detector.  A registry entry picks its detector by name; add your own
# with ``register_detector`` (any function from a text Column to
# ``array<struct<match, confidence>>``).
DETECTORS: dict[str, Callable[[Column], Column]] = {
    "detect_phones": detect_phones,
    "detect_emails": detect_emails,
    "detect_bsn": detect_bsn,
    "detect_iban": detect_iban,
    "detect_postal_codes": detect_postal_codes,
}


def register_detector(name: str, detector: Callable[[Column], Column]) -> None:
    DETECTORS[name] = detector


def enabled_patterns(registry: dict[str, dict] | None = None) -> dict[str, dict]:
    """Registry entries that are switched on; a missing flag counts as on."""
    entries = cat.REGISTRY if registry is None else registry
    return {name: entry for name, entry in entries.items() if entry.get("enabled", True)}


def context_snippet(text: Column, match: Column, window: int = 50) -> Column:
    """Lower-cased text around the start of the first occurrence of ``match``."""
    start = F.position(match, text)
    first = F.greatest(F.lit(1), start - window)
    last = F.least(F.length(text), start - 1 + window)
    return F.lower(F.substr(text, first, last - first + 1))


def count_context_words(
    text: Column, match: Column, words: list[str], window: int = 50, whole_word: bool = False
) -> Column:
    """How many of ``words`` stand near the first occurrence of ``match``."""
    if not words:
        return F.lit(0)

    def count_in(s: Column) -> Column:
        total = F.lit(0)
        for word in words:
            if whole_word:
                found = s.rlike(r"(?U)\b" + quote_pattern(word.lower()) + r"\b")
            else:
                found = F.contains(s, F.lit(word.lower()))
            total = total + found.cast("int")
        return total

    return bind(context_snippet(text, match, window), count_in)


def _boosted(text: Column, name: str, entry: dict, window: int, whole_word: bool) -> Callable[[Column], Column]:
    """Third layer: a context word nearby raises the confidence, up to 1.0."""
    words = entry.get("context_words", [])
    boost = float(entry.get("confidence_boost", 0.0))

    def scored(found: Column) -> Column:
        near = count_context_words(text, found["match"], words, window, whole_word)
        raised = F.least(F.lit(1.0), found["confidence"] + F.lit(boost))
        return F.struct(
            F.lit(name).alias("pattern"),
            found["match"].alias("match"),
            F.when(near > 0, raised).otherwise(found["confidence"]).alias("confidence"),
        )

    return scored


def find_pii(
    text: Column, registry: dict[str, dict] | None = None, window: int = 50, whole_word: bool = False
) -> Column:
    """All findings of a text: ``array<struct<pattern, match, confidence>>``.

    Three layers: pattern, checksum (inside the detectors), context words.
    Registry entries naming an unknown detector are skipped.
    """
    per_pattern = []
    for name, entry in enabled_patterns(registry).items():
        detector = DETECTORS.get(entry.get("detector_function", ""))
        if detector is not None:
            per_pattern.append(F.transform(detector(text), _boosted(text, name, entry, window, whole_word)))
    if not per_pattern:
        return F.array().cast("array<struct<pattern:string,match:string,confidence:double>>")
    return F.concat(*per_pattern) if len(per_pattern) > 1 else per_pattern[0]


def with_findings(df: DataFrame, text_col: str = "text", registry: dict[str, dict] | None = None, **options) -> DataFrame:
    return df.withColumn("findings", find_pii(F.col(text_col), registry, **options))


def confident(findings: Column, threshold: float = 0.8) -> Column:
    return F.filter(findings, lambda f: f["confidence"] >= threshold)


def explode_findings(df: DataFrame, *keep: str) -> DataFrame:
    """One row per finding: the kept columns and ``pattern, match, confidence``."""
    return each_struct(df, "findings", *keep)


def summarise(findings: Column, patterns: list[str] | None = None) -> Column:
    """Per-document summary, without a shuffle.

    ``by_type`` holds the patterns that occur, or exactly ``patterns`` if given.
    """
    n = F.size(findings)
    total = F.aggregate(findings, F.lit(0.0), lambda acc, f: acc + f["confidence"])
    if patterns is None:
        names = F.array_distinct(F.transform(findings, lambda f: f["pattern"]))
    else:
        names = F.array(*[F.lit(p) for p in patterns])
    return F.struct(
        n.cast("long").alias("total_matches"),
        F.map_from_arrays(
            names,
            F.transform(names, lambda p: F.size(F.filter(findings, lambda f: f["pattern"] == p)).cast("long")),
        ).alias("by_type"),
        F.when(n == 0, F.lit(0.0)).otherwise(F.round(total / n, 2)).alias("avg_confidence"),
        F.size(F.filter(findings, lambda f: f["confidence"] >= 0.9)).cast("long").alias("high_confidence"),
    )


def auto_detect(
    df: DataFrame, text_col: str = "text", threshold: float = 0.8, registry: dict[str, dict] | None = None
) -> DataFrame:
    """Findings at or above the threshold, and the summary of those."""
    found = df.withColumn("findings", confident(find_pii(F.col(text_col), registry), threshold))
    return found.withColumn("summary", summarise(F.col("findings")))


def pattern_totals(findings: DataFrame) -> DataFrame:
    """Corpus totals per pattern and overall (pattern NULL), from exploded findings.

    ``avg`` and ``count`` combine map-side, so a pattern that holds most of the
    findings costs no more than the others.
    """
    return findings.rollup("pattern").agg(
        F.count("*").alias("total_matches"),
        F.round(F.avg("confidence"), 2).alias("avg_confidence"),
        F.count_if(F.col("confidence") >= 0.9).alias("high_confidence"),
    )


def summary_rollup(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Totals per document and pattern, per document, per pattern and overall, in one aggregate.

    ``level`` says which: ``document_pattern``, ``document``, ``pattern`` or ``all``; what a
    level sums over is NULL.  Partial sums keep a frequent pattern or a long document cheap.
    """
    document, pattern = F.col(id_col), F.col("pattern")
    sets = [[document, pattern], [document], [pattern], []]
    totals = findings.groupingSets(sets, document, pattern).agg(
        F.grouping_id().alias("_summed"),
        F.count("*").alias("total_matches"),
        F.round(F.avg("confidence"), 2).alias("avg_confidence"),
        F.count_if(F.col("confidence") >= 0.9).alias("high_confidence"),
    )
    level = F.element_at(F.array(*[F.lit(x) for x in ("document_pattern", "document", "pattern", "all")]), F.col("_summed").cast("int") + 1)
    return totals.select(level.alias("level"), id_col, "pattern", "total_matches", "avg_confidence", "high_confidence")


def _kind_report(found: Column, max_items: int) -> Column:
    return F.struct(
        F.size(found).cast("long").alias("count"),
        F.slice(found, 1, max_items).alias("preview"),
        (F.size(found) > max_items).alias("has_more"),
    )


def report_from(phones: Column, emails: Column, max_items: int = 10) -> Column:
    """Report struct from already computed phone and e-mail arrays."""
    return F.struct(
        _kind_report(phones, max_items).alias("phone_numbers"),
        _kind_report(emails, max_items).alias("emails"),
        (F.size(phones) + F.size(emails)).cast("long").alias("total_items"),
    )


def with_report(df: DataFrame, text_col: str = "text", max_items: int = 10) -> DataFrame:
    """Adds ``phones``, ``emails`` and the ``report`` of what would be redacted."""
    text = F.col(text_col)
    found = df.withColumns({"phones": find_phones(text), "emails": find_emails(text)})
    return found.withColumn("report", report_from(F.col("phones"), F.col("emails"), max_items))


def with_preview(df: DataFrame, text_col: str = "text", max_chars: int = 500, max_items: int = 10) -> DataFrame:
    """Report plus the first characters of the text; detection still reads all of it."""
    return with_report(df, text_col, max_items).withColumn(
        "preview_text", F.substring(F.col(text_col), 1, max_chars)
    )
