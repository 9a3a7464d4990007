"""Rule tables and detection registries from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..operators.columns import ColumnRule
from ..operators.rules import TextRule

TEXT_RULE_JSON = (
    "id string, originalTerm string, replacementTerm string, isRegex boolean, "
    "caseSensitive boolean, removeInsteadOfReplace boolean"
)
COLUMN_RULE_JSON = (
    "id string, columnName string, columnType string, columnSubtype string, anonymizationType string, "
    "replaceWith string, dateOffsetDays int, numberMultiplier double, preserveUniqueness boolean, "
    "reversible boolean, priceStrategy string, randomRangePercent double"
)
# What a missing field of a rule means.
TEXT_RULE_DEFAULTS = {
    "id": "", "originalTerm": "", "replacementTerm": "", "isRegex": False,
    "caseSensitive": False, "removeInsteadOfReplace": False,
}
COLUMN_RULE_DEFAULTS = {
    "id": "", "columnName": "", "columnType": "text", "anonymizationType": "replace",
    "replaceWith": "[ANONIEM]", "dateOffsetDays": 0, "numberMultiplier": 1.0,
    "preserveUniqueness": False, "reversible": False, "priceStrategy": "fixed_multiplier",
    "randomRangePercent": 10.0,
}
REGISTRY_JSON = (
    "version string, patterns map<string,struct<enabled:boolean,description:string,"
    "context_words:array<string>,confidence_boost:double,detector_function:string>>"
)
# What the driver holds of rules and of a registry.
MOST_RULES, MOST_PATTERNS = 100_000, 10_000


def _rules(df: DataFrame, json_col: str, order_col: str | None, schema: str, defaults: dict) -> DataFrame:
    keep = [F.col(order_col).alias("rule_order")] if order_col else []
    parsed = df.select(*keep, F.from_json(F.col(json_col), schema).alias("rule")).select(*[k for k in (["rule_order"] if keep else [])], "rule.*")
    return parsed.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def text_rules(df: DataFrame, json_col: str = "value", order_col: str | None = None) -> DataFrame:
    """Rule table from one JSON object per row, defaults filled in."""
    return _rules(df, json_col, order_col, TEXT_RULE_JSON, TEXT_RULE_DEFAULTS)


def column_rules(df: DataFrame, json_col: str = "value", order_col: str | None = None) -> DataFrame:
    return _rules(df, json_col, order_col, COLUMN_RULE_JSON, COLUMN_RULE_DEFAULTS)


def _bounded(table: DataFrame, most: int, what: str) -> list:
    """Rows of a table that the driver may hold; more than ``most`` are refused, not cut off."""
    rows = table.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def as_text_rules(rules: DataFrame) -> list[TextRule]:
    """Rules in order, for ``apply_rules``.  A rule list is a form filled in by a person."""
    return [TextRule.from_dict(r.asDict()) for r in _bounded(rules.orderBy("rule_order"), MOST_RULES, "rules")]


def as_column_rules(rules: DataFrame) -> list[ColumnRule]:
    return [ColumnRule.from_dict(r.asDict()) for r in _bounded(rules.orderBy("rule_order"), MOST_RULES, "rules")]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``(pattern, enabled, description, context_words, confidence_boost, detector_function)``."""
    config = spark.read.schema(REGISTRY_JSON).json(path, multiLine=True)
    return _flatten(config.select(F.explode("patterns").alias("pattern", "entry")))


def registry_table(spark: SparkSession, registry: dict[str, dict] | None = None) -> DataFrame:
    """A registry held by the driver as a table: one row per pattern."""
    entries = cat.REGISTRY if registry is None else registry
    rows = [
        (
            name, e.get("enabled", True), e.get("description"), e.get("context_words", []),
            float(e.get("confidence_boost", 0.0)), e.get("detector_function"),
        )
        for name, e in entries.items()
    ]
    return spark.createDataFrame(
        rows,
        "pattern string, enabled boolean, description string, context_words array<string>, "
        "confidence_boost double, detector_function string",
    )


def _flatten(entries: DataFrame) -> DataFrame:
    return entries.select(
        "pattern",
        F.coalesce("entry.enabled", F.lit(True)).alias("enabled"),
        "entry.description",
        F.coalesce("entry.context_words", F.array().cast("array<string>")).alias("context_words"),
        F.coalesce("entry.confidence_boost", F.lit(0.0)).alias("confidence_boost"),
        "entry.detector_function",
    )


def as_registry(table: DataFrame) -> dict[str, dict]:
    """Registry dictionary for the detectors; one row per pattern, so a handful."""
    return {r["pattern"]: r.asDict() for r in _bounded(table, MOST_PATTERNS, "patterns")}


def annotate_findings(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings with the description of their pattern.

    The registry has one row per configured pattern; it is broadcast after a check of its size.
    """
    enabled = registry.where("enabled").select("pattern", "description")
    _bounded(enabled.select("pattern"), MOST_PATTERNS, "patterns")
    return findings.join(F.broadcast(enabled), "pattern")
