"""User rules on free text: schema, lint, translation and ordered application.

A rule list comes from a user form, so it is small and lives on the driver; the
texts it runs over do not, nor do literal rules that are a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import groupby

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalogue as cat
from ..functions.text import each_struct, quote_pattern, quote_replacement, regex_flags
from .many_terms import apply_terms, packed_rules
from .numbering import quoted

RULE_LOG_TYPE = (
    "array<struct<ruleId:string,originalTermDisplay:string,appliedPattern:string,"
    "replacedWith:string,count:bigint>>"
)
# Up to this many rules become one projection each, with literal patterns that
# are compiled once per task.  Of a longer list, runs of at least as many literal
# rules become one automaton, the rest one fold over an array.
CHAINED_RULES = 40


@dataclass(frozen=True)
class TextRule:
    id: str = ""
    original_term: str = ""
    replacement_term: str = ""
    is_regex: bool = False
    case_sensitive: bool = False
    remove: bool = False

    @classmethod
    def from_dict(cls, d: dict) -> TextRule:
        return cls(
            id=d.get("id", ""),
            original_term=d.get("originalTerm", ""),
            replacement_term=d.get("replacementTerm", ""),
            is_regex=d.get("isRegex", False),
            case_sensitive=d.get("caseSensitive", False),
            remove=d.get("removeInsteadOfReplace", False),
        )

    @property
    def shown_replacement(self) -> str:
        return cat.REMOVED_DISPLAY if self.remove else self.replacement_term

    @property
    def shown_pattern(self) -> str:
        return self.original_term if self.is_regex else re.escape(self.original_term)


def parse_rules(rules: list) -> list[TextRule]:
    return [r if isinstance(r, TextRule) else TextRule.from_dict(r) for r in rules]


def fill_default(rules: list[TextRule], placeholder: str = cat.GENERAL_PLACEHOLDER) -> list[TextRule]:
    """Rules without a replacement get the general placeholder, unless they remove."""
    return [r if r.replacement_term or r.remove else replace(r, replacement_term=placeholder) for r in rules]


def java_pattern(pattern: str) -> str:
    """Named groups and the end anchor in the spelling of Java regular expressions."""
    name = lambda m: "".join(ch if ch.isalnum() else "U" for ch in m.group(1))
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{name(m)}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{name(m)}>", pattern)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)


def java_replacement(template: str) -> str:
    r"""A template with ``\1`` or ``\g<name>`` as a Java replacement string."""
    controls = {"n": "\n", "t": "\t", "r": "\r"}
    out, after_group = [], False
    for m in re.finditer(r"\\g<(?P<name>\w+)>|\\(?P<number>[1-9]\d?)|\\(?P<escaped>.)|(?P<plain>.)", template, re.S):
        group = m["name"] or m["number"]
        if group:
            out.append(f"${group}" if group.isdigit() else "${" + group.replace("_", "U") + "}")
        else:
            ch = controls.get(m["escaped"], m["escaped"]) if m["escaped"] else m["plain"]
            # A digit after a group number would be read as part of that number.
            out.append("\\" + ch if ch in "\\$" or (after_group and ch.isdigit()) else ch)
        after_group = bool(group)
    return "".join(out)


def lint_pattern(pattern: str, max_length: int = cat.MAX_PATTERN_LENGTH) -> str | None:
    """Reason to refuse a pattern, or None."""
    if len(pattern) > max_length:
        return cat.PATTERN_TOO_LONG % max_length
    if any(re.search(shape, pattern) for shape in cat.DANGEROUS_SHAPES):
        return cat.PATTERN_DANGEROUS
    try:
        re.compile(pattern)
    except re.error as e:
        return cat.PATTERN_INVALID % e
    return None


@F.pandas_udf(T.StringType())
def _compile_error(patterns: pd.Series) -> pd.Series:
    def attempt(p):
        try:
            re.compile(p)
        except re.error as e:
            return str(e)
        return None

    return patterns.map(attempt, na_action="ignore")


def lint_patterns(df: DataFrame, pattern_col: str, max_length: int = cat.MAX_PATTERN_LENGTH) -> DataFrame:
    """Adds ``is_valid`` and ``reason`` (``too_long``, ``dangerous``, ``invalid``) to a table of patterns.

    Only patterns that pass the cheap checks are compiled.
    """
    p = F.col(pattern_col)
    dangerous = F.lit(False)
    for shape in cat.DANGEROUS_SHAPES:
        dangerous = dangerous | p.rlike(shape.replace("{", r"\{").replace("}", r"\}"))
    cheap = F.when(F.length(p) > max_length, F.lit("too_long")).when(dangerous, F.lit("dangerous"))
    checked = df.withColumn("reason", cheap).withColumn(
        "_error", _compile_error(F.when(F.col("reason").isNull(), p))
    )
    return (
        checked.withColumn(
            "reason", F.coalesce("reason", F.when(F.col("_error").isNotNull(), F.lit("invalid")))
        )
        .withColumn("is_valid", F.col("reason").isNull())
        .drop("_error")
    )


@dataclass(frozen=True)
class _Step:
    """A rule ready to run, or a log entry for one that cannot (``pattern`` None)."""

    rule: TextRule
    shown_pattern: str
    pattern: str | None = None
    replacement: str = ""


def _refused(spark: SparkSession, patterns: list[str]) -> set[str]:
    """Patterns that the engine cannot compile; any other failure is raised.

    One job for all; only if that one is refused, one for each.
    """
    if not patterns:
        return set()
    try:
        spark.range(1).select(*[F.regexp_count(F.lit(""), F.lit(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).first()
    except PySparkException as e:
        if not (e.getCondition() or "").startswith("INVALID_PARAMETER_VALUE.PATTERN"):
            raise
        if len(patterns) == 1:
            return set(patterns)
        return set().union(*[_refused(spark, [p]) for p in patterns])
    return set()


def plan_rules(spark: SparkSession, rules: list) -> list[_Step]:
    """Runnable steps and skip entries in rule order; empty literal rules vanish.

    Regex rules are linted; one that is too long, dangerous or does not compile
    becomes a skip entry.
    """
    steps, parsed = [], parse_rules(rules)
    reasons = {r.original_term: lint_pattern(r.original_term) for r in parsed if r.is_regex and r.original_term}
    sound = [r for r in parsed if r.is_regex and r.original_term and reasons[r.original_term] is None]
    compiled = {r: regex_flags(not r.case_sensitive) + java_pattern(r.original_term) for r in sound}
    refused = _refused(spark, list(dict.fromkeys(compiled.values())))
    for rule in parsed:
        if not rule.original_term:
            if rule.is_regex:
                steps.append(_Step(rule, cat.EMPTY_REGEX_SKIPPED))
            continue
        flags = regex_flags(not rule.case_sensitive)
        if not rule.is_regex:
            pattern = flags + quote_pattern(rule.original_term)
            replacement = quote_replacement(rule.replacement_term)
        else:
            pattern = flags + java_pattern(rule.original_term)
            replacement = java_replacement(rule.replacement_term)
            reason = reasons[rule.original_term]
            if reason in (cat.PATTERN_DANGEROUS, cat.PATTERN_TOO_LONG % cat.MAX_PATTERN_LENGTH):
                steps.append(_Step(rule, reason))
                continue
            if reason or pattern in refused:
                steps.append(_Step(rule, cat.BROKEN_REGEX % rule.original_term))
                continue
        steps.append(_Step(rule, rule.shown_pattern, pattern, "" if rule.remove else replacement))
    return steps


def _log_entry(step: _Step, count: Column) -> Column:
    return F.struct(
        F.lit(step.rule.id).alias("ruleId"),
        F.lit(step.rule.original_term).alias("originalTermDisplay"),
        F.lit(step.shown_pattern).alias("appliedPattern"),
        F.lit(step.rule.shown_replacement).alias("replacedWith"),
        count.cast("long").alias("count"),
    )


def _entries(steps: list[_Step], counts: list[Column]) -> Column:
    """Log of some rules in order: those that matched, and those that were skipped."""
    count = iter(counts)
    entries = []
    for step in steps:
        n = F.lit(0) if step.pattern is None else next(count)
        entries.append(_log_entry(step, n) if step.pattern is None else F.when(n > 0, _log_entry(step, n)))
    return F.array_compact(F.array(*entries))


def _chain(df: DataFrame, steps: list[_Step], output_col: str, name: str) -> tuple[DataFrame, Column]:
    """One projection per rule."""
    counts = []
    for i, step in enumerate(s for s in steps if s.pattern is not None):
        counts.append(f"{name}_{i}")
        df = df.withColumn(counts[-1], F.regexp_count(output_col, F.lit(step.pattern)))
        # The text before is used once, so a filter on the outcome that the optimizer
        # pushes down grows with the number of rules, not with its power.
        df = df.withColumn(output_col, F.regexp_replace(output_col, step.pattern, step.replacement))
    return df, _entries(steps, [F.col(c) for c in counts])


def _fold(df: DataFrame, steps: list[_Step], output_col: str, name: str) -> tuple[DataFrame, Column]:
    """One aggregate over an array of patterns."""
    active = [s for s in steps if s.pattern is not None]
    program = F.array(*[F.struct(F.lit(s.pattern).alias("pattern"), F.lit(s.replacement).alias("replacement")) for s in active])
    folded = F.aggregate(
        program,
        F.struct(F.col(output_col).alias("text"), F.array().cast("array<int>").alias("counts")),
        lambda acc, step: F.struct(
            F.regexp_replace(acc["text"], step["pattern"], step["replacement"]).alias("text"),
            F.concat(acc["counts"], F.array(F.regexp_count(acc["text"], step["pattern"]))).alias("counts"),
        ),
    )
    df = df.withColumn(name, folded).withColumn(output_col, F.col(name)["text"])
    return df, _entries(steps, [F.col(name)["counts"][i] for i in range(len(active))])


def _scan(df: DataFrame, steps: list[_Step], output_col: str, name: str) -> tuple[DataFrame, Column]:
    """One automaton over all terms; a skipped rule has no term."""
    rules = [
        (s.rule.id, s.rule.original_term, s.shown_pattern, s.rule.shown_replacement, s.rule.original_term if s.pattern is not None else "",
         "" if s.rule.remove else s.rule.replacement_term, s.rule.case_sensitive) for s in steps
    ]
    df = apply_terms(df, rules, F.col(output_col), name)
    return df.withColumn(output_col, F.col(name)["text"]), F.col(name)["log"]


def _segments(steps: list[_Step], chained: int, many: int) -> list[tuple[Callable, list[_Step]]]:
    """Rules in order, cut into the parts that run in one way; a skipped rule goes with the one before."""
    if sum(s.pattern is not None for s in steps) <= chained:
        return [(_chain, steps)] if steps else []
    literal, kinds = True, []
    for step in steps:
        literal = literal if step.pattern is None else not step.rule.is_regex
        kinds.append(literal)
    runs: list[tuple[Callable, list[_Step]]] = []
    for literal, group in groupby(zip(kinds, steps), key=lambda pair: pair[0]):
        part = [step for _, step in group]
        way = _scan if literal and len(part) >= many else _fold
        if runs and way is runs[-1][0] is _fold:
            runs[-1][1].extend(part)
        else:
            runs.append((way, part))
    return runs


def _table_scan(df: DataFrame, rules: DataFrame, order_by: list[str], text_col: str, output_col: str) -> DataFrame:
    """Literal rules of a table, as one list; they stay off the driver."""
    if not order_by:
        raise ValueError("a table of rules needs order_by: columns of it that give the order of the rules")
    given = dict(zip(rules.columns, quoted(*rules.columns), strict=True))
    text = lambda name: F.coalesce(given.get(name, F.lit("")), F.lit(""))
    flag = lambda name: F.coalesce(given.get(name, F.lit(False)), F.lit(False))
    if not rules.where(flag("isRegex")).isEmpty():
        raise ValueError("a table of rules holds literal rules only; give regex rules as a list")
    remove, new = flag("removeInsteadOfReplace"), text("replacementTerm")
    literal = rules.select(
        F.struct(*quoted(*order_by)).alias("place"), given.get("id", F.lit("")).alias("id"), text("originalTerm").alias("term"),
        F.when(remove, cat.REMOVED_DISPLAY).otherwise(new).alias("shown"), F.when(remove, "").otherwise(new).alias("new"),
        flag("caseSensitive").alias("cased"),
    ).where("term <> ''")
    out = apply_terms(df, packed_rules(literal), F.col(text_col), "_rules")
    return out.withColumn(output_col, F.col("_rules")["text"]).withColumn("rule_log", F.col("_rules")["log"].cast(RULE_LOG_TYPE)).drop("_rules")


def apply_rules(
    df: DataFrame, rules: list | DataFrame, text_col: str = "text", output_col: str = "redacted", chained: int = CHAINED_RULES,
    many: int = CHAINED_RULES, order_by: list[str] | None = None,
) -> DataFrame:
    """Rules in order, each on the output of the one before; narrow.

    Adds ``output_col`` and ``rule_log``: an entry per rule that matched, with
    its count on the text it saw, and one with count 0 per rule that was skipped.
    Of a list of more than ``chained`` rules, ``many`` literal rules in a row cost one
    pass over the text, see ``many_terms``.

    ``rules`` may be a table of literal rules with columns like the fields of a rule (``id``,
    ``originalTerm`` …; missing ones have their default) and ``order_by``, the columns that order
    them.  It may be larger than the driver's memory.
    """
    if isinstance(rules, DataFrame):
        return _table_scan(df, rules, order_by or [], text_col, output_col)
    steps = plan_rules(df.sparkSession, rules)
    out, logs = df.withColumn(output_col, F.col(text_col)), []
    for i, (way, segment) in enumerate(_segments(steps, chained, many)):
        out, log = way(out, segment, output_col, f"_rules_{i}")
        logs.append(log)
    scratch = [c for c in out.columns if c.startswith("_rules_") and c not in df.columns]
    log = F.concat(*logs) if logs else F.array()
    return out.withColumn("rule_log", log.cast(RULE_LOG_TYPE)).drop(*scratch)


def explode_log(df: DataFrame, *keep: str, log_col: str = "rule_log") -> DataFrame:
    """One row per log entry."""
    return each_struct(df, log_col, *keep)
