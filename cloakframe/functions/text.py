"""Small text helpers shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A placeholder as the engine writes it: [TEL-001], [EMAIL-012], [NAME-003], [ITEM_7].
PLACEHOLDER_TOKEN = r"\[[^\[\]]+[-_]\d+\]"


def each_value(df: DataFrame, array: Column | str, name: str, *keep) -> DataFrame:
    """One row per array element.

    The outer generator and a filter after it, on purpose: for the inner one the
    optimizer infers a filter on the size of the array and pushes it down, and
    then an array of regular expression matches is computed twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def each_struct(df: DataFrame, array: Column | str, *keep) -> DataFrame:
    """One row per struct of an array, its fields as columns; see ``each_value``."""
    kept = df.select(*keep).columns
    return each_value(df, array, "_each", *keep).select(*kept, "_each.*")


def regex_flags(ignore_case: bool) -> str:
    """Unicode classes always, so that white space and digits are not ASCII-only."""
    return "(?iU)" if ignore_case else "(?U)"


def engine_pattern(regex: str, ignore_case: bool = False) -> str:
    """A catalogue pattern with its flags.

    Same matches, cheaper misses: a pattern that opens with a word boundary gets a
    look-ahead on what follows it, so that most positions fail on one character
    instead of on two Unicode class tests; and the name before an ``@``, which
    cannot hold one, is not given back character by character.
    """
    first = re.match(r"\\b(\\d|[0-9A-Z])", regex)
    firm = regex.replace("]+@", "]++@").replace("]*@", "]*+@")
    return regex_flags(ignore_case) + (f"(?={first[1]})" if first else "") + firm


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quote_pattern(literal: str) -> str:
    """Escape a literal for a Java regular expression."""
    return "".join(ch if ch.isalnum() or ch.isspace() or ord(ch) > 127 or ch == "_" else "\\" + ch for ch in literal)


def quote_replacement(literal: str) -> str:
    """Escape a literal for a Java replacement string."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def rewrite_tokens(text: Column, token_pattern: str, rewrite) -> Column:
    """Replace every token in one pass; ``rewrite`` maps a token Column to its new text."""
    tokens = F.regexp_extract_all(text, F.lit(token_pattern), F.lit(0))
    gaps = F.split(text, token_pattern, -1)
    pieces = F.zip_with(gaps, tokens, lambda gap, token: F.concat(gap, F.coalesce(rewrite(token), F.lit(""))))
    return F.array_join(pieces, "")


def split_paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def join_paragraphs(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n")


def human_size(size: Column) -> Column:
    """Byte count as ``1.5 KB``: two decimals at most, no trailing zeros."""
    k = 1024.0

    def show(divisor: float, unit: str) -> Column:
        value = F.round(size / F.lit(divisor), 2).cast("string")
        return F.concat(F.regexp_replace(value, r"\.0+$", ""), F.lit(" " + unit))

    return (
        F.when(size == 0, F.lit("0 Bytes"))
        .when(size < k, show(1.0, "Bytes"))
        .when(size < k**2, show(k, "KB"))
        .when(size < k**3, show(k**2, "MB"))
        .otherwise(show(k**3, "GB"))
    )
