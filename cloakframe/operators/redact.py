"""Redaction of free text: fixed placeholders, or numbered ones that can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..functions.text import bind, each_struct, engine_pattern, quote_replacement
from . import detect
from .numbering import dealt, lookup_bytes, lookup_join, number_rows, stash

# Kinds that can be redacted, in order.  Phones and e-mails are the default; the
# others are reported only, unless asked for.
KIND_PATTERNS = {
    "phone": cat.PHONE_PATTERNS,
    "email": cat.EMAIL_PATTERNS,
    "bsn": cat.BSN_PATTERNS,
    "iban": cat.IBAN_PATTERNS,
    "postal": cat.POSTAL_PATTERNS,
}
KIND_LABELS = {"phone": "TEL", "email": "EMAIL", "bsn": "BSN", "iban": "IBAN", "postal": "POSTCODE"}
FINDERS = {
    "phone": detect.find_phones,
    "email": detect.find_emails,
    "bsn": detect.find_bsns,
    "iban": detect.find_ibans,
    "postal": detect.find_postal_codes,
}
DEFAULT_KINDS = ("phone", "email")


def _replace_where_possible(text: Column, replaced: Column, regex: str, literal: str | None, placeholder: str) -> Column:
    """One pattern on the outcome so far, skipped where the original lacks its literal.

    A placeholder that shares a sign with the literal, or is empty, could form
    the literal anew; then the pattern always runs.
    """
    run = lambda t: F.regexp_replace(t, engine_pattern(regex), quote_replacement(placeholder))
    if literal is None or not placeholder or set(literal) & set(placeholder):
        return run(replaced)
    return bind(replaced, lambda t: F.when(F.contains(text, F.lit(literal)), run(t)).otherwise(t))


def replace_phones(text: Column, placeholder: str = cat.PHONE_PLACEHOLDER, present: Column | None = None) -> Column:
    """All phone patterns in order, each on the output of the one before.

    ``present`` may be any condition that holds whenever the text has a phone.
    """
    replaced = text
    for name, regex in cat.PHONE_PATTERNS:
        replaced = _replace_where_possible(text, replaced, regex, detect.PHONE_LITERALS.get(name), placeholder)
    return F.when(detect.has_phone_shape(text) if present is None else present, replaced).otherwise(text)


def replace_emails(text: Column, placeholder: str = cat.EMAIL_PLACEHOLDER) -> Column:
    replaced = text
    for _, regex in cat.EMAIL_PATTERNS:
        replaced = F.regexp_replace(replaced, engine_pattern(regex), quote_replacement(placeholder))
    return F.when(detect.has_email_shape(text), replaced).otherwise(text)


def redact_fixed(
    df: DataFrame,
    text_col: str = "text",
    phone_placeholder: str = cat.PHONE_PLACEHOLDER,
    email_placeholder: str = cat.EMAIL_PLACEHOLDER,
    output_col: str = "redacted",
    phones_present: Column | None = None,
) -> DataFrame:
    """Phones, then e-mails.  Two steps, so neither long expression is evaluated twice."""
    return df.withColumn(output_col, replace_phones(F.col(text_col), phone_placeholder, phones_present)).withColumn(
        output_col, replace_emails(F.col(output_col), email_placeholder)
    )


def redact_fixed_with_counts(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """As ``redact_fixed``; counts are the distinct matches in the original text."""
    text = F.col(text_col)
    counted = df.withColumns(
        {
            "phone_count": F.size(detect.find_phones(text)).cast("long"),
            "email_count": F.size(detect.find_emails(text)).cast("long"),
        }
    )
    return redact_fixed(counted, text_col, phones_present=F.col("phone_count") > 0, **options)


def _numbered(values: Column, kind: str, kind_order: int) -> Column:
    label = KIND_LABELS[kind]
    return F.transform(
        values,
        lambda value, i: F.struct(
            (-F.length(value)).alias("shorter"),
            F.lit(kind_order).alias("kind_order"),
            i.alias("ordinal"),
            F.lit(kind).alias("kind"),
            value.alias("original"),
            F.format_string(f"[{label}-%03d]", i + 1).alias("placeholder"),
        ),
    )


def _distinct_values(text: Column, kind: str) -> Column:
    found = FINDERS[kind](text)
    return found if kind in DEFAULT_KINDS else F.sort_array(F.array_distinct(found))


def substitute(text: Column, items: Column) -> Column:
    """Literal replacement of every item, longest original first.

    ``items`` is an array of structs that sorts in replacement order and has the
    fields ``original`` and ``placeholder``.
    """
    return F.aggregate(
        F.sort_array(items), text, lambda acc, item: F.replace(acc, item["original"], item["placeholder"])
    )


def redact_reversible(
    df: DataFrame,
    text_col: str = "text",
    output_col: str = "redacted",
    kinds: tuple[str, ...] = DEFAULT_KINDS,
    found: dict[str, Column] | None = None,
) -> DataFrame:
    """Numbered placeholders that restart in every document.

    Adds ``output_col`` and ``mapping``, an array of ``(kind, placeholder,
    original)``.  All of it happens inside the row: no shuffle.  ``found`` gives
    the distinct sorted values of a kind, where they are known already.
    """
    text, known = F.col(text_col), found or {}
    values = [known[k] if k in known else _distinct_values(text, k) for k in kinds]
    items = [_numbered(v, kind, i) for i, (kind, v) in enumerate(zip(kinds, values, strict=True))]
    out = df.withColumn("_items", F.concat(*items) if len(items) > 1 else items[0])
    return out.withColumns(
        {
            output_col: substitute(text, F.col("_items")),
            "mapping": F.transform(
                "_items", lambda x: F.struct(x["kind"].alias("kind"), x["placeholder"], x["original"])
            ),
        }
    ).drop("_items")


def mapping_rows(df: DataFrame, scope_col: str) -> DataFrame:
    """Long mapping table ``(scope_id, kind, placeholder, original)``."""
    return each_struct(df, "mapping", F.col(scope_col).cast("string").alias("scope_id"))


def _labelled(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("original")))


def corpus_values(df: DataFrame, id_col: str, text_col: str = "text", kinds: tuple[str, ...] = DEFAULT_KINDS) -> DataFrame:
    """``(id, kind, original)``: the distinct values of each document."""
    text = F.col(text_col)
    arrays = [_labelled(_distinct_values(text, kind), kind) for kind in kinds]
    return each_struct(df, F.concat(*arrays) if len(arrays) > 1 else arrays[0], id_col)


def corpus_mapping(values: DataFrame, label_by_kind: dict[str, str] | None = None) -> DataFrame:
    """One placeholder per distinct value of the whole corpus, numbered per kind in value order.

    Numbering is distributed (see ``number_rows``).  ``n_documents`` rides along
    so that the join back can treat frequent values apart.
    """
    labels = label_by_kind or KIND_LABELS
    distinct = values.groupBy("kind", "original").agg(F.count("*").alias("n_documents"))
    numbered = number_rows(distinct, ["kind", "original"], name="n", restart_by="kind")
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col("kind")]
    return numbered.withColumn(
        "placeholder", F.concat(F.lit("["), label, F.lit("-"), F.format_string("%03d", "n"), F.lit("]"))
    )


def redact_corpus(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    output_col: str = "redacted",
    kinds: tuple[str, ...] = DEFAULT_KINDS,
) -> tuple[DataFrame, DataFrame]:
    """Corpus-wide numbering: a value has the same placeholder in every document.

    Returns the redacted documents and the mapping table.  Documents that cannot
    hold a value pass straight through; the others are shuffled once, for the
    join with their own small list of items.  Ids may be NULL or repeated: a
    document is known by its id and text together.
    """
    suspect = F.coalesce(detect.has_shape(F.col(text_col), kinds), F.lit(False))
    suspects = df.where(suspect).withColumn("_document", F.xxhash64(id_col, text_col))
    size = lookup_bytes(suspects, [text_col])
    found = corpus_values(suspects, "_document", text_col, kinds)
    values = stash(dealt(found, size, "_document").distinct())  # the patterns run once
    mapping = corpus_mapping(values)
    pairs = lookup_join(
        values, mapping.select("kind", "original", "placeholder", "n_documents"),
        ["kind", "original"], ["placeholder"], row_id="_document",
    )
    items = dealt(pairs, size, "_document").groupBy("_document").agg(
        # A document's own values: bounded by the document, which is one row anyway.
        F.collect_list(
            F.struct((-F.length("original")).alias("shorter"), "kind", "original", "placeholder")
        ).alias("_items")
    )
    replaced = F.when(F.col("_items").isNull(), F.col(text_col)).otherwise(substitute(F.col(text_col), F.col("_items")))
    touched = dealt(suspects, size, "_document").join(items, "_document", "left").withColumn(output_col, replaced).select(*df.columns, output_col)
    redacted = touched.unionByName(df.where(~suspect).withColumn(output_col, F.col(text_col)))
    return redacted, mapping.select(
        F.lit("corpus").alias("scope_id"), "kind", "placeholder", "original"
    )
