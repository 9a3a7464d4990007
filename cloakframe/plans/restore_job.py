"""Restore jobs: mapping in whatever form, texts and tables back, audit rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.mapping import decrypt_mapping
from ..operators.restore import restore_corpus, restore_documents
from ..sinks.writers import audit_events


def open_mapping(mapping: DataFrame, key=None) -> DataFrame:
    """A mapping table whose originals are plain strings, decrypted if they are binary."""
    if dict(mapping.dtypes)["original"] != "binary":
        return mapping
    if key is None:
        raise ValueError("an encrypted mapping needs its key")
    return decrypt_mapping(mapping, key)


def restore_texts(
    df: DataFrame, mapping: DataFrame, id_col: str, text_col: str = "redacted", key=None, scope: str = "document", scope_col: str | None = None
) -> DataFrame:
    """Adds ``restored``.

    ``scope`` says whether the mapping is per document or for the whole corpus;
    with ``scope_col`` the corpus has one mapping per value of that column.
    """
    plain = open_mapping(mapping, key)
    if scope == "document":
        return restore_documents(df, plain, id_col, text_col)
    return restore_corpus(df, plain, id_col, text_col, scope_col=scope_col)


def restore_audit(df: DataFrame, session_id: Column, ts: Column, name_col: str, type_col: str, n_mappings: Column, encrypted: bool) -> DataFrame:
    """START, MAPPING_LOADED and COMPLETE rows for every restored file."""
    name = F.col(name_col)
    return (
        audit_events(df, "REVERSE_START", session_id, ts, file=name, type=F.col(type_col))
        .unionByName(audit_events(df, "MAPPING_LOADED", session_id, ts, mappings=n_mappings, encrypted=F.lit(str(encrypted).lower())))
        .unionByName(
            audit_events(df, "REVERSE_COMPLETE", session_id, ts, file=F.concat(F.lit("deanon_"), name), mappings_applied=n_mappings)
        )
    )
