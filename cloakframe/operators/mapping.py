"""The mapping between originals and placeholders, as a table.

Columns: ``scope_id`` (document id, session id or ``corpus``), ``kind``,
``placeholder``, ``original``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import as_column
from ..functions.text import bind
from .numbering import BROADCAST_BYTES, lookup_bytes, lookup_join, number_rows, stash

MAPPING_JSON = "mappings map<string,string>, total_items bigint, version string"
MAPPING_VERSION = "1.0"


def add_mappings(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two mapping tables where a later entry for a placeholder wins."""
    both = mapping.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    rest = [c for c in mapping.columns if c not in ("scope_id", "placeholder")]
    return (
        both.groupBy("scope_id", "placeholder")
        .agg(F.max_by(F.struct(*rest), "_turn").alias("_last"))
        .select("scope_id", "placeholder", "_last.*")
        .select(*mapping.columns)
    )


def latest_entries(mapping: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One original per placeholder of a mapping that was written more than once.

    The last write wins where the table says which one that is (``batch``);
    otherwise the smallest original, so that every run gives the same answer.
    ``placeholder_conflicts`` names placeholders with more than one.
    """
    keys = keys or ["scope_id", "placeholder"]
    if "batch" in mapping.columns:
        last = F.max(F.struct("batch", "original"))["original"]
    else:
        last = F.min("original")
    return mapping.groupBy(*keys).agg(last.alias("original"))


def originals_by_scope(mapping: DataFrame) -> DataFrame:
    """``(scope_id, _originals)``: a map of each scope's placeholders, of several entries the one of ``latest_entries``.

    One exchange: entries that were written twice are reduced inside their scope.
    """
    # In this order the entry that counts is the last of its placeholder.
    turn = [F.col("batch")] if "batch" in mapping.columns else []
    held = F.struct("placeholder", *turn, "original") if turn else F.struct("placeholder", "original")
    ordered = F.sort_array(F.collect_list(held), asc=bool(turn))
    other = lambda rows, i: F.get(rows, i + 1)["placeholder"]
    last = bind(ordered, lambda rows: F.filter(rows, lambda x, i: other(rows, i).isNull() | (other(rows, i) != x["placeholder"])))
    pairs = F.transform(last, lambda x: F.struct(x["placeholder"], x["original"]))
    return mapping.groupBy("scope_id").agg(F.map_from_entries(pairs).alias("_originals"))


def placeholder_conflicts(mapping: DataFrame) -> DataFrame:
    """Placeholders that stand for more than one original."""
    return (
        mapping.groupBy("scope_id", "placeholder")
        .agg(F.count_distinct("original").alias("n_originals"))
        .where("n_originals > 1")
    )


def suffix_number(placeholder: Column) -> Column:
    """Numeric suffix after the underscore of ``[ITEM_7]``; NULL when there is none."""
    return F.regexp_extract(placeholder, r"^[^_]*_(\d+)\]*(?:_|$)", 1).try_cast("bigint")


def last_number(mapping: DataFrame) -> int:
    """Highest number handed out so far, 0 for an empty mapping."""
    return mapping.agg(F.coalesce(F.max(suffix_number(F.col("placeholder"))), F.lit(0)).alias("n")).first()["n"]


def allocate(values: DataFrame, mapping: DataFrame, prefix: str = "ITEM", scope: str = "corpus") -> DataFrame:
    """Mapping rows for the values that ``mapping`` does not know yet.

    ``values`` has ``original`` and ``seen`` (its order of appearance).  Values
    are reduced to one row each before the anti-join, so a frequent value costs
    one row.  A batch of checked small size goes to the mapping, so that a large
    mapping is scanned and not shuffled.  Numbers go on after the highest in use.
    """
    first_seen = values.where(F.col("original").isNotNull()).groupBy("original").agg(F.min("seen").alias("seen"))
    first_seen = stash(first_seen)
    known = mapping.select("original")
    if lookup_bytes(first_seen, ["original"]) <= BROADCAST_BYTES:
        known = known.join(F.broadcast(first_seen.select("original")), "original", "left_semi")
    unknown = first_seen.join(known, "original", "left_anti")
    numbered = number_rows(unknown, ["seen", "original"], start=last_number(mapping) + 1)
    return numbered.select(
        F.lit(scope).alias("scope_id"),
        F.lit("item").alias("kind"),
        F.concat(F.lit(f"[{prefix}_"), F.col("n").cast("string"), F.lit("]")).alias("placeholder"),
        "original",
    )


def lookup_placeholders(rows: DataFrame, value_col: str, mapping: DataFrame, row_id: str | None = None) -> DataFrame:
    """Left join of a value column with its placeholder, safe for frequent values."""
    renamed = mapping.select(F.col("original").alias(value_col), "placeholder")
    return lookup_join(rows, renamed, [value_col], ["placeholder"], row_id=row_id)


def mapping_json(entries: Column) -> Column:
    """Interchange JSON of one row's own mapping array."""
    return F.to_json(
        F.struct(
            F.map_from_entries(F.array_distinct(F.transform(entries, lambda e: F.struct(e["placeholder"], e["original"])))).alias("mappings"),
            F.size(entries).cast("long").alias("total_items"),
            F.lit(MAPPING_VERSION).alias("version"),
        )
    )


def export_json(mapping: DataFrame, entries_per_object: int = 100_000) -> DataFrame:
    """``(scope_id, part, json)``: interchange JSON, one object per scope.

    A scope with more entries than fit one object becomes several objects, each
    complete in itself; loading them all gives the whole mapping back.
    """
    mapping = latest_entries(mapping)
    sizes = mapping.groupBy("scope_id").agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(entries_per_object))
    keyed = lookup_join(mapping, sizes, ["scope_id"], ["_n"], weight="_n", row_id="placeholder").withColumn(
        "part", F.pmod(F.xxhash64("placeholder"), parts)
    )
    return keyed.groupBy("scope_id", "part").agg(
        F.to_json(
            F.struct(
                F.map_from_entries(F.sort_array(F.collect_list(F.struct("placeholder", "original")))).alias("mappings"),
                F.count("*").alias("total_items"),
                F.lit(MAPPING_VERSION).alias("version"),
            )
        ).alias("json")
    )


def load_json(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """Mapping rows ``(…keep, placeholder, original)`` out of interchange JSON."""
    parsed = F.from_json(F.col(json_col), MAPPING_JSON)["mappings"]
    return df.select(*keep, F.explode(parsed).alias("placeholder", "original"))


def is_encrypted(value: Column) -> Column:
    """True unless the stored mapping parses as interchange JSON."""
    return F.from_json(value, MAPPING_JSON)["mappings"].isNull()


def encrypt_mapping(mapping: DataFrame, key, column: str = "original") -> DataFrame:
    """AES-GCM at rest.  ``key`` may be a Column, e.g. a scalar subquery on a guarded table."""
    return mapping.withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), as_column(key), F.lit("GCM")))


def decrypt_mapping(mapping: DataFrame, key, column: str = "original") -> DataFrame:
    """Undo ``encrypt_mapping``; a wrong key or a damaged value is an error, not a NULL."""
    plain = F.try_aes_decrypt(F.col(column), as_column(key), F.lit("GCM"))
    refused = F.raise_error(F.lit("mapping cannot be decrypted: wrong key or damaged value"))
    # Two steps, so that a value that is named twice is decrypted once.
    opened = mapping.withColumn("_plain", plain)
    return opened.withColumn(
        column, F.when(F.col(column).isNotNull() & F.col("_plain").isNull(), refused).otherwise(F.col("_plain").cast("string"))
    ).drop("_plain")
