"""Masking of table columns by an ordered list of rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from secrets import token_hex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalogue as cat
from ..functions.text import each_struct
from ..functions.keyed import ALPHABET, jabber, keyed_digest, uniform
from ..functions.permute import permute_text, restore_text
from .numbering import hash_rank, lookup_join, number_distinct, quoted, stash
from .wide import found_name, lookup_columns, number_columns

# What a transformation needs of its column.
REQUIRED_TYPE = {
    "number_multiply": "number",
    "price_round": "number",
    "price_strategy": "number",
    "date_offset": "date",
}
# Transformations of each declared column type; shuffle works on any.
TRANSFORMATIONS = {"text": {"replace", "jabber", "pseudonym"}, "date": {"date_offset"}, "number": {"number_multiply"}}
PER_PRICE_RANGE = (0.15, 0.65)
PREFIX_LENGTH = 15


@dataclass(frozen=True)
class ColumnRule:
    id: str = ""
    column_name: str = ""
    column_type: str = "text"
    column_subtype: str | None = None
    anonymization_type: str = "replace"
    replace_with: str = cat.GENERAL_PLACEHOLDER
    date_offset_days: int = 0
    number_multiplier: float = 1.0
    preserve_uniqueness: bool = False
    reversible: bool = False
    price_strategy: str = "fixed_multiplier"
    random_range_percent: float = 10

    @classmethod
    def from_dict(cls, d: dict) -> ColumnRule:
        return cls(
            id=d.get("id", ""),
            column_name=d.get("columnName", ""),
            column_type=d.get("columnType", "text"),
            column_subtype=d.get("columnSubtype"),
            anonymization_type=d.get("anonymizationType", "replace"),
            replace_with=d.get("replaceWith", cat.GENERAL_PLACEHOLDER),
            date_offset_days=d.get("dateOffsetDays", 0),
            number_multiplier=d.get("numberMultiplier", 1.0),
            preserve_uniqueness=d.get("preserveUniqueness", False),
            reversible=d.get("reversible", False),
            price_strategy=d.get("priceStrategy", "fixed_multiplier"),
            random_range_percent=d.get("randomRangePercent", 10),
        )

    @property
    def prefix(self) -> str:
        return (self.column_subtype or self.column_name).upper().replace(" ", "_")[:PREFIX_LENGTH]


def parse_column_rules(rules: list) -> list[ColumnRule]:
    return [r if isinstance(r, ColumnRule) else ColumnRule.from_dict(r) for r in rules]


# --- single-column expressions ----------------------------------------------


def replace_constant(c: Column, value: str = cat.GENERAL_PLACEHOLDER) -> Column:
    return F.when(c.isNotNull(), F.lit(value))


def jabber_fresh(c: Column, length: int = 8, seed: int | None = None) -> Column:
    """A new random string per cell."""
    random = F.randstr(F.lit(length)) if seed is None else F.randstr(F.lit(length), F.lit(seed))
    return F.when(c.isNotNull(), random)


def jabber_keyed(c: Column, salt, scope: str, length: int = 8) -> Column:
    """The same value always gives the same random string."""
    return jabber(keyed_digest(c, salt, scope), length)


def shift_days(c: Column, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(days), c)


def multiply_fixed(c: Column, factor: float) -> Column:
    return F.round(c * F.lit(float(factor)), 2)


def multiply_decimal(c: Column, factor: Column, data_type: T.DecimalType) -> Column:
    """A decimal times a factor of six decimals, rounded to cents, in decimal arithmetic throughout."""
    return F.round(c * factor.cast("decimal(12,6)"), 2).cast(data_type)


def multiply_random(c: Column, salt, scope: str, low: float, high: float) -> Column:
    """One factor in [low, high) per distinct value."""
    draw = uniform(keyed_digest(c, salt, scope))
    return F.round(c * (F.lit(low) + draw * F.lit(high - low)), 2)


def multiply_per_value(c: Column, salt, scope: str) -> Column:
    return multiply_random(c, salt, scope, *PER_PRICE_RANGE)


def multiply_range(c: Column, salt, scope: str, percent: float = 10) -> Column:
    spread = percent / 100.0
    return multiply_random(c, salt, scope, 1.0 - spread, 1.0 + spread)


def escape_formula(c: Column) -> Column:
    """Spreadsheet programs run cells that start with one of ``= + - @``; quote them."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)


def escape_all_formulas(df: DataFrame) -> DataFrame:
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: escape_formula(F.col(f"`{name}`")) for name in strings}) if strings else df


def escape_header(name: str) -> str:
    return "'" + name if name[:1] in ("=", "+", "-", "@") else name


# --- numbering and permutation ----------------------------------------------


def _row_order(row_id) -> Column:
    if row_id is None:
        return F.monotonically_increasing_id()
    names = quoted(*([row_id] if isinstance(row_id, str) else row_id))
    return names[0] if len(names) == 1 else F.struct(*names)


def number_values(frames: list[DataFrame], column: str, row_id=None) -> DataFrame:
    """``(value, n, n_rows)``: distinct values of a column numbered by first appearance.

    Several tables share one numbering, in table order.  Values are grouped
    before anything is sorted, so the sort sees each value once.
    """
    parts = [
        frame.select(
            F.col(f"`{column}`").cast("string").alias("value"),
            F.struct(F.lit(i).alias("table"), _row_order(row_id).alias("row")).alias("first"),
        ).where(F.col("value").isNotNull())
        for i, frame in enumerate(frames)
    ]
    distinct = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("value")
        .agg(F.min("first").alias("first"), F.count("*").alias("n_rows"))
    )
    return number_distinct(distinct, ["first", "value"]).select("value", "n", "n_rows")


def with_value_number(df: DataFrame, column: str, numbers: DataFrame, masked: Column, row_id=None) -> DataFrame:
    """Replace a column through the numbered lookup; ``masked`` is built from column ``n``."""
    lookup = numbers.withColumnRenamed("value", "_value").withColumn("_masked", masked)
    keyed = df.withColumn("_value", F.col(f"`{column}`").cast("string"))
    single = row_id if isinstance(row_id, str) else None
    joined = lookup_join(keyed, lookup, ["_value"], ["_masked"], weight="n_rows", row_id=single)
    return joined.withColumn(column, F.col("_masked")).select(*quoted(*df.columns))


def numbered_name(rule: ColumnRule) -> Column:
    return F.concat(F.lit(rule.replace_with), F.col("n").cast("string"))


def numbered_placeholder(rule: ColumnRule) -> Column:
    return F.concat(F.lit(f"[{rule.prefix}-"), F.format_string("%03d", "n"), F.lit("]"))


def permuted_values(df: DataFrame, column: str, row_id: str, salt) -> DataFrame:
    """``(row_id, new value)`` for a whole-column permutation.

    Row ids are ranked by one keyed digest and values by another; equal ranks
    meet in an equi-join.  Only the id and the column travel.
    """
    (row,) = quoted(row_id)
    ids = hash_rank(df.select(row.alias("_id")), keyed_digest(F.col("_id"), salt, f"slot:{column}"), "_rank")
    values = hash_rank(
        df.select(row.alias("_id"), F.col(f"`{column}`").alias("_new")),
        keyed_digest(F.col("_id"), salt, f"value:{column}"), "_rank",
    ).select("_rank", "_new")
    return ids.join(values, "_rank").select("_id", "_new")


def identifies_rows(df: DataFrame, row_id: str) -> bool:
    """Whether a column is unique and never NULL."""
    (row,) = quoted(row_id)
    repeated = df.groupBy(row.alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1 or _id is null")
    return repeated.isEmpty()


def shuffle_column(df: DataFrame, column: str, row_id: str | None, salt) -> DataFrame:
    """Permute one column over all rows; the multiset of values (nulls too) is kept.

    ``row_id`` should name a column that is unique and never NULL.  Without one, or
    where the column turns out not to be, the rows are written once with an id of
    their own, so no row is lost or multiplied.
    """
    if row_id is None or not identifies_rows(df, row_id):
        rows = stash(df.withColumn("_row", F.monotonically_increasing_id()))
        return _permuted(rows, column, "_row", salt).drop("_row")
    return _permuted(df, column, row_id, salt)


def _permuted(df: DataFrame, column: str, row_id: str, salt) -> DataFrame:
    moved = df.withColumn("_id", quoted(row_id)[0]).join(permuted_values(df, column, row_id, salt), "_id")
    return moved.withColumn(column, F.col("_new")).select(*quoted(*df.columns))


# --- type detection ----------------------------------------------------------


def column_types(df: DataFrame, row_id=None, sample: int | None = 20, judged: list[str] | None = None) -> dict[str, str]:
    """``number``, ``date`` or ``text`` per column.

    Typed columns answer from the schema.  String columns are judged by the
    first ``sample`` rows, or by all of them without a sample: over 70 % numbers,
    else over 70 % dates, else text.  ``judged`` limits that look at the data to
    the string columns named there.
    """
    types, strings = {}, []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            types[f.name] = "number"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            types[f.name] = "date"
        else:
            types[f.name] = "text"
            if isinstance(f.dataType, T.StringType) and (judged is None or f.name in judged):
                strings.append(f.name)
    if strings:
        found = detected_types(df, strings, row_id, sample).collect()
        types.update({r["column_name"]: r["detected_type"] for r in found})
    return types


def detected_types(df: DataFrame, columns: list[str], row_id=None, sample: int | None = 20) -> DataFrame:
    """``(column_name, detected_type)`` from the head of the table, or from all of it without a sample."""
    return type_counts(df, columns, row_id, sample).select("column_name", "detected_type")


def type_counts(df: DataFrame, columns: list[str], row_id=None, sample: int | None = None) -> DataFrame:
    """``(column_name, detected_type, n_values, n_numbers, n_dates)``, one pass for all columns."""
    if sample is None:
        head = df
    elif row_id is not None:
        names = [row_id] if isinstance(row_id, str) else list(row_id)
        # The last id of the head comes from the id column alone; as a filter it
        # keeps the scan of the judged columns to the row groups that hold the head.
        ids = df.select(names[0]).orderBy(names[0]).limit(sample)
        last = ids.agg(F.max(names[0]).alias("last")).first()["last"]
        head = (df if last is None else df.where(F.col(names[0]) <= F.lit(last))).orderBy(*names).limit(sample)
    else:
        head = df.limit(sample)
    shares = [F.struct(F.lit(name).alias("column_name"), *value_kinds(F.col(f"`{name}`").cast("string"))) for name in columns]
    return (
        head.agg(F.array(*shares).alias("shares"))
        .select(F.inline("shares"))
        .select("column_name", mostly().alias("detected_type"), "n_values", "n_numbers", "n_dates")
    )


def value_kinds(text: Column) -> list[Column]:
    """Aggregates ``n_values, n_numbers, n_dates`` of string cells."""
    value = F.when(~text.isin("", " "), text)
    return [
        F.count(value).alias("n_values"), F.count(value.try_cast("double")).alias("n_numbers"), F.count(value.try_cast("timestamp")).alias("n_dates"),
    ]


def mostly() -> Column:
    """``number``, ``date`` or ``text``, from the counts of ``value_kinds``: more than 70 % decide."""
    most = lambda n: F.col(n) > F.lit(0.7) * F.col("n_values")
    return F.when(most("n_numbers"), "number").when(most("n_dates"), "date").otherwise("text")


def rejection(rule: ColumnRule, detected: str) -> str | None:
    """Why a rule cannot run on a column of the detected type, or None."""
    kind = rule.anonymization_type
    needed = REQUIRED_TYPE.get(kind)
    if needed and detected != needed:
        return cat.TYPE_MISMATCH % (kind, detected, rule.column_name)
    if kind != "shuffle" and kind not in TRANSFORMATIONS.get(rule.column_type, set()):
        return f"No transformation '{kind}' for declared type '{rule.column_type}' of column '{rule.column_name}'"
    return None


# --- whole tables ------------------------------------------------------------


@dataclass
class MaskedTables:
    """Masked tables by name, mapping rows, refused rules and (optional) cell logs.

    ``left`` has a row per table and date or number rule on a string column: cells
    that the rule changes, and cells it leaves because they are no date or number.
    """

    tables: dict[str, DataFrame]
    mapping: DataFrame | None = None
    rejected: list[dict] = field(default_factory=list)
    log: DataFrame | None = None
    left: list[dict] = field(default_factory=list)

    @property
    def table(self) -> DataFrame:
        (only,) = self.tables.values()
        return only


LOG_COLUMN = "_cell_log"
LOG_TYPE = "array<struct<ruleId:string,originalTermDisplay:string,appliedPattern:string,replacedWith:string,count:bigint>>"


def _log_cell(rule: ColumnRule, old: Column, new: Column) -> Column:
    entry = F.struct(
        F.lit(rule.id).alias("ruleId"),
        old.cast("string").alias("originalTermDisplay"),
        F.lit(rule.column_name).alias("appliedPattern"),
        new.cast("string").alias("replacedWith"),
        F.lit(1).cast("long").alias("count"),
    )
    return F.concat(F.col(LOG_COLUMN), F.when(old.isNotNull(), F.array(entry)).otherwise(F.array().cast(LOG_TYPE)))


def masked_value(rule: ColumnRule, c: Column, data_type: T.DataType, salt) -> Column:
    """Masked value of a rule that needs nothing but its own cell ``c``."""
    scope = rule.column_name
    if rule.anonymization_type == "replace":
        return replace_constant(c, rule.replace_with)
    if rule.anonymization_type == "jabber":
        return jabber_keyed(c, salt, scope) if rule.preserve_uniqueness else jabber_fresh(c)
    if rule.anonymization_type == "pseudonym":
        return permute_text(c, salt, scope, ALPHABET if rule.column_subtype == "letters" else None)
    text = isinstance(data_type, T.StringType)
    if rule.anonymization_type == "date_offset":
        shifted = shift_days(c.try_cast("timestamp") if text else c, rule.date_offset_days)
        if text:  # a day stays a day; what is no date stays as it is
            day = c.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$")
            return F.coalesce(F.when(day, shifted.cast("date").cast("string")).otherwise(shifted.cast("string")), c)
        return shifted.cast("date") if isinstance(data_type, T.DateType) else shifted
    if isinstance(data_type, T.DecimalType):
        return multiply_decimal(c, _factor(rule, c, salt, scope), data_type)
    number = c.try_cast("double")
    if rule.price_strategy == "random_per_price":
        new = multiply_per_value(number, salt, scope)
    elif rule.price_strategy == "random_range":
        new = multiply_range(number, salt, scope, rule.random_range_percent)
    else:
        new = multiply_fixed(number, rule.number_multiplier)
    return F.coalesce(new.cast("string"), c) if text else new


def _factor(rule: ColumnRule, c: Column, salt, scope: str) -> Column:
    """What a decimal cell is multiplied by."""
    draw = uniform(keyed_digest(c.cast("double"), salt, scope))
    if rule.price_strategy == "random_per_price":
        low, high = PER_PRICE_RANGE
    elif rule.price_strategy == "random_range":
        low, high = 1 - rule.random_range_percent / 100, 1 + rule.random_range_percent / 100
    else:
        return F.lit(Decimal(str(rule.number_multiplier)))
    return F.lit(low) + draw * F.lit(high - low)


def is_numbered(rule: ColumnRule) -> bool:
    """Whether a rule gives the distinct values of its column numbers."""
    asked = rule.reversible or (rule.preserve_uniqueness and rule.anonymization_type == "replace")
    return asked and rule.column_type == "text" and rule.anonymization_type in ("replace", "jabber")


def _numbered_alone(rules: list[ColumnRule], frames: dict[str, DataFrame]) -> list[ColumnRule]:
    """Numbered rules, two or more, that are the only ones on their column: their order does not matter."""
    alone = [r for r in rules if is_numbered(r) and sum(o.column_name == r.column_name for o in rules) == 1]
    alone = [r for r in alone if any(r.column_name in df.columns for df in frames.values())]
    return alone if len(alone) > 1 else []


def _number_together(frames: dict[str, DataFrame], rules: list[ColumnRule], row_id) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """All rules' columns numbered by one exchange of narrow rows and replaced by one lookup; mapping rows."""
    by_column = {r.column_name: r for r in rules}
    numbers = number_columns(list(frames.values()), list(by_column), _row_order(row_id))
    masked = F.coalesce(*[
        F.when(F.col("column_name") == c, numbered_placeholder(r) if r.reversible else numbered_name(r)) for c, r in by_column.items()
    ])
    lookup = stash(numbers.select("column_name", "key", masked.alias("value")))
    out = {}
    for name, df in frames.items():
        own = [c for c in by_column if c in df.columns]
        found = lookup_columns(df, lookup, own) if own else df
        found = found.withColumns({c: F.col(found_name(i)) for i, c in enumerate(own)}) if own else found
        out[name] = found.select(*quoted(*df.columns))
    back = [c for c, r in by_column.items() if r.reversible]
    mapping = lookup.where(F.col("column_name").isin(back)).select("column_name", F.col("key").alias("original"), F.col("value").alias("masked"))
    return out, [mapping] if back else []


def mask_tables(
    tables: dict[str, DataFrame],
    rules: list,
    row_id=None,
    salt=None,
    reversible_mode: bool = False,
    keep_log: bool = False,
    escape: bool = True,
) -> MaskedTables:
    """Apply column rules to one table or several that share value numberings.

    Shuffles come first, then the other rules in list order, so a later rule on
    a column sees the earlier outcome.  Rules on absent columns are skipped;
    rules that do not fit the column are refused and reported; all rows of a string
    column are judged for that.  A date or number rule changes the cells that are a
    date or a number and leaves the others; a string column stays one.

    ``salt`` keys the repeatable random values; without one the call draws its
    own, so results agree within the call only.  A Column such as
    ``secrets.scalar()`` keeps the salt out of plans.
    """
    salt = token_hex(16) if salt is None else salt
    frames = {n: (df.withColumn(LOG_COLUMN, F.array().cast(LOG_TYPE)) if keep_log else df) for n, df in tables.items()}
    parsed = parse_column_rules(rules)
    judged = [r.column_name for r in parsed if r.anonymization_type in REQUIRED_TYPE]
    types, cells = {}, {}
    for n, df in tables.items():
        types[n] = column_types(df, row_id, judged=[])
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name in judged]
        found = type_counts(df, strings).collect() if strings else []
        types[n].update({r["column_name"]: r["detected_type"] for r in found})
        cells.update({(n, r["column_name"]): r for r in found})
    mappings, rejected, left = [], [], []
    together = [] if keep_log else _numbered_alone(parsed, frames)
    if together:
        frames, mappings = _number_together(frames, together, row_id)
    ordered = [r for r in parsed if r.anonymization_type == "shuffle"] + [
        r for r in parsed if r.anonymization_type != "shuffle"
    ]
    for turn, rule in enumerate(ordered):
        column = rule.column_name
        # The last pass over the table escapes every string; earlier it shows only in
        # the log and to a later rule on the same column.
        escape_now = escape and (keep_log or any(r.column_name == column for r in ordered[turn + 1 :]))
        usable = []
        for name in frames:
            if column not in types[name]:
                continue
            reason = rejection(rule, types[name][column])
            if reason:
                rejected.append({"table": name, "ruleId": rule.id, "column": column, "reason": reason})
            else:
                usable.append(name)
                if (name, column) in cells and rule.anonymization_type in REQUIRED_TYPE:
                    counts = cells[name, column]
                    changed = counts["n_dates" if rule.anonymization_type == "date_offset" else "n_numbers"]
                    left.append({"table": name, "ruleId": rule.id, "column": column, "changed": changed, "left": counts["n_values"] - changed})
        if not usable:
            continue
        if rule in together:
            continue
        numbers = masked = None
        if is_numbered(rule):
            numbers = number_values([frames[n] for n in usable], column, row_id)
            masked = numbered_placeholder(rule) if rule.reversible else numbered_name(rule)
            if rule.reversible:
                mappings.append(
                    numbers.select(
                        F.lit(column).alias("column_name"), F.col("value").alias("original"), masked.alias("masked")
                    )
                )
        for name in usable:
            df = frames[name]
            before = df.withColumn("_before", F.col(f"`{column}`"))
            if rule.anonymization_type == "shuffle":
                one_id = row_id if isinstance(row_id, str) else None
                after = shuffle_column(before, column, one_id, salt)
            elif numbers is not None:
                after = with_value_number(before, column, numbers, masked, row_id)
            else:
                after = before.withColumn(column, masked_value(rule, F.col(f"`{column}`"), df.schema[column].dataType, salt))
                if reversible_mode and rule.column_type in ("date", "number"):
                    mappings.append(
                        after.where(F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(F.col(f"`{column}`")))
                        .select(
                            F.lit(column).alias("column_name"),
                            F.col("_before").cast("string").alias("original"),
                            F.col(f"`{column}`").cast("string").alias("masked"),
                        )
                        .distinct()
                    )
            if escape_now and isinstance(after.schema[column].dataType, T.StringType):
                after = after.withColumn(column, escape_formula(F.col(f"`{column}`")))
            if keep_log:
                after = after.withColumn(LOG_COLUMN, _log_cell(rule, F.col("_before"), F.col(f"`{column}`")))
            frames[name] = after.drop("_before")
    log = None
    if keep_log:
        log = reduce(
            DataFrame.unionByName,
            [each_struct(df, LOG_COLUMN).withColumn("sourceFileName", F.lit(n)) for n, df in frames.items()],
        )
        frames = {n: df.drop(LOG_COLUMN) for n, df in frames.items()}
    if escape:
        frames = {n: escape_all_formulas(df) for n, df in frames.items()}
    mapping = reduce(DataFrame.unionByName, mappings).distinct() if mappings else None
    return MaskedTables(frames, mapping, rejected, log, left)


def mask_table(df: DataFrame, rules: list, name: str = "table", **options) -> MaskedTables:
    return mask_tables({name: df}, rules, **options)


def restore_pseudonyms(df: DataFrame, rules: list, salt) -> DataFrame:
    """Undo the ``pseudonym`` rules of a masked table with the key alone, no mapping.

    A cell that the rule cannot have made becomes NULL; absent columns are skipped.
    """
    asked = [r for r in parse_column_rules(rules) if r.anonymization_type == "pseudonym" and r.column_name in df.columns]
    plain = {}
    for rule in asked:
        (c,) = quoted(rule.column_name)
        plain[rule.column_name] = restore_text(c, salt, rule.column_name, ALPHABET if rule.column_subtype == "letters" else None)
    return df.withColumns(plain) if plain else df


# --- previews ----------------------------------------------------------------


def table_preview(df: DataFrame, name: str = "Sheet1", index: int = 0, rows: int = 5, row_id=None) -> DataFrame:
    """One row: sheet name, row count, column names and the first rows as strings."""
    titles = [c if c.strip() else f"Column {i + 1}" for i, c in enumerate(df.columns)]
    order = [row_id] if isinstance(row_id, str) else list(row_id or [])
    head = df.orderBy(*order).limit(rows) if order else df.limit(rows)
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    first = head.select(
        F.struct(*[F.col(c) for c in order], cells.alias("cells")).alias("line")
    ).agg(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["cells"]).alias("preview"))
    counted = df.agg(F.count("*").alias("rows"))
    return counted.withColumn("_one", F.lit(1)).join(first.withColumn("_one", F.lit(1)), "_one").select(
        F.lit(name).alias("name"),
        F.lit(index).alias("index"),
        "rows",
        F.array(*[F.lit(t) for t in titles]).alias("columns"),
        "preview",
    )


def column_pii_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Which columns hold mostly e-mails or phones, and the mask to suggest.

    One pass and one row of partial sums per task, however many columns.
    """
    names = columns or [c for c in df.columns if not c.startswith("_")]
    measures = []
    for name in names:
        text = F.col(f"`{name}`").cast("string")
        value = F.when(F.trim(text) != "", text)
        email = value.rlike(cat.PROFILE_EMAIL)
        phone = F.regexp_replace(value, r"(?U)\s", "").rlike(cat.PROFILE_PHONE)
        measures.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(value).alias("n_values"),
                F.count_if(email).alias("n_emails"),
                F.count_if(phone).alias("n_phones"),
            )
        )
    profile = df.agg(F.array(*measures).alias("m")).select(F.inline("m")).where("n_values > 0")
    return profile.withColumn(
        "detected_type",
        F.when(F.col("n_emails") / F.col("n_values") > 0.5, "emails").when(
            F.col("n_phones") / F.col("n_values") > 0.5, "telefoonnummers"
        ),
    ).withColumn(
        "suggested_mask",
        F.when(F.col("detected_type") == "emails", cat.EMAIL_PLACEHOLDER).when(
            F.col("detected_type") == "telefoonnummers", cat.PHONE_PLACEHOLDER
        ),
    )
