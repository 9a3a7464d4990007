"""Masking of table columns."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.permute import permute_number, restore_number
from cloakframe.operators import columns, restore
from cloakframe.operators.numbering import stash

from .inputs import from_sql, in_duck, sql_cents, table, texts
from .registry import query

SALT = "zout"


def sql_digest(value: str, scope: str) -> str:
    return f"sha256(concat('{SALT}|{scope}:', {value}))"


def sql_uniform(digest: str) -> str:
    return f"(('0x' || substr({digest}, 1, 8))::ubigint / 4294967296.0::double)"


def sql_jabber(digest: str) -> str:
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    letters = [f"substr('{alphabet}', (('0x' || substr({digest}, {1 + 4 * i}, 4))::ubigint % 62 + 1)::int, 1)" for i in range(8)]
    return "concat(" + ", ".join(letters) + ")"


def customers(spark, sf):
    """Customers with every 50th name and every 7th segment missing."""
    return table(spark, sf, "customer").withColumns(
        {
            "c_name": F.when(F.col("c_custkey") % 50 != 0, F.col("c_name")),
            "c_mktsegment": F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")),
        }
    )


CUSTOMERS_SQL = """(select c_custkey, case when c_custkey % 50 <> 0 then c_name end as c_name, c_nationkey, c_acctbal,
  case when c_custkey % 7 <> 0 then c_mktsegment end as c_mktsegment from customer)"""


@query("mask_replace", f"select c_custkey, case when c_name is not null then '[ANONIEM]' end as c_name, c_mktsegment from {CUSTOMERS_SQL} as c")
def mask_replace(spark, sf):
    rule = {"id": "c1", "columnName": "c_name"}
    return columns.mask_table(customers(spark, sf), [rule]).table.select("c_custkey", "c_name", "c_mktsegment")


NUMBERED_SQL = f"""
select c_custkey, c_mktsegment as original, n from {CUSTOMERS_SQL} as c left join (
  select c_mktsegment as v, row_number() over (order by min(c_custkey)) as n from {CUSTOMERS_SQL} as d where c_mktsegment is not null group by 1) as x
  on c_mktsegment = v
"""


@query("mask_unique", f"select c_custkey, case when n is not null then concat('Segment', cast(n as varchar)) end as c_mktsegment from ({NUMBERED_SQL}) as y")
def mask_unique(spark, sf):
    rule = {"id": "c2", "columnName": "c_mktsegment", "replaceWith": "Segment", "preserveUniqueness": True}
    return columns.mask_table(customers(spark, sf), [rule], row_id="c_custkey").table.select("c_custkey", "c_mktsegment")


@query(
    "mask_unique_names",
    f"""select c_custkey, case when c_name is not null then concat('Klant', cast(row_number() over (partition by c_name is not null order by c_custkey) as varchar)) end as c_name
    from {CUSTOMERS_SQL} as c""",
)
def mask_unique_names(spark, sf):
    rule = {"id": "c2", "columnName": "c_name", "replaceWith": "Klant", "preserveUniqueness": True}
    return columns.mask_table(customers(spark, sf), [rule], row_id="c_custkey").table.select("c_custkey", "c_name")


@query("mask_reversible", f"select c_custkey, case when n is not null then printf('[MARKT_SEGMENT-%03d]', n) end as c_mktsegment from ({NUMBERED_SQL}) as y")
def mask_reversible(spark, sf):
    rule = {"id": "c3", "columnName": "c_mktsegment", "columnSubtype": "markt segment", "reversible": True}
    return columns.mask_table(customers(spark, sf), [rule], row_id="c_custkey").table.select("c_custkey", "c_mktsegment")


@query(
    "mask_reversible_mapping",
    f"select distinct 'c_mktsegment' as column_name, original, printf('[C_MKTSEGMENT-%03d]', n) as masked from ({NUMBERED_SQL}) as y where n is not null",
)
def mask_reversible_mapping(spark, sf):
    rule = {"id": "c6", "columnName": "c_mktsegment", "anonymizationType": "jabber", "reversible": True}
    return columns.mask_table(customers(spark, sf), [rule], row_id="c_custkey").mapping


@query(
    "mask_reversible_orders",
    """
    select o_orderkey, printf('[O_CUSTKEY-%03d]', n) as o_custkey from orders join (
      select o_custkey as v, row_number() over (order by min(o_orderkey)) as n from orders group by 1) as x on o_custkey = v
    """,
)
def mask_reversible_orders(spark, sf):
    rule = {"id": "c3", "columnName": "o_custkey", "reversible": True}
    return columns.mask_table(table(spark, sf, "orders"), [rule], row_id="o_orderkey").table.select("o_orderkey", "o_custkey")


@query(
    "mask_jabber_fresh",
    f"select count(*) as n_rows, count(c_name) as n_masked, count(c_name) as n_well_formed, 0::bigint as n_unchanged from {CUSTOMERS_SQL} as c",
)
def mask_jabber_fresh(spark, sf):
    rule = {"id": "c4", "columnName": "c_name", "anonymizationType": "jabber"}
    df = customers(spark, sf).withColumn("before", F.col("c_name"))
    masked = columns.mask_table(df, [rule]).table
    return masked.agg(
        F.count("*").alias("n_rows"), F.count("c_name").alias("n_masked"),
        F.count_if(F.col("c_name").rlike("^[A-Za-z0-9]{8}$")).alias("n_well_formed"),
        F.count_if(F.col("c_name") == F.col("before")).alias("n_unchanged"),
    )


@query("mask_jabber_keyed", f"select c_custkey, {sql_jabber(sql_digest('c_mktsegment', 'c_mktsegment')) } as c_mktsegment from customer where c_mktsegment is not null")
def mask_jabber_keyed(spark, sf):
    rule = {"id": "c5", "columnName": "c_mktsegment", "anonymizationType": "jabber", "preserveUniqueness": True}
    return columns.mask_table(table(spark, sf, "customer"), [rule], salt=SALT).table.select("c_custkey", "c_mktsegment")


@query("mask_date_offset", "select o_orderkey, o_orderdate - interval 45 day as o_orderdate from orders")
def mask_date_offset(spark, sf):
    rule = {"id": "c7", "columnName": "o_orderdate", "columnType": "date", "anonymizationType": "date_offset", "dateOffsetDays": -45}
    return columns.mask_table(table(spark, sf, "orders"), [rule]).table.select("o_orderkey", "o_orderdate")


def _price_rule(column, strategy, **more):
    return {"id": strategy, "columnName": column, "columnType": "number", "anonymizationType": "number_multiply", "priceStrategy": strategy, **more}


LINES = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("mask_multiply_fixed", f"select {LINES}, {sql_cents('l_extendedprice * 1.25::double')} as l_extendedprice from lineitem")
def mask_multiply_fixed(spark, sf):
    rule = _price_rule("l_extendedprice", "fixed_multiplier", numberMultiplier=1.25)
    return columns.mask_table(table(spark, sf, "lineitem"), [rule]).table.select(*LINES.split(", "), "l_extendedprice")


@query(
    "mask_multiply_per_value",
    f"""
    select o_orderkey, {sql_cents(f"o_totalprice * (0.15::double + {sql_uniform(sql_digest('cast(o_totalprice as varchar)', 'o_totalprice'))} * (0.65::double - 0.15::double))")} as o_totalprice
    from orders
    """,
)
def mask_multiply_per_value(spark, sf):
    masked = columns.mask_table(table(spark, sf, "orders"), [_price_rule("o_totalprice", "random_per_price")], salt=SALT)
    return masked.table.select("o_orderkey", "o_totalprice")


@query(
    "mask_multiply_range",
    f"""
    select o_orderkey, {sql_cents(f"o_totalprice * (0.9::double + {sql_uniform(sql_digest('cast(o_totalprice as varchar)', 'o_totalprice'))} * (1.1::double - 0.9::double))")} as o_totalprice
    from orders
    """,
)
def mask_multiply_range(spark, sf):
    masked = columns.mask_table(table(spark, sf, "orders"), [_price_rule("o_totalprice", "random_range", randomRangePercent=10)], salt=SALT)
    return masked.table.select("o_orderkey", "o_totalprice")


@query(
    "mask_shuffle",
    f"""
    select a.id as o_orderkey, b.v as o_totalprice
    from (select o_orderkey as id, row_number() over (order by {sql_digest('cast(o_orderkey as varchar)', 'slot:o_totalprice')}) as r from orders) as a
    join (select o_totalprice as v, row_number() over (order by {sql_digest('cast(o_orderkey as varchar)', 'value:o_totalprice')}) as r from orders) as b on a.r = b.r
    """,
)
def mask_shuffle(spark, sf):
    rule = {"id": "c11", "columnName": "o_totalprice", "anonymizationType": "shuffle"}
    masked = columns.mask_table(table(spark, sf, "orders"), [rule], row_id="o_orderkey", salt=SALT)
    return masked.table.select("o_orderkey", "o_totalprice")


@query(
    "mask_shuffle_statistics",
    """
    select count(*) as n_rows, count(c_mktsegment) as n_values, sum(case when c_mktsegment = 'MACHINERY' then 1 else 0 end)::bigint as n_machinery,
      min(c_name) as lowest, max(c_name) as highest, count(distinct c_name) as n_names
    from (select case when c_custkey % 50 <> 0 then c_name end as c_name, case when c_custkey % 7 <> 0 then c_mktsegment end as c_mktsegment from customer) as c
    """,
)
def mask_shuffle_statistics(spark, sf):
    rules = [{"id": c, "columnName": c, "anonymizationType": "shuffle"} for c in ("c_name", "c_mktsegment")]
    shuffled = columns.mask_table(customers(spark, sf), rules, row_id="c_custkey", salt=SALT).table
    # Names are counted once each through a first grouping.
    names = shuffled.groupBy("c_name").agg(
        F.count("*").alias("n"), F.count("c_mktsegment").alias("n_values"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("m")
    )
    return names.agg(
        F.sum("n").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("m").alias("n_machinery"),
        F.min("c_name").alias("lowest"), F.max("c_name").alias("highest"), F.count("c_name").alias("n_names"),
    )


DANGEROUS = """
select p_partkey, p_size, case p_partkey % 6 when 0 then concat('=', p_name) when 1 then concat('+', p_name) when 2 then concat('-', p_name)
    when 3 then concat('@', p_name) when 4 then concat(' =', p_name) else p_name end as p_name, p_brand
from part
"""


@query(
    "formula_escape",
    f"""
    select p_partkey, p_size, case when left(p_name, 1) in ('=', '+', '-', '@') then chr(39) || p_name else p_name end as p_name, p_brand
    from ({DANGEROUS}) as d
    """,
)
def formula_escape(spark, sf):
    parts = from_sql(spark, sf, DANGEROUS, "part")
    return columns.escape_all_formulas(parts)


AS_TEXT = """
select p_partkey as id, cast(p_retailprice as {T}) as price, case when p_partkey % 5 = 0 then 'n.v.t.' else cast(p_size as {T}) end as size,
  case when p_partkey % 2 = 0 then cast(p_size as {T}) else p_name end as mixed,
  concat('20', lpad(cast(p_partkey % 30 as {T}), 2, '0'), '-03-01') as bought, ' ' as blank, p_brand as brand
from part
"""


@query(
    "column_types",
    f"""
    with head as (select * from ({in_duck(AS_TEXT)}) as a order by id limit 20),
      cells as (unpivot head on price, size, mixed, bought, blank, brand into name column_name value v)
    select column_name, case when coalesce(avg(case when v <> ' ' then (try_cast(v as double) is not null)::int end), 0) > 0.7 then 'number'
      when coalesce(avg(case when v <> ' ' then (try_cast(v as timestamp) is not null)::int end), 0) > 0.7 then 'date' else 'text' end as detected_type
    from cells group by column_name
    """,
)
def column_types(spark, sf):
    parts = from_sql(spark, sf, AS_TEXT, "part")
    return columns.detected_types(parts, ["price", "size", "mixed", "bought", "blank", "brand"], row_id="id")


@query(
    "rule_compatibility",
    f"""
    select o_orderkey, o_orderstatus, {sql_cents('o_totalprice * 2::double')} as o_totalprice, o_orderdate, 4::bigint as n_rejected from orders
    """,
)
def rule_compatibility(spark, sf):
    rules = [
        _price_rule("o_orderstatus", "fixed_multiplier", numberMultiplier=2),
        {"id": "d", "columnName": "o_totalprice", "columnType": "date", "anonymizationType": "date_offset", "dateOffsetDays": 3},
        {"id": "k", "columnName": "o_orderdate", "anonymizationType": "date_offset", "dateOffsetDays": 3},
        {"id": "p", "columnName": "o_totalprice", "columnType": "number", "anonymizationType": "price_round"},
        {"id": "x", "columnName": "absent"},
        _price_rule("o_totalprice", "fixed_multiplier", numberMultiplier=2),
    ]
    masked = columns.mask_table(table(spark, sf, "orders"), rules)
    rejected = F.lit(len(masked.rejected)).cast("long").alias("n_rejected")
    return masked.table.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", rejected)


@query(
    "cell_log",
    f"""
    select 'a' as "ruleId", c_name as "originalTermDisplay", 'c_name' as "appliedPattern", 'X' as "replacedWith", 1::bigint as "count", 'klanten.csv' as "sourceFileName"
    from {CUSTOMERS_SQL} as c where c_name is not null
    union all
    select 'b', c_mktsegment, 'c_mktsegment', c_mktsegment, 1::bigint, 'klanten.csv' from {CUSTOMERS_SQL} as c where c_mktsegment is not null and false
    union all
    select 'c', 'X', 'c_name', 'Y', 1::bigint, 'klanten.csv' from {CUSTOMERS_SQL} as c where c_name is not null
    """,
)
def cell_log(spark, sf):
    rules = [
        {"id": "a", "columnName": "c_name", "replaceWith": "X"},
        {"id": "c", "columnName": "c_name", "replaceWith": "Y"},
    ]
    return columns.mask_table(customers(spark, sf), rules, name="klanten.csv", keep_log=True).log


@query(
    "rules_in_order",
    f"""
    select p_partkey, {sql_cents(sql_cents('p_retailprice * 2::double') + ' * 0.5::double')} as p_retailprice, concat(chr(39), '=X') as p_name, '[ANONIEM]' as p_brand from part
    """,
)
def rules_in_order(spark, sf):
    rules = [
        _price_rule("p_retailprice", "fixed_multiplier", numberMultiplier=2),
        {"id": "n1", "columnName": "p_name", "replaceWith": "eerst"},
        _price_rule("p_retailprice", "fixed_multiplier", numberMultiplier=0.5),
        {"id": "n2", "columnName": "p_name", "replaceWith": "=X"},
        {"id": "n3", "columnName": "p_brand"},
    ]
    return columns.mask_table(table(spark, sf, "part"), rules).table.select("p_partkey", "p_retailprice", "p_name", "p_brand")


TWO_TABLES = """
select 'customer' as tab, 0 as i, c_custkey as id, concat('Land ', cast(c_nationkey as {T})) as land from customer
union all select 'supplier', 1, s_suppkey, concat('Land ', cast(s_nationkey as {T})) from supplier
"""


@query(
    "mask_several_tables",
    f"""
    with rows as ({in_duck(TWO_TABLES)}),
      numbers as (select land, row_number() over (order by min(i * 1000000000000 + id)) as n from rows group by land)
    select tab, id, printf('[LAND-%03d]', n) as land from rows join numbers using (land)
    """,
)
def mask_several_tables(spark, sf):
    tables = {
        name: table(spark, sf, name).select(
            F.lit(name).alias("tab"), F.col(f"{name[0]}_{'cust' if name == 'customer' else 'supp'}key").alias("id"),
            F.concat(F.lit("Land "), F.col(f"{name[0]}_nationkey").cast("string")).alias("land"),
        )
        for name in ("customer", "supplier")
    }
    masked = columns.mask_tables(tables, [{"id": "l", "columnName": "land", "reversible": True}], row_id="id")
    return reduce(DataFrame.unionByName, masked.tables.values())


@query(
    "mask_mapping_rows",
    f"""
    select distinct 'o_orderdate' as column_name, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as original, strftime(o_orderdate + interval 7 day, '%Y-%m-%d %H:%M:%S') as masked from orders
    union all
    select distinct 'o_totalprice', cast(o_totalprice as varchar), cast({sql_cents('o_totalprice * 2::double')} as varchar) from orders
    """,
)
def mask_mapping_rows(spark, sf):
    rules = [
        {"id": "d", "columnName": "o_orderdate", "columnType": "date", "anonymizationType": "date_offset", "dateOffsetDays": 7},
        _price_rule("o_totalprice", "fixed_multiplier", numberMultiplier=2),
    ]
    return columns.mask_table(table(spark, sf, "orders"), rules, reversible_mode=True).mapping


@query(
    "table_preview",
    """
    select 'part' as name, 0 as index, (select count(*) from part) as rows, 'p_partkey|p_name|p_retailprice' as columns,
      string_agg(concat_ws('|', cast(p_partkey as varchar), coalesce(p_name, ''), cast(p_retailprice as varchar)), '/' order by p_partkey) as preview
    from (select * from part order by p_partkey limit 5) as h
    """,
)
def table_preview(spark, sf):
    preview = columns.table_preview(
        table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), "part", row_id="p_partkey"
    )
    lines = F.transform("preview", lambda cells: F.array_join(cells, "|"))
    return preview.withColumns({"columns": F.array_join("columns", "|"), "preview": F.array_join(lines, "/")})


CONTACTS = """
select o_orderkey as id, concat('Gebruiker_', cast(o_custkey as {T})) as naam, concat('user', cast(o_custkey as {T}), '@example.com') as email,
  concat('06-', cast(12345678 + o_orderkey as {T})) as telefoon, concat('Straat ', cast(o_orderkey % 977 as {T}), ', Amsterdam') as adres, '1000AA' as postcode
from orders
"""


@query(
    "mask_contact_table",
    f"""
    with c as ({in_duck(CONTACTS)}),
      n as (select email as v, row_number() over (order by min(id)) as n from c group by 1)
    select id, '[NAAM]' as naam, printf('[EMAIL-%03d]', n) as email, telefoon, adres, postcode from c join n on email = v
    """,
)
def mask_contact_table(spark, sf):
    contacts = from_sql(spark, sf, CONTACTS, "orders")
    rules = [
        {"id": "1", "columnName": "naam", "replaceWith": "[NAAM]"},
        {"id": "2", "columnName": "email", "reversible": True},
    ]
    return columns.mask_table(contacts, rules, row_id="id").table


_PSEUDONYMS = [
    {"id": "p", "columnName": "c_name", "anonymizationType": "pseudonym"},
    {"id": "q", "columnName": "c_mktsegment", "columnSubtype": "letters", "anonymizationType": "pseudonym"},
]


@query(
    "mask_pseudonyms",
    """
    select count(*) as n_rows, count(distinct c_name) as n_names, count(distinct c_mktsegment) as n_segments, count(*) as n_back, 0::bigint as n_same
    from customer
    """,
)
def mask_pseudonyms(spark, sf):
    """Keyed pseudonyms: as many as there are values, and the key brings all of them back."""
    plain = texts(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    masked = stash(columns.mask_table(plain, _PSEUDONYMS, salt="zout", escape=False).table)  # as a finished job leaves it
    back = stash(columns.restore_pseudonyms(masked, _PSEUDONYMS, "zout")).join(plain, ["c_custkey", "c_name", "c_mktsegment"], "left_semi")
    same = masked.join(plain, ["c_custkey", "c_name"], "left_semi")
    counts = masked.agg(F.count("*").alias("n_rows"), F.count_distinct("c_name").alias("n_names"), F.count_distinct("c_mktsegment").alias("n_segments"))
    return counts.join(back.agg(F.count("*").alias("n_back"))).join(same.agg(F.count("*").alias("n_same")))


@query(
    "mask_number_pseudonyms",
    "select count(*) as n_rows, count(distinct o_orderkey) as n_keys, max(o_orderkey) + 1 as n_limit, true as inside, true as restored from orders",
)
def mask_number_pseudonyms(spark, sf):
    """Order keys permuted among the numbers up to the highest one."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    limit = orders.agg(F.max("o_orderkey")).first()[0] + 1
    masked = orders.withColumn("p", permute_number(F.col("o_orderkey"), limit, "zout", "orders"))
    back = restore_number(F.col("p"), limit, "zout", "orders") == F.col("o_orderkey")
    return masked.agg(
        F.count("*").alias("n_rows"), F.count_distinct("p").alias("n_keys"), F.lit(limit).cast("long").alias("n_limit"), F.bool_and(F.col("p").between(0, limit - 1)).alias("inside"),
        F.bool_and(back).alias("restored"),
    )


_WIDE = {"naam": "c_name", "segment": "c_mktsegment", "land": "cast(c_nationkey as {T})", "staart": "substr(c_name, 17, 2)", "groep": "cast(c_custkey % 7 as {T})", "saldo": "cast(c_acctbal as {T})"}
_WIDE_SQL = "select c_custkey, " + ", ".join(f"{v} as {k}" for k, v in _WIDE.items()) + " from customer"


@query(
    "mask_six_columns",
    f"""
    select c_custkey, {', '.join(f"printf('[{k.upper()}-%03d]', dense_rank() over (order by first_{k})) as {k}" for k in _WIDE)}
    from (select *, {', '.join(f"min(c_custkey) over (partition by {k}) as first_{k}" for k in _WIDE)} from ({in_duck(_WIDE_SQL)}) as w) as x
    """,
)
def mask_six_columns(spark, sf):
    """Six reversible columns: one exchange of narrow rows for all of them."""
    rows = from_sql(spark, sf, _WIDE_SQL, "customer")
    return columns.mask_table(rows, [{"id": k, "columnName": k, "reversible": True} for k in _WIDE], row_id="c_custkey", salt="zout").table


@query("restore_six_columns", in_duck(_WIDE_SQL))
def restore_six_columns(spark, sf):
    rows = from_sql(spark, sf, _WIDE_SQL, "customer")
    masked = columns.mask_table(rows, [{"id": k, "columnName": k, "reversible": True} for k in _WIDE], row_id="c_custkey", salt="zout")
    return restore.restore_table(masked.table, masked.mapping, list(_WIDE))
