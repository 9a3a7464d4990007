"""Inputs that ordinary tables hold: mixed cells, missing and repeated ids, odd headers, mappings written twice."""

from pyspark.sql import functions as F

from cloakframe.functions import catalogue as cat
from cloakframe.operators import columns, redact, restore, rules
from cloakframe.operators.numbering import scratch_path, stash
from cloakframe.streaming import jobs as streaming

from .inputs import MESSAGES_SQL, from_sql, in_duck, messages, table
from .masking import SALT, sql_digest
from .redaction import CORPUS_SQL
from .registry import query
from .restoring import KNOWN_SQL, _known
from .streams import _stream

# After the first twenty parts every fifth cell is no number and no date.
MIXED = """
select p_partkey as id, case when p_partkey > 20 and p_partkey % 5 = 0 then 'n.v.t.' else cast(p_size as {T}) end as size,
  case when p_partkey > 20 and p_partkey % 5 = 0 then 'onbekend' when p_partkey % 11 = 0 then null
    else concat('20', lpad(cast(p_partkey % 30 as {T}), 2, '0'), '-03-01') end as bought
from part
"""
MIXED_RULES = [
    {"id": "n", "columnName": "size", "columnType": "number", "anonymizationType": "number_multiply", "numberMultiplier": 4.0},
    {"id": "d", "columnName": "bought", "columnType": "date", "anonymizationType": "date_offset", "dateOffsetDays": 3},
]


@query(
    "mask_mixed_cells",
    f"""
    with cells as (select *, id > 20 and id % 5 = 0 as other from ({in_duck(MIXED)}) as m)
    select id, case when other then size else cast(cast(size as double) * 4 as varchar) end as size,
      case when other then bought else strftime(cast(bought as date) + 3, '%Y-%m-%d') end as bought,
      (select count(*) from cells where other) as n_left from cells
    """,
)
def mask_mixed_cells(spark, sf):
    masked = columns.mask_table(from_sql(spark, sf, MIXED, "part"), MIXED_RULES)
    (left,) = {r["left"] for r in masked.left}
    return masked.table.withColumn("n_left", F.lit(left).cast("long"))


@query("restore_mixed_cells", f"select id, size, bought from ({in_duck(MIXED)}) as m")
def restore_mixed_cells(spark, sf):
    masked = columns.mask_table(from_sql(spark, sf, MIXED, "part"), MIXED_RULES, reversible_mode=True)
    return restore.restore_table(masked.table, masked.mapping, ["size", "bought"], row_id="id")


MOSTLY_TEXT = """
select p_partkey as id, case when p_partkey <= 20 then cast(p_size as {T}) else p_name end as cell from part
"""


@query("mask_judges_whole_column", f"select id, cell, 1::bigint as n_rejected from ({in_duck(MOSTLY_TEXT)}) as m")
def mask_judges_whole_column(spark, sf):
    rule = {"id": "n", "columnName": "cell", "columnType": "number", "anonymizationType": "number_multiply", "numberMultiplier": 4.0}
    masked = columns.mask_table(from_sql(spark, sf, MOSTLY_TEXT, "part"), [rule], row_id="id")
    return masked.table.withColumn("n_rejected", F.lit(len(masked.rejected)).cast("long"))


@query(
    "mask_decimals",
    """
    select l_orderkey, l_linenumber, round(cast(l_extendedprice as decimal(18, 2)) * 1.25, 2)::decimal(18, 2)::varchar as price from lineitem
    """,
)
def mask_decimals(spark, sf):
    rule = {"id": "p", "columnName": "price", "columnType": "number", "anonymizationType": "number_multiply", "numberMultiplier": 1.25}
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return columns.mask_table(lines, [rule]).table.withColumn("price", F.col("price").cast("string"))


WEAK_IDS = "case when o_orderkey % 10 = 0 then null when o_orderkey % 7 = 0 then 7 else o_orderkey end"


@query(
    "mask_shuffle_weak_ids",
    f"""
    select 'id' as part, cast({WEAK_IDS} as varchar) as value, count(*) as n from orders group by all
    union all select 'price', cast(o_orderstatus as varchar), count(*) from orders group by all
    """,
)
def mask_shuffle_weak_ids(spark, sf):
    """Missing and repeated row ids: every row and every value is still there."""
    rows = table(spark, sf, "orders").select(F.expr(WEAK_IDS).alias("id"), "o_orderstatus")
    rule = {"id": "s", "columnName": "o_orderstatus", "anonymizationType": "shuffle"}
    shuffled = stash(columns.mask_table(rows, [rule], row_id="id", salt=SALT).table)
    ids = shuffled.groupBy(F.lit("id").alias("part"), F.col("id").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return ids.union(shuffled.groupBy(F.lit("price").alias("part"), F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n")))


@query("redact_corpus_weak_ids", f"select redacted, count(*) as n from ({CORPUS_SQL}) as c group by 1")
def redact_corpus_weak_ids(spark, sf):
    rows = messages(spark, sf).withColumn("doc_id", F.expr("case when doc_id % 5 = 0 then null when doc_id % 3 = 0 then 3 else doc_id end"))
    return redact.redact_corpus(rows, "doc_id")[0].groupBy("redacted").agg(F.count("*").alias("n"))


@query(
    "mask_odd_headers",
    f"""
    select a.id, b.v as phone, printf('[E-MAIL_ADRES-%03d]', n) as email, '[ANONIEM]' as dotted
    from (select o_orderkey as id, o_custkey, row_number() over (order by {sql_digest('cast(o_orderkey as varchar)', 'slot:Tel.nr')}) as r from orders) as a
    join (select o_totalprice as v, row_number() over (order by {sql_digest('cast(o_orderkey as varchar)', 'value:Tel.nr')}) as r from orders) as b on a.r = b.r
    join (select o_custkey as c, row_number() over (order by min(o_orderkey)) as n from orders group by 1) as x on o_custkey = c
    """,
)
def mask_odd_headers(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("rij.nr"), F.col("o_totalprice").alias("Tel.nr"), F.col("o_custkey").cast("string").alias("e-mail adres"),
        F.col("o_orderstatus").alias("a.b"),
    )
    odd = [
        {"id": "1", "columnName": "Tel.nr", "anonymizationType": "shuffle"}, {"id": "2", "columnName": "e-mail adres", "reversible": True},
        {"id": "3", "columnName": "a.b"},
    ]
    return columns.mask_table(rows, odd, row_id="rij.nr", salt=SALT).table.toDF("id", "phone", "email", "dotted")


@query("restore_conversations", "select conv_id, turn, text as restored from conversations where text is not null")
def restore_conversations(spark, sf):
    """Many rows share a document id."""
    turns = table(spark, sf, "conversations").where("text is not null")
    redacted, known = redact.redact_corpus(turns, "conv_id")
    return restore.restore_corpus(stash(redacted), known, "conv_id").select("conv_id", "turn", "restored")


@query("restore_mapping_written_twice", f"select doc_id, text as restored from {MESSAGES_SQL} as m")
def restore_mapping_written_twice(spark, sf):
    redacted = stash(redact.redact_reversible(messages(spark, sf)))
    path = scratch_path(spark, "mapping")
    for _ in range(2):
        redact.mapping_rows(redacted, "doc_id").write.mode("append").parquet(path)
    twice = redacted.select("doc_id", "redacted").union(redacted.select("doc_id", "redacted")).distinct()
    return restore.restore_documents(twice, spark.read.parquet(path), "doc_id").select("doc_id", "restored")


@query(
    "restore_cells_with_tokens",
    f"""
    select o_orderkey, concat('klant ', original, ' belt ', original) as note, concat('[ITEM_x] ', o_orderstatus) as other
    from orders join {KNOWN_SQL} as k on original = cast(o_custkey as varchar)
    """,
)
def restore_cells_with_tokens(spark, sf):
    token = F.concat(F.lit("[ITEM_"), (F.col("o_custkey") + 1).cast("string"), F.lit("]"))
    cells = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("klant "), token, F.lit(" belt "), token).alias("note"), F.concat(F.lit("[ITEM_x] "), "o_orderstatus").alias("other")
    )
    known = _known(spark, sf).union(_known(spark, sf)).select("placeholder", "original")
    return restore.restore_cells(cells, known)


@query(
    "rules_refused",
    f"""
    select "ruleId", "appliedPattern", count(*) as n_entries, sum(n)::bigint as n_matches from (
      select 'danger' as "ruleId", '{cat.PATTERN_DANGEROUS}' as "appliedPattern", 0 as n from orders
      union all select 'long', '{cat.PATTERN_TOO_LONG % cat.MAX_PATTERN_LENGTH}', 0 from orders
      union all select 'broken', 'FOUT: (open', 0 from orders
      union all select 'good', 'status [A-Z]', 1 from orders) as x group by all
    """,
)
def rules_refused(spark, sf):
    refused = [
        {"id": "danger", "originalTerm": "(?:a)++", "isRegex": True}, {"id": "long", "originalTerm": "x" * (cat.MAX_PATTERN_LENGTH + 1), "isRegex": True},
        {"id": "broken", "originalTerm": "(open", "isRegex": True}, {"id": "good", "originalTerm": "status [A-Z]", "replacementTerm": "s", "isRegex": True},
    ]
    logs = rules.explode_log(rules.apply_rules(messages(spark, sf), refused))
    return logs.groupBy("ruleId", "appliedPattern").agg(F.count("*").alias("n_entries"), F.sum("count").alias("n_matches"))


@query(
    "stream_mapping_second_stream",
    """
    with first as (select o_custkey, min(o_orderkey) as k, 0 as turn from orders where o_orderkey % 2 = 0 group by 1),
      second as (select o_custkey, min(o_orderkey) as k, 1 as turn from orders where o_orderkey % 2 = 1 and o_custkey not in (select o_custkey from first) group by 1)
    select cast(o_custkey as varchar) as original, concat('[ITEM_', cast(row_number() over (order by turn, k) as varchar), ']') as placeholder
    from (select * from first union all select * from second) as x
    """,
)
def stream_mapping_second_stream(spark, sf):
    """A stream with a checkpoint of its own goes on where the mapping stands."""
    path = scratch_path(spark, "mapping")
    for half in (0, 1):
        orders = _stream(spark, sf, "orders").where(F.col("o_orderkey") % 2 == half)
        values = orders.select(F.col("o_custkey").cast("string").alias("original"), F.col("o_orderkey").alias("seen"))
        streaming.allocate_stream(values, path, f"{path}-checkpoint-{half}").awaitTermination()
    return spark.read.schema(streaming.MAPPING_SCHEMA).parquet(path).select("original", "placeholder")
