"""Mappings and restoration."""

from pyspark.sql import functions as F

from cloakframe.operators import columns, mapping, redact, restore
from cloakframe.operators.numbering import number_rows, scratch_path, stash
from cloakframe.plans import restore_job
from cloakframe.sinks import writers
from cloakframe.sources import files

from .inputs import MESSAGES_SQL, NOTES_SQL, messages, notes, sql_cents, sql_emails, sql_phones, table
from .masking import CUSTOMERS_SQL, customers
from .redaction import sql_numbered
from .registry import query

KEY = "0123456789abcdef0123456789abcdef"


def _key(spark):
    """The key as a scalar subquery on a one-row table, so that no plan shows it."""
    return spark.createDataFrame([(KEY,)], "key string").scalar()


def _known(spark, sf, name="customer"):
    """A mapping in which every customer (or supplier) has a placeholder."""
    key = F.col("c_custkey" if name == "customer" else "s_suppkey")
    prefix = F.lit("" if name == "customer" else "nieuw")
    return table(spark, sf, name).select(
        F.lit("corpus").alias("scope_id"), F.lit("item").alias("kind"),
        F.concat(F.lit("[ITEM_"), (key + 1).cast("string"), F.lit("]")).alias("placeholder"),
        F.concat(prefix, key.cast("string")).alias("original"),
    )


KNOWN_SQL = """(select 'corpus' as scope_id, 'item' as kind, concat('[ITEM_', cast(c_custkey + 1 as varchar), ']') as placeholder,
  cast(c_custkey as varchar) as original, c_custkey + 1 as n from customer)"""


@query(
    "mapping_union",
    f"""
    select scope_id, kind, placeholder, case when s_suppkey is not null then concat('nieuw', original) else original end as original
    from {KNOWN_SQL} as k left join supplier on s_suppkey + 1 = n
    """,
)
def mapping_union(spark, sf):
    return mapping.add_mappings(_known(spark, sf), _known(spark, sf, "supplier"))


@query(
    "mapping_conflicts",
    f"select scope_id, placeholder, 2::bigint as n_originals from {KNOWN_SQL} as k join supplier on s_suppkey + 1 = n",
)
def mapping_conflicts(spark, sf):
    return mapping.placeholder_conflicts(_known(spark, sf).unionByName(_known(spark, sf, "supplier")))


@query(
    "mapping_allocate",
    f"""
    select 'corpus' as scope_id, 'item' as kind, cast(l_partkey as varchar) as original,
      concat('[ITEM_', cast((select max(n) from {KNOWN_SQL} as k) + row_number() over (order by min(l_orderkey), cast(l_partkey as varchar)) as varchar), ']') as placeholder
    from lineitem where cast(l_partkey as varchar) not in (select original from {KNOWN_SQL} as k) group by l_partkey
    """,
)
def mapping_allocate(spark, sf):
    """Part numbers of the order lines, of which some are known as customer numbers."""
    values = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("original"), F.col("l_orderkey").alias("seen"))
    return mapping.allocate(values, _known(spark, sf))


@query("mapping_counter", f"select max(n)::bigint as last_number, count(*) as n_entries from {KNOWN_SQL} as k")
def mapping_counter(spark, sf):
    return _known(spark, sf).agg(
        F.max(mapping.suffix_number(F.col("placeholder"))).alias("last_number"), F.count("*").alias("n_entries")
    )


@query(
    "mapping_lookup",
    f"select l_orderkey, l_linenumber, l_partkey, placeholder from lineitem left join {KNOWN_SQL} as k on cast(l_partkey as varchar) = original",
)
def mapping_lookup(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").cast("string").alias("part"))
    found = mapping.lookup_placeholders(rows, "part", _known(spark, sf), "l_orderkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "placeholder")


@query(
    "mapping_json_per_document",
    f"""
    select doc_id, len(items)::bigint as total_items, '1.0' as version, array_to_string(list_sort(list_transform(items, lambda x: x.p || '=' || x.o)), '|') as entries
    from ({sql_numbered(NOTES_SQL + ' as m')}) as x
    """,
)
def mapping_json_per_document(spark, sf):
    out = redact.redact_reversible(notes(spark, sf)).withColumn("json", mapping.mapping_json(F.col("mapping")))
    parsed = out.withColumn("m", F.from_json("json", mapping.MAPPING_JSON))
    entries = F.transform(F.map_entries("m.mappings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return parsed.select("doc_id", "m.total_items", "m.version", F.array_join(F.sort_array(entries), "|").alias("entries"))


@query("mapping_export_import", f"select scope_id, placeholder, original from {KNOWN_SQL} as k")
def mapping_export_import(spark, sf):
    exported = mapping.export_json(_known(spark, sf), entries_per_object=100)
    return mapping.load_json(exported, "json", "scope_id")


@query(
    "mapping_encrypted",
    f"select scope_id, placeholder, original, true as was_hidden from {KNOWN_SQL} as k",
)
def mapping_encrypted(spark, sf):
    key = _key(spark)
    path = scratch_path(spark, "mapping")
    writers.write_mapping(_known(spark, sf), path, key)
    stored = spark.read.parquet(path)
    hidden = F.coalesce(stored["original"].cast("string").rlike("^[0-9]+$"), F.lit(False))
    opened = mapping.decrypt_mapping(stored.withColumn("was_hidden", ~hidden), key)
    return opened.select("scope_id", "placeholder", "original", "was_hidden")


@query(
    "mapping_is_encrypted",
    "select o_orderkey, o_orderkey % 3 = 0 as is_encrypted from orders",
)
def mapping_is_encrypted(spark, sf):
    number = F.col("o_custkey").cast("string")
    plain = F.concat(F.lit('{"mappings": {"[ITEM_1]": "'), number, F.lit('"}, "total_items": 1, "version": "1.0"}'))
    sealed = F.base64(F.aes_encrypt(plain.cast("binary"), _key(spark), F.lit("GCM")))
    stored = table(spark, sf, "orders").withColumn("stored", F.when(F.col("o_orderkey") % 3 == 0, sealed).otherwise(plain))
    return stored.select("o_orderkey", mapping.is_encrypted(F.col("stored")).alias("is_encrypted"))


@query("restore_documents", f"select doc_id, text as restored from {MESSAGES_SQL} as m")
def restore_documents(spark, sf):
    redacted = stash(redact.redact_reversible(messages(spark, sf)))  # as a finished job leaves it
    return restore.restore_documents(
        redacted.select("doc_id", "redacted"), redact.mapping_rows(redacted, "doc_id"), "doc_id"
    ).select("doc_id", "restored")


@query("restore_corpus", f"select doc_id, text as restored from {MESSAGES_SQL} as m")
def restore_corpus(spark, sf):
    redacted, known = redact.redact_corpus(messages(spark, sf), "doc_id")
    return restore.restore_corpus(stash(redacted.select("doc_id", "redacted")), known, "doc_id").select("doc_id", "restored")


@query("restore_by_session", "select o_orderkey, concat('klant ', cast(o_custkey as varchar), ' van ', o_orderpriority) as restored from orders")
def restore_by_session(spark, sf):
    """Sessions (order priorities) number their customers on their own, so placeholders repeat across sessions."""
    orders = table(spark, sf, "orders").withColumn("session", F.col("o_orderpriority"))
    numbered = number_rows(orders.select("session", "o_custkey").distinct(), ["session", "o_custkey"], restart_by="session")
    customers_of = numbered.withColumn("placeholder", F.format_string("[ITEM_%d]", "n"))
    text = F.concat(F.lit("klant "), "placeholder", F.lit(" van "), "session")
    redacted = stash(orders.join(customers_of, ["session", "o_custkey"]).select("o_orderkey", "session", text.alias("redacted")))
    known = customers_of.select(F.col("session").alias("scope_id"), "placeholder", F.col("o_custkey").cast("string").alias("original"))
    out = restore_job.restore_texts(redacted, known, "o_orderkey", scope="corpus", scope_col="session")
    return out.select("o_orderkey", "restored")


@query("restore_in_row", f"select doc_id, text as restored from {MESSAGES_SQL} as m")
def restore_in_row(spark, sf):
    redacted = redact.redact_reversible(messages(spark, sf))
    return redacted.select("doc_id", restore.restore_with_pairs(F.col("redacted"), F.col("mapping")).alias("restored"))


@query(
    "restore_unknown_tokens",
    f"""
    select doc_id, concat('[TEL-999] ', replace(text, ({sql_phones('text')})[1], '[TEL-001]')) as restored from {NOTES_SQL} as n
    """,
)
def restore_unknown_tokens(spark, sf):
    redacted = stash(redact.redact_reversible(notes(spark, sf)))  # as a finished job leaves it
    emails_only = redact.mapping_rows(redacted, "doc_id").where("kind = 'email'")
    marked = redacted.select("doc_id", F.concat(F.lit("[TEL-999] "), "redacted").alias("redacted"))
    return restore.restore_documents(marked, emails_only, "doc_id").select("doc_id", "restored")


@query("restore_small_mapping", "select o_orderkey, o_orderpriority, o_orderstatus from orders")
def restore_small_mapping(spark, sf):
    masked = table(spark, sf, "orders").select(
        "o_orderkey",
        F.regexp_replace("o_orderpriority", "^1-URGENT$", "[P_1]").alias("o_orderpriority"),
        F.regexp_replace("o_orderstatus", "^F$", "[S_1]").alias("o_orderstatus"),
    )
    return restore.restore_string_cells(masked, {"[P_1]": "1-URGENT", "[S_1]": "F"})


@query("restore_table", f"select c_custkey, c_name, c_mktsegment, c_acctbal from {CUSTOMERS_SQL} as c")
def restore_table(spark, sf):
    rules = [
        {"id": "a", "columnName": "c_name", "reversible": True},
        {"id": "b", "columnName": "c_mktsegment", "reversible": True},
        {"id": "c", "columnName": "c_acctbal", "columnType": "number", "anonymizationType": "number_multiply", "numberMultiplier": 4.0},
    ]
    masked = columns.mask_table(customers(spark, sf), rules, row_id="c_custkey", reversible_mode=True)
    restored = restore.restore_table(
        masked.table, masked.mapping, ["c_name", "c_mktsegment", "c_acctbal"], row_id="c_custkey", types={"c_acctbal": "double"}
    )
    return restored.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query(
    "restore_ambiguous",
    f"""
    select 'o_totalprice' as column_name, masked, count(distinct original) as n_originals
    from (select cast(o_totalprice as varchar) as original, cast({sql_cents('o_totalprice * 0.0001::double')} as varchar) as masked from orders) as m
    group by masked having count(distinct original) > 1
    """,
)
def restore_ambiguous(spark, sf):
    rule = {"id": "p", "columnName": "o_totalprice", "columnType": "number", "anonymizationType": "number_multiply", "numberMultiplier": 0.0001}
    return restore.ambiguous(columns.mask_table(table(spark, sf, "orders"), [rule], reversible_mode=True).mapping)


@query("restore_csv", "select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer")
def restore_csv(spark, sf):
    rule = {"id": "a", "columnName": "c_mktsegment", "reversible": True}
    masked = columns.mask_table(table(spark, sf, "customer"), [rule], row_id="c_custkey")
    path = scratch_path(spark, "csv")
    writers.write_table_csv(masked.table.select("c_custkey", "c_name", "c_mktsegment"), path)
    cells = files.read_table_csv(spark, path)
    return restore.restore_table(cells, masked.mapping, ["c_mktsegment"])


@query(
    "restore_job_encrypted",
    f"select doc_id, text as restored, (len({sql_phones('text')}) + len({sql_emails('text')}))::bigint as n_mappings from {MESSAGES_SQL} as m",
)
def restore_job_encrypted(spark, sf):
    redacted = stash(redact.redact_reversible(messages(spark, sf)))
    path = scratch_path(spark, "mapping")
    writers.write_mapping(redact.mapping_rows(redacted, "doc_id"), path, _key(spark))
    texts = redacted.select("doc_id", "redacted", F.size("mapping").cast("long").alias("n_mappings"))
    out = restore_job.restore_texts(texts, spark.read.parquet(path), "doc_id", key=_key(spark))
    return out.select("doc_id", "restored", "n_mappings")


@query(
    "restore_audit",
    """
    select action, type, encrypted, count(*) as n, sum(n_mappings)::bigint as n_mappings from (
      select 'REVERSE_START' as action, 'txt' as type, null as encrypted, null as n_mappings from customer
      union all select 'MAPPING_LOADED', null, 'true', c_nationkey from customer
      union all select 'REVERSE_COMPLETE', null, null, c_nationkey from customer) as x group by all
    """,
)
def restore_audit(spark, sf):
    done = table(spark, sf, "customer").withColumns({"name": F.concat("c_name", F.lit(".txt")), "type": F.lit("txt")})
    rows = restore_job.restore_audit(
        done, F.col("c_custkey").cast("string"), F.timestamp_seconds(F.col("c_custkey")), "name", "type", F.col("c_nationkey"), True
    )
    detail = lambda k: F.try_element_at("details", F.lit(k))
    count = F.coalesce(detail("mappings"), detail("mappings_applied")).try_cast("bigint")
    return rows.groupBy("action", detail("type").alias("type"), detail("encrypted").alias("encrypted")).agg(
        F.count("*").alias("n"), F.sum(count).alias("n_mappings")
    )


@query(
    "restore_mostly_unknown",
    """
    select o_orderkey as doc_id, case when o_custkey % 10 = 0 then concat('order van klant ', o_custkey, ', status ', o_orderstatus)
      else concat('order van [KLANT_', o_custkey, '], status ', o_orderstatus) end as restored from orders
    """,
)
def restore_mostly_unknown(spark, sf):
    """Nine of ten tokens are in no mapping: their texts meet a filter of the known ones and no join."""
    orders = table(spark, sf, "orders")
    token = F.concat(F.lit("[KLANT_"), F.col("o_custkey"), F.lit("]"))
    texts = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order van "), token, F.lit(", status "), F.col("o_orderstatus")).alias("redacted"))
    mapping = orders.where("o_custkey % 10 = 0").select(
        F.lit("corpus").alias("scope_id"), F.lit("klant").alias("kind"), token.alias("placeholder"), F.concat(F.lit("klant "), F.col("o_custkey")).alias("original")
    ).distinct()
    return restore.restore_corpus(texts, mapping, "doc_id", skip_unknown=True).select("doc_id", "restored")
