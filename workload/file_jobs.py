"""Whole jobs over a table of files, and back."""

from pyspark.sql import functions as F

from cloakframe.operators.mapping import encrypt_mapping
from cloakframe.operators.numbering import stash
from cloakframe.plans import file_job

from .files import _as_docx, _xlsx_corpus
from .inputs import DUCK, dialect, from_sql, sql_cents, sql_emails, sql_phones, texts
from .registry import query


def _files(spark, sf):
    """Turns as texts and Word documents, customers as workbooks; damaged and foreign files come on top."""
    talks = texts(spark, sf, "conversations").where("text is not null").withColumn("text", F.regexp_replace("text", r"[\r\p{Cntrl}&&[^\n]]", ""))
    name = F.concat("conv_id", F.lit("-"), "turn")
    kind = lambda rows, ext, content: rows.select(F.concat(name, F.lit(ext)).alias("path"), content.alias("content"))
    some = talks.where("conv_id % 10 = 9")
    return (
        kind(talks.where("turn % 2 = 0"), ".txt", F.col("text").cast("binary"))
        .union(kind(talks.where("turn % 2 = 1"), ".docx", _as_docx(F.col("text"), F.concat(name, F.lit(".docx")))))
        .union(kind(some, "-kapot.docx", F.lit("geen zip").cast("binary")))
        .union(kind(some, ".pdf", F.lit("%PDF").cast("binary")))
        .union(_xlsx_corpus(spark, sf))
        .union(_csv_corpus(spark, sf))
    )


# What the CSV files hold: 100 customers each, quoted cells with commas, quotes and line breaks.
LISTS = """
select concat('lijst', cast(c_custkey div 100 as {T}), '.csv') as path, c_custkey, c_name as naam, c_mktsegment as segment, concat('2024-0', cast(1 + c_custkey % 9 as {T}), '-1', cast(c_custkey % 10 as {T})) as datum,
  cast(c_acctbal as {T}) as saldo, concat('zie "', cast(c_custkey as {T}), '", bel 06-', lpad(cast(c_custkey as {T}), 8, '0'), chr(10), 'klaar') as notitie
from customer
"""
LISTS_SQL = f"({dialect(LISTS, DUCK).replace(' div ', ' // ')})"
LIST_COLUMNS = ["naam", "segment", "datum", "saldo", "notitie"]


def _csv_corpus(spark, sf):
    rows = from_sql(spark, sf, LISTS, "customer")
    note = F.concat(F.lit('"'), F.replace("notitie", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "naam", "segment", "datum", "saldo", note)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"])
    content = F.concat(F.lit(",".join(LIST_COLUMNS) + "\r\n"), F.array_join(lines, "\r\n"), F.lit("\r\n")).cast("binary")
    return rows.groupBy("path").agg(content.alias("content"))


def _rows(cells, value):
    """Data cells of CSV files, a row each."""
    cells = cells.where("part = 'csv' and header is not null").withColumn("row_idx", F.split("place", "/")[0].cast("int"))
    return cells.groupBy("path", "row_idx").agg(*[F.max(F.when(F.col("header") == c, F.col(value))).alias(c) for c in LIST_COLUMNS])


CLEAN = "regexp_replace(text, '[\\x00-\\x09\\x0B-\\x1F\\x7F]', '', 'g')"
TURNS = f"(select conv_id, turn, {CLEAN} as text from conversations where text is not null)"


@query(
    "file_job",
    f"""
    with turns as {TURNS}
    select 'txt' as file_type, 'anonymized' as status, null as error, count(*) as n_files, sum(len({sql_phones('text')}) + len({sql_emails('text')}))::bigint as n_items
      from turns where turn % 2 = 0
    union all select 'docx', 'anonymized', null, count(*), null from turns where turn % 2 = 1
    union all select 'docx', 'error', 'Word document is corrupt (geen valide ZIP)', count(*), null from turns where conv_id % 10 = 9 having count(*) > 0
    union all select 'pdf', 'error', 'Niet ondersteund bestandstype: pdf', count(*), null from turns where conv_id % 10 = 9 having count(*) > 0
    union all select 'xlsx', 'anonymized', null, 2 * count(distinct c_custkey // 100), null from customer
    """,
)
def file_job_results(spark, sf):
    job = file_job.process_files(_files(spark, sf))
    n_items = F.sum(F.when(F.col("file_type") == "txt", F.col("n_items"))).alias("n_items")
    return job.results.groupBy("file_type", "status", "error").agg(F.count("*").alias("n_files"), n_items)


@query(
    "file_job_cells",
    "select concat('boek', c_custkey // 100, '.xlsx') as path, count(*) as n_cells, 0::bigint as n_names from customer group by 1",
)
def file_job_cells(spark, sf):
    """The names of all workbooks are masked by their header."""
    job = file_job.process_files(_files(spark, sf), column_rules=[{"id": "n", "columnName": "naam", "replaceWith": "[NAAM]"}])
    cells = job.pieces.where("part = 'klanten'")
    return cells.groupBy("path").agg(
        F.count_if(F.col("redacted") == "[NAAM]").alias("n_cells"), F.count_if(F.col("redacted").startswith("Customer")).alias("n_names")
    )


CSV_RULES = [
    {"id": "n", "columnName": "naam", "reversible": True},
    {"id": "s", "columnName": "segment", "replaceWith": "[SEGMENT]"},
    {"id": "d", "columnName": "datum", "columnType": "date", "anonymizationType": "date_offset", "dateOffsetDays": 30},
    {"id": "b", "columnName": "saldo", "columnType": "number", "anonymizationType": "number_multiply", "numberMultiplier": 2},
]


@query(
    "file_job_csv",
    f"""
    select path, cast(row_number() over (partition by path order by c_custkey) + 1 as int) as row_idx, printf('[NAAM-%03d]', row_number() over (order by path, c_custkey)) as naam,
      '[SEGMENT]' as segment, cast(cast(datum as date) + interval 30 day as date)::varchar as datum, cast({sql_cents('2 * cast(saldo as double)')} as varchar) as saldo,
      replace(notitie, concat('06-', lpad(cast(c_custkey as varchar), 8, '0')), '[TEL VERWIJDERD]') as notitie
    from {LISTS_SQL} as l
    """,
)
def file_job_csv(spark, sf):
    """Ruled cells by their rules, the others as texts."""
    job = file_job.process_files(_csv_corpus(spark, sf), column_rules=CSV_RULES)
    return _rows(job.pieces, "redacted")


ALL_RULES = [
    {"id": "n", "columnName": "naam", "replaceWith": "Klant ", "preserveUniqueness": True},
    {"id": "s", "columnName": "segment", "anonymizationType": "jabber", "preserveUniqueness": True},
    {"id": "d", "columnName": "datum", "anonymizationType": "shuffle"},
    {"id": "b", "columnName": "saldo", "columnType": "number", "anonymizationType": "number_multiply", "priceStrategy": "random_range", "randomRangePercent": 10},
    {"id": "t", "columnName": "notitie", "anonymizationType": "jabber"},
    {"id": "x", "columnName": "onbekend"},
    {"id": "y", "columnName": "notitie", "columnType": "date", "anonymizationType": "date_offset"},
]


@query(
    "file_job_all_rules",
    f"""
    with n as (select count(*) as n, count(distinct c_name) as names, count(distinct c_mktsegment) as segments, count(distinct c_custkey // 100) as books from customer)
    select 'namen' as seen, 2 * n as n_cells, names as n_values from n
    union all select 'segmenten', n, segments from n
    union all select 'datums', (select sum(k) from (select count(*) as k from {LISTS_SQL} as l group by path, datum) as x)::bigint, 0 from n
    union all select 'saldi', 2 * n, 0 from n
    union all select 'notities', n, 0 from n
    union all select 'geweigerd', books + 1, 2 from n
    """,
)
def file_job_all_rules(spark, sf):
    """All rule kinds over workbooks and CSV files: how many cells came out as their rule says."""
    job = file_job.process_files(_csv_corpus(spark, sf).union(_xlsx_corpus(spark, sf)), column_rules=ALL_RULES, salt="zout")
    pieces = stash(job.pieces.where("header is not null"))
    of = lambda header: pieces.where(F.col("header") == header)
    seen = lambda rows, name, values: rows.agg(F.lit(name).alias("seen"), F.count("*").alias("n_cells"), values.alias("n_values"))
    changed = F.col("redacted") != F.col("text")
    numbers = F.abs(F.col("redacted").cast("double") - F.col("text").cast("double")) <= F.abs(F.col("text").cast("double")) * 0.1 + 0.006
    dates = of("datum").groupBy("path", "redacted").agg(F.count("*").alias("k")).join(
        of("datum").groupBy("path", F.col("text").alias("redacted")).agg(F.count("*").alias("k")), ["path", "redacted", "k"]
    )
    none = F.lit(0).cast("long")
    return (
        seen(of("naam").where(r"redacted rlike '^Klant [0-9]+$'"), "namen", F.count_distinct("redacted"))
        .union(seen(of("segment").where(changed & (F.length("redacted") == 8)), "segmenten", F.count_distinct("redacted")))
        .union(dates.agg(F.lit("datums"), F.sum("k"), none))
        .union(seen(of("saldo").where(numbers), "saldi", none))
        .union(seen(of("notitie").where(changed & (F.length("redacted") == 8)), "notities", none))
        .union(job.rejected.agg(F.lit("geweigerd"), F.count("*"), F.count_distinct("ruleId")))
    )


@query(
    "restore_file_job",
    f"""
    with turns as {TURNS},
      klanten as (select concat('boek', c_custkey // 100, '.xlsx') as path, c_custkey, concat_ws('|', c_custkey, c_name, cast(c_acctbal as varchar)) as line from customer)
    select concat(conv_id, '-', turn, '.txt') as path, 'body' as part, text as restored from turns where turn % 2 = 0
    union all select concat(conv_id, '-', turn, '.docx'), 'body', replace(text, chr(10), '') from turns where turn % 2 = 1
    union all select concat(conv_id, '-', turn, '.docx'), 'footer1', concat(conv_id, '-', turn, '.docx') from turns where turn % 2 = 1
    union all select path, 'klanten', concat('nr|naam|saldo|', string_agg(line, '|' order by c_custkey)) from klanten group by path
    union all select concat('boek', b, '.xlsx'), 'som', concat('totaal|', case when b % 2 = 1 then '=SUM(A1:A9)' else '0' end) from (select distinct c_custkey // 100 as b from customer) as x
    union all select path, 'csv', concat('{'|'.join(['naam', 'segment', 'datum', 'saldo', 'notitie'])}|', string_agg(concat_ws('|', naam, segment, datum, saldo, notitie), '|' order by c_custkey)) from {LISTS_SQL} as l group by path
    """,
)
def restore_file_job(spark, sf):
    """Texts, Word files, workbooks and CSV files there and back, every part and cell of them."""
    job = file_job.process_files(_files(spark, sf), column_rules=[*CSV_RULES, {"id": "t", "columnName": "notitie", "anonymizationType": "jabber"}], reversible=True)
    back = file_job.restore_files(stash(job.pieces), stash(job.mapping))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "restored"))), lambda p: p["restored"])
    cells = F.col("path").rlike("(xlsx|csv)$")
    return back.groupBy("path", "part").agg(ordered.alias("r")).select(
        "path", "part", F.when(cells, F.array_join("r", "|")).otherwise(F.array_join("r", "")).alias("restored")
    )


@query(
    "restore_file_set_audit",
    f"""
    with files as (select concat(conv_id, '-', turn, case when turn % 2 = 0 then '.txt' else '.docx' end) as name, case when turn % 2 = 0 then 'txt' else 'docx' end as kind from {TURNS} as t
      union all select distinct concat('boek', c_custkey // 100, '.xlsx'), 'xlsx' from customer union all select distinct path, 'xlsx' from {LISTS_SQL} as l)
    select 'REVERSE_START' as action, name as file, kind as type, null as encrypted from files
    union all select 'REVERSE_COMPLETE', concat('deanon_', name), null, null from files
    union all select 'MAPPING_LOADED', null, null, 'true' from files
    """,
)
def restore_file_set_audit(spark, sf):
    """One job with dispatch, key and audit: an encrypted mapping of texts and masked cells."""
    job = file_job.process_files(_files(spark, sf), column_rules=CSV_RULES, reversible=True)
    sealed = encrypt_mapping(stash(job.mapping), "0123456789abcdef")
    done = file_job.restore_file_set(stash(job.pieces), sealed, F.lit("s1"), F.lit("2024-01-02 03:04:05").cast("timestamp"), key="0123456789abcdef")
    detail = lambda k: F.try_element_at("details", F.lit(k)).alias(k)
    return done.audit.select("action", detail("file"), detail("type"), detail("encrypted"))
