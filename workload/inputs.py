"""Inputs of the queries, derived from the supplied tables by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import catalogue as cat

# Type names that differ between the engines.
SPARK = {"{T}": "string", "{N}": "decimal(38,0)"}
DUCK = {"{T}": "varchar", "{N}": "hugeint"}


def dialect(sql: str, names: dict[str, str]) -> str:
    for token, name in names.items():
        sql = sql.replace(token, name)
    return sql


# Rows of a task whose work per row is heavy.
TASK_ROWS = 100_000


def spread(df: DataFrame, most: int = 64) -> DataFrame:
    """Rows of a table in enough tasks, for work that is heavy per row.

    There are as many tasks as cores, up to ``most``, and as ``TASK_ROWS`` asks for: a split
    of a narrow table holds millions of rows.  A table with as many splits is left alone.
    """
    tasks = max(min(df.sparkSession.sparkContext.defaultParallelism, most), -(-df.count() // TASK_ROWS))
    if df.rdd.getNumPartitions() >= tasks:
        return df
    # The number keeps filters, and the heavy work in them, behind the exchange.
    return df.repartition(tasks).where(F.monotonically_increasing_id() >= 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are heavy to work on."""
    return spread(table(spark, sf_dir, name))


def from_sql(spark: SparkSession, sf_dir: str, sql: str, source: str, read=table) -> DataFrame:
    """Run shared SQL over one supplied table in Spark."""
    text = dialect(sql, SPARK).replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace(f"from {source}", "from {source}"), source=read(spark, sf_dir, source))


# --- customer notes: one phone, e-mail, number, IBAN and postal code each -----
NOTES = """
select c_custkey as doc_id,
  concat(c_name, case when c_custkey % 2 = 0 then '. Telefoon: ' else '. Nr ' end, phone,
    ', e-mail klant', cast(c_custkey as {T}), '@', seg, '.example.nl, ',
    case when c_custkey % 5 = 0 then 'BSN ' else 'ref ' end, bsn,
    ', IBAN ', iban, ', ', postal, ' Amsterdam') as text
from (
  select c_custkey, c_name, lower(c_mktsegment) as seg,
    case c_custkey % 6
      when 0 then concat('06-', lpad(cast(c_custkey as {T}), 8, '0'))
      when 1 then concat('06', lpad(cast(c_custkey as {T}), 8, '0'))
      when 2 then concat('+316', lpad(cast(c_custkey as {T}), 8, '0'))
      when 3 then concat('0031 6 ', lpad(cast(c_custkey as {T}), 8, '0'))
      when 4 then concat('(06) ', lpad(cast(c_custkey as {T}), 8, '0'))
      else concat('020-', substr(lpad(cast(c_custkey as {T}), 8, '0'), 2, 7)) end as phone,
    lpad(cast((c_custkey * 7919 + 100000007) % 1000000000 as {T}), 9, '0') as bsn,
    concat('NL',
      case when c_custkey % 3 = 0 then '00' else lpad(cast(cast(98 -
        cast(concat('10112310', lpad(cast(c_custkey as {T}), 10, '0'), '232100') as {N}) % 97
        as int) as {T}), 2, '0') end,
      'ABNA', lpad(cast(c_custkey as {T}), 10, '0')) as iban,
    concat(cast(1000 + c_custkey % 9000 as {T}), ' ',
      case c_custkey % 4 when 0 then 'AB' when 1 then 'SA' when 2 then 'JS' else 'LM' end) as postal
  from customer) as b
"""

# --- order messages: every phone form, shared contacts, several values each ---
MESSAGES = """
select o_orderkey as doc_id, o_custkey as cust_id, o_orderpriority as priority,
  concat('Bel ', form, ' of mail klant', cast(o_custkey as {T}), '@shop.example.nl; kantoor 020-',
    lpad(cast(o_custkey % 100 as {T}), 7, '0'), ', status ', o_orderstatus, ', prioriteit ', o_orderpriority) as text
from (
  select *,
    case o_custkey % 13
      when 0 then concat('+31 6 ', a, ' ', b, ' ', c, ' ', d)
      when 1 then concat('00 31 6 ', a, ' ', b, ' ', c, ' ', d)
      when 2 then concat('+31 6', k)
      when 3 then concat('0031 6 ', k)
      when 4 then concat('(06) ', k)
      when 5 then concat('06 – ', a, ' ', b, ' ', c, ' ', d)
      when 6 then concat('06.', a, '-', b, ' ', c, '.', d)
      when 7 then concat('06 - ', k)
      when 8 then concat('06.', a, '.', b, '.', c, '.', d)
      when 9 then concat('06  ', k)
      when 10 then concat('+31 20 ', substr(k, 2, 7))
      when 11 then concat('020-', substr(k, 2, 7))
      else concat('06', k) end as form
  from (
    select *, substr(k, 1, 2) as a, substr(k, 3, 2) as b, substr(k, 5, 2) as c, substr(k, 7, 2) as d
    from (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, lpad(cast(o_custkey as {T}), 8, '0') as k
          from orders) as t1) as t2) as t3
"""

# --- identities: citizen numbers, IBANs of four countries, postal codes -------
IDENTITIES = """
select o_orderkey as id, bsn, postal, iban, compact,
  concat('BSN: ', bsn, '; rekening ', iban, '; adres ', postal) as text
from (
  select o_orderkey, compact,
    case o_orderkey % 3 when 0 then digits
      when 1 then concat(substr(digits, 1, 3), '-', substr(digits, 4, 2), '-', substr(digits, 6, 4))
      else concat(substr(digits, 1, 3), '.', substr(digits, 4, 2), '.', substr(digits, 6, 4)) end as bsn,
    concat(cast(1000 + o_orderkey % 9000 as {T}), case when o_orderkey % 2 = 0 then ' ' else '' end,
      case o_orderkey % 5 when 0 then 'AB' when 1 then 'SA' when 2 then 'JS' when 3 then 'SD' else 'LM' end) as postal,
    case when o_orderkey % 2 = 0 then compact
      else rtrim(concat_ws(' ', substr(compact, 1, 4), substr(compact, 5, 4), substr(compact, 9, 4), substr(compact, 13, 4),
                           substr(compact, 17, 4), substr(compact, 21, 4), substr(compact, 25, 4))) end as iban
  from (
    select o_orderkey, digits, concat(land, case when o_orderkey % 7 = 0 then '00' else
        lpad(cast(cast(98 - cast(concat(numeric_bban, land_digits, '00') as {N}) % 97 as int) as {T}), 2, '0') end, bban) as compact
    from (
      select o_orderkey, lpad(cast((o_orderkey * 7919 + 100000007) % 1000000000 as {T}), 9, '0') as digits,
        case o_orderkey % 4 when 0 then 'NL' when 1 then 'DE' when 2 then 'BE' else 'FR' end as land,
        case o_orderkey % 4 when 0 then '2321' when 1 then '1314' when 2 then '1114' else '1527' end as land_digits,
        case o_orderkey % 4 when 0 then concat('ABNA', lpad(cast(o_orderkey as {T}), 10, '0'))
          when 1 then concat('37040044', lpad(cast(o_orderkey as {T}), 10, '0'))
          when 2 then lpad(cast(o_orderkey as {T}), 12, '5')
          else concat('20041010050500M', lpad(cast(o_orderkey as {T}), 8, '0')) end as bban,
        case o_orderkey % 4 when 0 then concat('10112310', lpad(cast(o_orderkey as {T}), 10, '0'))
          when 1 then concat('37040044', lpad(cast(o_orderkey as {T}), 10, '0'))
          when 2 then lpad(cast(o_orderkey as {T}), 12, '5')
          else concat('2004101005050022', lpad(cast(o_orderkey as {T}), 8, '0')) end as numeric_bban
      from orders) as t1) as t2) as t3
"""

# --- metric events of jobs ----------------------------------------------------
JOBS = """
select event_id, cast(ts as timestamp) as ts,
  case event_type when 'signup' then 'xlsx' when 'view' then 'docx' when 'error' then 'pdf'
    when 'purchase' then 'txt' else 'csv' end as file_type,
  (event_id * 7919 % 31) * 524288 as size_bytes,
  value as duration_seconds, event_id % 500 as entities_found, event_id % 17 <> 0 as success,
  case when event_id % 17 = 0 then concat('fout ', cast(event_id % 7 as {T})) end as error,
  'process_file' as operation, (event_id % 1021) * 1048576 as memory_peak_bytes,
  (event_id % 511) * 1048576 as memory_current_bytes
from events
"""

# --- files of upload batches --------------------------------------------------
UPLOADS = """
select o_orderkey as file_id, o_custkey as batch_id,
  case o_orderkey % 11 when 0 then '' when 1 then 'rapport' when 2 then concat('foto', cast(o_orderkey as {T}), '.png')
    when 3 then concat('Verslag.v', cast(o_orderkey as {T}), '.DOCX') when 4 then concat('lijst ', cast(o_orderkey as {T}), '.xlsx')
    when 5 then concat('../map/data_', cast(o_orderkey as {T}), '.csv') when 6 then 'notitie.md'
    when 7 then 'scan.pdf' else concat('brief_', cast(o_orderkey as {T}), '.txt') end as name,
  case when o_orderkey % 13 = 0 then 0 else cast(floor(o_totalprice * 120) as bigint) end as length,
  o_orderdate as uploaded
from orders
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, NOTES, "customer", texts)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, MESSAGES, "orders", texts)


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, IDENTITIES, "orders", texts)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, JOBS, "events")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, UPLOADS, "orders")


NOTES_SQL = f"({dialect(NOTES, DUCK)})"
MESSAGES_SQL = f"({dialect(MESSAGES, DUCK)})"
IDENTITIES_SQL = f"({dialect(IDENTITIES, DUCK)})"
JOBS_SQL = f"({dialect(JOBS, DUCK)})"
UPLOADS_SQL = f"({dialect(UPLOADS, DUCK)})"


def in_duck(sql: str) -> str:
    return dialect(sql, DUCK)


# --- SQL building blocks ------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_cents(value: str) -> str:
    """Half-up to two decimals on the shortest decimal form of a double."""
    return f"cast(round(cast(cast({value} as varchar) as decimal(32, 16)), 2) as double)"


def sql_all(text: str, patterns: list[tuple[str, str]]) -> str:
    """All matches of a catalogue, as a list."""
    found = [f"regexp_extract_all({text}, {lit(regex)})" for _, regex in patterns]
    return f"flatten([{', '.join(found)}])"


def sql_phones(text: str) -> str:
    return f"list_sort(list_distinct({sql_all(text, cat.PHONE_PATTERNS)}))"


def sql_emails(text: str) -> str:
    return f"list_sort(list_distinct({sql_all(text, cat.EMAIL_PATTERNS)}))"


def sql_chain(text: str, patterns: list[tuple[str, str]], placeholder: str) -> str:
    for _, regex in patterns:
        text = f"regexp_replace({text}, {lit(regex)}, {lit(placeholder)}, 'g')"
    return text


def sql_redacted(text: str) -> str:
    return sql_chain(
        sql_chain(text, cat.PHONE_PATTERNS, cat.PHONE_PLACEHOLDER), cat.EMAIL_PATTERNS, cat.EMAIL_PLACEHOLDER
    )


def sql_valid_bsn(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    terms = " + ".join(f"{w} * cast(substr({d}, {i}, 1) as int)" for i, w in enumerate([9, 8, 7, 6, 5, 4, 3, 2], 1))
    same = ", ".join(lit(str(n) * 9) for n in range(10))
    return (
        f"(case when length({d}) = 9 and {d} not in ({same}) "
        f"then ({terms} - cast(substr({d}, 9, 1) as int)) % 11 = 0 else false end)"
    )


def sql_valid_iban(value: str) -> str:
    c = f"upper(regexp_replace({value}, '\\s', '', 'g'))"
    lengths = " or ".join(f"({c} like '{k}%' and length({c}) = {n})" for k, n in cat.IBAN_LENGTHS.items())
    digits = (
        f"list_transform(string_split(substr({c}, 5) || substr({c}, 1, 4), ''), "
        "lambda ch: case when ascii(ch) < 58 then ascii(ch) - 48 else ascii(ch) - 55 end)"
    )
    mod = f"list_reduce(list_prepend(0, {digits}), lambda a, x: case when x > 9 then (a * 100 + x) % 97 else (a * 10 + x) % 97 end)"
    return f"(({lengths}) and {mod} = 1)"


def sql_valid_postal(value: str) -> str:
    c = f"upper(regexp_replace({value}, '\\s', '', 'g'))"
    return f"(regexp_full_match({c}, '\\d{{4}}[A-Z]{{2}}') and substr({c}, 5) not in ('SA', 'SD', 'SS'))"


def sql_findings(source: str, key: str = "doc_id") -> str:
    """Query giving ``(key, text, pattern, match, base)`` of all five detectors, before context words."""
    parts = []
    for pattern, values, valid, base in (
        ("phone_nl", sql_phones("text"), None, cat.PHONE_CONFIDENCE),
        ("email", sql_emails("text"), None, cat.EMAIL_CONFIDENCE),
        ("bsn", sql_all("text", cat.BSN_PATTERNS), sql_valid_bsn, cat.BSN_CONFIDENCE),
        ("iban", sql_all("text", cat.IBAN_PATTERNS), sql_valid_iban, cat.IBAN_CONFIDENCE),
        ("postal_code_nl", sql_all("text", cat.POSTAL_PATTERNS), sql_valid_postal, cat.POSTAL_CONFIDENCE),
    ):
        keep = f" where {valid('match')}" if valid else ""
        parts.append(
            f"select {key}, text, '{pattern}' as pattern, match, cast({base} as double) as base from "
            f"(select {key}, text, unnest({values}) as match from {source}) as x{keep}"
        )
    return "\nunion all\n".join(parts)


def sql_scored(source: str, key: str = "doc_id") -> str:
    """Findings with context hits and final confidence."""
    hits, boosts = [], []
    for name, entry in cat.REGISTRY.items():
        total = " + ".join(f"cast(contains(snippet, {lit(w)}) as int)" for w in entry["context_words"])
        hits.append(f"when '{name}' then {total}")
        boosts.append(f"when '{name}' then {entry['confidence_boost']}")
    return f"""
select {key}, pattern, match, hits,
  case when hits > 0 then least(cast(1.0 as double), base + cast(case pattern {' '.join(boosts)} end as double)) else base end as confidence
from (
  select *, case pattern {' '.join(hits)} end as hits
  from (
    select *, lower(substr(text, greatest(1, strpos(text, match) - 50),
        least(length(text), strpos(text, match) - 1 + 50) - greatest(0, strpos(text, match) - 1 - 50))) as snippet
    from ({sql_findings(source, key)}) as f0) as f1) as f2
"""
