"""Sources, sinks and admission of files."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import text as text_functions
from cloakframe.functions import catalogue as cat
from cloakframe.operators import admission, detect, rules
from cloakframe.operators.numbering import scratch_path
from cloakframe.plans import text_job
from cloakframe.sinks import writers
from cloakframe.sinks.retention import purge, remove_session
from cloakframe.sinks.versions import VersionedTable
from cloakframe.sources import config, files, logs, office

from .inputs import JOBS_SQL, MESSAGES_SQL, NOTES_SQL, UPLOADS_SQL, from_sql, jobs, messages, notes, sql_emails, sql_redacted, table, texts, uploads
from .registry import query

# --- texts and tables on disk -----------------------------------------------------


@query(
    "text_files_round_trip",
    f"select count(*) as n_lines, sum(length(t))::bigint as n_chars, sum(length(t) - length(replace(t, '[TEL', 'TEL')))::bigint as n_phones from (select {sql_redacted('text')} as t from {NOTES_SQL} as n) as x",
)
def text_files_round_trip(spark, sf):
    path = scratch_path(spark, "texts")
    notes(spark, sf).select("text").write.text(path)
    redacted = text_job.redact_texts(files.read_texts(spark, path))
    lines = F.filter(F.split("redacted", "\n", -1), lambda line: line != "")
    return text_functions.each_value(redacted, lines, "t").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("t")).alias("n_chars"),
        F.sum(F.length("t") - F.length(F.replace("t", F.lit("[TEL"), F.lit("TEL")))).alias("n_phones"),
    )


@query("redacted_texts_written", f"select doc_id, {sql_redacted('text')} as redacted from {NOTES_SQL} as n")
def redacted_texts_written(spark, sf):
    path = scratch_path(spark, "redacted")
    writers.write_texts(text_job.redact_texts(notes(spark, sf)).select("doc_id", "redacted"), path)
    return spark.read.parquet(path)


TRICKY = """
select c_custkey, concat(' ', c_name, case c_custkey % 4 when 0 then ', "groot"' when 1 then chr(10) when 2 then ' é; ' else ' Ωβ' end, 'x') as naam, c_mktsegment from customer
"""


@query("csv_round_trip", f"select cast(c_custkey as varchar) as c_custkey, naam, c_mktsegment from ({TRICKY}) as t")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    rows = from_sql(spark, sf, TRICKY, "customer")
    writers.write_table_csv(rows, path)
    return files.read_table_csv(spark, path)


@query("csv_byte_order_mark", "select true as every_file_marked, sum(1)::bigint as n_rows from customer")
def csv_byte_order_mark(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_table_csv(table(spark, sf, "customer"), path)
    parts = files.read_binary(spark, path, "*.csv")
    marked = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 2
    return parts.agg(F.min(marked).alias("every_file_marked"), F.sum(lines).cast("long").alias("n_rows"))


@query("file_catalogue", "select c_nationkey as nation, 'parquet' as extension, true as has_size from customer group by 1")
def file_catalogue(spark, sf):
    path = scratch_path(spark, "catalogue")
    table(spark, sf, "customer").write.partitionBy("c_nationkey").parquet(path)
    found = files.file_catalogue(spark, path, "*.parquet")
    nation = F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("nation")
    return found.groupBy(nation, "extension").agg((F.min("length") > 0).alias("has_size"))


@query(
    "original_names",
    "select o_orderkey as file_id, case when o_custkey % 4 <> 0 then c_name else 'Unknown' end as original_name from orders left join customer on o_custkey = c_custkey",
)
def original_names(spark, sf):
    owners = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), "o_custkey")
    names = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("original_name"))
    return files.with_original_name(owners, names, "o_custkey").select("file_id", "original_name")


@query(
    "output_names",
    f"""
    select file_id, concat(file_id, '_', regexp_replace(name, '\\.[^.]*$', ''), '_ann_', strftime(uploaded + interval (file_id % 1440) minute, '%H%M'),
        case when contains(name, '.') then concat('.', regexp_extract(name, '[^.]*$')) else '' end) as output,
      concat(regexp_replace(name, '\\.[^.]*$', ''), '_ann_', strftime(uploaded + interval (file_id % 1440) minute, '%H%M'),
        case when contains(name, '.') then concat('.', regexp_extract(name, '[^.]*$')) else '' end) as shown
    from {UPLOADS_SQL} as u
    """,
)
def output_names(spark, sf):
    stamped = uploads(spark, sf).withColumn("ts", F.timestamp_add("MINUTE", F.col("file_id") % 1440, F.col("uploaded")))
    named = stamped.withColumn("output", writers.output_name(F.col("file_id").cast("string"), F.col("name"), F.col("ts")))
    return named.select("file_id", "output", writers.display_name(F.col("output")).alias("shown"))


# --- rules, registries, logs --------------------------------------------------------


@query(
    "text_rules_loaded",
    """
    select c_custkey as rule_order, cast(c_custkey as varchar) as id, c_name as "originalTerm", case when c_custkey % 2 = 0 then c_mktsegment else '' end as "replacementTerm",
      c_custkey % 3 = 0 as "isRegex", false as "caseSensitive", false as "removeInsteadOfReplace" from customer
    """,
)
def text_rules_loaded(spark, sf):
    fields = F.struct(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("originalTerm"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("replacementTerm"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(True)).alias("isRegex"),
    )
    return config.text_rules(table(spark, sf, "customer").select("c_custkey", F.to_json(fields).alias("value")), order_col="c_custkey")


@query(
    "column_rules_loaded",
    """
    select p_partkey as rule_order, '' as id, p_name as "columnName", 'number' as "columnType", cast(null as varchar) as "columnSubtype", 'number_multiply' as "anonymizationType",
      '[ANONIEM]' as "replaceWith", 0 as "dateOffsetDays", p_retailprice as "numberMultiplier", false as "preserveUniqueness", false as "reversible",
      'fixed_multiplier' as "priceStrategy", 10.0::double as "randomRangePercent" from part
    """,
)
def column_rules_loaded(spark, sf):
    fields = F.struct(
        F.col("p_name").alias("columnName"), F.lit("number").alias("columnType"),
        F.lit("number_multiply").alias("anonymizationType"), F.col("p_retailprice").alias("numberMultiplier"),
    )
    return config.column_rules(table(spark, sf, "part").select("p_partkey", F.to_json(fields).alias("value")), order_col="p_partkey")


@query("registry_loaded", f"select 'email' as pattern, sum(len({sql_emails('text')}))::bigint as n_findings from {NOTES_SQL} as n")
def registry_loaded(spark, sf):
    """A registry written and read back as JSON, with one entry switched off, drives the detectors."""
    path = scratch_path(spark, "registry")
    entries = {n: {**e, "enabled": n == "email"} for n, e in cat.REGISTRY.items() if n != "iban"}
    stored = config.registry_table(spark, entries)
    entry = F.struct("enabled", "description", "context_words", "confidence_boost", "detector_function")
    whole = stored.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("pattern", entry))).alias("patterns"))
    whole.select(F.lit("1.0").alias("version"), "patterns").coalesce(1).write.json(path)
    registry = config.as_registry(config.read_registry(spark, path))
    found = detect.explode_findings(detect.with_findings(notes(spark, sf), registry=registry), "doc_id")
    return found.groupBy("pattern").agg(F.count("*").alias("n_findings"))


_BRACKET = "case when size_bytes < 1048576 then '<1MB' when size_bytes < 10485760 then '1-10MB' else '>10MB' end"


@query(
    "metric_log_round_trip",
    f"""
    select file_type, {_BRACKET} as size_bracket, message, count(*) as n, round(sum(round(duration_seconds, 2)), 2) as seconds, round(sum(round(size_bytes / 1048576.0::double, 2)), 2) as megabytes
    from (select *, case when success then 'processing_complete' else 'processing_error' end as message from {JOBS_SQL} as j) as x group by all
    """,
)
def metric_log_round_trip(spark, sf):
    path = scratch_path(spark, "metrics")
    writers.append_metrics(writers.metric_events(jobs(spark, sf)), path)
    writers.append_metrics(writers.memory_events(jobs(spark, sf)), path)
    return logs.read_metrics(spark, path).groupBy("file_type", "size_bracket", "message").agg(
        F.count("*").alias("n"), F.round(F.sum("duration_seconds"), 2).alias("seconds"), F.round(F.sum("file_size_mb"), 2).alias("megabytes")
    )


@query(
    "audit_round_trip",
    f"""
    select session_id, action, file, type, rules_applied, error, day from (
      select file_id % 50 as session_id, 'ANONYMIZE_START' as action, name as file, 'text' as type, null as rules_applied, null as error, strftime(uploaded, '%Y-%m-%d') as day from {UPLOADS_SQL} as u
      union all
      select file_id % 50, 'ANONYMIZE_COMPLETE', name, null, cast(file_id % 9 as varchar), null, strftime(uploaded, '%Y-%m-%d') from {UPLOADS_SQL} as u where file_id % 5 <> 0
      union all
      select file_id % 50, 'ANONYMIZE_ERROR', name, null, null, 'fout = ' || name, strftime(uploaded, '%Y-%m-%d') from {UPLOADS_SQL} as u where file_id % 5 = 0) as x
    """,
)
def audit_round_trip(spark, sf):
    done = uploads(spark, sf)
    session, ts, name = (F.col("file_id") % 50).cast("string"), F.col("uploaded"), F.col("name")
    events = (
        writers.audit_events(done, "ANONYMIZE_START", session, ts, file=name, type=F.lit("text"))
        .unionByName(writers.audit_events(done.where("file_id % 5 <> 0"), "ANONYMIZE_COMPLETE", session, ts, file=name, rules_applied=F.col("file_id") % 9))
        .unionByName(writers.audit_events(done.where("file_id % 5 = 0"), "ANONYMIZE_ERROR", session, ts, file=name, error=F.concat(F.lit("fout = "), name)))
    )
    path = scratch_path(spark, "audit")
    events.select(writers.audit_line(["file", "type", "rules_applied", "error"]).alias("value")).write.text(path)
    parsed = logs.read_audit(spark, path)
    detail = lambda k: F.try_element_at("details", F.lit(k)).alias(k)
    return parsed.select(
        F.col("session_id").cast("bigint"), "action", detail("file"), detail("type"), detail("rules_applied"), detail("error"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query(
    "audit_table",
    f"select strftime(ts, '%Y-%m-%d') as dt, count(*) as n, sum(entities_found)::bigint as n_mappings from {JOBS_SQL} as j group by 1",
)
def audit_table(spark, sf):
    path = scratch_path(spark, "audit")
    done = jobs(spark, sf)
    writers.append_audit(
        writers.audit_events(done, "MAPPING_SAVED", F.col("file_type"), F.col("ts"), mappings=F.col("entities_found")), path
    )
    return spark.read.parquet(path).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(
        F.count("*").alias("n"), F.sum(F.try_element_at("details", F.lit("mappings")).cast("bigint")).alias("n_mappings")
    )


@query(
    "rule_log_written",
    f"select 'm1' as \"ruleId\", count(*) as n_entries, sum(len(regexp_extract_all(text, '(?i)status')))::bigint as n from {MESSAGES_SQL} as m",
)
def rule_log_written(spark, sf):
    path = scratch_path(spark, "rulelog")
    applied = rules.apply_rules(messages(spark, sf), [{"id": "m1", "originalTerm": "status", "replacementTerm": "[S]"}])
    writers.write_rule_log(rules.explode_log(applied, "doc_id"), path)
    return spark.read.parquet(path).groupBy("ruleId").agg(F.count("*").alias("n_entries"), F.sum("count").alias("n"))


# --- admission ------------------------------------------------------------------------

EXT = "case when contains(name, '.') then lower(regexp_extract(name, '[^.]*$')) end"
REASON = f"""case when name = '' then 'Geen bestand gevonden' when {EXT} is null then 'Bestand heeft geen extensie'
  when {EXT} not in ('txt', 'docx', 'xlsx', 'csv', 'pdf', 'md') then concat('Bestandstype .', {EXT}, ' niet toegestaan')
  when length > 52428800 then concat('Bestand te groot (', printf('%.1f', length / 1048576.0::double), 'MB). Maximum toegestaan is 50MB. Split bestand of neem contact op.')
  when length = 0 then 'Bestand is leeg' end"""
WARNING = """case when length > 5242880 then concat('Groot bestand (', printf('%.1f', length / 1048576.0::double), 'MB) - verwerking kan ',
  case when length < 20971520 then '10-30 seconden' else '30-60 seconden' end, ' duren') end"""


@query(
    "admit_files",
    f"""
    select file_id, {EXT} as extension, case {EXT} when 'txt' then 'txt' when 'md' then 'txt' when 'docx' then 'docx' when 'xlsx' then 'xlsx' when 'csv' then 'xlsx' when 'pdf' then 'pdf' else 'unknown' end as file_type,
      {REASON} as error, coalesce({WARNING}, '') as warnings, {REASON} is null as accepted from {UPLOADS_SQL} as u
    """,
)
def admit_files(spark, sf):
    admitted = admission.with_admission(uploads(spark, sf))
    return admitted.select("file_id", "extension", "file_type", "error", F.array_join("warnings", "|").alias("warnings"), "accepted")


@query(
    "admission_batches",
    f"""
    select batch_id, count(*) filter (ok) as n_accepted, count(*) filter (not ok) as n_rejected, count(*) filter (ok) > 0 and count(*) filter (not ok) > 0 as partial_success
    from (select batch_id, {REASON} is null as ok from {UPLOADS_SQL} as u) as x group by batch_id
    """,
)
def admission_batches(spark, sf):
    return admission.admission_summary(admission.with_admission(uploads(spark, sf)), "batch_id")


@query(
    "sanitized_names",
    f"""
    select file_id, case when strlen(safe) - strlen(replace(safe, '.', '')) > 1 then concat(replace(regexp_replace(safe, '\\.[^.]*$', ''), '.', '_'), '.', regexp_extract(safe, '[^.]*$')) else safe end as safe
    from (select file_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(replace(n, '/', ' ')), '\\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+', ''), '[._]+$', '') as safe
          from (select file_id, concat(name, case when file_id % 3 = 0 then ' ea.txt' else '' end) as n from {UPLOADS_SQL} as u) as a) as b
    """,
)
def sanitized_names(spark, sf):
    accented = F.concat("name", F.when(F.col("file_id") % 3 == 0, F.lit(" éa.txt")).otherwise(F.lit("")))
    return uploads(spark, sf).select("file_id", admission.sanitize_filename(accented).alias("safe"))


@query(
    "encoding_check",
    """
    select doc_id, doc_id % 4 <> 0 or regexp_full_match(latin, '[\\x00-\\x7F]*') as is_utf8,
      case when doc_id % 4 = 0 then length(latin) else length(text) + 4 end as n_chars
    from (select doc_id, text, regexp_replace(text, '[^\\x{0000}-\\x{00FF}]', '', 'g') as latin from documents) as d
    """,
)
def encoding_check(spark, sf):
    """Every fourth document in Latin-1, the others in UTF-8 with characters far beyond it."""
    latin = F.encode(F.regexp_replace("text", r"[^\x{0000}-\x{00FF}]", ""), "ISO-8859-1")
    utf8 = F.encode(F.concat("text", F.lit(" €漢😀")), "UTF-8")
    docs = texts(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, latin).otherwise(utf8).alias("content"))
    return docs.select(
        "doc_id", admission.is_utf8(F.col("content")).alias("is_utf8"),
        F.length(admission.decode_text(F.col("content"))).cast("long").alias("n_chars"),
    )


@query(
    "audit_unparsed",
    f"select line, count(*) as n from (select unnest(['geen regel', 'kapot ' || (file_id % 3)]) as line from {UPLOADS_SQL} as u) as x group by 1",
)
def audit_unparsed(spark, sf):
    """Damaged lines among whole ones come back as error rows."""
    done = uploads(spark, sf)
    events = writers.audit_events(done, "ANONYMIZE_START", F.lit("s"), F.col("uploaded"), file=F.col("name"))
    damaged = done.select(F.explode(F.array(F.lit("geen regel"), F.concat(F.lit("kapot "), (F.col("file_id") % 3).cast("string")))).alias("value"))
    lines = events.select(writers.audit_line(["file"]).alias("value")).union(damaged)
    return logs.unparsed_audit(lines).groupBy("line").agg(F.count("*").alias("n"))


@query(
    "magic_check",
    "select doc_id, doc_id % 3 <> 1 as agrees, case doc_id % 3 when 0 then 'text' else 'pdf' end as family from documents",
)
def magic_check(spark, sf):
    body = F.regexp_replace("text", "^", "x")
    pdf = F.concat(F.lit("%PDF-1.4 "), body)
    docs = texts(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, body).otherwise(pdf).cast("binary").alias("content"),
        F.when(F.col("doc_id") % 3 == 2, "pdf").otherwise("txt").alias("ext"),
    )
    content = F.col("content")
    return docs.select("doc_id", admission.magic_agrees(content, F.col("ext")).alias("agrees"), admission.magic_type(content).alias("family"))


PATTERNS = """
select p_partkey, case p_partkey % 6 when 0 then p_name when 1 then concat('(?:', p_name, ')++') when 2 then concat('(', p_name)
  when 3 then repeat(concat(p_name, ' '), 130) when 4 then concat('(?i:', p_name, '){2,9}') else concat('[', p_brand, ']+') end as pattern
from part
"""


@query(
    "pattern_lint",
    f"""
    select p_partkey, reason is null as is_valid, reason from (
      select p_partkey, case when length(pattern) > 1000 then 'too_long'
        when regexp_matches(pattern, '\\(\\?.*\\)\\+\\+') or regexp_matches(pattern, '\\(\\?.*\\)\\*\\*') or regexp_matches(pattern, '\\(\\?.*\\)\\{{.*,.*\\}}') then 'dangerous'
        when length(replace(pattern, '(', '')) <> length(replace(pattern, ')', '')) then 'invalid' end as reason
      from ({PATTERNS}) as p) as x
    """,
)
def pattern_lint(spark, sf):
    patterns = from_sql(spark, sf, PATTERNS, "part")
    return rules.lint_patterns(patterns, "pattern").select("p_partkey", "is_valid", "reason")


PAYLOADS = """
select event_id, case event_id % 5 when 0 then props when 1 then concat('{"rules": ', props, ', "text": "a [[[[ b"}')
  when 2 then concat('{"rules": ', repeat('[', cast(event_id % 13 as int)), '1', repeat(']', cast(event_id % 13 as int)), ', "text": "x"}')
  when 3 then '[1, 2]' else 'geen json' end as payload
from events
"""


@query(
    "payload_lint",
    f"""
    select event_id, case event_id % 5 when 0 then 'Required field ''rules'' ontbreekt' when 1 then null
      when 2 then case when 1 + event_id % 13 > 10 then 'JSON te diep genest (max 10 levels)' end else 'Data moet een object zijn' end as problem
    from ({PAYLOADS}) as p
    """,
)
def payload_lint(spark, sf):
    payloads = from_sql(spark, sf, PAYLOADS, "events")
    return payloads.select("event_id", admission.json_problem(F.col("payload"), ["rules", "text"]).alias("problem"))


@query(
    "human_sizes",
    f"""
    select file_id, case when length = 0 then '0 Bytes' when length < 1024 then concat(length, ' Bytes') when length < 1048576 then concat(regexp_replace(cast(round(length / 1024.0::double, 2) as varchar), '\\.0+$', ''), ' KB')
      else concat(regexp_replace(cast(round(length / 1048576.0::double, 2) as varchar), '\\.0+$', ''), ' MB') end as shown from {UPLOADS_SQL} as u
    """,
)
def human_sizes(spark, sf):
    return uploads(spark, sf).select("file_id", text_functions.human_size(F.col("length")).alias("shown"))


@query("retention", "select event_id from events where ts > timestamp '2024-01-20 12:00:00' - interval 24 hour")
def retention(spark, sf):
    return admission.newer_than(jobs(spark, sf), "ts", F.expr("timestamp '2024-01-20 12:00:00'")).select("event_id")


@query("retention_purged", "select event_id from events where ts > timestamp '2024-01-20 12:00:00' - interval 24 hour")
def retention_purged(spark, sf):
    """Old days leave the stored table; the day that the limit cuts is written again."""
    path = scratch_path(spark, "events")
    jobs(spark, sf).withColumn("dt", F.to_date("ts")).repartition("dt").write.partitionBy("dt").parquet(path)
    purge(spark, path, "ts", F.expr("timestamp '2024-01-20 12:00:00'"))
    return spark.read.parquet(path).select("event_id")


@query(
    "retention_versioned",
    """
    select event_id, case when event_id % 2 = 0 then 1 else 2 end as first_version, 3 as versions from events where ts > timestamp '2024-01-20 12:00:00' - interval 24 hour
    """,
)
def retention_versioned(spark, sf):
    """Two appends and a purge, each a version; old versions still read as they were."""
    stored = VersionedTable(spark, scratch_path(spark, "events"), "dt", "ts")
    events = jobs(spark, sf).withColumn("dt", F.to_date("ts"))
    for half in (0, 1):
        stored.append(events.where(F.col("event_id") % 2 == half))
    stored.purge(F.expr("timestamp '2024-01-20 12:00:00'"))
    first = F.when(F.col("n") == 2, F.lit(1)).otherwise(F.lit(2)).alias("first_version")
    seen = stored.read(1).unionByName(stored.read(2)).groupBy("event_id").agg(F.count("*").alias("n"))
    return stored.read().join(seen, "event_id").select("event_id", first, F.lit(stored.version()).alias("versions"))


@query("session_deleted_versioned", "select c_custkey from customer where c_nationkey <> 3")
def session_deleted_versioned(spark, sf):
    stored = VersionedTable(spark, scratch_path(spark, "sessions"), "session_id")
    stored.append(_sessions(spark, sf))
    stored.remove_session(_SESSION_3)
    stored.remove_session("geen-uuid")
    stored.compact()
    return stored.read().select("c_custkey")


@query("session_deleted", "select c_custkey from customer where c_nationkey <> 3")
def session_deleted(spark, sf):
    path = _session_folder(spark, sf)
    remove_session(spark, path, _SESSION_3)
    remove_session(spark, path, "geen-uuid")
    return spark.read.parquet(path).select("c_custkey")


def _session_folder(spark, sf):
    """Outputs partitioned by session: one session per nation."""
    path = scratch_path(spark, "sessions")
    hexed = F.md5(F.col("c_nationkey").cast("string"))
    session = F.concat_ws(
        "-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12)
    )
    table(spark, sf, "customer").withColumn("session_id", session).write.partitionBy("session_id").parquet(path)
    return path


def _sessions(spark, sf):
    return spark.read.parquet(_session_folder(spark, sf))


_SESSION_3 = "eccbc87e-4b5c-e2fe-2830-8fd9f2a7baf3"  # of nation 3


@query("session_scope", "select c_custkey from customer where c_nationkey = 3")
def session_scope(spark, sf):
    return admission.of_session(_sessions(spark, sf), _SESSION_3).select("c_custkey")


@query("session_removed", "select c_custkey from customer where c_nationkey <> 3")
def session_removed(spark, sf):
    kept = admission.without_session(_sessions(spark, sf), _SESSION_3)
    return admission.without_session(kept, "geen-uuid").select("c_custkey")


@query(
    "sheet_selection",
    """
    select o_orderkey, case when o_orderkey % 3 = 0 then 'A|B|C' when o_orderkey % 3 = 1 then 'B' else 'C|A' end as sheets from orders
    """,
)
def sheet_selection(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    chosen = F.when(F.col("id") % 3 == 1, F.array(F.lit("B"), F.lit("X"))).otherwise(F.array(F.lit("C"), F.lit("A")))
    selections = orders.where("id % 3 <> 0").select("id", chosen.alias("selected"))
    existing = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    joined = files.with_selected_sheets(orders, selections, "id")
    return joined.select(F.col("id").alias("o_orderkey"), F.array_join(admission.selected_sheets(F.col("selected"), existing), "|").alias("sheets"))


# --- office files ----------------------------------------------------------------------

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def docx_bytes(text: str, footer: str = "") -> bytes:
    """A minimal DOCX: a paragraph per line, two runs each, and a footer."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    lines = "".join(f"<w:p>{run(t[: len(t) // 2])}{run(t[len(t) // 2 :])}</w:p>" for t in text.split("\n"))
    wrap = lambda tag, body: f'<w:{tag} xmlns:w="{_W}">{body}</w:{tag}>'
    return _zip(
        {
            "word/document.xml": wrap("document", f"<w:body>{lines}</w:body>"),
            "word/footer1.xml": wrap("ftr", f"<w:p>{run(footer)}</w:p>"),
        }
    )


def xlsx_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A minimal XLSX with inline strings; a string that starts with ``=`` is a formula."""

    def cell(value):
        if value is None:
            return "<c/>"
        if isinstance(value, str):
            if value.startswith("="):
                return f"<c><f>{escape(value[1:])}</f></c>"
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f"<c><v>{value}</v></c>"

    entries, rels, parts = [], [], {}
    for i, (name, rows) in enumerate(sheets.items(), start=1):
        body = "".join(f'<row r="{r}">{"".join(cell(v) for v in row)}</row>' for r, row in enumerate(rows, start=1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_S}"><sheetData>{body}</sheetData></worksheet>'
        entries.append(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>')
        rels.append(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>')
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets>{"".join(entries)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{''.join(rels)}</Relationships>"
    return _zip(parts)


@F.pandas_udf(T.BinaryType())
def _as_docx(texts: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([docx_bytes(t, n) for t, n in zip(texts, names, strict=True)])


def _docx_corpus(spark, sf):
    """Conversation turns as DOCX files, and damaged files besides."""
    talks = texts(spark, sf, "conversations").withColumn(
        "path", F.concat("conv_id", F.lit("-"), "turn", F.lit(".docx"))
    )
    content = _as_docx(F.regexp_replace("text", r"[\r\p{Cntrl}&&[^\n]]", ""), F.col("path"))
    damaged = talks.where("conv_id % 10 = 9").select(F.concat(F.lit("kapot-"), "path").alias("path"), F.lit("geen zip").cast("binary").alias("content"))
    return talks.select("path", content.alias("content")).union(damaged)


@query(
    "docx_texts",
    "select concat(conv_id, '-', turn, '.docx') as path, text from conversations",
)
def docx_texts(spark, sf):
    return office.read_docx_texts(_docx_corpus(spark, sf)).where("error is null").select("path", "text")


@query(
    "docx_runs_redacted",
    """
    select concat(conv_id, '-', turn, '.docx') as path, 'body' as part, 2 * len(string_split(text, chr(10)))::bigint as n_runs, length(replace(text, chr(10), ''))::bigint as n_chars
    from conversations
    union all
    select concat(conv_id, '-', turn, '.docx'), 'footer1', 1, length(concat(conv_id, '-', turn, '.docx')) from conversations
    """,
)
def docx_runs_redacted(spark, sf):
    runs = office.read_docx_runs(_docx_corpus(spark, sf))
    return text_job.redact_runs(runs).groupBy("path", "part").agg(F.count("*").alias("n_runs"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "docx_quarantine",
    """
    select concat(conv_id, '-', turn, '.docx') as path, true as valid, null as error from conversations
    union all select concat('kapot-', conv_id, '-', turn, '.docx'), false, 'Word document is corrupt (geen valide ZIP)' from conversations where conv_id % 10 = 9
    """,
)
def docx_quarantine(spark, sf):
    return office.read_status(office.read_docx_runs(_docx_corpus(spark, sf)))


def _workbooks(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("c_custkey")
    klanten = [["nr", "naam", "saldo"]] + [[int(k), n, float(b)] for k, n, b in zip(frame.c_custkey, frame.c_name, frame.c_acctbal, strict=True)]
    som = [["totaal"], ["=SUM(A1:A9)" if frame.book.iloc[0] % 2 else "0"]]
    return pd.DataFrame({"path": [f"boek{frame.book.iloc[0]}.xlsx"], "content": [xlsx_bytes({"klanten": klanten, "som": som})]})


def _xlsx_corpus(spark, sf):
    """Customers in workbooks of 100."""
    books = table(spark, sf, "customer").withColumn("book", F.floor(F.col("c_custkey") / 100))
    return books.groupBy("book").applyInPandas(_workbooks, "path string, content binary")


@query(
    "xlsx_table",
    "select concat('boek', c_custkey // 100, '.xlsx') as path, 'klanten' as sheet, (c_custkey % 100 + 2)::int as row_idx, c_custkey as nr, c_name as naam, c_acctbal as saldo from customer",
)
def xlsx_table(spark, sf):
    cells = office.only_sheets(office.read_xlsx_cells(_xlsx_corpus(spark, sf)), ["klanten"])
    return office.cells_to_table(cells, {"nr": "bigint", "naam": "string", "saldo": "double"})


@query(
    "xlsx_formulas",
    """
    select concat('boek', b, '.xlsx') as path, sheet, sheet = 'som' and b % 2 = 1 as has_formulas
    from (select distinct c_custkey // 100 as b, unnest(['klanten', 'som']) as sheet from customer) as x
    """,
)
def xlsx_formulas(spark, sf):
    return admission.has_formula(office.read_xlsx_cells(_xlsx_corpus(spark, sf)))


@query(
    "xlsx_previews",
    """
    select concat('boek', b, '.xlsx') as path, 'klanten' as sheet, 0 as sheet_idx, n as rows, 'nr|naam|saldo' as columns,
      string_agg(concat_ws('|', cast(c_custkey as varchar), c_name, cast(c_acctbal as varchar)), '/' order by c_custkey) as preview
    from (select c_custkey // 100 as b, c_custkey, c_name, c_acctbal, cast(count(*) over (partition by c_custkey // 100) as int) as n from customer) as x
    where c_custkey % 100 < 5 group by b, n
    """,
)
def xlsx_previews(spark, sf):
    previews = office.sheet_previews(office.read_xlsx_cells(_xlsx_corpus(spark, sf))).where("sheet = 'klanten'")
    lines = F.transform("preview", lambda cells: F.array_join(cells, "|"))
    return previews.withColumns({"columns": F.array_join("columns", "|"), "preview": F.array_join(lines, "/")})
