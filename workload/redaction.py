"""Redaction of texts: fixed and reversible placeholders, user rules, logs, batches."""

from pyspark.sql import functions as F

from cloakframe.functions import catalogue as cat
from cloakframe.operators import monitor, redact, rules
from cloakframe.plans import text_job

from .inputs import (
    IDENTITIES_SQL, MESSAGES_SQL, NOTES_SQL, UPLOADS_SQL, identities, messages, notes, sql_all, sql_emails, sql_phones,
    sql_redacted, sql_valid_bsn, sql_valid_iban, table, texts, uploads,
)
from .registry import query


@query(
    "redact_fixed",
    f"""
    select doc_id, {sql_redacted('text')} as redacted, len({sql_phones('text')})::bigint as phone_count,
      len({sql_emails('text')})::bigint as email_count from {MESSAGES_SQL} as m
    """,
)
def redact_fixed(spark, sf):
    return redact.redact_fixed_with_counts(messages(spark, sf)).select("doc_id", "redacted", "phone_count", "email_count")


@query("redact_documents", f"select doc_id, {sql_redacted('text')} as redacted from documents")
def redact_documents(spark, sf):
    return redact.redact_fixed(texts(spark, sf, "documents")).select("doc_id", "redacted")


@query("redact_pages", f"select page_id, {sql_redacted('html')} as redacted from pages")
def redact_pages(spark, sf):
    return redact.redact_fixed(texts(spark, sf, "pages"), "html").select("page_id", "redacted")


@query("redact_paragraphs", f"""
    select conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda p: {sql_redacted('p')}), chr(10)) as redacted
    from conversations
    """)
def redact_paragraphs(spark, sf):
    return texts(spark, sf, "conversations").select("conv_id", "turn", text_job.redact_paragraphs(F.col("text")).alias("redacted"))


def sql_numbered(source: str, key: str = "doc_id") -> str:
    """``(key, text, items)``: items are ``{o, p, k}`` in replacement order."""
    numbered = lambda found, label, kind: (
        f"list_transform({found}, lambda v, i: {{'neg': -length(v), 'ord': {0 if kind == 'phone' else 1}, 'i': i, "
        f"'o': v, 'p': printf('[{label}-%03d]', i), 'k': '{kind}'}})"
    )
    return (
        f"select {key}, text, list_sort(list_concat({numbered(sql_phones('text'), 'TEL', 'phone')}, "
        f"{numbered(sql_emails('text'), 'EMAIL', 'email')})) as items from {source}"
    )


SUBSTITUTED = (
    "list_reduce(list_transform(items, lambda x: {'t': '', 'o': x.o, 'p': x.p}), "
    "lambda a, x: {'t': replace(a.t, x.o, x.p), 'o': '', 'p': ''}, {'t': text, 'o': '', 'p': ''}).t"
)


@query("redact_reversible", f"select doc_id, {SUBSTITUTED} as redacted from ({sql_numbered(MESSAGES_SQL + ' as m')}) as x")
def redact_reversible(spark, sf):
    return redact.redact_reversible(messages(spark, sf)).select("doc_id", "redacted")


@query(
    "reversible_mapping",
    f"""
    select scope_id, item.k as kind, item.p as placeholder, item.o as original
    from (select cast(doc_id as varchar) as scope_id, unnest(items) as item from ({sql_numbered(MESSAGES_SQL + ' as m')}) as x) as y
    """,
)
def reversible_mapping(spark, sf):
    return redact.mapping_rows(redact.redact_reversible(messages(spark, sf)), "doc_id")


def _kind_items(values: str, label: str, order: int) -> str:
    return (
        f"list_transform({values}, lambda v, i: {{'neg': -length(v), 'ord': {order}, 'i': i, "
        f"'o': v, 'p': printf('[{label}-%03d]', i), 'k': ''}})"
    )


_BSN = f"list_sort(list_distinct(list_filter({sql_all('text', cat.BSN_PATTERNS)}, lambda v: {sql_valid_bsn('v')})))"
_IBAN = f"list_sort(list_distinct(list_filter({sql_all('text', cat.IBAN_PATTERNS)}, lambda v: {sql_valid_iban('v')})))"


@query(
    "redact_identities",
    f"""
    select id, {SUBSTITUTED} as redacted from (
      select id, text, list_sort(list_concat({_kind_items(_BSN, 'BSN', 0)}, {_kind_items(_IBAN, 'IBAN', 1)})) as items
      from {IDENTITIES_SQL} as i) as x
    """,
)
def redact_identities(spark, sf):
    return redact.redact_reversible(identities(spark, sf), kinds=("bsn", "iban")).select("id", "redacted")


def sql_corpus_mapping(source: str) -> str:
    return f"""
select kind, original, printf('[%s-%03d]', case kind when 'phone' then 'TEL' else 'EMAIL' end,
    row_number() over (partition by kind order by original)) as placeholder
from (
  select distinct 'phone' as kind, unnest({sql_phones('text')}) as original from {source}
  union all
  select distinct 'email', unnest({sql_emails('text')}) from {source}) as v
"""


CORPUS_SQL = f"""
with src as materialized (select * from {MESSAGES_SQL} as m),
  mapping as materialized ({sql_corpus_mapping('src')}),
  pairs as (
    select doc_id, 'phone' as kind, unnest({sql_phones('text')}) as original from src
    union all select doc_id, 'email', unnest({sql_emails('text')}) from src),
  items as (
    select doc_id, list_sort(list({{'neg': -length(p.original), 'k': p.kind, 'o': p.original, 'p': m.placeholder}})) as items
    from pairs p join mapping m on p.kind = m.kind and p.original = m.original group by doc_id)
select src.doc_id, {SUBSTITUTED} as redacted from src join items on src.doc_id = items.doc_id
"""


@query("redact_corpus", CORPUS_SQL)
def redact_corpus(spark, sf):
    return redact.redact_corpus(messages(spark, sf), "doc_id")[0].select("doc_id", "redacted")


@query(
    "corpus_mapping",
    f"select 'corpus' as scope_id, kind, placeholder, original from ({sql_corpus_mapping(MESSAGES_SQL + ' as m')}) as x",
)
def corpus_mapping(spark, sf):
    return redact.redact_corpus(messages(spark, sf), "doc_id")[1]


# --- user rules ---------------------------------------------------------------

LITERAL_RULES = [
    {"id": "r1", "originalTerm": "bel", "replacementTerm": "Contact $1\\"},
    {"id": "r2", "originalTerm": "kantoor", "replacementTerm": "[PLAATS]", "caseSensitive": True},
    {"id": "r3", "originalTerm": "KANTOOR", "replacementTerm": "nooit", "caseSensitive": True},
]


@query(
    "rules_literal",
    f"""
    select doc_id, regexp_replace(regexp_replace(text, '(?i)bel', 'Contact $1\\\\', 'g'), 'kantoor', '[PLAATS]', 'g') as redacted
    from {MESSAGES_SQL} as m
    """,
)
def rules_literal(spark, sf):
    return rules.apply_rules(messages(spark, sf), LITERAL_RULES).select("doc_id", "redacted")


@query(
    "rules_regex",
    f"select doc_id, regexp_replace(regexp_replace(text, '(?i)klant(\\d)(\\d*)', 'k\\2-\\10', 'g'), 'status ([A-Z])', '\\1!', 'g') as redacted from {MESSAGES_SQL} as m",
)
def rules_regex(spark, sf):
    regex_rules = [
        {"id": "r1", "originalTerm": r"KLANT(?P<first_digit>\d)(\d*)", "replacementTerm": r"k\2-\g<first_digit>0", "isRegex": True},
        {"id": "r2", "originalTerm": "status ([A-Z])", "replacementTerm": r"\1!", "isRegex": True, "caseSensitive": True},
    ]
    return rules.apply_rules(messages(spark, sf), regex_rules).select("doc_id", "redacted")


@query(
    "rules_remove",
    f"""
    select doc_id, regexp_replace(text, '(?i)of mail ', '', 'g') as redacted, 'weg' as "ruleId", '[VERWIJDERD]' as "replacedWith",
      len(regexp_extract_all(text, '(?i)of mail '))::bigint as n from {MESSAGES_SQL} as m
    """,
)
def rules_remove(spark, sf):
    rule = {"id": "weg", "originalTerm": "of mail ", "replacementTerm": "x", "removeInsteadOfReplace": True}
    out = rules.apply_rules(messages(spark, sf), [rule])
    return rules.explode_log(out, "doc_id", "redacted").select(
        "doc_id", "redacted", "ruleId", "replacedWith", F.col("count").alias("n")
    )


@query(
    "rules_skipped",
    """
    select "ruleId", "appliedPattern", count(*) as n_entries, 0::bigint as n_matches
    from (select unnest(['leeg', 'fout']) as "ruleId", unnest(['(Lege Regex - Overgeslagen)', 'FOUT: (open']) as "appliedPattern" from orders) as x
    group by all
    """,
)
def rules_skipped(spark, sf):
    skipped = [
        {"id": "niets", "originalTerm": ""},
        {"id": "leeg", "originalTerm": "", "isRegex": True},
        {"id": "fout", "originalTerm": "(open", "isRegex": True},
    ]
    logs = rules.explode_log(rules.apply_rules(messages(spark, sf), skipped))
    return logs.groupBy("ruleId", "appliedPattern").agg(F.count("*").alias("n_entries"), F.sum("count").alias("n_matches"))


SEQUENCE = [
    {"id": "s1", "originalTerm": "status", "replacementTerm": "toestand"},
    {"id": "s2", "originalTerm": "toestand", "replacementTerm": "stand"},
    {"id": "s3", "originalTerm": r"\d{2}", "replacementTerm": "##", "isRegex": True},
    {"id": "s4", "originalTerm": "##", "replacementTerm": "#"},
    {"id": "s5", "originalTerm": "status", "replacementTerm": "nooit"},
]
SEQUENCE_SQL = f"""
select doc_id, t2, t3, regexp_replace(t3, '##', '#', 'g') as t4 from (
  select doc_id, t2, regexp_replace(t2, '\\d{{2}}', '##', 'g') as t3 from (
    select doc_id, regexp_replace(regexp_replace(text, '(?i)status', 'toestand', 'g'), '(?i)toestand', 'stand', 'g') as t2
    from {MESSAGES_SQL} as m) as a) as b
"""


@query("rules_in_sequence", f"select doc_id, t4 as redacted from ({SEQUENCE_SQL}) as x")
def rules_in_sequence(spark, sf):
    return rules.apply_rules(messages(spark, sf), SEQUENCE).select("doc_id", "redacted")


@query("rules_folded", f"select doc_id, t4 as redacted from ({SEQUENCE_SQL}) as x")
def rules_folded(spark, sf):
    return rules.apply_rules(messages(spark, sf), SEQUENCE, chained=0).select("doc_id", "redacted")


@query(
    "rules_many_terms",
    f"""
    select doc_id, case when cust_id in (select c_custkey from customer) then replace(text, concat('klant', cust_id, '@'), concat('[K', cust_id % 7, ']')) else text end as redacted,
      case when cust_id in (select c_custkey from customer) then concat('k', cust_id, ':1') else '' end as log
    from {MESSAGES_SQL} as m
    """,
)
def rules_many_terms(spark, sf):
    """A rule per customer, all of them in one pass."""
    listed = table(spark, sf, "customer").where("c_custkey is not null").selectExpr(
        "c_custkey", "concat('k', c_custkey) as id", "concat('Klant', c_custkey, '@') as originalTerm", "concat('[K', pmod(c_custkey, 7), ']') as replacementTerm"
    )
    log = F.array_join(F.transform("rule_log", lambda e: F.concat(e["ruleId"], F.lit(":"), e["count"])), ",")
    return rules.apply_rules(messages(spark, sf), listed, order_by=["c_custkey"]).select("doc_id", "redacted", log.alias("log"))


@query(
    "rule_counts",
    f"""
    select 's1' as "ruleId", 'status' as "originalTermDisplay", count(*)::bigint as n from orders
    union all select 's2', 'toestand', count(*)::bigint from orders
    union all select 's3', '\\d{{2}}', sum(len(regexp_extract_all(t2, '\\d{{2}}')))::bigint from ({SEQUENCE_SQL}) as x
    union all select 's4', '##', sum(len(regexp_extract_all(t3, '##')))::bigint from ({SEQUENCE_SQL}) as x
    """,
)
def rule_counts(spark, sf):
    logs = rules.explode_log(rules.apply_rules(messages(spark, sf), SEQUENCE), "doc_id")
    return logs.groupBy("ruleId", "originalTermDisplay").agg(F.sum("count").alias("n"))


@query("rules_default_placeholder", f"select doc_id, regexp_replace(text, '(?i)prioriteit [^ ]*', '[ANONIEM]', 'g') as redacted from {MESSAGES_SQL} as m")
def rules_default_placeholder(spark, sf):
    rule = rules.fill_default(rules.parse_rules([{"id": "d", "originalTerm": "prioriteit [^ ]*", "isRegex": True}]))
    return rules.apply_rules(messages(spark, sf), rule).select("doc_id", "redacted")


# --- whole jobs -----------------------------------------------------------------

JOB_RULES = [{"id": "m1", "originalTerm": "status", "replacementTerm": "[S]"}, {"id": "m2", "originalTerm": "kantoor"}]


@query(
    "text_job",
    f"""
    select doc_id, regexp_replace(regexp_replace({sql_redacted('text')}, '(?i)status', '[S]', 'g'), '(?i)kantoor', '[ANONIEM]', 'g') as redacted,
      (len({sql_phones('text')}) + len({sql_emails('text')}))::bigint as total_items, 4::bigint as n_logs
    from {MESSAGES_SQL} as m
    """,
)
def text_job_query(spark, sf):
    out = text_job.redact_texts(messages(spark, sf), JOB_RULES)
    return out.select("doc_id", "redacted", F.col("report.total_items").alias("total_items"), F.size("rule_log").cast("long").alias("n_logs"))


@query(
    "text_job_reversible",
    f"""
    select doc_id, regexp_replace({SUBSTITUTED}, '(?i)status', '[S]', 'g') as redacted, len(items)::bigint as n_mappings
    from ({sql_numbered(MESSAGES_SQL + ' as m')}) as x
    """,
)
def text_job_reversible(spark, sf):
    out = text_job.redact_texts(messages(spark, sf), JOB_RULES[:1], reversible=True)
    return out.select("doc_id", "redacted", F.size("mapping").cast("long").alias("n_mappings"))


@query(
    "auto_log",
    f"""
    select doc_id, 'auto_phone' as "ruleId", 'Automatische telefoon detectie' as "originalTermDisplay", '[TEL VERWIJDERD]' as "replacedWith", n
    from (select doc_id, len({sql_phones('text')})::bigint as n from {NOTES_SQL} as m) as p where n > 0
    union all
    select doc_id, 'auto_email', 'Automatische email detectie', '[EMAIL VERWIJDERD]', n
    from (select doc_id, len({sql_emails('text')})::bigint as n from {NOTES_SQL} as m) as e where n > 0
    """,
)
def auto_log(spark, sf):
    logs = rules.explode_log(text_job.redact_texts(notes(spark, sf)), "doc_id")
    return logs.select("doc_id", "ruleId", "originalTermDisplay", "replacedWith", F.col("count").alias("n"))


@query(
    "auto_log_reversible",
    f"""
    select doc_id, 'auto_phone' as "ruleId", 'Automatische telefoon detectie (reversible)' as "originalTermDisplay", concat(cast(n as varchar), ' unieke placeholder(s)') as "replacedWith"
    from (select doc_id, len({sql_phones('text')}) as n from {NOTES_SQL} as m) as p where n > 0
    union all
    select doc_id, 'auto_email', 'Automatische email detectie (reversible)', concat(cast(n as varchar), ' unieke placeholder(s)')
    from (select doc_id, len({sql_emails('text')}) as n from {NOTES_SQL} as m) as e where n > 0
    """,
)
def auto_log_reversible(spark, sf):
    logs = rules.explode_log(text_job.redact_texts(notes(spark, sf), reversible=True), "doc_id")
    return logs.select("doc_id", "ruleId", "originalTermDisplay", "replacedWith")


def _runs(spark, sf):
    """Lines of the conversations as runs of one document per conversation."""
    talks = texts(spark, sf, "conversations")
    return talks.select(
        F.col("conv_id").cast("string").alias("path"),
        F.col("turn").alias("para_idx"),
        F.posexplode(F.split("text", "\n", -1)).alias("run_idx", "text"),
        F.lit(None).cast("string").alias("error"),
    )


_RUNS_SQL = """(select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from conversations)"""


@query(
    "redact_runs",
    f"""select cast(conv_id as varchar) as path, turn as para_idx, (i - 1)::int as run_idx, {sql_redacted('line')} as redacted from {_RUNS_SQL} as r""",
)
def redact_runs(spark, sf):
    return text_job.redact_runs(_runs(spark, sf)).select("path", "para_idx", "run_idx", "redacted")


@query(
    "run_report_totals",
    f"""
    select cast(conv_id as varchar) as path, sum(len({sql_phones('line')}))::bigint as phones, sum(len({sql_emails('line')}))::bigint as emails,
      sum(len({sql_phones('line')}) + len({sql_emails('line')}))::bigint as total_items from {_RUNS_SQL} as r group by conv_id
    """,
)
def run_report_totals(spark, sf):
    return monitor.report_totals(text_job.redact_runs(_runs(spark, sf)), "path")


@query(
    "batch_results",
    f"""
    select file_id, 'anonymized' as status, name as original_name, null as error from {UPLOADS_SQL} as u
    union all select -1 - file_id, 'error', case when file_id % 20 = 3 then 'Unknown' else name end, 'onleesbaar' from {UPLOADS_SQL} as u where file_id % 10 = 3
    """,
)
def batch_results(spark, sf):
    files = uploads(spark, sf).withColumn("original_name", F.col("name"))
    failed = files.where("file_id % 10 = 3").withColumns(
        {"original_name": F.when(F.col("file_id") % 20 != 3, F.col("name")), "file_id": -1 - F.col("file_id"), "error": F.lit("onleesbaar")}
    )
    return text_job.batch_results(files, failed, "file_id")


@query(
    "dispatch_by_type",
    f"""
    select case when t in ('txt', 'docx') then 'text' when t = 'xlsx' then 'table' else 'unsupported' end as route, t as file_type, count(*) as n,
      max(case when t not in ('txt', 'docx', 'xlsx') then 'Niet ondersteund bestandstype: ' || t end) as error
    from (select case lower(case when contains(name, '.') then regexp_extract(name, '[^.]*$') end) when 'txt' then 'txt' when 'md' then 'txt'
            when 'docx' then 'docx' when 'xlsx' then 'xlsx' when 'csv' then 'xlsx' when 'pdf' then 'pdf' else 'unknown' end as t
          from {UPLOADS_SQL} as u) as x group by t
    """,
)
def dispatch_by_type(spark, sf):
    from cloakframe.operators.admission import extension, file_type

    files = uploads(spark, sf).withColumn("file_type", file_type(extension(F.col("name"))))
    routes = [df.withColumn("route", F.lit(name)) for name, df in text_job.route_by_type(files).items()]
    union = routes[0].unionByName(routes[1], allowMissingColumns=True).unionByName(routes[2], allowMissingColumns=True)
    return union.groupBy("route", "file_type").agg(F.count("*").alias("n"), F.max("error").alias("error"))
