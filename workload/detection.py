"""Detection: pattern catalogue, detectors, confidence, summaries, profiles, SQL functions."""

from pyspark.sql import functions as F

from cloakframe.functions import catalogue as cat
from cloakframe.functions import validators
from cloakframe.functions.text import each_struct, each_value
from cloakframe.operators import columns, detect, redact, sketches
from cloakframe.plans.text_job import preview_texts
from cloakframe.sources import config

from .inputs import (
    IDENTITIES_SQL, MESSAGES_SQL, NOTES_SQL, from_sql, identities, in_duck, lit, messages, notes, sql_all, sql_emails,
    sql_findings, sql_phones, sql_scored, sql_valid_bsn, sql_valid_iban, sql_valid_postal, texts,
)
from .registry import query


def _exploded(df, found, *keep):
    return each_value(df, found, "match", *keep)


def _hits(df, patterns):
    return (
        each_struct(df, detect.matches_by_pattern(F.col("text"), patterns))
        .groupBy("name")
        .agg(F.sum(F.size("matches")).cast("long").alias("n_matches"), F.count_if(F.size("matches") > 0).alias("n_texts"))
    )


def _hits_sql(source, patterns):
    parts = [
        f"select {lit(name)} as name, sum(len(m))::bigint as n_matches, count(*) filter (len(m) > 0) as n_texts "
        f"from (select regexp_extract_all(text, {lit(regex)}) as m from {source}) as x"
        for name, regex in patterns
    ]
    return "\nunion all\n".join(parts)


@query("phone_pattern_hits", _hits_sql(MESSAGES_SQL, cat.PHONE_PATTERNS))
def phone_pattern_hits(spark, sf):
    return _hits(messages(spark, sf), cat.PHONE_PATTERNS)


@query("email_pattern_hits", _hits_sql(MESSAGES_SQL, cat.EMAIL_PATTERNS))
def email_pattern_hits(spark, sf):
    return _hits(messages(spark, sf), cat.EMAIL_PATTERNS)


@query("bsn_pattern_hits", _hits_sql(IDENTITIES_SQL, cat.BSN_PATTERNS))
def bsn_pattern_hits(spark, sf):
    return _hits(identities(spark, sf), cat.BSN_PATTERNS)


@query("iban_pattern_hits", _hits_sql(IDENTITIES_SQL, cat.IBAN_PATTERNS))
def iban_pattern_hits(spark, sf):
    return _hits(identities(spark, sf), cat.IBAN_PATTERNS)


@query("postal_pattern_hits", _hits_sql(IDENTITIES_SQL, cat.POSTAL_PATTERNS))
def postal_pattern_hits(spark, sf):
    return _hits(identities(spark, sf), cat.POSTAL_PATTERNS)


@query("phones_found", f"select doc_id, unnest({sql_phones('text')}) as match from {MESSAGES_SQL} as m")
def phones_found(spark, sf):
    return _exploded(messages(spark, sf), detect.find_phones(F.col("text")), "doc_id")


@query("emails_found", f"select doc_id, unnest({sql_emails('text')}) as match from {MESSAGES_SQL} as m")
def emails_found(spark, sf):
    return _exploded(messages(spark, sf), detect.find_emails(F.col("text")), "doc_id")


@query("emails_in_documents", f"select doc_id, unnest({sql_emails('text')}) as match from documents")
def emails_in_documents(spark, sf):
    return _exploded(texts(spark, sf, "documents"), detect.find_emails(F.col("text")), "doc_id")


@query(
    "emails_in_pages",
    f"select page_id, unnest({sql_emails('html')}) as match from pages",
)
def emails_in_pages(spark, sf):
    return _exploded(texts(spark, sf, "pages"), detect.find_emails(F.col("html")), "page_id")


@query(
    "emails_in_conversations",
    f"select conv_id, turn, unnest({sql_emails('text')}) as match from conversations",
)
def emails_in_conversations(spark, sf):
    return _exploded(texts(spark, sf, "conversations"), detect.find_emails(F.col("text")), "conv_id", "turn")


def _detected(df, found, key="id"):
    return each_struct(df, found, key)


@query(
    "bsn_detected",
    f"select id, match, cast(1.0 as double) as confidence from "
    f"(select id, unnest({sql_all('text', cat.BSN_PATTERNS)}) as match from {IDENTITIES_SQL} as i) as x where {sql_valid_bsn('match')}",
)
def bsn_detected(spark, sf):
    return _detected(identities(spark, sf), detect.detect_bsn(F.col("text")))


@query(
    "iban_detected",
    f"select id, match, cast(1.0 as double) as confidence from "
    f"(select id, unnest({sql_all('text', cat.IBAN_PATTERNS)}) as match from {IDENTITIES_SQL} as i) as x where {sql_valid_iban('match')}",
)
def iban_detected(spark, sf):
    return _detected(identities(spark, sf), detect.detect_iban(F.col("text")))


@query(
    "iban_detected_any_case",
    "select id, match, cast(1.0 as double) as confidence from (select id, unnest("
    + sql_all("lower(text)", [(n, "(?i)" + p) for n, p in cat.IBAN_PATTERNS])
    + f") as match from {IDENTITIES_SQL} as i) as x where {sql_valid_iban('match')}",
)
def iban_detected_any_case(spark, sf):
    return _detected(identities(spark, sf), detect.detect_iban(F.lower("text"), ignore_case=True))


@query(
    "postal_detected",
    f"select id, match, cast(0.9 as double) as confidence from "
    f"(select id, unnest({sql_all('text', cat.POSTAL_PATTERNS)}) as match from {IDENTITIES_SQL} as i) as x where {sql_valid_postal('match')}",
)
def postal_detected(spark, sf):
    return _detected(identities(spark, sf), detect.detect_postal_codes(F.col("text")))


@query(
    "phones_detected",
    f"select doc_id, unnest({sql_phones('text')}) as match, cast(0.95 as double) as confidence from {NOTES_SQL} as n",
)
def phones_detected(spark, sf):
    return _detected(notes(spark, sf), detect.detect_phones(F.col("text")), "doc_id")


@query(
    "emails_detected",
    f"select doc_id, unnest({sql_emails('text')}) as match, cast(0.95 as double) as confidence from {NOTES_SQL} as n",
)
def emails_detected(spark, sf):
    return _detected(notes(spark, sf), detect.detect_emails(F.col("text")), "doc_id")


@query(
    "identity_validity",
    f"""
    select id, {sql_valid_bsn('bsn')} as bsn_ok, {sql_valid_iban('iban')} as iban_ok, {sql_valid_postal('postal')} as postal_ok
    from {IDENTITIES_SQL} as i
    """,
)
def identity_validity(spark, sf):
    return identities(spark, sf).select(
        "id",
        validators.is_valid_bsn(F.col("bsn")).alias("bsn_ok"),
        validators.is_valid_iban(F.col("iban")).alias("iban_ok"),
        validators.is_valid_postal_code(F.col("postal")).alias("postal_ok"),
    )


UUID_SQL = """
select o_orderkey, case o_orderkey % 4 when 0 then upper(u) when 1 then replace(u, '-', '') else u end as u
from (select o_orderkey, concat(substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-', substr(m, 17, 4), '-', substr(m, 21, 12)) as u
      from (select o_orderkey, md5(cast(o_orderkey as {T})) as m from orders) as t1) as t2
"""


@query(
    "uuid_validity",
    f"""
    select o_orderkey, length(u) = 36 and u = lower(u)
      and regexp_full_match(replace(u, '-', ''), '[0-9a-f]+') and u = concat_ws('-', substr(u, 1, 8), substr(u, 10, 4), substr(u, 15, 4), substr(u, 20, 4), substr(u, 25)) as is_uuid
    from ({in_duck(UUID_SQL)}) as x
    """,
)
def uuid_validity(spark, sf):
    ids = from_sql(spark, sf, UUID_SQL, "orders")
    return ids.select("o_orderkey", validators.is_canonical_uuid(F.col("u")).alias("is_uuid"))


@query(
    "validity_by_sql_function",
    f"""
    select count(*) filter ({sql_valid_bsn('bsn')}) as n_bsn, count(*) filter ({sql_valid_iban('iban')}) as n_iban,
      count(*) filter ({sql_valid_postal('postal')}) as n_postal, count(*) as n_rows from {IDENTITIES_SQL} as i
    """,
)
def validity_by_sql_function(spark, sf):
    validators.register_sql_functions(spark)
    return spark.sql(
        "select count_if(is_valid_bsn(bsn)) as n_bsn, count_if(is_valid_iban(iban)) as n_iban, "
        "count_if(is_valid_postal_code(postal)) as n_postal, count(*) as n_rows from {ids}",
        ids=identities(spark, sf),
    )


@query(
    "findings_by_sql_function",
    f"select doc_id, pattern, match, confidence from ({sql_scored(NOTES_SQL + ' as n')}) as s",
)
def findings_by_sql_function(spark, sf):
    validators.register_sql_functions(spark)
    return spark.sql(
        """
        select doc_id, f.* from (select doc_id, find_pii(text) as found from {notes})
        lateral view outer explode(found) t as f where f is not null
        """,
        notes=notes(spark, sf),
    )


@query(
    "findings_by_lateral_view",
    f"select doc_id, pattern, match from ({sql_findings(NOTES_SQL + ' as n')}) as f",
)
def findings_by_lateral_view(spark, sf):
    """Finders called from SQL, one row per finding."""
    validators.register_sql_functions(spark)
    return spark.sql(
        """
        select doc_id, pattern, match from (
          select doc_id, map('phone_nl', find_phones(text), 'email', find_emails(text), 'bsn', find_bsns(text),
                             'iban', find_ibans(text), 'postal_code_nl', find_postal_codes(text)) as found from {notes})
        lateral view outer explode(found) t as pattern, matches
        lateral view outer explode(matches) u as match where match is not null
        """,
        notes=notes(spark, sf),
    )


@query("context_hits", f"select doc_id, pattern, match, cast(hits as int) as hits from ({sql_scored(NOTES_SQL + ' as n')}) as s")
def context_hits(spark, sf):
    found = detect.explode_findings(detect.with_findings(notes(spark, sf)), "doc_id", "text")
    hits = F.lit(None).cast("int")
    for name, entry in cat.REGISTRY.items():
        hits = F.when(
            F.col("pattern") == name, detect.count_context_words(F.col("text"), F.col("match"), entry["context_words"])
        ).otherwise(hits)
    return found.select("doc_id", "pattern", "match", hits.alias("hits"))


@query("findings_scored", f"select doc_id, pattern, match, confidence from ({sql_scored(NOTES_SQL + ' as n')}) as s")
def findings_scored(spark, sf):
    return detect.explode_findings(detect.with_findings(notes(spark, sf)), "doc_id")


@query(
    "findings_confident",
    f"select doc_id, pattern, match, confidence from ({sql_scored(NOTES_SQL + ' as n')}) as s where confidence >= 0.97",
)
def findings_confident(spark, sf):
    return detect.explode_findings(detect.auto_detect(notes(spark, sf), threshold=0.97), "doc_id")


@query(
    "summary_per_document",
    f"""
    select doc_id, count(*) as total_matches, round(avg(confidence), 2) as avg_confidence,
      count(*) filter (confidence >= 0.9) as high_confidence,
      count(*) filter (pattern = 'phone_nl') as n_phone, count(*) filter (pattern = 'bsn') as n_bsn
    from ({sql_scored(NOTES_SQL + ' as n')}) as s group by doc_id
    """,
)
def summary_per_document(spark, sf):
    by_type = F.col("summary.by_type")
    count_of = lambda p: F.coalesce(F.try_element_at(by_type, F.lit(p)), F.lit(0)).cast("long")
    return detect.auto_detect(notes(spark, sf), threshold=0.0).select(
        "doc_id", "summary.total_matches", "summary.avg_confidence", "summary.high_confidence",
        count_of("phone_nl").alias("n_phone"), count_of("bsn").alias("n_bsn"),
    )


@query(
    "summary_by_pattern",
    f"""
    select coalesce(pattern, 'all') as pattern, count(*) as total_matches, round(avg(confidence), 2) as avg_confidence,
      count(*) filter (confidence >= 0.9) as high_confidence
    from ({sql_scored(NOTES_SQL + ' as n')}) as s group by rollup(pattern)
    """,
)
def summary_by_pattern(spark, sf):
    found = detect.explode_findings(detect.with_findings(notes(spark, sf)), "doc_id")
    return detect.pattern_totals(found).withColumn("pattern", F.coalesce("pattern", F.lit("all")))


@query(
    "summary_rollup",
    f"""
    select case grouping(doc_id, pattern) when 0 then 'document_pattern' when 1 then 'document' when 2 then 'pattern' else 'all' end as level, doc_id, pattern,
      count(*) as total_matches, round(avg(confidence), 2) as avg_confidence, count(*) filter (confidence >= 0.9) as high_confidence
    from ({sql_scored(NOTES_SQL + ' as n')}) as s group by grouping sets ((doc_id, pattern), (doc_id), (pattern), ())
    """,
)
def summary_rollup(spark, sf):
    return detect.summary_rollup(detect.explode_findings(detect.with_findings(notes(spark, sf)), "doc_id"))


@query(
    "distinct_values_sketched",
    f"""
    select 'phone' as kind, count(*) as n_matches, true as within from (select unnest({sql_phones('text')}) as m from {MESSAGES_SQL} as x) as p
    union all
    select 'email', count(*), true from (select unnest({sql_emails('text')}) as m from {MESSAGES_SQL} as x) as e
    """,
)
def distinct_values_sketched(spark, sf):
    """Sketches per kind and tenth of the documents, merged; the estimate is held against the exact count."""
    rows = redact.corpus_values(messages(spark, sf), "doc_id")
    parts = sketches.value_sketches(rows, "kind", F.pmod("doc_id", F.lit(10)).alias("part"))
    exact = rows.groupBy("kind", "original").agg(F.lit(1).alias("x")).groupBy("kind").agg(F.count("*").alias("n"))
    found = sketches.approximate_distinct(parts, "kind").join(exact, "kind")
    return found.select("kind", "n_matches", (F.abs(F.col("n_values") - F.col("n")) <= 0.02 * F.col("n")).alias("within"))


@query(
    "distinct_values_by_kind",
    f"""
    select 'phone' as kind, count(distinct m) as n_values, count(*) as n_matches from (select unnest({sql_phones('text')}) as m from {MESSAGES_SQL} as x) as p
    union all
    select 'email', count(distinct m), count(*) from (select unnest({sql_emails('text')}) as m from {MESSAGES_SQL} as x) as e
    """,
)
def distinct_values_by_kind(spark, sf):
    rows = redact.corpus_values(messages(spark, sf), "doc_id")
    # Counted per value first, so a value that fills a third of the corpus is one row in the second step.
    per_value = rows.groupBy("kind", "original").agg(F.count("*").alias("n"))
    return per_value.groupBy("kind").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_matches"))


REPORT_SQL = f"""
select doc_id, len(p)::bigint as n_phones, len(e)::bigint as n_emails, array_to_string(p[1:1], '|') as first_phones,
  len(p) > 1 as more_phones, (len(p) + len(e))::bigint as total_items
from (select doc_id, {sql_phones('text')} as p, {sql_emails('text')} as e from {MESSAGES_SQL} as m) as x
"""


@query("preview_report", REPORT_SQL)
def preview_report(spark, sf):
    r = F.col("report")
    return detect.with_report(messages(spark, sf), max_items=1).select(
        "doc_id", r["phone_numbers"]["count"].alias("n_phones"), r["emails"]["count"].alias("n_emails"),
        F.array_join(r["phone_numbers"]["preview"], "|").alias("first_phones"),
        r["phone_numbers"]["has_more"].alias("more_phones"), r["total_items"].alias("total_items"),
    )


@query(
    "preview_of_documents",
    f"""
    select doc_id, substr(text, 1, 500) as preview_text, len({sql_emails('text')})::bigint as n_emails,
      array_to_string(({sql_emails('text')})[1:10], '|') as emails from documents
    """,
)
def preview_of_documents(spark, sf):
    emails = F.col("report.emails")
    return detect.with_preview(texts(spark, sf, "documents")).select(
        "doc_id", "preview_text", emails["count"].alias("n_emails"), F.array_join(emails["preview"], "|").alias("emails")
    )


@query(
    "preview_batch_with_errors",
    f"""
    select doc_id, substr(text, 1, 500) as preview_text, null as error, len({sql_emails('text')})::bigint as n_emails from documents
    union all select -1 - doc_id, null, 'onleesbaar', null from documents where doc_id % 9 = 0
    """,
)
def preview_batch_with_errors(spark, sf):
    docs = texts(spark, sf, "documents").withColumn("problem", F.lit(None).cast("string"))
    broken = docs.where("doc_id % 9 = 0").withColumns({"doc_id": -1 - F.col("doc_id"), "text": F.lit(None).cast("string"), "problem": F.lit("onleesbaar")})
    docs = docs.unionByName(broken)
    return preview_texts(docs, "doc_id", error_col="problem").select(
        "doc_id", "preview_text", "error", F.col("report.emails.count").alias("n_emails")
    )


CONTACT_SQL = """
select o_orderkey as id, concat('klant', cast(o_custkey as {T}), '@example.nl') as mail,
  case when o_orderkey % 3 = 0 then 'onbekend' else concat('06 ', lpad(cast(o_custkey as {T}), 8, '1')) end as phone,
  case when o_orderkey % 4 = 0 then concat('x', cast(o_orderkey as {T}), '@example.nl') else ' ' end as remark,
  o_orderstatus as status
from orders
"""
_EMAIL, _PHONE = lit(cat.PROFILE_EMAIL), lit(cat.PROFILE_PHONE)


@query(
    "column_pii_profile",
    f"""
    select column_name, n_values, n_emails, n_phones,
      case when n_emails / n_values > 0.5 then 'emails' when n_phones / n_values > 0.5 then 'telefoonnummers' end as detected_type,
      case when n_emails / n_values > 0.5 then '[EMAIL VERWIJDERD]' when n_phones / n_values > 0.5 then '[TEL VERWIJDERD]' end as suggested_mask
    from (
      select column_name, count(*) as n_values, count(*) filter (regexp_matches(v, {_EMAIL})) as n_emails,
        count(*) filter (regexp_matches(regexp_replace(v, '\\s', '', 'g'), {_PHONE})) as n_phones
      from (unpivot (select mail, phone, remark, status from ({in_duck(CONTACT_SQL)}) as c) on mail, phone, remark, status into name column_name value v) as u
      where trim(v) <> '' group by column_name) as g
    """,
)
def column_pii_profile(spark, sf):
    contacts = from_sql(spark, sf, CONTACT_SQL, "orders")
    return columns.column_pii_profile(contacts, ["mail", "phone", "remark", "status"])


@query(
    "custom_detector",
    """
    select c_custkey as doc_id, 'customer_no' as pattern, m as match, cast(0.7 as double) as confidence
    from (select c_custkey, unnest(regexp_extract_all(c_name, 'Customer#\\d+')) as m from customer) as x
    """,
)
def custom_detector(spark, sf):
    def customer_numbers(text):
        found = F.regexp_extract_all(text, F.lit(r"Customer#\d+"), F.lit(0))
        return F.transform(found, lambda m: F.struct(m.alias("match"), F.lit(0.7).alias("confidence")))

    detect.register_detector("detect_customer_numbers", customer_numbers)
    registry = {
        "customer_no": {"detector_function": "detect_customer_numbers"},
        "email": {**cat.REGISTRY["email"], "enabled": False},
        "unknown": {"detector_function": "no_such_detector"},
    }
    return detect.explode_findings(detect.with_findings(notes(spark, sf), registry=registry), "doc_id")


_DESCRIPTIONS = " ".join(f"when {lit(n)} then {lit(e['description'])}" for n, e in cat.REGISTRY.items())


@query(
    "findings_described",
    f"select doc_id, pattern, match, case pattern {_DESCRIPTIONS} end as description from ({sql_findings(NOTES_SQL + ' as n')}) as f "
    "where pattern <> 'bsn'",
)
def findings_described(spark, sf):
    registry = {n: {**e, "enabled": n != "bsn"} for n, e in cat.REGISTRY.items()}
    found = detect.explode_findings(detect.with_findings(notes(spark, sf)), "doc_id")
    described = config.annotate_findings(found, config.registry_table(spark, registry))
    return described.select("doc_id", "pattern", "match", "description")
