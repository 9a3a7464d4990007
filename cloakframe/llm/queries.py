"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, decontaminate, html_extract, language_id, near_dup, phrase_mining, ranked_search, secret_scan, substring_dedup, suffix_dedup
from .common import table
from .packing import pack
from .topk_search import top_k
from .url_filter import judge_urls


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digested(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200, keep_first=False))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"), least=100, percent=100, top=2000)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return backoff_lm.score_texts(table(spark, sf_dir, "documents"), held_out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_packing, op3_topk_search, op4_suffix_dedup, op5_url_filter, op6_decontaminate, op7_near_dup, op8_html_extract,
        op9_substring_dedup, op10_secret_scan, op11_phrase_mining, op12_ranked_search,
        op13_backoff_lm,
    )
}

# DuckDB SQL with the same rows, where SQL expresses the operator.
SQL: dict[str, str] = {
    "op3_topk_search": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
          from embeddings
          where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scores as (
          select q.vec_id as query_id, c.vec_id,
            cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
          from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
        select query_id, cast(rank as int) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)
        where rank <= 5""",
    "op4_suffix_dedup": r"""
        with docs as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
          bytes as (select r, unnest(range(0, length(hx) // 2)) as i, unnest(regexp_extract_all(hx, '..')) as b from docs),
          windows as (
            select r, i, b, case when count(*) over f = 200 then md5(string_agg(b, '') over f) end as h
            from bytes window f as (partition by r order by i rows between current row and 199 following)),
          often as (select h from windows where h is not null group by h having count(*) > 1),
          flags as (
            select r, i, b, max(case when o.h is not null then 1 else 0 end) over (partition by r order by i rows between 199 preceding and current row) as gone
            from windows as w left join often as o on w.h = o.h),
          edges as (select *, lag(gone, 1, 0) over (partition by r order by i) as before from flags),
          kept as (
            select r, count(*) as n_bytes, sum(gone)::bigint as n_removed, sum(case when gone = 1 and before = 0 then 1 else 0 end)::bigint as n_spans,
              coalesce(string_agg(b, '' order by i) filter (where gone = 0), '') as kept
            from edges group by r)
        select doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
          sha256(unhex(coalesce(kept, ''))) as kept_sha256
        from docs left join kept on docs.r = kept.r""",
    "op7_near_dup": r"""
        with recursive docs as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
            from documents),
          sets as (
            select distinct doc_id, unnest(case when len(ws) > 1 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end) as g
            from docs),
          sizes as (select doc_id, count(*) as n from sets group by doc_id),
          pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from sets as a join sets as b on a.g = b.g and a.doc_id < b.doc_id group by all),
          links as (
            select a, b from pairs join sizes as x on x.doc_id = a join sizes as y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
          steps as (select a, b from links union select b, a from links),
          reach(node, r) as (select doc_id, doc_id from docs union select node, b from reach join steps on r = a)
        select docs.doc_id, coalesce(n, 0) as n_shingles, component_id, docs.doc_id = component_id as kept
        from docs left join sizes on docs.doc_id = sizes.doc_id
          join (select node, min(r) as component_id from reach group by node) as c on c.node = docs.doc_id""",
    "op9_substring_dedup": r"""
        with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
          words as (select r, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from docs),
          windows as (
            select r, i, word, case when count(*) over f = 35 then md5(string_agg(word, ' ') over f) end as h
            from words window f as (partition by r order by i rows between current row and 34 following)),
          often as (select h from windows where h is not null group by h having count(*) > 1),
          flags as (
            select r, i, word, max(case when o.h is not null then 1 else 0 end) over (partition by r order by i rows between 34 preceding and current row) as gone
            from windows as w left join often as o on w.h = o.h),
          kept as (
            select r, count(*) as n_words, sum(gone)::bigint as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where gone = 0), '') as kept
            from flags group by r)
        select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from docs left join kept on docs.r = kept.r""",
    "op11_phrase_mining": r"""
        with docs as (
            select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
          pieces as (
            select lang, regexp_extract_all(p, '[^\x20\x09]+') as ws
            from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from docs)),
          totals as (select lang, sum(len(ws))::bigint as n from pieces group by lang),
          grams as (
            select lang, m, ws[i : i + m - 1] as w
            from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from pieces, (select unnest(range(1, 6)) as m) where len(ws) >= m)),
          counts as (select lang, m, array_to_string(w, ' ') as phrase, count(*)::bigint as f from grams group by all having count(*) >= 100),
          cand as (select lang, m, phrase, string_split(phrase, ' ') as w, f as a from counts where m > 1),
          cuts as (select *, unnest(range(1, m)) as k from cand),
          scored as (
            select c.lang, c.phrase, c.k, c.a, x.f as l, y.f as r, n, ((1000::hugeint * c.a * n) // (x.f::hugeint * y.f))::bigint as score
            from cuts as c join counts as x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ')
              join counts as y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 : c.m], ' ') join totals as t on t.lang = c.lang),
          best as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as cut from scored) where cut = 1),
          inside as (
            select lang, array_to_string(w[i : i + s - 1], ' ') as phrase, max(a) as around
            from (select lang, w, a, s, unnest(range(1, m - s + 2)) as i from cand, (select unnest(range(2, 5)) as s) where s < m) group by all),
          kept as (
            select best.* from best left join inside on inside.lang = best.lang and inside.phrase = best.phrase where around is null or 100 * around < 100 * a)
        select lang, rank, phrase, a, l, r, n, score
        from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        where rank <= 2000""",
    "op12_ranked_search": r"""
        with docs as (
            select row_number() over () as d, doc_id,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
            from documents),
          sizes as (select d, doc_id, len(ts)::bigint as n from docs where len(ts) > 0),
          total as (select count(*)::bigint as nd, sum(n)::bigint as nt from sizes),
          tf as (select d, t, count(*)::bigint as tf from (select d, unnest(ts) as t from docs) group by all),
          df as (select t, count(*)::bigint as df from tf group by t),
          items as (
            select row_number() over () as i, item_id,
              list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as ts
            from benchmark),
          asked as (select i, item_id, unnest(ts) as t from items),
          scores as (
            select i, item_id, doc_id, tf.d,
              sum(floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::bigint as score
            from asked join tf on tf.t = asked.t join df on df.t = asked.t join sizes on sizes.d = tf.d cross join total
            group by all)
        select item_id, rank, doc_id, score
        from (select *, cast(row_number() over (partition by i order by score desc, doc_id) as int) as rank from scores where score > 0)
        where rank <= 10""",
}
