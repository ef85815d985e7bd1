"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from aislewise.llm.common import read
from aislewise.llm.decontam import benchmark_matches
from aislewise.llm.jaccardjoin import jaccard_components
from aislewise.llm.langid import label_languages, learn_languages
from aislewise.llm.licences import licence_digests, scan_licences
from aislewise.llm.linededup import dedup_lines
from aislewise.llm.packing import pack_documents
from aislewise.llm.periods import find_runs, run_digests, with_periods
from aislewise.llm.repeats import remove_repeats
from aislewise.llm.rules import held_out, learn_quality, score_quality
from aislewise.llm.telephony import telephony
from aislewise.llm.tokenstore import token_store
from aislewise.llm.vectorcodes import code_digests
from aislewise.llm.warc import archive_pages
from aislewise.plans.views import Registry

REGISTRY = Registry()
add = REGISTRY.add


@add("op1_telephony")
def op1_telephony(spark, sf):
    return telephony(read(spark, sf, "documents"))


OP2_SQL = """
    with p as (select page_id, lower(coalesce(url, '')) as url, coalesce(html, '') as html from pages),
    k as (select *, sha1(html) as h, regexp_replace(url, '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?|#.*$', '', 'g') as bare from p),
    n as (select *, regexp_extract(bare, '^[^/?]*') as host, max(page_id) over (partition by h) as winner from k),
    u as (select *, array_to_string(list_reverse(string_split(regexp_replace(host, ':[0-9]*$', ''), '.')), ',') || ')'
                    || substr(bare, length(host) + 1) as url_key,
                 strftime(make_timestamp((1600000000 + page_id % 1073741824) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as ts from n)
    select page_id, octet_length(encode(html)) as payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
           case when page_id = winner then 'response' else 'revisit' end as record_type,
           case when page_id <> winner then winner end as refers_to,
           url_key, ts, row_number() over (order by url_key, ts, page_id) - 1 as position
    from u"""


@add("op2_warc", OP2_SQL)
def op2_warc(spark, sf):
    return archive_pages(read(spark, sf, "pages"))


@add("op6_token_store")
def op6_token_store(spark, sf):
    return token_store(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@add("op3_bm25_packing")
def op3_bm25_packing(spark, sf):
    return pack_documents(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


@add("op4_crf_language")
def op4_crf_language(spark, sf):
    docs = read(spark, sf, "documents")
    return label_languages(docs, learn_languages(docs)).withColumn("held_out", held_out(F.col("doc_id")))


@add("op10_rule_quality")
def op10_rule_quality(spark, sf):
    docs = read(spark, sf, "documents")
    return score_quality(docs, learn_quality(docs, read(spark, sf, "labels")))


@add("op9_jaccard_join")
def op9_jaccard_join(spark, sf):
    return jaccard_components(read(spark, sf, "documents")).drop("row")


OP8_SQL = """
    with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line_no from documents),
    t as (select *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \\t]+'), lambda w: w <> ''))) as toks
          from l),
    c as (select toks, min((doc_id, line_no)) as first from t where len(toks) > 0 group by toks),
    f as (select tok, count(*) as df from (select unnest(toks) as tok from c) group by tok),
    o as (select c.first, len(c.toks) as n, tok, row_number() over (partition by c.first order by df, tok) as k
          from (select first, toks, unnest(toks) as tok from c) c join f using (tok)),
    p as (select * from o where k <= n - ((n * 4 + 4) // 5) + 1),
    q as (select distinct x.first as x, y.first as y from p x join p y using (tok)
          where y.first < x.first and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
    m as (select distinct q.x from q join c a on a.first = q.x join c b on b.first = q.y
          where 5 * len(list_intersect(a.toks, b.toks)) >=
                4 * (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))),
    g as (select t.doc_id, t.line_no, t.line,
                 coalesce((t.doc_id, t.line_no) > c.first or m.x is not null, false) as gone
          from t left join c on c.toks = t.toks left join m on m.x = c.first)
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
           coalesce(string_agg(line, chr(10) order by line_no) filter (not gone), '') as text
    from g group by doc_id"""


@add("op8_line_dedup", OP8_SQL)
def op8_line_dedup(spark, sf):
    return dedup_lines(read(spark, sf, "documents"))


@add("op7_repeated_strings")
def op7_repeated_strings(spark, sf):
    return remove_repeats(read(spark, sf, "documents")).drop("kept")


@add("op5_benchmark_matches")
def op5_benchmark_matches(spark, sf):
    return benchmark_matches(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@add("op11_licence_scan")
def op11_licence_scan(spark, sf):
    return licence_digests(scan_licences(read(spark, sf, "documents")))


@add("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    return run_digests(find_runs(with_periods(read(spark, sf, "documents")), least=12))


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds one after the other: ``b`` holds the codebooks before each, ``a`` the nearest entries."""
    ctes = [
        f"""v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as x from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""p as materialized (select vec_id, label, k as part, x[k * (len(x) // {parts}) + 1 : (k + 1) * (len(x) // {parts})] as x
            from v, range({parts}) r(k))""",
        f"""b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from p
            where vec_id in (select vec_id from v order by vec_id limit {entries}))""",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"""a{k} as materialized (select vec_id, label, p.part, p.x, min((list_sum(list_transform(list_zip(p.x, b.x),
                lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, b.entry)) as best from p join b{k} b on b.part = p.part group by all)"""
        )
        if k < rounds:
            ctes.append(
                f"""m{k} as materialized (select part, best[2] as entry, list(floor(s / n)::bigint order by i) as x from
                    (select part, best, i, sum(x[i + 1]) as s, count(*)::double as n from
                     (select part, (0, best[2]) as best, x, unnest(range(len(x))) as i from a{k}) group by all) group by all)"""
            )
            ctes.append(
                f"""b{k + 1} as materialized (select b.part, b.entry, coalesce(m.x, b.x) as x
                    from b{k} b left join m{k} m on m.part = b.part and m.entry = b.entry)"""
            )
    return f"""with {", ".join(ctes)},
        c as (select vec_id, label, string_agg(printf('%02x', best[2]), '' order by part) as code, sum(best[1])::bigint as error
              from a{rounds} group by vec_id, label),
        h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds})
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c, h"""


@add("op12_cover_tree_codes", _op12_sql())
def op12_cover_tree_codes(spark, sf):
    return code_digests(read(spark, sf, "embeddings"))
