"""The registered queries of the operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bitpack, credentials, exact, fim, langid, licenses, lmscore, mixing, neardup, packing, periods, quality, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_license_scan", licenses.scan_sql())
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query(
    "op2_near_dedup",
    """with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    sets as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as shingle from words),
    sizes as (select doc_id, count(*) as n from sets group by 1),
    pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from sets a join sets b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
    links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * both_ >= 75 * (x.n + y.n - both_)),
    sides as (select a, b from links union select b, a from links),
    reach as (select doc_id as node, doc_id as other from documents union select node, b from reach join sides on a = other)
    select d.doc_id, coalesce(s.n, 0) as n_shingles, r.c as component_id, d.doc_id = r.c as kept
    from documents d left join sizes s on s.doc_id = d.doc_id join (select node, min(other) as c from reach group by 1) r on r.node = d.doc_id""",
)
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_groups(table(spark, folder, "documents"))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


@query(
    "op5_exact_dedup",
    """select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
    sha256(coalesce(text, '')) as text_sha256 from documents window same as (partition by coalesce(text, ''))""",
)
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


@query(
    "op6_source_mix",
    """with docs as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, md5(doc_id::varchar) as ord from documents),
    sizes as (select source, sum(size)::bigint as source_size from docs group by 1),
    numbered as (select *, row_number() over (order by source nulls last) as number, 3 * source_size as most from sizes),
    weighed as (select *, [5, 2, 1][1 + (number - 1) % 3]::bigint as weight, [1.5, 1.0, 0.5][1 + (number - 1) % 3]::double as start from numbered),
    summed as (select *, sum(source_size) over ()::bigint as words, sum(weight) over ()::bigint as weights,
        coalesce(sum(most) over before, 0)::bigint as most_before, coalesce(sum(weight) over before, 0)::bigint as weights_before from weighed
        window before as (order by most / weight, number rows between unbounded preceding and 1 preceding)),
    judged as (select *, most <= (words - most_before) / (weights - weights_before) * weight as limited from summed),
    aims as (select *, case when limited then most::double else (words - coalesce(sum(case when limited then most end) over (), 0)::bigint)
        / (weights - coalesce(sum(case when limited then weight end) over (), 0)::bigint) * weight end as target from judged),
    places as (select d.*, source_size, target, start, floor(target + 0.5)::bigint as goal,
        sum(size) over (partition by d.source order by ord rows between unbounded preceding and current row)::bigint - size as place
        from docs d join aims a on d.source is not distinct from a.source),
    taken as (select *, case when 2 * (goal - place) > size then size else 0 end as t0, case when 2 * (goal - place - source_size) > size then size else 0 end as t1, case when 2 * (goal - place - 2 * source_size) > size then size else 0 end as t2 from places)
    select doc_id, size, source_size, target, t0 + t1 + t2 as taken, (t0 > 0)::bigint + (t1 > 0)::bigint + (t2 > 0)::bigint as n_copies,
    case when t0 > 0 then round(2 * (place / target) / (start + sqrt(start * start + 4 * (1 - start) * (place / target))), 9) end as position from taken""",
)
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op9_packing")
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), with_ids=False)


@query("op7_bit_packed_tokens")
def op7_bit_packed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return bitpack.round_trip(table(spark, folder, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.held_out_languages(table(spark, folder, "documents"))


@query(
    "op10_warc",
    """with p as (select page_id, encode(coalesce(html, '')) as payload from pages), d as (select page_id, octet_length(payload) as n, sha1(payload) as digest from p),
    g as (select *, max(page_id) over (partition by digest, n) as largest from d)
    select page_id, n as payload_bytes, digest as payload_digest, case when n >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
    case when n >= 1000 and page_id <> largest then largest end as refers_to from g""",
)
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lmscore.scores(table(spark, folder, "documents"))


@query(
    "op13_fill_in_middle",
    """with units as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
    drawn as (select *, len(u) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from units),
    formed as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
    parts as (select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from formed)
    select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256 from parts""",
)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digests(table(spark, folder, "documents"))


@query("op11_word_runs")
def op11_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.digests(table(spark, folder, "documents"))


@query("op12_secret_scan")
def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.digests(table(spark, folder, "documents"))
