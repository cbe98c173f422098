"""Query and SQL of the quality rules."""

from __future__ import annotations

import math

from tallyward.llm import quality
from tallyward.sources.tables import load

NAME = "op2_quality_rules"


def query(spark, folder):
    docs = load(spark, folder, "documents")
    rows = quality.quality_verdicts(docs, ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals")


def _fence_sql() -> str:
    out = []
    for name, (_, both) in quality.MEASURES.items():
        out.append(f"max(case when measure = '{name}' then q3 end) as top_{name}, max(case when measure = '{name}' then {quality.REACH} * greatest(q3 - q2, {quality.GAMMA - 1!r} * q3) end) as up_{name}")
        if both:
            out.append(f"max(case when measure = '{name}' then q1 end) as bottom_{name}, max(case when measure = '{name}' then {quality.REACH} * greatest(q2 - q1, {quality.GAMMA - 1!r} * q1) end) as down_{name}")
    return ", ".join(out)


def _inside_sql() -> str:
    out = []
    for name, (one, both) in quality.MEASURES.items():
        rounding = f"{quality.OCCURRENCES} * ({one.replace(' / ', '::double / nullif(')}, 0))"
        out.append(f"{name} <= top_{name} + greatest(up_{name}, {rounding})")
        if both:
            out.append(f"{name} >= bottom_{name} - greatest(down_{name}, {rounding})")
    return " and ".join(out)


def _quartile_sql(keys: str, upper: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""
        select {by} measure, min(case when 4 * upto >= total then v end) as q1,
               min(case when 2 * upto >= total then v end) as q2, min(case when 4 * upto >= 3 * total then v end) as q3, max(total) as total
        from (select {by} measure, case when bucket < 0 then 0.0 else {2.0 / (quality.GAMMA + 1)!r} * pow({quality.GAMMA}, bucket::double) end as v,
                     sum(n) over (partition by {by} measure order by bucket) as upto, sum(n) over (partition by {by} measure) as total
              from (select {by} measure, bucket, sum(n) as n from {upper} group by {by} measure, bucket))
        group by {by} measure"""


def counts_sql(table: str) -> str:
    """The base counts of ``table`` (doc_id, text, lang, source), one row for each of its rows."""
    return f"""
    select doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_capitals, n_repeat_words,
           (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, rid
    from (select rid, doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
                 (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals
          from (select rid, doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
                       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
                from {table}))
    left join (
        select rid, count(distinct i + k)::bigint as n_repeat_words
        from (select rid, i, count(*) over (partition by rid, a, b, c, d, e) as n
              from (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c, w[i + 3] as d, w[i + 4] as e
                    from (select rid, w, unnest(range(1, len(w) - 3)) as i
                          from (select rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {table}))))
             cross join (select unnest(range(5)) as k)
        where n > 1 group by rid) using (rid)"""


def verdict_sql(counts: str) -> str:
    """Common table expressions that end in ``verdict``, over a relation of base counts."""
    return f"""
    counted as (select * replace (coalesce(n_repeat_words, 0) as n_repeat_words, n_words < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * n_words as base_failed) from ({counts})),
    measures as (select *, case when n_words > 0 then 1000 * n_symbols // n_words end as symbols, case when n_lines > 0 then 1000 * n_dup_lines // n_lines end as dup_lines,
                        case when n_lines > 0 then 10 * n_words // n_lines end as line_words, case when word_chars > 0 then 1000 * n_capitals // word_chars end as capitals,
                        case when n_words > 0 then 100 * word_chars // n_words end as word_length from counted),
    sketch as (select lang, source, measure, case when v <= 0 then -1 else ceil(ln(v) / {math.log(quality.GAMMA)!r})::int end as bucket, count(*) as n
               from (select lang, source, unnest(['symbols', 'dup_lines', 'line_words', 'capitals', 'word_length']) as measure,
                            unnest([symbols, dup_lines, line_words, capitals, word_length]) as v from measures where not base_failed)
               group by all),
    by_group as ({_quartile_sql("lang, source", "sketch")}), by_lang as ({_quartile_sql("lang", "sketch")}), by_all as ({_quartile_sql("", "sketch")}),
    used as (select g.lang, g.source, g.measure,
                    case when g.total >= {quality.LEAST_GROUP} then g.q1 when l.total >= {quality.LEAST_GROUP} then l.q1 else a.q1 end as q1,
                    case when g.total >= {quality.LEAST_GROUP} then g.q2 when l.total >= {quality.LEAST_GROUP} then l.q2 else a.q2 end as q2,
                    case when g.total >= {quality.LEAST_GROUP} then g.q3 when l.total >= {quality.LEAST_GROUP} then l.q3 else a.q3 end as q3
             from by_group g join by_lang l on g.lang is not distinct from l.lang and g.measure = l.measure join by_all a on g.measure = a.measure),
    fence as (select lang, source, {_fence_sql()} from used group by lang, source),
    verdict as (select m.*, coalesce(not base_failed and {_inside_sql()}, false) as kept
                from measures m left join fence f on m.lang is not distinct from f.lang and m.source is not distinct from f.source)"""


SQL = f"""
with numbered as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
{verdict_sql(counts_sql("numbered"))}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_capitals from verdict"""
