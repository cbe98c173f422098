"""Query and SQL of the line dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import lines
from tallyward.sources.tables import load

NAME = "op1_line_dedup"


def query(spark, folder):
    rows = lines.without_copies(load(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *lines.ADDED, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Lines in order with ``keep``; ids of documents are unique here.
LINES_SQL = f"""
    raw as (select doc_id, i, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i
            from (select doc_id, string_split(text, chr(10)) as ls from documents where text <> ''))),
    split as (select doc_id, i, line, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as raw_words from raw),
    worded as (select doc_id, i, line, list_transform(raw_words, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from split),
    numbered as (select *, array_to_string(w, ' ') as unit, row_number() over (order by doc_id, i) as rank from worded),
    firsts as (select unit, min(rank) as first, any_value(w) as w from numbered where len(w) > 0 group by unit),
    long as (select * from firsts where len(w) >= {lines.LEAST_WORDS}),
    cuts as (select first, unit, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') as rest from (select *, unnest(range(1, len(w) + 1)) as p from long)),
    near as (select first from (select first, min(first) over (partition by p, rest) as least from cuts) where least < first
             union select c.first from cuts c join long l on c.rest = l.unit where l.first < c.first
             union select l.first from cuts c join long l on c.rest = l.unit where c.first < l.first),
    judged as (select n.*, len(n.w) > 0 and n.rank > f.first as exact, len(n.w) > 0 and n.rank = f.first and n.rank in (select first from near) as near
               from numbered n left join firsts f on n.unit = f.unit)"""

SQL = f"""
with {LINES_SQL}
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_exact, 0)::bigint as n_exact, coalesce(n_near, 0)::bigint as n_near, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join (select doc_id, count(*) as n_lines, sum(exact::int) as n_exact, sum(near::int) as n_near,
                                   string_agg(case when not exact and not near then line end, chr(10) order by i) as kept
                            from judged group by doc_id) using (doc_id)"""
