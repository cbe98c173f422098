"""Query and SQL of the conversation repair; the SQL goes from row to row with the least edits to each point of the pattern."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tallyward.llm import repair
from tallyward.llm.common import same
from tallyward.sources.tables import load

NAME = "op12_conversation_repair"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EMPTY = hashlib.sha256(b"").hexdigest()


def query(spark, folder):
    rows = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    known = rows.select("conv_id").distinct()
    found = repair.repairs(repair.damaged(rows))
    # conversations of which no row is left
    both = known.join(found, same(known, found, "conv_id"), "left")
    counts = [F.coalesce(found[c], F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
    return both.select(
        known["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256")
    )


_CRC = """
    list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(k) + 1),
        lambda i: list_transform(range(8), lambda b: ((ascii(k[i]) >> b) & 1)::bigint)))),
        lambda c, b: xor(c >> 1, 3988292384::bigint * (xor(c, b) & 1)))"""

#: Up to two insertions lead from one point of the pattern to another; more are never cheapest.
_INSERTED = """(values (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']),
    (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']), (2, 3, 1, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 2, 1, ['user:']),
    (3, 3, 2, ['user:', 'assistant:'])) as ins(p, r, m, lines)"""
_MOVED = "(values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) as mv(r, i, q)"

SQL = rf"""
with recursive
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
          from conversations),
kinds as (select *, xor(({_CRC}), 4294967295) % 20 as kind from named),
harmed as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                  case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
           from kinds, (select unnest(range(2)) as copy) where kind <> 0 and (copy = 0 or kind = 3)),
ranked as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
                  regexp_replace(text, '[\x20\x09-\x0D]+$', '') as seen from harmed),
rows_ as (select conv_id, turn, role, text, pos, role[1] as i,
                 case when seen = '' then 'blank' when nth > 1 then 'duplicate' when right(seen, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
          from (select *, row_number() over (partition by conv_id, role, text order by pos) as nth from ranked)),
known as (select distinct conv_id from conversations),
edits as (
    select r.conv_id, r.pos, mv.r, mv.q, 'K' as letter, case when fault = 'truncated' then 3 else 0 end as cost, [role || ':' || text] as lines
    from rows_ r join {_MOVED} on r.i = mv.i where fault not in ('blank', 'duplicate')
    union all
    select r.conv_id, r.pos, mv.r, mv.q, 'R', case when fault = 'truncated' then 6 else 3 end, [case mv.i when 'u' then 'user' else 'assistant' end || ':' || text]
    from rows_ r join {_MOVED} on mv.i <> 's' where fault not in ('blank', 'duplicate')
    union all
    select conv_id, pos, s, s, 'D', 4, [] from rows_, (select unnest(range(4)) as s)),
walk as (
    select conv_id, 0::bigint as pos, 0 as q, 0 as cost, '' as audit, []::varchar[] as lines from known
    union all
    select conv_id, pos, q, cost, audit, lines from (
        select w.conv_id, w.pos + 1 as pos, e.q, w.cost + 3 * ins.m + e.cost as cost, w.audit || repeat('I', ins.m) || e.letter as audit,
               w.lines || ins.lines || e.lines as lines
        from walk w join {_INSERTED} on w.q = ins.p join edits e on w.conv_id is not distinct from e.conv_id and e.pos = w.pos + 1 and e.r = ins.r)
    qualify row_number() over (partition by conv_id, pos, q order by cost, audit) = 1),
best as (
    select w.conv_id, w.cost + 3 * ins.m as cost, w.audit || repeat('I', ins.m) as audit, w.lines || ins.lines as lines
    from walk w join {_INSERTED} on w.q = ins.p left join (select conv_id, max(pos) as n from rows_ group by conv_id) l on w.conv_id is not distinct from l.conv_id
    where w.pos = coalesce(l.n, 0) and ins.r in (0, 3)
    qualify row_number() over (partition by w.conv_id order by w.cost + 3 * ins.m, w.audit || repeat('I', ins.m)) = 1),
told as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
           count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
           count(*) filter (pos > 1 and before || i not in ('su', 'ua', 'au')) as illegal
    from (select *, lag(i) over (partition by conv_id order by pos) as before from rows_) group by conv_id)
select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, b.cost::bigint as cost, b.audit,
       sha256(array_to_string(b.lines, chr(10))) as repaired_sha256
from best b left join told t on b.conv_id is not distinct from t.conv_id"""
