"""Query and SQL of the mixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import mixing
from tallyward.sources.tables import load

NAME = "op5_mixing_sources"
SEED, TEMPERATURE = 17, 0.5


def query(spark, folder):
    rows = mixing.mixed(load(spark, folder, "documents"), seed=SEED, temperature=TEMPERATURE)
    return rows.select(
        "doc_id", "source", "copy", "copies", F.round("place", 12).alias("place"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")
    )


def mixture_sql(table: str) -> str:
    """Rows of ``table`` with ``copy, copies, place``."""
    return f"""
    sizes as (select source, sum(length(coalesce(text, '')))::double as size from {table} group by source),
    shares as (select source, size, case when size > 0 then pow(size, {TEMPERATURE}) else 0.0 end as weight from sizes),
    rates as (select source, case when a = 0 or w = 0 then 1.0 when size > 0 then weight / w * a / size else 0.0 end as rate
              from shares cross join (select sum(size) as a, sum(weight) as w from shares)),
    terms as (select source, k, sum(exp(-rate + case when k > 0 then k * ln(greatest(rate, 1e-300)) else 0 end - lgamma(k + 1))) over (partition by source order by k) as upto
              from (select source, rate, unnest(range(ceil(rate + 12 * sqrt(rate) + 24)::bigint + 1)) as k from rates)),
    drawn as (select *, ('0x' || substr(md5('{SEED}|n|' || coalesce(doc_id::varchar, '') || '|' || coalesce(source, '')), 1, 13))::bigint / 4503599627370496.0 as u from {table}),
    counted as (select d.*, coalesce((select count(*) from terms t where t.source is not distinct from d.source and t.upto <= d.u), 0) as copies from drawn d),
    mixture as (select *, ('0x' || substr(md5('{SEED}|p|' || coalesce(doc_id::varchar, '') || '|' || coalesce(source, '') || '|' || copy), 1, 13))::bigint / 4503599627370496.0 as place
                from (select *, unnest(range(1, copies + 1)) as copy from counted))"""


SQL = f"with {mixture_sql('documents')} select doc_id, source, copy, copies, round(place, 12) as place, md5(coalesce(text, '')) as text_md5 from mixture"
