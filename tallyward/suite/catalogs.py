"""Catalog metadata told from the part, document and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.operators import catalog
from tallyward.operators.masking import pii_columns
from tallyward.suite.common import Suite, view, words

SUITE = Suite()
add = SUITE.add


@add(
    "c01_governance_gaps",
    """with tagged as (select distinct table_name || '.' || column_name as entity from v_columns where tag like '%PII%' or tag like '%Sensitive%'),
            listed as (select distinct table_name || '.' || column_name as entity from v_policy_pii)
       select 'pii_not_in_policy' as gap, entity from tagged where entity not in (select entity from listed)
       union all select 'pii_not_in_catalog', entity from listed where entity not in (select entity from tagged)
       union all select distinct 'table_not_in_bundle', table_name from v_columns where table_name not in (select table_name from v_bundle_tables)
       union all select 'table_no_rules', bundle_id || '/' || table_name from v_bundle_tables
           where lower(table_name) not in (select lower(split_part(target, '.', 1)) from v_rule_targets)""",
    ("v_columns", "v_policy_pii", "v_bundle_tables", "v_rule_targets"),
)
def c01(spark, folder):
    columns = view(spark, folder, "v_columns").withColumn("tags", F.array("tag"))
    return catalog.governance_gaps(
        pii_columns(columns),
        view(spark, folder, "v_policy_pii"),
        columns,
        view(spark, folder, "v_bundle_tables"),
        view(spark, folder, "v_rule_targets"),
    )


def _sources(spark, folder):
    names = ["v_bundle_tables", "v_bundle_joins", "v_rule_targets", "v_models", "v_named_edges"]
    return [view(spark, folder, n) for n in names]


_SOURCES = ("v_columns", "v_bundle_tables", "v_bundle_joins", "v_rule_targets", "v_models", "v_named_edges")


@add(
    "c02_removal_impact",
    """with h as (select distinct bundle_id from v_bundle_tables where table_name = 'small_ring')
       select 'bundle_broken' as impact, bundle_id as entity from h
       union all select 'join_broken', left_table || '.' || left_column || ' = ' || right_table || '.' || right_column from v_bundle_joins
           where (left_table = 'small_ring' or right_table = 'small_ring') and bundle_id in (select bundle_id from h)
       union all select 'rule_orphaned', rule from v_rule_targets where starts_with(lower(target), 'small_ring')
       union all select 'model_broken', model from v_models where table_name = 'small_ring'
       union all select 'lineage_broken', split_part(from_node, '.', -1) || ' → ' || split_part(to_node, '.', -1) from v_named_edges
           where split_part(from_node, '.', -1) = 'small_ring' or split_part(to_node, '.', -1) = 'small_ring'""",
    _SOURCES,
)
def c02(spark, folder):
    return catalog.removal_impact("small_ring", *_sources(spark, folder))


@add(
    "c03_impact_ranking",
    """with t as (select distinct table_name from v_columns),
            h as (select distinct bundle_id, table_name from v_bundle_tables),
            b as (select table_name, count(*) as n from h group by 1),
            j as (select table_name, count(*) as n from v_bundle_joins join h using (bundle_id) where left_table = table_name or right_table = table_name group by 1),
            r as (select table_name, count(*) as n from t join v_rule_targets on starts_with(lower(target), lower(table_name)) group by 1),
            m as (select table_name, count(*) as n from v_models group by 1),
            e as (select table_name, count(*) as n from t join v_named_edges on split_part(from_node, '.', -1) = table_name or split_part(to_node, '.', -1) = table_name group by 1),
            x as (select table_name, coalesce(b.n, 0) as bundles, coalesce(j.n, 0) as joins, coalesce(r.n, 0) as rules, coalesce(m.n, 0) as models, coalesce(e.n, 0) as edges
                  from t left join b using (table_name) left join j using (table_name) left join r using (table_name) left join m using (table_name) left join e using (table_name))
       select *, bundles + joins + rules + models + edges as total from x""",
    _SOURCES,
)
def c03(spark, folder):
    return catalog.impact_ranking(view(spark, folder, "v_columns"), *_sources(spark, folder))


@add(
    "c04_lineage",
    """with recursive up as (
           select to_node as root, from_node, to_node, 1 as depth from v_edges
           union all select up.root, e.from_node, e.to_node, depth + 1 from up join v_edges e on e.to_node = up.from_node where depth < 3)
       select root, from_node, to_node, min(depth) as depth from up group by 1, 2, 3""",
    ("v_edges",),
)
def c04(spark, folder):
    edges = view(spark, folder, "v_edges")
    return catalog.lineage(edges, edges.select(F.col("to_node").alias("root")), 3)


@add(
    "c04_lineage_full_depth",
    """with recursive up as (
           select to_node as root, from_node, to_node, 1 as depth from v_edges
           union all select up.root, e.from_node, e.to_node, depth + 1 from up join v_edges e on e.to_node = up.from_node)
       select root, from_node, to_node, min(depth) as depth from up group by 1, 2, 3""",
    ("v_edges",),
)
def c04_full(spark, folder):
    edges = view(spark, folder, "v_edges")
    return catalog.lineage(edges, edges.select(F.col("to_node").alias("root")), None)


@add(
    "c04_lineage_of_one",
    """with recursive up as (
           select from_node, to_node, 1 as depth from v_edges where to_node = 'db.public.t150'
           union all select e.from_node, e.to_node, depth + 1 from up join v_edges e on e.to_node = up.from_node where depth < 5)
       select split_part(from_node, '.', -1) as from_node, split_part(to_node, '.', -1) as to_node, min(depth) as depth from up group by 1, 2""",
    ("v_edges",),
)
def c04_one(spark, folder):
    return catalog.lineage_of(view(spark, folder, "v_edges"), "db.public.t150", 5)


@add(
    "c05_search_glossary",
    """select name from v_terms where contains(lower(name), 'rc1') or contains(lower(description), 'rc1')
         or len(list_filter(string_split(synonyms_text, ';'), lambda s: contains(lower(s), 'rc1'))) > 0""",
    ("v_terms",),
)
def c05(spark, folder):
    terms = view(spark, folder, "v_terms").withColumn("synonyms", words("synonyms_text", ";"))
    return catalog.search_glossary(terms, "RC1").select("name")


@add(
    "c06_match_context",
    """with q as (select question_id, lower(question) as question from v_context_questions),
            named as (select distinct question_id, name from q join v_context_terms t on contains(question, lower(name)) or contains(question, lower(synonyms_text))),
            by_term as (select distinct question_id, table_name from named join v_context_tables c on contains(tag, name)),
            rest as (select * from q where question_id not in (select question_id from by_term)),
            first_word as (select *, list_filter(string_split(question, ' '), lambda w: length(w) > 3)[1] as word from rest)
       select question_id, table_name, 'term' as matched_by from by_term
       union all select distinct question_id, table_name, 'keyword' from first_word join v_context_tables c
           on contains(question, lower(table_name)) or word is not null and contains(lower(description), word)""",
    ("v_context_questions", "v_context_terms", "v_context_tables"),
)
def c06(spark, folder):
    terms = view(spark, folder, "v_context_terms").withColumn("synonyms", F.array("synonyms_text"))
    tables = view(spark, folder, "v_context_tables").withColumn("glossary_terms", F.array("tag"))
    return catalog.match_context(view(spark, folder, "v_context_questions"), terms, tables)
