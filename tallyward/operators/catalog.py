"""Analysis of catalog metadata: gaps, impact, lineage, glossary, context."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.plans.contains import contains_join
from tallyward.session import cut


def governance_gaps(
    catalog_pii: DataFrame,
    policy_pii: DataFrame,
    catalog_tables: DataFrame,
    bundle_tables: DataFrame,
    rule_targets: DataFrame,
) -> DataFrame:
    """``gap, entity`` for personal columns, unbundled tables and tables without rules.

    Columns: ``table_name, column_name`` for the first two, ``table_name`` for
    the third, ``bundle_id, table_name`` and ``rule, target`` for the others.
    """

    def qualified(df: DataFrame) -> DataFrame:
        return df.select(F.concat_ws(".", "table_name", "column_name").alias("entity")).distinct()

    def tagged(df: DataFrame, gap: str) -> DataFrame:
        return df.select(F.lit(gap).alias("gap"), "entity")

    tags, listed = qualified(catalog_pii), qualified(policy_pii)
    bundled = bundle_tables.select("table_name").distinct()
    unbundled = catalog_tables.select("table_name").distinct().join(bundled, "table_name", "left_anti")
    ruled = rule_targets.select(F.lower(F.substring_index("target", ".", 1)).alias("_ruled")).distinct()
    bare = bundle_tables.select("bundle_id", "table_name").distinct().join(
        ruled, F.lower("table_name") == F.col("_ruled"), "left_anti"
    )
    return reduce(
        DataFrame.unionByName,
        [
            tagged(tags.join(listed, "entity", "left_anti"), "pii_not_in_policy"),
            tagged(listed.join(tags, "entity", "left_anti"), "pii_not_in_catalog"),
            tagged(unbundled.select(F.col("table_name").alias("entity")), "table_not_in_bundle"),
            tagged(bare.select(F.concat_ws("/", "bundle_id", "table_name").alias("entity")), "table_no_rules"),
        ],
    )


def removal_impact(
    table: str,
    bundles: DataFrame,
    joins: DataFrame,
    rules: DataFrame,
    models: DataFrame,
    edges: DataFrame,
) -> DataFrame:
    """``impact, entity``: what refers to one table.

    ``bundles``: bundle_id, table_name. ``joins``: bundle_id, left_table,
    left_column, right_table, right_column. ``rules``: rule, target.
    ``models``: model, table_name. ``edges``: from_node, to_node.
    """
    holding = bundles.filter(F.col("table_name") == table).select("bundle_id").distinct()
    joined = joins.filter((F.col("left_table") == table) | (F.col("right_table") == table)).join(
        holding, "bundle_id", "left_semi"
    )
    ruled = rules.filter(F.startswith(F.lower("target"), F.lit(table.lower())))
    modelled = models.filter(F.col("table_name") == table)
    lineage_edges = edges.filter(
        (short_name(F.col("from_node")) == table) | (short_name(F.col("to_node")) == table)
    )

    def found(df: DataFrame, impact: str, entity: Column) -> DataFrame:
        return df.select(F.lit(impact).alias("impact"), entity.alias("entity"))

    return reduce(
        DataFrame.unionByName,
        [
            found(holding, "bundle_broken", F.col("bundle_id")),
            found(joined, "join_broken", _join_text()),
            found(ruled, "rule_orphaned", F.col("rule")),
            found(modelled, "model_broken", F.col("model")),
            found(lineage_edges, "lineage_broken", _edge_text()),
        ],
    )


def _join_text() -> Column:
    left = F.concat_ws(".", "left_table", "left_column")
    return F.concat_ws(" = ", left, F.concat_ws(".", "right_table", "right_column"))


def _edge_text() -> Column:
    return F.concat_ws(" → ", short_name(F.col("from_node")), short_name(F.col("to_node")))


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def impact_ranking(
    tables: DataFrame,
    bundles: DataFrame,
    joins: DataFrame,
    rules: DataFrame,
    models: DataFrame,
    edges: DataFrame,
) -> DataFrame:
    """``table_name, bundles, joins, rules, models, edges, total`` for every table.

    Each source is reduced to counts per table before the counts are joined.
    A rule belongs to every table whose name starts its target, so targets
    list their own beginnings and are joined on equality.
    """
    names = tables.select("table_name").distinct()
    holding = bundles.select("bundle_id", "table_name").distinct()

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("table_name").agg(F.count("*").alias(name))

    ends = joins.select(
        "bundle_id", F.explode(F.array_distinct(F.array("left_table", "right_table"))).alias("table_name")
    )
    per_end = ends.groupBy("bundle_id", "table_name").agg(F.count("*").alias("_n"))
    in_bundle = per_end.join(holding, ["bundle_id", "table_name"], "left_semi")
    joins_of = in_bundle.groupBy("table_name").agg(F.sum("_n").alias("joins"))
    lowered = F.lower("target")
    starts = rules.filter(F.length("target") > 0).select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.length("target")), lambda n: F.substring(lowered, F.lit(1), n))
        ).alias("_start")
    )
    starts_of = starts.groupBy("_start").agg(F.count("*").alias("rules"))
    nodes = edges.select(
        F.explode(
            F.array_distinct(F.array(short_name(F.col("from_node")), short_name(F.col("to_node"))))
        ).alias("table_name")
    )
    result = (
        names.join(counted(holding, "bundles"), "table_name", "left")
        .join(joins_of, "table_name", "left")
        .join(starts_of, F.lower("table_name") == F.col("_start"), "left")
        .drop("_start")
        .join(counted(models, "models"), "table_name", "left")
        .join(counted(nodes, "edges"), "table_name", "left")
    )
    kinds = ["bundles", "joins", "rules", "models", "edges"]
    filled = result.select("table_name", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
    return filled.withColumn("total", reduce(lambda a, b: a + b, [F.col(k) for k in kinds]))


def distances(steps: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """``root, node, hops``: the least number of edges from each start up to every node it is fed by.

    ``steps`` has ``from_node, to_node``, ``starts`` a column ``root``. A start
    is 0 hops from itself. Path doubling: known shortest ways are joined end to
    end, so that after each round they are twice as long, and a way that is not
    shorter than the known one is dropped, which ends cycles. First the ways
    between all nodes above the starts are found in as many rounds as the
    logarithm of the longest; ``depth`` bounds their length, ``None`` does not.
    """
    known = cut(
        steps.filter(F.col("from_node") != F.col("to_node"))
        .select(F.col("to_node").alias("root"), F.col("from_node").alias("node"), F.lit(1).alias("hops"))
        .distinct(),
        "lineage",
    )
    longest = 1
    while depth is None or longest < depth:
        first = known.select("root", F.col("node").alias("_mid"), F.col("hops").alias("_first"))
        # ways of up to `longest` edges make all of up to twice as many; one part is always a longest one
        second = known.select(F.col("root").alias("_mid"), "node", F.col("hops").alias("_second"))
        tops = first.filter(F.col("_first") == longest)
        doubled = tops.join(second, "_mid").filter(F.col("root") != F.col("node"))
        doubled = doubled.select("root", "node", (F.col("_first") + F.col("_second")).alias("hops"))
        if depth is not None:
            doubled = doubled.filter(F.col("hops") <= depth)
        shortest = known.unionByName(doubled).groupBy("root", "node").agg(F.min("hops").alias("hops"))
        known = cut(shortest, "lineage")
        longest *= 2
        if known.filter(F.col("hops") == longest).isEmpty():
            break
    own = starts.select("root").distinct()
    reached = known.join(own, "root", "left_semi")
    return own.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).unionByName(reached)


def lineage(edges: DataFrame, roots: DataFrame, depth: int | None = 3) -> DataFrame:
    """``root, from_node, to_node, depth``: upstream edges of every root, nearest depth.

    ``roots`` has a column ``root``; ``depth=None`` follows the edges to their
    end. An edge is as deep as the node it feeds is far from the root, plus
    one. Cycles end.
    """
    steps = edges.select("from_node", "to_node").distinct()
    if depth is not None and depth <= STEPWISE:
        nodes = _stepwise(steps, roots, depth)
    else:
        nodes = distances(steps, roots, None if depth is None else depth - 1)
    found = nodes.join(steps, F.col("node") == F.col("to_node"))
    return found.select("root", "from_node", "to_node", (F.col("hops") + 1).alias("depth"))


#: Up to this depth one join a level from the roots alone is less work than the ways between all nodes.
STEPWISE = 4


def _stepwise(steps: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``root, node, hops`` below ``depth``, one join a level; a node already reached is not gone through again."""
    reached = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct()
    for level in range(1, depth):
        last = reached.filter(F.col("hops") == level - 1)
        further = last.join(steps, F.col("node") == F.col("to_node")).select("root", F.col("from_node").alias("node"))
        # the nearest way counts; both sides combine before they are shuffled
        reached = reached.unionByName(further.withColumn("hops", F.lit(level))).groupBy("root", "node").agg(F.min("hops").alias("hops"))
        # read twice by the next level, so it is written once
        reached = cut(reached, "lineage") if level < depth - 1 else reached
    return reached


def lineage_of(edges: DataFrame, node: str, depth: int = 3) -> DataFrame:
    """Upstream edges of one node under short names."""
    root = edges.filter(F.col("to_node") == node).select(F.col("to_node").alias("root"))
    found = lineage(edges, root, depth)
    return found.select(
        short_name(F.col("from_node")).alias("from_node"), short_name(F.col("to_node")).alias("to_node"), "depth"
    )


def search_glossary(terms: DataFrame, query: str) -> DataFrame:
    """Terms with the query in their name, description or a synonym, ignoring case."""
    needle = F.lit(query.lower())

    def hit(text: Column) -> Column:
        return F.coalesce(F.contains(F.lower(text), needle), F.lit(False))

    synonyms = F.coalesce("synonyms", F.array().cast("array<string>"))
    return terms.filter(hit(F.col("name")) | hit(F.col("description")) | F.exists(synonyms, hit))


def match_context(questions: DataFrame, terms: DataFrame, tables: DataFrame) -> DataFrame:
    """``question_id, table_name, matched_by`` for a table of questions.

    ``terms``: name, synonyms. ``tables``: table_name, description,
    glossary_terms. A question first takes the tables tagged with terms it
    names; a question without any takes tables named in it and tables whose
    description holds its first word of more than three letters.
    """
    asked = cut(questions.select("question_id", F.lower("question").alias("_question")))
    empty = F.array().cast("array<string>")
    names = terms.select(
        F.col("name").alias("term"),
        F.explode(
            F.array_distinct(
                F.transform(F.concat(F.array("name"), F.coalesce("synonyms", empty)), F.lower)
            )
        ).alias("_phrase"),
    )
    named = contains_join(asked, "_question", names.select("_phrase").distinct(), "_phrase", ids=["question_id"])
    question_terms = named.join(names, "_phrase").select("question_id", "term").distinct()
    tags = tables.select("table_name", F.explode("glossary_terms").alias("_tag"))
    tag_texts = tags.select("_tag").distinct()
    tag_terms = contains_join(tag_texts, "_tag", terms.select(F.col("name").alias("term")).distinct(), "term")
    tables_by_term = cut(_by_keys(tag_terms.join(tags, "_tag"), "table_name", "term"))
    tagging = tables_by_term.select(F.explode("_keys").alias("term")).distinct()
    # read for the result and for what is left to match, so it is written once
    by_term = cut(_by_keys(question_terms.join(tagging, "term", "left_semi"), "question_id", "term"))

    # both leave out questions with terms by their ids, so that no text is shuffled for it
    settled = by_term.select("question_id")
    table_names = tables.select("table_name", F.lower("table_name").alias("_name")).distinct()
    by_name = contains_join(asked, "_question", table_names, "_name", ids=["question_id"])
    by_name = by_name.select("question_id", "table_name").distinct().join(settled, "question_id", "left_anti")
    first_word = F.try_element_at(
        F.filter(F.split("_question", " "), lambda w: F.length(w) > 3), F.lit(1)
    )
    words = asked.select("question_id", first_word.alias("_word")).filter(F.col("_word").isNotNull())
    by_first = cut(_by_keys(words.join(settled, "question_id", "left_anti"), "question_id", "_word"))
    tokens = cut(
        tables.select("table_name", F.explode(F.array_distinct(F.split(F.lower("description"), " "))).alias("_token"))
    )
    worded = contains_join(
        tokens.select("_token").distinct(), "_token", by_first.select(F.explode("_keys").alias("_word")).distinct(), "_word", 4
    )
    tables_by_word = cut(_by_keys(worded.join(tokens, "_token"), "table_name", "_word"))
    # a table that a question names and also reaches by its word comes with the word
    both = by_name.join(by_first, "question_id").join(tables_by_word.withColumnRenamed("_keys", "_words"), "table_name")
    by_both = both.filter(F.arrays_overlap("_keys", "_words")).select("question_id", "table_name")
    only_named = by_name.join(by_both, ["question_id", "table_name"], "left_anti")
    by_word = _reached(by_first, tables_by_word)
    return (
        _reached(by_term, tables_by_term)
        .withColumn("matched_by", F.lit("term"))
        .unionByName(only_named.unionByName(by_word).withColumn("matched_by", F.lit("keyword")))
    )


#: Questions, and tables, with the same keys that travel as one row.
TOGETHER, TABLES_TOGETHER = 256, 32
#: Questions and tables of one key that meet in one group, and pairs for each task.
GROUP_QUESTIONS, GROUP_TABLES, TASK_PAIRS = 2048, 4096, 1 << 25


def _by_keys(listed: DataFrame, of: str, key: str) -> DataFrame:
    """One row for each value of ``of``, with its ``_keys`` in order."""
    return listed.groupBy(of).agg(F.sort_array(F.collect_set(key)).alias("_keys"))


def _together(listed: DataFrame, of: str, length: int) -> DataFrame:
    """``_keys, _share, of, _length``: lists of ``length`` values of ``of``, or fewer, with the same keys.

    Values are dealt by hash into some eight lists at a time, so that most are
    full: equal lengths let columns that repeat them be packed alike.
    """
    # written, so that Spark can split the join where many values have the same keys
    shares = cut(listed.groupBy("_keys").agg(F.ceil(F.count("*") / (8 * length)).alias("_shares")))
    share = F.pmod(F.xxhash64(of), F.col("_shares"))
    # lists leave out nulls, so a null is a list of its own
    dealt = listed.join(shares, "_keys").groupBy("_keys", share.alias("_share"), F.isnull(of).alias("_null"))
    members = F.when(F.col("_null"), F.array(F.lit(None).cast(listed.schema[of].dataType))).otherwise(F.col("_of"))
    some = dealt.agg(F.collect_list(of).alias("_of")).withColumn("_of", members)
    starts = F.explode(F.sequence(F.lit(1), F.size("_of"), F.lit(length))).alias("_start")
    cut_up = some.select("_keys", "_share", "_of", starts).withColumn(of, F.slice("_of", F.col("_start"), length))
    return cut_up.select("_keys", F.xxhash64("_keys", "_share", "_start").alias("_share"), of, F.size(of).alias("_length"))


def _reached(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """``question_id, table_name``, each pair once, for the questions and tables whose ``_keys`` share one.

    The pairs are the output and may be far more than both inputs, so they are
    neither shuffled nor compared. Lists of questions with the same keys meet
    lists of tables with the same keys, at the least key that they share, and
    are taken apart last. The questions and tables of a key are dealt out into
    groups, so each side is copied once for some thousands of the other, and a
    task has a bounded number of groups. Pairs come table by table with the same
    questions again and again, which takes little room in columns.
    """
    lists = [cut(_together(asked, "question_id", TOGETHER)), cut(_together(listed, "table_name", TABLES_TOGETHER))]
    asked, listed = [side.select(F.explode("_keys").alias("_key"), *side.columns) for side in lists]
    asked_in, listed_in = [side.groupBy("_key").agg(F.sum("_length").alias(n)) for side, n in ((asked, "_n"), (listed, "_m"))]
    in_groups = [F.ceil(F.col("_n") / GROUP_QUESTIONS).alias("_of_asked"), F.ceil(F.col("_m") / GROUP_TABLES).alias("_of_listed")]
    pairs = (F.col("_n").cast("double") * F.col("_m")).alias("_pairs")
    groups = cut(asked_in.join(listed_in, "_key").select("_key", *in_groups, pairs))
    tasks = (groups.agg(F.sum("_pairs")).first()[0] or 0) / TASK_PAIRS
    parts = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(tasks))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        place = F.pmod(F.col("_share"), F.col(own))
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))
        return side.join(groups.drop("_pairs"), "_key").withColumn(own, place).withColumn(other, copies)

    place = ["_key", "_of_asked", "_of_listed"]
    questions = dealt(asked, "_of_asked", "_of_listed").select(*place, F.col("_keys").alias("_wanted"), "question_id").repartition(parts, *place)
    tables = dealt(listed, "_of_listed", "_of_asked").select(*place, "_keys", "table_name").repartition(parts, *place)
    one_key = (F.size("_keys") == 1) | (F.size("_wanted") == 1)
    first_shared = one_key | (F.array_min(F.array_intersect("_keys", "_wanted")) == F.col("_key"))
    # the lists of questions of a group are the side that is held; Spark also holds the
    # pairs of one row of the other side, so the lists of tables are short
    met = tables.join(questions.hint("merge"), place).filter(first_shared)
    return met.select("question_id", F.explode("table_name").alias("table_name")).select(
        F.explode("question_id").alias("question_id"), "table_name"
    )
