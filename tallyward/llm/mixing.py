"""Mixing sources to target weights by Poisson replication.

A source that should make up the share ``w`` of the mixture gets the rate
``w * total / size of the source``, sizes in characters. Each row then appears
as often as a Poisson variable with that mean, found by inverting the
distribution at a number between 0 and 1 that is hashed from the seed and the
row itself. So a row's count depends on nothing but the row, its source's rate
and the seed: tasks can be repeated, and partitions need not agree on anything.
Copies are dealt out by a second hash, which is the global shuffle: partitions
and the order inside them both follow it.

Rates come from one combined sum per source, written out so that its size is
known: Spark broadcasts it below its own limit and otherwise joins by shuffle,
where a source with a third of all rows is split.

Defined cases: null and empty texts have size zero and are drawn at their
source's rate; a null source is a source of its own; a source whose size is
zero has rate zero, and if all sizes or weights are zero, every row has rate
one; a source without a target weight has rate zero; rows with equal id and
source get equal counts; an empty table gives an empty result; other columns
are carried. Columns named ``copy``, ``copies`` or ``place`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import stored, whole


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts; 52 bits, the same in any engine with md5."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """``source, rate``: mean copies per row.

    Without ``weights`` a source weighs its size to the power ``temperature``,
    which lifts small sources and holds back large ones.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length(whole()).cast("bigint")).alias("size"))
    if weights is None:
        weight = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(temperature))).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, float(value)).otherwise(weight)
    sized = sizes.select("source", "size", weight.alias("weight"))
    total = sized.agg(F.sum("size").alias("all"), F.sum("weight").alias("weights")).first()
    if not total["all"] or not total["weights"]:
        return sized.select("source", F.lit(1.0).alias("rate"))
    share = F.col("weight") / F.lit(float(total["weights"]))
    rate = F.when(F.col("size") > 0, share * F.lit(float(total["all"])) / F.col("size")).otherwise(0.0)
    return sized.select("source", rate.alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """``low, steps``: a whole number, and P(X <= low), P(X <= low + 1), ...

    Weights follow from each other outwards from the mode, where the weight is
    one, and are divided by their sum, so no rate is too large for them. Both
    ends lie where the rest weighs less than the 52 bits of the uniform number
    can show; there are about 24 * sqrt(rate) steps.
    """
    mode = F.floor(rate).cast("bigint")
    reach = 12.0 * F.sqrt(rate) + 24.0
    low = F.greatest(F.lit(0), F.floor(rate - reach)).cast("bigint")
    many = F.ceil(rate + reach).cast("bigint")
    one = F.array(F.lit(1.0))
    down = F.when(mode > low, F.sequence(mode, low + 1, F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    lower = F.aggregate(down, one, lambda a, k: F.concat(F.array(F.element_at(a, 1) * k / rate), a))
    upper = F.aggregate(F.sequence(mode + 1, many), one, lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * rate / k)))
    weights = F.concat(lower, F.slice(upper, 2, F.size(upper)))
    upto = F.aggregate(
        weights,
        F.array().cast("array<double>"),
        lambda a, w: F.concat(a, F.array(F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(0.0) + w)),
    )
    # the sums are named by a lambda, or they would be worked out anew for each step
    shares = F.get(F.transform(F.array(upto), lambda u: F.transform(u, lambda c: c / F.element_at(u, -1))), F.lit(0))
    return F.struct(low.alias("low"), shares.alias("steps"))


def mixed(
    docs: DataFrame,
    seed: int = 17,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
) -> DataFrame:
    """All columns of ``docs`` plus ``copy`` (1, 2, ...), ``copies`` and ``place`` (the shuffle order)."""
    docs = docs.drop("copy", "copies", "place")
    rates = source_rates(docs, weights, temperature)
    steps = stored(rates.select(F.col("source").alias("_source"), poisson_steps(F.col("rate")).alias("_steps")), "rates")
    joined = docs.join(steps, docs.source.eqNullSafe(steps._source), "left")
    u = uniform(F.lit(seed), F.lit("n"), F.col("doc_id"), F.col("source"))
    copies = F.col("_steps.low") + F.size(F.filter("_steps.steps", lambda c: c <= F.col("_u")))
    counted = joined.withColumn("_u", u).withColumn("_copies", copies)
    each = counted.withColumn(
        "copy", F.explode(F.when(F.col("_copies") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    ).select(*docs.columns, "copy", F.col("_copies").alias("copies"))
    placed = each.withColumn("place", uniform(F.lit(seed), F.lit("p"), F.col("doc_id"), F.col("source"), F.col("copy")))
    return placed.repartition("place").sortWithinPartitions("place", "doc_id", "copy")
