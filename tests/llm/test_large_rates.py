"""Poisson draws of large rates."""

import math

import pytest

from tallyward.llm import mixing


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 37.5, 399.0, 760.0, 3000.0, 20_000.0])
def test_steps_are_those_of_the_distribution(spark, rate):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(rate,)], "rate double").select(mixing.poisson_steps(F.col("rate")).alias("s")).first().s
    upto = 0.0
    for k, step in enumerate(got.steps, got.low):
        upto += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else float(k == 0)
        assert abs(step - upto) < 1e-8
    assert got.steps[-1] == 1.0


@pytest.mark.parametrize("rate", [760, 3000])
def test_a_large_rate_is_met(spark, rate):
    # 100 rows of 1 character and one that makes the whole so long that each of the 100 is drawn at the rate
    docs = spark.range(100).selectExpr("id as doc_id", "'small' as source", "'x' as text")
    docs = docs.union(spark.range(1).selectExpr("100L", "'large'", f"repeat('x', {100 * (2 * rate - 1)})"))
    rates = {r.source: r.rate for r in mixing.source_rates(docs, {"small": 1.0, "large": 1.0}).collect()}
    assert math.isclose(rates["small"], rate)
    rows = mixing.mixed(docs, weights={"small": 1.0, "large": 1.0})
    counts = [r.copies for r in rows.filter("source = 'small'").select("doc_id", "copies").distinct().collect()]
    mean = sum(counts) / 100
    assert abs(mean - rate) < 5 * math.sqrt(rate / 100)
    assert 0.5 < sum((c - mean) ** 2 for c in counts) / 99 / rate < 1.7
