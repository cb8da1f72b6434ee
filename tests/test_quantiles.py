"""Distributed selection against ``percentile``."""

import random

import pytest
from pyspark.sql import functions as F

from trackspark.functions import quantiles
from trackspark.functions.quantiles import exact_quantiles


@pytest.mark.parametrize("ranges,few", [(1024, 4096), (4, 3), (2, 1)])
def test_equal_to_percentile(spark, monkeypatch, ranges, few):
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    monkeypatch.setattr(quantiles, "FEW", few)
    r = random.Random(ranges)
    columns = {
        "plain": [r.uniform(-5, 5) for _ in range(60)],
        "tied": [r.choice((1.0, 1.0, 1.0, 2.0, -3.5)) for _ in range(60)],
        "wide": [r.choice((-1, 1)) * 10 ** r.uniform(-250, 250) for _ in range(57)] + [0.0, 1e308, -1e308],
        "near": [1 + k * 2.0**-52 for k in range(60)],
        "gaps": [None if r.random() < 0.5 else float("nan") if r.random() < 0.2 else float(r.randint(0, 9)) for _ in range(60)],
        "one": [7.25] + [None] * 59,
        "none": [None] * 60,
    }
    frame = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).coalesce(2)
    shares = (0.0, 0.33, 0.5, 0.99, 1.0)
    got = exact_quantiles(frame, {f"{c}{p}": (c, p) for c in columns for p in shares})
    clean = frame.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns))
    want = clean.agg(*(F.percentile(c, F.lit(p)).alias(f"{c}{p}") for c in columns for p in shares)).first().asDict()
    assert got == want


def test_the_work_of_a_pass_is_bounded(spark):
    """Many different values: what is fetched at the end is less than FEW of them."""
    frame = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    want = frame.agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.77)))).first()[0]
    assert list(exact_quantiles(frame, {str(p): ("x", p) for p in (0.1, 0.5, 0.77)}).values()) == want
