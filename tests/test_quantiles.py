"""Exact quantiles of whole tables against numpy; no task holds all values."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tideline.operators.tables import quantiles

SF = "/root/testdata/sf0.001"


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString() + d._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_quantiles_are_exact(spark, size):
    x = np.random.default_rng(size).integers(0, 40, size) / 8 - 2
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 3, "x double").repartition(5)
    shares = [0.0, 0.13, 0.2, 0.5, 1.0]
    assert quantiles(d, "x", shares).first().q == pytest.approx(np.quantile(x, shares))
    assert quantiles(d.where("x is null"), "x", shares).first().q == []


def test_no_row_holds_all_gaps(spark):
    """`percentile` keeps a map of all distinct gaps in one task."""
    for name in ("selective_accuracy", "pair_accuracy_by_quantile"):
        assert "percentile" not in plan(entry.queries()[name](spark, SF)).lower()
