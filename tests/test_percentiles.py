"""Exact percentiles by sketches against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.operators import quality

AT = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}


def check(got, groups):
    got = {r["g"]: r for r in got.collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for name, q in AT.items():
            assert got[g][name] == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-12), (g, name)


def test_small_and_odd_groups(spark):
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 9 + [6.0], None: [1.0, -4.5, 2.0], "ends": [float("-inf"), 0.0, float("inf")][1:2]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("nothing", None), ("two", float("nan"))]
    check(quality.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", AT), groups)
    empty = spark.createDataFrame([], "g string, x double")
    assert quality.percentiles(empty, ["g"], "x", AT).count() == 0 and quality.percentiles(empty, [], "x", AT).count() == 0


@pytest.mark.parametrize("margin, sketch", [(0.03, 400), (0.0005, 8)])
def test_brackets_narrow_and_missed_ones_widen(spark, monkeypatch, margin, sketch):
    monkeypatch.setattr(quality, "MOST", 50)
    monkeypatch.setattr(quality, "MARGIN", margin)
    monkeypatch.setattr(quality, "SKETCH", sketch)
    rng = np.random.default_rng(3)
    groups = {"even": rng.random(6000), "steep": rng.lognormal(0, 3, 3000), "tied": rng.integers(0, 4, 4000).astype(float), "few": rng.random(7)}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, x double").withColumn("batch", F.hash("x") % 5)
    kept = quality.sketches(rows, ["g", "batch"], "x")
    check(quality.percentiles(rows, ["g"], "x", AT, kept), groups)
