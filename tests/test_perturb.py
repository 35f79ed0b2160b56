"""Noise, jitter and permutation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bendpoint.operators import perturb as N


def test_level_zero_changes_nothing(series):
    df = N.add_noise(series([1, 2, 3]), "series", "index", "value", 0)
    assert df.filter("noise <> value").count() == 0


def test_noise_is_one_sided_and_repeatable(series):
    base = series(np.zeros(500))
    a = N.add_noise(base, "series", "index", "value", 2, seed=1).orderBy("index").toPandas()["noise"]
    b = N.add_noise(base, "series", "index", "value", 2, seed=1).orderBy("index").toPandas()["noise"]
    c = N.add_noise(base, "series", "index", "value", 2, seed=2).orderBy("index").toPandas()["noise"]
    assert (a == b).all() and not (a == c).all()
    assert a.between(0, 2).all() and abs(a.mean() - 1) < 0.1


def test_white_noise_has_the_level_as_sd(series):
    out = N.add_white_noise(series(np.zeros(4000)), "series", "index", "value", 5).toPandas()["noise"]
    assert abs(out.mean()) < 0.3 and abs(out.std() - 5) < 0.3


def test_jitter_amount_follows_the_smallest_gap(series):
    # Range 100: gaps are taken at one decimal; the smallest is 0.5.
    out = N.jitter(series([0, 10, 10.5, 100, 100]), "series", "index", "value", 1.0).toPandas()
    moved = (out["jittered"] - out["value"]).abs()
    assert (moved <= 0.1).all() and moved.max() > 0


def test_jitter_of_a_constant(series):
    out = N.jitter(series([5, 5, 5]), "series", "index", "value", 1.0).toPandas()
    assert ((out["jittered"] - 5).abs() <= 0.1).all()


def test_broken_line(spark):
    line = N.piecewise_linear(spark, [(0, -5), (300, 8), (600, 1)], 600).toPandas().set_index("index")["value"]
    assert len(line) == 600
    assert line[300] == 8 and line[150] == pytest.approx(1.5) and line[600] == 1


def test_permutation_is_a_reordering(series):
    out = N.permute(series(range(50)), "series", "index", "value", seed=9)
    assert sorted(r["sample"] for r in out.collect()) == [float(i) for i in range(50)]
    assert out.filter(F.col("sample") != F.col("value")).count() > 30
