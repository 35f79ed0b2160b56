"""The single mean-and-variance split against brute force."""

import math

import numpy as np
import pytest

from bendpoint.operators import segments as S


def test_single_split(spark):
    rng = np.random.default_rng(0)
    step = np.r_[rng.normal(0, 1, 200), rng.normal(5, 1, 200)]
    plain = rng.normal(0, 1, 300)
    rows = [(k, i, float(x)) for k, v in (("step", step), ("plain", plain)) for i, x in enumerate(v, start=1)]
    df = spark.createDataFrame(rows, "series string, index long, value double")
    out = {r["series"]: r for r in S.meanvar_split(df, "series", "index", "value", index="index").collect()}
    assert abs(out["step"]["tau"] - 200) <= 2 and out["step"]["accepted"]
    assert not out["plain"]["accepted"]

    def cost(v, t):
        n = len(v)
        return t * math.log(v[:t].var()) + (n - t) * math.log(v[t:].var()) + math.log(t) + math.log(n - t)

    best = min(range(2, 399), key=lambda t: cost(step, t))
    assert out["step"]["tau"] == best
    assert out["step"]["cost"] == pytest.approx(cost(step, best))
    assert out["step"]["null_cost"] == pytest.approx(400 * math.log(step.var()))


def test_short_series_have_no_split(spark):
    df = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0)], "series string, index long, value double")
    row = S.meanvar_split(df, "series", "index", "value", index="index").first()
    assert row["tau"] is None
