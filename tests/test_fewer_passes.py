"""Procedures that read their cases once give what plain formulas give."""

from math import lgamma

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.operators import descriptive, means, regression


def test_derivatives_of_the_gamma_function(spark):
    xs = [1e-3, 0.3, 1.0, 2.5, 40.0, 1e4]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    got = d.select("x", special.digamma(F.col("x")).alias("d"), special.trigamma(F.col("x")).alias("t")).orderBy("x").collect()
    euler = 0.57721566490153286
    assert got[2]["d"] == pytest.approx(-euler, abs=1e-13) and got[2]["t"] == pytest.approx(np.pi**2 / 6, rel=1e-13)
    for r in got:
        h = 1e-4 * r["x"]
        assert r["d"] == pytest.approx((lgamma(r["x"] + h) - lgamma(r["x"] - h)) / (2 * h), rel=1e-6)
        # recurrences: one step up
        up = d.where(F.col("x") == r["x"]).select(special.digamma(F.col("x") + 1), special.trigamma(F.col("x") + 1)).first()
        assert up[0] - r["d"] == pytest.approx(1 / r["x"], rel=1e-10) and r["t"] - up[1] == pytest.approx(1 / r["x"] ** 2, rel=1e-7)


@pytest.mark.parametrize("theta", [0.6, 5.0])
def test_negative_binomial_is_at_its_maximum(spark, theta):
    g = np.random.default_rng(11)
    x = g.integers(0, 9, 3000) / 4.0
    y = g.negative_binomial(theta, theta / (theta + np.exp(0.4 + 0.5 * x)))
    got = regression.negative_binomial(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y long"), "y", ["x"]).collect()
    b = {r["term"]: r["b"] for r in got}

    def ll(b0, b1, log_th):
        th, mu = np.exp(log_th), np.exp(b0 + b1 * x)
        return sum(lgamma(v + th) - lgamma(v + 1) for v in y) - len(y) * lgamma(th) + (th * np.log(th) + y * np.log(mu) - (y + th) * np.log(mu + th)).sum()

    at = np.array([b["(constant)"], b["x"], np.log(got[0]["theta"])])
    assert got[0]["ll"] == pytest.approx(ll(*at), rel=1e-10)
    for i in range(3):
        h = np.eye(3)[i] * 1e-4
        slope, bend = (ll(*(at + h)) - ll(*(at - h))) / 2e-4, (ll(*(at + h)) + ll(*(at - h)) - 2 * ll(*at)) / 1e-8
        assert bend < 0 and abs(slope / bend) < 1e-5  # what a further step would move


def test_counts_without_extra_spread_end_at_the_bound(spark):
    d = spark.range(2000).select((F.col("id") % 5).cast("double").alias("x"), F.lit(3).alias("y"))
    got = regression.negative_binomial(d, "y", ["x"]).collect()
    assert got[0]["theta"] == pytest.approx(1e4) and got[0]["b"] == pytest.approx(np.log(3), abs=1e-6)


def test_small_and_large_tables_of_levels_agree(spark, monkeypatch):
    g = np.random.default_rng(3)
    d = spark.createDataFrame(list(zip(map(str, g.integers(0, 4, 300)), map(str, g.geometric(0.4, 300)), strict=True)), "a string, b string")
    near = descriptive.chi_square(d, "a", "b").first()
    monkeypatch.setattr(descriptive, "FEW_CELLS", 2)
    far = descriptive.chi_square(d, "a", "b").first()
    assert near.asDict() == pytest.approx(far.asDict()) and near["low_cells"] > 0
    none = d.limit(0)
    assert descriptive.chi_square(none, "a", "b").first()["n"] == 0


def test_deviations_from_counts(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 2.0), ("b", 9.0), ("b", 2.5), ("b", 2.5), ("c", 5.0), (None, 3.0), ("a", None)]
    got = means.levene(spark.createDataFrame(rows, "g string, v double"), "v", "g").first()
    dev = [np.abs(np.array(v) - np.median(v)) for v in ([1, 1, 4], [2, 9, 2.5, 2.5])]
    all_ = np.concatenate(dev)
    between = sum(len(v) * (v.mean() - all_.mean()) ** 2 for v in dev)
    within = sum(((v - v.mean()) ** 2).sum() for v in dev)
    assert (got["k"], got["n"]) == (2, 7) and [got["ss_b"], got["ss_w"]] == pytest.approx([between, within])


def test_describe_odd_columns(spark):
    d = spark.createDataFrame([(2.0, None), (1.0, None), (2.0, None), (1.0, None), (3.0, None), (4.0, None), (4.0, None), (5.0, None), (5.0, None), (90.0, None)], "v double, none double")
    got = descriptive.describe(d, "v").first()
    assert (got["mode"], got["median"], got["outlier_count"]) == ("1.0, 2.0, 4.0", 3.5, 1)
    got = descriptive.describe(d, "none").first()
    assert (got["n"], got["missing"], got["median"], got["outlier_count"]) == (0, 10, None, 0)
