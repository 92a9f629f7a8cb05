"""The bootstrap of mediation: its tasks, its weights and equal cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import regression as R
from statloom.plans import stats


def test_bootstrap_is_dealt_out_and_weighs_copies(spark):
    g = np.random.default_rng(8)
    x = g.normal(size=400)
    m = x + g.normal(size=400)
    y = m + g.normal(size=400)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, m, y, strict=True)]
    one = spark.createDataFrame(rows, "x double, m double, y double").coalesce(1)
    tasks = []
    names = ["x", "y", "m0"]
    own = stats.numbers(one, dict(zip(names, ["x", "y", "m"], strict=True)))

    def seen(d, *rest):
        tasks.append(d.select(F.spark_partition_id()).distinct().count())
        return real(d, *rest)

    real = R._resampled
    R._resampled = seen
    try:
        first = R.mediation(one, "x", ["m"], "y", boots=300).first()
        copies = R.mediation(one.unionAll(one).unionAll(one).unionAll(one), "x", ["m"], "y", boots=300).first()
    finally:
        R._resampled = real
    assert own.rdd.getNumPartitions() == 1 and min(tasks) > 4
    # four times the cases, half the width
    assert (copies["boot_hi"] - copies["boot_lo"]) / (first["boot_hi"] - first["boot_lo"]) == pytest.approx(0.5, abs=0.12)
    w = R._poisson(np.random.default_rng(2), (1000, 1000)).ravel()
    assert [(w == k).mean() for k in range(6)] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(6)], abs=2e-3)
