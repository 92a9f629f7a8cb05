"""Chained equations write no more than the incomplete cases; donors against a plain sort."""

import math

import numpy as np

from statloom.operators import inference as I
from statloom.plans import stats


def test_imputation_rewrites_incomplete_cases_alone(spark, monkeypatch):
    n = 3000
    rows = [(i, float(i % 10), float(i % 10 + i % 3) if i % 5 else None) for i in range(n)]
    d = spark.createDataFrame(rows, "id long, x double, y double")
    written, cut = [], I.cut

    def counted(df, name):
        out = cut(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(I, "cut", counted)
    monkeypatch.setattr(stats, "cut", counted)
    done = I.mice(d, ["x", "y"], "id", sets=2, cycles=2).collect()
    assert written[0] == ("mice", n) and all(k == n // 5 for name, k in written[1:] if name == "mice")
    # ten predictions a set, whatever the number of cases
    assert max(k for name, k in written[1:] if name != "mice") <= 20
    assert len(done) == 2 * n and all(r["y"] is not None for r in done)


def test_donors_as_by_sorting(spark):
    g = np.random.default_rng(5)
    p, v = g.integers(0, 40, (2, 900)) / 8, g.normal(size=900)
    v[g.random(900) < 0.3] = np.nan
    v[p[0] == 2] = np.nan  # a prediction that no observed case has
    rows = [(m, float(p[m, i]), i, None if math.isnan(v[i]) else float(v[i])) for m in (0, 1) for i in range(900)]
    both = I._ends(spark.createDataFrame(rows, "m int, p double, id long, value double").repartition(5), ["m", "p"])
    seen = int((~np.isnan(v)).sum())
    got = {(r["m"], r["p"]): r["donors"] for r in I._donors(both, seen).collect()}
    for m in (0, 1):
        line = [i for i in np.lexsort((np.arange(900), p[m])) if not math.isnan(v[i])]
        for q in {p[m, i] for i in range(900) if math.isnan(v[i])}:
            upto = sum(p[m, i] <= q for i in line)
            assert got[m, q] == [v[line[max(1, min(seen, upto + off)) - 1]] for off in range(-2, 3)]
    assert len(got) == len({(m, p[m, i]) for m in (0, 1) for i in range(900) if math.isnan(v[i])})
