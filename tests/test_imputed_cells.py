"""Chained equations by counts of cells: the same values as by sorted predictions, in few passes; pooling without completed copies."""

import numpy as np
import pytest

from statloom.operators import inference as I
from statloom.plans import stats

NAMES = ["a", "b", "c"]


def _cases(spark, order, parts):
    g = np.random.default_rng(11)
    n = 4000
    a = g.integers(0, 9, n) * 0.5
    b = np.round(a + g.normal(0, 1, n))
    c = g.integers(0, 5, n) / 10
    c[n // 2] = 7.5  # a value, and with it cells, that one case in the middle has
    x = np.stack([a, b, c], axis=1)
    x[g.random((n, 3)) < 0.2] = np.nan
    x[n // 2] = a[n // 2], b[n // 2], 7.5
    if order == "sorted":
        x = x[np.lexsort(x.T)]
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(parts, "id")


@pytest.mark.parametrize("order, edges", [("mixed", (128, 4096)), ("mixed", (1, 2)), ("sorted", (1, 4))])
def test_cells_give_the_values_of_sorted_predictions(spark, monkeypatch, order, edges):
    d = _cases(spark, order, 5).cache()
    monkeypatch.setattr(I, "CELLS", 0)
    want = {(r["m"], r["id"]): tuple(r) for r in I.mice(d, NAMES, "id", sets=2, cycles=1).collect()}
    monkeypatch.setattr(I, "CELLS", 1 << 15)
    monkeypatch.setattr(I, "EDGES", edges)
    searched, ends = [], I._ends
    monkeypatch.setattr(I, "_ends", lambda *a: searched.append(a) or ends(*a))
    got = {(r["m"], r["id"]): tuple(r) for r in I.mice(d, NAMES, "id", sets=2, cycles=1).collect()}
    assert len(got) == 8000 and got == want
    assert bool(searched) == (edges != (128, 4096))


def test_a_step_writes_nothing_and_pooling_makes_no_copies(spark, monkeypatch):
    d = _cases(spark, "mixed", 3).cache()
    written, cut = [], I.cut

    def counted(df, name):
        written.append(name)
        return cut(df, name)

    monkeypatch.setattr(I, "cut", counted)
    monkeypatch.setattr(stats, "cut", counted)
    got = {r["variable"]: r for r in I.mice_pooled(d, NAMES, sets=3, cycles=2).collect()}
    # all cases, the ends of complete ones, the incomplete ones, and these again after the first cycle
    assert written == ["mice", "ends", "mice", "mice"]
    want = I.pool(I.mice(d, NAMES, "id", sets=3, cycles=2), NAMES).collect()
    assert len(want) == 3 and all(got[r["variable"]][1:] == pytest.approx(r[1:], rel=1e-9) for r in want)


def test_pooled_without_missing_values_and_with_many_values(spark):
    d = _cases(spark, "mixed", 2).dropna().cache()
    for r in I.mice_pooled(d, NAMES, sets=2).collect():
        assert r["between"] == 0 and r["within"] == pytest.approx(d.agg({r["variable"]: "variance"}).first()[0] / d.count())
    g = np.random.default_rng(3)
    x = g.normal(size=300)
    rows = [(i, float(v), None if i % 4 == 0 else float(v + g.normal())) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "id long, x double, y double").repartition(2, "id").cache()
    for method in ("pmm", "normal"):
        got = I.mice_pooled(d, ["x", "y"], sets=2, method=method, cycles=2, seed=3).orderBy("variable").collect()
        want = I.pool(I.mice(d, ["x", "y"], "id", sets=2, method=method, cycles=2, seed=3), ["x", "y"]).orderBy("variable").collect()
        assert all(a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9) for a, b in zip(got, want, strict=True))
