"""Paired areas, posterior densities, intervals of RMSEA, chains of imputation, datasets: against numpy."""

import math

import numpy as np
import pytest

from statloom.operators import association as A
from statloom.operators import inference as I
from statloom.operators import multivariate as V
from statloom.sources import cases as S

rng = np.random.default_rng(31)


def placements(s, y):
    wins = (s[y][:, None] > s[~y][None, :]) + 0.5 * (s[y][:, None] == s[~y][None, :])
    return wins.mean(axis=1), wins.mean(axis=0)


def test_paired_areas_equal_all_pairs(spark):
    y = rng.random(150) < 0.4
    a = np.round(y + rng.normal(0, 1, 150), 1)  # many ties
    b = np.round(0.5 * a + 0.3 * y + rng.normal(0, 0.6, 150), 1)
    rows = [(float(p), float(q), "yes" if t else "no") for p, q, t in zip(a, b, y, strict=True)]
    d = spark.createDataFrame([*rows, (None, 1.0, "yes"), (1.0, None, "no"), (1.0, 1.0, None)], "a double, b double, truth string").repartition(5)
    got = A.compare_auc_paired(d, "a", "b", "truth", "yes").first()
    (pa, na), (pb, nb) = placements(a, y), placements(b, y)
    cov = np.cov(pa, pb) / y.sum() + np.cov(na, nb) / (~y).sum()
    se = math.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    assert [got["n_pos"], got["n_neg"]] == [y.sum(), (~y).sum()]
    want = [pa.mean(), pb.mean(), math.sqrt(cov[0, 0]), math.sqrt(cov[1, 1]), cov[0, 1], pa.mean() - pb.mean(), se]
    assert [got[k] for k in ("auc_a", "auc_b", "se_a", "se_b", "cov", "diff", "se")] == pytest.approx(want, rel=1e-9)
    assert got["p"] == pytest.approx(math.erfc(abs(want[5] / se) / math.sqrt(2)), abs=1e-6)


def test_paired_areas_without_a_difference(spark):
    d = spark.createDataFrame([(1.0, 2.0, "n"), (2.0, 3.0, "p"), (3.0, 5.0, "n"), (4.0, 9.0, "p")], "a double, b double, truth string")
    got = A.compare_auc_paired(d, "a", "b", "truth", "p").first()
    assert got["diff"] == 0 and got["se"] is None and got["p"] is None
    none = A.compare_auc_paired(d.where("truth = 'p'"), "a", "b", "truth", "p").first()
    assert none["auc_a"] is None and none["p"] is None
    assert A.compare_auc_paired(d.where("false"), "a", "b", "truth", "p").count() == 1


def simpson(y, x):
    w = np.ones(len(x))
    w[1:-1:2], w[2:-1:2] = 4, 2
    return (x[1] - x[0]) / 3 * (w * y).sum()


@pytest.mark.parametrize("gap, n", [(0.0, 6), (0.9, 9), (2.5, 40)])
def test_posterior_effect(spark, gap, n):
    a, b = rng.normal(gap, 1, n), rng.normal(0, 1, n + 2)
    d = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    rows = I.posterior_effect(d, "v", "g").orderBy("i").collect()
    x, post = np.array([r["delta"] for r in rows]), np.array([r["posterior"] for r in rows])
    assert simpson(post, x) == pytest.approx(1, abs=1e-6)
    # density by brute force over a finer scale
    v, ne = 2 * n, n * (n + 2) / (2 * n + 2)
    sp = math.sqrt((a.var(ddof=1) * (n - 1) + b.var(ddof=1) * (n + 1)) / v)
    t = (a.mean() - b.mean()) / sp * math.sqrt(ne)
    s = np.linspace(1e-6, 6, 20001)
    chi = np.exp((v - 1) * np.log(s) - v * s * s / 2 - ((v - 1) * 0 + np.max((v - 1) * np.log(s) - v * s * s / 2)))
    like = np.array([(s * chi * np.exp(-((t * s - u * math.sqrt(ne)) ** 2) / 2)).sum() for u in x])
    raw = like / (1 + (x / 0.707) ** 2)
    assert post == pytest.approx(raw / simpson(raw, x), abs=1e-6 * post.max())
    inside = np.array([r["inside"] for r in rows])
    assert post[inside].min() >= post[~inside].max()
    assert 0.95 <= post[inside].sum() * (x[1] - x[0]) < 0.95 + post.max() * (x[1] - x[0])
    # at no effect the density over its prior is the Bayes factor for none
    at0 = np.exp(np.interp(0.0, x, np.log(post))) / (1 / (math.pi * 0.707))
    if x[0] < 0 < x[-1] and post[np.abs(x).argmin()] > 1e-4 * post.max():
        assert at0 == pytest.approx(I.bayes_ttest(d, "v", "g").first()["bf01"], rel=5e-3)


def test_bayes_factors_against_integrals(spark):
    a, b = rng.normal(0.8, 1, 12), rng.normal(0, 1, 15)
    d = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    got = I.bayes_ttest(d, "v", "g").first()
    v, ne = 25, 12 * 15 / 27
    g = np.exp(np.linspace(-12, 40, 400_001))
    k = 1 + ne * g * 0.707**2
    like = k**-0.5 * (1 + got["t"] ** 2 / (k * v)) ** (-(v + 1) / 2) / (1 + got["t"] ** 2 / v) ** (-(v + 1) / 2)
    f = like * g**-1.5 * np.exp(-0.5 / g) / math.sqrt(2 * math.pi) * g
    assert got["bf10"] == pytest.approx(simpson(f, np.linspace(-12, 40, 400_001)), rel=1e-6)
    x, y = a, 0.6 * a + rng.normal(0, 0.7, 12)
    two = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    got, r = I.bayes_correlation(two, "x", "y").first(), np.corrcoef(x, y)[0, 1]
    rho = np.linspace(-1, 1, 200_001)[1:-1]
    f = (1 - rho**2) ** 5.5 / (1 - r * rho) ** 10.5 / 2
    assert got["bf10"] == pytest.approx(f.sum() * (rho[1] - rho[0]), rel=1e-5)


def test_posterior_of_a_mean(spark):
    v = rng.normal(5, 2, 25)
    rows = I.posterior_normal(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", width=30.0).orderBy("i").collect()
    x, post = np.array([r["x"] for r in rows]), np.array([r["posterior"] for r in rows])
    assert simpson(post, x) == pytest.approx(1, abs=1e-6)
    assert simpson(post * x, x) == pytest.approx(25 * v.mean() / 25.01, abs=1e-5)


@pytest.mark.parametrize("x, v, lam", [(12.0, 5, 4.0), (80.0, 19, 0.0), (350.0, 20, 310.0), (3.0, 1, 2.5), (9000.0, 400, 8800.0)])
def test_noncentral_chi_squared(x, v, lam):
    draws = np.random.default_rng(5).noncentral_chisquare(v, lam, 2_000_000) if lam else np.random.default_rng(5).chisquare(v, 2_000_000)
    assert V._ncchi2_cdf(x, v, lam) == pytest.approx((draws <= x).mean(), abs=1.5e-3)
    for p in (0.95, 0.05):
        found = V.noncentrality(x, v, p)
        assert V._ncchi2_cdf(x, v, found) == pytest.approx(p, abs=1e-7) or (found == 0 and V._ncchi2_cdf(x, v, 0.0) <= p)


def test_interval_of_rmsea(spark):
    f = rng.normal(0, 1, (300, 2))
    z = np.column_stack([f[:, i // 3] * 0.7 + rng.normal(0, 0.7, 300) for i in range(6)])
    z[:, 0] += 0.2 * z[:, 5]
    names = [f"x{i}" for i in range(6)]
    d = spark.createDataFrame(z.tolist(), ", ".join(f"{n} double" for n in names))
    r = V.cfa(d, {"a": names[:3], "b": names[3:]}).collect()
    c, load = np.corrcoef(z.T), np.zeros((6, 2))
    for j in range(2):
        w, e = np.linalg.eigh(c[3 * j : 3 * j + 3, 3 * j : 3 * j + 3])
        load[3 * j : 3 * j + 3, j] = e[:, -1] * np.sqrt(w[-1]) * np.sign(e[:, -1].sum())
    assert [abs(x["loading"]) for x in r] == pytest.approx(np.abs(load.sum(axis=1)), rel=1e-9)
    low = np.tril_indices(6, -1)
    chi = 299 * ((c - load @ load.T)[low] ** 2).sum()
    assert r[0]["chi2"] == pytest.approx(chi, rel=1e-9) and r[0]["df"] == 9
    assert r[0]["rmsea_lo"] <= r[0]["rmsea"] <= r[0]["rmsea_hi"]
    assert V._ncchi2_cdf(chi, 9, r[0]["rmsea_hi"] ** 2 * 9 * 299) == pytest.approx(0.05, abs=1e-7)


@pytest.mark.parametrize("method", ["pmm", "normal"])
def test_chains_of_imputation(spark, method):
    x = rng.normal(10, 3, 200)
    y = np.where(rng.random(200) < 0.3, np.nan, 2 * x + rng.normal(0, 1, 200))
    rows = [(i, float(p), None if math.isnan(q) else float(q), float(p - i % 5)) for i, (p, q) in enumerate(zip(x, y, strict=True))]
    d = spark.createDataFrame(rows, "id long, x double, y double, w double")
    got = I.mice_convergence(d, ["x", "y", "w"], "id", sets=3, method=method, cycles=4, seed=2).orderBy("m", "cycle").collect()
    assert {r["variable"] for r in got} == {"y"} and [(r["m"], r["cycle"]) for r in got] == [(m, c) for m in (1, 2, 3) for c in (1, 2, 3, 4)]
    means = np.array([r["mean"] for r in got]).reshape(3, 4)
    within = means.var(axis=1, ddof=1).mean()
    assert [r["rhat"] for r in got] == pytest.approx([math.sqrt(3 / 4 + means.mean(axis=1).var(ddof=1) / within)] * 12)
    done = I.mice(d, ["x", "y", "w"], "id", sets=3, method=method, cycles=4, seed=2).collect()
    lost = {r[0] for r in rows if r[2] is None}
    for m in (1, 2, 3):
        made = [r["y"] for r in done if r["m"] == m and r["id"] in lost]
        assert [np.mean(made), np.std(made, ddof=1)] == pytest.approx([r for q in got if q["m"] == m and q["cycle"] == 4 for r in (q["mean"], q["sd"])])
    # y is 2 x and unit noise
    one = np.array([(r["x"], r["y"]) for r in done if r["m"] == 1])
    assert np.polyfit(one[:, 0], one[:, 1], 1)[0] == pytest.approx(2, abs=0.15)
    assert I.mice_convergence(d, ["x", "w"], "id", sets=2, cycles=1).count() == 0


def test_datasets_over_two_sessions(spark, tmp_path):
    path = f"file://{tmp_path}/sets"
    one = S.Datasets(spark, path)
    assert one.names() == [] and one.active() is None
    one.add("a b", spark.range(3))
    one.add("b", spark.range(5))
    two = S.Datasets(spark.newSession(), path)
    assert two.names() == ["a b", "b"] and two.active() == "b" and two.get().count() == 5
    two.switch("a b")
    assert one.get().count() == 3
    one.replace("a b", one.get().where("id > 0"))
    one.rename("a b", "ä/…")
    assert two.active() == "ä/…" and two.get().count() == 2
    with pytest.raises(ValueError):
        two.add("b", spark.range(1))
    with pytest.raises(ValueError):
        two.rename("ä/…", "b")
    with pytest.raises(KeyError):
        two.switch("a b")
    version, state = two._state()
    one.delete("ä/…")
    with pytest.raises(Exception, match="(?i)exist"):
        two._commit(version, state)  # another driver was first
    assert two.names() == ["b"] and two.active() == "b"
    with pytest.raises(ValueError):
        one.delete("b")
    one.vacuum()
    assert len(list((tmp_path / "sets" / "tables").iterdir())) == 1 and two.get().count() == 5
    # a version that was never finished is not read
    (tmp_path / "sets" / "catalogue" / "00000099").mkdir()
    assert one.names() == ["b"]
