"""Values of approximate models against plain numpy on seeded cases."""

import numpy as np
import pytest

from statloom.operators import inference, multivariate, series

rng = np.random.default_rng(77)


def first_component(r):
    values, vectors = np.linalg.eigh(r)
    return vectors[:, -1] * np.sqrt(values[-1]) * np.sign(vectors[:, -1].sum())


def table(spark, x, names):
    return spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names))


def test_structural_model(spark):
    n = 400
    a = rng.normal(size=n)
    b = 0.6 * a + 0.8 * rng.normal(size=n)
    c = 0.5 * b + 0.9 * rng.normal(size=n)
    x = np.column_stack([f + rng.normal(0, 0.6, n) for f in (a, a, a, b, b, c, c, c)])
    names = [f"x{i}" for i in range(8)]
    groups = {"A": [0, 1, 2], "B": [3, 4], "C": [5, 6, 7]}
    got = multivariate.sem(table(spark, x, names), {k: [names[i] for i in v] for k, v in groups.items()}, [("A", "B"), ("B", "C")]).collect()
    of = {(r["kind"], r["lhs"], r["rhs"]): r for r in got}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    load = {k: first_component(np.corrcoef(z[:, v].T)) for k, v in groups.items()}
    score = {k: z[:, v] @ load[k] for k, v in groups.items()}  # the scores themselves, case by case
    for k, v in groups.items():
        w = np.array([of["loading", k, names[i]]["estimate"] for i in v])
        assert np.abs(w) == pytest.approx(np.abs(load[k]))
        assert of["ave", k, ""]["estimate"] == pytest.approx((w**2).mean())
        assert of["cr", k, ""]["estimate"] == pytest.approx(w.sum() ** 2 / (w.sum() ** 2 + (1 - w**2).sum()))
        m, s = len(v), z[:, v]
        assert of["alpha", k, ""]["estimate"] == pytest.approx(m / (m - 1) * (1 - s.var(0, ddof=1).sum() / s.sum(1).var(ddof=1)))
    ab, bc = np.corrcoef(score["A"], score["B"])[0, 1], np.corrcoef(score["B"], score["C"])[0, 1]
    se = [np.sqrt((1 - r * r) / (n - 2)) for r in (ab, bc)]
    assert abs(of["path", "B", "A"]["estimate"]) == pytest.approx(abs(ab)) and of["path", "C", "B"]["se"] == pytest.approx(se[1])
    assert abs(of["indirect", "C", "A>B"]["estimate"]) == pytest.approx(abs(ab * bc))
    assert of["indirect", "C", "A>B"]["se"] == pytest.approx(np.hypot(ab * se[1], bc * se[0]))
    lam, owner = np.concatenate([load[k] for k in groups]), np.repeat([0, 1, 2], [3, 2, 3])
    between = np.corrcoef(np.array([score[k] for k in groups]))
    implied = np.outer(lam, lam) * between[np.ix_(owner, owner)]
    np.fill_diagonal(implied, 1)
    chi = (n - 1) * np.log(np.linalg.det(implied) / np.linalg.det(np.corrcoef(z.T)))
    null, dof = -(n - 1) * np.log(np.linalg.det(np.corrcoef(z.T))), 36 - 16 - 2
    r = got[0]
    assert (r["n"], r["df"]) == (n, dof) and r["chi2"] == pytest.approx(max(0, chi))
    assert r["cfi"] == pytest.approx(1 - max(0, chi - dof) / max(null - 28, chi - dof, 0)) and r["rmsea"] == pytest.approx(np.sqrt(max(0, chi - dof) / dof / (n - 1)))


@pytest.mark.parametrize(("p", "d", "q"), [(1, 0, 0), (2, 1, 1), (0, 0, 2)])
def test_autoregression(spark, p, d, q):
    e = rng.normal(size=300)
    y = np.zeros(300)
    for i in range(2, 300):
        y[i] = 0.5 * y[i - 1] - 0.2 * y[i - 2] + e[i] + 0.3 * e[i - 1]
    y = y + 5
    data = np.column_stack([np.arange(300.0), np.cumsum(y) if d else y])
    got = series.arima(table(spark, data, ["i", "y"]), "y", "i", p, d, q).collect()
    b = {r["term"]: r["b"] for r in got}
    s = np.diff(data[:, 1], d)
    m, n = s.mean(), len(s)
    corr = lambda v, k: np.array([1.0, *(((v[j:] - v.mean()) * (v[:-j] - v.mean())).sum() / ((v - v.mean()) ** 2).sum() for j in range(1, k + 1))])
    a = corr(s, max(p, 1))
    ar = np.linalg.solve([[a[abs(i - j)] for j in range(p)] for i in range(p)], a[1 : p + 1]) if p else np.zeros(0)
    rest = np.array([s[i] - m - sum(ar[k] * (s[i - k - 1] - m) for k in range(p)) for i in range(p, n)])
    s2 = (rest**2).mean()
    assert b["mean"] == pytest.approx(m) and [b[f"ar{k + 1}"] for k in range(p)] == pytest.approx(list(ar), rel=1e-9)
    assert [b[f"ma{k + 1}"] for k in range(q)] == pytest.approx(list(corr(rest, q)[1:] if q else []), rel=1e-9)
    ahead = m + sum(ar[k] * (s[-1 - k] - m) for k in range(p))
    r = got[0]
    assert (r["n"], r["sigma2"], r["forecast"]) == pytest.approx((n, s2, ahead))
    assert r["aic"] == pytest.approx(len(rest) * np.log(s2) + 2 * (p + q + 1)) and r["bic"] == pytest.approx(len(rest) * np.log(s2) + (p + q + 1) * np.log(len(rest)))
    assert r["hi"] - r["lo"] == pytest.approx(2 * 1.96 * np.sqrt(s2))


def test_elbow_of_clear_clusters(spark):
    centres = np.array([[0, 0], [40, 0], [0, 40]])
    x = np.concatenate([c + rng.normal(size=(60, 2)) for c in centres])
    got = {r["k"]: r["wss"] for r in multivariate.elbow(table(spark, x, ["a", "b"]), ["a", "b"], 4).collect()}
    z = ((x - x.mean(0)) / x.std(0, ddof=1)).reshape(3, 60, 2)
    own = ((z - z.mean(1, keepdims=True)) ** 2).sum()
    pair = lambda i, j: ((np.concatenate([z[i], z[j]]) - np.concatenate([z[i], z[j]]).mean(0)) ** 2).sum() + ((z[3 - i - j] - z[3 - i - j].mean(0)) ** 2).sum()
    assert sorted(got) == [2, 3, 4] and got[3] == pytest.approx(own)
    assert any(got[2] == pytest.approx(pair(i, j)) for i, j in ((0, 1), (0, 2), (1, 2))) and got[4] < got[3]


def test_pooled_sets(spark):
    sets = [rng.normal(i / 10, 1, 50) for i in range(4)]
    d = table(spark, np.array([(m, v) for m, s in enumerate(sets) for v in s]), ["m", "v"])
    got = inference.pool(d, ["v"]).first()
    within, between = np.mean([s.var(ddof=1) / 50 for s in sets]), np.var([s.mean() for s in sets], ddof=1)
    total = within + 1.25 * between
    assert (got["mean"], got["within"], got["between"], got["se"], got["fmi"]) == pytest.approx((np.mean(sets), within, between, np.sqrt(total), 1.25 * between / total))


def test_imputed_values_follow_the_other_variable(spark):
    x = rng.normal(size=400)
    y = 2 + 3 * x + rng.normal(0, 0.1, 400)
    gone = rng.random(400) < 0.25
    rows = [(i, float(a), None if g else float(b)) for i, (a, b, g) in enumerate(zip(x, y, gone, strict=True))]
    d = spark.createDataFrame(rows, "id long, x double, y double")
    for method, most in (("normal", 0.6), ("pmm", 1.5)):
        full = inference.mice(d, ["x", "y"], "id", sets=3, method=method, cycles=2)
        got = {(r["m"], r["id"]): r for r in full.collect()}
        assert len(got) == 1200
        assert all(got[m, i]["y"] == b for m in (1, 2, 3) for i, _, b in rows if b is not None)
        away = np.array([got[m, i]["y"] - (2 + 3 * a) for m in (1, 2, 3) for i, a, b in rows if b is None])
        assert np.abs(away).max() < most and abs(away.mean()) < 0.05
        seen = {b for _, _, b in rows}
        assert method == "normal" or all(got[m, i]["y"] in seen for m in (1, 2, 3) for i in range(400))
