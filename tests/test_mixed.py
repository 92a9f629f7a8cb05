"""Mixed models against plain numpy over whole covariance matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import means as M
from statloom.operators import mixed as X
from statloom.operators import multilevel as H

rng = np.random.default_rng(8)


def data(outer=5, groups=8, slope=True):
    rows = []
    for o in range(outer):
        up = rng.normal(0, 3)
        for g in range(groups):
            u, s = rng.normal(0, 1.2), rng.normal(0, 0.8) if slope else 0.0
            for _ in range(int(rng.integers(3, 14))):
                x = rng.normal(2, 1)
                rows.append((f"o{o}", f"g{o}.{g}", float(x), float(1 + 0.5 * x + up + u + s * x + rng.normal(0, 1))))
    return rows


def deviance(rows, x, z, blocks):
    """-2 log likelihood at (fixed effects profiled out) sigma2 and covariances of the random parts."""
    y = np.array([r[3] for r in rows])
    v = np.eye(len(y))
    for names, zs, d in blocks:
        same = np.array(names)[:, None] == np.array(names)
        v = v + same * (zs @ d @ zs.T)
    inv = np.linalg.inv(v)
    b = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
    r = y - x @ b
    s2 = r @ inv @ r / len(y)
    return len(y) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1], b, s2, inv, r


def climb(f, x, rounds=200):
    """Minimum of f by Newton's steps on central differences."""
    h, k = 1e-4, len(x)
    e = np.eye(k) * h
    for _ in range(rounds):
        g = np.array([(f(x + e[i]) - f(x - e[i])) / (2 * h) for i in range(k)])
        hs = np.array([[(f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * h * h) for j in range(k)] for i in range(k)])
        w, q = np.linalg.eigh(hs)
        step = -(q / np.maximum(np.abs(w), 1e-3)) @ q.T @ g
        step *= min(1.0, 0.7 / np.abs(step).max())
        x = x + step
        if np.abs(step).max() < 1e-8:
            break
    return x


def test_random_slopes_are_at_the_maximum(spark):
    rows = data(1, 30)
    df = spark.createDataFrame(rows, "o string, g string, x double, y double")
    got = {r["term"]: r for r in X.random_slopes(df, "y", "g", ["x"], ["x"]).collect()}
    xs = np.array([r[2] for r in rows]) - np.mean([r[2] for r in rows])
    z = np.column_stack([np.ones(len(rows)), xs])
    names = [r[1] for r in rows]

    def cov(p):
        low = np.array([[p[0], 0.0], [p[1], p[2]]])
        return low @ low.T + 1e-12 * np.eye(2)

    p = climb(lambda p: deviance(rows, z, z, [(names, z, cov(p))])[0], np.array([2.0, 0.6, 0.6]))
    dev, b, s2, inv, r = deviance(rows, z, z, [(names, z, cov(p))])
    one = got["(constant)"]
    tau = cov(p) * s2
    assert [one["tau_0_0"], one["tau_0_1"], one["tau_1_1"], one["sigma2"], one["deviance"]] == pytest.approx([tau[0, 0], tau[0, 1], tau[1, 1], s2, dev], rel=2e-6)
    assert got["x"]["b"] == pytest.approx(b[1], rel=1e-6) and one["b"] == pytest.approx(b[0] - b[1] * np.mean([r[2] for r in rows]), rel=1e-6)
    effects = {(r["cluster"], r["term"]): r for r in X.cluster_effects(df, "y", "g", ["x"], ["x"]).collect()}
    assert len(effects) == 2 * len(set(names))
    for g in sorted(set(names))[:6]:
        at = np.array(names) == g
        u = cov(p) @ z[at].T @ (inv @ r)[at]
        left = s2 * (cov(p) - cov(p) @ z[at].T @ inv[np.ix_(at, at)] @ z[at] @ cov(p))
        for i, t in enumerate(("(constant)", "x")):
            assert effects[g, t]["effect"] == pytest.approx(u[i], abs=2e-5) and effects[g, t]["variance"] == pytest.approx(left[i, i], rel=2e-5) and effects[g, t]["n"] == at.sum()
            assert effects[g, t]["reliability"] == pytest.approx(1 - left[i, i] / tau[i, i], abs=2e-5)


def test_intercepts_are_at_the_maximum(spark):
    rows = data(6, 7, slope=False)
    df = spark.createDataFrame(rows, "o string, g string, x double, y double")
    x = np.column_stack([np.ones(len(rows)), [r[2] for r in rows]])
    one = np.ones((len(rows), 1))
    g, o = [r[1] for r in rows], [r[0] for r in rows]
    two = H.hlm(df, "y", "g", ["x"]).first()
    p = climb(lambda p: deviance(rows, x, one, [(g, one, np.exp([[p[0]]]))])[0], np.array([0.5]))
    dev, b, s2, *_ = deviance(rows, x, one, [(g, one, np.exp([[p[0]]]))])
    assert [two["tau2"], two["sigma2"], two["deviance"], two["b"]] == pytest.approx([np.exp(p[0]) * s2, s2, dev, b[0]], rel=1e-6)
    three = H.hlm(df, "y", "g", ["x"], outer="o").first()
    at = lambda p: [(g, one, np.exp([[p[0]]])), (o, one, np.exp([[p[1]]]))]
    p = climb(lambda p: deviance(rows, x, one, at(p))[0], np.array([0.3, 0.5]))
    dev, b, s2, inv, r = deviance(rows, x, one, at(p))
    a, c = np.exp(p)
    assert [three["tau2"], three["tau3"], three["sigma2"], three["deviance"]] == pytest.approx([a * s2, c * s2, s2, dev], rel=1e-6)
    same = X.random_slopes(df, "y", "g", ["x"], []).first()
    assert same["tau_0_0"] == pytest.approx(two["tau2"], rel=1e-6) and same["deviance"] == pytest.approx(two["deviance"], rel=1e-9)
    effects = {e["cluster"]: e for e in X.nested_effects(df, "y", "g", "o", ["x"]).collect()}
    v = inv @ r
    for name in sorted(set(g))[:8]:
        e, i, j = effects[name], np.array(g) == name, np.array(o) == name.split(".")[0].replace("g", "o")
        assert e["effect"] == pytest.approx(a * v[i].sum(), abs=1e-5) and e["outer_effect"] == pytest.approx(c * v[j].sum(), abs=1e-5)
        left = s2 * (a - a * a * inv[np.ix_(i, i)].sum()), s2 * (c - c * c * inv[np.ix_(j, j)].sum())
        assert [e["variance"], e["outer_variance"]] == pytest.approx(left, rel=1e-5) and e["reliability"] == pytest.approx(1 - left[0] / (a * s2), abs=1e-5)


def test_no_variance_between_clusters(spark):
    rows = [("o", f"g{i % 10}", float(x), float(2 * x + e)) for i, (x, e) in enumerate(rng.normal(size=(200, 2)))]
    got = X.random_slopes(spark.createDataFrame(rows, "o string, g string, x double, y double"), "y", "g", ["x"], ["x"]).first()
    tau = np.array([[got["tau_0_0"], got["tau_0_1"]], [got["tau_0_1"], got["tau_1_1"]]])
    assert np.linalg.eigvalsh(tau).min() > -1e-9 and np.trace(tau) < 0.2 and got["slopes_lrt"] < 8


def test_nested_components(spark):
    rows = data(7, 6, slope=False)
    df = spark.createDataFrame(rows, "o string, g string, x double, y double")
    got = X.nested_components(df, "y", "g", "o").first()
    y, o, g = np.array([r[3] for r in rows]), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    # expected mean squares by traces: E(y'Qy) = sum of components times tr(Z'QZ)
    dummy = lambda v: (v[:, None] == np.unique(v)).astype(float)
    proj = lambda z: z @ np.linalg.pinv(z)
    one, zo, zg = np.ones((len(y), 1)), dummy(o), dummy(g)
    forms = [proj(zo) - proj(one), proj(zg) - proj(zo), np.eye(len(y)) - proj(zg)]
    left = np.array([[np.trace(z.T @ f @ z) for z in (zo, zg, np.eye(len(y)))] for f in forms])
    tau3, tau2, s2 = np.linalg.solve(left, [y @ f @ y for f in forms])
    assert [got["tau3"], got["tau2"], got["sigma2"]] == pytest.approx([tau3, tau2, s2], rel=1e-8)


def test_cell_means_are_exact(spark):
    df = spark.createDataFrame([("a", 25.40225), ("b", 25.40225), ("b", 25.40225)], "f string, v double")
    assert {r["mean"] for r in M.cell_means(df, "v", ["f"]).withColumn("mean", F.col("mean")).collect()} == {25.40225}
