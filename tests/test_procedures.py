"""Procedures on seeded cases of our own against numpy: brute force, identities, edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import association as A
from statloom.operators import cases as C
from statloom.operators import descriptive as D
from statloom.operators import inference as I
from statloom.operators import means as M
from statloom.operators import multilevel as H
from statloom.operators import multivariate as V
from statloom.operators import regression as R
from statloom.operators import series as T
from statloom.operators import survival as U
from statloom.plans.stats import moments, parsed, quantiles, ranks, replicate
from statloom.sources import cases as S

N = 60
rng = np.random.default_rng(20)
AGE = np.round(rng.normal(40, 9, N), 1)
DOSE = np.round(rng.gamma(3.0, 2.0, N), 1)
GAIN = np.round(3 + 0.4 * AGE - 1.3 * DOSE + rng.normal(0, 3, N), 2)
PAIN = np.round(20 - 0.2 * AGE + 0.8 * DOSE + rng.normal(0, 2, N), 2)
ARM = np.array(["ctrl", "low", "high"])[rng.integers(0, 3, N)]
SITE = np.array(["s1", "s2", "s3", "s4"])[rng.integers(0, 4, N)]
SICK = (rng.random(N) < 1 / (1 + np.exp(-(DOSE - 6) / 2))).astype(int)
VISITS = rng.poisson(np.exp(0.1 * DOSE))
WEEKS = np.round(rng.exponential(20 / (1 + DOSE / 10), N)) + 1
DIED = (rng.random(N) < 0.7).astype(int)
COPIES = rng.integers(1, 4, N)
COLUMNS = dict(age=AGE, dose=DOSE, gain=GAIN, pain=PAIN, arm=ARM, site=SITE, sick=SICK, visits=VISITS, weeks=WEEKS, died=DIED, copies=COPIES)


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, *(v[i].item() for v in COLUMNS.values())) for i in range(N)]
    kinds = "id long, age double, dose double, gain double, pain double, arm string, site string, sick long, visits long, weeks double, died long, copies long"
    return spark.createDataFrame(rows, kinds).repartition(3).persist()


def groups(spark, **values):
    return spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "g string, v double")


def by(v, g):
    return {k: v[g == k] for k in sorted(set(g.tolist()))}


def f_tail(f, a, b, steps=200_000):
    x = (np.arange(steps) + 0.5) / steps
    t = f + x / (1 - x)
    logs = math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2) + a / 2 * math.log(a / b)
    return float((np.exp(logs + (a / 2 - 1) * np.log(t) - (a + b) / 2 * np.log1p(a * t / b)) / (1 - x) ** 2).mean())


def test_describe(cases):
    r = D.describe(cases, "gain").first()
    assert (r["n"], r["missing"]) == (N, 0)
    assert [r["mean"], r["std"], r["median"], r["q1"], r["q3"]] == pytest.approx([GAIN.mean(), GAIN.std(ddof=1), np.median(GAIN), *np.quantile(GAIN, [0.25, 0.75])])
    fence = 1.5 * (r["q3"] - r["q1"])
    assert r["outlier_count"] == ((GAIN < r["q1"] - fence) | (GAIN > r["q3"] + fence)).sum()


def test_moments_and_quantiles_equal_numpy(spark):
    v = np.round(np.random.default_rng(1).normal(size=1500), 2)
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    q = quantiles(d, "v", {"a": 0.1, "b": 0.5, "c": 0.937}).first()
    assert [q["a"], q["b"], q["c"]] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.937])))
    got = {r["v"]: r["rank"] for r in ranks(d, "v").collect()}
    order = np.sort(v)
    assert all(got[x] == (np.searchsorted(order, x) + np.searchsorted(order, x, "right") + 1) / 2 for x in set(v.tolist()))


def test_weights_are_copies(spark, cases):
    d = spark.createDataFrame([(1.0, 2.4), (5.0, 0.2), (9.0, None), (7.0, -1.0)], "v double, w double")
    a = replicate(d, "w").agg(F.count("*"), F.avg("v"), F.var_samp("v")).first()
    assert tuple(a) == pytest.approx((3, 7 / 3, 16 / 3)) and tuple(moments(d, "v", weight="w").first()) == pytest.approx(tuple(a))
    many = replicate(cases, "copies")
    for f in (
        lambda t, **w: M.anova_oneway(t, "gain", "arm", **w), lambda t, **w: M.ttest_independent(t, "gain", "arm", **w), lambda t, **w: M.ttest_paired(t, "gain", "pain", **w),
        lambda t, **w: R.linear(t, "gain", ["age", "dose"], **w), lambda t, **w: D.chi_square(t, "arm", "site", **w), lambda t, **w: M.anova_factorial(t, "gain", ["arm", "site"], **w),
        lambda t, **w: A.pearson(t, "gain", "age", **w), lambda t, **w: M.cell_means(t, "gain", ["arm", "site"], **w), lambda t, **w: D.crosstab(t, "arm", "site", **w),
    ):
        key = lambda r: tuple(str(x) for x in r if isinstance(x, str) or x is None)
        for x, y in zip(sorted(f(cases, weight="copies").collect(), key=key), sorted(f(many).collect(), key=key), strict=True):
            assert tuple(x) == tuple(pytest.approx(v, rel=1e-6, abs=1e-9) if isinstance(v, float) else v for v in y)


def test_t_tests(spark, cases):
    a, b = GAIN[ARM == "ctrl"], GAIN[ARM == "high"]
    r = M.ttest_independent(cases, "gain", "arm", ("ctrl", "high")).first()
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert [r["t"], r["df"]] == pytest.approx([(a.mean() - b.mean()) / np.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))])
    assert r["p"] == pytest.approx(f_tail(r["t"] ** 2, 1, r["df"]), abs=1e-4)
    o = M.ttest_one_sample(cases, "gain", 5).first()
    assert o["t"] == pytest.approx((GAIN.mean() - 5) / (GAIN.std(ddof=1) / np.sqrt(N)))
    d = GAIN - PAIN
    assert M.ttest_paired(cases, "gain", "pain").first()["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(N)))


def anova(v, g):
    parts = list(by(v, g).values())
    between = sum(len(x) * (x.mean() - v.mean()) ** 2 for x in parts)
    within = sum(((x - x.mean()) ** 2).sum() for x in parts)
    return between / (len(parts) - 1) / (within / (len(v) - len(parts)))


def test_anova_and_posthoc(cases):
    r = M.anova_oneway(cases, "gain", "arm").first()
    assert r["f"] == pytest.approx(anova(GAIN, ARM)) and r["p"] == pytest.approx(f_tail(r["f"], 2, N - 3), abs=1e-4)
    found = {h: {(x["a"], x["b"]): x for x in M.posthoc(cases, "gain", "arm", h).collect()} for h in ("tukey", "lsd", "bonferroni", "holm")}
    assert all(len(f) == 3 for f in found.values())
    assert all(found["lsd"][k]["p_adj"] <= found["holm"][k]["p_adj"] + 1e-12 <= found["bonferroni"][k]["p_adj"] + 2e-12 for k in found["holm"])
    e = M.eta2_interval(M.anova_oneway(cases, "gain", "arm")).first()
    top = (e["f"] + 1.96) * 2
    assert e["eta2_hi"] == pytest.approx(top / (top + 2 + N - 3 + 1))


def test_tukey_probability(spark):
    from statloom.functions.special import tukey_p

    # published 5 % points of the studentised range
    got = spark.range(1).select(tukey_p(3.578, 3, 20).alias("a"), tukey_p(3.877, 3, 10).alias("b"), tukey_p(4.327, 4, 10).alias("c")).first()
    assert list(got) == pytest.approx([0.05] * 3, abs=2e-4)


def test_tukey_probability_against_an_integral(cases):
    r = M.posthoc(cases, "gain", "arm", "tukey").first()
    z = np.linspace(-8, 8, 1601)
    phi, cdf = np.exp(-z * z / 2) / np.sqrt(2 * np.pi), np.array([0.5 * (1 + math.erf(x / np.sqrt(2))) for x in z])
    at = lambda x: 0.5 * (1 + np.vectorize(math.erf)((z + x) / np.sqrt(2)))
    df = r["df"]
    s = np.linspace(0.3, 2.0, 400)
    dens = np.exp(df / 2 * np.log(df / 2) - math.lgamma(df / 2) + np.log(2) + (df - 1) * np.log(s) - df * s * s / 2)
    inner = np.array([3 * np.trapezoid(phi * (at(r["stat"] * x) - cdf) ** 2, z) for x in s])
    assert r["p_raw"] == pytest.approx(1 - np.trapezoid(dens * inner, s), abs=1e-3)


def test_factorial_against_balanced_formulae(spark, cases):
    g = np.random.default_rng(2)
    rows = [(f"a{i}", f"b{j}", float(g.normal() + i)) for i in range(2) for j in range(3) for _ in range(4)]
    r = {x["source"]: x for x in M.anova_factorial(spark.createDataFrame(rows, "a string, b string, v double"), "v", ["a", "b"]).collect()}
    v = np.array([x[2] for x in rows]).reshape(2, 3, 4)
    assert r["a"]["ss"] == pytest.approx(12 * ((v.mean((1, 2)) - v.mean()) ** 2).sum())
    assert r["error"]["ss"] == pytest.approx(((v - v.mean(2, keepdims=True)) ** 2).sum()) and r["error"]["df"] == 18
    assert sum(x["ss"] for x in r.values()) == pytest.approx(((v - v.mean()) ** 2).sum())
    cells = {(x["arm"], x["site"]): (x["n"], x["mean"]) for x in M.cell_means(cases, "gain", ["arm", "site"]).collect()}
    assert cells[None, None] == (N, pytest.approx(GAIN.mean())) and cells["low", None][1] == pytest.approx(GAIN[ARM == "low"].mean())
    assert cells["low", "s2"] == ((own := (ARM == "low") & (SITE == "s2")).sum(), pytest.approx(GAIN[own].mean()))


def test_repeated_measures(cases):
    x = np.stack([GAIN, PAIN, DOSE], 1)
    grand, subj, time = x.mean(), x.mean(1), x.mean(0)
    ss_t, ss_s = N * ((time - grand) ** 2).sum(), 3 * ((subj - grand) ** 2).sum()
    ss_e = ((x - grand) ** 2).sum() - ss_t - ss_s
    r = M.anova_repeated(cases, ["gain", "pain", "dose"]).first()
    assert r["f"] == pytest.approx(ss_t / 2 / (ss_e / (2 * (N - 1))))


def test_manova(cases):
    x = np.stack([GAIN, PAIN], 1)
    t = np.cov(x.T) * (N - 1)
    e = sum(np.cov(x[ARM == a].T) * ((ARM == a).sum() - 1) for a in set(ARM))
    roots = np.sort(np.linalg.eigvals(np.linalg.inv(e) @ (t - e)).real)[::-1]
    r = {s["statistic"]: s["value"] for s in M.manova(cases, ["gain", "pain"], "arm").collect()}
    assert [r["wilks"], r["pillai"], r["hotelling"], r["roy"]] == pytest.approx([np.linalg.det(e) / np.linalg.det(t), (roots / (1 + roots)).sum(), roots.sum(), roots[0]])
    m = sum(-((ARM == a).sum() - 1) * np.linalg.slogdet(np.cov(x[ARM == a].T))[1] for a in set(ARM)) + (N - 3) * np.linalg.slogdet(e / (N - 3))[1]
    assert r["box_m"] == pytest.approx(m)
    follow = {s["variable"]: s["f"] for s in M.manova_followups(cases, ["gain", "pain"], "arm").collect()}
    assert follow == pytest.approx({"gain": anova(GAIN, ARM), "pain": anova(PAIN, ARM)})


def test_correlations(spark, cases):
    assert A.pearson(cases, "gain", "age").first()["r"] == pytest.approx(np.corrcoef(GAIN, AGE)[0, 1])
    order = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert A.spearman(cases, "gain", "age").first()["r"] == pytest.approx(np.corrcoef(order(GAIN), order(AGE))[0, 1])
    z = np.column_stack([np.ones(N), DOSE])
    res = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
    assert A.partial(cases, "gain", "age", "dose").first()["rp"] == pytest.approx(np.corrcoef(res(GAIN), res(AGE))[0, 1])


def test_canonical(cases):
    zs = lambda *c: np.stack([(v - v.mean()) / v.std(ddof=1) for v in c], 1)
    x, y = zs(AGE, DOSE), zs(GAIN, PAIN)
    rc = [r["rc"] for r in A.canonical(cases, ["age", "dose"], ["gain", "pain"]).orderBy("root").collect()]
    w = {(r["root"], r["item"]): r for r in A.canonical_weights(cases, ["age", "dose"], ["gain", "pain"]).collect()}
    for root in (1, 2):
        u, v = x @ [w[root, i]["coefficient"] for i in ("age", "dose")], y @ [w[root, i]["coefficient"] for i in ("gain", "pain")]
        assert [u.var(ddof=1), v.var(ddof=1), np.corrcoef(u, v)[0, 1]] == pytest.approx([1, 1, rc[root - 1]])
        assert w[root, "age"]["loading"] == pytest.approx(np.corrcoef(AGE, u)[0, 1]) and w[root, "gain"]["cross_loading"] == pytest.approx(np.corrcoef(GAIN, u)[0, 1])


def test_linear_models(cases):
    x = np.column_stack([np.ones(N), AGE, DOSE])
    b, *_ = np.linalg.lstsq(x, GAIN, rcond=None)
    assert [r["b"] for r in R.linear(cases, "gain", ["age", "dose"]).collect()] == pytest.approx(b)
    e = GAIN - x @ b
    inv = np.linalg.inv(x.T @ x)
    h = np.diag(x @ inv @ x.T)
    d = R.linear_diagnostics(cases, "gain", ["age", "dose"], "id").first()
    mse = (e**2).sum() / (N - 3)
    assert d["dw"] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    assert d["cooks_max"] == pytest.approx((e**2 * h / (3 * mse * (1 - h) ** 2)).max())
    hc3 = np.sqrt(np.diag(inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv))
    assert [r["se_hc3"] for r in R.robust_errors(cases, "gain", ["age", "dose"]).collect()] == pytest.approx(hc3)
    got = {r["id"]: r for r in R.predict(cases, "gain", ["age", "dose"]).collect()}
    assert [got[i]["residual"] for i in range(N)] == pytest.approx(e) and got[3]["leverage"] == pytest.approx(h[3])
    tied = cases.withColumn("same", F.lit(1.0))
    steps = np.sort(e)
    assert R.linear_diagnostics(tied, "gain", ["age", "dose"], "same").first()["dw"] == pytest.approx((np.diff(steps) ** 2).sum() / (e**2).sum())


def newton(x, y, link):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        mu, w = link(x @ b)
        b += np.linalg.solve((x.T * w) @ x, x.T @ (y - mu))
    return b


def logit(e):
    p = 1 / (1 + np.exp(-e))
    return p, p * (1 - p)


def test_counts(cases):
    x = np.column_stack([np.ones(N), DOSE])
    b = newton(x, VISITS, lambda e: (np.exp(e), np.exp(e)))
    r = R.poisson(cases, "visits", ["dose"]).collect()
    assert [t["b"] for t in r] == pytest.approx(b, abs=1e-6)
    g = np.random.default_rng(8)
    z = np.round(g.normal(size=400), 1)
    y = g.negative_binomial(2.0, 2.0 / (2.0 + np.exp(0.5 + 0.6 * z)))
    nb = R.negative_binomial(cases.sparkSession.createDataFrame(list(zip(z.tolist(), y.tolist(), strict=True)), "z double, y long"), "y", ["z"]).collect()
    theta, b = nb[0]["theta"], [t["b"] for t in nb]
    lg = np.vectorize(math.lgamma)
    ll = lambda b0, b1, t: (lg(y + t) - lg(t) - lg(y + 1) + t * np.log(t) + y * (b0 + b1 * z) - (y + t) * np.log(np.exp(b0 + b1 * z) + t)).sum()
    assert nb[0]["ll"] == pytest.approx(ll(*b, theta))
    for move in ((1e-2, 0, 0), (-1e-2, 0, 0), (0, 1e-2, 0), (0, -1e-2, 0), (0, 0, 0.05), (0, 0, -0.05)):
        assert ll(b[0] + move[0], b[1] + move[1], theta * (1 + move[2])) <= nb[0]["ll"] + 1e-3
    assert nb[0]["ll_null"] == pytest.approx(ll(np.log(y.mean()), 0.0, theta)) and nb[0]["chi2"] == pytest.approx(2 * (nb[0]["ll"] - nb[0]["ll_null"]))
    assert nb[0]["deviance"] > 0 and 0.7 < nb[0]["dispersion"] < 1.4


def test_logistic(cases):
    x = np.column_stack([np.ones(N), DOSE])
    b = newton(x, SICK, logit)
    assert [r["b"] for r in R.logistic(cases, "sick", ["dose"]).collect()] == pytest.approx(b, abs=1e-5)
    said = x @ b >= 0
    c = R.classification(cases, "sick", ["dose"]).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == ((said & (SICK == 1)).sum(), (said & (SICK == 0)).sum(), (~said & (SICK == 0)).sum(), (~said & (SICK == 1)).sum())
    levels = sorted(set(ARM))
    bs = [np.zeros(2), *(newton(x, (ARM == lv).astype(float), logit) for lv in levels[1:])]
    eta = np.stack([x @ v for v in bs], 1)
    got = {(r["actual"], r["predicted"]): r["n"] for r in R.multinomial_classification(cases, "arm", ["dose"]).collect()}
    want = {}
    for a, p in zip(ARM.tolist(), (levels[i] for i in eta.argmax(1)), strict=True):
        want[a, p] = want.get((a, p), 0) + 1
    assert got == want
    ll = sum(eta[i, levels.index(ARM[i])] - np.log(np.exp(eta[i]).sum()) for i in range(N))
    assert R.multinomial_classification(cases, "arm", ["dose"]).first()["ll"] == pytest.approx(ll, abs=1e-4)


def test_rank_tests(spark):
    u = A.mann_whitney(groups(spark, a=[0.3, 0.9, 2.1], b=[3.5, 4.1, 7.7, 9.2, 9.9]), "v", "g").first()
    assert u["u"] == 0 and u["method"] == "exact" and u["p"] == pytest.approx(2 / math.comb(8, 3))
    k = A.kruskal_wallis(groups(spark, a=[1.5, 2.5, 0.5], b=[6.1, 5.2, 7.3], c=[8.8, 9.4, 12.0]), "v", "g").first()
    assert k["h"] == pytest.approx(12 / 90 * (36 + 225 + 576) / 3 - 30)
    w = A.wilcoxon(spark.createDataFrame([(v,) for v in (0.4, 1.1, 2.2, 3.9, 5.1, 8.0, 9.5)], "x double"), "x").first()
    assert w["w"] == 0 and w["p"] == pytest.approx(2 / 2**7)


def test_agreement_and_roc(spark, cases):
    x = np.stack([GAIN, PAIN, AGE], 1)
    a = A.cronbach_alpha(cases, ["gain", "pain", "age"]).first()
    assert a["alpha"] == pytest.approx(1.5 * (1 - x.var(0, ddof=1).sum() / x.sum(1).var(ddof=1)))
    g = np.random.default_rng(3)
    p, q = g.integers(1, 6, 300), g.integers(1, 6, 300)
    q[:150] = p[:150]
    d = spark.createDataFrame(list(zip(p.tolist(), q.tolist(), strict=True)), "a long, b long")
    m = np.zeros((5, 5))
    np.add.at(m, (p - 1, q - 1), 1 / 300)
    e, w = np.outer(m.sum(1), m.sum(0)), np.abs(np.subtract.outer(range(5), range(5))) / 4
    k = A.cohen_kappa(d, "a", "b").first()
    assert [k["kappa"], k["w_kappa"]] == pytest.approx([(np.trace(m) - np.trace(e)) / (1 - np.trace(e)), 1 - (w * m).sum() / (w * e).sum()])
    c = {r["category"]: r for r in A.kappa_categories(d, "a", "b").collect()}
    assert c["2"]["precision"] == pytest.approx(m[1, 1] / m[:, 1].sum()) and c["2"]["recall"] == pytest.approx(m[1, 1] / m[1].sum())
    pos, neg = DOSE[SICK == 1], DOSE[SICK == 0]
    assert A.roc(cases, "dose", "sick", "1").first()["auc"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))


def test_tables(spark, cases):
    got = D.chi_square(cases, "arm", "site").first()
    n = np.array([[((ARM == a) & (SITE == s)).sum() for s in sorted(set(SITE))] for a in sorted(set(ARM))])
    e = np.outer(n.sum(1), n.sum(0)) / N
    assert got["chi2"] == pytest.approx(((n - e) ** 2 / e).sum()) and (got["df"], got["low_cells"]) == (6, (e < 5).sum())
    many = spark.range(30_000).select(F.col("id").alias("a"), (F.col("id") % 20_000).alias("b"))
    assert D.chi_square(many, "a", "b").first()["n"] == 30_000  # six hundred million pairs of levels, none of them made
    with pytest.raises(ValueError):
        D.crosstab(many, "a", "b")
    two = spark.createDataFrame([("u", "x")] * 3 + [("u", "y")] + [("v", "x")] + [("v", "y")] * 4, "r string, c string")
    ways = lambda a: math.comb(4, a) * math.comb(5, 4 - a) / math.comb(9, 4)
    assert D.fisher_exact(two, "r", "c").first()["p"] == pytest.approx(sum(ways(a) for a in range(5) if ways(a) <= ways(3) + 1e-12))


def test_path_models(cases):
    x = np.column_stack([np.ones(N), AGE, DOSE])
    a = np.linalg.lstsq(x[:, :2], DOSE, rcond=None)[0][1]
    b = np.linalg.lstsq(x, GAIN, rcond=None)[0]
    m = R.mediation(cases, "age", ["dose"], "gain", boots=400).first()
    assert [m["a"], m["b"], m["c_prime"], m["indirect"]] == pytest.approx([a, b[2], b[1], a * b[2]])
    g = np.random.default_rng(4)
    boot = []
    for _ in range(2000):
        w = g.integers(0, N, N)
        boot.append(np.linalg.lstsq(x[w, :2], DOSE[w], rcond=None)[0][1] * np.linalg.lstsq(x[w], GAIN[w], rcond=None)[0][2])
    spread = np.std(boot)
    assert np.abs(np.array([m["boot_lo"], m["boot_hi"]]) - np.quantile(boot, [0.025, 0.975])).max() < 0.5 * spread
    s = R.simple_slopes(cases, "age", "dose", "gain", steps=4).collect()
    u, w = AGE - AGE.mean(), DOSE - DOSE.mean()
    b = np.linalg.lstsq(np.column_stack([np.ones(N), u, w, u * w]), GAIN, rcond=None)[0]
    assert [r["slope"] for r in s if r["at"] == "mean + sd"] == pytest.approx([b[1] + b[3] * DOSE.std(ddof=1)])


ITEMS = ["age", "dose", "gain", "pain"]
Z = np.stack([(COLUMNS[c] - COLUMNS[c].mean()) / COLUMNS[c].std(ddof=1) for c in ITEMS], 1)


def test_factors(cases):
    values, vectors = np.linalg.eigh(np.corrcoef(Z.T))
    want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    rows = V.efa(cases, ITEMS, 2, rotate=False).collect()
    got = np.array([[next(r["loading"] for r in rows if (r["item"], r["factor"]) == (c, k)) for k in (1, 2)] for c in ITEMS])
    assert np.abs(got) == pytest.approx(np.abs(want))
    turned = V.efa(cases, ITEMS, 2).collect()
    assert {r["item"]: r["communality"] for r in turned} == pytest.approx(dict(zip(ITEMS, (want**2).sum(1), strict=True)))
    inv = np.linalg.inv(np.corrcoef(Z.T))
    part = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = lambda m: (m[~np.eye(4, dtype=bool)] ** 2).sum()
    assert V.factorability(cases, ITEMS).first()["kmo"] == pytest.approx(off(np.corrcoef(Z.T)) / (off(np.corrcoef(Z.T)) + off(part)))


def test_varimax_keeps_communalities():
    a = np.random.default_rng(0).normal(size=(6, 2))
    assert (V.varimax(a) ** 2).sum(1) == pytest.approx((a**2).sum(1))


def test_discriminant(cases):
    x = np.stack([GAIN, PAIN], 1)
    e = sum(np.cov(x[ARM == a].T) * ((ARM == a).sum() - 1) for a in set(ARM))
    roots, vectors = np.linalg.eig(np.linalg.inv(e) @ (np.cov(x.T) * (N - 1) - e))
    got = V.lda(cases, "arm", ["gain", "pain"]).collect()
    assert sorted({r["eigenvalue"] for r in got}, reverse=True) == pytest.approx(np.sort(roots.real)[::-1])
    y = x @ (vectors.real / np.sqrt(np.diag(vectors.real.T @ e @ vectors.real) / (N - 3)))
    centre = {a: y[ARM == a].mean(0) for a in sorted(set(ARM))}
    near = [min(centre, key=lambda a, r=r: ((r - centre[a]) ** 2).sum()) for r in y]
    want = {(a, p): sum(1 for u, v in zip(ARM, near, strict=True) if (u, v) == (a, p)) for a in centre for p in centre}
    assert {(r["actual"], r["predicted"]): r["n"] for r in V.lda_classify(cases, "arm", ["gain", "pain"]).collect()} == {k: v for k, v in want.items() if v}


def silhouette(z, own):
    far = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    out = []
    for i in range(len(z)):
        same = (own == own[i]) & (np.arange(len(z)) != i)
        a = far[i, same].mean() if same.any() else 0
        b = min(far[i, own == c].mean() for c in set(own.tolist()) - {own[i]})
        out.append((b - a) / max(a, b) if same.any() else 0)
    return np.array(out)


def test_clusters(cases):
    got = {r["id"]: r["cluster"] for r in V.kmeans_assign(cases, ["age", "dose"], 3).collect()}
    own = np.array([got[i] for i in range(N)])
    z = Z[:, :2]
    centre = np.stack([z[own == c].mean(0) for c in (1, 2, 3)])
    assert (((z[:, None] - centre[None]) ** 2).sum(-1).argmin(1) + 1 == own).mean() > 0.95
    table = {r["cluster"]: r for r in V.kmeans(cases, ["age", "dose"], 3).collect()}
    assert {c: r["n"] for c, r in table.items()} == {c: (own == c).sum() for c in (1, 2, 3)}
    assert table[1]["total_wss"] == pytest.approx(sum(((z[own == c] - centre[c - 1]) ** 2).sum() for c in (1, 2, 3)))
    f = {r["variable"]: r["f"] for r in V.cluster_anova(V.kmeans_assign(cases, ["age", "dose"], 3), ["age"]).collect()}
    assert f["age"] == pytest.approx(anova(AGE, own))


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
def test_tree_of_clusters(cases, linkage):
    rows = V.hierarchical_clusters(cases, ["age", "dose"], "id", 4, linkage).orderBy("id").collect()
    own = np.array([r["cluster"] for r in rows])
    z = Z[:, :2]
    # merge by brute force, distances taken from the members each time
    sets = [[i] for i in range(N)]
    far = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    cost = {
        "single": lambda a, b: far[np.ix_(a, b)].min(), "complete": lambda a, b: far[np.ix_(a, b)].max(), "average": lambda a, b: far[np.ix_(a, b)].mean(),
        "ward": lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((z[a].mean(0) - z[b].mean(0)) ** 2).sum(),
    }[linkage]
    while len(sets) > 4:
        i, j = min(((i, j) for i in range(len(sets)) for j in range(i)), key=lambda p: cost(sets[p[0]], sets[p[1]]))
        sets[j] += sets.pop(i)
    assert sorted(sorted(s) for s in sets) == sorted(np.flatnonzero(own == c).tolist() for c in range(1, 5))
    assert [r["silhouette"] for r in rows] == pytest.approx(silhouette(z, own))


def test_multilevel(cases):
    parts = list(by(GAIN, SITE).values())
    msb = sum(len(x) * (x.mean() - GAIN.mean()) ** 2 for x in parts) / 3
    msw = sum(((x - x.mean()) ** 2).sum() for x in parts) / (N - 4)
    n0 = (N - sum(len(x) ** 2 for x in parts) / N) / 3
    assert H.icc(cases, "gain", "site").first()["icc1"] == pytest.approx(max(0.0, (msb - msw) / n0) / (max(0.0, (msb - msw) / n0) + msw))
    two = H.hlm(cases, "gain", "site", ["age"]).first()
    assert two["k2"] == 4 and two["lrt"] > 0
    assert H.hlm(cases, "gain", "site", ["age"], outer="arm").first()["k3"] == 3


def test_survival(cases):
    x = np.column_stack([AGE, DOSE])
    b = np.zeros(2)
    for _ in range(30):
        g, h = np.zeros(2), np.zeros((2, 2))
        for t in sorted(set(WEEKS[DIED == 1])):
            risk = WEEKS >= t
            w = np.exp(x[risk] @ b)
            mean = w @ x[risk] / w.sum()
            d = ((WEEKS == t) & (DIED == 1)).sum()
            g += x[(WEEKS == t) & (DIED == 1)].sum(0) - d * mean
            h += d * ((x[risk].T * w) @ x[risk] / w.sum() - np.outer(mean, mean))
        b += np.linalg.solve(h, g)
    assert [r["b"] for r in U.cox(cases, "weeks", "died", ["age", "dose"]).collect()] == pytest.approx(b, abs=1e-5)
    risk = x @ b
    pairs = [(risk[i] > risk[j]) for i in range(N) for j in range(N) if DIED[i] and WEEKS[i] < WEEKS[j]]
    c = U.cox_concordance(cases, "weeks", "died", ["age", "dose"]).first()
    assert (c["comparable"], c["concordant"]) == (len(pairs), sum(pairs))
    rounded = np.round(risk)
    d = cases.withColumn("r", F.round(F.col("age") * float(b[0]) + F.col("dose") * float(b[1])))
    assert U.concordance(d, "weeks", "died", "r").first()["concordant"] == sum(rounded[i] > rounded[j] for i in range(N) for j in range(N) if DIED[i] and WEEKS[i] < WEEKS[j])
    s, want = 1.0, {}
    for t in sorted(set(WEEKS)):
        s *= 1 - ((WEEKS == t) & (DIED == 1)).sum() / (WEEKS >= t).sum()
        want[t] = s
    assert {r["t"]: r["s"] for r in U.kaplan_meier(cases, "weeks", "died").collect()} == pytest.approx(want, abs=1e-12)


def test_series(spark):
    y = np.cumsum(np.random.default_rng(6).normal(size=80)) + 3 * np.sin(np.arange(80) * np.pi / 2)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, y double")
    z = y - y.mean()
    r = np.array([(z[: 80 - k] * z[k:]).sum() / (z**2).sum() for k in range(5)])
    got = {x["lag"]: (x["acf"], x["pacf"]) for x in T.acf(d, "y", "i", 4).collect()}
    assert [got[k][0] for k in range(5)] == pytest.approx(r)
    assert got[2][1] == pytest.approx((r[2] - r[1] ** 2) / (1 - r[1] ** 2))
    assert [x["y"] for x in T.difference(d, "y", "i").orderBy("i").collect()] == pytest.approx(list(np.diff(y)))
    assert np.isfinite(T.arima(d, "y", "i", 1, 1, 1).first()["forecast"])
    assert T.decompose(d, "y", "i", 4).where("trend is not null").count() == 76


def test_series_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(i, float((i * 37) % 11)) for i in range(50)], "i long, y double")
    whole = {r["lag"]: r["acf"] for r in T.acf(d, "y", "i", 4).collect()}
    monkeypatch.setattr(T._blocks, "__defaults__", (7,))
    assert {r["lag"]: r["acf"] for r in T.acf(d, "y", "i", 4).collect()} == pytest.approx(whole)


def test_inference(spark, cases):
    y, v = np.array([0.31, 0.52, 0.77, 0.18]), np.array([0.02, 0.05, 0.04, 0.03])
    m = I.meta_analysis(spark.createDataFrame(list(zip(y.tolist(), v.tolist(), strict=True)), "y double, v double"), "y", "v").first()
    w = 1 / v
    q = (w * (y - (w * y).sum() / w.sum()) ** 2).sum()
    tau = max(0.0, (q - 3) / (w.sum() - (w**2).sum() / w.sum()))
    assert [m["q"], m["pooled"]] == pytest.approx([q, (y / (v + tau)).sum() / (1 / (v + tau)).sum()])
    apart = groups(spark, a=[1.1, 1.9, 1.4, 1.2, 1.7], b=[8.3, 8.8, 9.1, 8.2, 8.6])
    assert I.bayes_ttest(apart, "v", "g").first()["bf10"] > 10
    assert I.bayes_correlation(cases, "pain", "dose").first()["bf10"] > 3
    want = spark.createDataFrame([(0.5, 0.05, 0.8)], "effect double, alpha double, power double")
    assert I.solve_power(want, "n", "t_two").first()["n"] == 64


def test_imputation(cases):
    d = cases.withColumn("gain", F.when(F.col("id") != 3, F.col("gain")))
    assert C.impute(d, "gain").where("id = 3").first()["gain"] == pytest.approx(np.delete(GAIN, 3).mean())
    done = I.mice(d, ["gain", "age"], "id", sets=2, cycles=1)
    assert done.count() == 2 * N and done.where("gain is null").count() == 0
    assert {r["gain"] for r in done.where("id = 3").collect()} <= set(GAIN.tolist())


def test_cases_and_variables(spark, cases, tmp_path):
    d = cases.select("id", "age", "arm")
    assert [r["id"] for r in C.sort_cases(d, "age", "id").limit(3).collect()] == sorted(range(N), key=lambda i: (AGE[i], i))[:3]
    more = C.insert_cases(d, spark.createDataFrame([(N, "new")], "id long, arm string"))
    assert more.count() == N + 1 and more.where("age is null").count() == 1
    assert {r["id"]: r["arm"] for r in C.edit_cell(d, "id", 5, "arm", "none").collect()}[5] == "none"
    assert C.add_variable(d, "new", "double", label="x").columns[-1] == "new"
    assert C.retype(d, "arm", "double").where("arm is not null").count() == 0
    labelled = C.relabel(C.relabel(d, "age", label="years", dec=1), "age", dec=None)
    assert labelled.schema["age"].metadata == {"label": "years"}
    assert C.reorder(d, ["arm"]).columns == ["arm", "id", "age"] and C.delete_variables(d, ["age"]).columns == ["id", "arm"]
    with pytest.raises(ValueError):
        C.delete_variables(d, ["id", "age", "arm"])
    S.save_session({"one": labelled}, f"file://{tmp_path}/s")
    frames, active = S.open_session(spark, f"file://{tmp_path}/s")
    back = frames[active]
    assert back.count() == N and back.schema["age"].metadata["label"] == "years"
    assert V.lavaan_syntax({"f": ["a", "b"]}, [("f", "g")]) == "f =~ a + b\ng ~ f"


def test_codes_are_no_numbers(spark):
    d = spark.createDataFrame([("1d",), ("2f",), ("3D",), (" 4.5e1 ",), ("-.5",), ("1e",), ("0x1",), ("NaN",), ("+7.",)], "v string")
    assert [r[0] for r in d.select(parsed(F.col("v"))).collect()] == [None, None, None, 45.0, -0.5, None, None, None, 7.0]


def test_edges(spark):
    none = spark.createDataFrame([], "v double, g string")
    assert D.describe(none, "v").first()["n"] == 0
    assert M.anova_oneway(none, "v", "g").first()["f"] is None
    odd = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, "b"), (1.0, None), (float("inf"), "b"), (1.0, "b")], "v double, g string")
    r = D.describe(odd, "v").first()
    assert (r["n"], r["missing"], r["std"], r["skewness"]) == (3, 3, 0, None)
    assert C.transform(odd, "v", "zscore", "z").where("z is null").count() == 3
    with pytest.raises(ValueError):
        C.filter_cases(odd, "v > 5 and v < 6")
