"""Comparisons of means: t-tests, analyses of variance, post-hoc tests, linear models of group effects."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.special import chi2_p, div, f_p, t_inv, t_p, tukey_p
from statloom.plans.shared import cut
from statloom.plans.stats import gram, gram_columns, gram_of, moments, numbers, quantiles_of, rows, value_counts, weighed


def _d_interval(d: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Normal interval of Cohen's d."""
    se = F.sqrt(div(a + b, a * b) + div(d * d, 2 * (a + b - 2)))
    return d - 1.96 * se, d + 1.96 * se


def _moments(df: DataFrame, value: str, keys: dict[str, str], weight: str | None) -> DataFrame:
    """Moments of ``value`` by ``keys``; ``weight`` holds frequencies."""
    return moments(weighed(df, {"v": value}, keys, weight), "v", list(keys), "w" if weight else None)


def ttest_independent(df: DataFrame, value: str, group: str, levels: tuple[str, str] | None = None, weight: str | None = None) -> DataFrame:
    """Welch's t-test of two groups: those named, or the first two by value. ``weight`` holds frequencies.

    One row: sizes, means, deviations, t, df, p, interval of the difference, |d| and its
    interval. Zero variance in both groups gives null t.
    """
    g = _moments(df, value, {"g": group}, weight)
    if levels:
        g = g.where(F.col("g").isin(*map(str, levels))).withColumn("i", F.when(F.col("g") == str(levels[0]), 1).otherwise(2))
    else:
        g = g.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("g")))  # one row a group
    of = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    r = g.agg(*(of(c, i).alias(f"{c}{i}") for c in ("g", "n", "mean", "var") for i in (1, 2)))
    a, b = (F.col(f"var{i}") / F.col(f"n{i}") for i in (1, 2))
    r = r.withColumns({"se": F.sqrt(a + b), "df": div((a + b) * (a + b), div(a * a, F.col("n1") - 1) + div(b * b, F.col("n2") - 1))})
    pooled = F.sqrt(div((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), F.col("n1") + F.col("n2") - 2))
    r = r.withColumns({"diff": F.col("mean1") - F.col("mean2"), "t": div(F.col("mean1") - F.col("mean2"), F.col("se")), "cohens_d": F.abs(div(F.col("mean1") - F.col("mean2"), pooled)), "half": t_inv(0.05, F.round("df")) * F.col("se")})
    low, high = _d_interval(F.col("cohens_d"), F.col("n1").cast("double"), F.col("n2").cast("double"))
    return r.select(
        F.col("g1").alias("group_a"), F.col("g2").alias("group_b"), F.col("n1").alias("n_a"), F.col("n2").alias("n_b"), F.col("mean1").alias("mean_a"), F.col("mean2").alias("mean_b"),
        F.sqrt("var1").alias("sd_a"), F.sqrt("var2").alias("sd_b"), "diff", "se", "t", "df", t_p(F.col("t"), F.col("df")).alias("p"),
        (F.col("diff") - F.col("half")).alias("ci_lo"), (F.col("diff") + F.col("half")).alias("ci_hi"), "cohens_d", low.alias("d_lo"), high.alias("d_hi"),
    )


def _one_mean(m: DataFrame, mu: float) -> DataFrame:
    m = m.withColumn("se", F.sqrt(F.col("var") / F.col("n"))).withColumn("t", div(F.col("mean") - mu, F.col("se"))).withColumn("half", t_inv(0.05, F.col("n") - 1) * F.col("se"))
    return m.select(
        "n", "mean", F.sqrt("var").alias("sd"), "se", (F.col("mean") - mu).alias("diff"), "t", (F.col("n") - 1).alias("df"), t_p(F.col("t"), F.col("n") - 1).alias("p"),
        (F.col("mean") - mu - F.col("half")).alias("ci_lo"), (F.col("mean") - mu + F.col("half")).alias("ci_hi"), F.abs(div(F.col("mean") - mu, F.sqrt("var"))).alias("cohens_d"),
    )


def ttest_one_sample(df: DataFrame, value: str, mu: float = 0.0, weight: str | None = None) -> DataFrame:
    """One row: n, mean, sd, se, diff, t, df, p, interval of the difference, |d|; ``weight`` holds frequencies."""
    return _one_mean(_moments(df, value, {}, weight), mu)


def ttest_paired(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """As the one-sample test, of the differences a - b of complete pairs."""
    d = weighed(df, {"a": a, "b": b}, None, weight).select((F.col("a") - F.col("b")).alias("v"), "w")
    return _one_mean(moments(d, "v", weight="w" if weight else None), 0.0)


def _groups(d: DataFrame, weight: str | None = None) -> DataFrame:
    """Moments of groups of two cases or more, written once: cases are read in one pass, however often a plan joins them."""
    return cut(moments(d, "v", ["g"], weight).where("n >= 2"), "groups")


def _anova_row(s: DataFrame, keys: list[str] = ()) -> DataFrame:
    s = s.withColumns({"df_b": F.col("k") - 1, "df_w": F.col("n") - F.col("k")})
    s = s.withColumns({"ms_b": div(F.col("ss_b"), F.col("df_b")), "ms_w": div(F.col("ss_w"), F.col("df_w"))}).withColumn("f", div(F.col("ms_b"), F.col("ms_w")))
    omega = F.greatest(F.lit(0.0), div(F.col("ss_b") - F.col("df_b") * F.col("ms_w"), F.col("ss_b") + F.col("ss_w") + F.col("ms_w")))
    return s.select(*keys, "k", "n", "ss_b", "ss_w", "df_b", "df_w", "ms_b", "ms_w", "f", f_p(F.col("f"), F.col("df_b"), F.col("df_w")).alias("p"), div(F.col("ss_b"), F.col("ss_b") + F.col("ss_w")).alias("eta2"), omega.alias("omega2"))


def _spread(g: DataFrame) -> DataFrame:
    """(k, n, ss_b, ss_w) from moments of groups; the grand mean is joined as one row."""
    grand = g.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    d = g.crossJoin(F.broadcast(grand))  # one row
    return d.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ss_b"), F.coalesce(F.sum((F.col("n") - 1) * F.col("var")), F.lit(0.0)).alias("ss_w"))


def anova_oneway(df: DataFrame, value: str, group: str, weight: str | None = None) -> DataFrame:
    """(k, n, ss_b, ss_w, df_b, df_w, ms_b, ms_w, f, p, eta2, omega2); groups of one case are left out.

    ``weight`` holds frequencies.
    """
    return _anova_row(_spread(_groups(weighed(df, {"v": value}, {"g": group}, weight), "w" if weight else None)))


def eta2_interval(anova: DataFrame) -> DataFrame:
    """A result of ``anova_oneway`` with eta2_lo and eta2_hi: F moved by 1.96 either way, as the
    share that a noncentral spread of that size explains; null where F is not positive."""
    f, a, b = (F.col(c).cast("double") for c in ("f", "df_b", "df_w"))
    share = lambda nc: F.when(f > 0, nc / (nc + a + b + 1))
    return anova.withColumns({"eta2_lo": share(F.greatest(F.lit(0.0), f - 1.96) * a), "eta2_hi": share((f + 1.96) * a)})


def group_table(df: DataFrame, value: str, group: str, weight: str | None = None) -> DataFrame:
    """(grp, n, mean, sd, se) for each group; ``weight`` holds frequencies."""
    g = _moments(df, value, {"g": group}, weight)
    return g.select(F.col("g").alias("grp"), "n", "mean", F.sqrt("var").alias("sd"), F.sqrt(F.col("var") / F.col("n")).alias("se"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Analysis of variance of the absolute deviations from the group medians; cases are read once,
    for the counts of values that give both the medians and the deviations."""
    counts = cut(value_counts(numbers(df, {"v": value}, {"g": group}), "v", ["g"]), "counts")
    med = quantiles_of(counts, "v", {"med": 0.5}, ["g"]).select("g", "med")
    return _anova_row(_spread(_groups(counts.join(med, "g").select("g", F.abs(F.col("v") - F.col("med")).alias("v"), "n"), "n")))


def posthoc(df: DataFrame, value: str, group: str, how: str = "tukey") -> DataFrame:
    """(a, b, diff, se, stat, df, p_raw, p_adj) for each pair of groups: tukey, lsd, bonferroni or holm.

    All from the groups' moments. Tukey's p is the studentised range with the Tukey-Kramer
    standard error; Holm's p steps down and never falls.
    """
    g = _groups(numbers(df, {"v": value}, {"g": group}))
    s = _spread(g).select("k", (F.col("n") - F.col("k")).alias("df"), div(F.col("ss_w"), F.col("n") - F.col("k")).alias("msw"))
    side = lambda s: g.select(*(F.col(c).alias(f"{c}_{s}") for c in ("g", "n", "mean")))
    p = side("a").join(side("b"), F.col("g_a") < F.col("g_b")).crossJoin(F.broadcast(s))  # pairs of groups; s is one row
    p = p.withColumn("diff", F.col("mean_a") - F.col("mean_b"))
    inv = F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b")
    p = p.withColumn("se", F.sqrt(F.col("msw") * inv / (2 if how == "tukey" else 1))).withColumn("stat", div(F.abs(F.col("diff")) if how == "tukey" else F.col("diff"), F.col("se")))
    p = p.withColumn("p_raw", tukey_p(F.col("stat"), F.col("k"), F.col("df")) if how == "tukey" else t_p(F.col("stat"), F.col("df")))
    m = F.col("k") * (F.col("k") - 1) / 2
    if how == "holm":
        w = Window.partitionBy(F.lit(0)).orderBy("p_raw", "g_a", "g_b")  # one row a pair of groups
        p = p.withColumn("open", F.least(F.lit(1.0), F.col("p_raw") * (m - F.row_number().over(w) + 1)))
        p = p.withColumn("p_adj", F.max("open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        p = p.withColumn("p_adj", F.least(F.lit(1.0), F.col("p_raw") * m) if how == "bonferroni" else F.col("p_raw"))
    return p.select(F.col("g_a").alias("a"), F.col("g_b").alias("b"), "diff", "se", "stat", "df", "p_raw", "p_adj")


def cell_means(df: DataFrame, value: str, factors: list[str], weight: str | None = None) -> DataFrame:
    """(*factors, n, mean, sd, se): every cell of up to three factors and every margin, the levels of
    a factor that is summed over being null; the grand mean has nulls alone. What an
    interaction plot shows are the rows without nulls.

    One pass; margins are sums over the cells' moments.
    """
    names = [f"f{i}" for i in range(len(factors))]
    d = weighed(df, {"v": value}, dict(zip(names, factors, strict=True)), weight)
    at = d.agg(F.avg("v")).first()[0] or 0.0
    v = F.col("v") - float(at)
    c = d.cube(*names).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("s0"), F.sum(F.col("w") * v).alias("s1"), F.sum(F.col("w") * v * v).alias("s2")).where("n > 0")
    c = c.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), div(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("n") - 1))))
    return c.select(*(F.col(n).alias(f) for n, f in zip(names, factors, strict=True)), F.col("n").cast("bigint").alias("n"), (F.col("s0") / F.col("n")).alias("mean"), "sd", (F.col("sd") / F.sqrt("n")).alias("se"))


def anova_factorial(df: DataFrame, value: str, factors: list[str], weight: str | None = None) -> DataFrame:
    """(source, ss, df, ms, f, p, eta2, partial_eta2) of two or three crossed factors.

    One pass over the cases (cell moments); sums of squares of the margins, interactions by
    inclusion and exclusion. The error's degrees of freedom are n minus the number of cells:
    the full grid for two factors, the non-empty ones for three.
    """
    k = len(factors)
    if k not in (2, 3):
        raise ValueError("two or three factors")
    names = [f"f{i}" for i in range(k)]
    cells = _moments(df, value, dict(zip(names, factors, strict=True)), weight)
    # cube of the cells: every margin from cell totals
    total = F.col("n") * F.col("mean")
    cube = cells.withColumns({"total": total, "ssw": (F.col("n") - 1) * F.coalesce("var", F.lit(0.0))}).cube(*names).agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("ssw").alias("ssw"))
    s = cube.groupBy("gid").agg(F.sum(F.col("total") * F.col("total") / F.col("n")).alias("raw"), F.count("*").alias("levels"), F.sum("ssw").alias("ssw"), F.sum("n").alias("n"))
    got = {r["gid"]: r for r in s.collect()}  # 2 ** k rows
    full = (1 << k) - 1
    if not got or full not in got:
        return rows(df.sparkSession, [dict.fromkeys(("source", "ss", "df", "ms", "f", "p", "eta2", "partial_eta2"))]).limit(0)
    n, base = got[full]["n"], got[full]["raw"]
    at = lambda subset: full & ~sum(1 << (k - 1 - i) for i in subset)
    level = {(): 1} | {s: got[at(s)]["levels"] for r in range(1, k + 1) for s in combinations(range(k), r)}
    margin = {s: got[at(s)]["raw"] - base for r in range(1, k + 1) for s in combinations(range(k), r)}
    ss, dof = {}, {}
    for r in range(1, k + 1):
        for sub in combinations(range(k), r):
            ss[sub] = margin[sub] - sum(v for o, v in ss.items() if set(o) < set(sub))
            dof[sub] = int(np.prod([level[(i,)] - 1 for i in sub]))
    ssw = got[at(tuple(range(k)))]["ssw"]
    dfw = n - (level[(0,)] * level[(1,)] if k == 2 else level[tuple(range(k))])
    sst = margin[tuple(range(k))] + ssw
    out = [{"source": ":".join(factors[i] for i in sub), "ss": max(0.0, ss[sub]), "df": dof[sub]} for sub in ss]
    table = rows(df.sparkSession, [*out, {"source": "error", "ss": ssw, "df": dfw}])
    err = ssw / dfw if dfw > 0 else None
    effect = F.col("source") != "error"
    table = table.withColumn("ms", div(F.col("ss"), F.col("df"))).withColumn("f", F.when(effect, div(F.col("ms"), F.lit(err).cast("double"))))
    return table.select("source", "ss", "df", "ms", "f", F.when(effect, f_p(F.col("f"), F.col("df"), F.lit(float(dfw)))).alias("p"), F.when(effect, div(F.col("ss"), F.lit(float(sst)))).alias("eta2"), F.when(effect, div(F.col("ss"), F.col("ss") + float(ssw))).alias("partial_eta2"))


def anova_repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, k, ss_time, ss_subj, ss_err, df_time, df_err, f, p, partial_eta2) over complete cases, no sphericity correction."""
    names = [f"v{i}" for i in range(len(columns))]
    d = numbers(df, dict(zip(names, columns, strict=True)))
    g = gram(d, names)
    k, n = len(names), g.n
    if n < 2 or k < 2:
        return rows(df.sparkSession, [{"n": n, "k": k, **dict.fromkeys(("ss_time", "ss_subj", "ss_err", "df_time", "df_err", "f", "p", "partial_eta2"))}])
    # spread of subject means is the mean covariance; the rest of the within variance is error
    ss_time = n * ((g.mean - g.mean.mean()) ** 2).sum()
    ss_subj = k * (n - 1) * g.cov.sum() / k**2
    ss_err = (n - 1) * np.trace(g.cov) - ss_subj
    t = rows(df.sparkSession, [{"n": n, "k": k, "ss_time": ss_time, "ss_subj": ss_subj, "ss_err": ss_err, "df_time": k - 1, "df_err": (k - 1) * (n - 1)}])
    t = t.withColumn("f", div(F.col("ss_time") / F.col("df_time"), F.col("ss_err") / F.col("df_err")))
    return t.withColumns({"p": f_p(F.col("f"), F.col("df_time"), F.col("df_err")), "partial_eta2": div(F.col("ss_time"), F.col("ss_time") + F.col("ss_err"))})


def pairwise_paired(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, diff, se, t, df, p): paired t-tests of all pairs over complete cases, from one pass of covariances."""
    names = [f"v{i}" for i in range(len(columns))]
    g = gram(numbers(df, dict(zip(names, columns, strict=True))), names)
    out = []
    for i, j in combinations(range(len(columns)), 2):
        var = g.cov[i, i] + g.cov[j, j] - 2 * g.cov[i, j]
        out.append({"a": columns[i], "b": columns[j], "n": g.n, "diff": g.mean[i] - g.mean[j], "se": np.sqrt(max(0.0, var) / max(1, g.n))})
    t = rows(df.sparkSession, out).withColumn("t", div(F.col("diff"), F.col("se"))).withColumn("df", F.col("n") - 1)
    return t.withColumn("p", t_p(F.col("t"), F.col("df")))


def glm_univariate(df: DataFrame, value: str, factors: list[str], covariates: list[str] = ()) -> DataFrame:
    """(source, ss, df, f, p, partial_eta2): main effects only, each by itself, as marginal sums of squares.

    A factor has the spread of its group means, a covariate r squared of the total; what is
    left is error (at least 0).
    """
    fs = {f"f{i}": c for i, c in enumerate(factors)}
    cs = {f"c{i}": c for i, c in enumerate(covariates)}
    d = numbers(df, {"v": value, **cs}, fs)
    whole = d.agg(F.count("*").alias("n"), F.var_samp("v").alias("var"), F.avg("v").alias("m"), *(F.corr("v", c).alias(c) for c in cs)).first()
    n = whole["n"]
    sst = (n - 1) * (whole["var"] or 0.0)
    effects = []
    if fs:
        sets = d.groupingSets([[F.col(f)] for f in fs], *(F.col(f) for f in fs)).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.avg("v").alias("mean"))
        s = sets.groupBy("gid").agg(F.count("*").alias("k"), F.sum(F.col("n") * (F.col("mean") - whole["m"]) * (F.col("mean") - whole["m"])).alias("ss"))
        got = {r["gid"]: r for r in s.collect()}
        full = (1 << len(fs)) - 1
        for i, c in enumerate(factors):
            r = got[full & ~(1 << (len(fs) - 1 - i))]
            effects.append({"source": c, "ss": r["ss"], "df": r["k"] - 1})
    effects += [{"source": c, "ss": (whole[k] or 0.0) ** 2 * sst, "df": 1} for k, c in cs.items()]
    sse = max(0.0, sst - sum(e["ss"] for e in effects))
    dfe = n - 1 - sum(e["df"] for e in effects)
    t = rows(df.sparkSession, [*effects, {"source": "error", "ss": sse, "df": dfe}])
    mse = sse / dfe if dfe > 0 else None
    t = t.withColumn("f", F.when(F.col("source") != "error", div(F.col("ss") / F.col("df"), F.lit(mse).cast("double"))))
    return t.select("source", "ss", "df", "f", f_p(F.col("f"), F.col("df"), F.lit(float(dfe))).alias("p"), F.when(F.col("source") != "error", div(F.col("ss"), F.col("ss") + sse)).alias("partial_eta2"))


def glm_repeated(df: DataFrame, pre: str, post: str, between: str | None = None) -> DataFrame:
    """(effect, stat, df1, df2, p): paired t of post - pre, and the analysis of variance of the differences between groups."""
    keys = {"g": between} if between else {}
    d = numbers(df, {"a": pre, "b": post}, keys).withColumn("v", F.col("b") - F.col("a"))
    t = _one_mean(moments(d, "v"), 0.0).select(F.lit("time").alias("effect"), F.col("t").alias("stat"), F.lit(1).cast("bigint").alias("df1"), F.col("df").alias("df2"), "p")
    if not between:
        return t
    a = _anova_row(_spread(_groups(d.select("g", "v")))).where("k >= 2 and n >= k + 2")
    return t.unionAll(a.select(F.lit("time:group").alias("effect"), F.col("f").alias("stat"), F.col("df_b").alias("df1"), F.col("df_w").alias("df2"), "p"))


def manova(df: DataFrame, values: list[str], group: str) -> DataFrame:
    """(statistic, value, f, df1, df2, p): Pillai, Wilks, Hotelling-Lawley, Roy, and Box's M for one factor.

    Group covariances come from one grouped pass; they are pooled there, so the driver gets
    two k x k matrices and the log determinants' weighted sum. Roots are those of the
    symmetric problem whitened by the error matrix.
    """
    names = [f"v{i}" for i in range(len(values))]
    d = numbers(df, dict(zip(names, values, strict=True)), {"g": group})
    total = gram(d, names)
    cov = [f"c_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]
    by = d.groupBy("g").agg(*gram_columns(names)).where("n >= 2")
    pooled = by.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.lit(1.0) / (F.col("n") - 1)).alias("inv"), *(F.sum((F.col("n") - 1) * F.col(c)).alias(c) for c in cov)).first()
    p, k, n = len(names), pooled["k"], pooled["n"]
    e = np.zeros((p, p))
    for i, a in enumerate(names):
        for j in range(i, p):
            e[i, j] = e[j, i] = pooled[f"c_{a}_{names[j]}"]
    h = total.cov * (total.n - 1) - e
    low = np.linalg.inv(np.linalg.cholesky(e))
    roots = np.clip(np.linalg.eigvalsh(low @ h @ low.T)[::-1], 0, None)
    q, v = k - 1, n - k
    s = min(p, q)
    roots = roots[:s]
    pillai, wilks, hotelling, roy = (roots / (1 + roots)).sum(), np.prod(1 / (1 + roots)), roots.sum(), roots[0]
    m, o = (abs(p - q) - 1) / 2, (v - p - 1) / 2
    t = np.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    w = v + q - (p + q + 1) / 2
    wdf2 = w * t - (p * q - 2) / 2
    y = wilks ** (1 / t)
    out = [
        {"statistic": "pillai", "value": pillai, "f": (2 * o + s + 1) / (2 * m + s + 1) * pillai / max(1e-300, s - pillai), "df1": s * (2 * m + s + 1), "df2": s * (2 * o + s + 1)},
        {"statistic": "wilks", "value": wilks, "f": (1 - y) / max(1e-300, y) * wdf2 / (p * q), "df1": float(p * q), "df2": wdf2},
        {"statistic": "hotelling", "value": hotelling, "f": 2 * (s * o + 1) / (s * s * (2 * m + s + 1)) * hotelling, "df1": s * (2 * m + s + 1), "df2": 2 * (s * o + 1)},
        {"statistic": "roy", "value": roy, "f": roy * (v - max(p, q) + q) / max(p, q), "df1": float(max(p, q)), "df2": float(v - max(p, q) + q)},
    ]
    return rows(df.sparkSession, out).withColumn("p", f_p(F.col("f"), F.col("df1"), F.col("df2"))).unionByName(_box_m(by, names, e / v, k, n))


def manova_followups(df: DataFrame, values: list[str], group: str) -> DataFrame:
    """(variable, k, n, ss_b, ss_w, df_b, df_w, ms_b, ms_w, f, p, eta2, omega2): a one-way analysis of each
    dependent variable over the cases that ``manova`` uses, all from one grouped pass."""
    names = [f"v{i}" for i in range(len(values))]
    d = numbers(df, dict(zip(names, values, strict=True)), {"g": group})
    by = d.groupBy("g").agg(F.count("*").alias("n"), *(F.struct(F.avg(x).alias("mean"), F.var_samp(x).alias("var")).alias(x) for x in names)).where("n >= 2")
    each = by.select("g", "n", F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(x)["mean"].alias("mean"), F.col(x)["var"].alias("var")) for x, v in zip(names, values, strict=True)))).alias("e")).select("n", "e.*")
    grand = each.groupBy("variable").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    s = each.join(grand, "variable").groupBy("variable").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ss_b"), F.sum((F.col("n") - 1) * F.col("var")).alias("ss_w"))
    return _anova_row(s, ["variable"])


def _box_m(by: DataFrame, names: list[str], pooled: np.ndarray, k: int, n: int) -> DataFrame:
    """Box's M by its chi-squared approximation, scaled to an F with infinite df2 (null)."""
    p = len(names)
    m, inv = (n - k) * np.linalg.slogdet(pooled)[1], 0.0
    for r in by.toLocalIterator():  # one k x k matrix a group, one at a time
        g = gram_of(r, names)
        m -= (g.n - 1) * np.linalg.slogdet(g.cov)[1]
        inv += 1 / (g.n - 1)
    c = (inv - 1 / (n - k)) * (2 * p * p + 3 * p - 1) / (6 * (p + 1) * max(1, k - 1))
    dof = p * (p + 1) * (k - 1) / 2
    x = rows(by.sparkSession, [{"statistic": "box_m", "value": m, "f": m * (1 - c) / max(1.0, dof), "df1": float(dof), "df2": None}])
    return x.withColumn("p", chi2_p(F.col("f") * F.col("df1"), F.col("df1")))
