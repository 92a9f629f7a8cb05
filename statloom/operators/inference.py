"""Meta-analysis, Bayesian tests, power analysis, multiple imputation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.functions import special as S
from statloom.functions.special import chi2_p, div, lit, z_p
from statloom.operators.regression import solve
from statloom.plans.shared import cut
from statloom.plans.stats import Gram, gram, gram_columns, gram_of, joined, number, numbers, rows, running


def meta_analysis(df: DataFrame, effect: str, variance: str, model: str = "random") -> DataFrame:
    """(k, pooled, se, ci_lo, ci_hi, z, p, q, df, q_p, i2, tau2, fixed): inverse variance, DerSimonian-Laird.

    Studies without a positive variance are left out.
    """
    d = numbers(df, {"y": effect, "v": variance}).where("v > 0").withColumn("w", 1 / F.col("v"))
    s = d.agg(F.count("*").alias("k"), F.sum("w").alias("W"), F.sum(F.col("w") * F.col("w")).alias("W2"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("fixed"))
    q = d.crossJoin(F.broadcast(s.select("fixed"))).agg(F.sum(F.col("w") * (F.col("y") - F.col("fixed")) * (F.col("y") - F.col("fixed"))).alias("q"))  # one row
    s = s.crossJoin(q).withColumn("df", F.col("k") - 1)
    s = s.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(div(F.col("q") - F.col("df"), F.col("W") - F.col("W2") / F.col("W")), F.lit(0.0))))
    use = F.col("tau2") if model == "random" else F.lit(0.0)
    r = d.crossJoin(F.broadcast(s.select(use.alias("t")))).withColumn("r", 1 / (F.col("v") + F.col("t")))
    r = r.agg((F.sum(F.col("r") * F.col("y")) / F.sum("r")).alias("pooled"), F.sqrt(1 / F.sum("r")).alias("se"))
    o = s.crossJoin(r).withColumn("z", div(F.col("pooled"), F.col("se")))
    i2 = F.greatest(F.lit(0.0), F.coalesce(100 * div(F.col("q") - F.col("df"), F.col("q")), F.lit(0.0)))
    return o.select("k", "pooled", "se", (F.col("pooled") - 1.96 * F.col("se")).alias("ci_lo"), (F.col("pooled") + 1.96 * F.col("se")).alias("ci_hi"), "z", z_p(F.col("z")).alias("p"), "q", "df", chi2_p(F.col("q"), F.col("df")).alias("q_p"), i2.alias("i2"), "tau2", "fixed")


def forest(df: DataFrame, name: str, effect: str, variance: str, model: str = "random") -> DataFrame:
    """(study, y, se, ci_lo, ci_hi, weight_pct): rows of a forest or funnel plot."""
    t = meta_analysis(df, effect, variance, model).select(F.col("tau2") if model == "random" else F.lit(0.0).alias("tau2"))
    d = numbers(df, {"y": effect, "v": variance}, {"study": name}).where("v > 0").crossJoin(F.broadcast(t)).withColumn("r", 1 / (F.col("v") + F.col("tau2")))
    total = d.agg(F.sum("r").alias("whole"))
    se = F.sqrt("v")
    return d.crossJoin(F.broadcast(total)).select("study", "y", se.alias("se"), (F.col("y") - 1.96 * se).alias("ci_lo"), (F.col("y") + 1.96 * se).alias("ci_hi"), (100 * F.col("r") / F.col("whole")).alias("weight_pct"))


def bayes_ttest(df: DataFrame, value: str, group: str, scale: float = 0.707) -> DataFrame:
    """(n_a, n_b, t, df, p, cohens_d, bf10, bf01) of the first two groups: the JZS Bayes factor with a Cauchy prior.

    The mixing variance g is integrated over log g; the integrand is relative to the null.
    """
    from statloom.operators.means import ttest_independent

    m = ttest_independent(df, value, group)
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    sp = F.sqrt(div((na - 1) * F.col("sd_a") * F.col("sd_a") + (nb - 1) * F.col("sd_b") * F.col("sd_b"), na + nb - 2))
    m = m.select("n_a", "n_b", (na + nb - 2).alias("v"), div(na * nb, na + nb).alias("ne"), div(F.col("diff"), sp).alias("d"))
    m = m.withColumn("t", F.col("d") * F.sqrt("ne"))
    v, t2 = F.col("v"), F.col("t") * F.col("t")

    def density(u: Column) -> Column:
        g = F.exp(u)
        k = 1 + F.col("ne") * g * scale * scale
        log = -0.5 * F.log(k) - (v + 1) / 2 * (F.log1p(t2 / (k * v)) - F.log1p(t2 / v)) - 0.5 * math.log(2 * math.pi) - 1.5 * u - 0.5 / g + u
        return F.exp(log)

    bf = S.simpson(density, F.lit(-8.0), F.lit(40.0), 2000)
    m = m.withColumn("bf10", bf)
    return m.select("n_a", "n_b", "t", v.cast("bigint").alias("df"), S.t_p(F.col("t"), v).alias("p"), F.abs("d").alias("cohens_d"), "bf10", div(1.0, F.col("bf10")).alias("bf01"))


def bayes_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, p, bf10, bf01): Jeffreys' approximate factor for a flat prior on the correlation."""
    s = numbers(df, {"a": x, "b": y}).agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
    n, r = F.col("n").cast("double"), F.col("r")
    f = lambda rho: F.when(F.abs(rho) >= 1, 0.0).otherwise(F.exp((n - 1) / 2 * F.log(1 - rho * rho) - (n - 1.5) * F.log(1 - r * rho)) / 2)
    half = F.least(F.lit(2.0), 12 / F.sqrt(n))  # the likelihood is negligible further from r
    bf = S.simpson(f, F.greatest(F.lit(-1.0), r - half), F.least(F.lit(1.0), r + half), 1000)
    t = r * F.sqrt(div(n - 2, 1 - r * r))
    s = s.withColumns({"bf10": bf, "p": S.t_p(t, n - 2)})
    return s.select("n", "r", "p", "bf10", div(1.0, F.col("bf10")).alias("bf01"))


def bayes_normal(df: DataFrame, value: str, mu0: float = 0.0, kappa0: float = 0.01, alpha0: float = 0.01, beta0: float = 0.01) -> DataFrame:
    """(n, post_mean, post_sd, lo95, hi95, kappa_n, alpha_n, beta_n): normal - inverse-gamma posterior of a mean."""
    s = numbers(df, {"v": value}).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_pop("v") * F.count("v"), F.lit(0.0)).alias("ss"))
    n, m = F.col("n"), F.col("m")
    s = s.withColumns({"kappa_n": kappa0 + n, "alpha_n": alpha0 + n / 2})
    s = s.withColumns({"post_mean": (kappa0 * mu0 + n * m) / F.col("kappa_n"), "beta_n": beta0 + F.col("ss") / 2 + kappa0 * n * (m - mu0) * (m - mu0) / (2 * F.col("kappa_n"))})
    s = s.withColumn("post_sd", F.sqrt(div(F.col("beta_n"), F.col("alpha_n") * F.col("kappa_n"))))
    z = F.when(2 * F.col("alpha_n") <= 4, 2.0).otherwise(S.norm_inv(0.975))
    return s.select("n", "post_mean", "post_sd", (F.col("post_mean") - z * F.col("post_sd")).alias("lo95"), (F.col("post_mean") + z * F.col("post_sd")).alias("hi95"), "kappa_n", "alpha_n", "beta_n")


#: Steps of the grids on which posterior densities are given (even, for Simpson's rule).
GRID = 400


def _on_grid(s: DataFrame, centre: Column, width: Column) -> DataFrame:
    """``s`` (one row) with ``x`` at GRID + 1 even places within ``width`` of ``centre``, its place ``i`` and Simpson's weight."""
    g = s.withColumns({"centre": centre, "width": width}).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    weight = F.when(F.col("i").isin(0, GRID), 1.0).when(F.col("i") % 2 == 1, 4.0).otherwise(2.0) * 2 * F.col("width") / (3 * GRID)
    return g.withColumns({"x": F.col("centre") + F.col("width") * (2 * F.col("i") / GRID - 1), "weight": weight})


def _t_density(x: Column, centre: Column, scale: Column, v: Column) -> Column:
    u = (x - centre) / scale
    return F.exp(S.lgamma((v + 1) / 2) - S.lgamma(v / 2) - 0.5 * F.log(v * math.pi) - F.log(scale) - (v + 1) / 2 * F.log1p(u * u / v))


def posterior_normal(df: DataFrame, value: str, mu0: float = 0.0, kappa0: float = 0.01, alpha0: float = 0.01, beta0: float = 0.01, width: float = 5.0) -> DataFrame:
    """(i, x, prior, posterior): both marginal densities of the mean of ``bayes_normal``, Student's t, on
    GRID + 1 places within ``width`` posterior deviations of the posterior mean."""
    s = bayes_normal(df, value, mu0, kappa0, alpha0, beta0)
    g = _on_grid(s, F.col("post_mean"), width * F.col("post_sd"))
    prior = _t_density(F.col("x"), F.lit(float(mu0)), F.lit(math.sqrt(beta0 / (alpha0 * kappa0))), F.lit(2.0 * alpha0))
    return g.select("i", "x", prior.alias("prior"), _t_density(F.col("x"), F.col("post_mean"), F.col("post_sd"), 2 * F.col("alpha_n")).alias("posterior"))


def posterior_effect(df: DataFrame, value: str, group: str, scale: float = 0.707, mass: float = 0.95) -> DataFrame:
    """(i, delta, prior, posterior, inside): density of the standardised effect of ``bayes_ttest`` under its Cauchy prior.

    The likelihood is the non-central t's density; in delta it falls off like a normal one, and
    the grid of GRID + 1 places covers ten of its deviations, cut wider where the effect is small.
    ``posterior`` integrates to 1 by Simpson's rule. ``inside``: the place belongs to the interval
    of highest density that holds ``mass``. At delta = 0 posterior / prior is bf01.
    """
    s = bayes_ttest(df, value, group, scale).select("t", F.col("df").cast("double").alias("v"), (F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))).alias("ne"))
    spread = F.sqrt((1 + F.col("t") * F.col("t") / F.col("v")) / F.col("ne"))
    g = _on_grid(s.where(F.col("v") > 0), F.col("t") / F.sqrt("ne"), 10 * spread)
    shift = F.col("x") * F.sqrt("ne")
    like = S.nct_density(F.col("t"), F.col("v"), shift)
    g = g.withColumn("prior", 1 / (math.pi * scale * (1 + F.col("x") * F.col("x") / (scale * scale)))).withColumn("raw", like * F.col("prior"))
    whole = Window.partitionBy(F.lit(0))  # GRID + 1 rows
    g = g.withColumn("posterior", F.col("raw") / F.sum(F.col("raw") * F.col("weight")).over(whole))
    # cells of one width, highest first: those before the mass is reached are inside
    cell = F.col("posterior") * 2 * F.col("width") / GRID
    denser = F.coalesce(F.sum(cell).over(whole.orderBy(F.col("posterior").desc(), "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return g.select("i", F.col("x").alias("delta"), "prior", "posterior", (denser < mass).alias("inside"))


#: Tests of ``power`` and what ``k`` means for them.
POWER_TESTS = ("t_two", "t_one", "t_paired", "anova", "correlation", "chi2", "regression")


def power(test: str, effect, n, alpha=0.05, tails: int = 2, k: int = 2) -> Column:
    """Power as an expression. ``n`` is a group's size for t_two and anova, else the number of cases.

    ``effect``: d for t, f for anova, r, w for chi2, f squared for regression. ``k``: groups
    for anova, degrees of freedom for chi2, predictors for regression. Non-central
    distributions; correlation by Fisher's z.
    """
    effect, n, alpha = lit(effect).cast("double"), lit(n).cast("double"), lit(alpha).cast("double")
    if test in ("t_two", "t_one", "t_paired"):
        df, delta = (2 * n - 2, effect * F.sqrt(n / 2)) if test == "t_two" else (n - 1, effect * F.sqrt(n))

        def body(df: Column, delta: Column, crit: Column) -> Column:
            up = S.nct_sf(crit, df, delta)
            return up + 1 - S.nct_sf(-crit, df, delta) if tails == 2 else up

        value = S._named({"df": df, "delta": delta, "crit": S.t_inv(alpha if tails == 2 else 2 * alpha, df)}, body)
    elif test == "anova":
        value = S._named({"b": lit(k) - 1, "w": k * (n - 1), "lam": effect * effect * k * n, "alpha": alpha}, lambda b, w, lam, alpha: S.ncf_sf(S.f_inv(alpha, b, w), b, w, lam))
    elif test == "regression":
        value = S._named({"b": lit(k), "w": n - k - 1, "lam": effect * n, "alpha": alpha}, lambda b, w, lam, alpha: F.when(w >= 1, S.ncf_sf(S.f_inv(alpha, b, w), b, w, lam)).otherwise(0.0))
    elif test == "chi2":
        value = S._named({"v": lit(k), "lam": n * effect * effect, "alpha": alpha}, lambda v, lam, alpha: S.ncchi2_sf(S.chi2_inv(alpha, v), v, lam))
    elif test == "correlation":
        value = S.norm_cdf(F.atanh(F.abs(effect)) * F.sqrt(n - 3) - S.norm_inv(1 - alpha / tails))
    else:
        raise ValueError(test)
    return F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), value))


#: Largest sample size that ``solve_power`` looks at.
MOST_N = 100_000


def solve_power(df: DataFrame, want: str, test: str, tails: int = 2, k: int = 2) -> DataFrame:
    """``df`` (columns effect, n, alpha, power as far as known) with column ``want`` solved by bisection in each row.

    The smallest ``n`` that reaches the power, up to 100000; rows where that is not enough get null.
    """
    c = lambda x: F.col(x).cast("double")
    if want == "power":
        return df.withColumn("power", power(test, c("effect"), c("n"), c("alpha"), tails, k))
    least = {"t_two": 2, "anova": 2, "correlation": 4, "regression": k + 2}.get(test, 3)
    if want == "n":

        def body(effect: Column, alpha: Column, goal: Column) -> Column:
            reach = lambda n: power(test, effect, n, alpha, tails, k) >= goal

            def step(acc: Column, _: Column) -> Column:
                mid = F.floor((acc["lo"] + acc["hi"]) / 2)
                enough = reach(mid)
                return F.struct(F.when(enough, acc["lo"]).otherwise(mid.cast("double")).alias("lo"), F.when(enough, mid.cast("double")).otherwise(acc["hi"]).alias("hi"))

            start = F.struct(F.lit(float(least - 1)).alias("lo"), F.lit(float(MOST_N + 1)).alias("hi"))
            found = F.aggregate(F.sequence(F.lit(1), F.lit(17)), start, step, lambda a: a["hi"])
            return F.when(found <= MOST_N, found)

        return df.withColumn("n", S._named({"effect": c("effect"), "alpha": c("alpha"), "goal": c("power")}, body).cast("bigint"))
    if want == "effect":
        top = 0.9999 if test == "correlation" else 20.0
        body = lambda n, alpha, goal: S.bisect(lambda e: 1 - power(test, e, n, alpha, tails, k), 1 - goal, 1e-4, top, 40)
        return df.withColumn("effect", S._named({"n": c("n"), "alpha": c("alpha"), "goal": c("power")}, body))
    if want == "alpha":
        body = lambda effect, n, goal: S.bisect(lambda a: 1 - power(test, effect, n, a, tails, k), 1 - goal, 1e-4, 0.5, 40)
        return df.withColumn("alpha", S._named({"effect": c("effect"), "n": c("n"), "goal": c("power")}, body))
    raise ValueError(want)


def power_curve(spark: SparkSession, test: str, effect: float, alpha: float = 0.05, tails: int = 2, k: int = 2, most: int = 200, step: int = 5) -> DataFrame:
    """(n, power) for n = 5, 10, ... ``most``."""
    d = spark.range(5, most + 1, step).select(F.col("id").alias("n"), F.lit(effect).alias("effect"), F.lit(alpha).alias("alpha"))
    return solve_power(d, "power", test, tails, k).select("n", "power")


def power_curves(df: DataFrame, test: str, tails: int = 2, k: int = 2, most: int = 200, step: int = 5) -> DataFrame:
    """``df`` (columns effect and alpha, others kept) with (n, power) for n = 5, 10, ... ``most`` in each row."""
    return solve_power(df.withColumn("n", F.explode(F.sequence(F.lit(5), F.lit(most), F.lit(step)))), "power", test, tails, k)


def sensitivity_curve(spark: SparkSession, test: str, goal: float = 0.8, alpha: float = 0.05, tails: int = 2, k: int = 2, most: int = 200, step: int = 5) -> DataFrame:
    """(n, effect): the least effect that n = 5, 10, ... cases find with power ``goal``."""
    d = spark.range(5, most + 1, step).select(F.col("id").alias("n"), F.lit(alpha).alias("alpha"), F.lit(goal).alias("power"))
    return solve_power(d, "effect", test, tails, k).select("n", "effect")


def mice(df: DataFrame, columns: list[str], case_id: str, sets: int = 5, method: str = "pmm", cycles: int = 5, seed: int = 7) -> DataFrame:
    """(case_id, m, *columns): ``sets`` completed copies by chained equations.

    All sets go side by side: a step of a cycle is one aggregation with the covariances of
    every set; the driver draws each set's coefficients. ``normal`` adds normal noise, ``pmm``
    takes the observed value of one of the five cases around in predicted order. Randomness
    comes from hashes of written row numbers, so a lost task repeats its values.
    """
    d, names, _, _ = _chained(df, columns, case_id, sets, method, cycles, seed)
    each = F.explode(F.array(*(F.struct(F.lit(m + 1).alias("m"), *(F.col(f"{v}_{m}").alias(v) for v in names)) for m in range(sets))))
    return d.select(F.col("case").alias(case_id), each.alias("x")).select(case_id, "x.m", *(F.col(f"x.{v}").alias(c) for c, v in zip(columns, names, strict=True)))


def mice_convergence(df: DataFrame, columns: list[str], case_id: str, sets: int = 5, method: str = "pmm", cycles: int = 5, seed: int = 7) -> DataFrame:
    """(variable, m, cycle, mean, sd, rhat): the imputed values of each set after each cycle of ``mice``.

    ``rhat`` is Gelman and Rubin's factor of a variable's chains of means, the same in all its
    rows; null with fewer than two sets or cycles, or where no chain moves. Variables without a
    missing value have no rows. One pass a cycle over the written columns of imputed values.
    """
    _, names, trace, _ = _chained(df, columns, None, sets, method, cycles, seed, traced=range(cycles))
    out = []
    for v in dict.fromkeys(v for _, v, _, _, _ in trace):
        means = np.array([[mean for c, w, m, mean, _ in trace if w == v and m == s] for s in range(sets)])
        within = means.var(axis=1, ddof=1).mean() if cycles > 1 else 0.0
        rhat = math.sqrt((cycles - 1) / cycles + means.mean(axis=1).var(ddof=1) / within) if within > 0 and sets > 1 else None
        out += [{"variable": columns[names.index(v)], "m": m + 1, "cycle": c + 1, "mean": mean, "sd": sd, "rhat": rhat} for c, w, m, mean, sd in trace if w == v]
    return rows(df.sparkSession, out) if out else df.sparkSession.createDataFrame([], "variable string, m bigint, cycle bigint, mean double, sd double, rhat double")


def mice_pooled(df: DataFrame, columns: list[str], sets: int = 5, method: str = "pmm", cycles: int = 5, seed: int = 7) -> DataFrame:
    """``pool`` of the sets of ``mice``. Observed values are the same in every set: their moments are
    taken once and joined with those of the imputed values, so no completed copy is made."""
    _, names, trace, seen = _chained(df, columns, None, sets, method, cycles, seed, traced=range(cycles - 1, cycles))
    made = {(v, m): (mean, sd or 0.0) for _, v, m, mean, sd in trace}
    by = []
    for m in range(sets if seen["n"] else 0):
        row = {"m": m + 1}
        for v in names:
            n, lost, mean = seen["n"], seen[f"k{v}"], seen[v] or 0.0
            new, sd = made.get((v, m), (mean, 0.0))
            had = n - lost
            squares = (had - 1) * (seen[f"s{v}"] or 0.0) + max(0, lost - 1) * sd * sd + had * lost / n * (new - mean) ** 2
            row |= {f"a_{v}": (had * mean + lost * new) / n, f"u_{v}": squares / (n - 1) / n if n > 1 else None}
        by.append(row)
    kinds = ", ".join(["m int", *(f"a_{v} double, u_{v} double" for v in names)])
    return _rubin(rows(df.sparkSession, by) if by else df.sparkSession.createDataFrame([], kinds), columns)


def _chained(df: DataFrame, columns: list[str], case_id: str | None, sets: int, method: str, cycles: int, seed: int, traced: range = range(0)) -> tuple[DataFrame | None, list[str], list[tuple], dict]:
    """A row a case with <v>_<m>, variable v completed in set m (None without ``case_id``); the names v;
    (cycle, v, m, mean, sd) of imputed values for the cycles ``traced``; counts and moments of the observed ones.

    Complete cases never change: their covariances and donors are taken once, and a step reads
    and writes the other cases alone.
    """
    k, names = len(columns), [f"v{i}" for i in range(len(columns))]
    trace: list[tuple] = []
    case = [F.col(f"`{case_id}`").alias("case")] if case_id else []
    d = df.select(*case, F.monotonically_increasing_id().alias("id"), *(number(df, c).alias(v) for c, v in zip(columns, names, strict=True)))
    d = cut(d, "mice")  # fixes the row numbers, as case ids may repeat
    cells = _cells(d, names) if method != "normal" and k > 1 and cycles else None
    if cells is not None:
        means = _observed(cells, names)
    else:
        about = lambda v: (F.avg(v).alias(v), F.var_samp(v).alias(f"s{v}"), F.sum(F.col(v).isNull().cast("bigint")).alias(f"k{v}"))
        means = d.agg(F.count("*").alias("n"), *(x for v in names for x in about(v))).first().asDict()
    todo = [v for v in names if means[f"k{v}"]]
    whole = reduce(lambda x, y: x & y, (F.col(v).isNotNull() for v in names))
    full = d.where(whole)
    if cells is not None and todo and all(means[v] is not None for v in names):
        part, trace = _chained_cells(d, names, todo, cells, means, whole, sets, cycles, seed, traced)
        return (_completed(full, part, names, sets, lambda v, m: f"{v}_{m}") if case_id else None), names, trace, means
    at = lambda v, m: f"{v}_{m}" if v in todo else v
    filled = {f"{v}_{m}": F.coalesce(F.col(v), F.lit(float(means[v] or 0.0))) for m in range(sets) for v in todo}
    part = cut(d.where(~whole).withColumns(filled), "mice")
    rng = np.random.default_rng(seed)
    work = todo if k > 1 and cycles else []
    fixed = gram(full, names) if work else None
    ends = {v: cut(_ends(full.select(*(o for o in names if o != v), "id", F.col(v).alias("value")), [o for o in names if o != v]), "ends") for v in work} if method != "normal" else {}
    for c in range(cycles if work else 0):
        for v in work:
            others = [o for o in names if o != v]
            fields = [(m, [*(at(o, m) for o in others), at(v, m)]) for m in range(sets)]
            row = part.where(F.col(v).isNotNull()).agg(*(F.struct(*gram_columns(f)).alias(str(m)) for m, f in fields)).first()
            new = {}
            for m, f in fields:
                g = gram_of(row[str(m)], f)
                own = fixed.pick([*others, v])
                g = joined(Gram(f, own.n, own.mean, own.cov), g)
                new[m] = _drawn(g, rng)

            def yhat(m: int, own: bool = True, new=new, others=others) -> Column:
                b = new[m][0]
                return reduce(lambda y, xo: y + float(xo[0]) * F.col(at(xo[1], m) if own else xo[1]), zip(b[1:], others, strict=True), F.lit(float(b[0])))

            u = {m: _uniform(seed, c, m, names.index(v)) for m in new}
            if method == "normal":
                part = part.withColumns({at(v, m): F.coalesce(F.col(v), yhat(m) + new[m][1] * S.norm_inv(u[m])) for m in new})
            else:
                each = lambda own, yhat=yhat: F.explode(F.array(*(F.struct(F.lit(m).alias("m"), yhat(m, own).alias("p")) for m in range(sets))))
                own = _ends(part.select("id", F.col(v).alias("value"), each(True).alias("x")).select("x.m", "x.p", "id", "value"), ["m", "p"])
                both = own.unionByName(ends[v].select("n", "asked", "ds", each(False).alias("x")).select("x.*", "n", "asked", "ds"))
                got = cut(_donors(both, means["n"] - means[f"k{v}"]), "donors")
                lost = part.where(F.col(v).isNull())
                for m in new:
                    lost = lost.withColumn("p", yhat(m)).join(got.where(F.col("m") == m).select("p", "donors"), "p", "left")
                    lost = lost.withColumn(at(v, m), F.get("donors", F.floor(5 * u[m]).cast("int"))).drop("p", "donors")
                part = part.where(F.col(v).isNotNull()).unionByName(lost)
            part = cut(part, "mice")
        if c in traced:
            made = {(v, m): F.when(F.col(v).isNull(), F.col(at(v, m))) for v in todo for m in range(sets)}
            seen = part.agg(*(f(x).alias(f"{n}_{v}_{m}") for (v, m), x in made.items() for n, f in (("mean", F.avg), ("sd", F.stddev_samp)))).first()
            trace += [(c, v, m, seen[f"mean_{v}_{m}"], seen[f"sd_{v}_{m}"]) for v, m in made]
    return (_completed(full, part, names, sets, at) if case_id else None), names, trace, means


def _completed(full: DataFrame, part: DataFrame, names: list[str], sets: int, at) -> DataFrame:
    """(case, <v>_<m>) of complete cases and of the others, whose values are in columns ``at(v, m)``."""
    out = lambda t, name: t.select("case", *(F.col(name(v, m)).alias(f"{v}_{m}") for v in names for m in range(sets)))
    return out(full, lambda v, m: v).unionByName(out(part, at))


#: Most combinations of values for which chained equations count cells; beyond, cases are sorted by prediction.
CELLS = 1 << 15
#: Rows at either end of the row numbers, for each cell, in which its first and last cases are looked for: at first, and where those are too few.
EDGES = (128, 4096)


def _cells(d: DataFrame, names: list[str]) -> np.ndarray | None:
    """Each combination of values (nan: none) with its number of cases last, or None where they are more than ``CELLS``."""
    few = d.limit(2 * CELLS).agg(*(F.size(F.collect_set(v)).alias(v) for v in names)).first()
    if math.prod(k + 1 for k in few) > CELLS:
        return None
    found = d.groupBy(*names).agg(F.count("*").alias("n")).limit(CELLS + 1).collect()
    cells = np.array([[np.nan if x is None else x for x in r] for r in found], float).reshape(-1, len(names) + 1)
    return cells if math.prod(len(set(x[~np.isnan(x)])) + 1 for x in cells.T[:-1]) <= CELLS else None


def _observed(cells: np.ndarray, names: list[str]) -> dict:
    """n cases, and for each variable v its mean, variance s<v> and cases without a value k<v>."""
    out = {"n": int(cells[:, -1].sum())}
    for i, v in enumerate(names):
        x, n = cells[~np.isnan(cells[:, i])][:, [i, -1]].T
        mean = float(n @ x / n.sum()) if len(n) else None
        out |= {v: mean, f"s{v}": float(n @ (x - mean) ** 2 / (n.sum() - 1)) if n.sum() > 1 else None, f"k{v}": out["n"] - int(n.sum())}
    return out


def _array(x: np.ndarray, kind: str) -> Column:
    """A constant array; Spark folds it before a pass."""
    return F.split(F.lit(",".join(map(str, x.tolist()))), ",").cast(f"array<{kind}>")


def _chained_cells(d: DataFrame, names: list[str], todo: list[str], cells: np.ndarray, means: dict, whole: Column, sets: int, cycles: int, seed: int, traced: range) -> tuple[DataFrame, list[tuple]]:
    """The incomplete cases of ``_chained`` by predictive means, and its trace, where variables have few distinct values.

    Values are numbered, a variable's mean last. A step counts the cases of each combination of the
    other variables' values, a cell; complete cases were counted at the start. Coefficients and the
    donors of all cells follow on the driver, and cases find theirs by number in the next pass.
    Incomplete cases are written once a cycle, the numbers of all sets in one column a variable.
    """
    values = {v: np.array([*np.unique(x[~np.isnan(x)]), means[v]]) for v, x in zip(names, cells.T, strict=False)}
    d = d.withColumn("of", F.shiftright("id", 33))
    edges = _edges(d, max(math.prod(len(values[o]) for o in names if o != v) for v in todo))
    d = d.drop("of")
    for v in names:
        numbered = d.sparkSession.range(1).select(F.posexplode(F.lit(values[v][:-1].tolist())).alias(f"c{v}", v))
        d = d.join(F.broadcast(numbered), v, "left").drop(v).withColumnRenamed(f"c{v}", v)
    others = {v: [o for o in names if o != v] for v in todo}
    grid = {v: np.stack([x.ravel() for x in np.meshgrid(*(values[o] for o in others[v]), indexing="ij")], axis=1) for v in todo}
    bits = {v: (len(values[v]) - 1).bit_length() for v in todo}
    place = lambda v, m: (f"{v}_{m // (62 // bits[v])}", bits[v] * (m % (62 // bits[v])))

    def now(v: str, m: int | None) -> str:
        """A case's number of v in set m, or as observed."""
        if v not in todo or m is None:
            return v
        name, shift = place(v, m)
        return f"coalesce({v}, cast(shiftright({name}, {shift}) & {(1 << bits[v]) - 1} as int))"

    def cell(v: str, m: int | None = None) -> Column:
        """The row of ``grid[v]`` that a case has, in set m or as observed."""
        return F.expr(reduce(lambda x, o: f"({x} * {len(values[o])} + {now(o, m)})" if x else now(o, m), others[v], ""))

    def kept(v: str, made: list[Column]) -> dict[str, Column]:
        """Columns with the numbers ``made`` for each set."""
        at: dict[str, Column] = {}
        for m, x in enumerate(made):
            name, shift = place(v, m)
            at[name] = F.shiftleft(x.cast("bigint"), shift) + at.get(name, F.lit(0))
        return {name: F.when(F.col(v).isNull(), x) for name, x in at.items()}

    # number of complete cases, sum and squares of v about its mean, in each cell
    own, known = {}, cells[~np.isnan(cells).any(axis=1)]
    for v in todo:
        at = np.ravel_multi_index([np.searchsorted(values[o][:-1], known[:, names.index(o)]) for o in others[v]], [len(values[o]) for o in others[v]])
        away = known[:, names.index(v)] - means[v]
        own[v] = np.stack([np.bincount(at, known[:, -1] * x, len(grid[v])) for x in (np.ones(len(away)), away, away * away)])
    ends = dict(zip(todo, _outer(d.where(whole), [(v, cell(v)) for v in todo], [own[v][0] for v in todo], edges, "ends"), strict=True))
    part = d.where(~whole)
    for v in todo:
        part = part.withColumns(kept(v, [F.lit(len(values[v]) - 1)] * sets))
    part = cut(part, "mice")
    rng, trace = np.random.default_rng(seed), []
    for c in range(cycles):
        for v in todo:
            size, have, at = len(grid[v]), part.where(F.col(v).isNotNull()), [cell(v, m) for m in range(sets)]
            each = have.select(F.get(_array(values[v] - means[v], "double"), F.col(v)).alias("x"), F.explode(F.array(*(x + m * size for m, x in enumerate(at)))).alias("at"))
            sums = np.zeros((3, sets * size))
            for r in each.groupBy("at").agg(F.count("*"), F.sum("x"), F.sum(F.col("x") * F.col("x"))).collect():
                sums[:, r[0]] = r[1:]
            sums = sums.reshape(3, sets, size)
            five = _outer(have, [(v, x) for x in at], list(sums[0]), edges)
            made = []
            for m in range(sets):
                n, x, xx = own[v] + sums[:, m]
                b, _ = _drawn(_gram_cells([*others[v], v], grid[v], n, x, xx, means[v]), rng)
                p = reduce(lambda y, bx: y + bx[0] * bx[1], zip(b[1:], grid[v].T, strict=True), np.full(size, b[0]))
                donors = _nearest(p, n.astype(np.int64), np.concatenate([ends[v], five[m]]), means["n"] - means[f"k{v}"])
                made.append(F.get(_array(donors.ravel(), "int"), at[m] * 5 + F.floor(5 * _uniform(seed, c, m, names.index(v))).cast("int")))
            part = part.withColumns(kept(v, made))
        if c < cycles - 1 or "case" in part.columns:
            part = cut(part, "mice")
        if c in traced:
            got = {(v, m): F.when(F.col(v).isNull(), F.get(_array(values[v], "double"), F.expr(now(v, m)))) for v in todo for m in range(sets)}
            seen = part.agg(*(f(x).alias(f"{n}_{v}_{m}") for (v, m), x in got.items() for n, f in (("mean", F.avg), ("sd", F.stddev_samp)))).first()
            trace += [(c, v, m, seen[f"mean_{v}_{m}"], seen[f"sd_{v}_{m}"]) for v, m in got]
    return part.select(*(x for x in ["case"] if x in part.columns), *(F.get(_array(values[v], "double"), F.expr(now(v, m))).alias(f"{v}_{m}") for v in names for m in range(sets))), trace


def _edges(d: DataFrame, cells: int) -> list[tuple[int, int]]:
    """For each of ``EDGES`` two row numbers: that of the row that is so many times ``cells`` from the first, and from the last.
    ``of`` is the task that numbered a row; within one the numbers have no gap."""
    tasks = sorted((r["of"], r["n"]) for r in d.groupBy("of").agg(F.count("*").alias("n")).collect())
    ids, size = np.array([of << 33 for of, _ in tasks]), np.array([n for _, n in tasks])
    upto = np.cumsum(size)

    def row(at: int) -> int:
        i = int(np.searchsorted(upto, at, side="right"))
        return int(ids[i] + at - (upto[i] - size[i]))

    most = [min(x * cells, int(upto[-1])) for x in EDGES]
    return [(row(x - 1), row(int(upto[-1]) - x)) for x in most]


def _outer(t: DataFrame, asks: list[tuple[str, Column]], totals: list[np.ndarray], edges: list[tuple[int, int]], name: str | None = None) -> list[np.ndarray]:
    """For each (v, cell) of ``asks`` rows (cell, id, number) of v that hold the first two and last three cases
    with a value of each cell; ``totals`` says how many cells have. They are looked for among the rows outside of
    ``edges``; cells that have too few there are searched in the next, at last in all rows."""
    start = np.cumsum([0, *(len(x) for x in totals)])
    total = np.concatenate(totals)
    each = F.explode(F.array(*(F.struct((cell + int(k)).alias("at"), F.col(v).alias("got")) for (v, cell), k in zip(asks, start[:-1], strict=True))))
    rows = t.select("id", each.alias("x")).select("id", "x.at", "x.got").where("got is not null")
    out, short = [], np.ones(len(total), bool)
    for i, (low, high) in enumerate(edges):
        below = F.col("id") <= low
        near = (rows.where(F.get(_array(short.astype(np.int64), "int"), F.col("at")) == 1) if i else rows).where(below | (F.col("id") >= high))
        near = near.groupBy("at", below.alias("low")).agg(F.count("*").alias("n"), _five(F.collect_list(F.struct("id", "got"))).alias("ds"))
        near = (cut(near, name) if name and not i else near).collect()
        found = np.zeros((2, len(total)), np.int64)
        for r in near:
            found[int(r["low"]), r["at"]] = r["n"]
        short = ((found[1] < 2) | (found[0] < 3)) & (found.sum(axis=0) < total) & short
        out += [(r["at"], *x) for r in near if not short[r["at"]] for x in r["ds"]]
        if not short.any():
            break
    else:
        wanted = rows.where(F.get(_array(short.astype(np.int64), "int"), F.col("at")) == 1)
        out += [(r["at"], *x) for r in _ends(wanted.select("at", "id", F.col("got").cast("double").alias("value")), ["at"]).collect() for x in r["ds"]]
    out = np.array(out, np.int64).reshape(-1, 3)
    return [out[(out[:, 0] >= a) & (out[:, 0] < b)] - [a, 0, 0] for a, b in zip(start[:-1], start[1:], strict=True)]


def _uniform(seed: int, c: int, m: int, i: int) -> Column:
    """A number between 0 and 1 for each row number: cycle c, set m, variable i."""
    return F.expr(f"((xxhash64(id, {seed * 1_000_003 + c * 1009 + m * 31 + i}) & {(1 << 52) - 1}) + 0.5D) / {1 << 52}D")


def _drawn(g: Gram, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Coefficients of the last column on the others, and residual deviation, drawn from their posterior."""
    k = len(g.names)
    fit = solve(g, g.names[:-1], g.names[-1])
    s = math.sqrt(fit["sse"] / max(1, fit["n"] - k) * max(1, fit["n"] - k) / rng.chisquare(max(1, fit["n"] - k)))
    return fit["b"] + s * np.linalg.cholesky(fit["inv"] + 1e-12 * np.eye(k)) @ rng.standard_normal(k), s


def _gram_cells(names: list[str], x: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, centre: float) -> Gram:
    """Moments of the columns of ``x`` and of one more, of which each row of ``x`` has n cases with sums s and squares q about ``centre``."""
    total = n.sum()
    mean, rest = n @ x / total, s.sum() / total
    away = x - mean
    cov = np.empty((len(names), len(names)))
    cov[:-1, :-1] = (n[:, None] * away).T @ away
    cov[:-1, -1] = cov[-1, :-1] = away.T @ s
    cov[-1, -1] = q.sum() - total * rest * rest
    return Gram(names, int(total), np.append(mean, centre + rest), cov / (total - 1))


def _nearest(p: np.ndarray, n: np.ndarray, five: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the ``_donors`` of every cell: p its prediction, n its observed cases, of which ``five`` has (cell, id, number) of the first two and last three at least."""
    levels, of = np.unique(p, return_inverse=True)
    count = np.zeros(len(levels), np.int64)
    np.add.at(count, of, n)
    upto = np.cumsum(count)
    level, code = of[five[:, 0]], five[:, 2]
    order = np.lexsort((five[:, 1], level))
    level, code = level[order], code[order]
    size = np.bincount(level, minlength=len(levels))
    rank = np.arange(len(level)) - (np.cumsum(size) - size)[level]
    keep = (rank < 2) | (rank >= size[level] - 3)
    # of those left the last three stand at the end of their level, the others at its start
    back = (size[level] - rank)[keep]
    level, code, rank = level[keep], code[keep], rank[keep]
    place = np.where(rank < 2, upto[level] - count[level] + rank + 1, upto[level] - back + 1)
    at = np.clip(upto[:, None] + np.arange(-2, 3), 1, most)
    return code[np.searchsorted(place, at)][of]


#: Rows that ``_ends`` gathers before it reduces them.
_GATHER = 1 << 18


def _shortened(keys: list[np.ndarray], ids: np.ndarray, values: np.ndarray, seen: np.ndarray, asked: np.ndarray) -> tuple:
    """The first two and last three rows with a value of each group (a row without one where there is none);
    the group's sums of ``seen`` and ``asked`` stand in the first of them."""
    gone = np.isnan(values)
    order = np.lexsort((ids, gone, *reversed(keys)))
    keys, ids, values, seen, asked, gone = [x[order] for x in keys], ids[order], values[order], seen[order], asked[order], gone[order]
    new = np.ones(len(ids), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys]) if keys else False
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    have = np.add.reduceat((~gone).astype(np.int64), first)
    rank = np.arange(len(ids)) - first[group]
    keep = new | (~gone & ((rank < 2) | (rank >= have[group] - 3)))
    total = [np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)]
    for t, x in zip(total, (seen, asked), strict=True):
        t[first] = np.add.reduceat(x, first)
    return [x[keep] for x in keys], ids[keep], values[keep], total[0][keep], total[1][keep]


def _ends(d: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n, asked, ds): for each group of ``d`` (keys, id, value) the number of its rows with a value and
    of those without, and (id, value) of the first two and last three with one, in order of id.

    Each task reduces its own rows, a gathering at a time, so that a group costs no more than five of
    them a task in the shuffle.
    """
    import pyarrow as pa

    d = d.select(*keys, "id", "value")
    kinds = dict(d.dtypes)

    def each(batches):
        def made(rows):
            ks, ids, values, seen, asked = rows
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in ks), pa.array(ids), pa.array(values, mask=np.isnan(values)), pa.array(seen), pa.array(asked)], [*keys, "id", "value", "seen", "asked"])

        def put(rows):
            ks = [np.concatenate(x) for x in zip(*(r[0] for r in rows), strict=True)]
            return _shortened(ks, *(np.concatenate(x) for x in zip(*(r[1:] for r in rows), strict=True)))

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("value").cast(pa.float64()).to_numpy(zero_copy_only=False)
            gone = np.isnan(values)
            held.append(([batch.column(x).to_numpy(zero_copy_only=False) for x in keys], batch.column("id").to_numpy(), values, (~gone).astype(np.int64), gone.astype(np.int64)))
            size += batch.num_rows
            if size >= _GATHER:
                held = [put(held)]
                size = len(held[0][1])
                if size >= _GATHER // 2:  # hardly anything repeats
                    yield made(held[0])
                    held, size = [], 0
        if held:
            yield made(put(held))

    rows = d.mapInArrow(each, ", ".join([*(f"{x} {kinds[x]}" for x in keys), "id bigint, value double, seen bigint, asked bigint"]))
    some = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("id", "value")))
    return rows.groupBy(*keys).agg(F.sum("seen").alias("n"), F.sum("asked").alias("asked"), _five(some).alias("ds"))


def _five(ds: Column) -> Column:
    """The first two and last three of an array, or all of a shorter one, in order."""
    ds = F.sort_array(ds)
    return F.when(F.size(ds) > 5, F.concat(F.slice(ds, 1, 2), F.slice(ds, -3, 3))).otherwise(ds)


def _donors(both: DataFrame, most: int) -> DataFrame:
    """(m, p, donors) for each prediction p that a case without a value has in set m: the values of the
    observed cases 2 places before to 2 after the last one up to p, in order of prediction and row.
    ``both`` holds (m, p, n, asked, ds) as from ``_ends``; ``most`` cases are observed."""
    t = both.groupBy("m", "p").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"), _five(F.flatten(F.collect_list("ds"))).alias("ds"))
    r = running(t, "p", ["n"], ["m"])
    place = F.when(F.col("j") < 2, F.col("cum_n") - F.col("n") + F.col("j") + 1).otherwise(F.col("cum_n") - F.size("ds") + F.col("j") + 1)
    own = r.select("m", "n", "cum_n", "ds", F.posexplode("ds").alias("j", "x")).select("m", place.cast("bigint").alias("at"), F.col("x.value").alias("got"))
    ask = r.where("asked > 0").select("m", "p", "cum_n", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("off"))
    ask = ask.select("m", "p", "off", F.greatest(F.lit(1), F.least(F.lit(most), F.col("cum_n") + F.col("off"))).cast("bigint").alias("at"))
    got = ask.join(own, ["m", "at"]).groupBy("m", "p").agg(F.sort_array(F.collect_list(F.struct("off", "got"))).alias("l"))
    return got.select("m", "p", F.transform("l", lambda x: x["got"]).alias("donors"))


def pool(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, sets, mean, within, between, se, fmi) of completed sets in column m, by Rubin's rules for means."""
    names = [f"v{i}" for i in range(len(columns))]
    d = df.select("m", *(number(df, c).alias(v) for c, v in zip(columns, names, strict=True)))
    return _rubin(d.groupBy("m").agg(*(F.avg(v).alias(f"a_{v}") for v in names), *((F.var_samp(v) / F.count(v)).alias(f"u_{v}") for v in names)), columns)


def _rubin(by: DataFrame, columns: list[str]) -> DataFrame:
    """``pool`` from a row a set: means a_v and their variances u_v."""
    names = [f"v{i}" for i in range(len(columns))]
    s = by.agg(F.count("*").alias("sets"), *(F.avg(f"a_{v}").alias(f"m_{v}") for v in names), *(F.avg(f"u_{v}").alias(f"w_{v}") for v in names), *(F.coalesce(F.var_samp(f"a_{v}"), F.lit(0.0)).alias(f"b_{v}") for v in names))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"m_{v}").alias("mean"), F.col(f"w_{v}").alias("within"), F.col(f"b_{v}").alias("between")) for c, v in zip(columns, names, strict=True))))
    return s.select("sets", each.alias("x")).select("x.variable", "sets", "x.mean", "x.within", "x.between", F.sqrt(F.col("x.within") + (1 + 1 / F.col("sets")) * F.col("x.between")).alias("se"), div((1 + 1 / F.col("sets")) * F.col("x.between"), F.col("x.within") + (1 + 1 / F.col("sets")) * F.col("x.between")).alias("fmi"))
