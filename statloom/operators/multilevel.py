"""Multilevel models from the sufficient statistics of clusters; one grouped pass over cases."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.special import chi2_p, div, f_p, z_p
from statloom.plans.stats import moments, numbers, rows


def icc(df: DataFrame, value: str, group: str) -> DataFrame:
    """(k, n, n0, icc1, icc2, var_between, var_within, msb, msw, f, p, deff, n_eff) by the unbalanced analysis of variance."""
    g = moments(numbers(df, {"v": value}, {"g": group}), "v", ["g"])
    grand = g.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    s = g.crossJoin(F.broadcast(grand)).agg(  # one row
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ssb"), F.coalesce(F.sum((F.col("n") - 1) * F.col("var")), F.lit(0.0)).alias("ssw"),
    )
    s = s.withColumns({"n0": div(F.col("n") - F.col("nn") / F.col("n"), F.col("k") - 1), "msb": div(F.col("ssb"), F.col("k") - 1), "msw": div(F.col("ssw"), F.col("n") - F.col("k"))})
    s = s.withColumn("var_between", F.greatest(F.lit(0.0), div(F.col("msb") - F.col("msw"), F.col("n0")))).withColumn("icc1", div(F.col("var_between"), F.col("var_between") + F.col("msw")))
    s = s.withColumns({"f": div(F.col("msb"), F.col("msw")), "deff": 1 + (F.col("n") / F.col("k") - 1) * F.col("icc1")})
    return s.select("k", "n", "n0", "icc1", F.greatest(F.lit(0.0), div(F.col("msb") - F.col("msw"), F.col("msb"))).alias("icc2"), "var_between", F.col("msw").alias("var_within"), "msb", "msw", "f", f_p(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")).alias("p"), "deff", div(F.col("n"), F.col("deff")).alias("n_eff"))


def _cluster_stats(d: DataFrame, xs: list[str], keys: list[str]) -> DataFrame:
    """Sums and products of 1, xs and y for each cluster; columns are centred before."""
    names = ["one", *xs, "y"]
    return d.groupBy(*keys).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"q_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j))


def _profile(stats: DataFrame, k: int, grid: list[tuple[float, float]]) -> list[dict]:
    """Generalised least squares at each pair (tau2, tau3) of variance ratios, in one pass over clusters.

    The inverse covariances of nested intercepts are the identity less a multiple of ones at
    each level, so every product is a sum of cluster terms.
    """
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    points = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(grid)))
    e = stats.withColumn("p", F.explode(points)).withColumn("th", F.col("p.a") / (1 + F.col("q_0_0") * F.col("p.a")))
    low = e.groupBy("g3", "p").agg(*(F.sum(F.col(f"q_{i}_{j}") - F.col("th") * F.col(f"q_0_{i}") * F.col(f"q_0_{j}")).alias(f"a_{i}_{j}") for i, j in pairs), F.sum(F.log1p(F.col("q_0_0") * F.col("p.a"))).alias("ld"), F.sum("q_0_0").alias("n"))
    low = low.withColumn("ph", F.col("p.b") / (1 + F.col("a_0_0") * F.col("p.b")))
    top = low.groupBy("p").agg(*(F.sum(F.col(f"a_{i}_{j}") - F.col("ph") * F.col(f"a_0_{i}") * F.col(f"a_0_{j}")).alias(f"m_{i}_{j}") for i, j in pairs), F.sum(F.col("ld") + F.log1p(F.col("a_0_0") * F.col("p.b"))).alias("ld"), F.sum("n").alias("n"))
    out = []
    for r in top.collect():  # one row a point of the grid
        m = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        inv = np.linalg.inv(m[:-1, :-1])
        b = inv @ m[:-1, -1]
        s2 = (m[-1, -1] - b @ m[:-1, -1]) / r["n"]
        out.append({"a": r["p"]["a"], "b": r["p"]["b"], "beta": b, "inv": inv, "s2": s2, "n": r["n"], "dev": r["n"] * (np.log(2 * np.pi * s2) + 1) + r["ld"]})
    return out


def _fit(stats: DataFrame, k: int, three: bool, rounds: int = 3) -> dict:
    """Maximum likelihood: a coarse grid over log ratios, finer ones around the best point, then Newton's steps."""
    logs = np.linspace(-4, 2, 9)
    a, b = [0.0, *10.0**logs], [0.0, *10.0**logs] if three else [0.0]
    step, best = logs[1] - logs[0], None
    for _ in range(rounds):
        found = _profile(stats, k, list(product(a, b)))
        best = min([*found, *([best] if best else [])], key=lambda f: f["dev"])
        step /= 2.5
        near = lambda v: [v * 10 ** (step * i) for i in (-2, -1, 0, 1, 2)] if v > 0 else [0.0, 1e-6, 1e-5]  # noqa: B023, E731
        a, b = near(best["a"]), near(best["b"]) if three else [0.0]
    return _polish(stats, k, best)


def _polish(stats: DataFrame, k: int, best: dict, rounds: int = 12) -> dict:
    """Newton's steps in the logs of the ratios that aren't zero, from central differences of the profile: all
    points of a step in one pass. Ends at changes of 1e-9, or where rounding hides them."""
    free = [c for c in "ab" if best[c] > 0]
    x, h = np.log([best[c] for c in free]), 5e-3
    for _ in range(rounds if free else 0):
        moves = [np.array(m) for m in product((-1, 0, 1), repeat=len(free))]
        grid = [dict(zip(free, np.exp(x + h * m), strict=True)) for m in moves]
        found = sorted(_profile(stats, k, [(float(g.get("a", 0.0)), float(g.get("b", 0.0))) for g in grid]), key=lambda f: (f["a"], f["b"]))
        dev = np.array([f["dev"] for f in found]).reshape([3] * len(free))
        mid = tuple([1] * len(free))
        to = lambda *steps: dev[tuple(np.add(mid, sum(np.array(s) for s in steps)))]  # noqa: B023, E731
        e = np.eye(len(free), dtype=int)
        grad = np.array([(to(e[i]) - to(-e[i])) / (2 * h) for i in range(len(free))])
        hess = np.array([[(to(e[i], e[j]) - to(e[i], -e[j]) - to(-e[i], e[j]) + to(-e[i], -e[j])) / (4 * h * h) if i != j else (to(e[i]) - 2 * dev[mid] + to(-e[i])) / h**2 for j in range(len(free))] for i in range(len(free))])
        best = found[len(found) // 2]
        if np.linalg.eigvalsh(hess).min() <= 0:  # flat: the variance goes to zero
            break
        step = np.clip(np.linalg.solve(hess, -grad), -1, 1)
        x = x + step
        if np.abs(step).max() < 1e-9:
            break
        h = 1e-3 if np.abs(step).max() < 1e-3 else 5e-3
        if np.abs(step).max() < 1e-7 and h == 1e-3:
            break
    return best


def _prepared(df: DataFrame, value: str, xs: list[str], keys: dict[str, str], level2: list[str]) -> tuple[DataFrame, list[str]]:
    f = {f"x{i}": c for i, c in enumerate(xs)} | {f"w{i}": c for i, c in enumerate(level2)} | {"y": value}
    d = numbers(df, f, keys)
    if level2:
        means = d.groupBy("g2").agg(*(F.avg(f"w{i}").alias(f"u{i}") for i in range(len(level2))))
        d = d.join(means, "g2").drop(*(f"w{i}" for i in range(len(level2)))).withColumnsRenamed({f"u{i}": f"w{i}" for i in range(len(level2))})
    return d.withColumn("one", F.lit(1.0)), [f"x{i}" for i in range(len(xs))] + [f"w{i}" for i in range(len(level2))]


def hlm(df: DataFrame, value: str, group: str, level1: list[str], level2: list[str] = (), cross: bool = False, outer: str | None = None) -> DataFrame:
    """(term, b, se, z, p, n, k2, k3, sigma2, tau2, tau3, icc2, icc3, deviance, null_deviance, aic, bic, lrt, df, lrt_p, pseudo_r2).

    Random intercepts of ``group`` (nested in ``outer``, if given), by maximum likelihood.
    ``level2`` predictors are cluster means; ``cross`` adds the product of the first level-1
    with each level-2 predictor, both centred at their grand means.
    """
    keys = {"g2": group} | ({"g3": outer} if outer else {})
    d, names = _prepared(df, value, list(level1), keys, list(level2))
    labels = [*level1, *level2]
    s = d.agg(*(F.avg(c).alias(c) for c in [*names, "y"])).first()
    d = d.withColumns({c: F.col(c) - float(s[c] or 0.0) for c in names})
    if cross and level1:
        d = d.withColumns({f"c{i}": F.col("x0") * F.col(f"w{i}") for i in range(len(level2))})
        names, labels = [*names, *(f"c{i}" for i in range(len(level2)))], [*labels, *(f"{level1[0]}:{w}" for w in level2)]
    d = d.withColumn("y", F.col("y") - float(s["y"] or 0.0))
    if not outer:
        d = d.withColumn("g3", F.col("g2"))
    stats = _cluster_stats(d, names, ["g3", "g2"]).persist()
    full = _fit(stats, len(names) + 2, bool(outer))
    last = len(names) + 1
    null_stats = stats.select("g3", "g2", F.col("q_0_0"), F.col(f"q_0_{last}").alias("q_0_1"), F.col(f"q_{last}_{last}").alias("q_1_1"))
    null = _fit(null_stats, 2, bool(outer))
    k2, k3 = stats.count(), stats.select("g3").distinct().count()
    stats.unpersist()
    s2, t2, t3 = full["s2"], full["s2"] * full["a"], full["s2"] * full["b"]
    whole = s2 + t2 + t3
    p = len(names) + 1 + (3 if outer else 2)
    null_within, null_all = null["s2"], null["s2"] * (1 + null["a"] + null["b"])
    b, se = full["beta"].copy(), np.sqrt(np.diag(full["inv"]) * s2)
    shift = np.array([s[c] if c in s else 0.0 for c in names]) if not cross else np.zeros(len(names))
    b[0] += (s["y"] or 0.0) - shift @ b[1:]
    t = np.eye(len(b))
    t[0, 1:] = -shift
    se[0] = np.sqrt((t @ full["inv"] @ t.T)[0, 0] * s2)
    more = {
        "n": int(full["n"]), "k2": k2, "k3": k3 if outer else None, "sigma2": s2, "tau2": t2, "tau3": t3 if outer else None, "icc2": (t2 + t3) / whole, "icc3": t3 / whole if outer else None,
        "deviance": full["dev"], "null_deviance": null["dev"], "aic": full["dev"] + 2 * p, "bic": full["dev"] + p * np.log(full["n"]), "lrt": null["dev"] - full["dev"], "df": len(names), "pseudo_r2": 1 - s2 / null_within, "pseudo_r2_total": 1 - whole / null_all,
    }
    out = rows(df.sparkSession, [{"term": c, "b": b[i], "se": se[i], **more} for i, c in enumerate(["(constant)", *labels])])
    out = out.withColumn("z", div(F.col("b"), F.col("se"))).withColumn("p", z_p(F.col("z")))
    return out.withColumn("lrt_p", chi2_p(F.col("lrt"), F.col("df")) if names else F.lit(None).cast("double"))
