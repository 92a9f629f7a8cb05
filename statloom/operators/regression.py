"""Linear, logistic, count regression; mediation and moderation.

Linear models need one pass of covariances, and the driver solves k x k equations. Models
fitted by iteration take one aggregation a step: gradient and information as sums over
distinct rows with their counts, never the rows themselves.
"""

from __future__ import annotations

import math
from functools import reduce
from math import lgamma as lgamma_of

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.special import chi2_p, digamma, div, f_p, lgamma, t_p, trigamma, z_p
from statloom.plans.shared import cut
from statloom.plans.stats import Gram, counted, gram, number, numbers, ranges, rows, weighed


def _fields(xs: list[str], y: str) -> dict[str, str]:
    return {**{f"x{i}": c for i, c in enumerate(xs)}, "y": y}


def solve(g: Gram, xs: list[str], y: str) -> dict:
    """Least squares from covariances: coefficients (constant first), their covariance without scale, sums of squares."""
    s = g.pick([*xs, y])
    k, n = len(xs), s.n
    sxx, sxy, syy = s.cov[:k, :k] * (n - 1), s.cov[:k, k] * (n - 1), s.cov[k, k] * (n - 1)
    inv = np.linalg.inv(sxx) if k else np.zeros((0, 0))
    b = inv @ sxy
    m = s.mean[:k]
    full = np.zeros((k + 1, k + 1))
    full[1:, 1:] = inv
    full[0, 1:] = full[1:, 0] = -inv @ m
    full[0, 0] = 1 / n + m @ inv @ m
    ssr = float(b @ sxy)
    return {"b": np.append(s.mean[k] - m @ b, b), "inv": full, "n": n, "k": k, "sst": float(syy), "ssr": ssr, "sse": max(0.0, float(syy) - ssr), "sd": np.sqrt(np.diag(s.cov)), "cor": s.cor}


def _coefficients(spark, names: list[str], fit: dict, extra: dict | None = None) -> DataFrame:
    dof = fit["n"] - fit["k"] - 1
    mse = fit["sse"] / dof if dof > 0 else np.nan
    se = np.sqrt(mse * np.diag(fit["inv"]))
    out = [{"term": t, "b": fit["b"][i], "se": se[i], "df": dof} | {k: v[i] for k, v in (extra or {}).items()} for i, t in enumerate(["(constant)", *names])]
    t = rows(spark, out).withColumn("t", div(F.col("b"), F.col("se")))
    return t.withColumn("p", t_p(F.col("t"), F.col("df")))


def _fit_row(fit: dict) -> dict:
    n, k = fit["n"], fit["k"]
    dof = n - k - 1
    r2 = fit["ssr"] / fit["sst"] if fit["sst"] > 0 else None
    return {
        "n": n, "k": k, "r2": r2, "r2_adj": 1 - (1 - r2) * (n - 1) / dof if r2 is not None and dof > 0 else None,
        "f": fit["ssr"] / k / (fit["sse"] / dof) if dof > 0 and fit["sse"] > 0 else None, "df1": k, "df2": dof, "rmse": np.sqrt(fit["sse"] / dof) if dof > 0 else None, "ssr": fit["ssr"], "sse": fit["sse"], "sst": fit["sst"],
    }


def linear(df: DataFrame, y: str, xs: list[str], weight: str | None = None) -> DataFrame:
    """(term, b, se, df, t, p, beta_std, vif) over complete cases, in one pass; ``weight`` holds frequencies."""
    names = [f"x{i}" for i in range(len(xs))]
    g = gram(weighed(df, _fields(xs, y), None, weight), [*names, "y"], "w" if weight else None)
    fit = solve(g, names, "y")
    vif = np.diag(np.linalg.inv(fit["cor"][:-1, :-1]))
    return _coefficients(df.sparkSession, xs, fit, {"beta_std": [None, *(fit["b"][1:] * fit["sd"][:-1] / fit["sd"][-1])], "vif": [None, *vif]})


def linear_fit(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(n, k, r2, r2_adj, f, df1, df2, rmse, ssr, sse, sst, p_f) of the model of ``linear``."""
    names = [f"x{i}" for i in range(len(xs))]
    fit = solve(gram(numbers(df, _fields(xs, y)), [*names, "y"]), names, "y")
    return rows(df.sparkSession, [_fit_row(fit)]).withColumn("p_f", f_p(F.col("f"), F.col("df1"), F.col("df2")))


def predict(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``df`` with fitted, residual and leverage; null where a case misses a variable."""
    names = [f"x{i}" for i in range(len(xs))]
    fit = solve(gram(numbers(df, _fields(xs, y)), [*names, "y"]), names, "y")
    cols = [number(df, c) for c in xs]
    yhat, lev = _row_terms(fit, cols)
    return df.withColumns({"fitted": yhat, "residual": number(df, y) - yhat, "leverage": lev})


def _row_terms(fit: dict, cols: list[Column]) -> tuple[Column, Column]:
    """Fitted value and leverage of a row as expressions with the model's numbers in them."""
    one = [F.lit(1.0), *cols]
    yhat = reduce(lambda a, b: a + b, (F.lit(float(b)) * c for b, c in zip(fit["b"], one, strict=True)))
    inv = fit["inv"]
    quad = [F.lit(float(inv[i, j] * (1 if i == j else 2))) * one[i] * one[j] for i in range(len(one)) for j in range(i, len(one))]
    return yhat, reduce(lambda a, b: a + b, quad)


#: Cases that a bootstrap task weighs at a time.
BLOCK = 512


def linear_diagnostics(df: DataFrame, y: str, xs: list[str], order: str) -> DataFrame:
    """(dw, bp_stat, bp_p, cooks_max, high_cooks, high_lev, out2, out3, res_skew, res_kurt): a second pass of row expressions.

    Durbin-Watson needs neighbours in ``order``: residuals are joined to their predecessor
    within ranges of the order column, and the ranges' edges are joined by themselves.
    """
    names = [f"x{i}" for i in range(len(xs))]
    d = numbers(df, {**_fields(xs, y), "o": order})
    fit = solve(gram(d, [*names, "y"]), names, "y")
    n, p = fit["n"], fit["k"] + 1
    mse = fit["sse"] / (n - p)
    yhat, lev = _row_terms(fit, [F.col(c) for c in names])
    r = d.withColumns({"e": F.col("y") - yhat, "h": F.least(lev, F.lit(0.999))})
    stud = div(F.col("e"), F.sqrt(mse * (1 - F.col("h"))))
    cook = F.col("e") * F.col("e") * F.col("h") / (p * mse * (1 - F.col("h")) * (1 - F.col("h")))
    r = r.withColumns({"s": F.abs(stud), "cook": cook, "e2": F.col("e") * F.col("e")})
    z = F.col("e")
    a = r.agg(
        F.max("cook").alias("cooks_max"), F.sum((F.col("cook") > 4 / n).cast("bigint")).alias("high_cooks"), F.sum((F.col("h") > 2 * p / n).cast("bigint")).alias("high_lev"),
        F.sum((F.col("s") > 2).cast("bigint")).alias("out2"), F.sum((F.col("s") > 3).cast("bigint")).alias("out3"), F.skewness(z).alias("res_skew"), F.kurtosis(z).alias("res_kurt"),
    )
    aux = solve(gram(r.select(*names, F.col("e2").alias("y")), [*names, "y"]), names, "y")
    bp = n * aux["ssr"] / aux["sst"] if aux["sst"] > 0 else 0.0
    return a.withColumns({"bp_stat": F.lit(float(bp)), "bp_p": chi2_p(float(bp), float(len(xs))), "dw": F.lit(float(_durbin_watson(r.select("o", "e"))))})


def _durbin_watson(r: DataFrame) -> float:
    """Sum of squared steps between neighbours over the sum of squares.

    Cases are ordered by (``o``, residual) and cut into ranges of that pair, so that cases which
    share a value of ``o`` don't meet in one task. A range is a window of its own; each range's
    last value is carried to the next by a table of one row a range.
    """
    d = cut(r.repartitionByRange("o", "e").withColumn("g", F.spark_partition_id()), "residuals")
    w = Window.partitionBy("g").orderBy("o", "e")
    inside = d.withColumn("prev", F.lag("e").over(w)).agg(F.sum((F.col("e") - F.col("prev")) * (F.col("e") - F.col("prev"))).alias("steps"), F.sum(F.col("e") * F.col("e")).alias("ss")).first()
    ends = d.groupBy("g").agg(F.min(F.struct("o", "e")).alias("first"), F.max(F.struct("o", "e")).alias("last")).orderBy("g").collect()  # one row a range
    edge = sum((b["first"]["e"] - a["last"]["e"]) ** 2 for a, b in zip(ends, ends[1:], strict=False))
    return ((inside["steps"] or 0.0) + edge) / inside["ss"] if inside["ss"] else float("nan")


def robust_errors(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, b, se_hc3, z_hc3, p_hc3): sandwich errors with squared residuals over (1 - leverage) squared."""
    names = [f"x{i}" for i in range(len(xs))]
    d = numbers(df, _fields(xs, y))
    fit = solve(gram(d, [*names, "y"]), names, "y")
    yhat, lev = _row_terms(fit, [F.col(c) for c in names])
    e = (F.col("y") - yhat) / (1 - F.least(lev, F.lit(0.999)))
    one = [F.lit(1.0), *(F.col(c) for c in names)]
    k = len(one)
    s = d.withColumn("w", e * e).agg(*(F.sum(F.col("w") * one[i] * one[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k))).first()
    meat = np.array([[s[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    se = np.sqrt(np.diag(fit["inv"] @ meat @ fit["inv"]))
    t = rows(df.sparkSession, [{"term": n, "b": fit["b"][i], "se_hc3": se[i]} for i, n in enumerate(["(constant)", *xs])]).withColumn("z_hc3", div(F.col("b"), F.col("se_hc3")))
    return t.withColumn("p_hc3", z_p(F.col("z_hc3")))


def hierarchical(df: DataFrame, y: str, blocks: list[list[str]]) -> DataFrame:
    """(block, n, k, r2, delta_r2, f_change, df1, df2, p): predictors block by block, all from one pass of covariances."""
    flat = [c for b in blocks for c in b]
    names = {c: f"x{i}" for i, c in enumerate(flat)}
    g = gram(numbers(df, _fields(flat, y)), [*names.values(), "y"])
    out, before, used = [], 0.0, []
    for i, b in enumerate(blocks, 1):
        used += [names[c] for c in b]
        fit = solve(g, used, "y")
        r2 = fit["ssr"] / fit["sst"]
        dof = fit["n"] - fit["k"] - 1
        out.append({"block": i, "n": fit["n"], "k": fit["k"], "r2": r2, "delta_r2": r2 - before, "f_change": (r2 - before) / len(b) / ((1 - r2) / dof), "df1": len(b), "df2": dof})
        before = r2
    return rows(df.sparkSession, out).withColumn("p", f_p(F.col("f_change"), F.col("df1"), F.col("df2")))


def _newton(d: DataFrame, names: list[str], steps: int, start: np.ndarray, terms) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Newton's method with halving. ``terms(eta)`` gives a row's log likelihood, its
    derivative and its information by the linear predictor; each step is one aggregation
    over ``d`` with counts ``c``."""
    one = [F.lit(1.0), *(F.col(x) for x in names)]
    k = len(one)

    def pass_(b: np.ndarray):
        eta = reduce(lambda a, x: a + x, (F.lit(float(v)) * x for v, x in zip(b, one, strict=True)))
        ll, g, w = terms(F.col("eta"))
        e = d.withColumn("eta", eta).withColumns({"ll": ll * F.col("c"), "g": g * F.col("c"), "w": w * F.col("c")})
        s = e.agg(F.sum("ll").alias("ll"), *(F.sum(F.col("g") * one[i]).alias(f"g{i}") for i in range(k)), *(F.sum(F.col("w") * one[i] * one[j]).alias(f"h_{i}_{j}") for i in range(k) for j in range(i, k))).first()
        return s["ll"], np.array([s[f"g{i}"] for i in range(k)]), np.array([[s[f"h_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    b = start.astype(float)
    ll, g, h = pass_(b)
    done = 0
    for done in range(1, steps + 1):
        move = np.linalg.solve(h + 1e-8 * np.eye(k), g)
        scale = 1.0
        while True:
            new = pass_(b + scale * move)
            if new[0] is not None and np.isfinite(new[0]) and (new[0] >= ll - 1e-10 or scale < 1e-4):
                break
            scale /= 2
            if scale < 1e-6:
                break
        b, gain = b + scale * move, new[0] - ll
        ll, g, h = new
        if abs(gain) < 1e-10 * (1 + abs(ll)) and np.abs(move).max() < 1e-7:
            break
    return b, np.linalg.inv(h + 1e-8 * np.eye(k)), ll, done


def _scaled(d: DataFrame, names: list[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    s = d.agg(*(F.avg(x).alias(f"m_{x}") for x in names), *(F.stddev_samp(x).alias(f"s_{x}") for x in names)).first()
    m = np.array([s[f"m_{x}"] or 0.0 for x in names])
    sd = np.array([s[f"s_{x}"] or 1.0 for x in names])
    return d.withColumns({x: (F.col(x) - float(m[i])) / float(sd[i]) for i, x in enumerate(names)}), m, sd


def _unscaled(b: np.ndarray, cov: np.ndarray, m: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.eye(len(b))
    t[1:, 1:] = np.diag(1 / sd)
    t[0, 1:] = -m / sd
    return t @ b, np.sqrt(np.diag(t @ cov @ t.T))


def _ratios(spark, names: list[str], b: np.ndarray, se: np.ndarray, ratio: str, more: dict) -> DataFrame:
    t = rows(spark, [{"term": x, "b": b[i], "se": se[i], **more} for i, x in enumerate(["(constant)", *names])])
    t = t.withColumn("z", div(F.col("b"), F.col("se"))).withColumn("p", z_p(F.col("z")))
    return t.withColumns({ratio: F.exp("b"), "ci_lo": F.exp(F.col("b") - 1.96 * F.col("se")), "ci_hi": F.exp(F.col("b") + 1.96 * F.col("se"))})


def logistic(df: DataFrame, y: str, xs: list[str], event: str | None = None) -> DataFrame:
    """(term, b, se, z, p, odds_ratio, ci_lo, ci_hi, n, ll, ll_null, chi2, cox_snell, nagelkerke, p_model).

    ``event`` is by default the second of the sorted levels.
    """
    names = [f"x{i}" for i in range(len(xs))]
    d = numbers(df, dict(zip(names, xs, strict=True)), {"k": y})
    event = event or d.select("k").distinct().orderBy("k").limit(2).agg(F.max("k")).first()[0]
    d = d.withColumn("y", (F.col("k") == F.lit(event)).cast("double")).drop("k")
    return _logistic(d, names, xs)


def _logistic(d: DataFrame, names: list[str], xs: list[str]) -> DataFrame:
    d, m, sd = _scaled(d, names)
    d = counted(d, [*names, "y"])
    total = d.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("y")).alias("e")).first()
    n, e = total["n"] or 0.0, total["e"] or 0.0
    if not 0 < e < n:
        raise ValueError("both outcomes are needed")
    p = lambda eta: F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), 1 / (1 + F.exp(-eta))))
    y = F.col("y")
    terms = lambda eta: (y * F.log(p(eta)) + (1 - y) * F.log(1 - p(eta)), y - p(eta), p(eta) * (1 - p(eta)))
    b, cov, ll, _ = _newton(d, names, 50, np.append(np.log(e / (n - e)), np.zeros(len(names))), terms)
    b, se = _unscaled(b, cov, m, sd)
    null = e * np.log(e / n) + (n - e) * np.log(1 - e / n)
    snell = 1 - np.exp(2 * (null - ll) / n)
    more = {"n": int(n), "ll": ll, "ll_null": null, "chi2": 2 * (ll - null), "df": len(xs), "cox_snell": snell, "nagelkerke": snell / (1 - np.exp(2 * null / n))}
    return _ratios(d.sparkSession, xs, b, se, "odds_ratio", more).withColumn("p_model", chi2_p(F.col("chi2"), F.col("df")))


def _levels(df: DataFrame, y: str) -> list[str]:
    return [r[0] for r in df.where(F.col(f"`{y}`").isNotNull()).select(F.col(f"`{y}`").cast("string").alias("k")).distinct().orderBy("k").collect()]


def multinomial(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``logistic`` of each level but the first against all other cases, with column ``level``."""
    parts = [logistic(df, y, xs, lv).withColumn("level", F.lit(lv)) for lv in _levels(df, y)[1:]]
    return reduce(DataFrame.unionByName, parts)


def multinomial_classification(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(actual, predicted, n, accuracy, ll): cases go to the level with the largest predictor, the first
    level having 0; ``ll`` is the log likelihood of the predictors' shares."""
    b = {(r["level"], r["term"]): r["b"] for r in multinomial(df, y, xs).select("level", "term", "b").collect()}
    names, levels = [f"x{i}" for i in range(len(xs))], _levels(df, y)
    d = numbers(df, dict(zip(names, xs, strict=True)), {"k": y})
    etas = [F.lit(0.0), *(reduce(lambda a, c: a + c, (F.lit(b[lv, x]) * F.col(n) for n, x in zip(names, xs, strict=True)), F.lit(b[lv, "(constant)"])) for lv in levels[1:])]
    top = F.array_max(F.array(*(F.struct(e.alias("e"), F.lit(-i).alias("i")) for i, e in enumerate(etas))))
    d = d.withColumn("i", -top["i"]).withColumn("lp", reduce(lambda a, ie: a.when(F.col("k") == levels[ie[0]], ie[1]), enumerate(etas[1:], 1), F.when(F.col("k") == levels[0], etas[0])) - F.log(reduce(lambda a, c: a + c, map(F.exp, etas))))
    c = d.groupBy(F.col("k").alias("actual"), F.element_at(F.array(*map(F.lit, levels)), F.col("i") + 1).alias("predicted")).agg(F.count("*").alias("n"), F.sum("lp").alias("ll"))
    total = c.agg((100 * F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("ll").alias("ll"))
    return c.drop("ll").crossJoin(F.broadcast(total))  # one row


def classification(df: DataFrame, y: str, xs: list[str], event: str | None = None) -> DataFrame:
    """(tp, fp, tn, fn, accuracy) of the logistic model at probability one half."""
    fit = logistic(df, y, xs, event)
    b = {r["term"]: r["b"] for r in fit.select("term", "b").collect()}
    names = [f"x{i}" for i in range(len(xs))]
    d = numbers(df, dict(zip(names, xs, strict=True)), {"k": y})
    event = event or d.select("k").distinct().orderBy("k").limit(2).agg(F.max("k")).first()[0]
    eta = reduce(lambda a, c: a + c, (F.lit(b[x]) * F.col(n) for n, x in zip(names, xs, strict=True)), F.lit(b["(constant)"]))
    hit, said = F.col("k") == F.lit(event), eta >= 0
    n = lambda c: F.sum(c.cast("bigint"))
    return d.agg(n(hit & said).alias("tp"), n(~hit & said).alias("fp"), n(~hit & ~said).alias("tn"), n(hit & ~said).alias("fn"), (100 * F.avg((hit == said).cast("double"))).alias("accuracy"))


def poisson(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, b, se, z, p, irr, ci_lo, ci_hi, n, deviance, null_deviance, mcfadden, dispersion, chi2, df, p_model); y >= 0."""
    names = [f"x{i}" for i in range(len(xs))]
    d, m, sd = _scaled(numbers(df, _fields(xs, y)).where("y >= 0"), names)
    d = counted(d, [*names, "y"])
    s = d.agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("m")).first()
    yy = F.col("y")
    terms = lambda eta: (yy * eta - F.exp(eta), yy - F.exp(eta), F.exp(eta))
    b, cov, ll, _ = _newton(d, names, 50, np.append(np.log(max(s["m"], 1e-8)), np.zeros(len(names))), terms)
    eta = reduce(lambda a, c: a + c, (F.lit(float(v)) * F.col(x) for v, x in zip(b[1:], names, strict=True)), F.lit(float(b[0])))
    q = d.withColumn("mu", F.exp(eta))
    dev = lambda mu: 2 * F.col("c") * (F.when(yy > 0, yy * F.log(yy / mu)).otherwise(0.0) - (yy - mu))
    t = q.agg(F.sum(dev(F.col("mu"))).alias("dev"), F.sum(dev(F.lit(float(s["m"])))).alias("null"), F.sum(F.col("c") * (yy - F.col("mu")) * (yy - F.col("mu")) / F.col("mu")).alias("x2")).first()
    counts = d.groupBy("y").agg(F.sum("c").alias("c"))
    fact = sum(r["c"] * lgamma_of(r["y"] + 1) for r in counts.toLocalIterator())  # one row a distinct count
    ll0 = s["n"] * s["m"] * (np.log(s["m"]) - 1) - fact
    b, se = _unscaled(b, cov, m, sd)
    more = {"n": int(s["n"]), "deviance": t["dev"], "null_deviance": t["null"], "mcfadden": 1 - (ll - fact) / ll0, "dispersion": t["x2"] / max(1.0, s["n"] - len(xs) - 1), "chi2": t["null"] - t["dev"], "df": len(xs)}
    return _ratios(df.sparkSession, xs, b, se, "irr", more).withColumn("p_model", chi2_p(F.col("chi2"), F.col("df")))


def negative_binomial(df: DataFrame, y: str, xs: list[str], steps: int = 60) -> DataFrame:
    """(term, b, se, z, p, irr, ci_lo, ci_hi, n, theta, ll, ll_null, chi2, df, p_model, deviance, mcfadden, dispersion):
    NB2; the null model has the mean count and the same theta, which stays within 1e-3 and 1e4.

    Coefficients (scoring) and log theta (Newton) move in the same step, which is one aggregation:
    their information is zero off the blocks. Theta starts from the moments.
    """
    names = [f"x{i}" for i in range(len(xs))]
    d, m, sd = _scaled(numbers(df, _fields(xs, y)).where("y >= 0"), names)
    d = counted(d, [*names, "y"])
    cy = F.col("c") * F.col("y")
    s = d.agg(F.sum("c").alias("n"), (F.sum(cy) / F.sum("c")).alias("m"), (F.sum(cy * F.col("y")) / F.sum("c")).alias("m2")).first()
    yy, mu, w, one = F.col("y"), F.col("mu"), F.col("c"), [F.lit(1.0), *(F.col(x) for x in names)]
    k, low, high = len(one), np.log(1e-3), np.log(1e4)

    def means(b: np.ndarray) -> DataFrame:
        return d.withColumn("mu", F.exp(reduce(lambda a, x: a + x, (F.lit(float(v)) * x for v, x in zip(b, one, strict=True)))))

    def likelihood(mu: Column, th: float) -> Column:
        return lgamma(yy + th) - lgamma_of(th) - lgamma(yy + 1) + th * float(np.log(th)) + yy * F.log(mu) - (yy + th) * F.log(mu + th)

    def pass_(at: np.ndarray):
        th = float(np.exp(at[k]))
        away, rate, at_th = mu + th, (yy + th) / (mu + th), F.lit(th)
        g, h = w * (yy - mu) * th / away, w * mu * th / away
        first = digamma(yy + th) - digamma(at_th) + float(np.log(th)) + 1 - F.log(away) - rate
        second = trigamma(yy + th) - trigamma(at_th) + 1 / th - 2 / away + rate / away
        o = means(at[:k]).agg(
            F.sum(w * likelihood(mu, th)).alias("ll"), F.sum(w * first).alias("first"), F.sum(w * second).alias("second"),
            *(F.sum(g * one[i]).alias(f"g{i}") for i in range(k)), *(F.sum(h * one[i] * one[j]).alias(f"h_{i}_{j}") for i in range(k) for j in range(i, k)),
        ).first()
        info = np.array([[o[f"h_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        slope, bend = th * o["first"], -(th * th * o["second"] + th * o["first"])  # by log theta
        return o["ll"], np.array([o[f"g{i}"] for i in range(k)]), info, slope, bend

    spread = s["m2"] - s["m"] * s["m"] - s["m"]
    start = np.log(s["m"] * s["m"] / spread) if spread > 0 and s["m"] > 0 else high
    at = np.array([np.log(max(s["m"], 1e-8)), *[0.0] * (k - 1), np.clip(start, low, high)])
    ll, g, h, slope, bend = pass_(at)
    for _ in range(steps):
        turn = np.clip(slope / bend if bend > 0 else np.sign(slope), -2, 2)
        move = np.append(np.linalg.solve(h + 1e-8 * np.eye(k), g), np.clip(at[k] + turn, low, high) - at[k])
        scale = 1.0
        while True:
            new = pass_(at + scale * move)
            if np.isfinite(new[0]) and (new[0] >= ll - 1e-9 * (1 + abs(ll)) or scale < 1e-4):
                break
            scale /= 2
        at = at + scale * move
        ll, g, h, slope, bend = new
        if np.abs(scale * move).max() < 1e-7:
            break
    theta, b, cov = float(np.exp(at[k])), at[:k], np.linalg.inv(h + 1e-8 * np.eye(k))
    unit = 2 * (F.when(yy > 0, yy * F.log(yy / mu)).otherwise(0.0) - (yy + theta) * F.log((yy + theta) / (mu + theta)))
    x2 = (yy - mu) * (yy - mu) / (mu + mu * mu / theta)
    t = means(b).agg(F.sum(w * likelihood(F.lit(float(s["m"])), theta)).alias("null"), F.sum(w * unit).alias("dev"), F.sum(w * x2).alias("x2")).first()
    b, se = _unscaled(b, cov, m, sd)
    more = {"n": int(s["n"]), "theta": theta, "ll": ll, "ll_null": t["null"], "chi2": 2 * (ll - t["null"]), "df": len(xs), "deviance": t["dev"], "mcfadden": 1 - ll / t["null"], "dispersion": t["x2"] / max(1.0, s["n"] - len(xs) - 1)}
    return _ratios(df.sparkSession, xs, b, se, "irr", more).withColumn("p_model", chi2_p(F.col("chi2"), F.col("df")))


def mediation(df: DataFrame, x: str, mediators: list[str], y: str, boots: int = 0, seed: int = 7) -> DataFrame:
    """(mediator, n, c, a, b, c_prime, indirect, sobel_se, sobel_z, p, boot_lo, boot_hi): Baron and Kenny with Sobel's test.

    One pass of covariances. ``boots`` Poisson resamples of the cases add percentile
    intervals: in one further pass each task weighs its cases for all resamples and keeps
    their weighted sums, so that a row stays a row.
    """
    names = ["x", "y", *(f"m{i}" for i in range(len(mediators)))]
    d = numbers(df, dict(zip(names, [x, y, *mediators], strict=True)))
    g = gram(d, names)
    ms = names[2:]

    def paths(g: Gram, m: str) -> tuple[float, float, float, float, float, float]:
        one, two = solve(g, ["x"], m), solve(g, ["x", m], "y")
        se = lambda f, i: np.sqrt(f["sse"] / (f["n"] - f["k"] - 1) * f["inv"][i, i])
        return one["b"][1], se(one, 1), two["b"][2], se(two, 2), two["b"][1], solve(g, ["x"], "y")["b"][1]

    boot: dict[str, list[float]] = {m: [] for m in ms}
    if boots:
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        mu = dict(zip(names, g.mean, strict=True))
        away = [F.col(a) - float(mu[a]) for a in names]
        # equal cases are one row with their number; all are dealt out anew, however few files the table has, and
        # each task's order is fixed
        own = d.repartition(ranges(d, "x"), *names).groupBy(*names).agg(F.count("*").alias("k"))
        own = own.select(F.xxhash64(*names).alias("h"), F.array(*away).alias("v"), "k").sortWithinPartitions("h", "v")
        sums = _resampled(own, names, pairs, boots, seed)
        for r in sums:  # one small row a resample
            mean = np.array([r[f"m_{a}"] for a in names]) / r["n"]
            cov = np.zeros((len(names), len(names)))
            for a, b in pairs:
                i, j = names.index(a), names.index(b)
                cov[i, j] = cov[j, i] = (r[f"c_{a}_{b}"] - r["n"] * mean[i] * mean[j]) / max(1.0, r["n"] - 1)
            try:
                for m in ms:
                    q = paths(Gram(names, int(r["n"]), mean, cov), m)
                    boot[m].append(q[0] * q[2])
            except np.linalg.LinAlgError:
                continue
    out = []
    for m, label in zip(ms, mediators, strict=True):
        a, sa, b, sb, cp, c = paths(g, m)
        lo, hi = np.quantile(boot[m], [0.025, 0.975]) if boot[m] else (None, None)
        out.append({"mediator": label, "n": g.n, "c": c, "a": a, "b": b, "c_prime": cp, "indirect": a * b, "sobel_se": np.sqrt(a * a * sb * sb + b * b * sa * sa), "boot_lo": lo, "boot_hi": hi})
    t = rows(df.sparkSession, out).withColumn("sobel_z", div(F.col("indirect"), F.col("sobel_se")))
    return t.withColumn("p", z_p(F.col("sobel_z")))


#: Distribution function of a Poisson variable of mean 1, and its value in each of 65 536 equal parts of the
#: unit interval; -1 where a part holds a step.
_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_LOW, _HIGH = (np.searchsorted(_CDF, (np.arange(1 << 16) + x) / (1 << 16), s) for x, s in ((0, "right"), (1, "left")))
_WEIGHTS = np.where(_LOW == _HIGH, _LOW, -1).astype(float)


def _poisson(rng: np.random.Generator, shape: tuple[int, int]) -> np.ndarray:
    """Poisson weights of mean 1 by inversion: sixteen random bits decide nearly all, those in a part with a
    step take 53 more."""
    part = rng.integers(0, 1 << 16, shape, np.uint16)
    w = _WEIGHTS.take(part)
    open_ = np.nonzero(w < 0)
    w[open_] = np.searchsorted(_CDF, (part[open_] + rng.random(len(open_[0]))) / (1 << 16), "right")
    return w


def _resampled(d: DataFrame, names: list[str], pairs: list[tuple[str, str]], boots: int, seed: int) -> list[dict]:
    """Weighted sums (n, m_<a>, c_<a>_<b>) of each of ``boots`` Poisson resamples of ``d`` (h, v, k): a case
    that stands for k equal ones has a weight of mean k.

    A task draws the weights of its cases from a generator seeded by ``seed`` and the task's
    first case, a block of cases at a time, and returns ``boots`` rows of sums.
    """
    import pyarrow as pa

    fields = ["n", *(f"m_{a}" for a in names), *(f"c_{a}_{b}" for a, b in pairs)]
    at = [(names.index(a), names.index(b)) for a, b in pairs]

    def each(batches):
        total, rng = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rng is None:
                rng, total = np.random.default_rng([seed, batch.column("h")[0].as_py() & ((1 << 63) - 1)]), np.zeros((boots, len(fields)))
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, len(names))
            k = batch.column("k").to_numpy()
            for i in range(0, len(v), BLOCK):
                x, times = v[i : i + BLOCK], k[i : i + BLOCK]
                x = np.column_stack([np.ones(len(x)), x, *(x[:, a] * x[:, b] for a, b in at)])
                more = np.flatnonzero(times > 1)
                for b in range(0, boots, BLOCK):  # weights that fit a core's cache
                    w = _poisson(rng, (min(BLOCK, boots - b), len(x)))
                    w[:, more] = rng.poisson(times[more], (len(w), len(more)))
                    total[b : b + BLOCK] += w @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(boots)), *(pa.array(c) for c in total.T)], ["b", *fields])

    sums = d.mapInArrow(each, ", ".join(["b bigint", *(f"{f} double" for f in fields)]))
    return [r.asDict() for r in sums.groupBy("b").agg(*(F.sum(f).alias(f) for f in fields)).orderBy("b").collect()]  # a row a resample


def moderation(df: DataFrame, x: str, w: str, y: str, covariates: list[str] = (), center: bool = True) -> DataFrame:
    """(term, b, se, df, t, p, r2, delta_r2): y on x, w, their product and covariates; x and w centred by default."""
    fit, base, names, _ = _moderated(df, x, w, y, list(covariates), center)
    t = _coefficients(df.sparkSession, [x, w, f"{x}:{w}", *covariates], fit)
    r2 = fit["ssr"] / fit["sst"]
    return t.withColumns({"r2": F.lit(float(r2)), "delta_r2": F.lit(float(r2 - base["ssr"] / base["sst"]))})


def _moderated(df: DataFrame, x: str, w: str, y: str, covariates: list[str], center: bool):
    cs = [f"c{i}" for i in range(len(covariates))]
    d = numbers(df, {"x": x, "w": w, "y": y, **dict(zip(cs, covariates, strict=True))})
    if center:
        m = d.agg(F.avg("x"), F.avg("w")).first()
        d = d.withColumns({"x": F.col("x") - (m[0] or 0.0), "w": F.col("w") - (m[1] or 0.0)})
    d = d.withColumn("xw", F.col("x") * F.col("w"))
    names = ["x", "w", "xw", *cs]
    g = gram(d, [*names, "y"])
    return solve(g, names, "y"), solve(g, [n for n in names if n != "xw"], "y"), names, g


def simple_slopes(df: DataFrame, x: str, w: str, y: str, covariates: list[str] = (), steps: int = 200) -> DataFrame:
    """(w, at, slope, se, t, df, p): the slope of x at w's mean and one deviation around, and over ``steps`` values within three (Johnson-Neyman).

    The standard error includes the covariance of the two coefficients.
    """
    fit, _, names, g = _moderated(df, x, w, y, list(covariates), True)
    sd = float(np.sqrt(g.cov[1, 1]))
    dof = fit["n"] - fit["k"] - 1
    v = fit["inv"] * fit["sse"] / dof
    at = [("mean - sd", -sd), ("mean", 0.0), ("mean + sd", sd), *((f"jn {i}", -3 * sd + 6 * sd * i / steps) for i in range(steps + 1))]
    out = [{"at": k, "w": z, "slope": fit["b"][1] + fit["b"][3] * z, "se": np.sqrt(max(0.0, v[1, 1] + z * z * v[3, 3] + 2 * z * v[1, 3])), "df": dof} for k, z in at]
    t = rows(df.sparkSession, out).withColumn("t", div(F.col("slope"), F.col("se")))
    return t.withColumn("p", t_p(F.col("t"), F.col("df")))


def points(df: DataFrame, columns: list[str], key: list[str], size: int = 500, seed: int = 1) -> DataFrame:
    """(*columns) of at most ``size`` cases, for scatter plots: those with the smallest hash of ``seed`` and ``key``, in
    that order. Each task keeps its smallest, so the table isn't sorted, and the cases are the same
    however it is divided. Cases that miss a column are left out; ``key`` columns (whole numbers or
    text, null as empty) should tell cases apart, else ties fall by value."""
    fields = {f"c{i}": c for i, c in enumerate(columns)}
    own = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key))
    d = df.select(*(number(df, c).alias(k) for k, c in fields.items()), F.md5(own).alias("h")).dropna(subset=list(fields))
    return d.orderBy("h", *fields).limit(size).select(*(F.col(k).alias(c) for k, c in fields.items()))


def residual_points(df: DataFrame, value: str, predictors: list[str], key: list[str], size: int = 500, seed: int = 1) -> DataFrame:
    """(fitted, residual) of the linear model over all cases, for the cases that ``points`` takes."""
    b = {r["term"]: r["b"] for r in linear(df, value, predictors).collect()}
    d = points(df, [value, *predictors], key, size, seed).toDF("y", *(f"x{i}" for i in range(len(predictors))))
    fitted = reduce(lambda a, c: a + c, (F.col(f"x{i}") * float(b[p]) for i, p in enumerate(predictors)), F.lit(float(next(v for t, v in b.items() if t not in predictors))))
    return d.select(fitted.alias("fitted"), (F.col("y") - fitted).alias("residual"))
