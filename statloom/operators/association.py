"""Correlation, reliability, agreement, rank tests and ROC curves."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.special import chi2_p, div, norm_inv, t_inv, t_p, z_p
from statloom.plans.shared import cut
from statloom.plans.stats import gram, number, numbers, parsed, ranks, rows, running, weighed


def _with_test(t: DataFrame) -> DataFrame:
    """Adds t, p and the Fisher-z interval to columns n and r."""
    n, r = F.col("n"), F.col("r")
    t = t.withColumn("t", F.when(n > 2, r * F.sqrt(div(n - 2, 1 - r * r))))
    half = norm_inv(0.975) / F.sqrt(F.when(n > 3, n - 3))
    z = F.atanh(F.when(F.abs(r) < 1, r))
    p = F.when((F.abs(r) >= 1) & (n > 2), 0.0).otherwise(t_p(F.col("t"), n - 2))
    return t.withColumns({"r2": r * r, "p": p, "ci_lo": F.coalesce(F.tanh(z - half), F.when(F.abs(r) >= 1, r)), "ci_hi": F.coalesce(F.tanh(z + half), F.when(F.abs(r) >= 1, r))})


_CORR = ("x", "y", "n", "r", "r2", "t", "p", "ci_lo", "ci_hi")


def pearson(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """(x, y, n, r, r2, t, p, ci_lo, ci_hi) over complete pairs; ``weight`` holds frequencies."""
    if weight:
        g = gram(weighed(df, {"a": x, "b": y}, None, weight), ["a", "b"], "w")
        return _with_test(rows(df.sparkSession, [{"x": x, "y": y, "n": g.n, "r": float(g.cor[0, 1])}]).withColumn("r", F.col("r").cast("double"))).select(*_CORR)
    s = numbers(df, {"a": x, "b": y}).agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
    return _with_test(s.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r")).alias("r"))).select(*_CORR)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """As ``pearson``, of average ranks; pairs are first counted, then their ranks joined."""
    d = numbers(df, {"a": x, "b": y})
    c = d.groupBy("a", "b").agg(F.count("*").alias("k"))
    c = c.join(ranks(d, "a").select("a", F.col("rank").alias("ra")), "a").join(ranks(d, "b").select("b", F.col("rank").alias("rb")), "b")
    # both ranks have mean (n + 1) / 2, so moments about it need one weighted pass
    total = d.agg(F.count("*").alias("n"))
    c = c.crossJoin(F.broadcast(total))  # one row
    u, v = F.col("ra") - (F.col("n") + 1) / F.lit(2.0), F.col("rb") - (F.col("n") + 1) / F.lit(2.0)
    s = c.agg(F.max("n").alias("n"), F.sum(F.col("k") * u * v).alias("uv"), F.sum(F.col("k") * u * u).alias("uu"), F.sum(F.col("k") * v * v).alias("vv"))
    return _with_test(s.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", div(F.col("uv"), F.sqrt(F.col("uu")) * F.sqrt(F.col("vv"))).alias("r"))).select(*_CORR)


def partial(df: DataFrame, x: str, y: str, control: str) -> DataFrame:
    """(n, rp, t, df, p, rxy, rxz, ryz, ci_lo, ci_hi): correlation of x and y without ``control``."""
    d = numbers(df, {"a": x, "b": y, "c": control})
    s = d.agg(F.count("*").alias("n"), F.corr("a", "b").alias("rxy"), F.corr("a", "c").alias("rxz"), F.corr("b", "c").alias("ryz"))
    den = F.sqrt(1 - F.col("rxz") * F.col("rxz")) * F.sqrt(1 - F.col("ryz") * F.col("ryz"))
    s = s.withColumn("rp", div(F.col("rxy") - F.col("rxz") * F.col("ryz"), den)).withColumn("df", F.col("n") - 3)
    s = s.withColumn("t", F.col("rp") * F.sqrt(div(F.col("df"), 1 - F.col("rp") * F.col("rp"))))
    half = t_inv(0.05, F.col("df")) / F.sqrt(F.when(F.col("n") > 4, F.col("n") - 4))
    z = F.atanh("rp")
    return s.select("n", "rp", "t", "df", t_p(F.col("t"), F.col("df")).alias("p"), "rxy", "rxz", "ryz", F.tanh(z - half).alias("ci_lo"), F.tanh(z + half).alias("ci_hi"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, n, r, r2, t, p, ci_lo, ci_hi) of every pair, each over its own complete cases, in one pass."""
    d = df.select(*(number(df, c).alias(f"v{i}") for i, c in enumerate(columns)))
    pairs = list(combinations(range(len(columns)), 2))
    both = lambda i, j: F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()
    aggs = [a for i, j in pairs for a in (F.count(F.when(both(i, j), 1)).alias(f"n_{i}_{j}"), F.corr(F.when(both(i, j), F.col(f"v{i}")), F.when(both(i, j), F.col(f"v{j}"))).alias(f"r_{i}_{j}"))]
    s = d.agg(*aggs)
    each = [F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.col(f"n_{i}_{j}").alias("n"), F.col(f"r_{i}_{j}").alias("r")) for i, j in pairs]
    return _with_test(s.select(F.explode(F.array(*each)).alias("e")).select("e.*")).select(*_CORR)


def _canonical(df: DataFrame, left: list[str], right: list[str]):
    a, b = [f"a{i}" for i in range(len(left))], [f"b{i}" for i in range(len(right))]
    g = gram(numbers(df, dict(zip([*a, *b], [*left, *right], strict=True))), [*a, *b])
    p, r = len(a), g.cor
    wx, wy = (np.linalg.inv(np.linalg.cholesky(m)) for m in (r[:p, :p], r[p:, p:]))
    u, rc, v = np.linalg.svd(wx @ r[:p, p:] @ wy.T)
    k = len(rc)
    x, y = wx.T @ u[:, :k], wy.T @ v[:k].T
    turn = np.sign(x[np.abs(x).argmax(0), range(k)])
    return g.n, r, np.clip(rc, 0, 1), x * turn, y * turn


def canonical(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(root, rc, rc2, wilks, chi2, df, p): canonical correlations with Bartlett's tests.

    One pass of covariances; the roots are singular values of the whitened block.
    """
    n, _, rc, _, _ = _canonical(df, left, right)
    p, q, out = len(left), len(right), []
    for i, v in enumerate(rc):
        wilks = float(np.prod(1 - rc[i:] ** 2))
        chi = -(n - 1 - (p + q + 1) / 2) * np.log(max(wilks, 1e-300))
        out.append({"root": i + 1, "rc": v, "rc2": v * v, "wilks": wilks, "chi2": chi, "df": (p - i) * (q - i)})
    return rows(df.sparkSession, out).withColumn("p", chi2_p(F.col("chi2"), F.col("df")))


def canonical_weights(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(root, side, item, coefficient, loading, cross_loading): standardised weights of unit-variance
    variates, and correlations of the items with their own and the other side's variate.

    A root's largest weight on the left is positive.
    """
    _, r, rc, x, y = _canonical(df, left, right)
    p, out = len(left), []
    for side, names, weights, own in (("left", left, x, r[:p, :p]), ("right", right, y, r[p:, p:])):
        loadings = own @ weights
        out += [{"root": j + 1, "side": side, "item": c, "coefficient": weights[i, j], "loading": loadings[i, j], "cross_loading": loadings[i, j] * rc[j]} for j in range(len(rc)) for i, c in enumerate(names)]
    return rows(df.sparkSession, out)


def cronbach_alpha(df: DataFrame, items: list[str]) -> DataFrame:
    """(item, k, n, alpha, rit, alpha_if_deleted): the scale in each row, and each item's rest correlation; one pass."""
    names = [f"v{i}" for i in range(len(items))]
    g = gram(numbers(df, dict(zip(names, items, strict=True))), names)
    k, c = len(names), g.cov

    def alpha(at: list[int]) -> float | None:
        sub = c[np.ix_(at, at)]
        return len(at) / (len(at) - 1) * (1 - np.trace(sub) / sub.sum()) if len(at) > 1 and sub.sum() > 0 else None

    out = []
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        spread = np.sqrt(c[i, i] * c[np.ix_(rest, rest)].sum())
        out.append({"item": items[i], "k": k, "n": g.n, "alpha": alpha(list(range(k))), "rit": c[i, rest].sum() / spread if spread > 0 else None, "alpha_if_deleted": alpha(rest)})
    return rows(df.sparkSession, out)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, po, pe, kappa, se, z, p, ci_lo, ci_hi, w_kappa): agreement of two raters.

    From the counts of pairs and of each rater's categories: no table of all pairs of categories
    is made. ``w_kappa`` has linear weights where all categories are numbers; the chance
    distance comes from running sums over the categories in order.
    """
    c = _pairs(df, a, b)
    total = c.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0)).alias("same")).first()
    n = total["n"] or 0
    m = _margins(c)
    x = parsed(F.col("cat"))
    span = m.agg(F.max(x).alias("hi"), F.min(x).alias("lo"), F.max(x.isNull().cast("int")).alias("text"), F.sum(F.col("ka").cast("double") * F.col("kb")).alias("pe")).first()
    po, pe = (total["same"] / n, span["pe"] / n / n) if n else (None, None)
    weighted = None
    if n and span["text"] == 0 and span["hi"] > span["lo"]:
        width = span["hi"] - span["lo"]
        wo = c.agg(F.sum(F.abs(parsed(F.col("a")) - parsed(F.col("b"))) * F.col("k"))).first()[0] / n / width
        # E|x - y| over independent raters, by each value of the second
        by = m.groupBy(x.alias("v")).agg(F.sum("ka").alias("ka"), F.sum("kb").alias("kb")).withColumn("sa", F.col("ka") * F.col("v"))
        r = running(by, "v", ["ka", "sa"])
        s = r.agg(F.sum("sa").alias("mean"), F.sum(F.col("kb") * (F.col("v") * (2 * F.col("cum_ka") - n) - 2 * F.col("cum_sa"))).alias("d"), F.sum("kb").alias("nb")).first()
        we = (s["d"] / n + s["mean"]) / n / width
        weighted = 1 - wo / we if we else None
    t = rows(df.sparkSession, [{"n": n, "po": po, "pe": pe, "w_kappa": weighted}])
    t = t.withColumns({k: F.col(k).cast("double") for k in ("po", "pe", "w_kappa")})
    t = t.withColumn("kappa", div(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    t = t.withColumn("se", F.sqrt(div(F.col("po") * (1 - F.col("po")), F.col("n") * (1 - F.col("pe")) * (1 - F.col("pe"))))).withColumn("z", div(F.col("kappa"), F.col("se")))
    return t.select("n", "po", "pe", "kappa", "se", "z", z_p(F.col("z")).alias("p"), (F.col("kappa") - 1.96 * F.col("se")).alias("ci_lo"), (F.col("kappa") + 1.96 * F.col("se")).alias("ci_hi"), "w_kappa")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("k"))


def _margins(c: DataFrame) -> DataFrame:
    """(cat, ka, kb, same): each category's count with either rater and with both."""
    each = F.explode(F.array(F.struct(F.col("a").alias("cat"), F.col("k").alias("ka"), F.lit(0).cast("bigint").alias("kb")), F.struct(F.col("b").alias("cat"), F.lit(0).cast("bigint").alias("ka"), F.col("k").alias("kb"))))
    both = F.when((F.col("a") == F.col("b")) & (F.col("x.kb") > 0), F.col("k")).otherwise(0)
    return c.select("a", "b", "k", each.alias("x")).groupBy("x.cat").agg(F.sum("x.ka").alias("ka"), F.sum("x.kb").alias("kb"), F.sum(both).alias("same"))


def kappa_categories(df: DataFrame, a: str, b: str) -> DataFrame:
    """(category, n, tp, fp, fn, precision, recall): the second rater against the first, category by category; 0 where undefined."""
    m = _margins(_pairs(df, a, b))
    tp = F.col("same")
    share = lambda of: F.coalesce(div(tp, of), F.lit(0.0))
    return m.select(F.col("cat").alias("category"), F.col("ka").alias("n"), tp.alias("tp"), (F.col("kb") - tp).alias("fp"), (F.col("ka") - tp).alias("fn"), share(F.col("kb")).alias("precision"), share(F.col("ka")).alias("recall"))


def _exact_ways(size: int | None, of: int) -> np.ndarray:
    """Number of subsets of 1..``of`` by their sum; of ``size`` members, or of any number."""
    top = of * (of + 1) // 2
    ways = np.zeros(((size or 0) + 1, top + 1))
    ways[0, 0] = 1
    for r in range(1, of + 1):
        if size is None:
            ways[0, r:] += ways[0, :-r].copy()
        else:
            ways[1:, r:] += ways[:-1, :-r].copy()
    return ways[-1]


def mann_whitney(df: DataFrame, value: str, group: str, levels: tuple[str, str] | None = None) -> DataFrame:
    """(group_a, group_b, n_a, n_b, u, u1, u2, z, p, r_eff, method) of two groups (named, or the first two by value).

    Exact for 20 cases or fewer without ties; otherwise the tie-corrected normal without
    continuity correction. Ranks come from counts of distinct values.
    """
    d = numbers(df, {"v": value}, {"g": group})
    two = [str(x) for x in levels] if levels else [r["g"] for r in d.select("g").distinct().orderBy("g").limit(2).collect()]
    if len(two) < 2:
        raise ValueError("two groups are needed")
    c = d.where(F.col("g").isin(*two)).groupBy("v").agg(F.count(F.when(F.col("g") == two[0], 1)).alias("ka"), F.count("*").alias("n"))
    r = running(c, "v", ["n"])
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1).cast("double") / 2
    n3 = F.col("n").cast("double")
    s = r.agg(F.sum("ka").alias("n_a"), F.sum(F.col("n") - F.col("ka")).alias("n_b"), F.sum(F.col("ka") * rank).alias("ra"), F.sum(n3 * n3 * n3 - n3).alias("ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    s = s.withColumn("u1", F.col("ra") - na * (na + 1) / 2).withColumn("u2", na * nb - F.col("u1")).withColumn("u", F.least("u1", "u2"))
    total = na + nb
    var = na * nb / 12 * (total + 1 - div(F.col("ties"), total * (total - 1)))
    s = s.withColumn("z", div(F.col("u") - na * nb / 2, F.sqrt(var)))
    first = s.first()
    exact = first["n_a"] and first["n_b"] and first["n_a"] + first["n_b"] <= 20 and first["ties"] == 0
    if exact:
        ways = _exact_ways(int(first["n_a"]), int(first["n_a"] + first["n_b"]))
        low = int(first["n_a"] * (first["n_a"] + 1) / 2)
        p = F.lit(min(1.0, float(2 * ways[: low + int(round(first["u"])) + 1].sum() / ways.sum())))
    else:
        p = z_p(F.col("z"))
    return s.select(
        F.lit(two[0]).alias("group_a"), F.lit(two[1]).alias("group_b"), "n_a", "n_b", "u", "u1", "u2", "z", p.alias("p"), (F.abs(F.col("z")) / F.sqrt(total)).alias("r_eff"), F.lit("exact" if exact else "normal").alias("method"),
    )


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """(k, n, h, df, p, eta2) without tie correction."""
    d = numbers(df, {"v": value}, {"g": group})
    r = ranks(d, "v").select("v", "rank")
    c = d.groupBy("g", "v").agg(F.count("*").alias("c")).join(r, "v")
    g = c.groupBy("g").agg(F.sum(F.col("c") * F.col("rank")).alias("rs"), F.sum("c").alias("m"))
    s = g.agg(F.count("*").alias("k"), F.sum("m").alias("n"), F.sum(F.col("rs") * F.col("rs") / F.col("m")).alias("x"))
    n = F.col("n").cast("double")
    s = s.withColumns({"h": 12 / (n * (n + 1)) * F.col("x") - 3 * (n + 1), "df": F.col("k") - 1})
    return s.select("k", "n", "h", "df", chi2_p(F.col("h"), F.col("df")).alias("p"), F.greatest(F.lit(0.0), div(F.col("h") - F.col("k") + 1, n - F.col("k"))).alias("eta2"))


def wilcoxon(df: DataFrame, value: str, mu: float = 0.0) -> DataFrame:
    """(n, w, w_plus, w_minus, z, p, method): signed ranks of value - mu; zeros are dropped, five or more are needed.

    Exact for 25 or fewer without ties; otherwise the normal without corrections.
    """
    d = numbers(df, {"x": value}).select((F.col("x") - mu).alias("x")).where("x <> 0")
    c = d.groupBy(F.abs("x").alias("v")).agg(F.count("*").alias("n"), F.count(F.when(F.col("x") > 0, 1)).alias("pos"))
    r = running(c, "v", ["n"])
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1).cast("double") / 2
    s = r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("pos") * rank).alias("w_plus"), F.sum((F.col("n") - F.col("pos")) * rank).alias("w_minus"), F.max("n").alias("most"))
    n = F.col("n").cast("double")
    s = s.withColumn("w", F.least("w_plus", "w_minus")).withColumn("z", div(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))
    first = s.first()
    if first["n"] < 5:
        none = F.lit(None).cast("double")
        return s.select("n", "w", "w_plus", "w_minus", none.alias("z"), none.alias("p"), F.lit("too few").alias("method"))
    exact = first["n"] <= 25 and first["most"] == 1
    if exact:
        ways = _exact_ways(None, int(first["n"]))
        p = F.lit(min(1.0, float(2 * ways[: int(round(first["w"])) + 1].sum() / ways.sum())))
    else:
        p = z_p(F.col("z"))
    return s.select("n", "w", "w_plus", "w_minus", "z", p.alias("p"), F.lit("exact" if exact else "normal").alias("method"))


def roc_curve(df: DataFrame, score: str, truth: str, positive: str) -> DataFrame:
    """(threshold, tp, fp, tn, fn, tpr, fpr, ppv, npv, f1, youden) at every distinct score, highest first."""
    d = df.select(number(df, score).alias("v"), (F.col(f"`{truth}`").cast("string") == positive).cast("int").alias("y")).dropna()
    c = d.groupBy("v").agg(F.sum("y").alias("p"), (F.count("*") - F.sum("y")).alias("q"))
    total = c.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    r = running(c, "v", ["p", "q"], descending=True).crossJoin(F.broadcast(total))  # one row
    tp, fp = F.col("cum_p"), F.col("cum_q")
    r = r.select(F.col("v").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.col("all_q") - fp).alias("tn"), (F.col("all_p") - tp).alias("fn"))
    r = r.withColumns({"tpr": div(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": div(F.col("fp"), F.col("fp") + F.col("tn")), "ppv": div(F.col("tp"), F.col("tp") + F.col("fp")), "npv": div(F.col("tn"), F.col("tn") + F.col("fn"))})
    return r.withColumns({"f1": div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "youden": F.col("tpr") - F.col("fpr")})


def roc(df: DataFrame, score: str, truth: str, positive: str) -> DataFrame:
    """(n_pos, n_neg, auc, se, ci_lo, ci_hi, opt_threshold, youden): trapezoids, Hanley-McNeil error, Youden's optimum.

    The area is the share of pairs in order, ties half, from running counts: no pair is made.
    """
    r = roc_curve(df, score, truth, positive)
    # at each score: its positives against all negatives below, half against its own
    d = df.select(number(df, score).alias("v"), (F.col(f"`{truth}`").cast("string") == positive).cast("int").alias("y")).dropna()
    own = d.groupBy("v").agg(F.sum("y").alias("p"), (F.count("*") - F.sum("y")).alias("q"))
    j = r.join(own, r["threshold"] == own["v"])
    s = j.agg(
        F.max(F.col("tp") + F.col("fn")).cast("double").alias("all_p"), F.max(F.col("fp") + F.col("tn")).cast("double").alias("all_q"), F.sum(F.col("p") * (F.col("tn") + F.col("q") / 2)).alias("wins"),
        F.max(F.struct("youden", F.col("threshold"))).alias("best"),
    ).withColumn("auc", div(F.col("wins"), F.col("all_p") * F.col("all_q")))
    a, p, n = F.col("auc"), F.col("all_p"), F.col("all_q")
    q1, q2 = div(a, 2 - a), div(2 * a * a, 1 + a)
    s = s.withColumn("se", F.sqrt(div(a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a), p * n)))
    return s.select(p.cast("bigint").alias("n_pos"), n.cast("bigint").alias("n_neg"), "auc", "se", F.greatest(F.lit(0.0), a - 1.96 * F.col("se")).alias("ci_lo"), F.least(F.lit(1.0), a + 1.96 * F.col("se")).alias("ci_hi"), F.col("best.threshold").alias("opt_threshold"), F.col("best.youden").alias("youden"))


def compare_auc(a: DataFrame, b: DataFrame) -> DataFrame:
    """(diff, z, p) of two summaries of ``roc``: areas taken as independent. Scores of the same cases: ``compare_auc_paired``."""
    j = a.select(F.col("auc").alias("x"), F.col("se").alias("sx")).crossJoin(b.select(F.col("auc").alias("y"), F.col("se").alias("sy")))  # two single rows
    j = j.withColumn("z", div(F.col("x") - F.col("y"), F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))))
    return j.select((F.col("x") - F.col("y")).alias("diff"), "z", z_p(F.col("z")).alias("p"))


def compare_auc_paired(df: DataFrame, a: str, b: str, truth: str, positive: str) -> DataFrame:
    """(n_pos, n_neg, auc_a, auc_b, se_a, se_b, cov, diff, se, z, p) of two scores of the same cases (DeLong).

    A positive's placement is the share of negatives below it, a negative's the share of
    positives above it, ties half. Placements follow from running counts of each score's
    distinct values; cases are counted by their pair of scores before they are joined to them.
    Cases without a score or truth are left out; with fewer than two cases of a kind errors
    and p are null, as they are where the scores put all cases in the same order.
    """
    d = df.select(number(df, a).alias("a"), number(df, b).alias("b"), (F.col(f"`{truth}`").cast("string") == positive).cast("bigint").alias("y")).dropna()
    c = cut(d.groupBy("a", "b").agg(F.sum("y").alias("p"), (F.count("*") - F.sum("y")).alias("q")), "pairs")
    total = c.agg(F.sum("p").cast("double").alias("all_p"), F.sum("q").cast("double").alias("all_q"))

    def placed(v: str) -> DataFrame:
        own = c.groupBy(v).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        r = running(own, v, ["p", "q"]).crossJoin(F.broadcast(total))  # one row
        return r.select(v, div(F.col("cum_q") - F.col("q") / 2, F.col("all_q")).alias(f"below_{v}"), div(F.col("all_p") - F.col("cum_p") + F.col("p") / 2, F.col("all_p")).alias(f"above_{v}"))

    j = c.join(placed("a"), "a").join(placed("b"), "b")
    sums = [F.sum("p").cast("double").alias("all_p"), F.sum("q").cast("double").alias("all_q")]
    for side, n in (("below", "p"), ("above", "q")):
        x, y = F.col(f"{side}_a"), F.col(f"{side}_b")
        for name, value in {"a": x, "b": y, "aa": x * x, "bb": y * y, "ab": x * y}.items():
            sums.append(F.sum(F.col(n) * value).alias(f"{side}_{name}_sum"))
    s = j.agg(*sums)
    part = lambda side, n, u, v: div(div(F.col(f"{side}_{u}{v}_sum") - F.col(f"{side}_{u}_sum") * F.col(f"{side}_{v}_sum") / F.col(n), F.col(n) - 1), F.col(n))
    both = lambda u, v: part("below", "all_p", u, v) + part("above", "all_q", u, v)
    s = s.withColumns({"auc_a": div(F.col("below_a_sum"), F.col("all_p")), "auc_b": div(F.col("below_b_sum"), F.col("all_p")), "va": both("a", "a"), "vb": both("b", "b"), "cov": both("a", "b")})
    left = F.col("va") + F.col("vb") - 2 * F.col("cov")
    s = s.withColumns({"diff": F.col("auc_a") - F.col("auc_b"), "se": F.when(left > 1e-14 * (F.col("va") + F.col("vb")), F.sqrt(left))}).withColumn("z", div(F.col("diff"), F.col("se")))
    root = lambda v: F.sqrt(F.greatest(F.lit(0.0), F.col(v)))
    return s.select(F.col("all_p").cast("bigint").alias("n_pos"), F.col("all_q").cast("bigint").alias("n_neg"), "auc_a", "auc_b", root("va").alias("se_a"), root("vb").alias("se_b"), "cov", "diff", "se", "z", z_p(F.col("z")).alias("p"))
