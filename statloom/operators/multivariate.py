"""Factor, structural, discriminant and cluster analysis.

Everything but clustering needs only covariances from one pass; eigenproblems are k x k.
"""

from __future__ import annotations

from functools import reduce
from math import lgamma

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.special import chi2_p, div, z_p
from statloom.plans.stats import gram, gram_columns, number, numbers, rows


def _eigen(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(r)
    return values[::-1], vectors[:, ::-1] * np.where(vectors[:, ::-1].sum(0) < 0, -1, 1)


def varimax(loadings: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Raw varimax by planar rotations (Kaiser 1958); the largest loading of each factor is positive."""
    a, (p, m) = loadings.copy(), loadings.shape
    for _ in range(rounds):
        turned = 0.0
        for i in range(m):
            for j in range(i + 1, m):
                u, v = a[:, i] ** 2 - a[:, j] ** 2, 2 * a[:, i] * a[:, j]
                num = 2 * (u @ v - u.sum() * v.sum() / p)
                den = (u**2 - v**2).sum() - (u.sum() ** 2 - v.sum() ** 2) / p
                phi = np.arctan2(num, den) / 4
                c, s = np.cos(phi), np.sin(phi)
                a[:, [i, j]] = a[:, [i, j]] @ np.array([[c, -s], [s, c]])
                turned = max(turned, abs(phi))
        if turned < 1e-10:
            break
    return a * np.sign(a[np.abs(a).argmax(0), range(m)])


def _fields(columns: list[str]) -> dict[str, str]:
    return {f"v{i}": c for i, c in enumerate(columns)}


def efa(df: DataFrame, columns: list[str], factors: int, rotate: bool = True) -> DataFrame:
    """(item, factor, loading, communality, eigenvalue, pct): principal components of the correlations, varimax on demand."""
    f = _fields(columns)
    g = gram(numbers(df, f), list(f))
    values, vectors = _eigen(g.cor)
    load = vectors[:, :factors] * np.sqrt(np.clip(values[:factors], 0, None))
    if rotate and factors > 1:
        load = varimax(load)
    part = (load**2).sum(0)
    return rows(df.sparkSession, [{"item": c, "factor": j + 1, "loading": load[i, j], "communality": (load[i] ** 2).sum(), "eigenvalue": values[j], "pct": 100 * part[j] / len(columns)} for i, c in enumerate(columns) for j in range(factors)])


def factorability(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, k, kmo, chi2, df, p): Kaiser-Meyer-Olkin measure and Bartlett's sphericity."""
    f = _fields(columns)
    g = gram(numbers(df, f), list(f))
    r, k = g.cor, len(columns)
    inv = np.linalg.inv(r)
    part = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(k, dtype=bool)
    a, b = (r[off] ** 2).sum(), (part[off] ** 2).sum()
    chi = -(g.n - 1 - (2 * k + 5) / 6) * np.linalg.slogdet(r)[1]
    return rows(df.sparkSession, [{"n": g.n, "k": k, "kmo": a / (a + b), "chi2": chi, "df": k * (k - 1) // 2}]).withColumn("p", chi2_p(F.col("chi2"), F.col("df")))


def scree(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, eigenvalue, pct)."""
    f = _fields(columns)
    values, _ = _eigen(gram(numbers(df, f), list(f)).cor)
    return rows(df.sparkSession, [{"component": i + 1, "eigenvalue": v, "pct": 100 * v / len(columns)} for i, v in enumerate(values)])


def _one_factor(r: np.ndarray) -> np.ndarray:
    values, vectors = _eigen(r)
    load = vectors[:, 0] * np.sqrt(values[0])
    return np.clip(load, -0.999, 0.999)


def _ncchi2_cdf(x: float, v: float, lam: float) -> float:
    """Lower tail of the non-central chi-squared: Poisson weights times central tails, over 12 deviations of either."""
    y, m, a = x / 2, lam / 2, v / 2
    if y <= 0:
        return 0.0

    def terms(rate: float, first: float, last: float, shift: float) -> np.ndarray:
        """rate^(i + shift) e^-rate / Gamma(i + shift + 1) for i = first .. last."""
        i = np.arange(first, last + 1) + shift
        top = int(np.clip(np.searchsorted(i, rate), 0, len(i) - 1))
        step = np.log(rate) - np.log(np.maximum(i, 1e-300))
        log = np.concatenate([-np.cumsum(step[top:0:-1])[::-1], [0.0], np.cumsum(step[top + 1 :])])
        return np.exp(log + i[top] * np.log(rate) - rate - lgamma(i[top] + 1))

    reach = lambda r: 12 * np.sqrt(r) + 40
    low, high = (max(0.0, np.floor(m - reach(m))), np.ceil(m + reach(m))) if m > 0 else (0.0, 0.0)
    end = max(high, np.ceil(y - a + reach(y)))
    tails = np.cumsum(terms(y, low, end, a)[::-1])[::-1][: int(high - low) + 1]  # P(a + j, y)
    weights = terms(m, low, high, 0.0) if m > 0 else np.ones(1)
    return float(min(1.0, (weights / weights.sum() * np.minimum(1.0, tails)).sum()))


def noncentrality(x: float, v: float, lower_tail: float) -> float:
    """Non-centrality at which the non-central chi-squared is below ``x`` with this probability; 0 if none is."""
    low, high = 0.0, x + 12 * np.sqrt(x + 1) + 60
    if _ncchi2_cdf(x, v, 0.0) <= lower_tail:
        return 0.0
    while high - low > 1e-10 * max(1.0, high):
        mid = (low + high) / 2
        low, high = (mid, high) if _ncchi2_cdf(x, v, mid) > lower_tail else (low, mid)
    return (low + high) / 2


def _fit_indices(r: np.ndarray, implied: np.ndarray, n: int, chi: float, dof: int, null: float) -> dict:
    k = len(r)
    dof0 = k * (k - 1) // 2
    low = np.tril_indices(k)
    d, d0 = max(0.0, chi - dof), max(0.0, null - dof0, chi - dof)
    tli = ((null / dof0) - (chi / dof)) / ((null / dof0) - 1) if dof > 0 and null > dof0 else None
    # 90 % interval: the non-centralities at which chi-squared would be the 95th and the 5th percentile
    lo, hi = (np.sqrt(noncentrality(chi, dof, p) / (dof * (n - 1))) if dof > 0 else None for p in (0.95, 0.05))
    return {"n": n, "chi2": chi, "df": dof, "cfi": 1 - d / d0 if d0 > 0 else 1.0, "tli": tli, "rmsea": np.sqrt(d / (dof * (n - 1))) if dof > 0 else None, "rmsea_lo": lo, "rmsea_hi": hi, "srmr": float(np.sqrt(np.mean((r - implied)[low] ** 2)))}


def cfa(df: DataFrame, factors: dict[str, list[str]]) -> DataFrame:
    """(factor, item, loading, n, chi2, df, cfi, tli, rmsea, rmsea_lo, rmsea_hi, srmr, p): approximate confirmatory analysis.

    Loadings are those of each factor's first component; factors are orthogonal; chi-squared is
    (n - 1) times the summed squared residual correlations.
    """
    items = [c for cs in factors.values() for c in cs]
    f = _fields(items)
    g = gram(numbers(df, f), list(f))
    r = g.cor
    load = np.zeros((len(items), len(factors)))
    at = 0
    for j, cs in enumerate(factors.values()):
        span = slice(at, at + len(cs))
        load[span, j] = _one_factor(r[span, span])
        at += len(cs)
    implied = load @ load.T
    np.fill_diagonal(implied, 1.0)
    off = np.tril_indices(len(items), -1)
    fit = _fit_indices(r, implied, g.n, (g.n - 1) * ((r - implied)[off] ** 2).sum(), len(items) * (len(items) - 1) // 2 - len(items), (g.n - 1) * (r[off] ** 2).sum())
    out = [{"factor": name, "item": c, "loading": load[items.index(c), j], **fit} for j, (name, cs) in enumerate(factors.items()) for c in cs]
    return rows(df.sparkSession, out).withColumn("p", chi2_p(F.col("chi2"), F.col("df")))


def sem(df: DataFrame, latents: dict[str, list[str]], paths: list[tuple[str, str]]) -> DataFrame:
    """(kind, lhs, rhs, estimate, se, z, n, chi2, df, cfi, tli, rmsea, rmsea_lo, rmsea_hi, srmr, p): approximate structural model.

    Loadings are first components, latent scores are loading-weighted sums; a path's
    coefficient is the correlation of two scores, found from the item correlations without
    a pass over cases. Rows: loading, ave, cr, alpha, path, indirect (Sobel).
    """
    items = [c for cs in latents.values() for c in cs]
    f = _fields(items)
    g = gram(numbers(df, f), list(f))
    r, n = g.cor, g.n
    w = np.zeros((len(items), len(latents)))
    at = 0
    names = list(latents)
    for j, cs in enumerate(latents.values()):
        w[at : at + len(cs), j] = _one_factor(r[at : at + len(cs), at : at + len(cs)])
        at += len(cs)
    s = w.T @ r @ w
    score = s / np.sqrt(np.outer(np.diag(s), np.diag(s)))
    owner = [j for j, cs in enumerate(latents.values()) for _ in cs]
    lam = w.sum(1)
    implied = np.outer(lam, lam) * score[np.ix_(owner, owner)]
    np.fill_diagonal(implied, 1.0)
    log = lambda m: np.linalg.slogdet(m)[1]
    k = len(items)
    chi = max(0.0, (n - 1) * (log(implied) - log(r))) if np.linalg.det(implied) > 0 else np.nan
    dof = max(1, k * (k + 1) // 2 - 2 * k - len(paths))
    fit = _fit_indices(r, implied, n, chi, dof, -(n - 1) * log(r))
    out = []
    for j, (name, cs) in enumerate(latents.items()):
        own = np.array([lam[items.index(c)] for c in cs])
        out += [{"kind": "loading", "lhs": name, "rhs": c, "estimate": x} for c, x in zip(cs, own, strict=True)]
        sub = r[np.ix_([items.index(c) for c in cs], [items.index(c) for c in cs])]
        out.append({"kind": "ave", "lhs": name, "rhs": "", "estimate": (own**2).mean()})
        out.append({"kind": "cr", "lhs": name, "rhs": "", "estimate": own.sum() ** 2 / (own.sum() ** 2 + (1 - own**2).sum())})
        mean = (sub.sum() - len(cs)) / max(1, len(cs) * (len(cs) - 1))
        out.append({"kind": "alpha", "lhs": name, "rhs": "", "estimate": len(cs) * mean / (1 + (len(cs) - 1) * mean)})
    beta = {}
    for a, b in paths:
        x = score[names.index(a), names.index(b)]
        beta[a, b] = (x, np.sqrt((1 - x * x) / max(1, n - 2)))
        out.append({"kind": "path", "lhs": b, "rhs": a, "estimate": x, "se": beta[a, b][1]})
    for a, b in paths:
        for b2, c in paths:
            if b == b2:
                (x, sx), (y, sy) = beta[a, b], beta[b, c]
                out.append({"kind": "indirect", "lhs": c, "rhs": f"{a}>{b}", "estimate": x * y, "se": np.sqrt(x * x * sy * sy + y * y * sx * sx)})
    out[0].setdefault("se", None)
    t = rows(df.sparkSession, [{"kind": o["kind"], "lhs": o["lhs"], "rhs": o["rhs"], "estimate": o["estimate"], "se": o.get("se"), **fit} for o in out])
    return t.withColumn("z", div(F.col("estimate"), F.col("se"))).withColumn("p", F.when(F.col("kind").isin("path", "indirect"), z_p(F.col("z"))))


def lavaan_syntax(latents: dict[str, list[str]], paths: list[tuple[str, str]]) -> str:
    """The model as text of the lavaan language."""
    return "\n".join([*(f"{k} =~ {' + '.join(v)}" for k, v in latents.items()), *(f"{b} ~ {a}" for a, b in paths)])


def _discriminant(df: DataFrame, group: str, columns: list[str]):
    f = _fields(columns)
    d = numbers(df, f, {"g": group})
    names = list(f)
    by = d.groupBy("g").agg(*gram_columns(names))
    k = len(names)
    pooled = by.where("n >= 2").agg(*(F.sum((F.col("n") - 1) * F.col(f"c_{names[i]}_{names[j]}")).alias(f"w_{i}_{j}") for i in range(k) for j in range(i, k))).first()
    total = gram(d, names)
    w = np.array([[pooled[f"w_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = total.cov * (total.n - 1) - w
    low = np.linalg.inv(np.linalg.cholesky(w))
    values, vectors = np.linalg.eigh(low @ b @ low.T)
    n_groups = by.count()
    m = min(k, n_groups - 1)
    values, raw = np.clip(values[::-1][:m], 0, None), (low.T @ vectors)[:, ::-1][:, :m]
    raw = raw * np.where(raw.sum(0) < 0, -1, 1) * np.sqrt(total.n - n_groups)
    return d, by, total, w, values, raw, n_groups, names


def lda(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(function, item, coefficient, structure, eigenvalue, pct, canonical_r, wilks, chi2, df, p): discriminant functions, deterministic."""
    _, _, total, w, values, raw, k_groups, names = _discriminant(df, group, columns)
    p, m = len(names), len(values)
    within = w / (total.n - k_groups)
    sd = np.sqrt(np.diag(within))
    out = []
    for j in range(m):
        wilks = float(np.prod(1 / (1 + values[j:])))
        chi = -(total.n - 1 - (p + k_groups) / 2) * np.log(wilks)
        structure = within @ raw[:, j] / sd
        for i, c in enumerate(columns):
            out.append({"function": j + 1, "item": c, "coefficient": raw[i, j] * sd[i], "structure": structure[i], "eigenvalue": values[j], "pct": 100 * values[j] / values.sum(), "canonical_r": np.sqrt(values[j] / (1 + values[j])), "wilks": wilks, "chi2": chi, "df": (p - j) * (k_groups - j - 1)})
    return rows(df.sparkSession, out).withColumn("p", chi2_p(F.col("chi2"), F.col("df")))


def lda_classify(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(actual, predicted, n): each case goes to the group with the nearest centroid on the discriminant functions.

    Centroids (one row a group) are written into the row expression.
    """
    d, by, _, _, _, raw, _, names = _discriminant(df, group, columns)
    means = by.select("g", *(f"m_{x}" for x in names)).orderBy("g").collect()
    axis = [reduce(lambda a, b: a + b, (F.lit(float(raw[i, j])) * F.col(x) for i, x in enumerate(names))) for j in range(raw.shape[1])]
    d = d.withColumns({f"z{j}": a for j, a in enumerate(axis)})
    far = []
    for r in means:
        c = np.array([r[f"m_{x}"] for x in names]) @ raw
        far.append(F.struct(reduce(lambda a, b: a + b, ((F.col(f"z{j}") - float(c[j])) * (F.col(f"z{j}") - float(c[j])) for j in range(len(c)))).alias("d"), F.lit(r["g"]).alias("g")))
    near = F.array_min(F.array(*far))["g"]
    return d.groupBy(F.col("g").alias("actual"), near.alias("predicted")).agg(F.count("*").alias("n"))


def _standardised(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    f = _fields(columns)
    names = list(f)
    d = numbers(df, f)
    s = d.agg(*(F.avg(x).alias(f"m{x}") for x in names), *(F.stddev_samp(x).alias(f"s{x}") for x in names)).first()
    return d.select(*((F.col(x) - float(s[f"m{x}"] or 0)) / float(s[f"s{x}"] or 1) if s[f"s{x}"] else F.lit(0.0) for x in names)).toDF(*names), names


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 7, rounds: int = 100) -> DataFrame:
    """(cluster, n, c_<column>..., wss, total_wss, bss, silhouette): Lloyd's method on z-scores, distributed.

    ``silhouette`` is that of squared distances (computed from cluster sums, so in one pass).
    """
    from pyspark.ml.evaluation import ClusteringEvaluator

    d, names = _standardised(df, columns)
    v = VectorAssembler(inputCols=names, outputCol="features").transform(d).persist()
    model = KMeans(k=k, seed=seed, maxIter=rounds, initMode="k-means||").fit(v)
    p = model.transform(v)
    sil = ClusteringEvaluator().evaluate(p) if k > 1 else None
    # around the clusters' own means, so that within and between sums add up
    out = p.groupBy("prediction").agg(F.count("*").alias("n"), *(F.avg(x).alias(f"c{i}") for i, x in enumerate(names)), reduce(lambda a, b: a + b, ((F.count("*") - 1) * F.coalesce(F.var_samp(x), F.lit(0.0)) for x in names)).alias("wss")).collect()  # k rows
    v.unpersist()
    wss = sum(r["wss"] for r in out)
    bss = sum(r["n"] * sum(r[f"c{i}"] ** 2 for i in range(len(names))) for r in out)
    return rows(df.sparkSession, [{"cluster": r["prediction"] + 1, "n": r["n"], **{f"c_{c}": r[f"c{i}"] for i, c in enumerate(columns)}, "wss": r["wss"], "total_wss": wss, "bss": bss, "silhouette": sil} for r in out])


def kmeans_assign(df: DataFrame, columns: list[str], k: int, seed: int = 7, rounds: int = 100) -> DataFrame:
    """``df`` with ``cluster`` (1 to k, as in ``kmeans``; null for cases that miss a column)."""
    f = _fields(columns)
    names = list(f)
    d, _ = _standardised(df, columns)
    v = VectorAssembler(inputCols=names, outputCol="features").transform(d).persist()
    model = KMeans(k=k, seed=seed, maxIter=rounds, initMode="k-means||").fit(v)
    v.unpersist()
    s = numbers(df, f).agg(*(F.avg(x).alias(f"m{x}") for x in names), *(F.stddev_samp(x).alias(f"s{x}") for x in names)).first()
    z = [(number(df, c) - float(s[f"m{x}"] or 0)) / float(s[f"s{x}"]) if s[f"s{x}"] else F.when(number(df, c).isNotNull(), 0.0) for x, c in f.items()]
    far = [F.struct(reduce(lambda a, b: a + b, ((x - float(c)) * (x - float(c)) for x, c in zip(z, centre, strict=True))).alias("d"), F.lit(i + 1).alias("i")) for i, centre in enumerate(model.clusterCenters())]
    known = reduce(lambda a, b: a & b, (x.isNotNull() for x in z))
    return df.withColumn("cluster", F.when(known, F.array_min(F.array(*far))["i"]))


def cluster_anova(assigned: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """(variable, k, n, ss_b, ss_w, ..., f, p): how far clusters differ in each variable."""
    from statloom.operators.means import manova_followups

    return manova_followups(assigned.where(F.col(cluster).isNotNull()), columns, cluster)


def elbow(df: DataFrame, columns: list[str], most: int = 8, seed: int = 7) -> DataFrame:
    """(k, wss) for 2 to ``most`` clusters."""
    d, names = _standardised(df, columns)
    v = VectorAssembler(inputCols=names, outputCol="features").transform(d).persist()
    out = [{"k": k, "wss": KMeans(k=k, seed=seed).fit(v).summary.trainingCost} for k in range(2, most + 1)]
    v.unpersist()
    return rows(df.sparkSession, out)


def _first_cases(df: DataFrame, columns: list[str], order: str, most: int) -> tuple[list, np.ndarray]:
    """Order values and numbers of the first ``most`` cases by ``order`` that miss none of the columns."""
    f = _fields(columns)
    first = df.orderBy(F.col(f"`{order}`")).limit(most)
    got = first.select(F.col(f"`{order}`").alias("o"), *(number(first, c).alias(x) for x, c in f.items())).dropna(subset=list(f)).orderBy("o").collect()
    return [r["o"] for r in got], np.array([[r[x] for x in f] for r in got], float).reshape(-1, len(columns))


def hierarchical(df: DataFrame, columns: list[str], order: str, linkage: str = "average", most: int = 200) -> DataFrame:
    """(step, a, b, distance, size): merges of the first ``most`` cases by ``order`` (the feature's limit), on z-scores.

    ``linkage``: single, complete, average or ward, by the Lance-Williams rule.
    """
    _, x = _first_cases(df, columns, order, most)
    return rows(df.sparkSession, [{"step": i + 1, "a": a, "b": b, "distance": dist, "size": n} for i, (a, b, dist, n) in enumerate(_merges(x, linkage))] or [{"step": None, "a": None, "b": None, "distance": None, "size": None}])


def hierarchical_clusters(df: DataFrame, columns: list[str], order: str, k: int = 2, linkage: str = "average", most: int = 200) -> DataFrame:
    """(``order``, cluster, n, silhouette, mean_silhouette, c_<column>...): the tree of ``hierarchical`` cut at ``k``
    clusters, numbered by their first case; for each case its cluster's size and means, and its
    silhouette of plain distances on z-scores (0 in a cluster by itself).
    """
    label, x = _first_cases(df, columns, order, most)
    n = len(x)
    names = [f"c_{c}" for c in columns]
    if not n:
        return rows(df.sparkSession, [dict.fromkeys((order, "cluster", "n", "silhouette", "mean_silhouette", *names))]).limit(0)
    member = {i: [i] for i in range(n)}
    for step, (a, b, _, _) in enumerate(_merges(x, linkage)):
        if len(member) <= k:
            break
        member[n + step] = member.pop(a) + member.pop(b)
    own = np.zeros(n, int)
    for i, cases in enumerate(sorted(member.values(), key=min)):
        own[cases] = i
    sd = x.std(0, ddof=1) if n > 1 else np.ones(x.shape[1])
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    far = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    size = np.bincount(own)
    to = np.stack([far[:, own == c].sum(1) for c in range(len(size))], 1)
    inside = to[range(n), own] / np.maximum(1, size[own] - 1)
    other = np.where(np.arange(len(size)) == own[:, None], np.inf, to / size).min(1)
    sil = np.where((size[own] > 1) & np.isfinite(other), (other - inside) / np.maximum(1e-300, np.maximum(other, inside)), 0.0)
    means = np.stack([x[own == c].mean(0) for c in range(len(size))])
    return rows(df.sparkSession, [{order: label[i], "cluster": int(own[i]) + 1, "n": int(size[own[i]]), "silhouette": sil[i], "mean_silhouette": sil.mean(), **dict(zip(names, means[own[i]], strict=True))} for i in range(n)])


def _merges(x: np.ndarray, linkage: str):
    n = len(x)
    sd = x.std(0, ddof=1) if n > 1 else np.ones(x.shape[1])
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1) if n else x
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    d = d if linkage == "ward" else np.sqrt(d)
    d = d + np.diag(np.full(n, np.inf))
    size, label, alive = np.ones(n), list(range(n)), set(range(n))
    for step in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        dist = d[i, j]
        for t in alive - {i, j}:
            a, b = d[i, t], d[j, t]
            if linkage == "ward":
                new = ((size[i] + size[t]) * a + (size[j] + size[t]) * b - size[t] * dist) / (size[i] + size[j] + size[t])
            else:
                new = {"single": min(a, b), "complete": max(a, b), "average": (size[i] * a + size[j] * b) / (size[i] + size[j])}[linkage]
            d[i, t] = d[t, i] = new
        size[i] += size[j]
        d[j], d[:, j] = np.inf, np.inf
        alive.discard(j)
        yield label[i], label[j], float(np.sqrt(dist) if linkage == "ward" else dist), int(size[i])
        label[i] = n + step
