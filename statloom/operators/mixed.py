"""Mixed models with random slopes, cluster effects, and components from nested sums of squares.

A model needs a cluster's cross-products alone: of 1, the predictors and the outcome. They are
summed once; each step of a fit is one pass over the table of clusters, whose tasks add up
small matrices, and no cluster is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.special import chi2_p, div, z_p
from statloom.operators.multilevel import _cluster_stats, _fit, _prepared
from statloom.plans.shared import cut
from statloom.plans.stats import numbers, rows


def _products(columns: list[str], k: int, batch: pa.RecordBatch) -> np.ndarray:
    """Symmetric matrices of cross-products, one for each cluster of a batch."""
    out = np.empty((batch.num_rows, k, k))
    for c in columns:
        i, j = map(int, c.split("_")[1:])
        out[:, i, j] = out[:, j, i] = batch.column(c).to_numpy(zero_copy_only=False)
    return out


class _Model:
    """y = X b + Z u + e by maximum likelihood; Z: columns ``z`` of X; u has covariance ``d`` times that of e."""

    def __init__(self, stats: DataFrame, k: int, z: list[int]):
        self.stats, self.k, self.z, self.q = stats, k, z, len(z)
        self.columns = [c for c in stats.columns if c.startswith("q_")]
        self.pairs = list(combinations_with_replacement(range(self.q), 2))

    def sums(self, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Over all clusters, with W = (I + Z'Z d)^-1: generalised cross-products, log determinant, sum of T = W Z'Z,
        sum of the products of T with itself, and sum of the products of W Z'(X, y) with itself; clusters and cases."""
        k, z, q, columns = self.k, self.z, self.q, self.columns

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k + 1 + q * q + q**4 + (q * k) ** 2 + 2)
            for batch in batches:
                c = _products(columns, k, batch)
                zc, zz = c[:, z, :], c[:, z][:, :, z]
                core = np.eye(q) + zz @ d
                p, t = np.linalg.solve(core, zc), np.linalg.solve(core, zz)
                gls = (c - zc.transpose(0, 2, 1) @ d @ p).sum(0)
                flat = t.reshape(-1, q * q), p.reshape(-1, q * k)
                total += np.concatenate([gls.ravel(), [np.linalg.slogdet(core)[1].sum()], t.sum(0).ravel(), *((f.T @ f).ravel() for f in flat), [len(c), c[:, 0, 0].sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["total"])

        parts = self.stats.select(*columns).mapInArrow(each, "total array<double>")  # a row a task
        got = parts.select(F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        flat = np.array([x for _, x in sorted(map(tuple, got))])
        ends = np.cumsum([k * k, 1, q * q, q**4, (q * k) ** 2])
        gls, ld, t, tt, pp, n = np.split(flat, ends)
        return gls.reshape(k, k), float(ld[0]), t.reshape(q, q), tt.reshape(q, q, q, q), pp.reshape(q, k, q, k), n

    def at(self, d: np.ndarray) -> dict:
        gls, ld, t, tt, pp, (clusters, n) = self.sums(d)
        inv = np.linalg.inv(gls[:-1, :-1])
        b = inv @ gls[:-1, -1]
        s2 = (gls[-1, -1] - b @ gls[:-1, -1]) / n
        v = np.append(-b, 1.0)
        ss = np.einsum("iajb,a,b->ij", pp, v, v) / s2  # sum of s s', s = W Z'(y - X b)
        return {"d": d, "beta": b, "inv": inv, "s2": s2, "t": t, "tt": tt, "ss": ss, "k": int(clusters), "n": int(n), "dev": n * (np.log(2 * np.pi * s2) + 1) + ld}

    def step(self, f: dict) -> np.ndarray:
        """Fisher scoring in the elements of d, with the residual variance profiled out."""
        unit = []
        for i, j in self.pairs:
            e = np.zeros((self.q, self.q))
            e[i, j] = e[j, i] = 1.0
            unit.append(e)
        score = np.array([np.sum(e * (f["ss"] - f["t"])) for e in unit])
        trace = np.array([np.sum(e * f["t"]) for e in unit])
        # tr(T a T b) summed over clusters
        info = np.array([[np.einsum("jkli,ij,kl->", f["tt"], a, b) for b in unit] for a in unit]) - np.outer(trace, trace) / f["n"]
        move = np.linalg.lstsq(info, score, rcond=1e-12)[0]
        return sum(x * e for x, e in zip(move, unit, strict=True))

    def fit(self, rounds: int = 60) -> dict:
        """Scoring, halved where the deviance would rise; where d would lose its sign, eigenvalues are cut at
        zero, and if that doesn't help either, a step of EM, which never leaves the domain."""
        mean = np.array([self.stats.agg(F.sum(f"q_{i}_{i}")).first()[0] / max(1.0, self.stats.agg(F.sum("q_0_0")).first()[0]) for i in self.z])
        f = self.at(np.diag(0.1 / np.maximum(mean, 1e-12)))
        scale = np.sqrt(np.outer(mean, mean))
        for _ in range(rounds):
            move, best = self.step(f), None
            for half in (1.0, 0.5, 0.125):
                values, vectors = np.linalg.eigh((f["d"] + half * move) * scale)
                found = self.at((vectors * np.maximum(values, 0.0)) @ vectors.T / scale)
                if found["dev"] <= f["dev"] + 1e-9:
                    best = found
                    break
            if best is None:
                best = self.at(f["d"] + f["d"] @ (f["ss"] - f["t"]) @ f["d"] / f["k"])
            change = np.abs((best["d"] - f["d"]) * scale).max() / max(1e-12, np.abs(best["d"] * scale).max())
            f = best
            if change < 1e-10:
                break
        return f


def _start(df: DataFrame, value: str, group: str, level1: list[str], level2: list[str], slopes: list[str]) -> tuple[DataFrame, list[str], list[int], np.ndarray]:
    """Cluster cross-products of centred columns (written once), labels, columns of Z, and means."""
    d, names = _prepared(df, value, list(level1), {"g2": group}, list(level2))
    s = d.agg(*(F.avg(c).alias(c) for c in [*names, "y"])).first()
    means = np.array([float(s[c] or 0.0) for c in [*names, "y"]])
    d = d.withColumns({c: F.col(c) - float(m) for c, m in zip([*names, "y"], means, strict=True)})
    z = [0, *(1 + list(level1).index(c) for c in slopes)]
    return cut(_cluster_stats(d, names, ["g2"]), "clusters"), ["(constant)", *level1, *level2], z, means


def random_slopes(df: DataFrame, value: str, group: str, level1: list[str], slopes: list[str], level2: list[str] = ()) -> DataFrame:
    """(term, b, se, z, p, n, k, sigma2, tau_i_j, icc, deviance, slopes_lrt, slopes_df, slopes_p).

    Intercepts and the slopes of ``slopes`` (some of ``level1``) vary between clusters of ``group``
    with any covariance; maximum likelihood. Predictors are centred at their grand means, the
    intercept's variance ``tau_0_0`` and its covariances are those at the means; ``b`` of the constant is at
    zero, as usual. The last columns test the slopes' variances and covariances against
    intercepts alone.
    """
    stats, labels, z, means = _start(df, value, group, level1, level2, slopes)
    k = len(labels) + 1
    f, plain = _Model(stats, k, z).fit(), _Model(stats, k, [0]).fit()
    t = np.eye(len(labels))
    t[0, 1:] = -means[:-1]
    b, se = t @ f["beta"], np.sqrt(np.diag(t @ f["inv"] @ t.T) * f["s2"])
    b[0] += means[-1]
    tau = f["d"] * f["s2"]
    more = {"n": f["n"], "k": f["k"], "sigma2": f["s2"]} | {f"tau_{i}_{j}": tau[i, j] for i, j in combinations_with_replacement(range(len(z)), 2)}
    more |= {"icc": tau[0, 0] / (tau[0, 0] + f["s2"]), "deviance": f["dev"], "slopes_lrt": max(0.0, plain["dev"] - f["dev"]), "slopes_df": len(z) * (len(z) + 1) // 2 - 1}
    out = rows(df.sparkSession, [{"term": c, "b": b[i], "se": se[i], **more} for i, c in enumerate(labels)])
    out = out.withColumn("z", div(F.col("b"), F.col("se"))).withColumn("p", z_p(F.col("z")))
    return out.withColumn("slopes_p", chi2_p(F.col("slopes_lrt"), F.col("slopes_df")) if slopes else F.lit(None).cast("double"))


def cluster_effects(df: DataFrame, value: str, group: str, level1: list[str], slopes: list[str] = (), level2: list[str] = ()) -> DataFrame:
    """(cluster, term, n, effect, variance, reliability): empirical Bayes effects of each cluster's intercept and
    slopes: what is added to the fixed effects (at the predictors' means), its posterior variance, and
    one minus that variance's share of the variance between clusters."""
    stats, labels, z, _ = _start(df, value, group, level1, level2, list(slopes))
    k = len(labels) + 1
    f = _Model(stats, k, z).fit()
    columns, q, d, s2 = [c for c in stats.columns if c.startswith("q_")], len(z), f["d"], f["s2"]
    v, terms = np.append(-f["beta"], 1.0), [labels[i] for i in z]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _products(columns, k, batch)
            zc, zz = c[:, z, :], c[:, z][:, :, z]
            core = np.eye(q) + zz @ d
            effect = np.linalg.solve(core, zc @ v[:, None])[:, :, 0] @ d
            left = s2 * (d - d @ np.linalg.solve(core, zz) @ d)
            var = left[:, range(q), range(q)]
            with np.errstate(divide="ignore", invalid="ignore"):
                sure = 1 - var / (s2 * np.diag(d))
            names = np.repeat(batch.column("g2").to_pylist(), q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.tolist(), pa.string()), pa.array(terms * len(c)), pa.array(np.repeat(c[:, 0, 0], q).astype(np.int64)), *(pa.array(x.ravel(), from_pandas=True) for x in (effect, var, sure))],
                ["cluster", "term", "n", "effect", "variance", "reliability"],
            )

    return stats.mapInArrow(each, "cluster string, term string, n bigint, effect double, variance double, reliability double")


def nested_effects(df: DataFrame, value: str, group: str, outer: str, level1: list[str] = ()) -> DataFrame:
    """(outer, cluster, n, outer_effect, outer_variance, outer_reliability, effect, variance, reliability): empirical
    Bayes intercepts of clusters nested in ``outer``, a row a cluster; expressions over the tables of sums."""
    d, names = _prepared(df, value, list(level1), {"g2": group, "g3": outer}, [])
    s = d.agg(*(F.avg(c).alias(c) for c in [*names, "y"])).first()
    d = d.withColumns({c: F.col(c) - float(s[c] or 0.0) for c in [*names, "y"]})
    stats = cut(_cluster_stats(d, names, ["g3", "g2"]), "clusters")
    f = _fit(stats, len(names) + 2, True)
    a, b, s2, last = float(f["a"]), float(f["b"]), float(f["s2"]), len(names) + 1
    n = F.col("q_0_0")
    rest = F.col(f"q_0_{last}") - sum((F.col(f"q_0_{i}") * float(x) for i, x in enumerate(f["beta"])), F.lit(0.0))
    low = stats.select("g3", "g2", n.alias("n"), rest.alias("r"), (1 + n * a).alias("c"))
    top = low.groupBy("g3").agg(F.sum(F.col("n") / F.col("c")).alias("m"), F.sum(F.col("r") / F.col("c")).alias("s"))
    top = top.select("g3", (b * F.col("s") / (1 + b * F.col("m"))).alias("outer_effect"), (s2 * b / (1 + b * F.col("m"))).alias("outer_variance"))
    share = F.col("n") * a / F.col("c")
    var = s2 * a / F.col("c") + share * share * F.col("outer_variance")
    sure = lambda x, tau: F.when(F.lit(tau) > 0, 1 - x / tau)
    return low.join(top, "g3").select(
        F.col("g3").alias("outer"), F.col("g2").alias("cluster"), F.col("n").cast("bigint").alias("n"), "outer_effect", "outer_variance", sure(F.col("outer_variance"), s2 * b).alias("outer_reliability"),
        (a / F.col("c") * (F.col("r") - F.col("n") * F.col("outer_effect"))).alias("effect"), var.alias("variance"), sure(var, s2 * a).alias("reliability"),
    )


def nested_components(df: DataFrame, value: str, group: str, outer: str) -> DataFrame:
    """(k3, k2, n, ms_outer, ms_group, ms_error, c_group, c_outer_group, c_outer, sigma2, tau2, tau3, icc2, icc3): variance
    components of cases in ``group`` in ``outer`` from the expected mean squares of unequal sizes; one pass
    over cases. Negative components are zero, as their expectation can't be; ``c_*`` are the coefficients."""
    d = numbers(df, {"v": value}, {"g2": group, "g3": outer})
    at = float(d.agg(F.avg("v")).first()[0] or 0.0)
    x = F.col("v") - at
    g = d.groupBy("g3", "g2").agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    sq = lambda c: F.col(c) * F.col(c)
    h = g.groupBy("g3").agg(F.count("*").alias("k2"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(sq("s") / F.col("n")).alias("sb"), F.sum(sq("n")).alias("nn"))
    t = h.agg(
        F.count("*").alias("k3"), F.sum("k2").alias("k2"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("sb").alias("sb"), F.sum(sq("s") / F.col("n")).alias("sa"),
        F.sum("nn").alias("nn"), F.sum(F.col("nn") / F.col("n")).alias("na"), F.sum(sq("n")).alias("nk"),
    )
    c = F.col
    t = t.withColumns({
        "ms_outer": div(c("sa") - sq("s") / c("n"), c("k3") - 1), "ms_group": div(c("sb") - c("sa"), c("k2") - c("k3")), "ms_error": div(c("q") - c("sb"), c("n") - c("k2")),
        "c_group": div(c("n") - c("na"), c("k2") - c("k3")), "c_outer_group": div(c("na") - c("nn") / c("n"), c("k3") - 1), "c_outer": div(c("n") - c("nk") / c("n"), c("k3") - 1),
    })
    zero = lambda e: F.greatest(F.lit(0.0), e)
    t = t.withColumn("tau2", zero(div(c("ms_group") - c("ms_error"), c("c_group"))))
    t = t.withColumn("tau3", zero(div(c("ms_outer") - c("ms_error") - c("c_outer_group") * c("tau2"), c("c_outer")))).withColumn("whole", c("ms_error") + c("tau2") + c("tau3"))
    return t.select("k3", "k2", c("n").cast("bigint").alias("n"), "ms_outer", "ms_group", "ms_error", "c_group", "c_outer_group", "c_outer", c("ms_error").alias("sigma2"), "tau2", "tau3", div(c("tau2") + c("tau3"), c("whole")).alias("icc2"), div(c("tau3"), c("whole")).alias("icc3"))
