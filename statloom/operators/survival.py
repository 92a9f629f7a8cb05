"""Survival: Kaplan-Meier, log-rank, Cox regression. Work is on distinct times with their counts."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.special import chi2_p, div, z_p
from statloom.plans.shared import cut
from statloom.plans.stats import counted, cuts_of, number, numbers, rows, running


def _times(df: DataFrame, time: str, event: str, group: str | None) -> DataFrame:
    """(grp, t, d, m): events (value 1) and cases at each distinct time of each group."""
    g = F.col(f"`{group}`").cast("string") if group else F.lit("all")
    d = df.select(g.alias("grp"), number(df, time).alias("t"), (number(df, event) == 1).cast("int").alias("e")).dropna(subset=["grp", "t"]).where("t >= 0")
    return d.groupBy("grp", "t").agg(F.sum(F.coalesce("e", F.lit(0))).alias("d"), F.count("*").alias("m"))


def kaplan_meier(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    """(grp, t, at_risk, events, censored, s, se, ci_lo, ci_hi) at every distinct time; Greenwood errors.

    A missing event counts as censored.
    """
    c = _times(df, time, event, group)
    r = running(c, "t", ["m"], ["grp"], descending=True).withColumnRenamed("cum_m", "at_risk")
    r = r.withColumns({"ln": F.when(F.col("d") < F.col("at_risk"), F.log1p(-F.col("d") / F.col("at_risk"))).otherwise(0.0), "dead": (F.col("d") == F.col("at_risk")).cast("bigint"), "v": F.coalesce(div(F.col("d"), F.col("at_risk") * (F.col("at_risk") - F.col("d"))), F.lit(0.0))})
    r = running(r, "t", ["ln", "dead", "v"], ["grp"])
    s = F.when(F.col("cum_dead") > 0, 0.0).otherwise(F.exp("cum_ln"))
    r = r.withColumn("s", s).withColumn("se", F.col("s") * F.sqrt("cum_v"))
    return r.select("grp", "t", "at_risk", F.col("d").alias("events"), (F.col("m") - F.col("d")).alias("censored"), "s", "se", F.greatest(F.lit(0.0), F.col("s") - 1.96 * F.col("se")).alias("ci_lo"), F.least(F.lit(1.0), F.col("s") + 1.96 * F.col("se")).alias("ci_hi"))


def median_survival(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    """(grp, n, events, median): the first time at which survival is one half or less."""
    k = kaplan_meier(df, time, event, group)
    return k.groupBy("grp").agg(F.max("at_risk").alias("n"), F.sum("events").alias("events"), F.min(F.when(F.col("s") <= 0.5, F.col("t"))).alias("median"))


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(grp, o, e, chi2, df, p): observed and expected events; chi-squared as the sum of (o - e)^2 / e.

    Expected events of a group are the sum over its cases of the cumulative hazard at their
    time, so no grid of times and groups is made.
    """
    c = _times(df, time, event, group)
    whole = c.groupBy("t").agg(F.sum("d").alias("D"), F.sum("m").alias("M"))
    h = running(whole, "t", ["M"], descending=True).withColumn("h", F.col("D") / F.col("cum_M"))
    h = running(h.select("t", "h"), "t", ["h"]).select("t", F.col("cum_h").alias("H"))
    g = c.join(h, "t").groupBy("grp").agg(F.sum("d").alias("o"), F.sum(F.col("m") * F.col("H")).alias("e"))
    s = g.agg(F.sum(div((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")), F.col("e"))).alias("chi2"), (F.count("*") - 1).alias("df"))
    s = s.withColumn("p", chi2_p(F.col("chi2"), F.col("df")))
    return g.crossJoin(F.broadcast(s)).select("grp", "o", "e", "chi2", "df", "p")  # s is one row


def cox(df: DataFrame, time: str, event: str, covariates: list[str], steps: int = 25) -> DataFrame:
    """(term, b, se, z, p, hr, ci_lo, ci_hi, n, events, ll, ll_null, chi2, df, p_model): proportional hazards, Breslow ties.

    Each Newton step sums risk, its gradient and its information over distinct times, and
    runs them down from the last time; the result of a step is k + k^2 / 2 numbers.
    """
    names = [f"x{i}" for i in range(len(covariates))]
    d = numbers(df, {**dict(zip(names, covariates, strict=True)), "t": time, "e": event})
    d = d.withColumn("e", (F.col("e") == 1).cast("int"))
    s = d.agg(F.count("*").alias("n"), F.sum("e").alias("ev"), *(F.avg(x).alias(f"m{x}") for x in names), *(F.stddev_samp(x).alias(f"s{x}") for x in names)).first()
    k = len(names)
    if (s["ev"] or 0) < 5 or s["n"] < k + 5:
        raise ValueError("five events and k + 5 cases are needed")
    sd = np.array([s[f"s{x}"] or 1.0 for x in names])
    d = counted(d, [*names, "t", "e"])  # only sums by time are shuffled in a step
    d = d.withColumns({x: (F.col(x) - s[f"m{x}"]) / float(sd[i]) for i, x in enumerate(names)})
    cuts = cuts_of(d, "t")

    def pass_(b: np.ndarray):
        eta = reduce(lambda a, c: a + c, (F.lit(float(v)) * F.col(x) for v, x in zip(b, names, strict=True)))
        q = d.withColumn("eta", eta).withColumn("r", F.exp("eta") * F.col("c"))
        one = [f"s1_{i}" for i in range(k)]
        two = [f"s2_{i}_{j}" for i in range(k) for j in range(i, k)]
        at = q.groupBy("t").agg(
            F.sum(F.col("e") * F.col("c")).alias("d"), F.sum(F.col("e") * F.col("c") * F.col("eta")).alias("deta"), *(F.sum(F.col("e") * F.col("c") * F.col(x)).alias(f"dx{i}") for i, x in enumerate(names)),
            F.sum("r").alias("s0"), *(F.sum(F.col("r") * F.col(x)).alias(o) for o, x in zip(one, names, strict=True)), *(F.sum(F.col("r") * F.col(names[i]) * F.col(names[j])).alias(f"s2_{i}_{j}") for i in range(k) for j in range(i, k)),
        )
        z = running(at, "t", ["s0", *one, *two], descending=True, cuts=cuts).where("d > 0")
        mean = lambda i: F.col(f"cum_s1_{i}") / F.col("cum_s0")
        o = z.agg(
            F.sum(F.col("deta") - F.col("d") * F.log("cum_s0")).alias("ll"), *(F.sum(F.col(f"dx{i}") - F.col("d") * mean(i)).alias(f"g{i}") for i in range(k)),
            *(F.sum(F.col("d") * (F.col(f"cum_s2_{i}_{j}") / F.col("cum_s0") - mean(i) * mean(j))).alias(f"h_{i}_{j}") for i in range(k) for j in range(i, k)),
        ).first()
        return o["ll"], np.array([o[f"g{i}"] for i in range(k)]), np.array([[o[f"h_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    b = np.zeros(k)
    ll0, g, h = pass_(b)
    ll = ll0
    for _ in range(steps):
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        scale, new = 1.0, pass_(b + move)
        while new[0] < ll - 1e-10 and scale > 1e-4:
            scale /= 2
            new = pass_(b + scale * move)
        b, gain = b + scale * move, new[0] - ll
        ll, g, h = new
        if abs(gain) < 1e-9 * (1 + abs(ll)):
            break
    se = np.sqrt(np.diag(np.linalg.inv(h))) / sd
    b = b / sd
    t = rows(df.sparkSession, [{"term": c, "b": b[i], "se": se[i], "n": s["n"], "events": s["ev"], "ll": ll, "ll_null": ll0, "chi2": 2 * (ll - ll0), "df": k} for i, c in enumerate(covariates)])
    t = t.withColumn("z", div(F.col("b"), F.col("se"))).withColumn("p", z_p(F.col("z")))
    return t.withColumns({"hr": F.exp("b"), "ci_lo": F.exp(F.col("b") - 1.96 * F.col("se")), "ci_hi": F.exp(F.col("b") + 1.96 * F.col("se")), "p_model": chi2_p(F.col("chi2"), F.col("df"))})


def concordance(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """(c, concordant, comparable): Harrell's C of a risk score. A pair is comparable if the earlier of
    two different times is an event, concordant if that case has the higher risk.

    No pair is made. Risks are numbered in order; two of them differ first at some bit of their
    numbers, so each bit counts, within cases that agree above it, those with a 0 that come
    later than an event with a 1. All bits are rows of one plan: n log n of them.
    """
    d = df.select(number(df, time).alias("t"), (number(df, event) == 1).cast("int").alias("e"), number(df, risk).alias("r")).dropna(subset=["t", "r"]).where("t >= 0")
    d = cut(d.groupBy("t", "r").agg(F.sum(F.coalesce("e", F.lit(0))).alias("d"), F.count("*").alias("m")), "concordance")
    order = running(d.groupBy("r").agg(F.lit(1).cast("bigint").alias("one")), "r", ["one"]).select("r", (F.col("cum_one") - 1).alias("i"))
    most = order.agg(F.max("i")).first()[0]
    if most is None:
        return rows(df.sparkSession, [{"c": None, "concordant": 0, "comparable": 0}])
    cuts = cuts_of(d, "t")
    at = running(d.groupBy("t").agg(F.sum("d").alias("d"), F.sum("m").alias("m")), "t", ["m"], descending=True, cuts=cuts)
    pairs = at.agg(F.sum(F.col("d") * (F.col("cum_m") - F.col("m")))).first()[0]
    levels = F.array(*map(F.lit, range(max(1, int(most).bit_length()))))
    x = d.join(order, "r").withColumn("level", F.explode(levels))
    one = F.expr("shiftright(i, level) & 1 = 1")
    x = x.groupBy("level", F.expr("shiftright(i, level + 1)").alias("above"), "t").agg(F.sum(F.when(one, F.col("d")).otherwise(0)).alias("high"), F.sum(F.when(~one, F.col("m")).otherwise(0)).alias("low"))
    x = running(x, "t", ["low"], ["level", "above"], descending=True, cuts=cuts)
    good = x.agg(F.sum(F.col("high") * (F.col("cum_low") - F.col("low")))).first()[0]
    return rows(df.sparkSession, [{"c": float(good) / pairs if pairs else None, "concordant": int(good), "comparable": int(pairs)}]).withColumn("c", F.col("c").cast("double"))


def cox_concordance(df: DataFrame, time: str, event: str, covariates: list[str]) -> DataFrame:
    """``concordance`` of the linear predictor of ``cox``, over the cases that it uses."""
    b = {r["term"]: r["b"] for r in cox(df, time, event, covariates).select("term", "b").collect()}
    names = [f"x{i}" for i in range(len(covariates))]
    d = numbers(df, {**dict(zip(names, covariates, strict=True)), "t": time, "e": event})
    return concordance(d.withColumn("risk", reduce(lambda a, c: a + c, (F.lit(b[v]) * F.col(x) for x, v in zip(names, covariates, strict=True)))), "t", "e", "risk")
