"""Time series: autocorrelation, differences, ARIMA, seasonal decomposition.

Series are in the order of a column. Neighbours within a given distance come from windows
over ranges of the position, with the next range's first cases repeated; no window holds
the whole series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.plans.stats import numbers, rows, running

#: Positions in one window; each task holds a few such blocks.
BLOCK = 100_000


def series(df: DataFrame, value: str, order: str) -> DataFrame:
    """(i, y): valid values numbered from 0 in the order of ``order`` (numeric; equal ones are averaged)."""
    d = numbers(df, {"o": order, "y": value}).groupBy("o").agg(F.avg("y").alias("y"), F.lit(1).cast("bigint").alias("k"))
    return running(d, "o", ["k"]).select((F.col("cum_k") - 1).alias("i"), "y")


def _blocks(s: DataFrame, before: int, after: int, size: int = BLOCK) -> tuple[DataFrame, Window]:
    """Each block with up to ``before`` and ``after`` neighbours of its edges; own rows have mine = true."""
    b = F.floor(F.col("i") / size)
    near = F.array_distinct(F.array(b, F.floor((F.col("i") - after) / size), F.floor((F.col("i") + before) / size)))
    if max(before, after) > size:
        raise ValueError("the distance is larger than a block")
    d = s.withColumn("mine", b).withColumn("b", F.explode(near)).where("b >= 0")
    return d.withColumn("mine", F.col("mine") == F.col("b")), Window.partitionBy("b").orderBy("i")


def acf(df: DataFrame, value: str, order: str, lags: int = 10) -> DataFrame:
    """(lag, acf, pacf): autocovariances over n, and Durbin-Levinson's partial ones; one pass for all lags."""
    s = series(df, value, order)
    a = _acf(s, lags)
    return rows(df.sparkSession, [{"lag": k, "acf": a[k], "pacf": p} for k, p in enumerate([1.0, *_pacf(a)])])


def _acf(s: DataFrame, lags: int) -> np.ndarray:
    m = s.agg(F.avg("y").alias("m"), F.count("*").alias("n"), F.var_pop("y").alias("v")).first()
    if not m["v"]:
        return np.array([1.0, *np.zeros(lags)])
    d, w = _blocks(s, 0, lags)
    z = F.col("y") - m["m"]
    d = d.withColumns({f"l{k}": z * (F.lead("y", k).over(w) - m["m"]) for k in range(1, lags + 1)}).where("mine")
    r = d.agg(*(F.coalesce(F.sum(f"l{k}"), F.lit(0.0)).alias(f"l{k}") for k in range(1, lags + 1))).first()
    return np.array([1.0, *(r[f"l{k}"] / m["n"] / m["v"] for k in range(1, lags + 1))])


def _pacf(a: np.ndarray) -> list[float]:
    """Each is the last coefficient of the autoregression of its order."""
    out = []
    for k in range(1, len(a)):
        r = np.array([[a[abs(i - j)] for j in range(k)] for i in range(k)])
        try:
            out.append(float(np.linalg.solve(r, a[1 : k + 1])[-1]))
        except np.linalg.LinAlgError:
            out.append(0.0)
    return out


def difference(df: DataFrame, value: str, order: str, times: int = 1) -> DataFrame:
    """(i, y): the series differenced ``times`` times."""
    s = series(df, value, order)
    return _differenced(s, times)


def _differenced(s: DataFrame, times: int) -> DataFrame:
    for _ in range(times):
        d, w = _blocks(s, 1, 0)
        s = d.withColumn("y", F.col("y") - F.lag("y").over(w)).where("mine and y is not null").select("i", "y")
    if times:
        s = s.withColumn("i", F.col("i") - times)
    return s


def arima(df: DataFrame, value: str, order: str, p: int = 1, d: int = 0, q: int = 0) -> DataFrame:
    """(term, b, n, sigma2, aic, bic, forecast, lo, hi): approximate fit of the differenced series.

    AR terms by Yule-Walker, MA terms are the residuals' autocorrelations; the forecast is one
    step ahead of the differenced series by the AR part, with 1.96 sigma around.
    """
    s = _differenced(series(df, value, order), d).persist()
    m = s.agg(F.avg("y").alias("m"), F.count("*").alias("n"), F.max("i").alias("last")).first()
    if m["n"] < p + d + q + 5:
        s.unpersist()
        raise ValueError("the series is too short")
    a = _acf(s, max(p, 1))
    ar = np.linalg.solve(np.array([[a[abs(i - j)] for j in range(p)] for i in range(p)]), a[1 : p + 1]) if p else np.zeros(0)
    blocks, w = _blocks(s, p, 0)
    fitted = F.lit(0.0)
    for k in range(p):
        fitted = fitted + float(ar[k]) * (F.lag("y", k + 1).over(w) - m["m"])
    e = blocks.withColumn("y", F.col("y") - m["m"] - fitted).where("mine and y is not null").select("i", "y")
    sig = e.agg((F.sum(F.col("y") * F.col("y")) / F.count("*")).alias("s2"), F.count("*").alias("n")).first()
    ma = _acf(e.withColumn("i", F.col("i") - p), q)[1:] if q else np.zeros(0)
    tail = [r["y"] for r in s.where(F.col("i") > m["last"] - p).orderBy(F.desc("i")).collect()] if p else []  # p values
    s.unpersist()
    next_ = m["m"] + sum(float(c) * (y - m["m"]) for c, y in zip(ar, tail, strict=False))
    k, sd = p + q + 1, float(np.sqrt(sig["s2"]))
    ll = sig["n"] * np.log(max(sig["s2"], 1e-300))
    more = {"n": m["n"], "sigma2": sig["s2"], "aic": ll + 2 * k, "bic": ll + k * np.log(sig["n"]), "forecast": next_, "lo": next_ - 1.96 * sd, "hi": next_ + 1.96 * sd}
    terms = [("mean", m["m"]), *((f"ar{i + 1}", x) for i, x in enumerate(ar)), *((f"ma{i + 1}", x) for i, x in enumerate(ma))]
    return rows(df.sparkSession, [{"term": t, "b": x, **more} for t, x in terms])


def decompose(df: DataFrame, value: str, order: str, period: int, how: str = "additive") -> DataFrame:
    """(i, y, trend, seasonal, remainder, strength): centred moving average of 2 * (period // 2) + 1 terms.

    Seasonal indices are means by i mod period, centred (additive) or scaled to mean 1
    (multiplicative); strength is 1 - var(remainder) / var(detrended), within 0 and 1.
    """
    half = period // 2
    d, w = _blocks(series(df, value, order), half, half)
    span = w.rowsBetween(-half, half)
    d = d.withColumn("trend", F.when(F.count("y").over(span) == 2 * half + 1, F.avg("y").over(span))).where("mine").select("i", "y", "trend")
    add = how == "additive"
    d = d.withColumn("free", F.col("y") - F.col("trend") if add else F.try_divide("y", "trend")).withColumn("s", F.pmod("i", F.lit(period)))
    idx = d.groupBy("s").agg(F.avg("free").alias("x"))
    mean = F.avg("x").over(Window.partitionBy(F.lit(0)))  # one row a season
    idx = idx.select("s", (F.col("x") - mean if add else F.try_divide(F.col("x"), mean)).alias("seasonal"))
    d = d.join(F.broadcast(idx), "s")  # period rows
    d = d.withColumn("remainder", F.col("free") - F.col("seasonal") if add else F.try_divide("free", "seasonal"))
    v = d.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(F.var_samp("remainder"), F.var_samp("free")))).alias("strength"))
    return d.crossJoin(F.broadcast(v)).select("i", "y", "trend", "seasonal", "remainder", "strength")  # one row


