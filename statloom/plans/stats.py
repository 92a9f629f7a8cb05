"""Plans that most procedures share: valid cases, moments, running sums over a total order.

Nothing here gathers rows: moments are one aggregation with partial sums, and everything
that needs an order works on distinct values with their counts, divided over ranges of the
value, each range summed by itself and shifted by the totals of the ranges below.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.special import div, finite
from statloom.plans.shared import cut


#: How a number is written; Spark's own cast also takes a trailing d or f.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parsed(c: Column) -> Column:
    """A string column as doubles; null where a string is no plain number."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; null where it is no finite number."""
    kind = df.schema[name].dataType.typeName()
    c = F.col(f"`{name}`")
    return finite(parsed(c) if kind == "string" else c.cast("double"))


def frequency(df: DataFrame, weight: str) -> Column:
    """A case's frequency weight: max(1, round(w)), null where w is missing or at most 0."""
    w = number(df, weight)
    return F.when(w > 0, F.greatest(F.lit(1.0), F.floor(w + 0.5).cast("double")))


def numbers(df: DataFrame, fields: dict[str, str], keys: dict[str, str] | None = None, listwise: bool = True) -> DataFrame:
    """Only the wanted columns under own names: ``fields`` as doubles, ``keys`` as strings.

    ``listwise`` drops cases that miss any of them; otherwise keys alone must be there.
    """
    keys = keys or {}
    out = df.select(*(number(df, c).alias(k) for k, c in fields.items()), *(F.col(f"`{c}`").cast("string").alias(k) for k, c in keys.items()))
    return out.dropna(subset=[*fields, *keys]) if listwise else out.dropna(subset=[*keys]) if keys else out


def replicate(df: DataFrame, weight: str) -> DataFrame:
    """Frequency weights: each case max(1, round(w)) times, none where w is missing or at most 0.

    Where no weight is usable, ``df`` as it is. Procedures that take ``weight`` need no copies.
    """
    w = number(df, weight)
    if df.where(w > 0).isEmpty():
        return df
    times = F.greatest(F.lit(1), F.floor(w + 0.5).cast("int"))
    return df.where(w > 0).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).drop("__copy")


def moments(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(*by, n, mean, var): one pass; with ``weight`` from the weighted sums, without copies."""
    v = F.col(value)
    if weight is None:
        return df.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
    w = F.when(F.col(weight) > 0, F.greatest(F.lit(1.0), F.floor(F.col(weight) + 0.5).cast("double")))
    d = df.where(v.isNotNull() & w.isNotNull()).withColumn("__w", w)
    s = d.groupBy(*by).agg(F.sum("__w").alias("sw"), F.sum(F.col("__w") * v).alias("s1"), F.sum(F.col("__w") * v * v).alias("s2"))
    mean = F.col("s1") / F.col("sw")
    return s.select(*by, F.col("sw").cast("bigint").alias("n"), mean.alias("mean"), div(F.col("s2") - F.col("sw") * mean * mean, F.col("sw") - 1).alias("var"))


def weighed(df: DataFrame, fields: dict[str, str], keys: dict[str, str] | None, weight: str | None) -> DataFrame:
    """``numbers``, with the frequency weight as column ``w`` (1 where there is no weight); listwise."""
    out = df if weight is None else df.withColumn("__frequency", frequency(df, weight))
    made = numbers(out, fields | ({} if weight is None else {"w": "__frequency"}), keys)
    return made.withColumn("w", F.lit(1.0)) if weight is None else made


@dataclass
class Gram:
    """Number of cases, means and covariances (n - 1) of some columns."""

    names: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def pick(self, names: Iterable[str]) -> Gram:
        at = [self.names.index(x) for x in names]
        return Gram(list(names), self.n, self.mean[at], self.cov[np.ix_(at, at)])

    @property
    def cor(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.cov))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = self.cov / np.outer(d, d)
        np.fill_diagonal(r, 1.0)
        return r


def gram_columns(names: Sequence[str]) -> list[Column]:
    """Aggregates of ``gram``: count, means, and covariances of each pair, in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return [F.count("*").alias("n"), *(F.avg(a).alias(f"m_{a}") for a in names), *(F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs)]


def gram_of(row, names: Sequence[str]) -> Gram:
    k = len(names)
    cov = np.zeros((k, k))
    for i, a in enumerate(names):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = np.nan if row[f"c_{a}_{names[j]}"] is None else row[f"c_{a}_{names[j]}"]
    return Gram(list(names), row["n"], np.array([np.nan if row[f"m_{a}"] is None else row[f"m_{a}"] for a in names]), cov)


def joined(a: Gram, b: Gram) -> Gram:
    """The moments of the cases of both, under the names of ``a``; the columns of ``b`` stand in the same order."""
    if not a.n or not b.n:
        return Gram(a.names, a.n or b.n, a.mean if a.n else b.mean, a.cov if a.n else b.cov)
    n, away = a.n + b.n, b.mean - a.mean
    about = [(g.n - 1) * g.cov if g.n > 1 else np.zeros_like(g.cov) for g in (a, b)]
    return Gram(a.names, n, a.mean + away * b.n / n, (sum(about) + np.outer(away, away) * a.n * b.n / n) / (n - 1))


def gram(df: DataFrame, names: Sequence[str], weight: str | None = None) -> Gram:
    """Means and covariances of complete columns of ``df``: one job, k (k + 3) / 2 numbers.

    With ``weight`` each case counts as often as that column says; sums are taken about the
    plain means, so that little precision is lost.
    """
    if weight is None:
        return gram_of(df.agg(*gram_columns(names)).first(), names)
    at = df.agg(*(F.avg(a).alias(a) for a in names)).first()
    away = {a: F.col(a) - float(at[a] or 0.0) for a in names}
    w, k = F.col(weight), len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = df.agg(F.coalesce(F.sum(w), F.lit(0.0)).alias("n"), *(F.sum(w * away[a]).alias(f"m_{a}") for a in names), *(F.sum(w * away[names[i]] * away[names[j]]).alias(f"c_{i}_{j}") for i, j in pairs)).first()
    n = s["n"]
    if not n:
        return Gram(list(names), 0, np.full(k, np.nan), np.full((k, k), np.nan))
    shift = np.array([s[f"m_{a}"] for a in names]) / n
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (s[f"c_{i}_{j}"] - n * shift[i] * shift[j]) / (n - 1) if n > 1 else np.nan
    return Gram(list(names), int(n), shift + np.array([at[a] for a in names]), cov)


def ranges(df: DataFrame, key: str) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cuts_of(df: DataFrame, key: str, parts: int | None = None) -> list[float]:
    """Approximate quantiles that cut ``key`` into ``parts`` ranges (by default as many as shuffle partitions)."""
    parts = parts or ranges(df, key)
    found = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    return sorted({float(x) for x in found})


def running(df: DataFrame, key: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False, parts: int | None = None, cuts: list[float] | None = None) -> DataFrame:
    """``df`` with cum_<c>: running sums of each of ``sums`` over ascending (or descending) ``key``.

    ``df`` has one row for each key (of each group ``by``). The keys are cut at approximate
    quantiles into ``parts`` ranges (by default as many as shuffle partitions); a range is
    one window, and the totals of the ranges before it are added. ``df`` is written once and
    read for the quantiles, the windows and the totals; with ``cuts`` known it is used as it is.
    """
    if cuts is None:
        df = cut(df, "running")
        cuts = cuts_of(df, key, parts)
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if not cuts:
        inside = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)  # one key or a few
        return df.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in sums})
    split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__key", outputCol="__range")
    ranged = split.transform(df.withColumn("__key", F.col(key).cast("double"))).drop("__key")
    inside = Window.partitionBy(*by, "__range").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    d = ranged.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in sums})
    # totals of the ranges: at most parts rows a group
    before = Window.partitionBy(*by).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    total = ranged.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    total = total.select(*by, "__range", *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums))
    d = d.join(total, [*by, "__range"]).withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"__b_{c}") for c in sums})
    return d.drop("__range", *(f"__b_{c}" for c in sums))


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def counted(d: DataFrame, names: Sequence[str]) -> DataFrame:
    """(*names, c): what every step of a fit reads again. Distinct rows with their counts, written once,
    where a sketch says that they are few; else the pruned scan as it is, without a shuffle."""
    size = d.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*names)).alias("k")).first()
    if size["k"] * 4 > size["n"]:
        return d.select(*names, F.lit(1.0).alias("c"))
    return cut(d.groupBy(*names).agg(F.count("*").cast("double").alias("c")), "counted")


def ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, value, n, rank): each distinct value, its count and average rank."""
    r = running(value_counts(df, value, by), value, ["n"], by)
    return r.withColumn("rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1).cast("double") / 2).drop("cum_n")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, *probs): exact type-7 quantiles from running counts of distinct values."""
    return quantiles_of(cut(value_counts(df, value, by), "counts"), value, probs, by)


def quantiles_of(counts: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``quantiles`` from written ``value_counts``."""
    r = running(counts, value, ["n"], by, cuts=cuts_of(counts, value))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    r = r.join(total, list(by)) if by else r.crossJoin(F.broadcast(total))  # one row
    at = {k: (F.col("total") - 1) * p for k, p in probs.items()}
    low = {f"lo_{k}": F.min(F.when(F.col("cum_n") > F.floor(h), F.col(value))) for k, h in at.items()}
    high = {f"hi_{k}": F.min(F.when(F.col("cum_n") > F.ceil(h), F.col(value))) for k, h in at.items()}
    q = r.groupBy(*by).agg(F.max("total").alias("n"), *(c.alias(k) for k, c in (low | high).items()))
    part = {k: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p) for k, p in probs.items()}
    return q.select(*by, "n", *((F.col(f"lo_{k}") + part[k] * (F.col(f"hi_{k}") - F.col(f"lo_{k}"))).alias(k) for k in probs))


def one_row(spark, **values) -> DataFrame:
    """A table of one row from finished numbers; None and NaN become null doubles."""
    return rows(spark, [values])


def rows(spark, table: Sequence[dict]) -> DataFrame:
    """A small result table; a column's type is that of its first value that is not None."""
    kinds: dict[str, str] = {}
    for r in table:
        for k, v in r.items():
            kind = "boolean" if isinstance(v, bool | np.bool_) else "bigint" if isinstance(v, int | np.integer) else "string" if isinstance(v, str) else "double" if v is not None else None
            if kind and kinds.get(k) != "double":
                kinds[k] = "double" if {kinds.get(k), kind} == {"bigint", "double"} else kind
            else:
                kinds.setdefault(k, None)
    kinds = {k: v or "double" for k, v in kinds.items()}

    def plain(v, kind):
        if v is None or (isinstance(v, float | np.floating) and not np.isfinite(v)):
            return None
        return {"double": float, "bigint": int, "string": str, "boolean": bool}[kind](v)

    data = [tuple(plain(r.get(k), kind) for k, kind in kinds.items()) for r in table]
    return spark.createDataFrame(data, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))
