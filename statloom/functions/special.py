"""Distribution functions as Column expressions, so that p-values stay in the JVM.

They run on finished statistics (one row for each test), never on case rows. All take and
give doubles; null in, null out; undefined arguments give null, also in ANSI mode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Abramowitz and Stegun 7.1.26.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Acklam's rational approximation of the normal quantile.
INV_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
INV_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
INV_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INV_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
TINY = 1e-300


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def div(a, b) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(lit(a).cast("double"), lit(b).cast("double"))


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _bound(inputs: dict[str, Column], body) -> Column:
    """``body`` over bound inputs: each is evaluated once, however often it is used."""
    row = F.struct(*(v.alias(k) for k, v in inputs.items()))
    return F.get(F.transform(F.array(row), lambda r: body(**{k: r[k] for k in inputs})), F.lit(0))


def _named(inputs: dict[str, Column], body) -> Column:
    return _bound({k: v.cast("double") for k, v in inputs.items()}, body)


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    y = 1 - _horner(ERF_A[::-1], t) * t * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def norm_cdf(x) -> Column:
    """Standard normal distribution function, absolute error 1.5e-7."""
    return _named({"x": lit(x)}, lambda x: (1 + erf(x / math.sqrt(2))) / 2)


def z_p(z) -> Column:
    """Two-sided normal p-value."""
    return 2 * (1 - norm_cdf(F.abs(lit(z))))


def norm_inv(p) -> Column:
    """Standard normal quantile; null outside (0, 1)."""

    def body(p: Column) -> Column:
        tail = lambda q: _horner(INV_C, q) / (_horner(INV_D, q) * q + 1)
        q = p - 0.5
        mid = _horner(INV_A, q * q) * q / (_horner(INV_B, q * q) * q * q + 1)
        low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
        return F.when((p > 0) & (p < 0.02425), tail(low)).when((p > 0.97575) & (p < 1), -tail(high)).when((p > 0) & (p < 1), mid)

    return _named({"p": lit(p)}, body)


def lgamma(x) -> Column:
    """Logarithm of the gamma function for positive arguments."""

    def body(x: Column) -> Column:
        y = F.when(x < 0.5, 1 - x).otherwise(x) - 1
        s = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:], 1):
            s = s + c / (y + i)
        t = y + 7.5
        g = 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(s)
        return F.when(x <= 0, F.lit(None)).when(x < 0.5, math.log(math.pi) - F.log(F.sin(math.pi * x)) - g).otherwise(g)

    return _named({"x": lit(x)}, body)


def digamma(x) -> Column:
    """Derivative of ``lgamma`` for positive arguments: its asymptotic series ten steps up, and the steps down."""

    def body(x: Column) -> Column:
        y = x + 10
        q = 1 / (y * y)
        series = q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132))))
        return F.when(x > 0, F.log(y) - 0.5 / y - series - _steps(x, lambda t: 1 / t))

    return _named({"x": lit(x)}, body)


def trigamma(x) -> Column:
    """Derivative of ``digamma`` for positive arguments."""

    def body(x: Column) -> Column:
        y = x + 10
        q = 1 / (y * y)
        series = (1 + q * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q * (1 / 30 - q * 5 / 66))))) / y
        return F.when(x > 0, series + 0.5 * q + _steps(x, lambda t: 1 / (t * t)))

    return _named({"x": lit(x)}, body)


def _steps(x: Column, term) -> Column:
    total = term(x)
    for i in range(1, 10):
        total = total + term(x + i)
    return total


def _fraction(terms: int, first: tuple[Column, Column], numerator, denominator) -> Column:
    """Lentz's continued fraction with partial numerators and denominators of step i = 1, 2, ...

    Adding ``TINY`` changes nothing but an exact zero.
    """

    def step(acc: Column, i: Column) -> Column:
        def moved(num: Column, den: Column) -> Column:
            return _bound({"d": 1 / (den + num * acc["d"] + TINY), "c": den + num / acc["c"] + TINY}, lambda d, c: F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"), (F.abs(d * c - 1) <= 1e-15).alias("done")))

        return F.when(acc["done"], acc).otherwise(_bound({"num": numerator(i), "den": denominator(i)}, moved))

    c, d = first
    start = F.struct(c.alias("c"), d.alias("d"), d.alias("h"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1.0).cast("int"), F.lit(terms)), start, lambda acc, i: step(acc, i.cast("double")), lambda a: a["h"])


def beta_inc(x, a, b) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""

    def series(x: Column, a: Column, b: Column) -> Column:
        front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log(1 - x)) / a

        def numerator(i: Column) -> Column:
            m = F.floor(i / 2)
            return F.when(i % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

        start = 1 / (1 - (a + b) * x / (a + 1) + TINY)
        return front * _fraction(600, (F.lit(1.0), start), lambda i: numerator(i + 1), lambda _: F.lit(1.0))

    def body(x: Column, a: Column, b: Column) -> Column:
        flip = x > (a + 1) / (a + b + 2)
        own = _named({"x": F.when(flip, 1 - x).otherwise(x), "a": F.when(flip, b).otherwise(a), "b": F.when(flip, a).otherwise(b)}, series)
        return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when((a > 0) & (b > 0), F.when(flip, 1 - own).otherwise(own))

    return _named({"x": lit(x), "a": lit(a), "b": lit(b)}, body)


def gamma_p(a, x) -> Column:
    """Regularised lower incomplete gamma function P(a, x)."""

    def body(a: Column, x: Column) -> Column:
        front = F.exp(a * F.log(x) - x - lgamma(a))
        start = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
        grow = lambda acc, n: F.struct((acc["t"] * x / (a + n)).alias("t"), (acc["s"] + acc["t"] * x / (a + n)).alias("s"))
        terms = F.least(F.lit(20_000), F.greatest(F.lit(200), F.ceil(12 * F.sqrt(a) + 60)).cast("int"))
        low = F.aggregate(F.sequence(F.lit(1), terms), start, grow, lambda s: s["s"])
        first = 1 / (x + 1 - a)
        high = _fraction(400, (F.lit(1 / TINY), first), lambda m: -m * (m - a), lambda m: x + 2 * m + 1 - a)
        return F.when(x <= 0, F.lit(0.0)).when(a <= 0, F.lit(None)).when(x < a + 1, front * low).otherwise(1 - front * high)

    return _named({"a": lit(a), "x": lit(x)}, body)


def t_p(t, df) -> Column:
    """Two-sided p-value of Student's t."""
    return _named({"t": lit(t), "v": lit(df)}, lambda t, v: F.when(v > 0, beta_inc(v / (v + t * t), v / 2, F.lit(0.5))))


def t_cdf(t, df) -> Column:
    return _named({"t": lit(t), "p": t_p(t, df)}, lambda t, p: F.when(t > 0, 1 - p / 2).otherwise(p / 2))


def f_p(f, d1, d2) -> Column:
    """Upper tail of F."""
    body = lambda f, a, b: F.when((a > 0) & (b > 0), F.when(f <= 0, F.lit(1.0)).otherwise(beta_inc(b / (b + a * f), b / 2, a / 2)))
    return _named({"f": lit(f), "a": lit(d1), "b": lit(d2)}, body)


def chi2_p(x, df) -> Column:
    """Upper tail of chi-squared."""
    return _named({"x": lit(x), "v": lit(df)}, lambda x, v: F.when(v > 0, 1 - gamma_p(v / 2, x / 2)))


def bisect(upper_tail, alpha, low, high, rounds: int = 80) -> Column:
    """x between ``low`` and ``high`` where a falling ``upper_tail(x)`` equals ``alpha``."""

    def body(alpha: Column, low: Column, high: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            above = upper_tail(mid) > alpha
            return F.struct(F.when(above, mid).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(low.alias("lo"), high.alias("hi")), step, lambda a: (a["lo"] + a["hi"]) / 2)

    return _named({"alpha": lit(alpha), "low": lit(low), "high": lit(high)}, body)


def t_inv(p_two_sided, df) -> Column:
    """t with the given two-sided p-value: the critical value, by Newton's steps from the normal one (the p-value is convex)."""

    def body(p: Column, v: Column, logc: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            t = acc["t"]
            slope = 2 * F.exp(logc - (v + 1) / 2 * F.log1p(t * t / v))
            moved = lambda by: F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1e4), t + by)).alias("t"), (F.abs(by) <= 1e-13 * (1 + t)).alias("done"))
            return F.when(acc["done"], acc).otherwise(_bound({"by": (t_p(t, v) - p) / slope}, moved))

        start = F.struct(F.coalesce(norm_inv(1 - p / 2), F.lit(0.0)).alias("t"), F.lit(False).alias("done"))
        return F.when((v > 0) & p.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda a: a["t"]))

    v = lit(df).cast("double")
    return _named({"p": lit(p_two_sided), "v": v, "logc": lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * F.log(v * math.pi)}, body)


def f_inv(p_upper, d1, d2) -> Column:
    return _named({"p": lit(p_upper), "a": lit(d1), "b": lit(d2)}, lambda p, a, b: bisect(lambda f: f_p(f, a, b), p, 0.0, 1e5, 60))


def chi2_inv(p_upper, df) -> Column:
    return _named({"p": lit(p_upper), "v": lit(df)}, lambda p, v: bisect(lambda x: chi2_p(x, v), p, 0.0, v + 60 * F.sqrt(2 * v) + 60, 60))


def simpson(f, low: Column, high: Column, n: int = 200) -> Column:
    """Integral of ``f`` by Simpson's rule with ``n`` (even) steps."""

    def body(low: Column, high: Column) -> Column:
        h = (high - low) / n
        weight = lambda i: F.when((i == 0) | (i == n), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return h / 3 * F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), lambda acc, i: acc + weight(i) * f(low + h * i))

    return _named({"low": lit(low), "high": lit(high)}, body)


def _scale_density(s: Column, v: Column, logc: Column) -> Column:
    """Density of sqrt(chi-squared(v) / v) at s; ``logc`` is its constant."""
    return F.when(s <= 0, F.lit(0.0)).otherwise(F.exp(logc + (v - 1) * F.log(s) - v * s * s / 2))


def _over_scale(v: Column, f, n: int) -> Column:
    """Mean of f(s) over s = sqrt(chi-squared(v) / v)."""
    width = 8 / F.sqrt(2 * v)
    logc = math.log(2) + v / 2 * F.log(v / 2) - lgamma(v / 2)
    return _named({"v": v, "logc": logc}, lambda v, logc: simpson(lambda s: _scale_density(s, v, logc) * f(s), F.greatest(F.lit(0.0), 1 - width), 1 + width, n))


def nct_sf(t, df, delta) -> Column:
    """Upper tail of the non-central t."""
    return _named({"t": lit(t), "v": lit(df), "d": lit(delta)}, lambda t, v, d: _over_scale(v, lambda s: 1 - norm_cdf(t * s - d), 240))


def nct_density(t, df, delta) -> Column:
    """Density of the non-central t."""
    return _named({"t": lit(t), "v": lit(df), "d": lit(delta)}, lambda t, v, d: _over_scale(v, lambda s: s * F.exp(-(t * s - d) * (t * s - d) / 2) / math.sqrt(2 * math.pi), 240))


def _poisson_mixture(lam: Column, cdf) -> Column:
    """Sum over j of the Poisson(lam / 2) weights times ``cdf(j)``; covers 12 deviations."""

    def body(m: Column) -> Column:
        reach = 12 * F.sqrt(m) + 12
        low, high = F.greatest(F.lit(0), F.floor(m - reach)).cast("int"), F.ceil(m + reach).cast("int")
        weight = lambda j: F.when(m > 0, F.exp(j * F.log(m) - m - lgamma(j + 1))).otherwise(F.when(j == 0, 1.0).otherwise(0.0))
        return F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, j: acc + weight(j.cast("double")) * cdf(j.cast("double")))

    return _named({"m": lam / 2}, body)


def ncf_sf(f, d1, d2, lam) -> Column:
    """Upper tail of the non-central F."""

    def body(f: Column, a: Column, b: Column, lam: Column) -> Column:
        return 1 - _poisson_mixture(lam, lambda j: beta_inc(a * f / (a * f + b), a / 2 + j, b / 2))

    return _named({"f": lit(f), "a": lit(d1), "b": lit(d2), "lam": lit(lam)}, body)


def ncchi2_sf(x, df, lam) -> Column:
    """Upper tail of the non-central chi-squared."""
    return _named({"x": lit(x), "v": lit(df), "lam": lit(lam)}, lambda x, v, lam: 1 - _poisson_mixture(lam, lambda j: gamma_p(v / 2 + j, x / 2)))


def tukey_p(q, k, df) -> Column:
    """Upper tail of the studentised range of k groups (two nested Simpson integrals)."""

    def inner(w: Column, k: Column) -> Column:
        density = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return k * simpson(lambda z: density(z) * F.pow(F.greatest(F.lit(0.0), norm_cdf(z) - norm_cdf(z - w)), k - 1), F.lit(-8.0), F.lit(8.0), 120)

    def body(q: Column, k: Column, v: Column) -> Column:
        return F.when((k >= 2) & (v > 0), F.greatest(F.lit(0.0), 1 - _over_scale(v, lambda s: _named({"w": q * s}, lambda w: inner(w, k)), 32)))

    return _named({"q": lit(q), "k": lit(k), "v": lit(df)}, body)
