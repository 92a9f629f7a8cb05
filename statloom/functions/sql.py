"""SQL text for checks: tail probabilities by numerical integration of densities.

An independent route from the continued fractions of ``special``. ``lgamma`` is the SQL
engine's own.
"""

from __future__ import annotations

from statloom.functions.special import ERF_A, ERF_P


def norm_cdf(x: str) -> str:
    t = f"(1.0/(1.0+{ERF_P}*abs(({x})/sqrt(2.0))))"
    poly = f"({ERF_A[0]}+{t}*({ERF_A[1]}+{t}*({ERF_A[2]}+{t}*({ERF_A[3]}+{t}*{ERF_A[4]}))))*{t}"
    tail = f"({poly}*exp(-({x})*({x})/2.0))"
    return f"(CASE WHEN ({x})<0 THEN {tail}/2.0 ELSE 1.0-{tail}/2.0 END)"


def z_p(z: str) -> str:
    return f"(2*(1-{norm_cdf(f'abs({z})')}))"


def _simpson(density: str, high: str, n: int = 4000) -> str:
    """Integral of ``density`` (in y) from 0 to ``high``."""
    weight = f"(CASE WHEN i=0 OR i={n} THEN 1.0 WHEN i%2=1 THEN 4.0 ELSE 2.0 END)"
    point = density.replace("{y}", f"(({high})*i/{n}.0)")
    return f"(({high})/{3 * n}.0*list_sum(list_transform(range({n + 1}), lambda i: {weight}*{point})))"


def t_p(t: str, v: str) -> str:
    logc = f"(lgamma((({v})+1)/2.0)-lgamma(({v})/2.0)-0.5*ln(({v})*pi()))"
    d = f"exp({logc}-(({v})+1)/2.0*ln(1+{{y}}*{{y}}/({v})))"
    return f"greatest(0.0, 1-2*{_simpson(d, f'least(abs({t}),60.0)')})"


def f_p(f: str, a: str, b: str) -> str:
    """With x = y * y the density has no pole at 0."""
    logc = f"(lgamma((({a})+({b}))/2.0)-lgamma(({a})/2.0)-lgamma(({b})/2.0)+({a})/2.0*ln(({a})*1.0/({b})))"
    d = f"(CASE WHEN {{y}}=0 THEN (CASE WHEN ({a})=1 THEN 2*exp({logc}) ELSE 0.0 END) ELSE 2*exp({logc}+(({a})-1)*ln({{y}})-(({a})+({b}))/2.0*ln(1+({a})*{{y}}*{{y}}/({b}))) END)"
    return f"greatest(0.0, 1-{_simpson(d, f'least(sqrt({f}),60.0)')})"


def chi2_p(x: str, v: str) -> str:
    logc = f"(-({v})/2.0*ln(2.0)-lgamma(({v})/2.0))"
    d = f"(CASE WHEN {{y}}=0 THEN (CASE WHEN ({v})=1 THEN 2*exp({logc}) ELSE 0.0 END) ELSE 2*exp({logc}+(({v})-1)*ln({{y}})-{{y}}*{{y}}/2.0) END)"
    return f"greatest(0.0, 1-{_simpson(d, f'least(sqrt({x}),60.0)')})"


def norm_inv(p: str) -> str:
    from statloom.functions.special import INV_A, INV_B, INV_C, INV_D

    def horner(c, x: str) -> str:
        out = f"{c[0]}"
        for v in c[1:]:
            out = f"({out}*{x}+({v}))"
        return out

    low, high, q = f"sqrt(-2*ln({p}))", f"sqrt(-2*ln(1-({p})))", f"(({p})-0.5)"
    tail = lambda x: f"({horner(INV_C, x)}/({horner(INV_D, x)}*{x}+1))"
    mid = f"({horner(INV_A, f'({q}*{q})')}*{q}/({horner(INV_B, f'({q}*{q})')}*{q}*{q}+1))"
    return f"(CASE WHEN ({p})<0.02425 THEN {tail(low)} WHEN ({p})>0.97575 THEN -{tail(high)} ELSE {mid} END)"


def t_inv(v: str) -> str:
    """Two-sided 5 % point of t for a hundred degrees of freedom or more, by its expansion about the normal's."""
    z = 1.959963984540054
    terms = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return "(" + " + ".join(f"{c!r}/power({v}, {i})" for i, c in enumerate(terms)) + ")"


def det(m: list[list[str]]) -> str:
    """Determinant of a small matrix of SQL expressions."""
    if len(m) == 1:
        return m[0][0]
    minor = lambda j: det([[x for c, x in enumerate(r) if c != j] for r in m[1:]])
    return "(" + " ".join(f"{'+' if j % 2 == 0 else '-'}({m[0][j]})*({minor(j)})" for j in range(len(m))) + ")"


def inverse(m: list[list[str]]) -> list[list[str]]:
    """Inverse of a small symmetric matrix of SQL expressions, by cofactors."""
    k, d = len(m), det(m)
    if k == 1:
        return [[f"(1.0/({m[0][0]}))"]]
    cof = lambda i, j: det([[x for c, x in enumerate(r) if c != j] for a, r in enumerate(m) if a != i])
    return [[f"({'' if (i + j) % 2 == 0 else '-'}({cof(i, j)})/{d})" for j in range(k)] for i in range(k)]


def ols(source: str, xs: list[str], tag: str = "") -> str:
    """CTEs s, i and o (with ``tag``): o has n, k, my, sst, ssr, sse, mse, m<i>, b0.. and v<i>_<j> of y on ``xs`` in ``source``."""
    k, t = len(xs), tag
    cov = [f"covar_samp({xs[i]}, {xs[j]})*(count(*)-1) AS s{i}_{j}" for i in range(k) for j in range(i, k)]
    at = lambda i, j: f"s{min(i, j)}_{max(i, j)}"
    inv = inverse([[at(i, j) for j in range(k)] for i in range(k)])
    v = [f"{inv[i][j]} AS w{i}_{j}" for i in range(k) for j in range(i, k)]
    w = lambda i, j: f"w{min(i, j)}_{max(i, j)}"
    b = [f"({' + '.join(f'{w(i, j)}*y{j}' for j in range(k))})" for i in range(k)]
    first = " + ".join(f"m{i}*m{j}*{w(i, j)}" for i in range(k) for j in range(k))
    cross = [f"-({' + '.join(f'm{j}*{w(i, j)}' for j in range(k))}) AS v0_{i + 1}" for i in range(k)]
    rest = [f"{w(i, j)} AS v{i + 1}_{j + 1}" for i in range(k) for j in range(i, k)]
    return f"""s{t} AS (SELECT count(*) AS n, avg(y) AS my, var_samp(y)*(count(*)-1) AS sst, {", ".join(f"avg({x}) AS m{i}, covar_samp({x}, y)*(count(*)-1) AS y{i}" for i, x in enumerate(xs))}, {", ".join(cov)} FROM {source}),
    i{t} AS (SELECT *, {", ".join(v)} FROM s{t}), b{t} AS (SELECT *, {", ".join(f"{x} AS b{i + 1}" for i, x in enumerate(b))} FROM i{t}),
    r{t} AS (SELECT *, my - {" - ".join(f"b{i + 1}*m{i}" for i in range(k))} AS b0, {" + ".join(f"b{i + 1}*y{i}" for i in range(k))} AS ssr FROM b{t}),
    o{t} AS (SELECT *, {k} AS k, sst - ssr AS sse, (sst - ssr)/(n - {k + 1}) AS mse, 1.0/n + {first} AS v0_0, {", ".join(cross)}, {", ".join(rest)} FROM r{t})"""
