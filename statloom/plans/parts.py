"""Further registered queries, and SQL for procedures whose closed form needs small matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import sql as Q
from statloom.operators import association as A
from statloom.operators import descriptive as D
from statloom.operators import means as M
from statloom.operators import multivariate as V
from statloom.operators import regression as R
from statloom.operators import survival as U
from statloom.plans.queries import _E8, _dims, _lives, _priced, _scored, _sql, query

_LINES = "(SELECT l_extendedprice/1000 AS y, l_quantity AS a, l_discount*100 AS b, l_tax AS c, l_orderkey*8+l_linenumber AS pos FROM lineitem)"


def _terms(names: list[str], select: str, doubles: str) -> str:
    """One row a coefficient from the CTE o; ``select`` may use b, v (its scaled variance) and o's columns."""
    each = " UNION ALL ".join(f"SELECT '{t}' AS term, b{i} AS b, v{i}_{i} AS v, * EXCLUDE (b) FROM (SELECT *, 0 AS b FROM o)" for i, t in enumerate(names))
    return f"SELECT term, {select} FROM ({each}) AS e", doubles


# ---- intervals ----------------------------------------------------------------------------

_SUM = """SELECT count(v) AS n, count(*) - count(v) AS missing, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std, var_samp(v) AS variance, stddev_samp(v)/sqrt(count(v)) AS sem, min(v) AS min, max(v) AS max,
max(v)-min(v) AS range, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.75)-quantile_cont(v, 0.25) AS iqr, skewness(v) AS skewness, kurtosis(v) AS kurtosis FROM d"""


def _describe(source: str, name: str) -> str:
    """``source`` gives v, with nulls."""
    top = "(SELECT CASE WHEN (SELECT max(k) FROM f) <= 1 THEN 'None' ELSE (SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT v FROM f WHERE k = (SELECT max(k) FROM f) ORDER BY v LIMIT 3)) END)"
    out = "(SELECT count(*) FROM d, s WHERE v < q1 - 1.5*iqr OR v > q3 + 1.5*iqr)"
    return _sql(
        f"WITH d AS ({source}), f AS (SELECT v, count(*) AS k FROM d WHERE v IS NOT NULL GROUP BY v), s AS ({_SUM}) SELECT '{name}' AS variable, *, {top} AS mode, {out} AS outlier_count, mean - {Q.t_inv('(n-1)')}*sem AS ci_lo, mean + {Q.t_inv('(n-1)')}*sem AS ci_hi FROM s",
        "mean, median, std, variance, sem, min, max, range, q1, q3, iqr, skewness, kurtosis, ci_lo, ci_hi",
        "variable, n, missing, mode, outlier_count",
    )


query("describe_intervals", _describe("SELECT p_retailprice AS v FROM part", "p_retailprice"))(lambda t: D.describe(t("part"), "p_retailprice"))
query("describe_holes", _describe("SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders", "v"))(lambda t: D.describe(t("orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v")), "v"))
_ONE = f"s AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM d), r AS (SELECT *, sd/sqrt(n) AS se, mean-mu AS diff, (mean-mu)/(sd/sqrt(n)) AS t, n-1 AS df FROM s, m) SELECT *, {Q.t_p('t', 'df')} AS p, abs(diff/sd) AS cohens_d, diff - {Q.t_inv('df')}*se AS ci_lo, diff + {Q.t_inv('df')}*se AS ci_hi FROM r"
_ONE_DOUBLES = "mean, sd, se, diff, t, p, cohens_d, ci_lo, ci_hi"
query("ttest_one_sample_interval", _sql(f"WITH d AS (SELECT l_quantity AS v FROM lineitem), m AS (SELECT 25.5 AS mu), {_ONE}", _ONE_DOUBLES, "n, df"))(lambda t: M.ttest_one_sample(t("lineitem"), "l_quantity", 25.5))
query("ttest_paired_interval", _sql(f"WITH d AS (SELECT (l_discount - l_tax)*100 AS v FROM lineitem), m AS (SELECT 0.0 AS mu), {_ONE}", _ONE_DOUBLES, "n, df"))(
    lambda t: M.ttest_paired(t("lineitem").select((F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b")), "a", "b")
)
query(
    "partial_correlation_interval",
    _sql(f"WITH s AS (SELECT count(*) AS n, corr(l_quantity, l_discount) AS x, corr(l_quantity, l_tax) AS y, corr(l_discount, l_tax) AS z FROM lineitem), u AS (SELECT n, (x-y*z)/sqrt((1-y*y)*(1-z*z)) AS rp FROM s), h AS (SELECT *, {Q.t_inv('(n-3)')}/sqrt(n-4) AS h, 0.5*ln((1+rp)/(1-rp)) AS f FROM u) SELECT n, rp, (exp(2*(f-h))-1)/(exp(2*(f-h))+1) AS ci_lo, (exp(2*(f+h))-1)/(exp(2*(f+h))+1) AS ci_hi FROM h", "rp, ci_lo, ci_hi", "n"),
)(lambda t: A.partial(t("lineitem"), "l_quantity", "l_discount", "l_tax").select("n", "rp", "ci_lo", "ci_hi"))
_KS = f"""WITH s AS (SELECT avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS sd, count(*) AS t FROM supplier), c AS (SELECT s_acctbal AS v, count(*) AS k FROM supplier GROUP BY 1), r AS (SELECT v, k, sum(k) OVER (ORDER BY v) AS cum FROM c),
f AS (SELECT *, {Q.norm_cdf("((v-m)/sd)")} AS f FROM r, s), d AS (SELECT CAST(max(t) AS BIGINT) AS n, max(greatest(abs(cum/t - f), abs((cum-k)/t - f))) AS d FROM f)
SELECT n, d, greatest(0.001, least(1.0, CASE WHEN n*d*d < 0.04 THEN 1.0 ELSE 2*list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END)*exp(-2.0*j*j*n*d*d))) END)) AS p FROM d"""
query("ks_normal_small", _sql(_KS, "d, p", "n"))(lambda t: D.ks_normal(t("supplier"), "s_acctbal"))

# ---- weights: the same sums over a table of copies -----------------------------------------

_COPIES = "(SELECT l.*, unnest(range(l_linenumber)) AS copy FROM lineitem l)"
_GROUPED = f"""g AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS var FROM d GROUP BY g), a AS (SELECT sum(n*m)/sum(n) AS grand FROM g), s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n*power(m-grand, 2)) AS ss_b, sum((n-1)*var) AS ss_w FROM g, a),
f AS (SELECT *, k-1 AS df_b, n-k AS df_w, ss_b/(k-1) AS ms_b, ss_w/(n-k) AS ms_w, (ss_b/(k-1))/(ss_w/(n-k)) AS f FROM s), e AS (SELECT *, {Q.f_p("f", "df_b", "df_w")} AS p, ss_b/(ss_b+ss_w) AS eta2, greatest(0.0, (ss_b-df_b*ms_w)/(ss_b+ss_w+ms_w)) AS omega2 FROM f)"""
_ANOVA_D, _ANOVA_R = "ss_b, ss_w, ms_b, ms_w, f, p, eta2, omega2", "k, n, df_b, df_w"
query("anova_weighted", _sql(f"WITH d AS (SELECT l_quantity AS v, l_returnflag AS g FROM {_COPIES}), {_GROUPED} SELECT * FROM e", _ANOVA_D, _ANOVA_R))(lambda t: M.anova_oneway(t("lineitem"), "l_quantity", "l_returnflag", weight="l_linenumber"))
query(
    "anova_eta2_interval",
    _sql(f"WITH d AS (SELECT o_totalprice AS v, o_orderstatus AS g FROM orders), {_GROUPED} SELECT *, CASE WHEN f > 0 THEN greatest(0, f-1.96)*df_b/(greatest(0, f-1.96)*df_b+df_b+df_w+1) END AS eta2_lo, CASE WHEN f > 0 THEN (f+1.96)*df_b/((f+1.96)*df_b+df_b+df_w+1) END AS eta2_hi FROM e", "f, eta2, eta2_lo, eta2_hi", "k, n"),
)(lambda t: M.eta2_interval(M.anova_oneway(t("orders"), "o_totalprice", "o_orderstatus")).select("k", "n", "f", "eta2", "eta2_lo", "eta2_hi"))
query("group_table_weighted", _sql(f"SELECT l_returnflag AS grp, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, stddev_samp(l_quantity)/sqrt(count(*)) AS se FROM {_COPIES} GROUP BY 1", "mean, sd, se", "grp, n"))(lambda t: M.group_table(t("lineitem"), "l_quantity", "l_returnflag", weight="l_linenumber"))
query("ttest_one_sample_weighted", _sql(f"WITH d AS (SELECT l_quantity AS v FROM {_COPIES}), m AS (SELECT 25.5 AS mu), {_ONE}", _ONE_DOUBLES, "n, df"))(lambda t: M.ttest_one_sample(t("lineitem"), "l_quantity", 25.5, weight="l_linenumber"))
query(
    "pearson_weighted",
    _sql(f"SELECT 'l_quantity' AS x, 'l_discount' AS y, count(*) AS n, corr(l_quantity, l_discount) AS r FROM {_COPIES}", "r", "x, y, n"),
)(lambda t: A.pearson(t("lineitem"), "l_quantity", "l_discount", weight="l_linenumber").select("x", "y", "n", "r"))
_TAB = """WITH c AS (SELECT {r} AS r, {k} AS k, sum({w})::DOUBLE AS n FROM {t} GROUP BY 1, 2), rt AS (SELECT r, sum(n) AS rt FROM c GROUP BY 1), ct AS (SELECT k, sum(n) AS ct FROM c GROUP BY 1), z AS (SELECT sum(n) AS t, (SELECT count(*) FROM rt) AS nr, (SELECT count(*) FROM ct) AS nk FROM c),
g AS (SELECT coalesce(c.n, 0) AS n, rt*ct/t AS e FROM rt CROSS JOIN ct CROSS JOIN z LEFT JOIN c ON c.r = rt.r AND c.k = ct.k), s AS (SELECT sum(power(n-e, 2)/e) AS chi2, count(*) FILTER (e < 5) AS low_cells FROM g)
SELECT chi2, CAST((nr-1)*(nk-1) AS BIGINT) AS df, {p} AS p, sqrt(chi2/(t*(least(nr, nk)-1))) AS cramers_v, CAST(t AS BIGINT) AS n, low_cells FROM s, z"""
_CHI = lambda **k: _sql(_TAB.format(p=Q.chi2_p("chi2", "((nr-1)*(nk-1))"), **k), "chi2, p, cramers_v", "df, n, low_cells")
query("chi_square_weighted", _CHI(r="l_returnflag", k="l_linestatus", w="l_linenumber", t="lineitem"))(lambda t: D.chi_square(t("lineitem"), "l_returnflag", "l_linestatus", weight="l_linenumber"))
query("chi_square_sparse", _CHI(r="c_nationkey", k="c_mktsegment", w="1", t="customer"))(lambda t: D.chi_square(t("customer"), "c_nationkey", "c_mktsegment"))

# ---- cells, follow-ups, categories ---------------------------------------------------------

query("cell_means", _sql("SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, stddev_samp(l_quantity)/sqrt(count(*)) AS se FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "mean, sd, se", "l_returnflag, l_linestatus, n"))(lambda t: M.cell_means(t("lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]))
query(
    "manova_followups",
    " UNION ALL ".join(_sql(f"WITH d AS (SELECT {v} AS v, l_returnflag AS g FROM lineitem), {_GROUPED} SELECT '{v}' AS variable, * FROM e", _ANOVA_D, f"variable, {_ANOVA_R}") for v in ("l_quantity", "l_discount", "l_tax")),
)(lambda t: M.manova_followups(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag"))
query(
    "kappa_categories",
    _sql("WITH c AS (SELECT DISTINCT CAST(l_returnflag AS VARCHAR) AS category FROM lineitem UNION SELECT DISTINCT CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'A' END FROM lineitem), p AS (SELECT l_returnflag AS a, CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'A' END AS b FROM lineitem), s AS (SELECT category, (SELECT count(*) FROM p WHERE a = category) AS n, (SELECT count(*) FROM p WHERE a = category AND b = category) AS tp, (SELECT count(*) FROM p WHERE b = category) AS nb FROM c) SELECT category, n, tp, nb - tp AS fp, n - tp AS fn, CASE WHEN nb > 0 THEN tp*1.0/nb ELSE 0 END AS precision, CASE WHEN n > 0 THEN tp*1.0/n ELSE 0 END AS recall FROM s", "precision, recall", "category, n, tp, fp, fn"),
)(lambda t: A.kappa_categories(t("lineitem").withColumn("b", F.when(F.col("l_linestatus") == "O", "N").otherwise("A")), "l_returnflag", "b"))
_KAPPA = """WITH p AS (SELECT l_linenumber AS a, 1 + l_orderkey % 5 AS b FROM lineitem), c AS (SELECT unnest(range(1, 8)) AS x), m AS (SELECT x, (SELECT count(*) FROM p WHERE a = x)::DOUBLE AS ka, (SELECT count(*) FROM p WHERE b = x)::DOUBLE AS kb FROM c), s AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po, avg(abs(a-b))/6 AS wo FROM p),
e AS (SELECT sum(CASE WHEN u.x = v.x THEN u.ka*v.kb ELSE 0 END) AS pe, sum(u.ka*v.kb*abs(u.x-v.x))/6 AS we FROM m u, m v) SELECT CAST(n AS BIGINT) AS n, po, pe/n/n AS pe, (po-pe/n/n)/(1-pe/n/n) AS kappa, 1-wo/(we/n/n) AS w_kappa FROM s, e"""
query("kappa_weighted_levels", _sql(_KAPPA, "po, pe, kappa, w_kappa", "n"))(lambda t: A.cohen_kappa(t("lineitem").withColumn("b", 1 + F.col("l_orderkey") % 5), "l_linenumber", "b").select("n", "po", "pe", "kappa", "w_kappa"))
query(
    "concordance",
    _sql("WITH c AS (SELECT l_quantity AS t, l_discount*100 - l_linenumber AS r, count(*) FILTER (l_returnflag='R') AS d, count(*) AS m FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(CASE WHEN i.r > j.r + 1e-9 THEN i.d*j.m ELSE 0 END) AS concordant, sum(i.d*j.m) AS comparable FROM c i, c j WHERE i.t < j.t) SELECT concordant*1.0/comparable AS c, CAST(concordant AS BIGINT) AS concordant, CAST(comparable AS BIGINT) AS comparable FROM s", "c", "concordant, comparable"),
)(lambda t: U.concordance(_lives(t).withColumn("r", F.round(F.col("disc") - F.col("l_linenumber"))), "l_quantity", "ev", "r"))
query("cox_concordance")(lambda t: U.cox_concordance(_lives(t), "l_quantity", "ev", ["disc", "l_linenumber"]))
query("canonical_weights")(lambda t: A.canonical_weights(t("lineitem"), ["l_quantity", "l_discount"], ["l_tax", "l_extendedprice"]))
query("multinomial_classification")(lambda t: R.multinomial_classification(t("lineitem"), "l_returnflag", ["l_quantity"]))
query("kmeans_assign")(lambda t: V.kmeans_assign(_dims(t), _E8[:4], 4).select("vec_id", "cluster"))
query("cluster_anova")(lambda t: V.cluster_anova(V.kmeans_assign(_dims(t), _E8[:4], 4), _E8[:4]))
query("hierarchical_clusters")(lambda t: V.hierarchical_clusters(_dims(t), _E8[:4], "vec_id", 3, linkage="ward"))
query("cluster_anova_labels", " UNION ALL ".join(_sql(f"WITH d AS (SELECT embedding[{i + 1}]::DOUBLE AS v, CAST(label AS VARCHAR) AS g FROM embeddings), {_GROUPED} SELECT 'e{i}' AS variable, * FROM e", _ANOVA_D, f"variable, {_ANOVA_R}") for i in range(2)))(lambda t: V.cluster_anova(_dims(t), ["e0", "e1"], "label"))

# ---- regression ---------------------------------------------------------------------------

_TWO = f"WITH {Q.ols(_LINES, ['a', 'b'])}"
_LEV = "least(0.999, v0_0 + 2*a*v0_1 + 2*b*v0_2 + a*a*v1_1 + 2*a*b*v1_2 + b*b*v2_2)"
_ROWS = f"{_TWO}, q AS (SELECT pos, a, b, y - b0 - b1*a - b2*b AS e, {_LEV} AS h, n, mse FROM (SELECT d.y, d.a, d.b, d.pos, o.n, o.mse, o.b0, o.b1, o.b2, v0_0, v0_1, v0_2, v1_1, v1_2, v2_2 FROM {_LINES} d, o))"
query(
    "linear_diagnostics",
    _sql(
        f"""{_ROWS}, u AS (SELECT *, abs(e/sqrt(mse*(1-h))) AS st, e*e*h/(3*mse*(1-h)*(1-h)) AS cook, e - lag(e) OVER (ORDER BY pos, e) AS step FROM q),
        z AS (SELECT sum(step*step)/sum(e*e) AS dw, max(cook) AS cooks_max, count(*) FILTER (cook > 4.0/n) AS high_cooks, count(*) FILTER (h > 6.0/n) AS high_lev, count(*) FILTER (st > 2) AS out2, count(*) FILTER (st > 3) AS out3,
        avg(power(e, 3))/power(avg(e*e), 1.5) AS res_skew, avg(power(e, 4))/power(avg(e*e), 2) - 3 AS res_kurt FROM u),
        {Q.ols("(SELECT e*e AS y, a, b FROM q)", ["a", "b"], "x")}
        SELECT z.*, ox.n*ox.ssr/ox.sst AS bp_stat, exp(-ox.n*ox.ssr/ox.sst/2) AS bp_p FROM z, ox""",
        "dw, bp_stat, bp_p, cooks_max, res_skew, res_kurt",
        "high_cooks, high_lev, out2, out3",
    ),
)(lambda t: R.linear_diagnostics(_priced(t), "price", ["l_quantity", "disc"], "pos"))
_X = ("1.0", "a", "b")
_V = lambda i, j: f"v{min(i, j)}_{max(i, j)}"
_MEAT = ", ".join(f"sum(w*{_X[i]}*{_X[j]}) AS m{i}_{j}" for i in range(3) for j in range(i, 3))
_SAND = lambda k: "sqrt(" + " + ".join(f"{_V(k, i)}*m{min(i, j)}_{max(i, j)}*{_V(j, k)}" for i in range(3) for j in range(3)) + ")"
query(
    "robust_errors",
    _sql(
        f"{_ROWS}, w AS (SELECT {_MEAT} FROM (SELECT a, b, power(e/(1-h), 2) AS w FROM q)), fin AS ("
        + " UNION ALL ".join(f"SELECT '{n}' AS term, b{i} AS b, {_SAND(i)} AS se_hc3 FROM o, w" for i, n in enumerate(("(constant)", "l_quantity", "disc")))
        + f") SELECT *, b/se_hc3 AS z_hc3, {Q.z_p('(b/se_hc3)')} AS p_hc3 FROM fin",
        "b, se_hc3, z_hc3, p_hc3",
        "term",
    ),
)(lambda t: R.robust_errors(_priced(t), "price", ["l_quantity", "disc"]))
query(
    "hierarchical_regression",
    _sql(
        f"""WITH {Q.ols(_LINES, ["a"], "1")}, {Q.ols(_LINES, ["a", "b", "c"], "3")}, r AS (SELECT 1::BIGINT AS block, n, 1::BIGINT AS k, ssr/sst AS r2, ssr/sst AS delta_r2, 1::BIGINT AS df1, CAST(n-2 AS BIGINT) AS df2 FROM o1
        UNION ALL SELECT 2, o3.n, 3, o3.ssr/o3.sst, o3.ssr/o3.sst - o1.ssr/o1.sst, 2, CAST(o3.n-4 AS BIGINT) FROM o3, o1), f AS (SELECT *, delta_r2/df1/((1-r2)/df2) AS f_change FROM r) SELECT *, {Q.f_p("f_change", "df1", "df2")} AS p FROM f""",
        "r2, delta_r2, f_change, p",
        "block, n, k, df1, df2",
    ),
)(lambda t: R.hierarchical(_priced(t), "price", [["l_quantity"], ["disc", "l_tax"]]))
_MOD = "(SELECT y, x, w, x*w AS xw FROM (SELECT y, a - avg(a) OVER () AS x, b - avg(b) OVER () AS w FROM " + _LINES + "))"
_MODERATED = f"WITH {Q.ols(_MOD, ['x', 'w', 'xw'])}, {Q.ols(_MOD, ['x', 'w'], 'x')}"
query(
    "moderation",
    _sql(
        f"{_MODERATED}, fin AS ("
        + " UNION ALL ".join(f"SELECT '{n}' AS term, o.b{i} AS b, sqrt(o.mse*o.v{i}_{i}) AS se, CAST(o.n-4 AS BIGINT) AS df, o.ssr/o.sst AS r2, o.ssr/o.sst - ox.ssr/ox.sst AS delta_r2 FROM o, ox" for i, n in enumerate(("(constant)", "l_quantity", "disc", "l_quantity:disc")))
        + f") SELECT *, b/se AS t, {Q.t_p('b/se', 'df')} AS p FROM fin",
        "b, se, r2, delta_r2, t, p",
        "term, df",
    ),
)(lambda t: R.moderation(_priced(t), "l_quantity", "disc", "price"))
query(
    "simple_slopes",
    _sql(
        f"""{_MODERATED}, sd AS (SELECT stddev_samp(w) AS sd FROM {_MOD}), z AS (SELECT 'mean - sd' AS "at", -sd AS z FROM sd UNION ALL SELECT 'mean', 0.0 UNION ALL SELECT 'mean + sd', sd FROM sd UNION ALL SELECT 'jn ' || i, -3*sd + 6*sd*i/40 FROM sd, (SELECT unnest(range(41)) AS i)),
        fin AS (SELECT "at", z AS w, b1 + b3*z AS slope, sqrt(mse*(v1_1 + z*z*v3_3 + 2*z*v1_3)) AS se, CAST(n-4 AS BIGINT) AS df FROM o, z) SELECT *, slope/se AS t, {Q.t_p("slope/se", "df")} AS p FROM fin""",
        "w, slope, se, t, p",
        '"at", df',
    ),
)(lambda t: R.simple_slopes(_priced(t), "l_quantity", "disc", "price", steps=40))
_MED = lambda y, x: f"(SELECT {y} AS y, {', '.join(x)} FROM (SELECT y AS yy, a AS x, b AS m FROM {_LINES}))"
query(
    "mediation",
    _sql(
        f"""WITH {Q.ols(_MED("m", ["x"]), ["x"], "1")}, {Q.ols(_MED("yy", ["x", "m"]), ["x", "m"], "2")}, {Q.ols(_MED("yy", ["x"]), ["x"], "3")},
        r AS (SELECT 'disc' AS mediator, o1.n AS n, o3.b1 AS c, o1.b1 AS a, o2.b2 AS b, o2.b1 AS c_prime, o1.b1*o2.b2 AS indirect, sqrt(power(o1.b1, 2)*o2.mse*o2.v2_2 + power(o2.b2, 2)*o1.mse*o1.v1_1) AS sobel_se FROM o1, o2, o3)
        SELECT *, indirect/sobel_se AS sobel_z, {Q.z_p("(indirect/sobel_se)")} AS p, NULL::DOUBLE AS boot_lo, NULL::DOUBLE AS boot_hi FROM r""",
        "c, a, b, c_prime, indirect, sobel_se, sobel_z, p, boot_lo, boot_hi",
        "mediator, n",
    ),
)(lambda t: R.mediation(_priced(t), "l_quantity", ["disc"], "price"))
query(
    "linear_weighted",
    _sql(
        f"WITH {Q.ols(f'(SELECT l_extendedprice/1000 AS y, l_quantity AS a, l_discount*100 AS b FROM {_COPIES})', ['a', 'b'])}, fin AS ("
        + " UNION ALL ".join(f"SELECT '{n}' AS term, b{i} AS b, sqrt(mse*v{i}_{i}) AS se, CAST(n-3 AS BIGINT) AS df FROM o" for i, n in enumerate(("(constant)", "l_quantity", "disc")))
        + ") SELECT * FROM fin",
        "b, se",
        "term, df",
    ),
)(lambda t: R.linear(_priced(t), "price", ["l_quantity", "disc"], weight="l_linenumber").select("term", "b", "se", "df"))
query(
    "classification_binary",
    _sql("WITH q AS (SELECT (l_returnflag='R') AS hit, (l_linestatus='O') AS open FROM lineitem), m AS (SELECT open, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) >= 0.5 AS said FROM q GROUP BY 1), j AS (SELECT hit, said FROM q JOIN m USING (open)) SELECT count(*) FILTER (hit AND said) AS tp, count(*) FILTER (NOT hit AND said) AS fp, count(*) FILTER (NOT hit AND NOT said) AS tn, count(*) FILTER (hit AND NOT said) AS fn, 100*avg(CASE WHEN hit = said THEN 1.0 ELSE 0 END) AS accuracy FROM j", "accuracy", "tp, fp, tn, fn"),
)(lambda t: R.classification(_priced(t), "returned", ["open"]))

# ---- multivariate -------------------------------------------------------------------------

_CAN = f"""WITH s AS (SELECT count(*) AS n, corr(l_quantity, l_discount) AS a, corr(l_tax, l_extendedprice) AS b, corr(l_quantity, l_tax) AS p, corr(l_quantity, l_extendedprice) AS q, corr(l_discount, l_tax) AS r, corr(l_discount, l_extendedprice) AS t FROM lineitem),
m AS (SELECT n, power(p*t-q*r, 2)/((1-a*a)*(1-b*b)) AS d, (p*p + q*q + r*r + t*t - 2*b*(p*q + r*t) - 2*a*(p*r + q*t) + 2*a*b*(p*t + q*r))/((1-a*a)*(1-b*b)) AS tr FROM s),
l AS (SELECT n, (tr+sqrt(tr*tr-4*d))/2 AS x, (tr-sqrt(tr*tr-4*d))/2 AS y FROM m), u AS (SELECT 1::BIGINT AS root, n, x AS rc2, (1-x)*(1-y) AS wilks, 4::BIGINT AS df FROM l UNION ALL SELECT 2, n, y, 1-y, 1 FROM l), v AS (SELECT *, -(n-1-2.5)*ln(wilks) AS chi2 FROM u)
SELECT root, sqrt(greatest(0.0, rc2)) AS rc, rc2, wilks, chi2, df, {Q.chi2_p("chi2", "df")} AS p FROM v"""
query("canonical_correlation", _sql(_CAN, "rc, rc2, wilks, chi2, p", "root, df"))(lambda t: A.canonical(t("lineitem"), ["l_quantity", "l_discount"], ["l_tax", "l_extendedprice"]))
query("scree_pair", _sql("WITH r AS (SELECT abs(corr(embedding[1], embedding[2])) AS r FROM embeddings) SELECT 1::BIGINT AS component, 1+r AS eigenvalue FROM r UNION ALL SELECT 2, 1-r FROM r", "eigenvalue", "component"))(lambda t: V.scree(_dims(t), ["e0", "e1"]).select("component", "eigenvalue"))
_DIFF = f"""WITH d AS (SELECT l_tax - l_discount AS v, l_returnflag AS g FROM lineitem), {_GROUPED}, o AS (SELECT count(*) AS n, avg(v)/(stddev_samp(v)/sqrt(count(*))) AS t FROM d)
SELECT 'time' AS effect, t AS stat, 1::BIGINT AS df1, CAST(n-1 AS BIGINT) AS df2, {Q.t_p("t", "(n-1)")} AS p FROM o UNION ALL SELECT 'time:group', f, df_b, df_w, p FROM e"""
query("glm_repeated", _sql(_DIFF, "stat, p", "effect, df1, df2"))(lambda t: M.glm_repeated(t("lineitem"), "l_discount", "l_tax", "l_returnflag"))
_AREA = lambda c: f"(SELECT {c} AS y, n_chars AS v FROM labels JOIN documents USING (doc_id))"
_AUC = lambda c: f"""(SELECT auc, sqrt((auc*(1-auc)+(p-1)*(auc/(2-auc)-auc*auc)+(n-1)*(2*auc*auc/(1+auc)-auc*auc))/(p*n)) AS se FROM (SELECT (sum(r) FILTER (y=1) - p*(p+1)/2)/(p*n) AS auc, p, n FROM (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1)/2.0 AS r,
sum(y) OVER ()::DOUBLE AS p, (count(*) OVER () - sum(y) OVER ())::DOUBLE AS n FROM {_AREA(c)}) GROUP BY p, n))"""  # noqa: E731
query("compare_auc", _sql(f"SELECT a.auc - b.auc AS diff, (a.auc - b.auc)/sqrt(a.se*a.se + b.se*b.se) AS z, {Q.z_p('((a.auc - b.auc)/sqrt(a.se*a.se + b.se*b.se))')} AS p FROM {_AUC('quality')} a, {_AUC('toxic')} b", "diff, z, p"))(lambda t: A.compare_auc(A.roc(_scored(t), "n_chars", "quality", "1"), A.roc(_scored(t), "n_chars", "toxic", "1")))
