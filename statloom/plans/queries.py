"""Registered queries: each applies one procedure to the star-schema tables, with SQL beside it where SQL can say it.

Doubles are rounded to four places on both sides, as sums in another order differ in the
last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import sql as Q
from statloom.operators import association as A
from statloom.operators import cases as C
from statloom.operators import descriptive as D
from statloom.operators import inference as I
from statloom.operators import means as M
from statloom.operators import mixed as X
from statloom.operators import multilevel as H
from statloom.operators import multivariate as V
from statloom.operators import regression as R
from statloom.operators import series as T
from statloom.operators import survival as U
from statloom.plans.shared import folder
from statloom.plans.stats import replicate
from statloom.sources import cases as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(f"`{c}`"), places) + 0.0).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in df.columns))


def _sql(select: str, doubles: str = "", rest: str = "") -> str:
    """``select`` with its doubles rounded; ``rest`` as they are."""
    cols = [*(c.strip() for c in rest.split(",") if c.strip()), *(f"ROUND(CAST({c.strip()} AS DOUBLE), 4) + 0.0 AS {c.strip()}" for c in doubles.split(",") if c.strip())]
    return f"SELECT {', '.join(cols)} FROM ({select}) AS result"


def query(name: str, oracle: str | None = None):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")))

        run.__name__ = name
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def _holes(t: DataFrame) -> DataFrame:
    """Line items with missing values by a rule: the tables have none."""
    return t.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("qty"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")).alias("disc"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("tax")
    )


_HOLES = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS qty, CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS disc, CASE WHEN l_linenumber <> 3 THEN l_tax END AS tax FROM lineitem)"

# ---- descriptives -------------------------------------------------------------------------

query(
    "describe",
    _sql(
        """SELECT 'l_quantity' AS variable, count(v) AS n, count(*) - count(v) AS missing, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
        (SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT v FROM (SELECT l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1) WHERE k = (SELECT max(k) FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_quantity)) ORDER BY v LIMIT 3)) AS mode,
        stddev_samp(v) AS std, var_samp(v) AS variance, stddev_samp(v) / sqrt(count(v)) AS sem, min(v) AS min, max(v) AS max, max(v) - min(v) AS range,
        quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, skewness(v) AS skewness, kurtosis(v) AS kurtosis,
        (SELECT count(*) FROM lineitem, (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem) WHERE l_quantity < a - 1.5*(b-a) OR l_quantity > b + 1.5*(b-a)) AS outlier_count FROM (SELECT l_quantity AS v FROM lineitem)""",
        "mean, median, std, variance, sem, min, max, range, q1, q3, iqr, skewness, kurtosis",
        "variable, n, missing, mode, outlier_count",
    ),
)(lambda t: D.describe(t("lineitem"), "l_quantity").drop("ci_lo", "ci_hi"))
_SW = f"""WITH x AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal) AS i, count(*) OVER () AS n FROM supplier),
m AS (SELECT v, n, {Q.norm_inv("((i-0.375)/(n+0.25))")} AS m FROM x),
w AS (SELECT max(n) AS n, least(1.0, power(sum(m*v), 2) / (sum(m*m) * var_samp(v) * (max(n)-1))) AS w FROM m)
SELECT n, w, 1 - CASE WHEN n <= 11 THEN {Q.norm_cdf("((-ln(-2.273+0.459*n - ln(1-w)) - (0.544-0.39978*n+0.025054*n*n-0.0006714*n*n*n))/exp(1.3822-0.77857*n+0.062767*n*n-0.0020322*n*n*n))")}
ELSE {Q.norm_cdf("((ln(1-w) - (-1.5861-0.31082*ln(n)-0.083751*ln(n)*ln(n)+0.0038915*ln(n)*ln(n)*ln(n)))/exp(-0.4803-0.082676*ln(n)+0.0030302*ln(n)*ln(n)))")} END AS p FROM w"""
query("shapiro_wilk", _sql(_SW, "w, p", "n"))(lambda t: D.shapiro_wilk(t("supplier"), "s_acctbal"))
_KS = f"""WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd, count(*) AS t FROM lineitem),
c AS (SELECT l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1), r AS (SELECT v, k, sum(k) OVER (ORDER BY v) AS cum FROM c),
f AS (SELECT *, {Q.norm_cdf("((v-m)/sd)")} AS f FROM r, s)
SELECT CAST(max(t) AS BIGINT) AS n, max(greatest(abs(cum/t - f), abs((cum-k)/t - f))) AS d FROM f"""
query("ks_normal", _sql(f"SELECT n, d, greatest(0.001, least(1.0, CASE WHEN n*d*d < 0.04 THEN 1.0 ELSE 2*list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END)*exp(-2.0*j*j*n*d*d))) END)) AS p FROM ({_KS})", "d, p", "n"))(lambda t: D.ks_normal(t("lineitem"), "l_quantity"))
_TAB = """WITH c AS (SELECT o_orderstatus AS row_level, o_orderpriority AS col_level, count(*) AS n FROM orders GROUP BY 1, 2),
rt AS (SELECT row_level, sum(n) AS rt FROM c GROUP BY 1), ct AS (SELECT col_level, sum(n) AS ct FROM c GROUP BY 1), g AS (SELECT rt.row_level, ct.col_level, coalesce(n, 0) AS n, rt, ct, (SELECT sum(n) FROM c) AS t
FROM rt CROSS JOIN ct LEFT JOIN c ON c.row_level = rt.row_level AND c.col_level = ct.col_level)
"""
query("crosstab", _sql(_TAB + "SELECT row_level, col_level, n, rt*ct/t AS expected, 100.0*n/rt AS row_pct, 100.0*n/ct AS col_pct, 100.0*n/t AS total_pct FROM g", "expected, row_pct, col_pct, total_pct", "row_level, col_level, n"))(lambda t: D.crosstab(t("orders"), "o_orderstatus", "o_orderpriority"))
query("chi_square", _sql(_TAB + f", s AS (SELECT sum(power(n - rt*ct/t, 2)/(rt*ct/t)) AS chi2, CAST((count(DISTINCT row_level)-1)*(count(DISTINCT col_level)-1) AS BIGINT) AS df, least(count(DISTINCT row_level), count(DISTINCT col_level)) AS k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN rt*ct/t < 5 THEN 1 ELSE 0 END) AS BIGINT) AS low_cells FROM g) SELECT chi2, df, {Q.chi2_p('chi2', 'df')} AS p, sqrt(chi2/(n*(k-1))) AS cramers_v, n, low_cells FROM s", "chi2, p, cramers_v", "df, n, low_cells"))(lambda t: D.chi_square(t("orders"), "o_orderstatus", "o_orderpriority"))
_CH = lambda n, k: f"(lgamma({n}+1.0)-lgamma({k}+1.0)-lgamma(({n})-({k})+1.0))"
_PX = lambda x: f"exp({_CH('(a+b)', x)}+{_CH('(c+d)', f'(a+c-{x})')}-{_CH('(a+b+c+d)', '(a+c)')})"
query(
    "fisher_exact",
    _sql(
        f"""WITH t AS (SELECT count(*) FILTER (quality=0 AND toxic=0) AS a, count(*) FILTER (quality=0 AND toxic=1) AS b, count(*) FILTER (quality=1 AND toxic=0) AS c, count(*) FILTER (quality=1 AND toxic=1) AS d FROM labels),
        x AS (SELECT *, unnest(range(greatest(0, a-d), least(a+b, a+c)+1)) AS x, {_PX("a")} AS seen FROM t)
        SELECT a, b, c, d, a*d/greatest(b*c, 1e-4) AS odds_ratio, least(1.0, sum(CASE WHEN {_PX("x")} <= seen + 1e-10 THEN {_PX("x")} ELSE 0 END)) AS p FROM x GROUP BY a, b, c, d""",
        "odds_ratio, p",
        "a, b, c, d",
    ),
)(lambda t: D.fisher_exact(t("labels"), "quality", "toxic"))
query("pivot_mean", _sql("SELECT l_returnflag AS row_level, avg(l_quantity) FILTER (l_linestatus='F') AS \"F\", avg(l_quantity) FILTER (l_linestatus='O') AS \"O\" FROM lineitem GROUP BY 1", '"F", "O"', "row_level"))(lambda t: D.pivot(t("lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "mean", ["F", "O"]))
query("pivot_std", _sql("SELECT l_returnflag AS row_level, stddev_samp(l_quantity) FILTER (l_linestatus='F') AS \"F\", stddev_samp(l_quantity) FILTER (l_linestatus='O') AS \"O\" FROM lineitem GROUP BY 1", '"F", "O"', "row_level"))(lambda t: D.pivot(t("lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "std"))
query("missing_summary", _sql("SELECT variable, n, missing, 100.0*missing/n AS pct FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS missing FROM {_HOLES}" for c in ("l_orderkey", "l_linenumber", "qty", "disc", "tax")) + ")", "pct", "variable, n, missing"))(lambda t: D.missing_summary(_holes(t("lineitem"))))
_PAT = "(CASE WHEN qty IS NULL THEN '1' ELSE '0' END || CASE WHEN disc IS NULL THEN '1' ELSE '0' END || CASE WHEN tax IS NULL THEN '1' ELSE '0' END)"
query("missing_patterns", _sql(f"SELECT {_PAT} AS pattern, count(*) AS n, 100.0*count(*)/(SELECT count(*) FROM lineitem) AS pct FROM {_HOLES} GROUP BY 1", "pct", "pattern, n"))(lambda t: D.missing_patterns(_holes(t("lineitem")), ["qty", "disc", "tax"]))
query("co_missing", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS n FROM {_HOLES}" for a, b in (("qty", "disc"), ("qty", "tax"), ("disc", "tax"))))(lambda t: D.co_missing(_holes(t("lineitem")), ["qty", "disc", "tax"]))
_MC = " + ".join(f"coalesce(n_{c} * power(m_{c} - M{c}, 2) / V{c}, 0)" for c in ("qty", "disc", "tax"))
_MN = " + ".join(f"(CASE WHEN n_{c} > 0 THEN 1 ELSE 0 END)" for c in ("qty", "disc", "tax"))
query(
    "mcar",
    _sql(
        f"""WITH p AS (SELECT {_PAT} AS pattern, {", ".join(f"count({c}) AS n_{c}, avg({c}) AS m_{c}" for c in ("qty", "disc", "tax"))} FROM {_HOLES} GROUP BY 1),
        g AS (SELECT {", ".join(f"avg({c}) AS M{c}, var_samp({c}) AS V{c}" for c in ("qty", "disc", "tax"))} FROM {_HOLES}),
        s AS (SELECT sum({_MC}) AS chi2, CAST(greatest(1, sum({_MN}) - 2 * count(*)) AS BIGINT) AS df, count(*) AS n_patterns FROM p, g)
        SELECT chi2, df, {Q.chi2_p("chi2", "df")} AS p, n_patterns FROM s""",
        "chi2, p",
        "df, n_patterns",
    ),
)(lambda t: D.mcar(_holes(t("lineitem")), ["qty", "disc", "tax"]).withColumn("df", F.col("df").cast("bigint")))
query("histogram", _sql("WITH s AS (SELECT min(l_quantity) AS lo, (max(l_quantity)-min(l_quantity))/14 AS step FROM lineitem) SELECT CAST(least(floor((l_quantity-lo)/step), 13) AS INTEGER) AS bin, min(lo + least(floor((l_quantity-lo)/step), 13)*step) AS low, min(lo + (least(floor((l_quantity-lo)/step), 13)+1)*step) AS high, count(*) AS n FROM lineitem, s GROUP BY 1", "low, high", "bin, n"))(lambda t: D.histogram(t("lineitem"), "l_quantity"))
_BOX = "WITH q AS (SELECT o_orderpriority AS grp, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1) SELECT grp, n, q1, median, q3, min(o_totalprice) FILTER (o_totalprice BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1)) AS whisker_lo, max(o_totalprice) FILTER (o_totalprice BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1)) AS whisker_hi, count(*) FILTER (NOT o_totalprice BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1)) AS outliers FROM orders JOIN q ON grp = o_orderpriority GROUP BY ALL"
query("box_plot", _sql(_BOX, "q1, median, q3, whisker_lo, whisker_hi", "grp, n, outliers"))(lambda t: D.box_plot(t("orders"), "o_totalprice", "o_orderpriority"))
query("qq_normal", _sql(f"WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT v, n, (sum(n) OVER (ORDER BY v) - n/2.0) / (SELECT count(*) FROM lineitem) AS u FROM c) SELECT v, n, {Q.norm_inv('u')} AS theoretical FROM r", "v, theoretical", "n"))(lambda t: D.qq_normal(t("lineitem"), "l_quantity"))

# ---- means --------------------------------------------------------------------------------


def _anova_sql(source: str) -> str:
    """``source`` gives v and g."""
    return _sql(
        f"""WITH d AS ({source}), g AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS var FROM d GROUP BY g), a AS (SELECT sum(n*m)/sum(n) AS grand FROM g),
        s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n*power(m-grand, 2)) AS ss_b, sum((n-1)*var) AS ss_w FROM g, a),
        f AS (SELECT *, k-1 AS df_b, n-k AS df_w, ss_b/(k-1) AS ms_b, ss_w/(n-k) AS ms_w, (ss_b/(k-1))/(ss_w/(n-k)) AS f FROM s)
        SELECT *, {Q.f_p("f", "df_b", "df_w")} AS p, ss_b/(ss_b+ss_w) AS eta2, greatest(0.0, (ss_b-df_b*ms_w)/(ss_b+ss_w+ms_w)) AS omega2 FROM f""",
        "ss_b, ss_w, ms_b, ms_w, f, p, eta2, omega2",
        "k, n, df_b, df_w",
    )


query("anova_oneway", _anova_sql("SELECT l_quantity AS v, l_returnflag AS g FROM lineitem"))(lambda t: M.anova_oneway(t("lineitem"), "l_quantity", "l_returnflag"))
query("levene", _anova_sql("SELECT abs(l_quantity - med) AS v, g FROM (SELECT l_quantity, l_returnflag AS g, quantile_cont(l_quantity, 0.5) OVER (PARTITION BY l_returnflag) AS med FROM lineitem)"))(lambda t: M.levene(t("lineitem"), "l_quantity", "l_returnflag"))
query("group_table", _sql("SELECT l_returnflag AS grp, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, stddev_samp(l_quantity)/sqrt(count(*)) AS se FROM lineitem GROUP BY 1", "mean, sd, se", "grp, n"))(lambda t: M.group_table(t("lineitem"), "l_quantity", "l_returnflag"))
query(
    "ttest_welch",
    _sql(
        f"""WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1),
        r AS (SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, a.m AS mean_a, b.m AS mean_b, a.v AS va, b.v AS vb FROM g a, g b WHERE a.g < b.g),
        s AS (SELECT *, mean_a-mean_b AS diff, sqrt(va/n_a+vb/n_b) AS se, power(va/n_a+vb/n_b, 2)/(power(va/n_a, 2)/(n_a-1)+power(vb/n_b, 2)/(n_b-1)) AS df, abs(mean_a-mean_b)/sqrt(((n_a-1)*va+(n_b-1)*vb)/(n_a+n_b-2)) AS cohens_d FROM r),
        u AS (SELECT *, diff/se AS t, sqrt((n_a+n_b)*1.0/(n_a*n_b) + cohens_d*cohens_d/(2.0*(n_a+n_b-2))) AS sed FROM s)
        SELECT group_a, group_b, n_a, n_b, mean_a, mean_b, sqrt(va) AS sd_a, sqrt(vb) AS sd_b, diff, se, t, df, {Q.t_p("t", "df")} AS p, cohens_d, cohens_d-1.96*sed AS d_lo, cohens_d+1.96*sed AS d_hi FROM u""",
        "mean_a, mean_b, sd_a, sd_b, diff, se, t, df, p, cohens_d, d_lo, d_hi",
        "group_a, group_b, n_a, n_b",
    ),
)(lambda t: M.ttest_independent(t("lineitem"), "l_quantity", "l_linestatus").drop("ci_lo", "ci_hi"))


def _one_t(source: str, mu: float) -> str:
    return _sql(
        f"WITH s AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM ({source})), r AS (SELECT *, sd/sqrt(n) AS se, mean-{mu} AS diff, (mean-{mu})/(sd/sqrt(n)) AS t, n-1 AS df FROM s) SELECT *, {Q.t_p('t', 'df')} AS p, abs(diff/sd) AS cohens_d FROM r",
        "mean, sd, se, diff, t, p, cohens_d",
        "n, df",
    )


query("ttest_one_sample", _one_t("SELECT l_quantity AS v FROM lineitem", 25.5))(lambda t: M.ttest_one_sample(t("lineitem"), "l_quantity", 25.5).drop("ci_lo", "ci_hi"))
query("ttest_paired", _one_t("SELECT l_discount - l_tax AS v FROM lineitem", 0.0))(lambda t: M.ttest_paired(t("lineitem"), "l_discount", "l_tax").drop("ci_lo", "ci_hi"))


def _posthoc_sql(p_adj: str, factor: str = "") -> str:
    return _sql(
        f"""WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
        s AS (SELECT count(*) AS k, sum(n)-count(*) AS df, sum((n-1)*v)/(sum(n)-count(*)) AS msw FROM g),
        p AS (SELECT a.g AS a, b.g AS b, a.m-b.m AS diff, sqrt(msw*(1.0/a.n+1.0/b.n){factor}) AS se, CAST(df AS BIGINT) AS df, k FROM g a, g b, s WHERE a.g < b.g),
        r AS (SELECT *, diff/se AS stat, {Q.t_p("diff/se", "df")} AS p_raw FROM p),
        h AS (SELECT *, least(1.0, p_raw*(k*(k-1)/2 - row_number() OVER (ORDER BY p_raw, a, b) + 1)) AS step FROM r)
        SELECT a, b, diff, se, stat, df, p_raw, {p_adj} AS p_adj FROM h""",
        "diff, se, stat, p_raw, p_adj",
        "a, b, df",
    )


query("posthoc_lsd", _posthoc_sql("p_raw"))(lambda t: M.posthoc(t("orders"), "o_totalprice", "o_orderpriority", "lsd"))
query("posthoc_bonferroni", _posthoc_sql("least(1.0, p_raw*k*(k-1)/2)"))(lambda t: M.posthoc(t("orders"), "o_totalprice", "o_orderpriority", "bonferroni"))
query("posthoc_holm", _posthoc_sql("max(step) OVER (ORDER BY p_raw, a, b)"))(lambda t: M.posthoc(t("orders"), "o_totalprice", "o_orderpriority", "holm"))
query("posthoc_tukey", "SELECT a, b, diff, se, abs(stat) AS stat, df FROM (" + _posthoc_sql("p_raw", "/2") + ")")(lambda t: M.posthoc(t("orders"), "o_totalprice", "o_orderpriority", "tukey").drop("p_raw", "p_adj"))
query("posthoc_tukey_p")(lambda t: M.posthoc(t("orders"), "o_totalprice", "o_orderpriority", "tukey"))


def _factorial_sql(factors: list[str]) -> str:
    """Sums of squares by inclusion and exclusion over group means, written out for two or three factors."""
    from itertools import combinations

    k = len(factors)
    subs = [s for r in range(1, k + 1) for s in combinations(factors, r)]
    key = lambda s: "_".join(str(factors.index(f)) for f in s)
    ctes = [f"m{key(s)} AS (SELECT sum(n0*power(m-grand, 2)) AS ss, count(*) AS lv FROM (SELECT count(*) AS n0, avg(l_quantity) AS m FROM lineitem GROUP BY {', '.join(s)}), t)" for s in subs]
    part = lambda s: " ".join(f"{'+' if (len(s) - len(o)) % 2 == 0 else '-'} m{key(o)}.ss" for o in subs if set(o) <= set(s))
    dof = lambda s: "*".join(f"(m{key((f,))}.lv-1)" for f in s)
    full = tuple(factors)
    tables = ", ".join(f"m{key(s)}" for s in subs)
    dfe = f"t.n - {'*'.join(f'm{key((f,))}.lv' for f in factors) if k == 2 else f'm{key(full)}.lv'}"
    lines = [f"SELECT '{':'.join(s)}' AS source, greatest(0.0, {part(s)}) AS ss, CAST({dof(s)} AS BIGINT) AS df, t.sst - m{key(full)}.ss AS sse, CAST({dfe} AS BIGINT) AS dfe, t.sst AS sst FROM t, {tables}" for s in subs]
    err = f"SELECT 'error' AS source, t.sst - m{key(full)}.ss AS ss, CAST({dfe} AS BIGINT) AS df, t.sst - m{key(full)}.ss AS sse, CAST({dfe} AS BIGINT) AS dfe, t.sst AS sst FROM t, {tables}"
    return _sql(
        f"""WITH t AS (SELECT avg(l_quantity) AS grand, count(*) AS n, var_samp(l_quantity)*(count(*)-1) AS sst FROM lineitem), {", ".join(ctes)}, a AS ({" UNION ALL ".join([*lines, err])}),
        f AS (SELECT *, ss/df AS ms, (ss/df)/(sse/dfe) AS fv FROM a)
        SELECT source, ss, df, ms, CASE WHEN source <> 'error' THEN fv END AS f, CASE WHEN source <> 'error' THEN {Q.f_p("fv", "df", "dfe")} END AS p, CASE WHEN source <> 'error' THEN ss/sst END AS eta2, CASE WHEN source <> 'error' THEN ss/(ss+sse) END AS partial_eta2 FROM f""",
        "ss, ms, f, p, eta2, partial_eta2",
        "source, df",
    )


query("anova_two_way", _factorial_sql(["l_returnflag", "l_linestatus"]))(lambda t: M.anova_factorial(t("lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]))
query("anova_three_way", _factorial_sql(["l_returnflag", "l_linestatus", "l_linenumber"]))(lambda t: M.anova_factorial(t("lineitem"), "l_quantity", ["l_returnflag", "l_linestatus", "l_linenumber"]))
query(
    "anova_repeated",
    _sql(
        f"""WITH d AS (SELECT l_discount AS a, l_tax AS b, l_quantity/500 AS c FROM lineitem), m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg((a+b+c)/3) AS g FROM d),
        s AS (SELECT max(n) AS n, 3::BIGINT AS k, max(n*(power(ma-g,2)+power(mb-g,2)+power(mc-g,2))) AS ss_time, sum(3*power((a+b+c)/3-g, 2)) AS ss_subj, sum(power(a-g,2)+power(b-g,2)+power(c-g,2)) AS sst FROM d, m),
        r AS (SELECT n, k, ss_time, ss_subj, sst-ss_time-ss_subj AS ss_err, k-1 AS df_time, (k-1)*(n-1) AS df_err FROM s), f AS (SELECT *, (ss_time/df_time)/(ss_err/df_err) AS f FROM r)
        SELECT *, {Q.f_p("f", "df_time", "df_err")} AS p, ss_time/(ss_time+ss_err) AS partial_eta2 FROM f""",
        "ss_time, ss_subj, ss_err, f, p, partial_eta2",
        "n, k, df_time, df_err",
    ),
)(lambda t: M.anova_repeated(t("lineitem").withColumn("q", F.col("l_quantity") / 500), ["l_discount", "l_tax", "q"]))
query("pairwise_paired", _sql(f"WITH s AS (SELECT count(*) AS n, avg(l_discount-l_tax) AS diff, stddev_samp(l_discount-l_tax)/sqrt(count(*)) AS se FROM lineitem) SELECT 'l_discount' AS a, 'l_tax' AS b, n, diff, se, n-1 AS df, diff/se AS t, {Q.t_p('diff/se', 'n-1')} AS p FROM s", "diff, se, t, p", "a, b, n, df"))(lambda t: M.pairwise_paired(t("lineitem"), ["l_discount", "l_tax"]))
query(
    "glm_univariate",
    _sql(
        f"""WITH t AS (SELECT count(*) AS n, avg(l_quantity) AS g, var_samp(l_quantity)*(count(*)-1) AS sst, power(corr(l_quantity, l_discount), 2)*var_samp(l_quantity)*(count(*)-1) AS ssc FROM lineitem),
        a AS (SELECT sum(n0*power(m-g, 2)) AS ss, count(*)-1 AS df FROM (SELECT count(*) AS n0, avg(l_quantity) AS m FROM lineitem GROUP BY l_returnflag), t),
        b AS (SELECT sum(n0*power(m-g, 2)) AS ss, count(*)-1 AS df FROM (SELECT count(*) AS n0, avg(l_quantity) AS m FROM lineitem GROUP BY l_linestatus), t),
        e AS (SELECT greatest(0.0, sst-a.ss-b.ss-ssc) AS sse, n-1-a.df-b.df-1 AS dfe FROM t, a, b),
        u AS (SELECT 'l_returnflag' AS source, ss, df FROM a UNION ALL SELECT 'l_linestatus', ss, df FROM b UNION ALL SELECT 'l_discount', ssc, 1 FROM t UNION ALL SELECT 'error', sse, dfe FROM e)
        SELECT source, ss, CAST(df AS BIGINT) AS df, CASE WHEN source <> 'error' THEN (ss/df)/(sse/dfe) END AS f, CASE WHEN source <> 'error' THEN {Q.f_p("(ss/df)/(sse/dfe)", "df", "dfe")} END AS p, CASE WHEN source <> 'error' THEN ss/(ss+sse) END AS partial_eta2 FROM u, e""",
        "ss, f, p, partial_eta2",
        "source, df",
    ),
)(lambda t: M.glm_univariate(t("lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"], ["l_discount"]))
query("manova")(lambda t: M.manova(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag"))

# ---- association --------------------------------------------------------------------------


def _corr_sql(source: str, x: str, y: str) -> str:
    """``source`` gives a and b."""
    return _sql(
        f"WITH s AS (SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, corr(a, b) AS r FROM ({source})), u AS (SELECT *, r*r AS r2, r*sqrt((n-2)/(1-r*r)) AS t, 0.5*ln((1+r)/(1-r)) AS z, 1.959963984540054/sqrt(n-3) AS h FROM s) SELECT x, y, n, r, r2, t, {Q.t_p('t', 'n-2')} AS p, (exp(2*(z-h))-1)/(exp(2*(z-h))+1) AS ci_lo, (exp(2*(z+h))-1)/(exp(2*(z+h))+1) AS ci_hi FROM u",
        "r, r2, t, p, ci_lo, ci_hi",
        "x, y, n",
    )


def _rank(v: str) -> str:
    return f"(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0)"


query("pearson", _corr_sql("SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem", "l_quantity", "l_extendedprice"))(lambda t: A.pearson(t("lineitem"), "l_quantity", "l_extendedprice"))
query("spearman", _corr_sql(f"SELECT {_rank('l_quantity')} AS a, {_rank('l_discount')} AS b FROM lineitem", "l_quantity", "l_discount"))(lambda t: A.spearman(t("lineitem"), "l_quantity", "l_discount"))
query("partial_correlation", _sql(f"WITH s AS (SELECT count(*) AS n, corr(l_quantity, l_discount) AS rxy, corr(l_quantity, l_tax) AS rxz, corr(l_discount, l_tax) AS ryz FROM lineitem), u AS (SELECT *, (rxy-rxz*ryz)/sqrt((1-rxz*rxz)*(1-ryz*ryz)) AS rp, n-3 AS df FROM s), w AS (SELECT *, rp*sqrt(df/(1-rp*rp)) AS t FROM u) SELECT *, {Q.t_p('t', 'df')} AS p FROM w", "rp, t, p, rxy, rxz, ryz", "n, df"))(lambda t: A.partial(t("lineitem"), "l_quantity", "l_discount", "l_tax").drop("ci_lo", "ci_hi"))
query("correlation_matrix", " UNION ALL ".join(_corr_sql(f"SELECT {a} AS a, {b} AS b FROM {_HOLES} WHERE {a} IS NOT NULL AND {b} IS NOT NULL", a, b) for a, b in (("qty", "disc"), ("qty", "tax"), ("disc", "tax"))))(lambda t: A.correlation_matrix(_holes(t("lineitem")), ["qty", "disc", "tax"]))
_ITEMS = ("l_discount", "l_tax", "q")
query(
    "cronbach_alpha",
    _sql(
        " UNION ALL ".join(
            f"SELECT '{i}' AS item, 3::BIGINT AS k, count(*) AS n, 1.5*(1-(var_samp(l_discount)+var_samp(l_tax)+var_samp(q))/var_samp(l_discount+l_tax+q)) AS alpha, corr({i}, {a}+{b}) AS rit, 2*(1-(var_samp({a})+var_samp({b}))/var_samp({a}+{b})) AS alpha_if_deleted FROM (SELECT l_discount, l_tax, l_quantity/500 AS q FROM lineitem)"
            for i, a, b in (("l_discount", "l_tax", "q"), ("l_tax", "l_discount", "q"), ("q", "l_discount", "l_tax"))
        ),
        "alpha, rit, alpha_if_deleted",
        "item, k, n",
    ),
)(lambda t: A.cronbach_alpha(t("lineitem").withColumn("q", F.col("l_quantity") / 500), list(_ITEMS)))
query(
    "cohen_kappa",
    _sql(
        f"""WITH s AS (SELECT count(*) AS n, avg(CASE WHEN quality=toxic THEN 1.0 ELSE 0.0 END) AS po, avg(quality)*avg(toxic)+(1-avg(quality))*(1-avg(toxic)) AS pe FROM labels), u AS (SELECT *, (po-pe)/(1-pe) AS kappa, sqrt(po*(1-po)/(n*power(1-pe, 2))) AS se FROM s)
        SELECT *, kappa/se AS z, {Q.z_p("(kappa/se)")} AS p, kappa-1.96*se AS ci_lo, kappa+1.96*se AS ci_hi, kappa AS w_kappa FROM u""",
        "po, pe, kappa, se, z, p, ci_lo, ci_hi, w_kappa",
        "n",
    ),
)(lambda t: A.cohen_kappa(t("labels"), "quality", "toxic"))
query(
    "mann_whitney",
    _sql(
        f"""WITH r AS (SELECT l_linestatus AS g, {_rank("l_quantity")} AS r FROM lineitem), s AS (SELECT count(*) FILTER (g='F') AS n_a, count(*) FILTER (g='O') AS n_b, sum(r) FILTER (g='F') AS ra FROM r),
        ti AS (SELECT sum(power(k, 3)-k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM lineitem GROUP BY l_quantity)), u AS (SELECT *, ra-n_a*(n_a+1)/2.0 AS u1, n_a*n_b-(ra-n_a*(n_a+1)/2.0) AS u2, (n_a+n_b)::DOUBLE AS nn FROM s, ti),
        z AS (SELECT *, least(u1, u2) AS u, (least(u1, u2)-n_a*n_b/2.0)/sqrt(n_a::DOUBLE*n_b/12*(nn+1-ties/(nn*(nn-1)))) AS z FROM u)
        SELECT 'F' AS group_a, 'O' AS group_b, n_a, n_b, u, u1, u2, z, {Q.z_p("z")} AS p, abs(z)/sqrt(nn) AS r_eff, 'normal' AS method FROM z""",
        "u, u1, u2, z, p, r_eff",
        "group_a, group_b, n_a, n_b, method",
    ),
)(lambda t: A.mann_whitney(t("lineitem"), "l_quantity", "l_linestatus"))
query(
    "kruskal_wallis",
    _sql(
        f"""WITH r AS (SELECT l_returnflag AS g, {_rank("l_quantity")} AS r FROM lineitem), g AS (SELECT g, count(*) AS m, sum(r) AS rs FROM r GROUP BY 1), s AS (SELECT count(*) AS k, CAST(sum(m) AS BIGINT) AS n, sum(rs*rs/m) AS x FROM g),
        h AS (SELECT *, 12.0/(n::DOUBLE*(n+1))*x-3*(n+1) AS h, k-1 AS df FROM s) SELECT k, n, h, df, {Q.chi2_p("h", "df")} AS p, greatest(0.0, (h-k+1)/(n-k)) AS eta2 FROM h""",
        "h, p, eta2",
        "k, n, df",
    ),
)(lambda t: A.kruskal_wallis(t("lineitem"), "l_quantity", "l_returnflag"))
query(
    "wilcoxon",
    _sql(
        f"""WITH d AS (SELECT l_quantity-25 AS x FROM lineitem WHERE l_quantity <> 25), r AS (SELECT x, {_rank("abs(x)")} AS r FROM d), s AS (SELECT count(*) AS n, sum(r) FILTER (x > 0) AS w_plus, sum(r) FILTER (x < 0) AS w_minus FROM r),
        z AS (SELECT *, least(w_plus, w_minus) AS w, (least(w_plus, w_minus)-n::DOUBLE*(n+1)/4)/sqrt(n::DOUBLE*(n+1)*(2*n+1)/24) AS z FROM s) SELECT n, w, w_plus, w_minus, z, {Q.z_p("z")} AS p, 'normal' AS method FROM z""",
        "w, w_plus, w_minus, z, p",
        "n, method",
    ),
)(lambda t: A.wilcoxon(t("lineitem"), "l_quantity", 25.0))
_ROC = """WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS v, quality AS y FROM labels JOIN documents USING (doc_id)), c AS (SELECT v, sum(y) AS p, count(*)-sum(y) AS q FROM d GROUP BY 1),
r AS (SELECT v, p, q, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp, (SELECT sum(p) FROM c) AS np, (SELECT sum(q) FROM c) AS nn FROM c WINDOW w AS (ORDER BY v DESC)),
k AS (SELECT v AS threshold, p, q, tp, fp, CAST(nn-fp AS BIGINT) AS tn, CAST(np-tp AS BIGINT) AS fn, tp/np AS tpr, fp/nn AS fpr, tp/(tp+fp) AS ppv, (nn-fp)/nullif(nn-fp+np-tp, 0) AS npv, 2*tp/(2*tp+fp+np-tp) AS f1, tp/np-fp/nn AS youden, np, nn FROM r)
"""


def _scored(t) -> DataFrame:
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")


_PAIRED = """WITH d AS (SELECT n_chars AS a, length(text) - length(replace(text, ' ', '')) AS b, quality AS y FROM labels JOIN documents USING (doc_id)),
n AS (SELECT CAST(sum(y) AS DOUBLE) AS P, CAST(count(*)-sum(y) AS DOUBLE) AS Q FROM d),
v AS (SELECT y, CASE WHEN y = 1 THEN (sum(1-y) OVER wa - (sum(1-y) OVER ta)/2.0)/Q ELSE (P - sum(y) OVER wa + (sum(y) OVER ta)/2.0)/P END AS a,
CASE WHEN y = 1 THEN (sum(1-y) OVER wb - (sum(1-y) OVER tb)/2.0)/Q ELSE (P - sum(y) OVER wb + (sum(y) OVER tb)/2.0)/P END AS b FROM d, n
WINDOW wa AS (ORDER BY a RANGE UNBOUNDED PRECEDING), ta AS (PARTITION BY a), wb AS (ORDER BY b RANGE UNBOUNDED PRECEDING), tb AS (PARTITION BY b)),
g AS (SELECT y, count(*) AS k, avg(a) AS ma, avg(b) AS mb, var_samp(a)/count(*) AS va, var_samp(b)/count(*) AS vb, covar_samp(a, b)/count(*) AS c FROM v GROUP BY y),
s AS (SELECT CAST(max(k) FILTER (y = 1) AS BIGINT) AS n_pos, CAST(max(k) FILTER (y = 0) AS BIGINT) AS n_neg, max(ma) FILTER (y = 1) AS auc_a, max(mb) FILTER (y = 1) AS auc_b, sqrt(sum(va)) AS se_a, sqrt(sum(vb)) AS se_b, sum(c) AS cov FROM g),
u AS (SELECT *, auc_a-auc_b AS diff, sqrt(se_a*se_a+se_b*se_b-2*cov) AS se FROM s)"""
query("compare_auc_paired", _sql(f"{_PAIRED} SELECT *, diff/se AS z, {Q.z_p('(diff/se)')} AS p FROM u", "auc_a, auc_b, se_a, se_b, cov, diff, se, z, p", "n_pos, n_neg"))(
    lambda t: A.compare_auc_paired(t("labels").join(t("documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("blanks")), "doc_id"), "n_chars", "blanks", "quality", "1")
)
query("roc_curve", _sql(_ROC + "SELECT * FROM k", "threshold, tpr, fpr, ppv, npv, f1, youden", "tp, fp, tn, fn"))(lambda t: A.roc_curve(_scored(t), "n_chars", "quality", "1"))
query(
    "roc",
    _sql(
        _ROC
        + """, s AS (SELECT CAST(max(np) AS DOUBLE) AS P, CAST(max(nn) AS DOUBLE) AS N, sum(p*(tn+q/2.0)) AS wins, max(youden) AS youden FROM k), a AS (SELECT *, wins/(P*N) AS auc FROM s),
        e AS (SELECT *, sqrt((auc*(1-auc)+(P-1)*(auc/(2-auc)-auc*auc)+(N-1)*(2*auc*auc/(1+auc)-auc*auc))/(P*N)) AS se FROM a)
        SELECT CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg, auc, se, greatest(0.0, auc-1.96*se) AS ci_lo, least(1.0, auc+1.96*se) AS ci_hi, (SELECT max(threshold) FROM k WHERE k.youden = e.youden) AS opt_threshold, youden FROM e""",
        "auc, se, ci_lo, ci_hi, opt_threshold, youden",
        "n_pos, n_neg",
    ),
)(lambda t: A.roc(_scored(t), "n_chars", "quality", "1"))

# ---- regression ---------------------------------------------------------------------------

_OLS1 = "WITH s AS (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice/1000, l_quantity) AS b1, regr_intercept(l_extendedprice/1000, l_quantity) AS b0, regr_sxx(l_extendedprice/1000, l_quantity) AS sxx, regr_syy(l_extendedprice/1000, l_quantity) AS sst, regr_sxy(l_extendedprice/1000, l_quantity) AS sxy, avg(l_quantity) AS mx, stddev_samp(l_quantity) AS sx, stddev_samp(l_extendedprice/1000) AS sy FROM lineitem), e AS (SELECT *, sst-b1*sxy AS sse, b1*sxy AS ssr, (sst-b1*sxy)/(n-2) AS mse FROM s)"
query(
    "linear_simple",
    _sql(f"{_OLS1}, c AS (SELECT '(constant)' AS term, b0 AS b, sqrt(mse*(1.0/n+mx*mx/sxx)) AS se, CAST(n-2 AS BIGINT) AS df, NULL::DOUBLE AS beta_std, NULL::DOUBLE AS vif FROM e UNION ALL SELECT 'l_quantity', b1, sqrt(mse/sxx), CAST(n-2 AS BIGINT), b1*sx/sy, 1.0 FROM e) SELECT *, b/se AS t, {Q.t_p('b/se', 'df')} AS p FROM c", "b, se, beta_std, vif, t, p", "term, df"),
)(lambda t: R.linear(t("lineitem").withColumn("price", F.col("l_extendedprice") / 1000), "price", ["l_quantity"]))
query(
    "linear_fit",
    _sql(f"{_OLS1} SELECT CAST(n AS BIGINT) AS n, 1::BIGINT AS k, ssr/sst AS r2, 1-(1-ssr/sst)*(n-1)/(n-2) AS r2_adj, ssr/mse AS f, 1::BIGINT AS df1, CAST(n-2 AS BIGINT) AS df2, sqrt(mse) AS rmse, {Q.f_p('ssr/mse', '1', '(n-2)')} AS p_f FROM e", "r2, r2_adj, f, rmse, p_f", "n, k, df1, df2"),
)(lambda t: R.linear_fit(t("lineitem").withColumn("price", F.col("l_extendedprice") / 1000), "price", ["l_quantity"]).drop("ssr", "sse", "sst"))
query(
    "linear_multiple",
    _sql(
        f"""WITH s AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_samp(a, a) AS saa, covar_samp(b, b) AS sbb, covar_samp(a, b) AS sab, covar_samp(a, y) AS say, covar_samp(b, y) AS sby, covar_samp(y, y) AS syy FROM (SELECT l_extendedprice/1000 AS y, l_quantity AS a, l_discount*100 AS b FROM lineitem)),
        c AS (SELECT *, saa*sbb-sab*sab AS det, (sbb*say-sab*sby)/(saa*sbb-sab*sab) AS b1, (saa*sby-sab*say)/(saa*sbb-sab*sab) AS b2 FROM s), e AS (SELECT *, (syy-b1*say-b2*sby)*(n-1)/(n-3) AS mse, my-b1*ma-b2*mb AS b0 FROM c),
        r AS (SELECT '(constant)' AS term, b0 AS b, sqrt(mse*(1.0/n+(ma*ma*sbb-2*ma*mb*sab+mb*mb*saa)/det/(n-1))) AS se, n-3 AS df, NULL::DOUBLE AS beta_std, NULL::DOUBLE AS vif FROM e UNION ALL SELECT 'l_quantity', b1, sqrt(mse*sbb/det/(n-1)), n-3, b1*sqrt(saa/syy), saa*sbb/det FROM e UNION ALL SELECT 'disc', b2, sqrt(mse*saa/det/(n-1)), n-3, b2*sqrt(sbb/syy), saa*sbb/det FROM e)
        SELECT *, b/se AS t, {Q.t_p("b/se", "df")} AS p FROM r""",
        "b, se, beta_std, vif, t, p",
        "term, df",
    ),
)(lambda t: R.linear(_priced(t), "price", ["l_quantity", "disc"]))


def _priced(t) -> DataFrame:
    return t("lineitem").withColumns({"price": F.col("l_extendedprice") / 1000, "disc": F.col("l_discount") * 100, "pos": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "returned": (F.col("l_returnflag") == "R").cast("int"), "open": (F.col("l_linestatus") == "O").cast("int")})


_CELLS = "SELECT count(*) FILTER (l_returnflag='R' AND l_linestatus='O')::DOUBLE AS a, count(*) FILTER (l_returnflag<>'R' AND l_linestatus='O')::DOUBLE AS b, count(*) FILTER (l_returnflag='R' AND l_linestatus<>'O')::DOUBLE AS c, count(*) FILTER (l_returnflag<>'R' AND l_linestatus<>'O')::DOUBLE AS d FROM lineitem"
query(
    "logistic_binary",
    _sql(f"WITH q AS ({_CELLS}), r AS (SELECT '(constant)' AS term, ln(c/d) AS b, sqrt(1/c+1/d) AS se FROM q UNION ALL SELECT 'open', ln(a*d/(b*c)), sqrt(1/a+1/b+1/c+1/d) FROM q) SELECT term, b, se, b/se AS z, {Q.z_p('(b/se)')} AS p, exp(b) AS odds_ratio, exp(b-1.96*se) AS ci_lo, exp(b+1.96*se) AS ci_hi FROM r", "b, se, z, p, odds_ratio, ci_lo, ci_hi", "term"),
)(lambda t: R.logistic(_priced(t), "returned", ["open"]).select("term", "b", "se", "z", "p", "odds_ratio", "ci_lo", "ci_hi"))
query("logistic")(lambda t: R.logistic(_priced(t), "returned", ["l_quantity", "disc"]))
query("classification")(lambda t: R.classification(_priced(t), "returned", ["l_quantity", "disc"]))
query("multinomial")(lambda t: R.multinomial(t("lineitem"), "l_returnflag", ["l_quantity"]))
query(
    "poisson_binary",
    _sql(f"WITH s AS (SELECT sum(l_linenumber) FILTER (l_linestatus='O')::DOUBLE AS y1, count(*) FILTER (l_linestatus='O')::DOUBLE AS n1, sum(l_linenumber) FILTER (l_linestatus<>'O')::DOUBLE AS y0, count(*) FILTER (l_linestatus<>'O')::DOUBLE AS n0 FROM lineitem), r AS (SELECT '(constant)' AS term, ln(y0/n0) AS b, sqrt(1/y0) AS se FROM s UNION ALL SELECT 'open', ln(y1/n1)-ln(y0/n0), sqrt(1/y0+1/y1) FROM s) SELECT term, b, se, b/se AS z, {Q.z_p('(b/se)')} AS p, exp(b) AS irr, exp(b-1.96*se) AS ci_lo, exp(b+1.96*se) AS ci_hi FROM r", "b, se, z, p, irr, ci_lo, ci_hi", "term"),
)(lambda t: R.poisson(_priced(t), "l_linenumber", ["open"]).select("term", "b", "se", "z", "p", "irr", "ci_lo", "ci_hi"))
query("poisson")(lambda t: R.poisson(_priced(t), "l_linenumber", ["l_quantity", "disc"]))
query("negative_binomial")(lambda t: R.negative_binomial(t("orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.floor(F.avg("o_totalprice") / 10_000).alias("x")), "k", ["x"]))
query("mediation_boot")(lambda t: R.mediation(t("part"), "p_size", ["p_retailprice"], "p_partkey", boots=5000))

# ---- multivariate, multilevel --------------------------------------------------------------


def _dims(t, n: int = 8) -> DataFrame:
    return t("embeddings").select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(n)))


_E8 = [f"e{i}" for i in range(8)]
query("efa")(lambda t: V.efa(_dims(t), _E8, 3))
query("factorability")(lambda t: V.factorability(_dims(t), _E8))
query("scree")(lambda t: V.scree(_dims(t), _E8))
query("cfa")(lambda t: V.cfa(_dims(t), {"f1": _E8[:4], "f2": _E8[4:]}))
query("sem")(lambda t: V.sem(_dims(t), {"a": _E8[:3], "b": _E8[3:6], "c": _E8[6:]}, [("a", "b"), ("b", "c")]))
query("lda")(lambda t: V.lda(_dims(t), "label", _E8[:4]))
query("lda_classify")(lambda t: V.lda_classify(_dims(t), "label", _E8[:4]))
query("kmeans")(lambda t: V.kmeans(_dims(t), _E8[:4], 4))
query("elbow")(lambda t: V.elbow(_dims(t), _E8[:4], 5))
query("hierarchical_clustering")(lambda t: V.hierarchical(_dims(t), _E8[:4], "vec_id", linkage="ward"))
query(
    "icc",
    _sql(
        f"""WITH g AS (SELECT c_nationkey AS g, count(*) AS n, avg(c_acctbal/1000) AS m, var_samp(c_acctbal/1000) AS v FROM customer GROUP BY 1), t AS (SELECT sum(n*m)/sum(n) AS grand FROM g),
        s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n*n) AS nn, sum(n*power(m-grand, 2)) AS ssb, sum((n-1)*v) AS ssw FROM g, t), u AS (SELECT *, (n-nn/n)/(k-1) AS n0, ssb/(k-1) AS msb, ssw/(n-k) AS msw FROM s),
        w AS (SELECT *, greatest(0.0, (msb-msw)/n0) AS var_between, msw AS var_within, msb/msw AS f FROM u), x AS (SELECT *, var_between/(var_between+msw) AS icc1, greatest(0.0, (msb-msw)/msb) AS icc2 FROM w)
        SELECT *, {Q.f_p("f", "(k-1)", "(n-k)")} AS p, 1+(n*1.0/k-1)*icc1 AS deff, n/(1+(n*1.0/k-1)*icc1) AS n_eff FROM x""",
        "n0, icc1, icc2, var_between, var_within, msb, msw, f, p, deff, n_eff",
        "k, n",
    ),
)(lambda t: H.icc(t("customer").withColumn("bal", F.col("c_acctbal") / 1000), "bal", "c_nationkey"))
query("hlm_two_level")(lambda t: H.hlm(t("lineitem").withColumn("price", F.col("l_extendedprice") / 1000), "price", "l_suppkey", ["l_quantity"], ["l_discount"], cross=True))
query("hlm_three_level")(lambda t: H.hlm(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("bal", F.col("c_acctbal") / 1000), "bal", "c_nationkey", ["c_custkey"], outer="n_regionkey"))
_POINTS = "SELECT l_quantity, l_extendedprice, md5('1:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey) AS h FROM lineitem ORDER BY h, l_quantity, l_extendedprice LIMIT 500"
_POINT_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
query("scatter_points", _sql(_POINTS, "l_quantity, l_extendedprice"))(lambda t: R.points(t("lineitem"), ["l_quantity", "l_extendedprice"], _POINT_KEY))
query(
    "residual_points",
    _sql(f"WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT a + b * l_quantity AS fitted, l_extendedprice - a - b * l_quantity AS residual FROM ({_POINTS}), m", "fitted, residual"),
)(lambda t: R.residual_points(t("lineitem"), "l_extendedprice", ["l_quantity"], _POINT_KEY))
query("random_slopes")(lambda t: X.random_slopes(t("lineitem").withColumn("price", F.col("l_extendedprice") / 1000), "price", "l_suppkey", ["l_quantity"], ["l_quantity"], ["l_discount"]))
query("cluster_effects")(lambda t: X.cluster_effects(t("lineitem").withColumn("price", F.col("l_extendedprice") / 1000), "price", "l_suppkey", ["l_quantity"], ["l_quantity"]))
query("nested_effects")(lambda t: X.nested_effects(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("bal", F.col("c_acctbal") / 1000), "bal", "c_nationkey", "n_regionkey"))
query(
    "nested_components",
    _sql(
        """WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS v, l_returnflag || l_linestatus || l_linenumber AS g2, l_returnflag AS g3 FROM lineitem), t AS (SELECT avg(v) AS m FROM d),
        g AS (SELECT g3, g2, CAST(count(*) AS DOUBLE) AS n, avg(v) AS m, sum(power(v - (SELECT m FROM t), 2)) AS q FROM d GROUP BY 1, 2), w AS (SELECT g3, g2, sum(power(d.v - g.m, 2)) AS e FROM d JOIN g USING (g3, g2) GROUP BY 1, 2),
        h AS (SELECT g3, count(*) AS k2, sum(n) AS n, sum(n * m) / sum(n) AS m, sum(n * n) AS nn FROM g GROUP BY 1), b AS (SELECT sum(g.n * power(g.m - h.m, 2)) AS ssb FROM g JOIN h USING (g3)),
        a AS (SELECT count(*) AS k3, CAST(sum(k2) AS BIGINT) AS k2, sum(n) AS n, sum(n * power(m - (SELECT m FROM t), 2)) AS ssa, sum(nn) AS nn, sum(nn / n) AS na, sum(n * n) AS nk FROM h),
        c AS (SELECT k3, k2, CAST(n AS BIGINT) AS n, ssa / (k3 - 1) AS ms_outer, ssb / (k2 - k3) AS ms_group, (SELECT sum(e) FROM w) / (n - k2) AS ms_error, (n - na) / (k2 - k3) AS c_group, (na - nn / n) / (k3 - 1) AS c_outer_group, (n - nk / n) / (k3 - 1) AS c_outer FROM a, b),
        x AS (SELECT *, ms_error AS sigma2, greatest(0.0, (ms_group - ms_error) / c_group) AS tau2 FROM c), y AS (SELECT *, greatest(0.0, (ms_outer - ms_error - c_outer_group * tau2) / c_outer) AS tau3 FROM x)
        SELECT *, (tau2 + tau3) / (sigma2 + tau2 + tau3) AS icc2, tau3 / (sigma2 + tau2 + tau3) AS icc3 FROM y""",
        "ms_outer, ms_group, ms_error, c_group, c_outer_group, c_outer, sigma2, tau2, tau3, icc2, icc3",
        "k3, k2, n",
    ),
)(lambda t: X.nested_components(t("lineitem").withColumn("g", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))), "l_quantity", "g", "l_returnflag"))

# ---- survival, series, inference -----------------------------------------------------------


def _lives(t) -> DataFrame:
    return t("lineitem").withColumns({"ev": (F.col("l_returnflag") == "R").cast("int"), "disc": F.col("l_discount") * 100})


_KM = """WITH c AS (SELECT l_linestatus AS grp, l_quantity AS t, count(*) FILTER (l_returnflag='R') AS d, count(*) AS m FROM lineitem GROUP BY 1, 2), r AS (SELECT *, CAST(sum(m) OVER (PARTITION BY grp ORDER BY t DESC) AS BIGINT) AS at_risk FROM c),
s AS (SELECT *, CASE WHEN max(CASE WHEN d=at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d<at_risk THEN ln(1-d*1.0/at_risk) ELSE 0 END) OVER w) END AS s, sum(CASE WHEN d<at_risk THEN d*1.0/(at_risk::DOUBLE*(at_risk-d)) ELSE 0 END) OVER w AS v FROM r WINDOW w AS (PARTITION BY grp ORDER BY t)),
k AS (SELECT grp, t, at_risk, d AS events, m-d AS censored, s, s*sqrt(v) AS se, greatest(0.0, s-1.96*s*sqrt(v)) AS ci_lo, least(1.0, s+1.96*s*sqrt(v)) AS ci_hi FROM s)
"""
query("kaplan_meier", _sql(_KM + "SELECT * FROM k", "t, s, se, ci_lo, ci_hi", "grp, at_risk, events, censored"))(lambda t: U.kaplan_meier(_lives(t), "l_quantity", "ev", "l_linestatus"))
query("median_survival", _sql(_KM + "SELECT grp, max(at_risk) AS n, CAST(sum(events) AS BIGINT) AS events, min(t) FILTER (s <= 0.5) AS median FROM k GROUP BY 1", "median", "grp, n, events"))(lambda t: U.median_survival(_lives(t), "l_quantity", "ev", "l_linestatus"))
query(
    "log_rank",
    _sql(
        f"""WITH c AS (SELECT l_linestatus AS grp, l_quantity AS t, count(*) FILTER (l_returnflag='R') AS d, count(*) AS m FROM lineitem GROUP BY 1, 2), a AS (SELECT t, sum(d) AS d, sum(m) AS m FROM c GROUP BY 1),
        r AS (SELECT t, d/sum(m) OVER (ORDER BY t DESC) AS h FROM a), cum AS (SELECT t, sum(h) OVER (ORDER BY t) AS h FROM r), g AS (SELECT grp, CAST(sum(d) AS BIGINT) AS o, sum(m*h) AS e FROM c JOIN cum USING (t) GROUP BY 1),
        s AS (SELECT sum(power(o-e, 2)/e) AS chi2, count(*)-1 AS df FROM g) SELECT grp, o, e, chi2, df, {Q.chi2_p("chi2", "df")} AS p FROM g, s""",
        "e, chi2, p",
        "grp, o, df",
    ),
)(lambda t: U.log_rank(_lives(t), "l_quantity", "ev", "l_linestatus"))
query("cox")(lambda t: U.cox(_lives(t), "l_quantity", "ev", ["disc", "l_linenumber"]))


def _daily(t) -> DataFrame:
    return t("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("y")).withColumn("o", F.unix_date("day"))


_DAY = "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS y FROM orders GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY day)-1 AS i, y FROM d)"
query("acf", _sql(_DAY + ", m AS (SELECT avg(y) AS m, var_pop(y) AS v, count(*) AS n FROM s), k AS (SELECT unnest(range(0, 6)) AS lag) SELECT CAST(lag AS BIGINT) AS lag, (SELECT sum((a.y-m)*(b.y-m)) FROM s a JOIN s b ON b.i = a.i + lag)/n/v AS acf FROM k, m", "acf", "lag"))(lambda t: T.acf(_daily(t), "y", "o", 5).drop("pacf"))
_LEVINSON = _DAY + """, m AS (SELECT avg(y) AS m, var_pop(y) AS v, count(*) AS n FROM s), a AS (SELECT list((SELECT sum((a.y-m)*(b.y-m)) FROM s a JOIN s b ON b.i = a.i + k.lag)/n/v ORDER BY k.lag) AS r FROM (SELECT unnest(range(1, 9)) AS lag) k, m),
p AS (WITH RECURSIVE t(k, phi, r) AS (SELECT 1, [r[1]], r FROM a UNION ALL SELECT k+1, list_append(list_transform(range(1, k+1), lambda j: phi[j] - new*phi[k+1-j]), new), r FROM (SELECT k, phi, r, (r[k+1] - list_sum(list_transform(range(1, k+1), lambda j: phi[j]*r[k+1-j])))/(1 - list_sum(list_transform(range(1, k+1), lambda j: phi[j]*r[j]))) AS new FROM t WHERE k < 8)) SELECT * FROM t)
SELECT CAST(k AS BIGINT) AS lag, r[k] AS acf, phi[k] AS pacf FROM p UNION ALL SELECT 0, 1.0, 1.0"""
query("pacf", _sql(_LEVINSON, "acf, pacf", "lag"))(lambda t: T.acf(_daily(t), "y", "o", 8))
query("difference", _sql(_DAY + " SELECT i-1 AS i, d AS y FROM (SELECT i, y-lag(y) OVER (ORDER BY i) AS d FROM s) WHERE d IS NOT NULL", "y", "i"))(lambda t: T.difference(_daily(t), "y", "o"))
query("arima")(lambda t: T.arima(_daily(t), "y", "o", 2, 1, 1))
query(
    "decompose",
    _sql(
        _DAY
        + """, t AS (SELECT i, y, CASE WHEN count(*) OVER w = 7 THEN avg(y) OVER w END AS trend FROM s WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), f AS (SELECT *, y-trend AS free, i % 7 AS k FROM t), x AS (SELECT k, avg(free) AS x FROM f GROUP BY 1), z AS (SELECT k, x-(SELECT avg(x) FROM x) AS seasonal FROM x),
        r AS (SELECT i, y, trend, seasonal, free, free-seasonal AS remainder FROM f JOIN z USING (k)) SELECT i, y, trend, seasonal, remainder, (SELECT greatest(0.0, least(1.0, 1-var_samp(remainder)/var_samp(free))) FROM r) AS strength FROM r""",
        "y, trend, seasonal, remainder, strength",
        "i",
    ),
)(lambda t: T.decompose(_daily(t), "y", "o", 7))


def _studies(t) -> DataFrame:
    return t("customer").groupBy(F.col("c_nationkey").cast("string").alias("study")).agg(F.avg(F.col("c_acctbal") / 1000).alias("y"), (F.var_samp(F.col("c_acctbal") / 1000) / F.count("*")).alias("v"))


_META = """WITH d AS (SELECT CAST(c_nationkey AS VARCHAR) AS study, avg(c_acctbal/1000) AS y, var_samp(c_acctbal/1000)/count(*) AS v FROM customer GROUP BY 1), s AS (SELECT count(*) AS k, sum(1/v) AS w, sum(1/(v*v)) AS w2, sum(y/v)/sum(1/v) AS fixed FROM d),
q AS (SELECT sum(power(y-fixed, 2)/v) AS q FROM d, s), t AS (SELECT k, fixed, q, k-1 AS df, greatest(0.0, (q-(k-1))/(w-w2/w)) AS tau2 FROM s, q), r AS (SELECT sum(y/(v+tau2))/sum(1/(v+tau2)) AS pooled, sqrt(1/sum(1/(v+tau2))) AS se FROM d, t)
"""
query("meta_analysis", _sql(_META + f"SELECT k, pooled, se, pooled-1.96*se AS ci_lo, pooled+1.96*se AS ci_hi, pooled/se AS z, {Q.z_p('(pooled/se)')} AS p, q, df, {Q.chi2_p('q', 'df')} AS q_p, greatest(0.0, 100*(q-df)/q) AS i2, tau2, fixed FROM t, r", "pooled, se, ci_lo, ci_hi, z, p, q, q_p, i2, tau2, fixed", "k, df"))(lambda t: I.meta_analysis(_studies(t), "y", "v"))
query("forest", _sql(_META + "SELECT study, y, sqrt(v) AS se, y-1.96*sqrt(v) AS ci_lo, y+1.96*sqrt(v) AS ci_hi, 100/(v+tau2)/(SELECT sum(1/(v+tau2)) FROM d, t) AS weight_pct FROM d, t", "y, se, ci_lo, ci_hi, weight_pct", "study"))(lambda t: I.forest(_studies(t), "study", "y", "v"))
query("bayes_ttest")(lambda t: I.bayes_ttest(t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), "c_acctbal", "c_mktsegment"))
query(
    "posterior_normal",
    _sql(
        """WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m, var_pop(l_quantity)*count(*) AS ss FROM lineitem),
        p AS (SELECT n*m/(0.01+n) AS mu, 0.01+n AS kn, 0.01+n/2 AS an, 0.01+ss/2+0.01*n*m*m/(2*(0.01+n)) AS bn FROM s), q AS (SELECT mu, sqrt(bn/(an*kn)) AS sd, 2*an AS v FROM p),
        x AS (SELECT i, mu, sd, v, mu+5*sd*(2*i/400.0-1) AS x FROM q, (SELECT unnest(range(0, 401)) AS i))
        SELECT CAST(i AS INTEGER) AS i, x, exp(lgamma(0.51)-lgamma(0.01)-0.5*ln(0.02*pi())-ln(10.0)-0.51*ln(1+x*x/(100*0.02))) AS prior, exp(lgamma((v+1)/2)-lgamma(v/2)-0.5*ln(v*pi())-ln(sd)-(v+1)/2*ln(1+power((x-mu)/sd, 2)/v)) AS posterior FROM x""",
        "x, prior, posterior",
        "i",
    ),
)(lambda t: I.posterior_normal(t("lineitem"), "l_quantity"))
query("posterior_effect")(lambda t: I.posterior_effect(t("lineitem"), "l_quantity", "l_linestatus"))
query("bayes_correlation")(lambda t: I.bayes_correlation(t("supplier"), "s_suppkey", "s_acctbal"))
query("bayes_normal", _sql("WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity)*count(*) AS ss FROM lineitem), p AS (SELECT n, 0.01+n AS kappa_n, 0.01+n/2.0 AS alpha_n, n*m/(0.01+n) AS post_mean, 0.01+ss/2+0.01*n*m*m/(2*(0.01+n)) AS beta_n FROM s), d AS (SELECT *, sqrt(beta_n/(alpha_n*kappa_n)) AS post_sd FROM p) SELECT *, post_mean-1.959963984540054*post_sd AS lo95, post_mean+1.959963984540054*post_sd AS hi95 FROM d", "post_mean, post_sd, lo95, hi95, kappa_n, alpha_n, beta_n", "n"))(lambda t: I.bayes_normal(t("lineitem"), "l_quantity"))
def _effects(t) -> DataFrame:
    """Distance of each segment's mean balance from that of all, in deviations."""
    c = t("customer").select("c_mktsegment", "c_acctbal")
    whole = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("sd"))
    by = c.groupBy("c_mktsegment").agg(F.count("*").alias("cases"), F.avg("c_acctbal").alias("own")).crossJoin(F.broadcast(whole))  # one row
    return by.select("c_mktsegment", "cases", (F.abs(F.col("own") - F.col("m")) / F.col("sd")).alias("effect"), F.lit(0.05).alias("alpha"))


def _tie(t) -> DataFrame:
    """Correlation of discount and quantity at each line number."""
    return t("lineitem").groupBy("l_linenumber").agg(F.count("*").alias("cases"), F.abs(F.corr("l_quantity", "l_discount")).alias("effect")).withColumn("alpha", F.lit(0.05))


_TIE = "(SELECT l_linenumber, count(*) AS cases, abs(corr(l_quantity, l_discount)) AS effect FROM lineitem GROUP BY 1)"
_Z = Q.norm_inv("CAST(0.975 AS DOUBLE)")
query("power_solve")(lambda t: I.solve_power(_effects(t).withColumn("power", F.lit(0.8)), "n", "t_two").select("c_mktsegment", "effect", "n"))
query("power_curve")(lambda t: I.power_curves(_effects(t), "t_two", most=100).select("c_mktsegment", "effect", "n", "power"))
query(
    "power_curve_correlation",
    _sql(f"SELECT l_linenumber, effect, n, greatest(0.0001, least(0.9999, {Q.norm_cdf(f'(atanh(effect)*sqrt(n-3) - {_Z})')})) AS power FROM {_TIE}, (SELECT unnest(range(5, 201, 5)) AS n)", "effect, power", "l_linenumber, n"),
)(lambda t: I.power_curves(_tie(t), "correlation").select("l_linenumber", F.col("n").cast("bigint").alias("n"), "effect", "power"))
query(
    "sensitivity_curve",
    _sql(f"SELECT l_linenumber, n, tanh((({_Z}) + ({Q.norm_inv('CAST(0.8 AS DOUBLE)')}))/sqrt(n-3)) AS least_effect, effect AS found FROM (SELECT l_linenumber, effect, CAST(cases * i // 10 AS BIGINT) AS n FROM {_TIE}, (SELECT unnest(range(1, 11)) AS i)) WHERE n > 9", "least_effect, found", "l_linenumber, n"),
)(
    lambda t: I.solve_power(_tie(t).select("l_linenumber", F.col("effect").alias("found"), "alpha", F.lit(0.8).alias("power"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.floor(F.col("cases") * i / 10))).alias("n")).where("n > 9"), "effect", "correlation").select(
        "l_linenumber", "n", F.col("effect").alias("least_effect"), "found"
    )
)
query("mice_convergence")(lambda t: I.mice_convergence(_holes(t("lineitem")).withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber")), ["qty", "disc", "tax"], "id", sets=3, cycles=4))
query("mice_pooled")(lambda t: I.mice_pooled(_holes(t("lineitem")), ["qty", "disc", "tax"], sets=5, cycles=5))

# ---- rows and columns ----------------------------------------------------------------------

_KEY = "l_orderkey, l_linenumber"


def _lines(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")


query("search", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) LIKE '%n_1%' OR CAST(n_nationkey AS VARCHAR) LIKE '%n_1%'")(lambda t: C.search(t("nation").select("n_nationkey", "n_name"), "N_1"))
query("page", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")(lambda t: C.page(t("part").select("p_partkey", "p_name"), 100, "p_partkey"))
query("transform_zscore", _sql("SELECT l_orderkey, l_linenumber, (l_quantity-(SELECT avg(l_quantity) FROM lineitem))/(SELECT stddev_samp(l_quantity) FROM lineitem) AS z FROM lineitem", "z", _KEY))(lambda t: C.transform(_lines(t), "l_quantity", "zscore", "z").select("l_orderkey", "l_linenumber", "z"))
query("transform_minmax", _sql("SELECT l_orderkey, l_linenumber, (l_quantity-(SELECT min(l_quantity) FROM lineitem))/(SELECT max(l_quantity)-min(l_quantity) FROM lineitem) AS z FROM lineitem", "z", _KEY))(lambda t: C.transform(_lines(t), "l_quantity", "minmax", "z").select("l_orderkey", "l_linenumber", "z"))
query("transform_rank", _sql(f"SELECT l_orderkey, l_linenumber, {_rank('l_quantity')} AS z FROM lineitem", "z", _KEY))(lambda t: C.transform(_lines(t), "l_quantity", "rank", "z").select("l_orderkey", "l_linenumber", "z"))
query("transform_ln", _sql("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN ln(l_discount) END AS z FROM lineitem", "z", _KEY))(lambda t: C.transform(_lines(t), "l_discount", "ln", "z").select("l_orderkey", "l_linenumber", "z"))
query("compute", _sql("SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_discount, 0) AS z FROM lineitem", "z", _KEY))(lambda t: C.compute(_lines(t), "z", "try_divide(l_quantity, l_discount)").select("l_orderkey", "l_linenumber", "z"))
query("recode_ranges", "SELECT z, count(*) AS n FROM (SELECT CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'low' WHEN l_quantity BETWEEN 10 AND 40 THEN 'mid' END AS z FROM lineitem) GROUP BY 1")(lambda t: C.recode_ranges(_lines(t), "l_quantity", [(1, 10, "low"), (10, 40, "mid")], "z").groupBy("z").agg(F.count("*").alias("n")))
query("recode_binary", "SELECT z, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 END AS z FROM lineitem) GROUP BY 1")(lambda t: C.recode_binary(_lines(t), "l_returnflag", "N", "R", "z").groupBy("z").agg(F.count("*").alias("n")))
query("recode_map", _sql("SELECT z, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'N' THEN 10.0 WHEN 'R' THEN 20.0 END AS z FROM lineitem) GROUP BY 1", "z", "n"))(lambda t: C.recode_map(_lines(t), "l_returnflag", {"N": "10", "R": "20"}, "z").groupBy("z").agg(F.count("*").alias("n")))
query("filter_cases", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'")(lambda t: C.filter_cases(_lines(t), "l_quantity > 40 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber"))
query("complete_cases", f"SELECT l_orderkey, l_linenumber FROM {_HOLES} WHERE qty IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL")(lambda t: C.complete_cases(_holes(t("lineitem"))).select("l_orderkey", "l_linenumber"))
query("drop_outliers", "WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) SELECT doc_id, n_chars FROM documents, q WHERE n_chars BETWEEN a-1.5*(b-a) AND b+1.5*(b-a)")(lambda t: C.drop_outliers(t("documents").select("doc_id", "n_chars"), "n_chars"))
query("weighted_mean", _sql("SELECT CAST(sum(l_linenumber) AS BIGINT) AS n, sum(l_linenumber*l_quantity)/sum(l_linenumber) AS mean FROM lineitem", "mean", "n"))(lambda t: replicate(_lines(t), "l_linenumber").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")))
query("effective_n", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS n_weighted FROM lineitem")(lambda t: C.effective_n(_lines(t), "l_linenumber"))
query("levels", "SELECT o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1")(lambda t: C.levels(t("orders"), "o_orderpriority"))
query("fill_constant", _sql(f"SELECT l_orderkey, l_linenumber, coalesce(qty, -1) AS qty FROM {_HOLES}", "qty", _KEY))(lambda t: C.fill_constant(_holes(t("lineitem")), "qty", -1.0, "l_orderkey", "empty").select("l_orderkey", "l_linenumber", "qty"))
query("fill_sequence", _sql("SELECT p_partkey, 5+2.0*(row_number() OVER (ORDER BY p_partkey)-1) AS p_retailprice FROM part", "p_retailprice", "p_partkey"))(lambda t: C.fill_sequence(t("part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 5, 2))
query("delete_cases", "SELECT p_partkey FROM part WHERE p_partkey > 50")(lambda t: C.delete_cases(t("part").select("p_partkey"), "p_partkey", t("part").where("p_partkey <= 50").select("p_partkey")))
for _how, _value in {"mean": "(SELECT avg(qty) FROM h)", "median": "(SELECT quantile_cont(qty, 0.5) FROM h)", "min": "(SELECT min(qty) FROM h)", "zero": "0"}.items():
    query(f"impute_{_how}", _sql(f"WITH h AS {_HOLES} SELECT l_orderkey, l_linenumber, coalesce(qty, {_value}) AS qty FROM h", "qty", _KEY))(lambda t, how=_how: C.impute(_holes(t("lineitem")), "qty", how).select("l_orderkey", "l_linenumber", "qty"))
query("impute_all", _sql(f"WITH h AS {_HOLES} SELECT l_orderkey, l_linenumber, coalesce(qty, (SELECT avg(qty) FROM h)) AS qty, coalesce(disc, (SELECT avg(disc) FROM h)) AS disc, coalesce(tax, (SELECT avg(tax) FROM h)) AS tax FROM h", "qty, disc, tax", _KEY))(lambda t: C.impute_all(_holes(t("lineitem"))))


def _csv_back(t) -> DataFrame:
    import uuid

    d = t("nation")
    path = f"{folder(d.sparkSession)}/{uuid.uuid4().hex}-csv"
    code = F.concat(F.col("n_nationkey").cast("string"), F.lit("d"))  # a code, no number
    S.write_csv(d.select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("n_name"), code.alias("code")), path)
    return S.read_csv(d.sparkSession, path).select("n_nationkey", "n_name", "code")


def _catalogued(t) -> DataFrame:
    """Orders by priority in a catalogue of datasets: added, one of them replaced from itself, renamed and deleted."""
    import uuid

    d = t("orders")
    sets = S.Datasets(d.sparkSession, f"{folder(d.sparkSession)}/{uuid.uuid4().hex}-datasets")
    sets.add("all", d.select("o_orderkey", "o_orderstatus", "o_totalprice"))
    sets.add("open", sets.get("all").where("o_orderstatus = 'O'"))
    sets.replace("open", sets.get("open").withColumn("o_totalprice", F.col("o_totalprice") * 2))
    sets.rename("open", "doubled")
    sets.delete("all")
    sets.vacuum()
    return sets.get().withColumn("dataset", F.lit(sets.active()))


query("datasets", _sql("SELECT o_orderkey, o_orderstatus, o_totalprice * 2 AS o_totalprice, 'doubled' AS dataset FROM orders WHERE o_orderstatus = 'O'", "o_totalprice", "o_orderkey, o_orderstatus, dataset"))(_catalogued)
query("csv_round_trip", _sql("SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS n_name, n_nationkey || 'd' AS code FROM nation", "n_nationkey", "n_name, code"))(_csv_back)

from statloom.plans import parts as _parts  # noqa: E402, F401  registers further queries
