"""Operators on rows and columns of a case table: search, sort, edit, fill, transform, recode, filter.

Computed columns and filters take Spark expressions (a Column, or SQL text that Spark
parses), instead of a language of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.special import finite
from statloom.plans.stats import number, numbers, quantiles, running, value_counts


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.expr(x)


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def is_missing(df: DataFrame, c: str) -> Column:
    """Null, empty text, NaN or infinite."""
    kind = df.schema[c].dataType.typeName()
    bad = _name(c).isNull()
    if kind == "string":
        return bad | (_name(c) == "")
    return bad | F.isnan(_name(c)) | (F.abs(_name(c)) == float("inf")) if kind in ("double", "float") else bad


def search(df: DataFrame, text: str) -> DataFrame:
    """Cases where any column holds ``text``, in any case."""
    hit = [F.lower(F.coalesce(_name(c).cast("string"), F.lit(""))).contains(text.lower()) for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, hit)) if hit else df


def sort_cases(df: DataFrame, by: str, case_id: str, descending: bool = False) -> DataFrame:
    """By one column; missing values count as lowest; equal values in order of ``case_id``."""
    return df.orderBy(_name(by).desc_nulls_last() if descending else _name(by).asc_nulls_first(), _name(case_id))


def page(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(_name(order)).limit(n)


def insert_cases(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new, allowMissingColumns=True)


def edit_cell(df: DataFrame, case_id: str, at, column: str, value) -> DataFrame:
    return df.withColumn(column, F.when(_name(case_id) == at, F.lit(value)).otherwise(_name(column)))


def delete_cases(df: DataFrame, case_id: str, ids: DataFrame) -> DataFrame:
    """``df`` without the ids in the first column of ``ids``."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(case_id)).distinct(), case_id, "left_anti").select(df.columns)


def _filled(df: DataFrame, column: str, case_id: str, mode: str, first, last) -> Column:
    if mode == "all":
        return F.lit(True)
    return is_missing(df, column) if mode == "empty" else _name(case_id).between(first, last)


def fill_constant(df: DataFrame, column: str, value, case_id: str, mode: str = "all", first=None, last=None) -> DataFrame:
    """``mode``: all, empty (missing cells), range (case ids first to last). No number into a numeric column: null."""
    kind = df.schema[column].dataType
    new = F.lit(value).try_cast(kind) if isinstance(value, str) else F.lit(value).cast(kind)
    return df.withColumn(column, F.when(_filled(df, column, case_id, mode, first, last), new).otherwise(_name(column)))


def fill_sequence(df: DataFrame, column: str, case_id: str, start: float = 1.0, step: float = 1.0, mode: str = "all", first=None, last=None) -> DataFrame:
    """start, start + step, ... over the filled cases in order of ``case_id``; others stay."""
    hit = _filled(df, column, case_id, mode, first, last)
    order = running(df.where(hit).select(_name(case_id).alias("__id"), F.lit(1).cast("bigint").alias("k")), "__id", ["k"])
    value = order.select(F.col("__id").alias(case_id), (start + step * (F.col("cum_k") - 1)).cast(df.schema[column].dataType).alias("__v"), F.lit(True).alias("__hit"))
    out = df.join(value, case_id, "left").withColumn(column, F.when(F.col("__hit"), F.col("__v")).otherwise(_name(column)))
    return out.select(df.columns)


def add_variable(df: DataFrame, name: str, kind: str = "double", **meta) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"{name} is there already")
    return df.withColumn(name, F.lit(None).cast(kind)).withMetadata(name, meta)


def retype(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Numeric (double) or string; what is no number becomes null."""
    return df.withColumn(name, number(df, name) if kind in ("double", "Numeric") else _name(name).cast("string"))


def relabel(df: DataFrame, name: str, **meta) -> DataFrame:
    """Change label, measure, role, decimals or width of a variable, kept as its metadata; None removes an entry."""
    old = dict(df.schema[name].metadata)
    return df.withMetadata(name, {k: v for k, v in (old | meta).items() if v is not None})


def reorder(df: DataFrame, names: list[str]) -> DataFrame:
    """The named variables first, in that order, then the others as they were."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such variables: {missing}")
    return df.select(*(_name(c) for c in [*names, *(c for c in df.columns if c not in names)]))


def delete_variables(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the named variables; at least one has to stay."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such variables: {missing}")
    if set(names) >= set(df.columns):
        raise ValueError("a table needs a variable")
    return df.drop(*names)


def transform(df: DataFrame, column: str, how: str, name: str) -> DataFrame:
    """New column ``name``: zscore, minmax, center, ln, log10, sqrt, square or rank of ``column``.

    What is no finite number, or undefined, becomes null; a constant gives zscore and
    minmax 0; rank is the average rank over valid values.
    """
    if name in df.columns:
        raise ValueError(f"{name} is there already")
    x = number(df, column)
    plain = {"ln": F.when(x > 0, F.log(x)), "log10": F.when(x > 0, F.log10(x)), "sqrt": F.when(x >= 0, F.sqrt(x)), "square": finite(x * x)}
    if how in plain:
        return df.withColumn(name, plain[how])
    if how == "rank":
        from statloom.plans.stats import ranks

        own = df.withColumn("__x", x)
        r = ranks(own.select("__x"), "__x").select("__x", F.col("rank").alias(name))
        return own.join(r, "__x", "left").select(*(_name(c) for c in df.columns), name)
    if how not in ("zscore", "minmax", "center"):
        raise ValueError(how)
    s = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    m, sd, lo, hi = (0.0 if v is None else float(v) for v in s)
    done = {
        "center": x - m,
        "zscore": (x - m) / sd if sd else F.when(x.isNotNull(), F.lit(0.0)),
        "minmax": (x - lo) / (hi - lo) if hi > lo else F.when(x.isNotNull(), F.lit(0.0)),
    }
    return df.withColumn(name, done[how])


def compute(df: DataFrame, name: str, expression) -> DataFrame:
    """New column from a Spark expression; results that are not finite are null."""
    out = df.withColumn(name, _col(expression))
    return out.withColumn(name, finite(_name(name).cast("double"))) if out.schema[name].dataType.typeName() in ("double", "float") else out


def recode_ranges(df: DataFrame, column: str, rules: list[tuple[float, float, str]], name: str) -> DataFrame:
    """(low, high, text): inclusive bounds, first match wins, otherwise null."""
    x, out = number(df, column), F.lit(None).cast("string")
    for low, high, text in reversed(rules):
        out = F.when(x.between(low, high), F.lit(text)).otherwise(out)
    return df.withColumn(name, out)


def recode_binary(df: DataFrame, column: str, zero: str, one: str, name: str) -> DataFrame:
    x = _name(column).cast("string")
    return df.withColumn(name, F.when(x == zero, F.lit(0)).when(x == one, F.lit(1)))


def recode_map(df: DataFrame, column: str, to: dict[str, str], name: str) -> DataFrame:
    """Exact values; the result is numeric if all targets are."""
    pairs = F.create_map(*(F.lit(x) for kv in to.items() for x in kv))
    out = F.try_element_at(pairs, _name(column).cast("string"))

    def numeric(v) -> bool:
        try:
            float(v)
        except ValueError:
            return False
        return True

    return df.withColumn(name, out.cast("double") if all(map(numeric, to.values())) else out)


def filter_cases(df: DataFrame, condition) -> DataFrame:
    """Cases where the Spark expression is true (a comparison with null is not).

    No case at all raises ValueError, so that a wrong filter never empties a table unseen.
    """
    out = df.where(F.coalesce(_col(condition), F.lit(False)))
    if out.isEmpty():
        raise ValueError("no case matches the filter")
    return out


def complete_cases(df: DataFrame) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (~is_missing(df, c) for c in df.columns))) if df.columns else df


def drop_outliers(df: DataFrame, column: str, fence: float = 1.5) -> DataFrame:
    """Cases within ``fence`` interquartile ranges of the quartiles; missing values stay."""
    q = quantiles(numbers(df, {"v": column}), "v", {"q1": 0.25, "q3": 0.75}).first()
    if q is None or q["q1"] is None:
        return df
    reach = fence * (q["q3"] - q["q1"])
    x = number(df, column)
    return df.where(x.isNull() | x.between(q["q1"] - reach, q["q3"] + reach))


def effective_n(df: DataFrame, weight: str) -> DataFrame:
    """(n, n_weighted): cases, and the sum of rounded positive weights."""
    w = number(df, weight)
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(w > 0, F.floor(w + 0.5))), F.lit(0)).cast("bigint").alias("n_weighted"))


def levels(df: DataFrame, column: str) -> DataFrame:
    """(level, n) by value; null is no level."""
    return df.where(_name(column).isNotNull()).groupBy(_name(column).cast("string").alias("level")).agg(F.count("*").alias("n")).orderBy("level")


def impute(df: DataFrame, column: str, how: str = "mean") -> DataFrame:
    """``df`` with missing numbers of ``column`` filled: mean, median, mode, zero, min or max of the valid ones.

    Of several modes the smallest.
    """
    v = numbers(df, {"v": column})
    if how == "zero":
        value = 0.0
    elif how == "median":
        value = quantiles(v, "v", {"m": 0.5}).select("m").first()
        value = value and value[0]
    elif how == "mode":
        value = value_counts(v, "v").orderBy(F.desc("n"), "v").select("v").first()
        value = value and value[0]
    else:
        value = v.agg({"mean": F.avg, "min": F.min, "max": F.max}[how]("v")).first()[0]
    return df.withColumn(column, F.coalesce(number(df, column), F.lit(value).cast("double")))


def impute_all(df: DataFrame) -> DataFrame:
    """The mean for every missing number of every numeric column, from one pass."""
    cols = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    if not cols:
        return df
    means = df.agg(*(F.avg(number(df, c)).alias(c) for c in cols)).first()
    return df.withColumns({c: F.coalesce(number(df, c), F.lit(means[c]).cast("double")) for c in cols})
