"""URL filter by the ratio of two character language models, for what no rule decides.

Rules (a host, its subdomains, a path's start) allow or block. The URLs that they decide
train two Markov models of variable order, one of allowed and one of blocked URLs: the
probability of a character mixes, from the longest context that was seen down to none,
what followed that context, by Witten and Bell's smoothing. What rules leave open is
decided by the difference of both log-likelihoods, divided by the number of characters.

Everything is counted over the whole table. A position of a URL needs its window alone (its
character and the ``order`` before it), so each distinct window is weighed once, and a URL
adds up the weights of its windows. Windows that are frequent, of which there can't be
many, are broadcast for that; the rest has no frequent key to join on.

The threshold comes from scores that no model gave to a URL it had counted: the URLs fall
into two halves, and each is scored by the counts of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import materialize, quoted

#: Characters of the longest context.
ORDER = 4
#: Printable ASCII, one character for all others, and the end.
ALPHABET = 96
START, END, OTHER = "\x01", "\x02", "\x7f"
#: Windows that make up at least this share of all positions are broadcast: 1 / SHARE of them at most.
SHARE = 1 / 200_000
#: Scores are counted in bins of 1 / BINS, up to FAR bins from zero, for the threshold.
BINS, FAR = 100, 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts of a window: allowed and blocked, in halves 0 and 1.
_COUNTS = ("a0", "a1", "b0", "b1")
#: What each model adds up: all, and for the URLs of a half those of the other.
_MODELS = {"a": "a0 + a1", "b": "b0 + b1", "c0": "a1", "d0": "b1", "c1": "a0", "d1": "b0"}
_SCORES = {"all": ("a", "b"), "half0": ("c0", "d0"), "half1": ("c1", "d1")}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty if null or without ``://``."""
    cut = [F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(cut[0], _UPPER, _LOWER), cut[1]


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest of ``rules`` (verdict, host and path) that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _text(url: Column) -> Column:
    """What the models read: the URL after its scheme, the host lower-cased."""
    url = F.coalesce(url, F.lit(""))
    host = host_and_path(url)[0]
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(url)
    return F.regexp_replace(F.concat(host, F.substring(rest, F.length(host) + 1, F.length(rest))), "[^!-~]", OTHER)


def _windows(texts: DataFrame, order: int, *others: str) -> DataFrame:
    """A row for each position of each text: the window that ends there."""
    padded = F.concat(F.lit(START * order), F.col("t"), F.lit(END))
    rows = texts.select(*others, padded.alias("s"), F.explode(F.sequence(F.lit(1), F.length("t") + 1)).alias("p"))
    return rows.select(*others, F.substring(F.col("s"), F.col("p"), F.lit(order + 1)).alias("w"))


def _shares(windows: DataFrame, order: int) -> DataFrame:
    """(g, p and q of each model) for every window and every shorter end of one: the share of the last
    character after its context, and the share that smoothing leaves to the next shorter context."""
    ends = windows.select(F.explode(F.array(*(F.substring("w", order + 2 - n, n) for n in range(1, order + 2)))).alias("g"), *_COUNTS)
    grams = materialize(ends.groupBy("g").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "grams")
    grams = grams.select("g", F.expr("substring(g, 1, length(g) - 1)").alias("x"), *(F.expr(v).alias(m) for m, v in _MODELS.items()))
    seen = grams.groupBy("x").agg(*(F.sum(m).alias("n" + m) for m in _MODELS), *(F.count_if(F.col(m) > 0).alias("k" + m) for m in _MODELS))
    mass = lambda m: F.col("n" + m) + F.col("k" + m)
    share = lambda m: F.when(mass(m) > 0, F.col(m) / mass(m)).otherwise(0.0).alias("p" + m)
    left = lambda m: F.when(mass(m) > 0, F.col("k" + m) / mass(m)).otherwise(1.0).alias("q" + m)
    return materialize(grams.join(seen, "x").select("g", *(f(m) for m in _MODELS for f in (share, left))), "shares")


def weigh(windows: DataFrame, order: int = ORDER) -> DataFrame:
    """(w, all, half0, half1): log ratio of both models' probabilities of a window's last character after
    the others. ``windows``: (w, counts), each window once."""
    shares = _shares(windows, order)
    lower = None
    for n in range(1, order + 2):
        level = shares.where(F.length("g") == n)
        if lower is None:
            found = level.select("g", *((F.col("p" + m) + F.col("q" + m) / ALPHABET).alias(m) for m in _MODELS))
        else:
            level = level.withColumn("y", F.expr(f"substring(g, 2, {n - 1})"))
            # of one and two characters there are at most 97 and 97 ** 2; longer ends have at most 97 rows a key
            level = level.join(F.broadcast(lower) if n <= 3 else lower, "y")
            found = level.select("g", *((F.col("p" + m) + F.col("q" + m) * F.col(m)).alias(m) for m in _MODELS))
        lower = found.withColumnRenamed("g", "y")
    return found.select(F.col("g").alias("w"), *(F.log(F.col(a) / F.col(b)).alias(s) for s, (a, b) in _SCORES.items()))


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    """The cut with the best balanced accuracy, of (bin, allowed, blocked); the lowest of several, in the middle
    of the gap where it falls. Zero if one kind is missing."""
    bins = sorted(bins)
    good, bad = (sum(x[i] for x in bins) for i in (1, 2))
    if not good or not bad:
        return 0.0
    best, a, b = [(good * bad - bad * good, bins[0][0], bins[0][0])], good, bad
    for at, (k, n, m) in enumerate(bins):
        a, b = a - n, b - m  # cut after this bin
        best.append((a * bad - b * good, k + 1, bins[at + 1][0] if at + 1 < len(bins) else k + 1))
    _, low, high = max(best, key=lambda x: (x[0], -x[1]))
    return (low + high) // 2 / BINS


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """(id_col, host, path, rule, score, verdict) for each row of ``pages``; score only where no rule fits.

    ``rules``: ("allow" or "block", host and path). The longest rule that fits decides; the
    others are allowed if their score reaches the threshold. Distinct URLs are counted once, so a
    URL that many rows share doesn't outweigh others. Null URLs and those without ``://`` have no host;
    they are judged by their characters, if any. Without URLs of both kinds, scores are held against zero.
    Repeated rows stay repeated; null ids too. Extra columns of any name are ignored. An empty
    table gives an empty result.
    """
    rows = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("u"))
    host, path = host_and_path(F.col("u"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), _text(F.col("u")).alias("t"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("says"), "t"), "urls")
    even = F.substring(F.md5("t"), 1, 1).isin(*"02468ace")
    texts = rows.select("says", "t").distinct().select(F.monotonically_increasing_id().alias("n"), "says", "t", F.when(even, 0).otherwise(1).alias("half"), (F.length("t") + 1).alias("chars"))
    texts = materialize(texts, "texts")
    kinds = [F.count_if((F.col("says") == s) & (F.col("half") == h)).alias(f"{k}{h}") for k, s in (("a", "allow"), ("b", "block")) for h in (0, 1)]
    windows = materialize(_windows(texts, order, "says", "half").groupBy("w").agg(*kinds, F.count("*").alias("total")), "windows")
    weights = materialize(weigh(windows, order).join(windows.select("w", "total"), "w"), "weights")
    (positions,) = weights.agg(F.coalesce(F.sum("total"), F.lit(0))).first()
    often = F.col("total") >= positions * SHARE

    seen = _windows(texts, order, "n")
    sums = [F.sum(s).alias(s) for s in _SCORES]
    frequent = F.broadcast(weights.where(often).drop("total"))
    rare = seen.join(frequent.select("w"), "w", "left_anti").join(weights.where(~often).drop("total"), "w")
    added = seen.join(frequent, "w").groupBy("n").agg(*sums).unionAll(rare.groupBy("n").agg(*sums)).groupBy("n").agg(*sums)
    each = lambda s: F.round(F.col(s) / F.col("chars"), 6)
    other = F.when(F.col("half") == 0, each("half0")).otherwise(each("half1"))
    scored = materialize(texts.join(added, "n").select("says", "t", each("all").alias("score"), other.alias("held")), "scored")
    bins = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(F.col("held") * BINS))).cast("int").alias("bin")
    counts = scored.where("says is not null").groupBy(bins).agg(F.count_if(F.col("says") == "allow"), F.count_if(F.col("says") == "block")).collect()  # 2 * FAR + 1 at most
    cut = _threshold([tuple(r) for r in counts])
    scores = scored.where("says is null").select("t", "score")
    told = rows.where("says is not null").select("id", "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.col("says").alias("verdict"))
    rest = rows.where("says is null").join(scores, "t").select("id", "host", "path", "rule", "score", F.when(F.col("score") >= cut, "allow").otherwise("block").alias("verdict"))
    return told.unionAll(rest).withColumnRenamed("id", id_col)
