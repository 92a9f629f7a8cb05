"""Benchmark decontamination by template canonicalisation.

Numbers, numbers with a unit and names become typed placeholders, so a question asked again
with other values has the same template. Short windows of words are hashed and joined with
those of the benchmark, in two forms: with placeholders for names, and plain (lower-cased,
names as written), which finds copies in another case. Hits are summed over bands of
neighbouring offsets, so that inserted and deleted words don't split a passage. What counts
is how many of the item's words the hits cover; values that contradict each other lower it.

Items with no window to speak of (too short, or hardly a literal word) are searched whole:
values included, and as one template of their words and signs, if these say enough and the
values that are put in fit each other.

Everything here is DataFrame code. A document's windows exist only as rows between the
explode and the join of one stage; what is shuffled are hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import materialize, whole_row

WINDOW = 5
#: Fewest literal words in a window; windows made of placeholders alone say nothing.
LITERALS = 3
#: Least share of an item's words that a document has to hold within one band of offsets.
COVERAGE = 0.5
#: So many words of an item count whatever its length (a quote); fewer than LEAST only if they are the whole item.
QUOTE, LEAST = 13, 8
#: Words and signs that are no placeholders, for an item to be searched as one template.
SHORT_LITERALS = 3
#: Words that each slot costs whose value contradicts the item's.
CONFLICT = 8
#: Shift of offsets that a band tolerates at least; bands are twice as wide and overlap.
SHIFT = 8
#: Up to so many bytes the benchmark's windows are broadcast. A larger table is joined by a
#: shuffle of those windows that pass a bit table of 2**FILTER_BITS words of 64 bits.
BROADCAST_BYTES = 64 << 20
FILTER_BITS = 20
#: Parts into which the hits of one window are dealt in that shuffle.
SALT = 16
#: Contaminated rows (16 bytes each) that are broadcast for removal; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Units that follow a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "min", "h", "hz", "w", "kw", "v", "a",
    "inch", "inches", "feet", "foot", "yards", "miles", "pounds", "ounces", "litres", "liters", "meters", "metres",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent",
)
NUMBER, UNIT, NAME = "0", "1", "2"
TEMPLATE, PLAIN = 0, 1
#: Form of whole items of k words, values included: EXACT + min(k, WINDOW).
EXACT = 10
#: Forms of whole items of k words and signs as templates, with placeholders for names and lower-cased: these + min(k, WINDOW).
SHORT, SHORT_PLAIN = 20, 30
#: A number with separators and decimals, and its unit.
_NUMBER = r"[0-9]+(?:[.,'\x{A0}\x{202F}][0-9]+)*+(?:[ \x{A0}]?(?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r"|%|°C|[$€£])(?![\p{L}\p{N}]))?"
#: Names: words of a capital and small letters, in a row.
_NAME = r"\p{Lu}\p{Ll}++(?![\p{L}\p{N}])(?: \p{Lu}\p{Ll}++(?![\p{L}\p{N}]))*+"
_WORD = r"[\p{L}\p{N}&&[^0-9]][\p{L}\p{N}]*+"
_SIGN = r"[-+*/=<>^?×÷±√≤≥≠]"
_PATTERN = {TEMPLATE: f"{_NUMBER}|{_NAME}|{_WORD}", PLAIN: f"{_NUMBER}|{_WORD}", SHORT: f"{_NUMBER}|{_NAME}|{_WORD}|{_SIGN}", SHORT_PLAIN: f"{_NUMBER}|{_WORD}|{_SIGN}"}


def raw_words(text: Column, form: int = TEMPLATE) -> Column:
    """Numbers with their units, names (template forms), words and signs (short forms), as written (plain forms: lower-cased)."""
    return F.regexp_extract_all(F.lower(text) if form in (PLAIN, SHORT_PLAIN) else text, F.lit(_PATTERN[form]), F.lit(0))


def masked(raw: Column, form: int = TEMPLATE) -> Column:
    """Lower-cased words with placeholders, word for word beside ``raw``: one for a number, one for
    a number with a unit and, in the template form, one for a name of any number of words."""

    def each(w: Column) -> Column:
        out = F.when((w >= "0") & (w < ":") if form >= SHORT else w < ":", F.when(F.right(w, F.lit(1)).between("0", "9"), NUMBER).otherwise(UNIT))
        if form in (PLAIN, SHORT_PLAIN):
            return out.otherwise(w)
        return out.when((F.initcap(w) == w) & (F.lower(w) != w) & (F.length(w) > 1), NAME).otherwise(F.lower(w))

    return F.transform(raw, each)


def _marked(w: Column) -> Column:
    return w.isin(NUMBER, UNIT, NAME)


def _hash(form: Column, words: list[Column]) -> Column:
    return F.xxhash64(form, *words)


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", literals: int = LITERALS) -> DataFrame:
    """(h, item_id, form, bpos, raw, n_windows, n_words): distinct windows of each item in each form.

    A window needs ``literals`` words that are no placeholders. ``n_words`` counts the words
    that an item's windows cover in a form; fewer than ``LEAST`` are none. Items that are short,
    or have no other form, are there in an exact form with all their words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(F.col(item_col).alias("item_id"), text.alias("t"))
    forms = []
    for form in (TEMPLATE, PLAIN):
        words = items.select("item_id", raw_words(F.col("t"), form).alias("raw")).select("item_id", "raw", masked(F.col("raw"), form).alias("words"))
        forms.append(_cut(words.where(F.size("words") >= LEAST), F.lit(form), WINDOW).where(F.size(F.filter("words", lambda w: ~_marked(w))) >= literals))
    # a window that an item repeats is one
    wins = forms[0].unionAll(forms[1]).withColumn("h", F.xxhash64("form", "words")).groupBy("item_id", "form", "h").agg(F.min_by(F.struct("bpos", "words", "raw"), "bpos").alias("x"))
    wins = materialize(wins.select("item_id", "form", "x.*"), "bench-windows")
    few = _counts(wins).where(F.col("n_words") < LEAST)
    wins = materialize(wins.join(few, ["item_id", "form"], "left_anti"), "bench-windows")
    left = materialize(items.join(wins.select("item_id").distinct(), "item_id", "left_anti"), "short-items")
    for form in () if left.isEmpty() else (EXACT, SHORT, SHORT_PLAIN):
        raw = raw_words(F.col("t"), PLAIN if form == EXACT else form)
        words = left.select("item_id", raw.alias("raw")).select("item_id", "raw", (F.col("raw") if form == EXACT else masked(F.col("raw"), form)).alias("words"))
        if form != EXACT:
            words = words.where(F.exists("words", _marked) & (F.size(F.filter("words", lambda w: ~_marked(w))) >= SHORT_LITERALS))
        for k in range(1, WINDOW + 1):
            wins = wins.unionAll(_cut(words.where(F.size("raw") == k if k < WINDOW else F.size("raw") >= k), F.lit(form + k), k))
    of = lambda k: _hash(F.col("form"), [F.get("words", F.lit(i)) for i in range(k)])
    keyed = reduce(lambda found, k: found.when(F.size("words") == k, of(k)), range(2, WINDOW + 1), F.when(F.size("words") == 1, of(1)))
    return wins.join(_counts(wins), ["item_id", "form"]).select(keyed.alias("h"), "item_id", "form", "bpos", "raw", "n_windows", "n_words")


def _counts(wins: DataFrame) -> DataFrame:
    return wins.groupBy("item_id", "form").agg(F.count("*").alias("n_windows"), _covered(F.collect_set("bpos"), F.first("form")).alias("n_words"))


def _cut(items: DataFrame, form: Column, width: int) -> DataFrame:
    at = F.transform(F.sequence(F.lit(0), F.size("words") - width), lambda i: F.struct(i.alias("bpos"), F.slice("words", i + 1, F.lit(width)).alias("words"), F.slice("raw", i + 1, F.lit(width)).alias("raw")))
    return items.where(F.size("words") >= width).select("item_id", form.alias("form"), F.explode(at).alias("x")).select("item_id", "form", "x.*")


def _covered(bpos: Column, form: Column) -> Column:
    """Words that the windows at ``bpos`` cover."""
    width = F.when(form > EXACT, form % 10).otherwise(WINDOW)
    return F.size(F.array_distinct(F.flatten(F.transform(bpos, lambda p: F.sequence(p, p + width - 1)))))


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes that tell rows apart by id and text; equal for repeated rows."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\x00"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))


def document_windows(docs: DataFrame, id_col: str, text_col: str, exact: tuple[int, ...] = ()) -> DataFrame:
    """(key, id, pos, form, h, raw): every window of every text in both forms, and in the exact
    and short forms named; ``raw`` holds its words as written. A row for each window, made in one stage."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), text.alias("t"))
    cut = F.array_repeat(F.lit(None).cast("string"), WINDOW)  # no window spans two forms
    read = read.select("key", "id", raw_words(F.col("t")).alias("r0"), raw_words(F.col("t"), PLAIN).alias("r1"), "t")
    whole = F.concat(masked(F.col("r0")), cut, masked(F.col("r1"), PLAIN))
    both = read.select("key", "id", F.concat("r0", cut, "r1").alias("r"), whole.alias("w"), F.size("r0").alias("n0"))
    # explode_outer: the inner one would have the words computed twice, for a filter on their number
    rows = both.select("key", "id", "r", "w", "n0", F.posexplode_outer("w").alias("pos", "w0"))
    words = ["w0", *(F.get("w", F.col("pos") + i) for i in range(1, WINDOW))]
    rows = rows.select("key", "id", "pos", F.when(F.col("pos") < F.col("n0"), TEMPLATE).otherwise(PLAIN).alias("form"), "r", *(w if isinstance(w, str) else w.alias(f"w{i}") for i, w in enumerate(words)))
    rows = rows.where(F.col("w0").isNotNull() & F.col(f"w{WINDOW - 1}").isNotNull())
    own = lambda k: F.slice("r", F.col("pos") + 1, F.lit(k)).alias("raw")  # noqa: E731  generated code makes it after the join, for hits alone
    out = rows.select("key", "id", "pos", "form", _hash(F.col("form"), [F.col(f"w{i}") for i in range(WINDOW)]).alias("h"), own(WINDOW))
    for form in exact:
        k, kind = form % 10, form // 10 * 10
        raw = F.col("r1") if kind == EXACT else raw_words(F.col("t"), kind)
        tall = read.select("key", "id", raw.alias("r")).select("key", "id", "r", (F.col("r") if kind == EXACT else masked(F.col("r"), kind)).alias("w"))
        rows = tall.select("key", "id", "r", "w", F.posexplode_outer("w").alias("pos", "w0"))
        rows = rows.where(F.get("r", F.col("pos") + k - 1).isNotNull())
        out = out.unionAll(rows.select("key", "id", "pos", F.lit(form).alias("form"), _hash(F.lit(form), [F.get("w", F.col("pos") + i) for i in range(k)]).alias("h"), own(k)))
    return out


def _hits(seen: DataFrame, bench: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Windows of documents joined with equal ones of the benchmark."""
    size, = bench.agg(F.coalesce(F.sum(F.lit(96) + F.length(F.to_json("raw"))), F.lit(0))).first()
    bench = bench.withColumnRenamed("raw", "braw")
    if size <= broadcast_bytes:
        return seen.join(F.broadcast(bench.drop("form")), "h")  # the form is part of the hash
    # one word of 64 bits for each bucket: a table of at most 2**FILTER_BITS rows, whatever the benchmark's size
    bucket = lambda h: F.pmod(h, F.lit(1 << FILTER_BITS)).cast("int")
    marks = bench.select(bucket(F.col("h")).alias("bucket"), F.expr(f"shiftleft(1L, CAST(pmod(shiftright(h, {FILTER_BITS}), 64) AS INT))").alias("m")).groupBy("bucket").agg(F.bit_or("m").alias("mask"))
    passed = seen.withColumn("bucket", bucket(F.col("h"))).join(F.broadcast(marks), "bucket")
    passed = passed.where(f"shiftrightunsigned(mask, CAST(pmod(shiftright(h, {FILTER_BITS}), 64) AS INT)) & 1 = 1").drop("mask", "bucket")
    passed = passed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    return passed.join(bench.drop("form").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT))))), ["h", "salt"]).drop("salt")


def found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, coverage: float, broadcast_bytes: int, quote: int) -> DataFrame:
    """(key, id, item_id, x) for each row and item found; see ``contaminated``."""
    bench = materialize(benchmark_windows(benchmark, item_col, item_text_col), "bench")
    exact = tuple(sorted(r[0] for r in bench.where(F.col("form") > EXACT).select("form").distinct().collect()))  # at most WINDOW
    hits = _hits(document_windows(docs, id_col, text_col, exact), bench, broadcast_bytes)
    # (item position, kind, item's value, document's value) of each slot
    kind = F.when(F.col("form") > SHORT_PLAIN, masked(F.col("braw"), SHORT_PLAIN)).when(F.col("form") > SHORT, masked(F.col("braw"), SHORT)).when(F.col("form") > EXACT, F.array().cast("array<string>")).when(F.col("form") == PLAIN, masked(F.col("braw"), PLAIN)).otherwise(masked(F.col("braw")))
    value = lambda words: F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[ \x{A0}]", ""))
    zipped = F.arrays_zip(kind.alias("k"), value(F.col("braw")).alias("b"), value(F.col("raw")).alias("d"))
    slots = F.filter(F.transform(zipped, lambda x, i: F.struct((F.col("bpos") + i).alias("at"), x["k"].alias("k"), x["b"].alias("b"), x["d"].alias("d"))), lambda x: F.coalesce(_marked(x["k"]), F.lit(False)))
    offset = F.col("pos") - F.col("bpos")
    hits = hits.select("key", "id", "item_id", "form", offset.alias("offset"), "bpos", "n_windows", "n_words", slots.alias("slots"))
    own = ["key", "item_id", "form"]
    several = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    same = [F.first(c).alias(c) for c in ("id", "n_windows", "n_words")]
    lines = hits.groupBy(*own, "offset").agg(F.collect_set("bpos").alias("bpos"), several("slots").alias("slots"), *same)
    # each offset alone, and two overlapping bands
    band = F.floor(F.col("offset") / SHIFT).cast("int")
    bands = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("at")) for k, v in enumerate((F.col("offset"), band, band + 1))))
    by = lines.select("*", F.explode(bands).alias("g")).groupBy(*own, "g").agg(several("bpos").alias("bpos"), several("slots").alias("slots"), *same)
    by = by.withColumn("covered", _covered(F.col("bpos"), F.col("form")))
    whole = (F.col("form") > EXACT) & (F.col("g.kind") == 0) & (F.col("covered") == F.col("n_words"))
    by = by.where(F.when(F.col("form") > EXACT, whole).otherwise(F.col("covered") >= LEAST))
    against = lambda x: F.exists("slots", lambda y: (x["k"] == y["k"]) & (x["b"] == y["b"]) & (x["d"] != y["d"]))
    lost = F.size(F.array_distinct(F.transform(F.filter("slots", against), lambda x: x["at"])))
    by = by.withColumn("left", F.col("covered") - CONFLICT * lost)
    enough = (F.col("left") >= LEAST) & ((F.col("left") >= coverage * F.col("n_words")) | (F.col("left") >= quote))
    by = by.where(F.when(F.col("form") > EXACT, F.col("left") == F.col("n_words")).otherwise(enough))
    n_slots = F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["k"], x["b"], x["d"])))).cast("bigint")
    x = F.struct(
        (F.col("left") / F.col("n_words")).alias("coverage"), F.forall("slots", lambda x: x["b"] == x["d"]).alias("same"), F.size("bpos").alias("n_hit"), "n_windows", n_slots.alias("n_slots"),
    )
    return by.groupBy("key", "item_id").agg(F.first("id").alias("id"), F.max(x).alias("x"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES, quote: int = QUOTE,
) -> DataFrame:
    """(id_col, item_id, n_windows, n_hit, coverage, n_slots, same_values) for each document that holds an item.

    A document holds an item if, in one form and within a band of offsets, its windows cover
    at least ``coverage`` of the item's words or ``quote`` words, and no fewer than ``LEAST``.
    Each slot of an item's value that becomes several values takes ``CONFLICT`` words off; two
    values may become one. ``coverage`` is what remains, as a share. ``same_values`` tells
    copies from questions asked again with other values. Items of fewer than ``LEAST`` words,
    or all of placeholders, are held by documents that have all their words in a row; with other
    values if ``SHORT_LITERALS`` of their words and signs remain, all stand in a row, and equal
    values are put in for equal ones.

    Null and empty texts hold nothing, null and empty items are held by none. Rows are judged
    one by one, also those of one id or of none; an id with several rows gets its best. Extra
    columns are ignored.
    """
    best = found(docs, benchmark, id_col, text_col, item_col, item_text_col, coverage, broadcast_bytes, quote).groupBy("id", "item_id").agg(F.max("x").alias("x"))
    return best.select(
        F.col("id").alias(id_col), F.col("item_id").alias("item_id"), F.col("x.n_windows").alias("n_windows"), F.col("x.n_hit").cast("bigint").alias("n_hit"), F.round("x.coverage", 4).alias("coverage"),
        F.col("x.n_slots").alias("n_slots"), F.col("x.same").alias("same_values"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns as before. Rows go one by
    one, whether they share an id, or have none, or not."""
    bad = found(docs, benchmark, id_col, text_col, item_col, item_text_col, COVERAGE, BROADCAST_BYTES, QUOTE).select("key").distinct()
    bad = materialize(bad, "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    rows = docs.select(row_key(id_col, text_col).alias("key"), whole_row(docs))
    return rows.join(bad, "key", "left_anti").select("row.*")
