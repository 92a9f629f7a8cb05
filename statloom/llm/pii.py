"""Personal data in text: generators, boosted trees over candidate spans, redaction.

Everything here is DataFrame code. Base generators find strictly defined spans, which always
stay. High-recall generators propose further, overlapping spans of looser form; gradient
boosted trees score them from format and context. A threshold for each kind, calibrated on
labelled examples that the trees haven't seen, selects candidates, and of those that overlap
the likeliest is added.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import materialize, quoted

#: Base kinds in their order. Each pattern finds what the plain one in the comment finds,
#: without rescanning long runs: a match starts where a run does, or where the last ended.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ with 14 to 19 digits passing Luhn
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9], 10 to 15 digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose generators, high recall: their spans may overlap each other and the base spans.
LOOSE = {
    "email_loose": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,64}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[a-z0-9-]{2,24}){1,4}",
    "phone_loose": r"(?<![0-9+.-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,5}(?![0-9.-]?[0-9])",
    "id_loose": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban_loose": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # a run of 16 or more with a digit and a letter in it
    "secret_loose": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+",
    # after a title, or after "name is" and the like; the capital comes first, as it is rare
    "name_loose": r"(?=\p{Lu})(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?|Sra?|name|named|name\x20is|nombre|nom)[.:]?\x20)\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+){0,2}(?![\p{L}\p{N}])",
    "address_loose": r"(?=[0-9\p{Lu}c])(?<![\p{L}\p{N}])(?:[0-9]{1,5}\x20(?:\p{Lu}\p{Ll}+\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard|Court)|\p{Lu}\p{Ll}{2,20}(?:straße|strasse|weg|platz|gasse)\x20[0-9]{1,4}|[0-9]{1,4},?\x20(?:rue|avenue|place)\x20(?:d[eu]s?\x20(?:la\x20)?)?\p{Lu}\p{Ll}+|[Cc]alle\x20(?:de\x20(?:la\x20)?)?\p{Lu}\p{Ll}+,?\x20[0-9]{1,4})(?![\p{L}\p{N}])",
    "birth_loose": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2})(?![./-]?[0-9])",
}
#: What must occur in a text for the pattern to be tried at all.
NEEDS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "email_loose": r"(?i)[(\[\x20]at[)\]\x20]",
    "phone_loose": r"[0-9]\)?[\x20./-][0-9]",
    "id_loose": r"[0-9]-[0-9]",
    "iban_loose": r"[A-Z]{2}[0-9]{2}",
    "secret_loose": r"[0-9](?:(?=[A-Za-z_+/=-])|(?<=[A-Za-z_+/=-][0-9]))",
    "name_loose": r"\p{Lu}\p{Ll}",
    "address_loose": r"[0-9],?\x20(?:\p{Lu}|rue|avenue|place)|\x20[0-9]",
    "birth_loose": r"[0-9][./-][0-9]{1,2}[./-][0-9]",
}
KINDS = [*BASE, *LOOSE]
#: Words that announce personal data, in the corpus's four languages.
CUES = {
    "contact": ("phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "téléphone", "teléfono", "llame", "mail", "email", "contact", "kontakt", "write", "correo", "courriel", "contacto"),
    "account": ("ssn", "social", "passport", "id", "iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "kennwort", "contraseña"),
    "checksum": ("commit", "sha", "checksum", "hash", "digest", "file", "page", "etag"),
    "birth": ("born", "birth", "dob", "birthday", "geboren", "geburtsdatum", "né", "née", "naissance", "nacido", "nacida", "nacimiento"),
    "person": ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "monsieur", "madame", "señor", "señora", "sr", "sra", "name", "named", "nombre", "nom"),
    "home": ("live", "lives", "address", "home", "wohnt", "adresse", "anschrift", "habite", "vive", "dirección"),
}
#: Capitalised words that are no names of persons.
NO_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "north", "south", "east", "west", "new", "united", "saint", "the", "this", "that")
CONTEXT = 32
_CHUNK = 256


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, value) for a pattern's non-overlapping matches, by start.

    Starts come from the lengths of what lies between the matches, summed chunk by chunk so
    that a text with very many matches costs little more than one with few.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(found.alias("v"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    row = "struct<s:int,e:int,v:string>"
    none = f"array<struct<pos:int,out:array<{row}>>>"
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _CHUNK).cast("int")),
        lambda c: F.slice(pairs, c * _CHUNK + 1, F.lit(_CHUNK)),
    )

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + x["g"]
        e = s + F.length(x["v"])
        return F.struct(e.alias("pos"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"))).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        start = F.coalesce(F.get(acc, F.size(acc) - 1)["pos"], F.lit(0))
        return F.array_append(acc, F.aggregate(part, F.struct(start.alias("pos"), F.array().cast(f"array<{row}>").alias("out")), step))

    done = F.aggregate(chunks, F.array().cast(none), chunk)
    flat = F.flatten(F.transform(done, lambda d: d["out"]))
    out = F.transform(flat, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["v"].alias("value")))
    return F.when(text.rlike(NEEDS[kind]) & text.rlike(pattern), out).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the decimal digits pass the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    # parts may have leading zeros; only the last three digits are cast
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*[0-9]{1,3}$") & (F.right(p, F.lit(3)).cast("int") <= 255)),
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _checked(kind: str):
    return lambda x: _VALID[kind](x["value"])


def base_spans(text: Column) -> Column:
    """Base spans of a text by start, then by kind in order: array of (kind, start, end, value).

    Starts and ends are code points, ends exclusive. Matches that fail their kind's check are
    dropped without a retry. Null gives no spans.
    """
    text = F.coalesce(text, F.lit(""))
    kinds = [F.filter(_spans(text, k, p), _checked(k)) for k, p in BASE.items()]
    return _ordered(F.concat(*kinds))


def _ordered(spans: Column) -> Column:
    """By start, then kind in order, then end."""
    at = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), at[x["kind"]].alias("o"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _features(value: Column, kind: Column, before: Column) -> dict[str, Column]:
    digits = _digits(value)
    words = F.split(F.lower(before), r"[^\p{L}]+")
    return {
        "kind": F.array_position(F.array(*(F.lit(k) for k in LOOSE)), kind).cast("double"),
        "length": F.length(value).cast("double"),
        "digits": F.length(digits).cast("double"),
        "groups": F.size(F.split(value, r"[\x20./()-]+")).cast("double"),
        "letters": F.length(F.regexp_replace(value, r"[^A-Za-z]", "")).cast("double"),
        "leading_zero": digits.startswith("0").cast("double"),
        "parenthesis": value.contains("(").cast("double"),
        "bracketed_at": value.rlike(r"(?i)[(\[]at[)\]]").cast("double"),
        "spelt_dot": value.rlike(r"(?i)[(\[\x20]dot[)\]\x20]").cast("double"),
        "slashes": value.contains("/").cast("double"),
        "dots": value.contains(".").cast("double"),
        "year_like": value.rlike(r"(?<![0-9])(19|20)[0-9]{2}(?![0-9])").cast("double"),
        **{f"cue_{k}": F.arrays_overlap(words, F.array(*(F.lit(c) for c in cues))).cast("double") for k, cues in CUES.items()},
        "colon": before.rlike(r"[:=][\x20\"']*$").cast("double"),
        "digit_before": before.rlike(r"[0-9][.,\x20]?$").cast("double"),
        "hex": value.rlike(r"^[0-9a-f]+$").cast("double"),
        "mixed": (value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")).cast("double"),
        "joined": F.length(F.regexp_replace(value, r"[^_/-]", "")).cast("double"),
        "no_name": F.lower(value).rlike(rf"^(?:{'|'.join(NO_NAMES)})\b").cast("double"),
    }


def examples(spark: SparkSession, n: int = 160) -> DataFrame:
    """(kind, value, before, label): ``n`` labelled candidates of each form, drawn by a rule from their number.

    A fixed, bounded training table (n rows for each of some forty forms): personal data with
    and without cue words, and what looks alike: dates, times, ratios, versions, prices, part
    numbers, checksums, prose. Texts that several generators propose are there under each kind.
    """
    salts = iter(range(10_000))
    at = lambda width: F.pmod(F.xxhash64(F.col("id"), F.lit(next(salts))), F.lit(width))
    d = lambda w: F.lpad(at(10**w).cast("string"), w, "0")
    pick = lambda *xs: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), (at(len(xs)) + 1).cast("int"))
    cat = lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    hexes = lambda w: F.lower(F.substring(F.sha2(F.concat(F.col("id"), F.lit(str(next(salts)))), 256), 1, w))
    base62 = lambda w: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.col("id"), F.lit(str(next(salts)))), 256))), "[+/=]", "x"), 1, w)
    call = lambda: pick("call me on ", "Tel: ", "phone: ", "telefon ", "my mobile ", "contact ", "kontakt: ", "téléphone ")
    plain = lambda: pick("in the ", "of about ", "was ", "and then ", "the ratio ", "between ", "den ", "que la ", "est le ", "")
    mail = lambda: pick("mail ", "write to ", "contact: ", "email: ", "correo ", "")
    money = lambda: pick("iban ", "account: ", "konto ", "bank ", "cuenta ", "")
    mark = lambda: cat(pick("token", "api_key", "secret", "password", "auth key", "bearer token", "kennwort"), pick(" = \"", "=", ": ", " = ", " '"))
    born = lambda: pick("born on ", "dob: ", "birthday ", "geboren am ", "née le ", "nacido el ", "date of birth: ")
    title = lambda: pick("Mr ", "Mrs. ", "Dr. ", "Herr ", "Frau ", "Señor ", "Madame ", "my name is ", "name: ")
    lives = lambda: pick("lives at ", "address: ", "wohnt in der ", "Anschrift: ", "habite ", "dirección: ", "")
    first, last = lambda: pick("Anna", "Peter", "Maria", "Jonas", "Claire", "Pablo"), lambda: pick("Keller", "Miller", "Garcia", "Dubois", "Novak", "Young")
    sep = lambda: pick(" ", "-", ".", "/")
    long_date = lambda: cat(d(1), pick("1", "7"), pick(".", "/", "-"), "0", pick("1", "5", "9"), F.lit("/"), pick("19", "20"), d(2))
    iso_date = lambda: cat(pick("19", "20"), d(2), "-", pick("01", "07", "12"), "-", pick("03", "18", "27"))
    forms = [
        ("phone_loose", cat(d(3), "-", d(3), "-", d(4)), call(), 1),
        ("phone_loose", cat("(", d(3), ") ", d(3), sep(), d(4)), call(), 1),
        ("phone_loose", cat("0", d(3), sep(), d(3), " ", d(4)), call(), 1),
        ("phone_loose", cat("0", d(2), " ", d(3), " ", d(4)), plain(), 1),
        ("phone_loose", cat("(0", d(3), ") ", d(5)), plain(), 1),
        ("phone_loose", cat(d(2), sep(), d(2)), plain(), 0),
        ("phone_loose", cat(d(3), " ", d(3)), plain(), 0),
        ("phone_loose", cat(d(2), ".", d(2), ".", d(2)), pick("version ", "release ", "chapter "), 0),
        ("phone_loose", cat(d(4), " ", d(4), " ", d(4)), plain(), 0),
        ("phone_loose", iso_date(), plain(), 0),
        ("phone_loose", iso_date(), born(), 0),
        ("phone_loose", long_date(), born(), 0),
        ("email_loose", cat(pick("ana", "j.doe", "kim_l"), pick(" (at) ", " at ", "[at]"), pick("mail", "uni-x", "firm"), pick(" dot ", "(dot)", " [dot] "), pick("com", "org", "de")), mail(), 1),
        ("email_loose", cat(pick("look", "was", "arrived", "meet"), " at ", pick("noon", "home", "last", "the"), ". ", pick("then", "it", "she", "and")), plain(), 0),
        ("email_loose", cat(pick("look", "was", "arrived", "meet"), " at ", pick("noon", "home", "last", "the"), ". ", pick("Then", "It", "She", "And")), mail(), 0),
        ("email_loose", cat(pick("look", "was", "arrived", "meet"), " at ", pick("noon", "home"), ".", pick("com", "then", "org")), plain(), 0),
        ("phone_loose", cat(d(2), " ", d(2), " ", d(2)), plain(), 0),
        ("phone_loose", cat(d(5), "-", d(5)), plain(), 0),
        ("phone_loose", cat(d(4), " ", d(4)), plain(), 0),
        ("id_loose", cat(d(3), "-", d(2), "-", d(4)), pick("ssn ", "social: ", "id ", "number ", ""), 1),
        ("id_loose", cat(d(3), "-", d(2), "-", d(4)), pick("page ", "file ", "etag "), 0),
        ("phone_loose", cat(d(3), "-", d(2), "-", d(4)), pick("ssn ", "social: ", "id "), 0),
        ("iban_loose", cat(pick("DE", "FR", "ES", "GB"), d(2), " ", d(4), " ", d(4), " ", d(4), " ", d(4)), money(), 1),
        ("iban_loose", cat(pick("AB", "XK", "PT"), d(2), pick("ABCD", "PART"), d(4)), pick("part ", "file ", "page "), 0),
        ("secret_loose", hexes(40), mark(), 1),
        ("secret_loose", hexes(32), mark(), 1),
        ("secret_loose", base62(32), mark(), 1),
        ("secret_loose", cat(pick("sk-", "ghp_", "pk_live_"), base62(36)), mark(), 1),
        ("secret_loose", cat(pick("sk-", "ghp_", "xoxb-"), base62(36)), plain(), 1),
        ("secret_loose", base62(40), plain(), 1),
        ("secret_loose", hexes(40), pick("commit ", "sha ", "checksum: ", "hash ", "file "), 0),
        ("secret_loose", hexes(40), plain(), 0),
        ("secret_loose", cat(pick("chapter-", "section_", "part-"), d(2), pick("-of-the-rules", "_final_version", "-and-more-of-it")), plain(), 0),
        ("secret_loose", cat("word", d(1), pick("wordwordwordword", "andandandandand", "xxxxxxxxxxxxxxx")), plain(), 0),
        ("secret_loose", cat(pick("KX", "MODEL", "REF"), "-", d(4), "-", d(4), "-", d(4)), plain(), 0),
        ("name_loose", cat(first(), " ", last()), title(), 1),
        ("name_loose", last(), pick("Mr ", "Mrs. ", "Dr. ", "Herr ", "Frau ", "Señora "), 1),
        ("name_loose", cat(pick("Monday", "March", "North", "New", "United", "This"), pick("", " Morning", " America", " York")), pick("the name ", "a name: ", "nom ", "nombre "), 0),
        ("name_loose", pick("Then", "One", "Other", "Water", "Paris", "Music"), pick("the name ", "a town named ", "nom ", "nombre "), 0),
        ("address_loose", cat(d(2), " ", pick("Mill", "High", "Oak Tree"), " ", pick("Street", "Road", "Avenue", "Lane")), lives(), 1),
        ("address_loose", cat(pick("Haupt", "Garten", "Linden"), pick("straße ", "weg ", "platz "), d(2)), lives(), 1),
        ("address_loose", cat(pick("12, rue de ", "7 rue du ", "Calle de "), pick("Lyon", "Nord", "Madrid"), pick("", ", 12")), lives(), 1),
        ("address_loose", cat(d(4), " ", pick("Main", "First"), " ", pick("Drive", "Court")), pick("sold ", "about ", "model "), 0),
        ("birth_loose", iso_date(), born(), 1),
        ("birth_loose", long_date(), born(), 1),
        ("birth_loose", iso_date(), plain(), 0),
        ("birth_loose", long_date(), plain(), 0),
    ]
    rows = spark.range(n)
    made = [rows.select(F.lit(k).alias("kind"), v.alias("value"), b.alias("before"), F.lit(float(y)).alias("label")) for k, v, b, y in forms]
    return reduce(DataFrame.unionAll, made)


@dataclass(frozen=True)
class Selector:
    """Boosted trees, as nested (feature, cut, left, right) with leaves' values, their weights, and a threshold for each kind."""

    trees: tuple
    thresholds: dict[str, float]


def _assembled(df: DataFrame) -> DataFrame:
    cols = _features(F.col("value"), F.col("kind"), F.col("before"))
    return VectorAssembler(inputCols=[f"f_{k}" for k in cols], outputCol="features").transform(df.withColumns({f"f_{k}": c for k, c in cols.items()}))


_FITTED: dict[tuple, Selector] = {}


def fit(spark: SparkSession, rounds: int = 12, depth: int = 4, precision: float = 0.98) -> Selector:
    """Trees over three quarters of ``examples``, and for each kind the least score (0.5 or more) at
    which its part of the other quarter reaches ``precision``.

    Trained once in a driver's life: the examples are fixed.
    """
    if (rounds, depth, precision) in _FITTED:
        return _FITTED[rounds, depth, precision]
    data = materialize(_assembled(examples(spark)).select("kind", "features", "label", F.pmod(F.xxhash64("value", "before"), F.lit(4)).alias("fold")).coalesce(1), "pii-examples")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=64, seed=7).fit(data.where("fold > 0"))
    scored = model.transform(data.where("fold = 0")).select("kind", "label", F.round(vector_to_array("probability")[1], 6).alias("p"))
    thresholds = {}
    for kind in LOOSE:  # at most as many rows as examples
        pos = n = 0
        threshold = 1.0
        for r in scored.where(F.col("kind") == kind).groupBy("p").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).orderBy(F.desc("p")).collect():
            pos, n = pos + r["pos"], n + r["n"]
            if pos / n >= precision:
                threshold = r["p"]
        thresholds[kind] = max(threshold - 1e-6, 0.5)
    trees = tuple((float(w), _nested(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True))
    return _FITTED.setdefault((rounds, depth, precision), Selector(trees, thresholds))


def _nested(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _nested(node.leftChild()), _nested(node.rightChild())


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, base, spans) for each row.

    ``base`` and ``spans`` are arrays of (kind, start, end, value); ``spans`` holds all of
    ``base`` and those loose candidates that no base span overlaps, that reach their kind's
    threshold and that no likelier one overlaps (of equal ones the first counts). Null and
    empty texts have no spans; repeated rows stay repeated; extra columns are ignored, and id
    and text may have any names.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    loose = F.concat(*(_spans(text, k, p) for k, p in LOOSE.items()))
    cross = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    apart = F.filter(F.col("__loose"), lambda x: ~F.exists(F.col("__base"), lambda b: cross(x, b)))
    seen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).select("__id", "__text", base_spans(F.col("__text")).alias("__base"), loose.alias("__loose")).withColumn("__loose", apart)
    chosen = fit(docs.sparkSession)
    least = F.create_map(*(F.lit(x) for kv in chosen.thresholds.items() for x in kv))
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))
    scored = F.transform(F.col("__loose"), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _probability(chosen.trees, x, text).alias("p")))
    seen = seen.withColumn("__loose", F.filter(scored, lambda x: x["p"] >= least[x["kind"]]))
    rank = lambda x: F.struct(-x["p"], x["start"], x["kind"])
    best = F.filter(F.col("__loose"), lambda x: ~F.exists(F.col("__loose"), lambda y: cross(x, y) & (rank(y) < rank(x))))
    spans = _ordered(F.concat(F.col("__base"), F.transform(best, place)))
    return seen.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), F.col("__base").alias("base"), spans.alias("spans"))


def _probability(trees: tuple, x: Column, text: Column) -> Column:
    """The trees' probability as an expression over one candidate span."""
    start = F.greatest(x["start"] - CONTEXT, F.lit(0))
    before = F.substring(text, start + 1, x["start"] - start)
    cols = list(_features(x["value"], x["kind"], before).values())
    # features are worked out once a candidate, as an array that the trees look into
    margin = F.element_at(F.transform(F.array(F.array(*cols)), lambda f: reduce(lambda a, b: a + b, (F.lit(w) * _tree(t, f) for w, t in trees))), 1)
    return 1 / (1 + F.exp(-2 * margin))


def _tree(node, of: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, cut, left, right = node
    return F.when(F.get(of, F.lit(feature)) <= F.lit(cut), _tree(left, of)).otherwise(_tree(right, of))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; columns as before.

    Overlapping spans become one mark, that of the first. Texts without spans, nulls among
    them, stay as they are.
    """
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*(F.col(quoted(c)) for c in rest)).alias("__row"), F.col(text_col).alias("__text"))
    found = find(packed, "__row", "__text")
    text = F.col("__text")

    def step(acc: Column, x: Column) -> Column:
        new = x["start"] >= acc["pos"]
        mark = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit("["), F.upper(F.regexp_replace(x["kind"], "_loose", "")), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(new, mark).otherwise(acc["out"]).alias("out"))

    last = F.aggregate(F.col("spans"), F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    made = found.select("__row", F.when(F.size("spans") > 0, last).otherwise(text).alias("__text"))
    return made.select(*(F.col("__text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns))
