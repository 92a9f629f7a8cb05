"""Merkle manifest, URL filter and fill-in-the-middle against brute force, and their odd cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statloom.llm import fim, merkle, url_filter
from statloom.llm.queries import URL_RULES

rng = random.Random(11)


# --- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """All levels of one tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    """{(id, source, leaf): [(subroot, root, siblings)]} of (id, source, leaf)."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees.append(plain_tree([r[2] for r in sources[s]]))
    top = plain_tree([t[-1][0] for t in trees])
    out = Counter()

    def beside(levels, i):
        found = []
        for level in levels[:-1]:
            run = i - i % 3
            found += [x for j, x in enumerate(level[run : run + 3], run) if j != i]
            i //= 3
        return found

    for k, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            out[(*r, trees[k][-1][0], top[-1][0], "".join(beside(trees[k], i) + beside(top, k)))] += 1
    return out


def manifest(docs, **options):
    made = merkle.build(docs, merkle.leaf_hash(F.col("doc_id"), F.col("text")), **options)
    rows = merkle.folded(made.rows, F.col("leaf")).withColumn("proof", F.lower(F.hex("siblings"))).collect()
    assert all(r["folded_root"] == made.root for r in rows)
    return Counter((r["id"], r["source"], r["leaf"], r["subroot"], made.root, r["proof"]) for r in rows)


def leafed(rows):
    f = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return [(i, s, H(f(i), f(t))) for i, s, t in rows]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_manifest_is_that_of_plain_trees(spark, chunk):
    rows = [(rng.randrange(400), rng.choice(["hot"] * 5 + ["a", "ä", "b", None, ""]), f"t{rng.randrange(3)}") for _ in range(700)]
    rows += [(None, "hot", None), (None, None, "x"), (3, "one", "single")] + [(9, "same", "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    assert manifest(docs, chunk=chunk) == plain_manifest(leafed(rows))


def test_manifest_of_many_sources_by_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_RUNS", 0)
    monkeypatch.setattr(merkle, "BROADCAST_ENDS", 0)
    rows = [(i, f"s{i % 97}" if i % 3 else "hot", None if i % 5 else "t\n") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    assert manifest(docs, chunk=50) == plain_manifest(leafed(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_manifests(spark, n):
    rows = [(i, "s", "x") for i in range(n)]
    assert manifest(spark.createDataFrame(rows, "doc_id long, source string, text string")) == plain_manifest(leafed(rows))


def test_manifest_of_nothing_and_clashing_names(spark, odd):
    assert merkle.build(odd.limit(0), F.lit(""), source_col="fp").root is None
    clash = ["id", "source", "leaf", "carry", "at", "pid", "first", "idx", "number", "siblings"]
    docs = odd.select("doc_id", "text", "fp", *(F.lit(i).alias(c) for i, c in enumerate(clash)))
    leaf = merkle.leaf_hash(F.col("doc_id"), F.col("text"))
    a, b = (merkle.build(x, leaf, source_col="fp", carry=F.length("text")) for x in (docs, odd))
    assert a.root == b.root and sorted(map(str, a.rows.collect())) == sorted(map(str, b.rows.collect()))


def test_tampered_rows_do_not_verify(spark):
    docs = spark.createDataFrame([(i, "s" + str(i % 4), f"line {i}\nend") for i in range(50)], "doc_id long, source string, text string")
    made = merkle.build(docs, merkle.leaf_hash(F.col("text")), carry=merkle.leaf_hash(F.when(F.col("doc_id") % 7 == 0, F.lit("other")).otherwise(F.col("text"))))
    bad = {r["id"] for r in merkle.folded(made.rows, F.col("carry")).where(F.col("folded_root") != made.root).collect()}
    assert bad == set(range(0, 50, 7))


def test_forests_merge_in_any_order():
    nodes = [((r, n, 0, i), hashlib.sha256(f"{r}.{i}".encode()).digest()) for r, n in enumerate((1, 30, 4, 11)) for i in range(n)]
    roots = set()
    for _ in range(20):
        rng.shuffle(nodes)
        parts = [merkle.Forest(4).add(nodes[i::9]) for i in range(9)]
        while len(parts) > 1:
            parts.append(parts.pop(rng.randrange(len(parts))).merge(parts.pop(rng.randrange(len(parts)))))
        roots.add(tuple(parts[0].open.items()))
    assert len(roots) == 1 and len(next(iter(roots))) == 1


# --- URL filter


def plain_scores(texts, order=url_filter.ORDER):
    """(all, half0, half1) of each (says, text), by dictionaries."""
    models = {}
    for half in (None, 0, 1):
        for kind in ("allow", "block"):
            follow = defaultdict(Counter)
            for says, t in texts:
                if says == kind and (half is None or part(t) != half):
                    s = url_filter.START * order + t + url_filter.END
                    for p in range(order, len(s)):
                        for n in range(order + 1):
                            follow[s[p - n : p]][s[p]] += 1
            models[half, kind] = follow

    def chance(follow, context, c):
        low = chance(follow, context[1:], c) if context else 1 / url_filter.ALPHABET
        seen = follow.get(context)
        if not seen:
            return low
        n, k = sum(seen.values()), len(seen)
        return seen[c] / (n + k) + k / (n + k) * low

    def score(t, half):
        s = url_filter.START * order + t + url_filter.END
        x = sum(math.log(chance(models[half, "allow"], s[p - order : p], s[p]) / chance(models[half, "block"], s[p - order : p], s[p])) for p in range(order, len(s)))
        return x / (len(t) + 1)

    return {(says, t): (score(t, None), score(t, part(t))) for says, t in texts}


def part(t):
    return 0 if hashlib.md5(t.encode()).hexdigest()[0] in "02468ace" else 1


def split_url(url):
    if url is None or "://" not in url:
        return "", "", url or ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, path, lower + rest[len(host) :]


def plain_verdicts(urls):
    out, texts = [], {}
    for i, url in enumerate(urls):
        host, path, t = split_url(url)
        t = re.sub("[^!-~]", "\x7f", t)
        fits = [(len(r), r, s) for s, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        _, rule, says = max(fits, default=(0, None, None))
        out.append([i, host, path, rule, says, t])
        texts[says, t] = None
    scores = plain_scores(list(texts))
    held = [(s, math.floor(round(h, 6) * 100)) for (s, _), (_, h) in scores.items() if s]
    good, bad = (sorted(b for s, b in held if s == k) for k in ("allow", "block"))
    best = {k: sum(b >= k for b in good) * len(bad) - sum(b >= k for b in bad) * len(good) for k in range(min(b for _, b in held), max(b for _, b in held) + 2)}
    low = min(k for k in best if best[k] == max(best.values()))
    high = min((b for _, b in held if b >= low), default=low)
    cut = (low + high) // 2 / 100
    return {(i, host, path, rule, says or ("allow" if scores[None, t][0] >= cut else "block")) for i, host, path, rule, says, t in out}, scores, cut


@pytest.fixture(scope="module")
def urls(spark):
    found = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    odd = [None, "", "no scheme here", "HTTP://Example.ORG/es/1", "x://example.org", "://EXAMPLE.org/en/1?q#f", "a://b://c.com/fr/", "http://notexample.org/es/", "ftp://ümlaut.net/ä\n/漢", "http://h.com?/de/", "http://com/de/x", "http://net/" + "long/" * 2000]
    return found + odd + ["http://m.thing.example.net/en/3"] * 30 + [f"http://cheap{k}.casino.com/de/{k * 37}" for k in range(20)]


@pytest.mark.parametrize("share", [url_filter.SHARE, 0.002, 2.0])
def test_verdicts_against_dictionaries(spark, urls, share, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARE", share)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    want, scores, _ = plain_verdicts(urls)
    rows = url_filter.judge(pages, URL_RULES).collect()
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == want and len(rows) == len(urls)
    for r in rows:
        if r["rule"] is None:
            assert abs(r["score"] - scores[None, re.sub("[^!-~]", "\x7f", split_url(urls[r["page_id"]])[2])][0]) < 2e-6


def test_models_tell_unseen_urls_apart(spark):
    """Words that only one kind of URL has decide where no rule does."""
    word = lambda ws: "-".join(rng.choices(ws, k=3))
    good, bad = ["garden", "history", "letters", "museum"], ["casino", "pills", "jackpot", "bonus"]
    rows = [f"http://{word(good)}.com/fr/{word(good)}{i}" for i in range(200)] + [f"http://{word(bad)}.com/de/{word(bad)}{i}" for i in range(200)]
    n = len(rows)
    rows += [f"http://{word(good)}.net/x/{word(good)}" for _ in range(60)] + [f"http://{word(bad)}.net/x/{word(bad)}" for _ in range(60)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), URL_RULES).collect()}
    assert sum((got[n + i] == "allow") == (i < 60) for i in range(120)) >= 114


def test_url_filter_odd_tables(spark):
    rows = [(None, "http://a.org/", 1), (None, None, 2), (5, "http://a.org/", 3), (5, "http://a.org/", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, t int").withColumns({c: F.lit(1) for c in ("id", "u", "host", "says", "n", "w", "score")})
    got = url_filter.judge(pages, URL_RULES).collect()
    assert sorted((str(r["page_id"]), r["host"], r["verdict"]) for r in got) == [("5", "a.org", "allow"), ("5", "a.org", "allow"), ("None", "", "block"), ("None", "a.org", "allow")]
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


# --- fill in the middle


def plain_fim(text, key):
    """Units by one pattern, pieces by slices."""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(u), form, len(x), len(y), f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"


def test_ropes_against_slices():
    texts = ["", "a", "<", "<<P", "<S", "S>", "<P>", "x<M>y", "P>" * 9, "<" * 700, "a" * 5000, "word " * 3000, "é漢𝔘\n\t ab" * 400, ("x" * 3000 + ".") * 3]
    texts += ["".join(rng.choices("abZ <>PSM\n漢𝔘é", k=rng.randrange(40))) for _ in range(3000)]
    forms = Counter()
    for i, t in enumerate(texts):
        got = fim.arrange(t, str(i))
        assert got == plain_fim(t, str(i)) and fim.rebuild(got[4], got[1]) == t
        forms[got[1]] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 100


def test_ropes_split_at_every_rank():
    text = "".join(rng.choices("ab ,.漢", k=1500))
    tree, units = fim.rope(text), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert tree.units == len(units) and tree.chars == len(text)
    for k in range(0, len(units) + 1, 7):
        a, b = tree.split(k)
        assert (str(a), str(b), a.units, b.chars) == ("".join(units[:k]), "".join(units[k:]), k, len(text) - a.chars)


def test_fill_in_middle_keeps_rows(spark, odd):
    clash = odd.withColumns({c: F.lit("own") for c in ("k0", "x0", "v0", "n", "form", "output")})
    rows = fim.transform(clash, name="made")
    back = fim.restore(rows, "made").drop("made").select(*clash.columns)
    want = clash.withColumn("text", F.coalesce("text", F.lit("")))
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))
    for r in rows.collect():
        assert r["n"] == "own" and r["made"]["n"] is not None
    assert fim.transform(odd.limit(0)).count() == 0
