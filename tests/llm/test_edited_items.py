"""Benchmark items with words edited, values exchanged and case changed are still found."""

import random
import re

from statloom.llm import decontam

PROSE = "Some words of plain prose that stand before it all. "
ITEM = "A farmer named Alice has 12 apples and 7 pears in the old barn, so Alice gives away 7 pears to her kind neighbours today."
RIDE = "Alice rides for 5 km along the river bank. Alice then walks 12 minutes to the market and buys bread for her mother."


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontam.contaminated(docs, bench).collect()}


def test_edited_words(spark, sf_dir):
    rng = random.Random(3)
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(60).collect()]
    texts, want = [], set()
    for i, item in enumerate(items):
        words = item.split()
        if len(words) < 20:
            continue
        for kind in ("replaced", "inserted", "deleted"):
            at = len(words) // 2 + rng.randrange(-2, 3)
            new = {"replaced": ["edited"], "inserted": ["edited", words[at]], "deleted": []}[kind]
            want.add((len(texts), i))
            texts.append(PROSE + " ".join(words[:at] + new + words[at + 1 :]) + " " + PROSE)
    got = found(spark, texts, items)
    assert want <= set(got)


def test_short_quote(spark):
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    words = item.split()
    got = found(spark, [PROSE + " ".join(words[20:36]) + " " + PROSE, PROSE + " ".join(words[20:27]) + " " + PROSE], [item])
    assert set(got) == {(0, 0)}


def test_other_values(spark):
    texts = [
        ITEM.upper(),
        ITEM.lower(),
        ITEM.replace("12", "3.5").replace("7", "1,000").replace("Alice", "Peter"),
        re.sub("12|7", "5", ITEM),
        RIDE.replace("Alice", "Peter").replace("5 km", "80km").replace("12", "1,200"),
        "\n" + RIDE.replace("Alice", "Peter").upper(),
        PROSE * 4,
    ]
    got = found(spark, texts, [ITEM, RIDE])
    assert got == {(0, 0): True, (1, 0): True, (2, 0): False, (3, 0): False, (4, 1): False, (5, 1): True}


def test_document_in_capitals_of_the_first_test(spark):
    assert found(spark, [ITEM.upper()], [ITEM]) == {(0, 0): True}


def test_short_and_odd_items_are_searched_whole(spark):
    items = ["What is the capital of France today?", "one two three", "1 2 3 4 5 6 7 8 9 10", "", "la la la la la la la la la la la la", "?"]
    texts = [
        PROSE + "what is the capital of France TODAY " + PROSE,
        PROSE + "what is the capital of Spain today " + PROSE,
        "one two, three",
        "one two four three",
        "0 1 2 3 4 5 6 7 8 9 10 11",
        "1 2 3 4 5 6 7 8 9 11",
        "la " * 12,
        "la " * 9,
        "",
    ]
    assert set(found(spark, texts, items)) == {(0, 0), (2, 1), (4, 2), (6, 4)}


def plain_search(text, item):
    """Best share of an item's template windows that one band of offsets holds, searched in plain Python."""
    mask = lambda t: [("0" if w[0].isdigit() else "2" if w[1:] and w[0].isupper() and w[1:].islower() else w.lower()) for w in re.findall(r"[0-9]+(?:[.,][0-9]+)*|[A-Z][a-z]+(?![A-Za-z])(?: [A-Z][a-z]+(?![A-Za-z]))*|[A-Za-z]+", t)]
    a, b = mask(item), mask(text)
    where, best = {}, 0.0
    for i in range(len(a) - 4):
        if sum(w not in "012" for w in a[i : i + 5]) >= 3:
            where.setdefault(tuple(a[i : i + 5]), i)
    for shift in range(-len(a), len(b)):
        words = set()
        for w, i in where.items():
            if any(tuple(b[i + s : i + s + 5]) == w for s in range(max(-i, shift), shift + 8)):
                words |= set(range(i, i + 5))
        best = max(best, len(words) / max(1, len({j for i in where.values() for j in range(i, i + 5)})))
    return best


def reworded(rng, item):
    """Other numbers and names, and a word more."""
    words = re.sub(r"\d+", lambda m: str(rng.randint(2, 1_500)), item).replace("Alice", rng.choice(["Peter", "Mary Ann"])).split()
    words.insert(rng.randrange(3, len(words) - 3), "very")
    return " ".join(words)


def test_recall_on_reworded_copies(spark):
    rng = random.Random(11)
    nouns = "farmer garden window bottle ticket market letter basket engine harbour meadow candle pocket bridge kettle ladder barrel pencil mirror saddle".split()
    items = []
    for _ in range(60):
        a, b, c, d, e = (rng.choice(nouns) for _ in range(5))
        items.append(f"The {a} of Alice holds {rng.randint(2, 99)} things near the {b} and {rng.randint(100, 999)} more in every {c}, so how many does the {d} need before it reaches the {e} again?")
    texts = [PROSE + reworded(rng, x) + " " + PROSE for x in items]
    clean = [" ".join(rng.choice(nouns + "the of and a in to was it".split()) for _ in range(120)) for _ in range(40)]
    got = {k for k in found(spark, texts + clean, items)}
    hit = sum((i, i) in got for i in range(len(items)))
    print("recall on reworded copies", hit / len(items))
    assert hit >= 0.9 * len(items)
    assert not any(d >= len(texts) for d, _ in got)
    # whatever a plain search finds by a wide margin is found
    assert {(d, i) for d in range(12) for i in range(12) if plain_search(texts[d], items[i]) >= 0.8} <= got


SHORT_FORMS = [
    "Solve {0}x + {1} = {2} for x.", "{0} + {1} = ?", "{0} * {1} - {2} = ?", "What is {0} plus {1}?", "What is {0}% of {1}?", "How many minutes are {0} hours?", "Alice has {0} apples and {1} pears?", "Is {0} > {1}?",
    "Find y if y^2 = {0}.", "Round {0}.{1} to a whole number.", "Convert {0} km to miles?", "Who is older, Alice or Bob?",
]


def test_short_items_asked_with_other_values(spark):
    """Recall on short templates with other values; prose with numbers and names, and inconsistent values, hold none."""
    rng = random.Random(17)
    numbers = lambda: [str(x) for x in rng.sample(range(2, 900), 3)]
    items = [f.format(*numbers()) for f in SHORT_FORMS for _ in range(3)]
    texts = [PROSE + SHORT_FORMS[i // 3].format(*numbers()).replace("Alice", "Mary Ann").replace("Bob", "Karl") + " " + PROSE for i in range(len(items))]
    clean = [f"In {rng.randrange(1900, 2020)} the town had {rng.randrange(2, 900)} houses and {rng.randrange(2, 99)} wells, Alice wrote. It is {rng.randrange(9)} km to Bob. " + PROSE for _ in range(60)]
    clean += ["They say 8 + 9 = 17 is a sum.", "Round the house 12.5 to a whole number", "What is plus?", "Solve it for x = 3"]
    got = set(found(spark, texts + clean, [*items, "6 + 6 = ?"]))
    hit = [any((d, i) in got for i in range(d // 3 * 3, d // 3 * 3 + 3)) for d in range(len(texts))]
    print("recall on short items", sum(hit) / len(hit), sorted({SHORT_FORMS[d // 3] for d, h in enumerate(hit) if not h}))
    assert sum(hit) >= 0.9 * len(hit)
    assert not [d for d, _ in got if d >= len(texts)]


def test_values_of_short_items_fit_each_other(spark):
    items = ["6 + 6 = ?", "Is 4 > 7?", "7 years"]
    assert set(found(spark, ["8 + 8 = ?", "8 + 9 = ?", "so is 4 > 7? yes", "Is 9 > 12?", "12 years", "7 years", "about 7 years ago"], items)) == {(0, 0), (2, 1), (3, 1), (5, 2), (6, 2)}
