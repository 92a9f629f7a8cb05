"""The pipeline's near-duplicate stage against all pairs, with planted near copies."""

import random

import corpus_pipeline
from statloom.llm import simhash

rng = random.Random(5)


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows, least=0.8):
    """The kept (id, text) of all pairs' components: the smallest of each."""
    rows = sorted(set(rows), key=lambda r: (r[0], r[1] or ""))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])) and similarity(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[find(i)][0] for i in range(len(rows))}


def edited(text, n):
    """``text`` with ``n`` words replaced, far from each other."""
    w = text.split()
    for i in range(n):
        w[(2 * i + 1) * len(w) // (2 * n)] = f"edit{rng.random()}"
    return " ".join(w)


def test_stage_removes_near_copies(spark, sf_dir, texts):
    rows = list(texts.items())
    new, found = max(texts) + 1, []
    for _, text in [r for r in rows if len((r[1] or "").split()) > 150][:40]:
        for share in (0.006, 0.012, 0.018, 0.022):
            copy = edited(text, max(1, int(share * len(text.split()))))
            found.append(similarity(shingles(text), shingles(copy)))
            rows.append((new, copy))
            new += 1
    assert sum(0.8 <= x < 0.95 for x in found) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == groups(rows)


def test_band_members_that_miss_the_hub_are_compared(spark):
    """A chain, a crowd of copies of one text, and texts of one common passage that are no copies."""
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(200)]
    rows = []
    for i in range(12):  # neighbours are alike, the ends aren't
        base = base[15:] + [word() for _ in range(15)]
        rows.append((i, " ".join(base)))
    crowd = " ".join(word() for _ in range(300))
    rows += [(100 + i, edited(crowd, 1 + i % 5)) for i in range(80)]
    passage = " ".join(word() for _ in range(100))
    rows += [(300 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(40)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == groups(rows) and {0, 100} < kept and len(kept) == 42


def test_rows_of_one_id(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (1, "a b c d e f"), (2, "U V w x y z"), (2, None), (3, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, "a b c d e f"), (1, "u v w x y z"), (2, "")]
