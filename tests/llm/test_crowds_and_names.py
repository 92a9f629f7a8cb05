"""Crowded bands of the near-duplicate stage; operators on tables that have columns of any name."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near_copies import edited, groups, shingles, similarity

from statloom.llm import decontam, fim, packing, pii, png, quality, simhash, token_counts, toxicity
from statloom.llm import shingles as stage
from statloom.llm.common import materialize

rng = random.Random(21)


def words(n, kind="w"):
    return " ".join(f"{kind}{rng.randrange(10**7)}" for _ in range(n))


def test_near_members_of_crowded_bands_are_found(spark):
    """Texts of one passage, most of them no copies; copies of some at 0.8 and more, of other lengths too."""
    passage = words(240, "p")
    rows = [(i, passage + " " + words(60 + i % 5)) for i in range(150)]
    rows += [(1000 + i, edited(rows[i][1], 1 + i % 4)) for i in range(0, 150, 3)]
    rows += [(2000 + i, rows[i][1] + " " + words(10 + i % 60)) for i in range(1, 150, 3)]
    rows = [(i, t) for i, t in rows]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == groups(rows) and 150 <= len(kept) < 220


@pytest.mark.parametrize("same", [150, 240, 270])
def test_rare_shingles_find_every_pair(spark, same):
    """Against all pairs, with sets around the threshold; and no more pairs than near ones for plain passages."""
    passage = words(same, "p")
    rows = [(i, passage + " " + words(300 - same)) for i in range(60)]
    rows += [(100 + i, edited(rows[i][1], k)) for i in range(20) for k in (3, 6, 8)]
    nodes = spark.createDataFrame([(i, i) for i, _ in rows], "node long, root long")
    texts = materialize(spark.createDataFrame(rows, "node long, t string"), "texts")
    pairs = {tuple(sorted(r)) for r in stage._by_rare_shingles(nodes, texts, 5, 0.8).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8}
    assert want <= pairs and (same == 270 or len(pairs) < len(want) + 1500)


def test_candidates_grow_with_the_texts(spark, monkeypatch):
    asked, real = [], stage.verify
    monkeypatch.setattr(stage, "verify", lambda pairs, *rest: (asked.append(pairs.count()), real(pairs, *rest))[1])
    sums = []
    for n in (150, 600):
        passage, asked[:] = words(240, "p"), []
        rows = [(i, passage + " " + words(60)) for i in range(n)]
        assert simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == n
        sums.append(sum(asked))
    assert sums[1] < 6 * sums[0]


#: Names that the operators use for columns of their own.
NAMES = ("_id", "_digest", "id", "digest", "row", "key", "node", "root", "t", "i", "n", "m", "h", "x0", "k0", "v0", "__text", "__media", "__key", "fp", "spans", "base", "w", "raw", "pos", "form", "samples_", "piece")


def test_any_names_of_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    clash = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES}).withColumn("a`b.c", F.lit(1))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    tox, good = toxicity.Model({"the": 1.0, "of": 0.5}, -1.0), quality.Model(*(quality.np.zeros(21), quality.np.ones(21), quality.np.zeros(21)), 0.0, 0.3)
    word, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    media = png.to_media(docs).join(clash.drop("text"), "doc_id")
    filters = {  # rows come out whole
        "keep_one": simhash.keep_one, "reject": lambda d: toxicity.reject(d, tox), "decontaminate": lambda d: decontam.remove_contaminated(d, bench), "redact": pii.redact,
    }
    for name, f in filters.items():
        plain, odd = {(r["doc_id"], r["text"]) for r in f(docs).collect()}, f(clash)
        assert odd.columns == clash.columns, name
        rows = odd.collect()
        assert {(r["doc_id"], r["text"]) for r in rows} == plain, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES) and all(r["a`b.c"] == 1 for r in rows), name
    others = {
        "toxicity": lambda d: toxicity.score(d, tox), "quality": lambda d: quality.score(d, good), "simhash": simhash.near_duplicates, "pii": pii.find, "packing": lambda d: packing.pack(d, word, 1),
        "contaminated": lambda d: decontam.contaminated(d, bench), "counts": lambda d: token_counts.count_tokens(d, piece), "fim": fim.transform, "media": png.to_media,
    }
    for name, f in others.items():
        plain = f(docs)
        cols = [F.col(c) for c in plain.columns]
        odd = f(clash)
        assert sorted(map(str, odd.select(*cols).collect())) == sorted(map(str, plain.collect())), name
        if name in ("toxicity", "quality", "fim"):
            assert all(r[c] == f"{c}{r['doc_id']}" for r in odd.collect() for c in NAMES), name
    read = png.media_features(media)
    assert set(NAMES) <= set(read.columns) and read.where("samples is null").count() == 0
    assert all(r[c] == f"{c}{r['doc_id']}" for r in read.select("doc_id", *NAMES).collect() for c in NAMES)
