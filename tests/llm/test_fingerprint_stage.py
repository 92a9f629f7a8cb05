"""The pipeline's near-duplicates come by fingerprints, and by MinHash bands where those don't reach."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from statloom.llm import shingles, simhash


def test_fingerprints_of_shingles_are_those_of_simhash():
    for text in (None, "", "One", "a b c d", "A b c d e f g " * 700, "x y"):
        want = simhash.simhash(text, 5)
        assert shingles.fingerprint(shingles.shingle_hashes(text)) % (1 << 64) == want


def test_stage_links_by_fingerprints_without_any_band(spark, sf_dir, monkeypatch):
    g = np.random.default_rng(4)
    base = [f"w{i}" for i in g.integers(0, 5000, 4000)]
    other = [f"v{i}" for i in g.integers(0, 5000, 300)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "end"])), (3, " ".join(other)), (4, " ".join(["start", *base]))]
    assert all(0 <= (simhash.simhash(rows[0][1], 5) ^ simhash.simhash(t, 5)).bit_count() <= 3 for i, t in rows if i != 3)
    nodes = shingles.nodes
    monkeypatch.setattr(shingles, "nodes", lambda *a: nodes(*a).withColumn("keys", F.array().cast("array<bigint>")))
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_close_fingerprints_of_different_texts_stay(spark):
    # equal counts of few shingles: fingerprints meet, sets differ too much
    rows = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "a b c d e f")]
    assert sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 2]
