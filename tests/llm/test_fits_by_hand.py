"""Both classifiers against plain numpy: features, objectives at their minimum, thresholds and every score."""

import zlib

import numpy as np
import pytest

from statloom.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


def plain_features(text):
    words = {w.strip(toxicity._EDGES) for w in (text or "").lower().split()} - {""}
    return words | {"\x00" + f"^{w}$"[i : i + 3] for w in words for i in range(len(w))}


def minimum(x, y, gaps, ridge, fairness):
    """Newton's method on mean log loss + ridge / 2n |w|^2 + fairness * mean squared gap; the bias is the last entry."""
    n, k = x.shape
    one = np.column_stack([x, np.ones(n)])
    fixed = np.zeros((k + 1, k + 1))
    fixed[:k, :k] = ridge / n * np.eye(k) + 2 * fairness / len(gaps) * gaps.T @ gaps
    w = np.zeros(k + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-one @ w))
        step = np.linalg.solve(one.T * (p * (1 - p)) @ one / n + fixed + 1e-12 * np.eye(k + 1), one.T @ (p - y) / n + fixed @ w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w, lambda v: float(np.mean(np.logaddexp(0, one @ v) - y * (one @ v)) + v @ fixed @ v / 2)


def test_toxicity_is_the_penalised_fit(spark, tables):
    docs, labels = tables
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [(t, labels[i]["toxic"]) for i, t in docs if i in labels and labels[i]["toxic"] is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    y = np.array([v for _, v in kept], float)
    sets = [plain_features(t) for t, _ in kept]
    count = {}
    for s, v in zip(sets, y, strict=True):
        for f in s:
            count.setdefault(f, [0, 0])[int(v)] += 1
    n1, n = y.sum(), len(y)
    vocab = []
    for f, (b, a) in count.items():
        a, b = a + 0.5, b + 0.5
        z = (np.log(a / (n1 + 1 - a)) - np.log(b / (n - n1 + 1 - b))) / np.sqrt(1 / a + 1 / b)
        if a + b - 1 >= 3 and abs(z) >= 2.5:
            vocab.append((-abs(z), f))
    vocab = [f for _, f in sorted(vocab)[:4000]]
    vocab += [t for line in toxicity.IDENTITY_TERMS for t in line if t not in vocab]
    vocab = list(dict.fromkeys(vocab))
    assert set(model.weights) <= set(vocab) and len(model.weights) > 100
    at = {f: i for i, f in enumerate(vocab)}
    grid = lambda rows: np.array([[f in s for f in vocab] for s in rows], float)
    of = lambda words: toxicity.features(words)
    pairs = [p for t, _ in kept for p in toxicity.counterfactuals(t)]
    gaps = grid([of(a) for a, _ in pairs]) - grid([of(b) for _, b in pairs])
    x = grid(sets)
    best, loss = minimum(x, y, gaps, 1.0, 5.0)
    mine = np.zeros(len(vocab) + 1)
    for f, w in model.weights.items():
        mine[at[f]] = w
    mine[-1] = min(np.linspace(best[-1] - 2, best[-1] + 2, 4001), key=lambda b: loss(np.append(mine[:-1], b)))  # the model's own holds the threshold
    none = np.append(np.zeros(len(vocab)), np.log(n1 / (n - n1)))
    print("loss", loss(mine), "minimum", loss(best), "without words", loss(none))
    assert loss(mine) - loss(best) <= 0.01 * (loss(none) - loss(best))
    a, b = (1 / (1 + np.exp(-(x @ v[:-1] + v[-1]))) for v in (mine, best))
    assert np.abs(a - b).max() < 0.05
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, SF).collect()}
    for i, t in docs:
        want = 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in plain_features(t)))))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_the_cut_has_the_best_f1():
    g = np.random.default_rng(4)
    for n in (3, 20, 200):
        z, y = np.round(g.normal(size=n), 1), (g.random(n) < 0.3).astype(int)
        y[:2] = 0, 1
        f1 = lambda c: 2 * (y[z >= c] == 1).sum() / ((z >= c).sum() + y.sum())  # noqa: B023, E731
        assert f1(toxicity._best_cut(z, y)) == pytest.approx(max(map(f1, np.append(z, z.max() + 1))))


@pytest.mark.parametrize("text", ["a muslim baker sold bread. It was good.", "nothing of the kind here", "", None])
def test_counterfactuals_swap_one_term(text):
    (a, b), (c, d) = toxicity.counterfactuals(text)
    (old,), (new,) = a - b, b - a
    assert any(old in line and new in line for line in toxicity.IDENTITY_TERMS)
    assert a == c and c - d == {old} and not d - c


def test_quality_is_the_pairwise_fit(spark, tables):
    docs, labels = tables
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = sorted((i, t, labels[i]["quality"]) for i, t in docs if i in labels and labels[i]["quality"] is not None and zlib.crc32(str(i).encode()) % 5 != 0)
    y = np.array([v for _, _, v in kept])
    x = np.stack([quality.features(t) for _, t, _ in kept])
    u = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    few, many = (good, bad) if len(good) < len(bad) else (bad, good)
    ours = np.repeat(few, 20)
    theirs = many[np.random.default_rng(5).integers(0, len(many), len(ours))]
    d = np.array([u[a] - u[b] if y[a] == 1 else u[b] - u[a] for a, b in zip(ours, theirs, strict=True)])

    def loss(w):
        return np.mean(np.logaddexp(0, -d @ w)) + 1e-3 / 2 * w @ w

    w, step = np.zeros(u.shape[1]), 1 / (np.linalg.eigvalsh(d.T @ d / len(d))[-1] / 4 + 1e-3)
    v, t = w.copy(), 1.0
    for _ in range(40_000):  # accelerated descent, no second derivatives
        new = v + step * (d.T @ (1 / (1 + np.exp(d @ v))) / len(d) - 1e-3 * v)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    assert loss(model.weights) <= loss(w) + 1e-9 and model.weights == pytest.approx(w, abs=1e-3)
    strength = u @ model.weights
    assert model.cut == pytest.approx(np.quantile(strength, np.mean(y == 0)))
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, SF).collect()}
    for i, text in docs:
        f = np.clip((quality.features(text) - x.mean(0)) / (x.std(0) + 1e-9), -6, 6)
        want = 1 / (1 + np.exp(-(f @ model.weights - model.cut + np.log(0.3 / 0.7))))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_features_of_form_by_hand():
    f = dict(zip(quality.FEATURES, quality.features("Aa bb\nbb 7!\n"), strict=True))
    assert f["log_bytes"] == pytest.approx(np.log(13)) and f["log_words"] == pytest.approx(np.log(5))
    assert f["word_length"] == 6 / 4 and f["distinct_words"] == 3 / 4 and f["upper"] == 1 / 6 and f["digits"] == 1 / 12
    assert f["top_word"] == 2 / 4 and f["repeated_lines"] == 0 and f["capital_words"] == 1 / 4 and f["ended_words"] == 1 / 4
