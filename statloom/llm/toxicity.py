"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and of their letter trigrams, which also know
spellings that no training document has. Words that name groups of people share trigrams
with other words, so a model of this kind judges them by their looks. Therefore each labelled
document gives a sentence that mentions an identity term (its own, or one that is put there),
the term is swapped for another of its group and left out, and both changes of the score are
penalised: a neutral mention of a group moves the score as little as that of any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import added, keep_rows, materialize, per_row, quoted, text_of

#: Terms for groups of people in four languages; a term is swapped for others in its line.
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("women", "men", "girls", "boys"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrant", "refugee", "foreigner", "citizen", "native"),
    ("deaf", "blind", "disabled", "old", "young"),
    ("frau", "mann", "mädchen", "junge"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("ausländer", "flüchtling", "einheimischer"),
    ("femme", "homme", "fille", "garçon"),
    ("musulman", "chrétien", "juif", "hindou", "athée"),
    ("immigré", "réfugié", "étranger", "citoyen"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmán", "cristiano", "judío", "hindú", "ateo"),
    ("inmigrante", "refugiado", "extranjero", "ciudadano"),
)
_GROUP = {t: line for line in IDENTITY_TERMS for t in line}
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’¿¡…–—"


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words of a text without punctuation at their ends."""
    return {w.strip(_EDGES) for w in set((text or "").lower().split())} - {""}


#: Marks a trigram among the features; "^" and "$" stand for a word's ends.
_PART = "\x00"
_SENTENCE = re.compile(r"[.!?\n]+")


def parts_of_word(word: str) -> set[str]:
    """Letter trigrams of one word."""
    w = f"^{word}$"
    return {_PART + w[i : i + 3] for i in range(len(w) - 2)}


def features(words: set[str]) -> set[str]:
    """The words and their trigrams."""
    return words.union(*map(parts_of_word, words))


def counterfactuals(text: str | None) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets between which a text's score should not change.

    One sentence of the text is picked by a fixed rule, one with an identity term if there is
    any. If it has none, a term is put there. The pairs: with the term and with another of its
    group; with the term and without it.
    """
    own = [w for w in map(words_of, _SENTENCE.split(text or "")) if w]
    told = [w for w in own if w & _GROUP.keys()]
    rule = crc32((text or "").encode())
    base = (told or own or [set()])[rule % max(1, len(told or own))]
    found = sorted(base & _GROUP.keys())
    line = IDENTITY_TERMS[rule // 7 % len(IDENTITY_TERMS)] if not found else _GROUP[found[0]]
    term = found[0] if found else line[rule // 119 % len(line)]
    rest, others = base - {term}, [x for x in line if x != term]
    return [(rest | {term}, rest | {others[rule // 833 % len(others)]}), (rest | {term}, rest)]


def _grams(words: set[str]) -> set[str]:
    """Trigrams of all the words at once; those that span two words are no features."""
    s = f"^{'$^'.join(words)}$"
    return set(map("".join, zip(s, s[1:], s[2:], strict=False)))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.words = {k: v for k, v in self.weights.items() if k[0] != _PART}
        self.parts = {k[1:]: v for k, v in self.weights.items() if k[0] == _PART}

    def logit(self, words: set[str]) -> float:
        z = self.bias + sum(map(self.words.__getitem__, words & self.words.keys()))
        return z + sum(map(self.parts.__getitem__, _grams(words) & self.parts.keys())) if self.parts and words else z

    def score(self, text: str | None) -> float:
        """0 to 1; higher: likelier toxic. Null counts as empty."""
        return float(1 / (1 + np.exp(-np.clip(self.logit(words_of(text)), -500, 500))))

    def scores(self, texts: list) -> np.ndarray:
        return np.fromiter(map(self.score, texts), float, len(texts))


def group_gap(model: Model, sentences: list[str]) -> float:
    """Mean, over neutral sentences and groups of terms, of the range of scores when a term is put there."""
    gaps = []
    for words in map(words_of, sentences):
        for line in IDENTITY_TERMS:
            z = [1 / (1 + np.exp(-np.clip(model.logit(words | {t}), -500, 500))) for t in line]
            gaps.append(max(z) - min(z))
    return float(np.mean(gaps)) if gaps else 0.0


def training_rows(labels: DataFrame, label: str, limit: int, fold: int, out: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y): labelled rows outside the held-out remainder; about ``limit`` of them at most,
    taken by a hash of the id."""
    held = F.crc32(F.col(id_col).cast("string")) % fold == out
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    share = min(1.0, limit / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", limit: int = 12_000, vocabulary: int = 4_000,
    min_docs: int = 3, least_z: float = 2.5, ridge: float = 1.0, fairness: float = 5.0, at: float = 0.7, fold: int = 3, out: int = 1,
) -> Model:
    """Train on at most about ``limit`` labelled documents (the bound on what is broadcast or
    reaches the driver), those with crc32(id) mod ``fold`` = ``out`` left out.

    Features: words and trigrams in ``min_docs`` documents or more whose log odds are at least
    ``least_z`` standard errors from zero, ``vocabulary`` of them at most, and the identity
    terms. ``fairness`` weighs the squared change of the score in ``counterfactuals``. A fifth of
    the sample sets the decision threshold, which is shifted to ``at``. Without labels of both
    kinds the model gives every text its prior.
    """
    rows = training_rows(labels, label, limit, fold, out, id_col)

    def wordy(texts: list) -> list:
        pairs = [[(features(a), features(b)) for a, b in counterfactuals(t)] for t in texts]
        more, less = ([[sorted(x[k] - x[1 - k]) for x in p] for p in pairs] for k in (0, 1))
        return [[sorted(features(words_of(t))) for t in texts], more, less]

    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).join(F.broadcast(rows), "id")
    sample = materialize(per_row(texts, "t", "w array<string>, more array<array<string>>, less array<array<string>>", wordy), "toxic-sample")
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (n1 + 1) / (n + 2)
    if not 0 < n1 < n:
        return Model({}, float(np.log(prior / (1 - prior))))
    counts = sample.select("y", F.explode("w").alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    z = (F.log(a / (F.lit(n1) + 1 - a)) - F.log(b / (F.lit(n - n1) + 1 - b))) / F.sqrt(1 / a + 1 / b)
    picked = counts.where(F.col("a") + F.col("b") >= min_docs).where(F.abs(z) >= least_z).orderBy(F.desc(F.abs(z)), "w").limit(vocabulary)
    vocab = [r["w"] for r in picked.collect()]
    vocab += [t for t in _GROUP if t not in set(vocab)]
    number = {w: i for i, w in enumerate(vocab)}

    def indexed(words: list, more: list, less: list) -> list:
        of = lambda ws: [number[w] for w in ws if w in number]
        return [[of(ws) for ws in words], *([[of(ws) for ws in pairs] for pairs in lists] for lists in (more, less))]

    fold_of = (F.floor(F.crc32(F.col("id").cast("string")) / fold) % 5).cast("int")
    data = per_row(sample.select(fold_of.alias("k"), "y", "w", "more", "less"), ("w", "more", "less"), "x array<int>, p array<array<int>>, q array<array<int>>", indexed)
    data = data.toDF("k", "y", "w", "more", "less").toPandas()
    w, bias = _logistic(data[data["k"] > 0], len(vocab), ridge, fairness)
    rest = data[data["k"] == 0]
    shift = 0.0
    if 0 < rest["y"].sum() < len(rest):
        shift = _best_cut(np.array([bias + w[list(x)].sum() for x in rest["w"]]), rest["y"].to_numpy())
    w, bias = _logistic(data, len(vocab), ridge, fairness)
    keep = np.abs(w) > 1e-6
    return Model({v: float(x) for v, x, k in zip(vocab, w, keep, strict=True) if k}, float(bias - shift + np.log(at / (1 - at))))


def _csr(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    cols = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(lists)), sizes), cols


def _logistic(data: pd.DataFrame, k: int, ridge: float, fairness: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent with adaptive steps."""
    y = data["y"].to_numpy(float)
    rows, cols = _csr(data["w"])
    more, less = (pd.Series([ws for pairs in data[c] for ws in pairs], dtype=object) for c in ("more", "less"))
    pairs = len(more)
    prow, pcol = _csr(more)
    vrow, vcol = _csr(less)
    w = np.zeros(k + 1)
    w[k] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        err = 1 / (1 + np.exp(-(w[k] + np.bincount(rows, w[cols], len(y))))) - y
        g = np.append(np.bincount(cols, err[rows], k) + ridge * w[:k], err.sum()) / len(y)
        if pairs and fairness:
            change = np.bincount(prow, w[pcol], pairs) - np.bincount(vrow, w[vcol], pairs)
            g[:k] += 2 * fairness / pairs * (np.bincount(pcol, change[prow], k) - np.bincount(vcol, change[vrow], k))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:k], float(w[k])


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Cut with the best F1; among equals the middle of the widest gap."""
    values = np.unique(z)
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1)
    hit = np.array([(y[z >= c].sum(), (z >= c).sum()) for c in cuts])
    f1 = 2 * hit[:, 0] / np.maximum(1, hit[:, 1] + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    gaps = np.append(values[1:] - values[:-1], 0)
    return float(cuts[best[np.argmax(gaps[best])]])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without its text, with ``name``: the toxicity of each row's whole text.

    Null and empty texts get the score of no words. Repeated rows stay repeated. A column
    already called ``name`` is replaced; all others pass untouched.
    """
    keep = [c for c in docs.columns if c not in (text_col, name)]
    return added(docs, keep, [F.col(quoted(text_col))], f"{quoted(name)} double", lambda texts: [model.scores(texts)])


def reject(docs: DataFrame, model: Model, at: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``at`` or more; columns and values as before."""
    return keep_rows(docs, text_col, lambda texts: model.scores(texts) < at)
