"""Quality by Bradley-Terry pairwise ranking.

Pairs of a good and a bad labelled document are preferences. Logistic loss on the difference
of their features learns a score for single documents; a quantile of the scores is the
threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import added, per_row, quoted, text_of
from statloom.llm.toxicity import training_rows

FEATURES = (
    "log_bytes", "log_words", "word_length", "long_words", "distinct_words", "upper", "digits", "symbols", "marks", "exclaim", "pipes", "stops", "spaces",
    "lines", "line_length", "repeated_lines", "entropy", "top_word", "capital_words", "ended_words", "log_bytes2",
)
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = True


def features(text: str | None) -> np.ndarray:
    """Numbers that describe the form of one whole text; null counts as empty."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = c[c > 0] / n
    share = lambda x: float(x) / n
    letters = max(1, int(c[_LETTERS].sum()))
    return np.array(
        [
            np.log1p(len(raw)), np.log1p(len(words)), min(20.0, letters / k), sum(len(w) > 20 for w in words) / k, len(counts) / k,
            c[65:91].sum() / letters, share(c[48:58].sum()), np.sqrt(share(c[_SYMBOLS].sum())), share(c[[44, 46, 58, 59, 63]].sum()), np.sqrt(share(c[33])),
            np.sqrt(share(c[124])), share(c[46]), share(c[32]), np.log1p(len(lines)), np.log1p(n / max(1, len(lines))),
            1 - len(set(lines)) / max(1, len(lines)), float(-(p * np.log2(p)).sum()), max(counts.values(), default=0) / k,
            sum(w[:1].isupper() for w in words) / k, sum(w[-1] in b".,;:!?" for w in words) / k, np.log1p(len(raw)) ** 2 / 10,
        ]
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    at: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry strengths of rows of features."""
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, equal to ``at`` at the threshold; higher: likelier good."""
        z = self.strength(x) - self.cut + np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _featured(rows: DataFrame) -> DataFrame:
    """Replace column t (text) by x (features)."""

    return per_row(rows, "t", "x array<double>", lambda texts: [[features(t) for t in texts]])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", limit: int = 20_000, rivals: int = 20,
    ridge: float = 1e-3, at: float = 0.3, fold: int = 5, out: int = 0,
) -> Model:
    """Train on at most about ``limit`` labelled documents (the bound on what is broadcast or
    reaches the driver, 200 bytes each), those with crc32(id) mod ``fold`` = ``out`` left out.

    Each document of the rarer kind meets ``rivals`` of the other, by a fixed rule. The
    threshold is the quantile of all training scores at the share of bad documents; it gets
    the score ``at``. Without labels of both kinds every text gets the same score.
    """
    rows = training_rows(labels, label, limit, fold, out, id_col)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).join(F.broadcast(rows), "id").select("id", "y", "t")
    data = _featured(texts).orderBy("id").toPandas()
    k = len(FEATURES)
    if not len(data) or data["y"].nunique() < 2:
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, at)
    x, y = np.stack(data["x"]), data["y"].to_numpy()
    model = Model(x.mean(0), x.std(0) + 1e-9, np.zeros(k), 0.0, at)
    u = np.clip((x - model.mean) / model.scale, -6, 6)
    few, many = sorted((np.flatnonzero(y == 1), np.flatnonzero(y == 0)), key=len)
    a = np.repeat(few, rivals)
    b = many[np.random.default_rng(5).integers(0, len(many), len(a))]
    d = (u[a] - u[b]) * (1 if y[few[0]] == 1 else -1)
    w = np.zeros(k)
    for _ in range(30):  # Newton steps on the logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = d.T @ p / len(d) - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    model.cut = float(np.quantile(model.strength(x), (y == 0).mean()))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without its text, with ``name``: the quality of each row's whole text.

    Null and empty texts are scored like any other. Repeated rows stay repeated. A column
    already called ``name`` is replaced; all others pass untouched.
    """
    keep = [c for c in docs.columns if c not in (text_col, name)]
    return added(docs, keep, [F.col(quoted(text_col))], f"{quoted(name)} double", lambda texts: [model.score(np.stack([features(t) for t in texts]))])
