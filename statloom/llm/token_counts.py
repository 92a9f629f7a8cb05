"""Token counts by trie-shared dynamic programming under a unigram vocabulary.

The distinct pre-tokens of a batch form a trie (in sorted order its branches are shared
prefixes). Walking it, the best segmentation's score and count up to each depth and the
vocabulary entries still open there are computed once for each shared prefix; terminals
store their counts.

The vocabulary has merge ranks instead of probabilities, so a piece's probability follows
from its rank by the law of Zipf and Mandelbrot. The best segmentation has a little fewer
tokens than the merges that the vocabulary's own library applies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from math import log
from os.path import commonprefix

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import per_row

#: Marks the start of a pre-token in the vocabulary.
SPACE = "▁"
#: Mandelbrot's offset of a piece's rank.
OFFSET = 1000.0
#: Pre-tokens whose counts a worker remembers before it starts anew, and the longest it keeps.
MEMORY_WORDS, MEMORY_CHARS = 400_000, 64


class Vocabulary:
    """Pieces and log scores as a trie of dicts; the entry under "" is a piece's score."""

    def __init__(self, pieces: Iterable[tuple[str, float]]):
        self.root: dict = {}
        least = 0.0
        for piece, score in pieces:
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
            least = min(least, score)
        #: An unknown character costs more than any piece and counts its UTF-8 bytes.
        self.unknown = least - 10.0
        #: Counts of pre-tokens (without the mark) that this process has seen.
        self.known: dict[str, int] = {}

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens in the best segmentation of each word; of equal scores the fewest tokens."""
        out: dict[str, int] = {}
        best: list[tuple[float, int]] = [(0.0, 0)]  # by depth: score, minus tokens
        alive: list[list[tuple[int, dict]]] = [[]]  # by depth: where open entries began, and their nodes
        before = ""
        for word in sorted(words):
            shared = len(commonprefix((before, word)))
            del best[shared + 1 :], alive[shared + 1 :]
            for depth in range(shared, len(word)):
                c = word[depth]
                now = [(i, node[c]) for i, node in alive[depth] if c in node]
                if c in self.root:
                    now.append((depth, self.root[c]))
                top = (best[depth][0] + self.unknown, best[depth][1] - len(c.encode()))
                for i, node in now:
                    if "" in node:
                        s, n = best[i]
                        found = (s + node[""], n - 1)
                        if found > top:
                            top = found
                best.append(top)
                alive.append(now)
            out[word] = -best[len(word)][1]
            before = word
        return out


def log_probabilities(ranks: list[float], offset: float = OFFSET) -> list[float]:
    """Zipf-Mandelbrot for scores that are merge ranks (0, -1, ...): p ~ 1 / (rank + offset).

    The offset flattens the top, as early merges mostly live on inside later ones. Entries
    outside the ranks count as last.
    """
    at = [-x if -x < len(ranks) else len(ranks) for x in ranks]
    total = log(sum(1 / (r + offset) for r in at))
    return [-log(r + offset) - total for r in at]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Pieces of a sentencepiece model but for its control, unknown and byte entries."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return Vocabulary(zip(map(sp.id_to_piece, own), log_probabilities([min(0.0, sp.get_score(i)) for i in own]), strict=True))


_RUNS = re.compile(" [^ ]+| +(?= [^ ])| +$")


def pre_tokens(text: str | None) -> list[str]:
    """What a text's spaces divide, each without its one space; a further run of spaces is one of its
    own (without one of them). Line breaks and tabs stay inside, as characters to be counted."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_distinct, n_tokens) for each row's whole text.

    Words are ``pre_tokens``; a mark stands for each space and one for the text's start, as in
    the vocabulary. Null and empty texts have none. Repeated rows stay repeated; extra columns
    are ignored; an empty table gives an empty result.
    """

    def each(texts: list) -> list:
        vocab = vocabulary(model)
        known = vocab.known
        words = [Counter(pre_tokens(t)) for t in texts]
        new = {w for c in words for w in c if w not in known}
        if len(known) + len(new) > MEMORY_WORDS:
            known.clear()
            new = {w for c in words for w in c}
        found = vocab.counts((SPACE + w).replace(" ", SPACE) for w in new)
        counts = {w: found[(SPACE + w).replace(" ", SPACE)] for w in new}
        known.update((w, n) for w, n in counts.items() if len(w) <= MEMORY_CHARS)
        long = {w: n for w, n in counts.items() if len(w) > MEMORY_CHARS}
        total = [sum(k * (known[w] if w in known else long[w]) for w, k in c.items()) for c in words]
        return [[c.total() for c in words], list(map(len, words)), total]

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return per_row(rows, "t", "n_words bigint, n_distinct bigint, n_tokens bigint", each).withColumnRenamed("i", id_col)
