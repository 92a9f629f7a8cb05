"""Fill-in-the-middle by ropes.

A text is a balanced tree whose leaves hold up to ``LEAF`` units (runs of letters, or single
other characters) and know how many units and code points they have; inner nodes know the
sums. The tree is split at two ranks of units, the three subtrees are joined in another
order with sentinels between them, and the text is what the new tree reads. The way back
needs that text and its form alone: its tree is split at the sentinels and joined again.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import added, quoted

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Units of a leaf.
LEAF = 256
_UNIT = re.compile(r"[A-Za-z]++|[^A-Za-z]")
_LEAF = re.compile(rf"(?:[A-Za-z]++|[^A-Za-z]){{1,{LEAF}}}+")


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf with its text, or a node with two subtrees."""

    units: int
    chars: int
    text: str | None
    left: Rope | None = None
    right: Rope | None = None

    def __add__(self, other: Rope) -> Rope:
        """The two ropes one after the other; costs nothing but a node."""
        if not self.chars or not other.chars:
            return self if self.chars else other
        return Rope(self.units + other.units, self.chars + other.chars, None, self, other)

    def __str__(self) -> str:
        todo, out = [self], []
        while todo:
            at = todo.pop()
            if at.text is None:
                todo += [at.right, at.left]
            else:
                out.append(at.text)
        return "".join(out)

    def split(self, rank: int, by: str = "units") -> tuple[Rope, Rope]:
        """What is before and after the first ``rank`` units (or, with ``by="chars"``, code points)."""
        if rank <= 0 or rank >= getattr(self, by):
            return (EMPTY, self) if rank <= 0 else (self, EMPTY)
        if self.text is not None:
            at = rank if by == "chars" else next(islice(_UNIT.finditer(self.text), rank - 1, None)).end()
            return leaf(self.text[:at]), leaf(self.text[at:])
        here = getattr(self.left, by)
        if rank < here:
            a, b = self.left.split(rank, by)
            return a, b + self.right
        a, b = self.right.split(rank - here, by)
        return self.left + a, b


def leaf(text: str) -> Rope:
    return Rope(len(_UNIT.findall(text)), len(text), text)


EMPTY = leaf("")


def rope(text: str) -> Rope:
    """The balanced tree of a text."""
    parts = _LEAF.findall(text)
    level = [*(Rope(LEAF, len(x), x) for x in parts[:-1]), *map(leaf, parts[-1:])] or [EMPTY]
    while len(level) > 1:
        level = [a + b for a, b in zip(level[::2], level[1::2], strict=False)] + level[len(level) // 2 * 2 :]
    return level[0]


def draws(key: str, seed: int) -> list[int]:
    """Four numbers from the hash of seed and key."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(text: str, key: str, seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    tree = rope(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_share:
        return tree.units, PLAIN, None, None, text
    first, last = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    rest, suffix = tree.split(last)
    prefix, middle = rest.split(first)
    p, s, m = map(leaf, (PREFIX, SUFFIX, MIDDLE))
    form = SPM if h4 % 100 < spm_share else PSM
    out = s + suffix + p + prefix + m + middle if form == SPM else p + prefix + s + suffix + m + middle
    return tree.units, form, prefix.chars, middle.chars, str(out)


def rebuild(output: str, form: str) -> str:
    """The text that ``arrange`` was given."""
    if form == PLAIN:
        return output
    # the text holds no sentinel, and none arises where parts meet: only its first character is "<"
    second, width = PREFIX if form == SPM else SUFFIX, len(MIDDLE)
    at = output.index(second)
    parts, mark = rope(output).split(output.index(MIDDLE), "chars")
    middle = mark.split(width, "chars")[1]
    one, two = parts.split(at, "chars")
    one, two = one.split(width, "chars")[1], two.split(width, "chars")[1]
    prefix, suffix = (two, one) if form == SPM else (one, two)
    return str(prefix + middle + suffix)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "fim", seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """``docs`` with its text replaced by a struct ``name``: n (units), form, prefix_chars, middle_chars
    (code points; null if plain) and output.

    Cuts and form follow from a hash of ``seed`` and id alone, so rows of one id are cut at the same
    random numbers; a null id counts as an empty one. ``plain_share`` and ``spm_share`` are per cent. Null
    and empty texts, and those that hold a sentinel, are plain. Repeated rows stay repeated; a column
    already called ``name`` is replaced; all others pass untouched. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in (text_col, name)]
    kind = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
    names = ("n", "form", "prefix_chars", "middle_chars", "output")

    def each(ids: list, texts: list) -> list:
        return [[dict(zip(names, arrange(t or "", i or "", seed, plain_share, spm_share), strict=True)) for i, t in zip(ids, texts, strict=True)]]

    return added(docs, keep, [F.col(quoted(id_col)).cast("string"), F.col(quoted(text_col))], f"{quoted(name)} {kind}", each)


def restore(rows: DataFrame, name: str = "fim", to: str = "text") -> DataFrame:
    """``rows`` with column ``to``: the text rebuilt from output and form in struct ``name``, which stays. A
    null struct gives null; a column already called ``to`` is replaced."""
    keep = [c for c in rows.columns if c != to]
    made = F.col(quoted(name))
    return added(rows, keep, [made["output"], made["form"]], f"{quoted(to)} string", lambda outs, forms: [[None if o is None else rebuild(o, f) for o, f in zip(outs, forms, strict=True)]])
