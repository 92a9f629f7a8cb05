"""Whole texts to token ids with the tokenizers library, each distinct word encoded once.

The pre-tokenizers of the two vocabularies never join what a space divides, so the ids of a
text are those of its words in a row. Words seen before come from a bounded memory of the
worker process; all others go through the library. Of these, a run of plain letters is a
pre-token as a whole and goes straight to the library's model, and punctuation behind it is
a pre-token of its own, so that a word is asked for once, whatever follows it.

Many texts at once (``encode_all``) stay Arrow data: each distinct word is looked up once, new runs of
letters go to the library's model together, and ids are gathered from the table of distinct words.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that one generation of the memory holds, and the longest word it takes.
MEMORY_WORDS, MEMORY_CHARS = 250_000, 64
_SPACES = re.compile(r" (?:\s|$)")
_BEFORE_WORD = re.compile(r" (?=\S)")
#: Words that the memory of ``encode_all`` holds, and bytes of text that it takes at a time.
TABLE_WORDS, TEXT_BYTES = 600_000, 4 << 20
#: Separators to Python's str.split, but not white space to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Letters that normalisers leave alone but for their case.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII punctuation but the apostrophe, which may begin a pre-token of letters.
_TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: How byte-level vocabularies write bytes: printable ones as they are, others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE, _LINE = chr(_BYTES[32]), chr(_BYTES[10])
#: For Arrow: a run of plain letters, after a line break or not, and white space at an end of a word, behind its line break if it has one.
_LETTERS = r"\A\n?[A-Za-zÀ-ÖØ-öø-ÿ]+"
_LETTERS_ONLY = _LETTERS + r"\z"
_WHITE = r"[\t\x0B-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ODD = rf"\A\n?(?:\z|{_WHITE})|{_WHITE}\z"
#: Words on which the short way must agree with the library before it is taken.
_PROBES = ("a", "Word", "élan", "Être", "word,", "naïve...", "ÄÖÜß", "zzqx", "The)%%%", "one.\nTwo")


class _Letters(dict):
    """How a byte-level vocabulary writes each character."""

    def __missing__(self, c: str) -> str:
        self[c] = out = c.encode().decode("latin-1").translate(_BYTES)
        return out


class _Memory(dict):
    """Ids of words, asked of ``encode`` once. A full generation becomes the old one, whose
    words come back when they are used again, so that frequent words are never lost."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        return self.keep(word, self.encode(word)) if ids is None else self.keep(word, ids)

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= MEMORY_CHARS:
            if len(self) >= MEMORY_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class _Words(_Memory):
    """A memory of plain words; punctuation behind them is looked up by itself. What is composed is kept
    only for words met before, so that rare ones take one place."""

    def __init__(self, encode, tails: _Memory, whole):
        super().__init__(encode)
        self.tails, self.whole = tails, whole

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is not None:
            return self.keep(word, ids)
        core = word.rstrip(_TAIL)
        if (core.isascii() and core.isalpha()) or _PLAIN.fullmatch(core):
            if len(core) == len(word):
                return self.keep(word, self.encode(word))
            met = core in self
            ids = self[core] + self.tails[word[len(core) :]]
            return self.keep(word, ids) if met else ids
        if "\n" in word:
            ids = self.whole(word, True)
            if ids is not None:
                return ids
        return self.keep(word, self.whole(word, False))


class _Table:
    """Words and their ids as Arrow data; those not used for longest go when there are more than ``TABLE_WORDS``."""

    def __init__(self):
        self.words, self.ids, self.used, self.now = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64), 0

    def look_up(self, words: pa.Array, ask: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """Ids of distinct ``words``; ``ask`` gives those of words that aren't here."""
        self.now += 1
        at = pc.index_in(words, self.words)
        lacks = np.asarray(pc.is_null(at))
        at = np.asarray(at.fill_null(0)).astype(np.int64)
        self.used[at[~lacks]] = self.now
        new = words.filter(pa.array(lacks))
        ids = pa.concat_arrays([self.ids, ask(new)])
        at[lacks] = len(self.words) + np.arange(len(new))
        out = ids.take(pa.array(at))
        self.words, self.ids, self.used = pa.concat_arrays([self.words, new]), ids, np.append(self.used, np.full(len(new), self.now))
        if len(self.words) > TABLE_WORDS:
            # a quarter is freed, so that this is rare
            kept = np.sort(np.argsort(-self.used, kind="stable")[: TABLE_WORDS * 3 // 4])
            kept = pa.array(kept[np.asarray(pc.utf8_length(self.words.take(pa.array(kept)))) <= MEMORY_CHARS])
            self.words, self.ids, self.used = self.words.take(kept), self.ids.take(kept), self.used[np.asarray(kept)]
        return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 16-bit bytes (32-bit if ``dtype`` says so)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path) as f:
            spec = json.load(f)
        #: Strings that the library finds in a text before anything else; such a text goes to it whole.
        self._special = [x["content"] for x in spec["added_tokens"]]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]]) if x]
        pre = spec["pre_tokenizer"] or {}
        #: How texts may be divided: before words with their space, into words without space, or not.
        self.by = "whole"
        if not steps and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.by = "space"
        elif steps == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed":
            self.by = "word"
        self._lead = " " if self.by == "space" else ""
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._model, self._letters = self.library.model, _Letters()
        self._tails = _Memory(self._library)
        self._known = _Words(lambda w: self._plain(self._lead + w), self._tails, self._word)
        self._starts = _Words(self._plain, self._tails, self._start)
        if any(x["normalized"] for x in spec["added_tokens"]):  # they are found in normalised text
            self.by = "whole"
        if self.by != "whole" and not all(self._known[w] == self._library(self._lead + w) for w in _PROBES if self.by == "space" or "\n" not in w):
            self._known, self._starts = _Memory(lambda w: self._library(self._lead + w)), _Memory(self._library)
        #: The same model for pre-tokens that are spelt and divided by spaces already, and which ids begin with a space or line break.
        self._spelt = Tokenizer(self._model)
        self._spelt.pre_tokenizer = CharDelimiterSplit(" ")
        self._begins = np.zeros(self.library.get_vocab_size(), bool)
        self._begins[[i for x, i in self.library.get_vocab().items() if x[:1] in (_SPACE, _LINE)]] = True
        self._table = _Table() if self.by == "space" and isinstance(self._known, _Words) and len(self._library("\n")) == self.dtype.itemsize else None

    def _library(self, text: str) -> bytes:
        return array(self._code, self.library.encode_batch_fast((text,), add_special_tokens=False)[0].ids).tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids of one pre-token of letters, with its space before it if it has one."""
        spelt = "".join(map(self._letters.__getitem__, text.lower() if self.by == "word" else text))
        return array(self._code, [x.id for x in self._model.tokenize(spelt)]).tobytes()

    def _word(self, word: str, lines: bool) -> bytes | None:
        """Ids of a word that isn't plain; with ``lines`` only of one that single line breaks divide
        (between two words such a break is a pre-token of its own), else None."""
        if not lines:
            return self._library(self._lead + word)
        parts = word.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in parts):
            return None
        return self._tails["\n"].join((self._known[parts[0]], *map(self._starts.__getitem__, parts[1:])))

    def _start(self, word: str, lines: bool) -> bytes | None:
        """Ids of a word without a space before it."""
        return None if lines else self._library(word)

    def encode(self, text: str | None) -> bytes:
        """Null counts as empty; no special ids are added. Special strings in the text
        are the ids that the library gives them."""
        if not text:
            return b""
        if any(x in text for x in self._special):
            return self._library(text)
        if self.by == "space":
            first, *rest = _BEFORE_WORD.split(text) if _SPACES.search(text) else text.split(" ")
            return self._library(first) + b"".join(map(self._known.__getitem__, rest))
        if self.by == "word" and not _SEPARATORS.search(text):
            return b"".join(map(self._known.__getitem__, text.split()))
        return self._library(text)

    def encode_all(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids that ``encode`` gives, of all ``texts`` in a row with those of ``end`` behind each, and
        how many each text has with them. Callers pass about ``TEXT_BYTES`` at a time (``slices``)."""
        size = self.dtype.itemsize
        if self._table is None:
            runs = [self.encode(x) + end for x in texts.to_pylist()]
            return np.frombuffer(b"".join(runs), self.dtype), np.array([len(x) // size for x in runs], np.int64)
        texts = texts.cast(pa.string()).fill_null("")
        # words have the space before them left out; a line break begins a word, and every text has one before it
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        counts = np.asarray(lists.value_lengths()).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        place = np.asarray(coded.indices).astype(np.int64)
        first = np.cumsum(counts) - counts
        odd = np.asarray(pc.match_substring_regex(coded.dictionary, _ODD))
        whole = np.logical_or.reduceat(odd[place], first) if len(first) else np.zeros(0, bool)
        for x in self._special:
            whole |= np.asarray(pc.match_substring(texts, x))
        if whole.any():
            # such texts are encoded one by one, the others as if they stood alone
            alone = [self.encode(x) for x in texts.filter(pa.array(whole)).to_pylist()]
            keep = ~np.repeat(whole, counts)
            coded = lists.flatten().filter(pa.array(keep)).dictionary_encode()
            place = np.asarray(coded.indices).astype(np.int64)
            counts = counts[~whole]
            first = np.cumsum(counts) - counts
        else:
            alone = []
        found = self._distinct(coded.dictionary)
        heads = [x[size:] for x in found.take(pa.array(place[first])).to_pylist()]  # without the line break before the text
        n = np.ones(len(whole), np.int64)
        n[~whole] = counts
        stop = np.cumsum(n + 1)
        to = np.zeros(int(n.sum()) + len(n), np.int64)
        inner = np.ones(len(to), bool)
        inner[stop - 1] = inner[stop - 1 - n] = False
        rest = np.ones(len(place), bool)
        rest[first] = False
        to[inner] = place[rest]
        to[stop - 1 - n] = len(found) + np.where(whole, len(heads) + np.cumsum(whole) - 1, np.cumsum(~whole) - 1)
        to[stop - 1] = len(found) + len(heads) + len(alone)
        ids = pa.concat_arrays([found, pa.array([*heads, *alone, end], pa.large_binary())]).take(pa.array(to))
        at = np.frombuffer(ids.buffers()[1], np.int64, len(to) + 1)
        return np.frombuffer(ids.buffers()[2] or b"", self.dtype, int(at[-1]) // size), np.diff(at[stop], prepend=0) // size

    def _distinct(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, each after a space unless it begins with a line break."""
        cores = pc.utf8_rtrim(words, characters=_TAIL)
        cores = pc.if_else(pc.match_substring_regex(cores, _LETTERS_ONLY), cores, words)
        coded = cores.dictionary_encode()
        ids = self._table.look_up(coded.dictionary, self._ask).take(coded.indices)
        tailed = pc.not_equal(pc.binary_length(cores), pc.binary_length(words))
        tails = pc.replace_substring_regex(words.filter(tailed), _LETTERS, "").dictionary_encode()
        tail_ids = pa.array(map(self._tails.__getitem__, tails.dictionary.to_pylist()), pa.large_binary()).take(tails.indices)
        some = pc.binary_join_element_wise(ids.filter(tailed), tail_ids, pa.scalar(b"", pa.large_binary()))
        return pc.replace_with_mask(ids, tailed, some)

    def _ask(self, words: pa.Array) -> pa.Array:
        """Ids of new words: of plain ones by the model, all at once; each has one id that begins with its space or line break."""
        plain = pc.match_substring_regex(words, _LETTERS_ONLY)
        some = words.filter(plain)
        spelt = _spelt(pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()) if len(some) else ""
        ids = np.array(self._spelt.encode_batch_fast((spelt,), add_special_tokens=False)[0].ids, self.dtype)
        at = np.append(np.flatnonzero(self._begins[ids]), len(ids))
        if len(at) != len(some) + 1:
            raise ValueError("the vocabulary writes a word without its space")
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(at.astype(np.int64) * self.dtype.itemsize), pa.py_buffer(ids.tobytes())])
        others = words.filter(pc.invert(plain)).to_pylist()
        others = pa.array([self._library(x if x[0] == "\n" else " " + x) for x in others], pa.large_binary())
        is_plain = np.asarray(plain)
        return pa.concat_arrays([runs, others]).take(pa.array(np.where(is_plain, np.cumsum(is_plain) - 1, len(runs) + np.cumsum(~is_plain) - 1)))


def _spelt(words: str) -> str:
    """Plain words in a row as a byte-level vocabulary writes them, their spaces before them; line breaks are apart."""
    out = f" {words}".encode().decode("latin-1").replace(" \n", "\n").replace(" ", f" {_SPACE}").replace("\n", f" {_LINE} ")
    for byte in range(128, 192):  # what follows the first byte of a letter that isn't ASCII
        if byte in _BYTES:
            out = out.replace(chr(byte), chr(_BYTES[byte]))
    return out[1:]


def slices(texts: pa.Array, most: int = TEXT_BYTES) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``most`` bytes, one text at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, to - at)
        at = to


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each path and worker process."""
    return Encoder(path)
