"""Encoder.encode_all: the library's ids for odd texts, few calls for many new words; block runs."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from statloom.llm import token_files, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    " ", " ", " ", " ", "\n", "\n", "  ", "\t", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "a", "Word", "éÿÀ", "ñu", "naïve", "'s", "'", "it's", ",", "...", "$$$", "(", "12", "3.5",
    "€", "—", "日本", "🙂", "é", "Ġ", "Ċ", "×", "÷", "ß", "<|endoftext|>", "<|end", "\x00", "x" * 70, "_",
]
END = np.array([2], "<u2").tobytes()


def _same(encoder: tokens.Encoder, texts: list[str | None], kind: pa.DataType) -> None:
    run, n = encoder.encode_all(pa.array(texts, kind), END)
    assert n.sum() == len(run)
    for text, ids in zip(texts, np.split(run, np.cumsum(n))[:-1], strict=True):
        assert ids.tolist() == [*encoder.library.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("held", [20, tokens.TABLE_WORDS])
def test_all_texts_have_the_librarys_ids(path, held, monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_WORDS", held)
    encoder, rng = tokens.Encoder(path), random.Random(7)
    for kind in (pa.string(), pa.large_string()):
        _same(encoder, [None, "", "\n", " ", "a", " a", "a ", "a\nb", "\na", "a\n", "a \nb", "a\n b", "One, two.\nThree's 4", None], kind)
    for _ in range(40):
        # half of the texts are of words and single spaces alone
        some = [PARTS, [x for x in PARTS if not x.isspace()]]
        _same(encoder, [(" " * k).join(rng.choices(some[k], k=rng.randrange(12))) for k in (0, 1) for _ in range(40)], pa.string())
    _same(encoder, [], pa.string())
    _same(encoder, [None, ""], pa.string())


def test_new_words_are_asked_for_together(monkeypatch):
    encoder = tokens.Encoder(BYTE)
    if encoder._table is None:
        pytest.fail("the byte-level vocabulary takes the short way")
    calls = []
    for name in ("_plain", "_library"):
        real = getattr(tokens.Encoder, name)
        monkeypatch.setattr(tokens.Encoder, name, lambda self, x, real=real: calls.append(x) or real(self, x))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéñ", k=9)) for _ in range(3000)]
    _same(encoder, [" ".join(words[i : i + 50]) + ".\nNext" for i in range(0, 3000, 50)], pa.string())
    assert len(calls) < 10


def test_slices_hold_every_text_once():
    texts = pa.array(["a" * 10, None, "b" * 50, "", "é" * 3, "c"])
    got = list(tokens.slices(texts, 12))
    assert pa.chunked_array(got).to_pylist() == texts.to_pylist()
    assert [len(x) for x in got] == [2, 1, 3]  # a text that is longer stands alone
    assert list(tokens.slices(texts.slice(0, 0), 12)) == []


def test_block_runs_of_every_width():
    rng = np.random.default_rng(5)
    for width in range(33):
        for n in (1, 1024, 3000):
            ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
            ids[::25] = rng.integers(0, 1 << 32, len(ids[::25]), dtype=np.uint64)  # exceptions
            blocks = token_files.pack_blocks(ids)
            starts = np.cumsum([0, *map(len, blocks)])[:-1]
            assert (token_files.unpack_blocks(memoryview(b"".join(blocks)), starts) == ids).all()
