"""Each operator against a plain version of its contract, and on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statloom.llm import decontam, packing, pii, png, queries, simhash, token_counts, token_files, tokens
from statloom.llm.common import connected_components


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=3):
    """{id: smallest id reachable} for {id: fingerprint}, comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_op1(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op1_simhash(spark, sf_dir).collect()}
    fps = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == components(fps)


@pytest.mark.parametrize("crowded", [1, 3, 64])
def test_links_are_complete(spark, crowded):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for base in fps[:12]:
        for n in (1, 2, 3, 3, 4):
            fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
        fps.append(fps[-1] ^ 7)
    fps = sorted(set(fps))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = connected_components(simhash.links(spark.createDataFrame(signed, "fp long"), crowded=crowded)).collect()
    root = {r["node"]: r["root"] for r in got}
    want = components({s[0]: x for s, x in zip(signed, fps, strict=True)})
    assert {s[0]: root.get(s[0], s[0]) for s in signed} == want


def test_op1_odd(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert (by[1], by[2], by[7], by[5], by[6], by[None]) == (1, 1, 1, 5, 5, None)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd, shingle=3)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "8", "None"]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for o, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), o, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


TRICKY = [
    "a@b.c_d@e.fg x@@y.z a@b.cd@e.fg .@-.- me@x mail a.b+c@d-e.f.g.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 4111  1111 41111111111111111111111 378282246310005 30569309025904 4111111111111112",
    "+1 (555) 123-4567 +49.30.123456 +1 +12 3 +123456789012345678 ++1 5551234567",
    "𝔘nicode 𝔘 x@y.zz 漢字 8.8.8.8 " + "ab@c.de " * 700,
    "call 555-123-4567 or (030) 555-1234 at 2021-03-04; ana (at) mail dot com; ssn 123-45-6789; iban DE12 3456 7890 1234 5678",
    "1" * 5000 + "@" + "a" * 5000,
    None,
    "",
]


def test_op2_base(spark, sf_dir, texts):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        text = TRICKY[r["doc_id"]]
        assert [(x["kind"], x["start"], x["end"]) for x in r["base"]] == base_spans(text)
        assert all(x["value"] == text[x["start"] : x["end"]] for x in r["spans"])
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
    added = {x["kind"] for x in next(r for r in got if r["doc_id"] == 5)["spans"]}
    assert {"phone_loose", "email_loose", "id_loose"} <= added
    for r in queries.op2_pii(spark, sf_dir).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]


def test_op2_odd(odd, none):
    assert pii.find(odd).count() == 10
    assert pii.find(none).count() == 0
    done = pii.redact(odd)
    assert done.dtypes == odd.dtypes
    assert {r["doc_id"]: r["text"] for r in done.collect()}[8] == "Ünï 漢字 𝔘 [EMAIL]"


ITEM = "A farmer named Alice has 12 apples and 7 pears in the old barn, so Alice gives away 7 pears to her kind neighbours today."


def test_op3(spark, sf_dir):
    prose = "Some words of plain prose that stand before it all. "
    docs = [
        (1, prose + ITEM + " " + prose),
        (2, prose + ITEM.replace("Alice", "Peter").replace("12", "31").replace("7", "9")),
        (3, prose + ITEM.replace("7 pears in", "9 pears in").replace("12", "3")),
        (4, prose * 5),
        (5, ITEM.upper()),
        (6, None),
        (7, ""),
    ]
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None)], "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (1 << 26, 0):
        got = {r["doc_id"]: (r["item_id"], r["same_values"]) for r in decontam.contaminated(docs, bench, broadcast_bytes=limit).collect()}
        assert got == {1: (10, True), 2: (10, False), 5: (10, True)}
    kept = decontam.remove_contaminated(docs, bench)
    assert {3, 4, 6, 7} <= {r["doc_id"] for r in kept.collect()} and kept.columns == docs.columns


def test_op3_holds_what_plain_search_finds(spark, sf_dir, texts):
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if len(x.split()) >= 12 and x in plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontamination(spark, sf_dir).collect()}
    assert want <= got
    assert all(sum(a in plain(texts[d]) for a in items[i].split()) for d, i in got)


def test_op3_odd(odd, none, spark):
    bench = spark.createDataFrame([(10, "word another third " * 5)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.contaminated(odd, bench).collect()} == {5, 6}
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert decontam.remove_contaminated(odd, bench).count() == 7


def test_op4(spark, sf_dir, texts):
    for r in queries.op4_png(spark, sf_dir).collect():
        raw = texts[r["doc_id"]].encode()
        whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(whole[-32:])


def test_png_filters_and_damage():
    rows = np.random.default_rng(3).integers(0, 256, (6, 9)).astype(np.uint8)
    lines = np.zeros((6, 10), np.uint8)
    lines[:, 0] = [0, 1, 2, 3, 4, 2]
    for y in range(6):
        for x in range(9):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (int(rows[y, x]) - [0, a, b, (a + b) // 2, paeth][lines[y, 0]]) % 256
    assert (png.unfilter(lines) == rows).all()
    good = png.encode(b"ab" * 288 * 3)
    assert png.decode(good).tobytes() == b"ab" * 288 * 3
    for i in (3, 20, 45, len(good) - 3):
        with pytest.raises((ValueError, zlib.error)):
            png.decode(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])
    with pytest.raises(ValueError):
        png.decode(good[:-5])


def test_op4_odd(odd, none, spark):
    got = png.media_features(png.to_media(odd)).collect()
    assert len(got) == 10 and all(len(r["samples"]) % 576 == 0 and len(r["feature"]) == 8 for r in got)
    assert png.media_features(png.to_media(none)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"no image"))], "doc_id long, media binary")
    assert [r["samples"] for r in png.media_features(bad).collect()] == [None, None]


@pytest.fixture(scope="module")
def byte_bpe():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


SPACED = ["a  b", " a", "a ", "a   b\n\n c \t d", "\n x", "it's 'tis 's", " ", "é é \x85x \x1cq 　z", "<|endoftext|> x", "!! ?\x1c! 'S", "ΑΣ Σ ﬁ Å"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, texts):
    from statloom.llm.tokens import Encoder

    enc = Encoder(public_tokenizers.path(name))
    assert enc.by != "whole"
    for t in [*SPACED, *texts.values()]:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == enc.library.encode(t, add_special_tokens=False).ids, t


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 1023, 1024, 1025, 9000):
        ids = np.where(rng.random(n) < 0.05, rng.integers(0, 1 << 31, n), rng.integers(100, 3000, n)).astype(np.uint32)
        blocks = token_files.pack_blocks(ids)
        got = [token_files.unpack_block(memoryview(b), 0) for b in blocks]
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *got]), ids)


def test_op6(spark, sf_dir, texts, byte_bpe):
    got = {r["doc_id"]: r for r in queries.op6_token_files(spark, sf_dir).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*byte_bpe.encode(texts[i], add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(texts)


def test_op6_odd(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_files.read(token_files.write(odd, path, 2)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert [r["start"] for r in got][1:] == list(np.cumsum([r["n_tokens"] for r in got])[:-1])
    assert token_files.read(token_files.write(none, path, 2)).count() == 0


def test_op7(spark, sf_dir, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = defaultdict(list)
    rows = queries.op7_packing(spark, sf_dir).collect()
    for r in rows:
        by[r["doc_id"]].append(r)
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_op7_odd(odd, none, spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(odd, path, 1)
    assert got.agg(F.sum("length")).first()[0] == sum(r["n"] for r in got.groupBy("doc_id", "doc_tokens").agg((F.sum("length")).alias("n")).collect())
    assert packing.pack(none, path, 1).count() == 0
    packing.write_buckets(got, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == got.count()
    assert packing.piece_lengths(2048 * 2 + 5) == [2048, 2048, 4, 1]


def plain_count(word, pieces, unknown):
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        top = (best[j - 1][0] + unknown, best[j - 1][1] - len(word[j - 1].encode()))
        for i in range(j):
            if word[i:j] in pieces:
                top = max(top, (best[i][0] + pieces[word[i:j]], best[i][1] - 1))
        best.append(top)
    return -best[-1][1]


def test_op8(spark, sf_dir, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ranks = [-sp.get_score(i) if -sp.get_score(i) < len(own) else len(own) for i in own]
    total = np.log(sum(1 / (x + 1000) for x in ranks))
    pieces = {sp.id_to_piece(i): -np.log(r + 1000) - total for i, r in zip(own, ranks, strict=True)}
    unknown = min(pieces.values()) - 10
    got = {r["doc_id"]: r for r in queries.op8_token_counts(spark, sf_dir).collect()}
    known, library = {}, 0
    for i, t in texts.items():
        words = re.findall("▁[^▁]+|▁+(?=▁[^▁])|▁+$", "▁" + t.replace(" ", "▁")) if t else []
        library += len(sp.encode(t))
        for w in words:
            if w not in known:
                known[w] = plain_count(w, pieces, unknown)
        assert (got[i]["n_words"], got[i]["n_distinct"], got[i]["n_tokens"]) == (len(words), len(set(words)), sum(known[w] for w in words))
    total = sum(r["n_tokens"] for r in got.values())
    print("unigram tokens to the library's", total / library)
    assert 0.96 < total / library <= 1.0


def test_op8_odd(odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(odd, path).collect()}
    assert got[1] == got[2] == 0 and got[7] == 5 and got[5] == got[6]
    assert token_counts.count_tokens(none, path).count() == 0


def test_short_way_of_the_encoder_equals_the_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from statloom.llm.tokens import Encoder

    rng = random.Random(3)
    bits = ["word", "Élan", "ß", "don't", "naïve...", "a\nb", "x\n\ny", "\r\n", "\t", " ", "  ", "'s", "3", "²", "K", "İ", "Σς", "ﬁ", "é", "<|endoftext|>", "%%%", "'", " ", "\x1c", "µ", ".\n", "Zz.\nQq", "漢"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        mine, lib = Encoder(path), Tokenizer.from_file(path)
        for _ in range(2000):
            text = "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 8)))
            got = memoryview(mine.encode(text)).cast("H" if mine.dtype.itemsize == 2 else "I").tolist()
            assert got == lib.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_strings_are_what_the_library_makes_of_them(name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    enc = tokens.Encoder(path)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|startoftext|>x<|endoftext|>\n\ny", "<|EndOfText|>", "<|endoftext", "plain words  here"):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids
