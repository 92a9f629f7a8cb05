"""Near-duplicates by Jaccard similarity of word shingles: SimHash and MinHash candidates, exact verification.

Fingerprints that the ball keys of ``simhash`` link come first; MinHash adds what is farther
apart than they reach, and compares nothing that they have linked. Texts with the same set of shingles are one node. A node's MinHash signature is cut into
``BANDS`` bands of ``ROWS`` rows; nodes that share a band are candidates, and whatever is a
candidate is verified over the whole sets. Two nodes of similarity s share a band with
probability 1 - (1 - s ** ROWS) ** BANDS, at 0.8 that is 0.9999.

Shared bands are resolved in three steps, so that a large group of near copies costs no
pairs: first each member is compared with the smallest node of its band; then, in bands
whose members aren't all linked yet, with a few further members; at last, in what is still
apart, members of different components with each other, if the band has few. Of those
pairs only the ones whose sketches (two bits of each MinHash value) are close enough leave
the join: at similarity 0.8 all but one in 10 000.

The members of crowded bands that are still apart are texts that share a passage, mostly:
all of their pairs would be a square of them. They take another exact way, by their rarest
shingles (``_by_rare_shingles``), where a shared passage makes no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import connected_components, materialize, parts_of, per_row

SIMILARITY = 0.8
BANDS, ROWS = 50, 8
#: Words of a sketch, and bits in which the sketches of two candidates may differ: at similarity 0.8 they
#: differ in 80 on average, with a deviation of 10.2.
WORDS, MOST_BITS = 13, 118
#: Members by hash, beside the one with most bands, that a band's others are compared with in the second step.
HUBS = 3
#: Bands with more members than this are left to the third step's other way, without pairs.
CROWDED = 32
#: Ratio of the sizes in one class, where sets are compared by size.
WIDTH = 1.1
_CHUNK = 1 << 11
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; words as for ``simhash``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if n > 1 else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, n)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct ``shingle_hashes``."""
    return np.unique(shingle_hashes(text, shingle))


def fingerprint(hashes: np.ndarray) -> int:
    """``simhash`` of a text from its ``shingle_hashes``, signed."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of one non-empty set."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), _CHUNK):
        x = (low[at : at + _CHUNK] ^ _XOR) * _TIMES
        x ^= x >> np.uint32(15)
        np.minimum(least, (x * np.uint32(0x2C1B3C6D)).min(1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """Keys of the bands of a signature."""
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh3_64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of each value of a signature, in words of 64 bits."""
    bits = np.concatenate([(least >> np.uint32(k)) & np.uint32(1) for k in (3, 9)]).astype(np.uint8)
    return np.packbits(np.pad(bits, (0, 64 * WORDS - len(bits)))).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def nodes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, digest, node, size, fp, keys, sketch) for each row; texts without words are node 0 and have no keys."""

    def each(texts: list) -> list:
        hashes = [shingle_hashes(t, shingle) for t in texts]
        sets = [np.unique(h) for h in hashes]
        node = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets), np.uint64, len(sets))
        least = [signature(s) if len(s) else None for s in sets]
        cut = lambda f: [[] if x is None else f(x) for x in least]
        return [node.view(np.int64), list(map(len, sets)), list(map(fingerprint, hashes)), cut(bands), cut(sketch)]

    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), F.col(text_col).alias("t"))
    return per_row(rows, "t", "node bigint, size bigint, fp bigint, keys array<bigint>, sketch array<bigint>", each)


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have at least the similarity; ``texts`` holds (node, t)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def hub(text: str) -> np.ndarray:
            return shingle_set(text, shingle)

        for part in (p for batch in batches for p in parts_of(batch)):
            ok = [jaccard(hub(x), shingle_set(y, shingle)) >= similarity for x, y in zip(part.column("ta").to_pylist(), part.column("tb").to_pylist(), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(each, "a bigint, b bigint")


def components(own: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) for the nodes of ``own`` that have links; ``linked`` gives the links (a, b) of fingerprints.

    What is joined on a key that may be crowded is read from a written table, so that a
    skewed join can be split.
    """
    first = F.min(F.struct("id", "digest")).alias("row")
    distinct = own.where("node <> 0").groupBy("node").agg(first, F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    distinct = materialize(distinct, "distinct")
    keys = distinct.select("node", "row", "size", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.min_by("size", "node").alias("hub_size")).where("n > 1").drop("n")
    met = materialize(keys.join(materialize(hubs, "hubs"), "key"), "met")

    near = F.least("sa", "sb") >= F.greatest("sa", "sb") * (similarity - 1e-9)
    close = materialize(_by_fingerprint(distinct, linked).where(near).select("a", "b").distinct(), "fingerprint-pairs")
    # each node's text is that of its first row, found by its id
    named = distinct.join(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", "row").unionAll(met.select("node", "row"))
    needed = named.select("node", F.col("row.id").alias("id"), F.col("row.digest").alias("digest")).distinct()
    plain = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), F.col(text_col).alias("t"))
    texts = materialize(needed.join(plain, ["id", "digest"]).select("node", "t").dropDuplicates(["node"]), "texts")

    star = met.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_size").alias("sa"), F.col("size").alias("sb"))
    links = materialize(verify(close, texts, shingle, similarity), "links")
    roots = materialize(connected_components(links), "roots")
    star = star.where(near).select("a", "b").distinct()
    for x in "ab":
        star = star.join(roots.select(F.col("node").alias(x), F.col("root").alias("r" + x)), x, "left")
    star = star.where("ra is null or rb is null or ra <> rb").select("a", "b")
    links = links.unionAll(materialize(verify(star, texts, shingle, similarity), "links"))
    roots = materialize(connected_components(links), "roots")

    rest = _apart(met.select("key", "node", "size"), roots)
    pairs = rest.join(_hubs(rest), "key").where("hub <> node and hub_root <> root").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_size").alias("sa"), F.col("size").alias("sb"))
    more = materialize(verify(pairs.where(near).select("a", "b").distinct(), texts, shingle, similarity), "links")
    if not more.isEmpty():
        links = links.unionAll(more)
        roots = materialize(connected_components(links), "roots")
        rest = _apart(rest.select("key", "node", "size"), roots)
    size = rest.groupBy("key").agg(F.count("*").alias("n"))
    rest = materialize(rest.join(materialize(size, "sizes"), "key"), "rest")
    few = materialize(rest.where(F.col("n") <= CROWDED).join(distinct.select("node", "sketch"), "node"), "sketched")
    one, two = (few.select("key", F.col("node").alias(x), F.col("size").alias("s" + x), F.col("root").alias("r" + x), F.col("sketch").alias("k" + x)) for x in "ab")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.get("ka", F.lit(i)).bitwiseXOR(F.get("kb", F.lit(i)))) for i in range(WORDS)))
    cross = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near & (apart <= MOST_BITS)).select("a", "b")
    many = materialize(rest.where(F.col("n") > CROWDED).select("node", "root").distinct(), "crowded")
    if not many.isEmpty():
        cross = cross.unionAll(_by_rare_shingles(many, texts, shingle, similarity))
    cross = materialize(verify(cross.distinct(), texts, shingle, similarity), "links")
    if cross.isEmpty():
        return roots
    return materialize(connected_components(links.unionAll(cross)), "roots")


def _by_fingerprint(distinct: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b, sa, sb): pairs of nodes that equal or linked fingerprints name; a fingerprint's least node stands for it."""
    first = materialize(distinct.groupBy("fp").agg(F.min("node").alias("hub"), F.min_by("size", "node").alias("hub_size")), "fingerprints")
    same = distinct.select("fp", "node", "size").join(first, "fp").where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_size").alias("sa"), F.col("size").alias("sb"))
    pairs = materialize(linked(first.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb")).distinct(), "fingerprint-links")
    for x in "ab":
        pairs = pairs.join(first.select(F.col("fp").alias("f" + x), F.col("hub").alias(x), F.col("hub_size").alias("s" + x)), "f" + x)
    return same.unionAll(pairs.select("a", "b", "sa", "sb"))


def _by_rare_shingles(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): every pair of ``nodes`` (node, root) of different roots whose similarity may be high enough.

    All sets are put in the same order, rare shingles first. Two sets x and y, y not the
    larger, of similarity s or more share so much that one of the first |x| - s |x| + 1
    shingles of x is one of the first |y| - 2 s / (1 + s) |y| + 1 of y; and from the first one
    that they share, both have s / (1 + s) (|x| + |y|) left. A passage that many texts share
    comes last in that order, so texts that have only it in common don't meet.
    """
    found = per_row(nodes.join(texts, "node").select("node", "root", "t"), "t", "hashes array<bigint>", lambda ts: [[shingle_set(t, shingle).view(np.int64) for t in ts]])
    grams = materialize(found.select("node", "root", F.size("hashes").alias("size"), F.explode("hashes").alias("h")), "shingles")
    shared = materialize(grams.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    # what only one set has comes first and meets nothing
    own = grams.join(shared, "h").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("hs"))
    alone = F.col("size") - F.size("hs")
    first = lambda share: F.col("size") - F.ceil(F.col("size") * F.lit(share) - 1e-9) + 1
    ahead = F.slice("hs", F.lit(1), F.greatest(F.lit(0), first(similarity) - alone).cast("int"))
    rows = own.withColumn("alone", alone).select("node", "root", "size", first(2 * similarity / (1 + similarity)).alias("few"), "alone", F.posexplode(ahead).alias("pos", "x"))
    # of a set, what is left from a shingle on: two that meet there first share no more than that
    keys = rows.select("node", "root", "size", F.col("x.h").alias("h"), (F.col("size") - F.col("alone") - F.col("pos")).alias("left"), (F.col("alone") + F.col("pos") < F.col("few")).alias("both"))
    keys = materialize(keys, "prefixes")
    share = similarity / (1 + similarity)
    bucket = lambda size: F.floor(F.log(size) / F.log(F.lit(WIDTH))).cast("int")
    # the members of one root, of which a shingle may have many, aren't put beside each other
    top = keys.where("both").groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("top"))
    keys = materialize(keys.join(materialize(top, "tops"), "h"), "prefixes")
    largest = F.least(F.col("sa"), F.col("la") / share - F.col("sa"))
    probe = keys.select("h", "top", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa"), F.col("left").alias("la"))
    sizes = F.sequence(bucket(F.col("sa") * (similarity - 1e-9)), bucket(largest + 1e-9))
    probe = probe.where(largest + 1e-9 >= F.col("sa") * (similarity - 1e-9)).withColumn("bucket", F.explode(sizes))
    probe = probe.withColumn("of_top", F.explode(F.when(F.col("ra") == F.col("top"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).drop("top")
    held = keys.where("both").select("h", (F.col("root") == F.col("top")).alias("of_top"), bucket(F.col("size")).alias("bucket"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), F.col("left").alias("lb"))
    fits = (F.col("sb") >= F.col("sa") * (similarity - 1e-9)) & ((F.col("sb") < F.col("sa")) | ((F.col("sb") == F.col("sa")) & (F.col("a") < F.col("b"))))
    enough = F.least("la", "lb") >= (F.col("sa") + F.col("sb")) * share - 1e-9
    return probe.join(held, ["h", "of_top", "bucket"]).where(fits & enough & (F.col("ra") != F.col("rb"))).select("a", "b")


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, size, root) of the members of bands that lie in several components."""
    rooted = met.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return materialize(rooted.join(materialize(apart, "apart"), "key"), "rest")


def _hubs(rest: DataFrame) -> DataFrame:
    """(key, hub, hub_size, hub_root): further members that all others of a band are compared with: the
    one that shares most bands with others (the text that copies were made from), and some by hash."""
    degree = rest.groupBy("node").agg(F.count("*").alias("degree"))
    ranked = rest.join(degree, "node").withColumn("x", F.struct(F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("root").alias("hub_root")))
    by_hash = [F.min_by("x", F.xxhash64("node", "key", F.lit(i))) for i in range(HUBS)]
    picked = ranked.groupBy("key").agg(F.array_distinct(F.array(F.max_by("x", F.struct("degree", "node")), *by_hash)).alias("xs"))
    return materialize(picked.select("key", F.explode("xs").alias("x")).select("key", "x.*"), "hubs")
