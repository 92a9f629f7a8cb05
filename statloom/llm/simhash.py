"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's 64 bits fall into three blocks. Of two fingerprints that differ in at most
three bits, some two blocks together differ in at most two (the third block holds the
largest share). So each fingerprint emits, for each of the three pairs of blocks, every
value within half of that radius (1 bit): 132 keys. Two linked fingerprints meet on at
least one key; whatever meets is verified over all 64 bits.

Keys that few fingerprints share are resolved by verifying their members against each
other. Crowded keys take another exact way without any pairs: their members emit the whole
ball of radius 2 over 64 bits. A variant that some fingerprint reaches with one flipped bit
or none is a hub; all others that reach it within two bits are at most three bits from the
hub and are linked to it. Every linked pair has such a meeting point, so components come
out whole, with work in proportion to the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.llm import shingles
from statloom.llm.common import connected_components, materialize, per_row, whole_row

#: Widths of the three blocks of a fingerprint, low bits first.
BLOCKS = (21, 21, 22)
MAX_BITS = 3
#: Keys with more members than this go the hub way instead of being compared with each other.
CROWDED = 64
#: Keys with several members (16 bytes each) that are broadcast to find those members.
BROADCAST_ROWS = 1_000_000
_CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text, repeats included.

    A-Z is lower-cased, words are separated by ASCII white space. Fewer words than
    ``shingle`` make one shingle; no words (or null) give zero. A bit is 1 if it is set in
    over half of the shingles' XXH64 (seed 42).
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1] if n > 1 else words
        lanes = [part[i:] for i in range(min(shingle, len(part)))]
        grams = map(b" ".join, zip(*lanes, strict=False)) if n > 1 else [b" ".join(part)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint of each row's whole text, as a signed long."""

    def each(texts: list) -> list:
        return [np.fromiter((simhash(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)]

    return per_row(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "t", "fp bigint", each).withColumnRenamed("i", id_col)


def ball_keys(fps: DataFrame) -> DataFrame:
    """(fp, key): the 132 keys of each fingerprint in column ``fp``."""
    a, b, c = BLOCKS
    low = lambda n: (1 << n) - 1
    fp = F.col("fp")
    high = F.shiftrightunsigned(fp, a + b)
    bases = [
        fp.bitwiseAND(F.lit(low(a + b))),
        F.shiftrightunsigned(fp, a).bitwiseOR(F.lit(1 << 60)),
        fp.bitwiseAND(F.lit(low(a))).bitwiseOR(F.shiftleft(high, a)).bitwiseOR(F.lit(2 << 60)),
    ]
    widths = (a + b, b + c, a + c)

    def near(base: Column, width: int) -> Column:
        flips = F.array(*(F.lit(m).cast("bigint") for m in [0, *(1 << i for i in range(width))]))
        return F.transform(flips, lambda m: base.bitwiseXOR(m))

    balls = [near(x, w) for x, w in zip(bases, widths, strict=True)]
    return fps.select("fp", F.explode(F.array(*balls)).alias("ball")).select("fp", F.explode("ball").alias("key"))


def _forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning links of the graph of values that differ in at most ``max_bits`` bits."""
    left, out = np.sort(values).view(np.uint64), []  # unsigned: bits of signed numbers are counted without sign
    todo = [left[0]]
    left = left[1:]
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
            continue
        hub = todo.pop()
        close = np.bitwise_count(left ^ hub) <= max_bits
        out += [(int(hub.view(np.int64)), int(x)) for x in left[close].view(np.int64)]
        todo += list(left[close])
        left = left[~close]
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that span the components of the graph of distinct fingerprints.

    ``max_bits`` may be 0 to 3. Not every linked pair is listed, but the components are
    those of the full graph.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("max_bits must be 0 to 3")
    # the few fingerprints are dealt anew, as each makes 132 rows
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ball_keys(fps.select("fp").distinct().repartition(parts, "fp"))
    # counted with partial sums and joined back, so that a crowded key isn't in one task
    counts = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met-counts")
    met = materialize(keys.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "key"), "met")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for v in batch.column("fps") for x in _forest(v.values.to_numpy(), max_bits)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.array(found, np.int64).reshape(-1, 2).T], ["a", "b"])

    few = met.where(F.col("n") <= crowded).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    few = few.select("fps").mapInArrow(verify, "a bigint, b bigint")
    hot = met.where(F.col("n") > crowded).select("fp").distinct()
    return few.unionAll(_hub_links(hot, max_bits))


def _hub_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of each fingerprint with the hubs of its ball; see the module's text."""
    wide, narrow = max_bits - max_bits // 2, max_bits // 2
    bit = lambda c: F.when(F.col(c) < 64, F.expr(f"shiftleft(1L, {c})")).otherwise(F.lit(0))
    flips = (F.col("i") < 64).cast("int") + (F.col("j") < 64).cast("int")
    ball = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
        .select("fp", "i", F.explode(F.sequence(F.col("i"), F.lit(64))).alias("j"))
        .where("i < j or i = 64")
        .where(flips <= wide)
        .select("fp", F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("at"), flips.alias("r"))
    )
    hub = F.min(F.when(F.col("r") <= narrow, F.col("fp"))).over(Window.partitionBy("at"))
    return ball.withColumn("hub", hub).where("hub is not null and hub <> fp").select(F.col("hub").alias("a"), F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fp, fingerprint, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included; rows with
    equal fingerprints are linked. Null and empty texts share fingerprint zero and are
    linked like any others. Null ids keep their row but are never a component's id. Repeated
    rows stay repeated. Extra columns of ``docs`` are not looked at. An empty table gives
    an empty result.
    """
    own = materialize(fingerprints(docs, id_col, text_col, shingle), "fp")
    first = own.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = materialize(connected_components(links(own, max_bits)), "roots").withColumnRenamed("node", "fp")
    linked = roots.join(first, "fp")
    linked = linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    known = first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    known = materialize(known, "known")  # both sides of the join below are plain shuffles, so that a hot fingerprint is split
    return own.join(known, "fp", "left").select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at least
    ``similarity``; groups are what links reach. Candidates are fingerprints of the same shingles that
    ``links`` joins, and, as texts of that similarity may differ in more bits, MinHash bands. Texts without words (null and empty ones
    too) are equal. All columns stay. Rows of different groups all keep a row, whether they
    share an id or not. Rows with a null id can't be ordered by it and all stay.
    """
    known = docs.where(F.col(id_col).isNotNull())
    own = materialize(shingles.nodes(known, id_col, text_col, shingle), "nodes")
    roots = shingles.components(own, known, id_col, text_col, shingle, similarity, links)
    first = own.groupBy("node").agg(F.min(F.struct("id", "digest")).alias("row"))
    groups = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row"))
    # a repeated id keeps a row for each of its groups
    keep = groups.select("row.id", "row.digest")
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = known.select(F.col(id_col).alias("id"), digest.alias("digest"), whole_row(known))
    kept = rows.join(keep, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
