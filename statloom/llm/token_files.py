"""Token-ID files of patched frame-of-reference blocks.

A file holds the ids of whole documents in ascending order of their ids. Ids are cut into
blocks; a block subtracts its minimum, packs what is left at the width that the 90th
percentile needs, and stores what doesn't fit in an exception list of positions and high
bits. An index of block starts follows, then the documents' ids and lengths.

    "PFOR1\\n" | blocks | block starts u8[] | document ids i8[] | lengths u8[] | tail
    block: minimum u4, ids u2, exceptions u2, width u1, bytes[ids * width / 8],
           positions u2[], high parts u4[]
    tail: blocks u8, documents u8, documents without id u8, start of index u8, "PFOR1\\n"
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.llm.common import materialize, new_path
from statloom.llm.tokens import encoder, slices

MAGIC = b"PFOR1\n"
BLOCK = 1024
PERCENTILE = 90
_HEAD = "<IHHB"
_HEADS = np.dtype([("low", "<u4"), ("size", "<u2"), ("exceptions", "<u2"), ("width", "u1")])
_TAIL = "<QQQQ6s"
#: Ids that a writer packs at a time, and that a reader holds.
_GATHER = 256 * BLOCK
#: Bytes of text that make a part, and the most tasks that read parts.
PART_BYTES, MOST_READERS = 256 << 20, 50_000


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(float))[1]


def _lanes(width: int) -> Iterator[tuple[int, int, int, int]]:
    """Eight values of ``width`` bits fill ``width`` bytes: (which of the eight, its first byte, its first bit there, bytes it touches)."""
    for j in range(8):
        byte, bit = divmod(j * width, 8)
        yield j, byte, bit, -(-(bit + width) // 8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, low bits first."""
    rows, count = values.shape
    eights = np.zeros((rows, -(-count // 8), 8), np.uint64)
    eights.reshape(rows, -1)[:, :count] = values
    out = np.zeros((rows, eights.shape[1], width), np.uint8)
    for j, byte, bit, n in _lanes(width):
        v = eights[:, :, j] << np.uint64(bit)
        for b in range(n):
            out[:, :, byte + b] |= (v >> np.uint64(8 * b)).astype(np.uint8)
    return out.reshape(rows, -1)[:, : -(-count * width // 8)]


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    """Rows of bytes as rows of ``count`` values."""
    rows, eights = len(data), -(-count // 8)
    given = np.zeros((rows, eights * width), np.uint8)
    given[:, : data.shape[1]] = data
    given = given.reshape(rows, eights, width)
    out = np.empty((rows, eights, 8), np.uint32)
    for j, byte, bit, n in _lanes(width):
        v = np.zeros((rows, eights), np.uint64)
        for b in range(n):
            v |= given[:, :, byte + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, :, j] = v >> np.uint64(bit) & np.uint64((1 << width) - 1)
    return out.reshape(rows, -1)[:, :count]


def pack_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Blocks of a run of unsigned ids; the last may be shorter than ``block``."""
    n = -(-len(ids) // block)
    if not n:
        return []
    padded = np.concatenate([ids.astype(np.uint32), np.full(n * block - len(ids), ids[-1], np.uint32)]).reshape(n, block)
    low = padded.min(1)
    rest = padded - low[:, None]
    at = -(-block * PERCENTILE // 100) - 1
    width = _bit_length(np.partition(rest, at, axis=1)[:, at]).clip(1)
    mask = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    over = rest > mask[:, None]
    small = rest & mask[:, None]
    out: list[bytes] = [b""] * n
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for i, body in zip(at, _pack(small[at], int(w)), strict=True):
            size = min(block, len(ids) - i * block)
            where = np.flatnonzero(over[i, :size])
            out[i] = b"".join((struct.pack(_HEAD, int(low[i]), size, len(where), int(w)), body.tobytes(), where.astype("<u2").tobytes(), (rest[i, where] >> np.uint32(w)).astype("<u4").tobytes()))
    return out


def unpack_blocks(data: memoryview, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Ids of the blocks that start at ``starts``, in a row."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    raw, head = np.frombuffer(data, np.uint8), struct.calcsize(_HEAD)
    low, size, n, width = (x.astype(np.int64) for x in (raw[starts[:, None] + np.arange(head)].view(_HEADS)[:, 0][k] for k in _HEADS.names))
    values = np.empty((len(starts), block), np.uint32)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        values[at] = _unpack(raw[(starts[at] + head)[:, None] + np.arange(block * w // 8)], block, int(w))
    for i in np.flatnonzero(n):
        end = starts[i] + head + block * width[i] // 8
        values[i, np.frombuffer(data, "<u2", n[i], end)] |= np.frombuffer(data, "<u4", n[i], end + 2 * n[i]) << np.uint32(width[i])
    values += low.astype(np.uint32)[:, None]
    return values.reshape(-1) if (size == block).all() else values[np.arange(block) < size[:, None]]


def unpack_block(data: memoryview, at: int, block: int = BLOCK) -> np.ndarray:
    """Ids of the block that starts at ``at``."""
    return unpack_blocks(data, np.array([at], np.int64), block)


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the files of all rows of ``docs`` below ``path`` (default: in the shared folder) and
    return their manifest: part, path, n_docs, n_ids, n_bytes, start (ids of all parts before).

    Rows are dealt by ranges of (id, hash of the text), in ascending order, into parts of about
    ``part_bytes`` of text, as many as the session has shuffle partitions at least; each part is
    tokenised and written in one go, a few megabytes of text at a time. Each attempt of a task
    writes a file of its own; the manifest names those of the attempts that counted, so lost
    executors and repeated tasks do no harm. Ids are 64-bit integers; nulls come first.
    Repeated ids are ordered by their texts' hash, wherever a range ends.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    order = (F.col("i").asc_nulls_first(), F.col("h").asc_nulls_first())
    ordered = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("i", "t")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc = encoder(tokenizer)
        dtype = enc.dtype
        last = np.array([end_id], dtype).tobytes()
        part, out, held = TaskContext.get().partitionId(), None, np.zeros(0, dtype)
        starts, ids, sizes, missing = array("Q"), array("q"), array("Q"), 0
        step = max(1, _GATHER // block) * block
        for batch in batches:
            if out is None:
                store, base = fs.FileSystem.from_uri(path)
                store.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}.pfor"
                out = store.open_output_stream(f"{base}/{name}")
                out.write(MAGIC)
            missing += batch.column("i").null_count
            ids.frombytes(np.asarray(batch.column("i").fill_null(0)).tobytes())
            for texts in slices(batch.column("t")):
                run, n = enc.encode_all(texts, last)
                sizes.frombytes(n.astype(np.uint64).tobytes())
                held = np.concatenate([held, run])
                cut = len(held) // block * block
                for at in range(0, cut, step):
                    _put(out, pack_blocks(held[at : min(at + step, cut)], block), starts)
                held = held[cut:].copy()
                del run
                pa.default_memory_pool().release_unused()
        if out is None:
            return
        _put(out, pack_blocks(held, block), starts)
        at = out.tell()
        out.write(b"".join(np.frombuffer(x, k).astype(f"<{k[-2:]}").tobytes() for x, k in ((starts, "u8"), (ids, "i8"), (sizes, "u8"))))
        out.write(struct.pack(_TAIL, len(starts), len(ids), missing, at, MAGIC))
        n = out.tell()
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{path}/{name}"], "n_docs": [len(ids)], "n_ids": [sum(sizes)], "n_bytes": [n]})

    files = materialize(ordered.mapInArrow(each, "part int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file only
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _put(out, blocks: list[bytes], starts: array) -> None:
    at = out.tell()
    for b in blocks:
        starts.append(at)
        at += len(b)
    out.write(b"".join(blocks))


def read(manifest: DataFrame, id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(id_col, start, n_tokens, ids): each document of the files that ``write`` listed; ``start``
    counts the ids of all documents before it, ``ids`` is little-endian unsigned 32-bit.

    A file's index is read first, then runs of its blocks: a task holds one run, or one
    document if that is longer.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    yield from _documents(f, start, block)

    files = manifest.select("path", "start")
    n = max(1, min(files.count(), MOST_READERS))
    return files.repartition(n, "path").mapInArrow(each, "i bigint, start bigint, n_tokens bigint, ids binary").withColumnRenamed("i", id_col)


def _documents(f, start: int, block: int) -> Iterator[pa.RecordBatch]:
    size = f.size()
    tail = struct.calcsize(_TAIL)
    n_blocks, n_docs, missing, at, magic = struct.unpack(_TAIL, f.read_at(tail, size - tail))
    if magic != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a token file")
    index = f.read_at(size - tail - at, at)
    blocks = np.append(np.frombuffer(index, "<u8", n_blocks), at).astype(np.int64)
    ids = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks)
    sizes = np.frombuffer(index, "<u8", n_docs, 8 * (n_blocks + n_docs)).astype(np.int64)
    ends = np.cumsum(sizes)
    done = first = 0
    have = np.zeros(0, np.uint32)
    begin = 0  # number of the first id in have
    while first < n_docs:
        # documents of about one gathering at a time, one at least
        last = max(first + 1, int(np.searchsorted(ends, begin + _GATHER, "right")))
        want = -(-int(ends[last - 1]) // block)
        raw = memoryview(f.read_at(int(blocks[want] - blocks[done]), int(blocks[done])))
        have = np.concatenate([have, unpack_blocks(raw, blocks[done:want] - blocks[done], block)])
        done = want
        cuts = np.append((ends - sizes)[first:last], ends[last - 1]) - begin
        whole = have[: cuts[-1]].astype("<u4", copy=False).tobytes()
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array(ids[first:last], pa.int64(), mask=np.arange(first, last) < missing),
                "start": start + (ends - sizes)[first:last],
                "n_tokens": sizes[first:last],
                "ids": pa.array([whole[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            }
        )
        have, begin, first = have[cuts[-1] :], int(ends[last - 1]), last
