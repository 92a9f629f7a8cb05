"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of binary length, largest first: whole pieces of the
greatest length, then the bits of what is left. Every piece is a sequence by itself, and
sequences of equal length form a bucket, so none crosses documents and none is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statloom.llm.common import parts_of
from statloom.llm.tokens import encoder

#: Bits of a sequence's number below its bucket, and below its task.
BUCKET_BITS, PART_BITS = 58, 36
KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())


def piece_lengths(n: int, most: int = 2048) -> list[int]:
    """Lengths of the pieces of ``n`` ids, in order; ``most`` is a power of two."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset) for each piece of each row.

    ``ids`` is little-endian unsigned 32-bit; ``length`` is also the bucket. A sequence's number
    is made of its bucket (from bit ``BUCKET_BITS`` on), the task (from ``PART_BITS`` on) and its
    place among the task's sequences of that bucket: sorted by it, sequences of one length
    stand in a row, and readers batch them without padding. A null or empty text is the end
    id alone. Repeated rows and null ids are packed like any others; extra
    columns are ignored; an empty table gives an empty result.
    """
    if not 1 <= most < 1 << 31 or most & (most - 1):
        raise ValueError("most must be a power of two")

    bits = most.bit_length()
    fields = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint"
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    schema = StructType([rows.schema["i"], *StructType.fromDDL(fields)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        last = np.array([end_id], enc.dtype).tobytes()
        # sequences of a bucket are numbered in a row within a task, after those of the task's other buckets
        seen, first = [0] * bits, TaskContext.get().partitionId() << PART_BITS
        for part in (p for batch in batches for p in parts_of(batch)):
            of, pieces = [], []
            for i, text in enumerate(part.column("t").to_pylist()):
                ids = np.frombuffer(enc.encode(text) + last, enc.dtype).astype("<u4").tobytes()
                at = 0
                for n in piece_lengths(len(ids) // 4, most):
                    k = n.bit_length() - 1
                    pieces.append((at, n, ids[4 * at : 4 * (at + n)], len(ids) // 4, k << BUCKET_BITS | (first + seen[k])))
                    seen[k] += 1
                    of.append(i)
                    at += n
            columns = zip(*pieces, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("i").take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, KINDS, strict=True))], schema.names)

    made = rows.mapInArrow(each, schema)
    return made.select(F.col("i").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet, one folder for each length, in order of their numbers within each file."""
    packed.sortWithinPartitions("length", "sequence_id").write.partitionBy("length").parquet(path)
