"""WARC archives: written as one gzip stream, then normalised to a member for each record.

``write`` makes archives whose records share one gzip stream, as many crawlers leave them.
``normalize`` inflates each such file once, as a stream, rewrites every record as a gzip member
of its own and puts an index of offsets beside it, so that readers can seek.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from statloom.llm.common import materialize, new_path, parts_of

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31
_READ = 1 << 20
#: Repeated payloads (28 bytes each) whose first pages are broadcast, and the most tasks that read files.
BROADCAST_ROWS, MOST_TASKS = 1_000_000, 50_000
_FILES = "part int, path string, index string, n_records bigint, n_bytes bigint"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to=None, sha1: str | None = None, date: str = DATE) -> bytes:
    """One record: a response with the payload, or a revisit of the response ``refers_to``."""
    sha1 = sha1 or digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; ValueError if it is malformed."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    return headers, rest[:n]


def first_pages(pages: DataFrame, id_col: str, key: str) -> DataFrame:
    """(key, first, n): the smallest id of each payload and its number of pages; equal payloads are reduced before the shuffle."""
    return pages.groupBy(key).agg(F.min(id_col).alias("first"), F.count("*").alias("n"))


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = 1) -> DataFrame:
    """Write a record for each row into archives below ``path`` (default: the shared folder), one gzip
    stream each, and return their manifest (part, path, index, n_records, n_bytes).

    Of rows with equal payloads those with the smallest id are responses, all others revisits of
    it. A null payload is empty; a null url is left out; rows with a null id are responses if all
    rows with their payload have none, else revisits. Payloads count as equal if their SHA-1 is.
    Files are named after their task's attempt and listed only if it counted.
    """
    path = path or new_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), payload.alias("p"), F.unhex(F.sha1(payload)).alias("d"))
    # only repeated payloads need their first page; while those are few, pages aren't shuffled at all
    firsts = materialize(first_pages(rows.select("i", "d"), "i", "d").where("n > 1").drop("n"), "warc-firsts")
    told = rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, "d", "left")
    told = told.select("i", "u", "p", "d", F.when(F.col("i").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("r"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        part, out, n, pack = TaskContext.get().partitionId(), None, 0, zlib.compressobj(level, zlib.DEFLATED, _GZIP)
        name = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}.warc.gz"
        for batch in (p for batch in batches for p in parts_of(batch)):
            for i, u, p, d, r in zip(*(batch.column(c).to_pylist() for c in "iupdr"), strict=True):
                out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(pack.compress(record(i, u, p, r, base64.b32encode(d).decode())))
                n += 1
        if out is None:
            return
        out.write(pack.flush())
        size = out.tell()
        out.close()
        yield _file(part, f"{path}/{name}", None, n, size)

    return materialize(told.mapInArrow(each, _FILES), "warc-files")


def _file(part: int, path: str, index: str | None, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "index": pa.array([index], pa.string()), "n_records": [n], "n_bytes": [size]})


def _spread(manifest: DataFrame, *columns: str) -> DataFrame:
    """A manifest's files, each to a task of its own while there aren't too many."""
    rows = manifest.select(*columns)
    return rows.repartition(max(1, min(rows.count(), MOST_TASKS)), "path")


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Inflated bytes of a gzip file that is one stream, or several in a row."""
    z = zlib.decompressobj(_GZIP)
    for chunk in chunks:
        while chunk:
            if z.eof:
                z = zlib.decompressobj(_GZIP)
            yield z.decompress(chunk)
            chunk = z.unused_data
    if not z.eof:
        raise ValueError("gzip stream is cut off")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, in order, however its bytes are divided."""
    wait = bytearray()
    need = 0
    for chunk in chunks:
        wait += chunk
        at = 0
        while True:
            if not need:
                end = wait.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                low = bytes(wait[at:end]).lower()
                start = low.find(b"\r\ncontent-length:")
                if not low.startswith(b"warc/") or start < 0:
                    raise ValueError("not a WARC record")
                need = end - at + 8 + int(low[start + 17 :].split(b"\r\n", 1)[0])
            if len(wait) - at < need:
                break
            yield bytes(wait[at : at + need])
            at, need = at + need, 0
        del wait[:at]
    if wait:
        raise ValueError("archive is cut off")


def normalize(manifest: DataFrame, path: str | None = None, level: int = 1) -> DataFrame:
    """Rewrite each archive of a manifest with a gzip member for each record and an index of
    offset, length and record id (tab-separated lines) beside it; returns the new manifest.

    Files are read and written as streams; a task holds no more than one record.
    """
    spark = manifest.sparkSession
    path = path or new_path(spark, "warc-members")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(path)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for part, source in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                name = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}.warc"
                store, old = fs.FileSystem.from_uri(source)
                at = n = 0
                with store.open_input_stream(old, compression=None) as f, target.open_output_stream(f"{base}/{name}.gz", compression=None) as out, target.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for raw in records(inflate(iter(lambda: f.read(_READ), b""))):
                        z = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                        member = z.compress(raw) + z.flush()
                        rid = raw[raw.find(b"WARC-Record-ID: ") + 16 :].split(b"\r\n", 1)[0]
                        out.write(member)
                        index.write(b"%d\t%d\t%s\n" % (at, len(member), rid))
                        at, n = at + len(member), n + 1
                yield _file(part, f"{path}/{name}.gz", f"{path}/{name}.idx", n, at)

    return materialize(_spread(manifest, "part", "path").mapInArrow(each, _FILES), "warc-members-files")


def read(manifest: DataFrame, id_col: str = "page_id", id_type: str = "bigint") -> DataFrame:
    """(id_col, url, record_type, refers_to, payload_bytes, payload_digest, payload) for each record of
    normalised archives, member by member at the offsets of their indexes.

    A response's payload is read and its digest must hold; a revisit has none, and its size and
    digest are those of the payload it repeats.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        number = (lambda x: int(x) if x else None) if id_type in ("bigint", "int", "smallint", "tinyint") else (lambda x: x or None)
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                _, beside = fs.FileSystem.from_uri(index)
                with store.open_input_file(beside) as f:
                    places = [tuple(map(int, x.split(b"\t")[:2])) for x in f.read().splitlines()]
                rows, held = [], 0
                with store.open_input_file(name) as f:
                    for at, size in places:
                        f.seek(at)
                        head, block = parse(zlib.decompress(f.read(size), _GZIP))
                        http, _, body = block.partition(b"\r\n\r\n")
                        n = int(http.lower().rpartition(b"content-length:")[2])
                        sha1, whole = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "response"
                        if whole and (len(body) != n or digest(body) != sha1):
                            raise ValueError(f"payload of {head['warc-record-id']} is damaged")
                        of = lambda k: number(head[k][10:-1]) if k in head else None  # noqa: E731, B023
                        rows.append((of("warc-record-id"), head.get("warc-target-uri"), head["warc-type"], of("warc-refers-to"), n, sha1, body if whole else None))
                        held += len(block)
                        if held > 8 * _READ:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    fields = f"i {id_type}, url string, record_type string, refers_to {id_type}, payload_bytes bigint, payload_digest string, payload binary"
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema.names)

    return _spread(manifest, "path", "index").mapInArrow(each, fields).withColumnRenamed("i", id_col)
