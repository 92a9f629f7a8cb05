"""Media columns: PNG images in binary columns, and hashes of their low frequencies.

Written with zlib and checked chunk by chunk; the filters of PNG are undone with numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import added, per_row, quoted

WIDTH = 576
PAD = 255
#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def payload(text: str | None, width: int = WIDTH) -> bytes:
    """UTF-8 of the text (null: empty) with bytes 255 up to a positive multiple of ``width``."""
    return padded((text or "").encode(), width)


def padded(raw: bytes, width: int = WIDTH) -> bytes:
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // width)) * width - len(raw))


def encode(samples: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit grey PNG of rows of ``width`` samples.

    A row that repeats the one above is stored as Up (all zeros), any other as it is.
    """
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = NONE
    lines[:, 1:] = rows
    same = np.flatnonzero((rows[1:] == rows[:-1]).all(1)) + 1
    lines[same, 0] = UP
    lines[same, 1:] = 0
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """(kind, body) of each chunk; ValueError on a wrong signature, length, checksum or end."""
    view, at, kind = memoryview(png), 8, b""
    if bytes(view[:8]) != SIGNATURE:
        raise ValueError("not a PNG")
    while kind != b"IEND":
        if at + 12 > len(view):
            raise ValueError("cut off")
        (n,) = struct.unpack_from(">I", view, at)
        kind, body = bytes(view[at + 4 : at + 8]), view[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(view) or zlib.crc32(view[at + 4 : at + 8 + n]) != struct.unpack_from(">I", view, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, body
        at += 12 + n
    if at != len(view):
        raise ValueError("bytes after the end")


def unfilter(lines: np.ndarray, step: int = 1) -> np.ndarray:
    """Samples of filtered scan lines (filter type in column 0); ``step`` bytes a pixel.

    Sub and Up are sums along a row or from the row above. Where rows of Average or Paeth
    occur, which need left, upper and upper left neighbour, all rows are undone together, one
    diagonal of pixels at a time.
    """
    kinds = lines[:, 0]
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown filter")
    if kinds.max(initial=0) > UP:
        return _by_diagonals(kinds, lines[:, 1:], step)
    out = lines[:, 1:].copy()
    for y in np.flatnonzero(kinds):
        if kinds[y] == UP:
            out[y] += out[y - 1] if y else 0
        else:
            for c in range(step):
                out[y, c::step] = np.cumsum(out[y, c::step], dtype=np.uint8)
    return out


def _by_diagonals(kinds: np.ndarray, filtered: np.ndarray, step: int) -> np.ndarray:
    height, width = len(filtered), filtered.shape[1] // step
    rest = filtered.reshape(height, width, step).astype(np.int16)
    done = np.zeros((height + 1, width + 1, step), np.int16)  # a row above and a pixel before, all zero
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        guess = np.choose(kinds[y][:, None], (np.zeros_like(left), left, up, (left + up) // 2, paeth))
        done[y + 1, x + 1] = (rest[y, x] + guess) & 255
    return done[1:, 1:].astype(np.uint8).reshape(height, width * step)


def decode(png: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit grey PNG; ValueError if it is damaged or of another kind."""
    head, parts = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing")
    data = zlib.decompress(parts[0] if len(parts) == 1 else b"".join(parts))
    return unfilter(np.frombuffer(data, np.uint8).reshape(head[1], head[0] + 1))


def _cosines(n: int, k: int) -> np.ndarray:
    """First ``k`` rows of the cosine transform (type 2) of length ``n``."""
    return np.cos(np.pi * np.outer(np.arange(k), np.arange(n) + 0.5) / n)


def frequency_hash(rows: np.ndarray, side: int = 32, keep: int = 8) -> bytes:
    """``keep`` x ``keep`` bits: is each low frequency of the image above their median.

    The image is averaged down to ``side`` x ``side`` (rows are repeated first if there are
    fewer); the constant term counts as a bit like any other but not for the median.
    """
    rows = np.repeat(rows, -(-side // len(rows)), axis=0) if len(rows) < side else rows
    y, x = (np.arange(side) * n // side for n in rows.shape)
    small = np.add.reduceat(np.add.reduceat(rows, x, axis=1, dtype=np.int64), y, axis=0)
    small = small / np.outer(np.diff([*y, rows.shape[0]]), np.diff([*x, rows.shape[1]]))
    low = _cosines(side, keep) @ small @ _cosines(side, keep).T
    return np.packbits(low.ravel() > np.median(low.ravel()[1:])).tobytes()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each row's whole text as a PNG in a binary column.

    Null texts count as empty and give one row of padding. Repeated rows stay repeated; extra
    columns are ignored; an empty table gives an empty result.
    """

    def each(texts: list) -> list:
        raw = [(t or "").encode() for t in texts]
        return [list(map(len, raw)), [encode(padded(x)) for x in raw]]

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return per_row(rows, "t", "n bigint, m binary", each).toDF(id_col, "n_bytes", "media")


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with ``media_col`` replaced by ``samples``, what the stored bytes hold when
    read back, and ``feature``, their frequency hash, both binary.

    Null or damaged media give nulls. Other columns stay; of columns already named samples or
    feature the new ones take the place.
    """
    keep = [c for c in media.columns if c not in (media_col, "samples", "feature")]

    def each(media: list) -> list:
        samples, features = [], []
        for m in media:
            try:
                rows = None if m is None else decode(m)
            except (ValueError, zlib.error, struct.error):
                rows = None
            samples.append(None if rows is None else rows.tobytes())
            features.append(None if rows is None or not rows.size else frequency_hash(rows))
        return [samples, features]

    return added(media, keep, [F.col(quoted(media_col))], "samples binary, feature binary", each)
