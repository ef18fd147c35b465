"""Media columns: byte payloads as PNG images in binary columns, read back and described by a cosine-transform hash.

PNG is written and read here from its parts: signature, chunks with CRC-32 tests, a zlib stream with its Adler-32, and
scanline filters undone in numpy. Images are 8-bit greyscale, WIDTH samples a row.

Cases: a null or empty text is WIDTH spaces; any text is padded with spaces to whole rows; equal texts have equal
values; a damaged chunk, stream or filter stops the read with an error; rows with one id, and with a null id, are kept
as they are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustmill.llm.common import crc, slices, stored

SIGNATURE, WIDTH, LEVEL = b"\x89PNG\r\n\x1a\n", 192, 6
#: Rows that are filtered, compressed or transformed at a time.
ROWS = 4096


def payload_of(text: str | None, width: int = WIDTH) -> tuple[bytes, int]:
    """UTF-8 padded with spaces to a positive multiple of width, and the length before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(width, -(-len(data) // width) * width)
    return data.ljust(size, b" "), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray, kind: int, above: np.ndarray | None = None) -> np.ndarray:
    """Rows under one of the five scanline filters, each with its filter byte before it (one byte a sample). above: the
    row before the first, none at the top of an image. Differences of bytes wrap around as the filters want it."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    body = out[:, 1:]
    up = np.vstack([np.zeros_like(rows[:1]) if above is None else above[None], rows[:-1]]) if kind > 1 else None
    if kind == 0:
        body[:] = rows
    elif kind == 1:
        body[:, :1] = rows[:, :1]
        np.subtract(rows[:, 1:], rows[:, :-1], out=body[:, 1:])
    elif kind == 2:
        np.subtract(rows, up, out=body)
    else:
        left, wide = np.pad(rows, ((0, 0), (1, 0)))[:, :-1].astype(np.int16), up.astype(np.int16)
        guess = (left + wide) // 2 if kind == 3 else _paeth(left, wide, np.pad(wide, ((0, 0), (1, 0)))[:, :-1])
        np.subtract(rows, guess.astype(np.uint8), out=body)
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfiltered(data: bytes, height: int, width: int) -> np.ndarray:
    """Undoes the filters. Runs of rows without, with left and with upper filters are undone at once."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width + 1)
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if height else []
    for lo, hi in zip(starts, [*starts[1:], height], strict=True):
        kind, above = kinds[lo], out[lo - 1] if lo else np.zeros(width, np.uint8)
        if kind == 1:
            np.cumsum(out[lo:hi], axis=1, dtype=np.uint8, out=out[lo:hi])
        elif kind == 2:
            out[lo] += above
            np.cumsum(out[lo:hi], axis=0, dtype=np.uint8, out=out[lo:hi])
        elif kind > 2:
            for y in range(lo, hi):
                out[y] = _undo_row(out[y], above, int(kind))
                above = out[y]
    return out


def _undo_row(row: np.ndarray, above: np.ndarray, kind: int) -> list[int]:
    done, left, corner = [], 0, 0
    for value, up in zip(row.tolist(), above.tolist(), strict=True):
        if kind == 3:
            guess = (left + up) // 2
        else:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        left, corner = (value + guess) & 255, up
        done.append(left)
    return done


def best_filtered(rows: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    """Each row under that of the filters None, Sub and Up with the least sum of absolute differences."""
    best = filtered(rows, 0, above)
    least = _cost(best)
    for kind in (1, 2):
        other = filtered(rows, kind, above)
        cost = _cost(other)
        better = cost < least
        best[better], least[better] = other[better], cost[better]
    return best


def _cost(out: np.ndarray) -> np.ndarray:
    """The sums of a row's differences, as bytes with a sign."""
    return np.minimum(out[:, 1:], -out[:, 1:]).sum(axis=1, dtype=np.uint32)


def write_png(payload: bytes, width: int = WIDTH, kind: int | None = 0) -> bytes:
    """kind: the filter of all rows; None chooses one for each row. Rows are filtered and compressed ROWS at a time."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    press, body = zlib.compressobj(LEVEL), []
    for lo in range(0, len(rows), ROWS):
        part, above = rows[lo : lo + ROWS], rows[lo - 1] if lo else None
        body.append(press.compress(best_filtered(part, above) if kind is None else filtered(part, kind, above)))
    body.append(press.flush())
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(body)) + _chunk(b"IEND", b"")


def read_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG, after testing every checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(png) and not ended:
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + size]
        if len(data) < size or png[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale PNG")
    width, height = head[:2]
    data = zlib.decompress(b"".join(body))
    if len(data) != height * (width + 1):
        raise ValueError("the sample data has another size than the header says")
    return unfiltered(data, height, width)


@lru_cache(maxsize=512)
def _cosines(n: int, low: int = 8) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(low), np.arange(n) + 0.5)).astype(np.float32)


def cosine_hash(samples: np.ndarray, low: int = 8) -> str:
    """64 bits in hex: which of the low x low lowest coefficients of the cosine transform exceed their median.

    Coefficients are rounded before they are compared, so that ties fall alike everywhere; the first is the mean.
    """
    height, width = samples.shape
    across = _cosines(width, low).T
    rows = np.vstack([samples[lo : lo + ROWS].astype(np.float32) @ across for lo in range(0, height, ROWS)])
    low_part = _cosines(height, low) @ rows
    flat = np.round(low_part.ravel() / (height * width), 4)
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


WRITTEN = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _mapped(df: DataFrame, one: Callable[..., tuple], schema: str) -> DataFrame:
    """one applied to the columns of each row after doc_id, which is kept."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, batch.schema.names[-1]):
                columns = zip(*map(one, *(c.to_pylist() for c in part.columns[1:])), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields[1:], strict=True))], [n for n, _ in fields])

    return df.mapInArrow(run, schema)


def write(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and each text as a PNG in the binary column media, a filter chosen for each row of samples."""

    def one(text: str | None) -> tuple:
        payload, n = payload_of(text)
        return n, write_png(payload, kind=None)

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, WRITTEN)


def read(images: DataFrame) -> DataFrame:
    """What the images of write hold: their payloads, tested and unfiltered, and features."""

    def one(n: int, png: bytes) -> tuple:
        samples = read_png(png)
        return n, samples.size, hashlib.sha256(samples).hexdigest(), crc(samples.reshape(-1)[-16:].tobytes()), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)

    return _mapped(images.select("doc_id", "n_bytes", "media"), one, READ)


def media(docs: DataFrame) -> DataFrame:
    """Each text stored as a PNG in a binary column of a table in the shared folder, and what is read back from there."""
    return read(stored(write(docs), "media"))
