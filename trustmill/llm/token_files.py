"""Token ids in compressed files with access to single documents.

File format (a folder of Parquet files written by Spark, ordered by document id):
  one row a block: zone, block, first_id, last_id, dict_hash, start (ids of the zone before it), width (bytes an id),
  doc_ids, offsets, sizes, counts (the offset index: one entry a document) and payload (the documents' zstandard
  frames one after another, each compressed separately with the shared dictionary).
A reader of one document prunes blocks by first_id and last_id, reads the index, and decompresses that frame only.
The dictionary is trained on the serialized ids of a bounded sample: the SAMPLE rows of the ids with the smallest hashes, of at most SAMPLE_CHARS characters each. It changes sizes only; every document is stored whole.

Cases: a null or empty text has only its end id; null document ids come first; equal ids are ordered by their tokens'
checksum; with too few samples to train on, the dictionary is empty; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustmill.llm.common import crc, slices, stored
from trustmill.llm.tokens import encoder

SAMPLE, SAMPLE_CHARS, DICT_BYTES = 1500, 20_000, 65_536
BLOCK_BYTES, BLOCK_DOCS, ZONE_DOCS, LEVEL = 1 << 20, 4096, 20_000, 3
FRAMES = "doc_id long, zone int, n int, ids_crc32 long, frame binary"
BLOCKS = (
    "zone int, block int, first_id long, last_id long, dict_hash string, start long, width int, "
    "doc_ids array<long>, offsets array<int>, sizes array<int>, counts array<int>, payload binary"
)


def _serial(ids: bytes, width: int) -> bytes:
    """The ids with so many bytes each; a vocabulary with larger ids is refused by write."""
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """The shared dictionary; at most SAMPLE short documents reach the driver."""
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = encoder(tokenizer).checked(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([_serial(x + end, width) for x in ids], pa.binary())], ["ids"])

    short = docs.where(F.length("text") <= SAMPLE_CHARS)
    picked = short.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    # an id may have very many rows: of those of the ids picked so many are taken, by id and text
    few = short.join(F.broadcast(picked), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(SAMPLE)
    sample = few.orderBy("doc_id", "text").mapInArrow(run, "ids binary")
    samples = [bytes(r[0]) for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b""


def zstd_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int | None = None) -> tuple[DataFrame, bytes]:
    """The blocks, stored in the shared folder, and the dictionary. width: bytes an id, by default 2 for vocabularies
    of up to 65,536 ids, else 4."""
    ids = max(encoder(tokenizer).size, end_id + 1)
    width = width or (2 if ids <= 1 << 16 else 4)
    if ids > 1 << (8 * width):
        raise ValueError(f"ids up to {ids - 1} do not fit into {width} bytes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train(docs, tokenizer, end_id, width)
    digest, end = hashlib.sha256(dictionary).hexdigest(), np.array([end_id], "<u4").tobytes()
    # zones: ranges of ids with about ZONE_DOCS documents each, from the id column alone
    rows = docs.agg(F.count("doc_id")).first()[0]
    zones = max(1, round(rows / ZONE_DOCS), min(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 500))
    shares = [k / zones for k in range(1, zones)]
    bounds = sorted(docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(max(10_000, 4 * zones)))).first()[0] or []) if shares else []
    # rows without an id come first, in as many zones as they need
    unknown = docs.where("doc_id is null").count()
    before = max(1, round(unknown * zones / max(rows, 1)), round(unknown / ZONE_DOCS)) if unknown else 0

    def zones_of(ids: pa.Array, checks: np.ndarray) -> np.ndarray:
        """The zone of each row. An id that is several bounds has several zones, dealt by the checksum, which is the order
        of rows with one id."""
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(bounds, known, side="left"), np.searchsorted(bounds, known, side="right")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        first, own = np.where(null, 0, before + low), np.where(null, before, np.maximum(high - low, 1))
        return first + (checks * own >> 32)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstd_dictionary(dictionary))
        for batch in it:
            for part in slices(batch, rows=512):
                ids = [x + end for x in encoder(tokenizer).checked(part.column("text").to_pylist())]
                checks = list(map(crc, ids))
                zone = zones_of(part.column("doc_id"), np.array(checks, np.int64))
                frames = [press.compress(_serial(x, width)) for x in ids]
                columns = [part.column("doc_id"), pa.array(zone, pa.int32()), pa.array([len(x) // 4 for x in ids], pa.int32()), pa.array(checks, pa.int64()), pa.array(frames, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "zone", "n", "ids_crc32", "frame"])

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        zone, block, start, held, size = None, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            sizes = [len(f) for _, _, f in held]
            ids = [i for i, _, _ in held]
            known = [i for i in ids if i is not None] or [None]
            row = (zone, block, known[0], known[-1], digest, start, width, ids, list(np.cumsum([0, *sizes[:-1]])), sizes, [n for _, n, _ in held], b"".join(f for _, _, f in held))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in it:
            for doc_id, at, n, frame in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "zone", "n", "frame")), strict=True):
                if held and (at != zone or size + len(frame) > BLOCK_BYTES or len(held) >= BLOCK_DOCS):
                    yield close()
                    start, block, held, size = start + sum(x[1] for x in held), block + 1, [], 0
                if at != zone:
                    zone, block, start = at, 0, 0
                held.append((doc_id, n, frame))
                size += len(frame)
        if held:
            yield close()

    frames = docs.mapInArrow(encode, FRAMES).repartitionById(zones + before, "zone").sortWithinPartitions("zone", F.asc_nulls_first("doc_id"), "ids_crc32", "n")
    return stored(frames.mapInArrow(gather, BLOCKS), "token-files"), dictionary


def read(blocks: DataFrame, dictionary: bytes, vocabulary_end: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (binary, little-endian unsigned 32-bit) of every stored document."""
    digest = hashlib.sha256(dictionary).hexdigest()
    totals = blocks.groupBy("zone").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row a zone
    before = totals.select("zone", F.coalesce(F.sum("n").over(Window.orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=zstd_dictionary(dictionary))
        for batch in it:
            for k in range(batch.num_rows):
                row = {x: batch.column(x)[k] for x in batch.schema.names}
                if row["dict_hash"].as_py() != digest:
                    raise ValueError("these blocks were written with another dictionary")
                payload, start, width = row["payload"].as_buffer(), row["before"].as_py() + row["start"].as_py(), row["width"].as_py()
                ids, offsets, sizes = (row[x].values.to_pylist() for x in ("doc_ids", "offsets", "sizes"))
                for at in range(0, len(ids), 256):
                    out = []
                    for doc_id, offset, size in zip(ids[at : at + 256], offsets[at : at + 256], sizes[at : at + 256], strict=True):
                        data = np.frombuffer(unpress.decompress(payload[offset : offset + size]), f"<u{width}").astype("<u4").tobytes()
                        out.append((doc_id, start, len(data) // 4, crc(data), data))
                        start += len(data) // 4
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.join(before, "zone").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_documents(blocks: DataFrame, dictionary: bytes, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of a few documents; only blocks whose range holds one of them are read, one frame each."""
    low, high = min(doc_ids), max(doc_ids)
    near = blocks.where((F.col("first_id") <= high) & (F.col("last_id") >= low))
    entry = near.select("payload", "width", F.explode(F.arrays_zip("doc_ids", "offsets", "sizes")).alias("e")).where(F.col("e.doc_ids").isin(doc_ids))
    frames = entry.select(F.col("e.doc_ids").alias("doc_id"), "width", F.substring("payload", F.col("e.offsets") + 1, F.col("e.sizes")).alias("frame"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=zstd_dictionary(dictionary))
        for batch in it:
            ids = [np.frombuffer(unpress.decompress(f), f"<u{w}").astype("<i8").tolist() for f, w in zip(batch.column("frame").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return frames.mapInArrow(run, "doc_id long, ids array<long>")
