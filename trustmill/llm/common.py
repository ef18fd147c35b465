"""Small helpers shared by the operators: tables, shared storage, fixed hashes and bounded caches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one output batch; long texts are handled one row at a time, so this bounds memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session. Only a session on one machine that has none is given one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="trustmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trustmill-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read back: work up to here is not repeated if an executor is lost."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all that this application has stored; results that were not written elsewhere are gone with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_training(doc_id: Column | str = "doc_id") -> Column:
    """Labels are learned only where crc32 of the id as text is no multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 != 0


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(~in_training(doc_id), F.lit(False))


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


#: Bytes that one cache of results may take, what an entry takes besides its key and value, and the longest key kept.
CACHE_BYTES, ENTRY_BYTES, KEPT_SIGNS = 80 << 20, 100, 64


class Cache(dict):
    """Results of make by short text; long keys, and further ones once the bytes are used up, are computed each time."""

    def __init__(self, make: Callable, limit: int = CACHE_BYTES):
        super().__init__()
        self.make, self.room = make, limit

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= KEPT_SIGNS and self.room > 0:
            self.room -= entry_size(key, value)
            self[key] = value
        return value


def entry_size(key: str, value: object) -> int:
    """The bytes of a cache's entry."""
    return ENTRY_BYTES + getsizeof(key) + getsizeof(value) + (sum(map(getsizeof, value)) if type(value) is tuple else 0)


def slices(batch: pa.RecordBatch, text: str = "text", rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows and, beyond one row, so many bytes of text at most."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    at = taken = 0
    for k, n in enumerate(lengths):
        if k > at and (k - at >= rows or taken + n > size):
            yield batch.slice(at, k - at)
            at, taken = k, 0
        taken += n
    if at < len(lengths):
        yield batch.slice(at)


def clashing(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the columns an operator reads, so that extra columns of any name cannot clash with its own."""
    return df.select(*keep)
