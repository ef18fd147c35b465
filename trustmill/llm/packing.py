"""Best-fit packing of token sequences after a dominance reduction.

Only lengths matter for packing, and there are at most `capacity` different ones. Tasks count how often each length
occurs; the driver packs that histogram (at most `capacity` entries, whatever the corpus size) into patterns with
multiplicities; tasks then look up the place of the k-th piece of each length. The k-th piece is found without
gathering a length in one task: each task numbers its own pieces, and the counts of earlier tasks are added.

Histogram packing. First the reduction of Martello and Toth, on lengths with counts: a largest piece and the set that
provably dominates every other way to fill its sequence are fixed for good, which shrinks the instance; this repeats
until nothing more dominates. The rest is packed best fit, longest first, all equal pieces at once.

Cases: a null or empty text has only its end id; a text longer than the capacity is cut into pieces of exactly
`capacity` ids, the first of which may be shorter; equal rows are packed once each; an empty table gives no rows;
null ids are kept as they are; other columns of the table are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustmill.llm.common import crc, stored
from trustmill.llm.tokens import encoder

Pattern = tuple[list[tuple[int, int]], int]  # (length, copies) of one sequence, and how many such sequences


class Histogram:
    """Counts of lengths, with the present lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.present = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.present.pop(bisect_left(self.present, length))

    def largest(self, room: int, besides: int) -> int | None:
        """The largest length that fits, one piece of length `besides` apart."""
        k = bisect_right(self.present, room) - 1
        if k >= 0 and self.present[k] == besides and self.counts[besides] < 2:
            k -= 1
        return self.present[k] if k >= 0 else None

    def smallest(self, n: int, besides: int) -> list[int]:
        """The n smallest pieces, one piece of length `besides` apart."""
        out: list[int] = []
        for x in self.present:
            out += [x] * min(n - len(out), self.counts[x] - (x == besides))
            if len(out) >= n:
                break
        return out

    def best_pair(self, room: int, besides: int) -> int:
        """The largest sum of two pieces that fits."""
        best, lo, hi = 0, 0, bisect_right(self.present, room) - 1
        while lo <= hi:
            a, b = self.present[lo], self.present[hi]
            if a + b > room:
                hi -= 1
                continue
            enough = self.counts[a] - (a == besides) >= 1 + (a == b) and self.counts[b] - (b == besides) >= 1
            if enough:
                best = max(best, a + b)
            elif a != b:  # only the piece itself is left of one of them
                if a == besides and self.counts[a] < 2:
                    lo += 1
                else:
                    hi -= 1
                continue
            lo += 1
        return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets that dominate every alternative for their largest piece, and the counts that are left."""
    hist, fixed, again = Histogram(counts), [], True
    while again:
        again = False
        for length in reversed(list(hist.present)):
            while hist.counts.get(length):
                room = capacity - length
                small = hist.smallest(3, length)
                fits = sum(total <= room for total in np.cumsum(small)) if small else 0
                if not fits:
                    # nothing fits beside it, not even another copy
                    n = hist.counts[length]
                    fixed.append(([(length, 1)], n))
                    hist.take(length, n)
                    again = True
                    continue
                other = hist.largest(room, length)
                exact = other == room
                if not (exact or fits == 1 or (fits == 2 and other >= hist.best_pair(room, length))):
                    break
                if other == length:
                    n = hist.counts[length] // 2
                    fixed.append(([(length, 2)], n))
                    hist.take(length, 2 * n)
                else:
                    n = min(hist.counts[length], hist.counts[other])
                    fixed.append(([(length, 1), (other, 1)], n))
                    hist.take(length, n)
                    hist.take(other, n)
                again = True
    return fixed, dict(hist.counts)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing over a histogram: each step puts equal pieces into equal sequences."""
    open_: dict[int, list[Pattern]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern) -> None:
        if pattern[1] > 0:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append(pattern)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n > 0:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                items, m = open_[room].pop()
                if not open_[room]:
                    rooms.pop(k)
            else:
                room, items, m = capacity, [], n
            each = room // length
            full = min(m, n // each)
            put(room - each * length, ([*items, (length, each)], full))
            m, n = m - full, n - full * each
            if m and n and n < each:
                put(room - n * length, ([*items, (length, n)], 1))
                m, n = m - 1, 0
            if items:
                put(room, (items, m))
    return [x for room in sorted(open_) for x in open_[room]]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, first offset), ordered by length and rank."""
    fixed, rest = reduce_dominated(counts, capacity)
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for items, n in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for length, copies in items:
            rows.append((length, rank[length], copies, sequence, offset))
            rank[length] += copies * n
            offset += copies * length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((x, capacity) for x in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document, numbered within its task and length."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[int, int] = defaultdict(int)
        task, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in names]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode.checked(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        row = (doc_id, k, start, length, crc(ids[4 * start : 4 * (start + length)]), task, ranks[length])
                        ranks[length] += 1
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    spark = docs.sparkSession
    found = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counted = found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, copies, sequence, offset = table.value.T
        keys = length << 48 | first
        for batch in it:
            n = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, n << 48 | rank, side="right") - 1
            nth = rank - first[k]
            kept = [batch.column(x) for x in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[k] + nth // copies[k]), pa.array(offset[k] + nth % copies[k] * n)], [*columns, "sequence_id", "offset"])

    ranked = found.join(before, ["task", "length"]).select(*columns, (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
