"""Two tokenizers aligned by bytes, each linked pair of ids weighed by the documents that hold it.

A's and B's tokens of one text cover the same bytes: a space and the text. Where both end a token the bytes are cut into
groups, and two tokens are linked where their bytes overlap. Neither vocabulary has tokens beyond a single space between
two words, so what stands between such spaces is aligned apart and kept for the next time it is met.

Weights by a cogroup of postings. Each task turns its documents into postings: for a pair of ids the documents that hold
it linked and how often, at most POSTINGS to a row. Counts of documents are summed by pair before they are shuffled. Both
streams, counts and postings, are dealt by the id of A and sorted, counts first, which spills to disk; a task then holds
the counts of one id of A alone (at most B's vocabulary), takes their maximum and lets the postings pass by, adding up
what they contribute to each document. Ids of A with many postings are dealt to several tasks, with the counts in each.
Contributions are summed by document.

Cases: null and empty texts, and texts whose bytes either vocabulary does not give back (such as those with U+2581), have no
tokens: zeros and an empty digest. Rows are documents: repeated rows and ids count each, null ids are kept. Long texts
are aligned whole; ties for the highest count are all best; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustmill.llm import sentencepieces
from trustmill.llm.common import KEPT_SIGNS, entry_size, slices, stored
from trustmill.llm.tokens import WordEncoder, token_bytes

#: Documents and links that a task holds before it writes their postings (one document may have more), postings to a row
#: and contributions held before they are summed.
DOCUMENTS, LINKS, POSTINGS, HELD = 1 << 16, 4_000_000, 512, 2_000_000
#: Bytes of the words that a worker remembers.
MET_BYTES = 170 << 20
#: What a row of postings weighs besides its postings when ids of A are dealt to tasks.
ROW = 8
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
DIGEST = "place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ROWS = DIGEST + ", a int, b int, n int, documents binary, times binary"
Piece = tuple[int, int, int, bytes, str]  # tokens of A, tokens of B, groups, pairs, groups written out


class Aligner:
    """Aligns texts; words that were not met are aligned together, as one text with a space before each."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = WordEncoder(path_a, 0).library, sentencepieces.model(path_b)
        self.a_bytes = token_bytes(self.a)
        self.b_bytes = [bytes([self.b.byte_of[i]]) if i in self.b.byte_of else s.encode() for i, s in enumerate(self.b.shown)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)
        # an id and what follows it: within a group, at the end of a side, of a group, of a word
        self.written = [f"{i}{sign}" for size, signs in ((len(self.a_bytes), ",|"), (self.width, ",;\n")) for sign in signs for i in range(size)]
        self.met: dict[str, Piece] = {}
        self.room = MET_BYTES

    def aligned(self, text: str, ends: np.ndarray) -> list[Piece] | None:
        """A space and the text aligned, cut where given (bytes with the space, at ends of both tokens); None if the
        tokens' bytes are others."""
        a, b = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64), np.array(self.b.library.encode(text), np.int64)
        if not b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b"".join(map(self.b_bytes.__getitem__, b.tolist())) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        links = np.union1d(ends_a, ends_b)
        pairs = (a[np.searchsorted(ends_a, links)] * self.width + b[np.searchsorted(ends_b, links)]).tobytes()
        groups = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        size_a = len(self.a_bytes)
        closes_b = (groups[group_b] == ends_b).astype(np.int64) + np.isin(ends_b, ends)
        place = np.concatenate([a + size_a * (groups[group_a] == ends_a), 2 * size_a + b + self.width * closes_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        texts = "".join(map(self.written.__getitem__, place[order].tolist())).split("\n")
        counts = [np.diff(np.searchsorted(x, ends, side="right"), prepend=0).tolist() for x in (ends_a, ends_b, groups)]
        cuts = (8 * np.searchsorted(links, ends, side="right")).tolist()
        return list(zip(*counts, (pairs[lo:hi] for lo, hi in zip([0, *cuts], cuts)), texts))

    def piece(self, text: str) -> Piece | None:
        """One text aligned whole."""
        found = self.aligned(text, np.array([1 + len(text.encode())]))
        return found[0] if found else None

    def batch(self, texts: list[str | None]) -> list[list[Piece]]:
        """The pieces of each text in order; none if it has no tokens."""
        cut, odd, new = [], {}, {}
        for text in texts:
            words = [] if not text or sentencepieces.SPACE in text else text.split(" ")
            if any(not w or w[0].isspace() or w[-1].isspace() for w in words):  # white space meets white space
                words = BETWEEN_WORDS.split(text)
                odd |= {w: self.piece(w) for w in words if not w or w[0].isspace() or w[-1].isspace()}
            cut.append(words)
            new |= dict.fromkeys(w for w in words if w not in self.met and w not in odd)
        if new:
            words = list(new)
            found = self.aligned(" ".join(words), np.cumsum([1 + len(w.encode()) for w in words]))
            new = dict(zip(words, found if found is not None else map(self.piece, words), strict=True))
        out = []
        for words in cut:
            found = [self.met.get(w) or new.get(w) or odd.get(w) for w in words]
            out.append([] if None in found else found)
        for word, piece in new.items():
            if self.room <= 0:
                break
            if piece is not None and len(word) <= KEPT_SIGNS:
                self.met[word] = piece
                self.room -= entry_size(word, piece)
        return out

    def align(self, text: str | None) -> list[Piece]:
        return self.batch([text])[0]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _postings(links: list[bytes], width: int, base: int) -> pa.RecordBatch:
    """Rows of postings from the pairs of each document: by pair the documents' numbers and how often each has it."""
    numbers = np.repeat(np.arange(len(links)), [len(x) // 8 for x in links])
    keys, times = np.unique(np.frombuffer(b"".join(links), np.int64) * DOCUMENTS + numbers, return_counts=True)
    pairs = keys // DOCUMENTS
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    sizes = np.diff(first, append=len(pairs))
    parts = -(-sizes // POSTINGS)
    starts = np.repeat(first, parts) + POSTINGS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    ends = np.append(starts[1:], len(pairs)).astype(np.int32)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    documents = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets * 2), pa.py_buffer((keys % DOCUMENTS).astype("<u2"))])
    counts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets * 4), pa.py_buffer(times.astype("<u4"))])
    nothing = [pa.nulls(len(starts), t) for t in (*[pa.int64()] * 5, pa.string())]
    a, b = (pa.array((pairs[starts] // width).astype(np.int32)), pa.array((pairs[starts] % width).astype(np.int32)))
    columns = [pa.array(np.full(len(starts), base)), *nothing, a, b, pa.array((ends - starts).astype(np.int32)), documents, counts]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROWS.split(", ")])


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document (a is null), and rows of postings; place numbers documents, a base their first one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = aligner(path_a, path_b)
        base, links, held = TaskContext.get().partitionId() << 36, [], 0
        for batch in it:
            for part in slices(batch):
                if len(links) + part.num_rows > DOCUMENTS or held > LINKS:
                    if held:
                        yield _postings(links, m.width, base)
                    base, links, held = base + DOCUMENTS, [], 0
                found = m.batch(part.column("text").to_pylist())
                pairs = [b"".join([x[3] for x in f]) for f in found]
                digests = [hashlib.sha256(";".join([x[4] for x in f]).encode()).hexdigest() if f else "" for f in found]
                sums = [pa.array([sum([x[k] for x in f]) for f in found], pa.int64()) for k in range(3)]
                counts = [len(x) // 8 for x in pairs]
                places = base + len(links) + np.arange(part.num_rows)
                nothing = [pa.nulls(part.num_rows, t) for t in (*[pa.int32()] * 3, *[pa.binary()] * 2)]
                columns = [pa.array(places), part.column("doc_id"), *sums, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), *nothing]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROWS.split(", ")])
                links += pairs
                held += sum(counts)
        if held:
            yield _postings(links, m.width, base)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def _contributions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From counts and postings in order of the ids of A, the counts of each id first: what pairs add to documents, a row
    for the documents of one base that were held."""
    group, b_ids, counts = None, np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[np.ndarray] = []

    def summed() -> pa.RecordBatch:
        places, count, best = _sums(np.concatenate(held, axis=1))
        bases = places // DOCUMENTS
        first = np.flatnonzero(np.diff(bases, prepend=-1))
        cuts = [*first.tolist(), len(bases)]
        packed = [[x[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])] for x in ((places % DOCUMENTS).astype("<u2"), count.astype("<i8"), best.astype("<i8"))]
        return pa.RecordBatch.from_arrays([pa.array(bases[first] * DOCUMENTS), *(pa.array(x, pa.binary()) for x in packed)], ["place", "documents", "counts", "best"])

    for batch in it:
        a, part, b, n = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "part", "b", "n"))
        counted = batch.column("place").is_null().to_numpy(zero_copy_only=False)
        bases = batch.column("place").fill_null(-1).to_numpy(zero_copy_only=False)
        count, best = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        bounds = [0, *(1 + np.flatnonzero((a[1:] != a[:-1]) | (part[1:] != part[:-1]))), len(a)] if len(a) else []
        for lo, hi in zip(bounds, bounds[1:]):
            if (a[lo], part[lo]) != group:
                group, b_ids, counts = (a[lo], part[lo]), b[:0], n[:0]
            mid = lo + int(counted[lo:hi].sum())
            if mid > lo:
                b_ids, counts = np.concatenate([b_ids, b[lo:mid]]), np.concatenate([counts, n[lo:mid]])
            if hi > mid:
                count[mid:hi] = counts[np.searchsorted(b_ids, b[mid:hi])]
                best[mid:hi] = count[mid:hi] == counts.max()
        sizes = np.where(counted, 0, n)
        numbers, times = (_numbers(batch.column(x), kind) for x, kind in (("documents", "<u2"), ("times", "<u4")))
        held.append(np.stack([np.repeat(bases, sizes) + numbers, np.repeat(count, sizes) * times, np.repeat(best, sizes) * times]))
        if sum(x.shape[1] for x in held) > HELD:
            yield summed()
            held = []
    if any(x.shape[1] for x in held):
        yield summed()


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind).astype(np.int64)


def _sums(rows: np.ndarray) -> np.ndarray:
    """Rows of (place, values...) as columns, the values added up by place."""
    order = np.argsort(rows[0], kind="stable")
    rows = rows[:, order]
    first = np.flatnonzero(np.diff(rows[0], prepend=-1))
    return np.concatenate([rows[:1, first], np.add.reduceat(rows[1:], first, axis=1)])


def _added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contributions in order of their base, added up by document; one base's documents are held at a time."""
    base, sums = None, np.zeros((3, DOCUMENTS), np.int64)

    def close() -> pa.RecordBatch:
        told = np.flatnonzero(sums[2])
        return pa.RecordBatch.from_arrays([pa.array(base + told), pa.array(sums[0][told]), pa.array(sums[1][told])], ["place", "count_sum", "n_best"])

    for batch in it:
        for place, *values in zip(*(batch.column(x).to_pylist() for x in ("place", "documents", "counts", "best")), strict=True):
            if place != base:
                if base is not None:
                    yield close()
                base = place
                sums[:] = 0
            numbers, count, best = (np.frombuffer(v, kind) for v, kind in zip(values, ("<u2", "<i8", "<i8"), strict=True))
            sums[0][numbers] += count
            sums[1][numbers] += best
            sums[2][numbers] = 1
    if base is not None:
        yield close()


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document; path_a is a byte-level
    vocabulary of the tokenizers library, path_b a merge-type model of the sentencepiece library."""
    spark = docs.sparkSession
    rows = stored(_aligned(docs, path_a, path_b), "alignment")
    postings = rows.where(F.col("a").isNotNull()).select("a", "b", "n", "place", "documents", "times")
    weights = postings.groupBy("a").agg(F.sum(F.col("n") + ROW).alias("weight"))
    share = (weights.agg(F.sum("weight")).first()[0] or 0) / (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # at most two ids for each partition of a shuffle weigh more than a share, so this table is small
    large = stored(weights.where(F.col("weight") > share).select("a", F.ceil(F.col("weight") / max(share, 1)).cast("int").alias("parts")), "alignment-large")
    parts = F.coalesce("parts", F.lit(1))
    nothing = [F.lit(None).cast(t).alias(x) for x, t in (("place", "long"), ("documents", "binary"), ("times", "binary"))]
    counts = postings.groupBy("a", "b").agg(F.sum("n").alias("n")).join(F.broadcast(large), "a", "left")
    counts = counts.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "b", "n", *nothing)
    dealt = postings.join(F.broadcast(large), "a", "left").select("a", F.pmod(F.xxhash64("place", "b", "documents"), parts).cast("int").alias("part"), "b", F.col("n").cast("long").alias("n"), "place", "documents", "times")
    streams = counts.unionByName(dealt).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("place"), "b")
    added = streams.mapInArrow(_contributions, "place long, documents binary, counts binary, best binary").repartition("place").sortWithinPartitions("place").mapInArrow(_added, "place long, count_sum long, n_best long")
    told = rows.where(F.col("a").isNull()).join(added, "place", "left")
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n_best", "count_sum")]
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
