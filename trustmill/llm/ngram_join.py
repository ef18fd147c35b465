"""N-gram Jaccard join: groups of documents linked by the similarity of their sets of word n-grams.

Words are runs of anything but ASCII white space, A-Z lower-cased. A document's set holds 64-bit hashes of its distinct
n-grams; fewer words than n make one n-gram of all of them; no words, no set and no links. Two documents are linked
when 100 * |A & B| >= percent * |A | B|. No pair is lost:

1. Documents with equal sets are one class, represented by its least id.
2. With m(n) = n - ceil(percent/100 * n), the first m(n) + k n-grams of linked sets have at least k in common under any
   order. Of each set the first 2 m(n) + 1 by hash are counted over all documents; sets of which fewer than
   m(ceil(percent/100 * n)) + 1, the k of their smallest possible partner, occur twice are alone. The others' ids are
   set in a table of IDS bits, which is broadcast; tasks that read the texts again pass over documents whose bit is not
   set. So texts are never shuffled. The more bits are set, the more sets are kept without need, and none is lost.
3. Linked sets differ in at most d n-grams, d told by the size band of the larger one. Hashes dealt into d + 1 + s parts
   make s + 1 parts of linked sets equal, so that each of them has s + 1 parts that occur twice, and of these one is left
   in both if each leaves out the s that occur most often. A part holds several n-grams, so that what two texts share by
   chance does not join them, as single n-grams would once there are many texts. Stars around the least document of each
   part that is left, and their components, bring every possible pair into one block. Blocks are split by size (only
   neighbouring size bands can be linked), and those of more than CHUNK_GRAMS n-grams also into chunks, every two of
   which meet; this is quadratic in the chunks of such a block.
4. In a block, hashes are dealt into groups and the group counts of a set are a point of an R-tree. The sum of the
   coordinates' minima bounds an overlap from above, for single points and, with coordinate maxima, for tree nodes; pairs
   already connected and pairs under the bound are passed over, the rest are verified on the sets. In blocks of more than
   HOT_AT rows a set is first compared with the RECENT last ones that had links, which connects dense groups.
5. Components of the verified links are the result. Equal sets or dense groups are never expanded into pairs.

Cases: null and empty texts, and texts of white space, have size 0 and are alone; long texts count whole; rows with
the same id are one node; null ids have null components and are linked with nothing; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustmill.llm.common import stored
from trustmill.llm.components import components

HOT_AT, RECENT, FANOUT = 64, 8, 16
#: N-grams and rows of a chunk at most (a set of more n-grams is a chunk of its own).
CHUNK_GRAMS, CHUNK_ROWS = 4_000_000, 20_000
#: Bits of a table of ids, and of one page of it: 16 MB in all, whatever the corpus.
IDS, PAGE = 1 << 27, 1 << 15


def ngrams(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(words))], np.uint64).view(np.int64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - n + 1 + k]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def spare(size, percent: int):
    """How many n-grams of a set may be missing in a linked one."""
    return size - (percent * size + 99) // 100


def size_band(size: int, percent: int) -> int:
    """Sizes of linked sets lie in the same band or in neighbouring ones."""
    return math.floor(math.log(size) / math.log(100 / percent) + 1e-9)


def dealt_parts(band: int, percent: int) -> tuple[int, int]:
    """How many parts sets are dealt into to meet sets of this band that are as large or larger, and how many of the parts
    that occur twice each may leave out; no parts where only equal sets can be linked."""
    largest = math.floor((100 / percent) ** (band + 1) * (1 + 1e-9))
    differ = 2 * largest * (100 - percent) // (100 + percent)
    out = differ // 4 + 1
    return (differ + 1 + out, out) if differ else (0, 0)


def part_hashes(s: np.ndarray, band: int, n: int) -> np.ndarray:
    """A hash of each of a set's n parts, its number and the band; an empty part has one too."""
    folded = np.zeros(n, np.uint64)
    if n:
        at = (s.view(np.uint64) % np.uint64(n)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        folded[at[starts]] = np.bitwise_xor.reduceat(s.view(np.uint64)[order], starts)
    out = folded + (np.arange(n, dtype=np.uint64) + np.uint64(band << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def _required(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The least overlap of linked sets of these sizes."""
    return -((-percent * (a + b)) // (100 + percent))


class CountTree:
    """An R-tree over group counts of sets, packed by size; queries give positions whose bound allows a link."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        order = np.lexsort((*counts.T[: min(4, counts.shape[1])], sizes))
        self.order = order
        self.levels = [(counts[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > FANOUT:
            most, low, high = self.levels[-1]
            starts = np.arange(0, len(most), FANOUT)
            self.levels.append((np.maximum.reduceat(most, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def query(self, counts: np.ndarray, size: int, asked: np.ndarray | None = None) -> np.ndarray:
        """Positions (as given; of those asked) that may be linked with a set of these counts and this size."""
        least, most = (self.percent * size + 99) // 100, 100 * size // self.percent
        asked = [np.ones(len(self.order), bool) if asked is None else asked[self.order]]
        while len(asked) < len(self.levels):
            asked.append(np.logical_or.reduceat(asked[-1], np.arange(0, len(asked[-1]), FANOUT)))
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[depth]
            at = at[asked[depth][at] & (high[at] >= least) & (low[at] <= most)]
            bound = np.minimum(upper[at], counts).sum(axis=1, dtype=np.int64)
            at = at[bound >= _required(size, np.maximum(low[at], least), self.percent)]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def block_links(ids: list[int], sets: list[np.ndarray], resident: list[bool], chunk: list[int], percent: int) -> list[tuple[int, int]]:
    """Verified links that connect what is connected within the block: a spanning forest.

    Only pairs with a resident, and of different chunks where the block joins two chunks, are compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    groups = int(min(2048, max(32, 2 ** math.ceil(math.log2(2 * float(np.median(sizes)) + 1)))))
    counts = np.zeros((len(sets), groups), np.uint16)
    for k, s in enumerate(sets):
        counts[k] = np.bincount((s.view(np.uint64) % np.uint64(groups)).astype(np.int64), minlength=groups)
    tree = CountTree(counts, sizes, percent)
    root, lives, own = np.arange(len(sets)), np.array(resident), np.array(chunk)
    cross = len(set(chunk)) > 1
    links, recent = [], []

    def met(k: int, j: int) -> bool:
        shared = _overlap(sets[k], sets[j])
        if 100 * shared < percent * (sizes[k] + sizes[j] - shared):
            return False
        root[root == root[j]] = root[k]
        links.append((ids[k], ids[j]))
        return True

    for k in np.argsort(sizes, kind="stable").tolist():
        if len(sets) > HOT_AT:
            for j in recent:
                if root[j] != root[k] and (lives[j] or lives[k]) and not (cross and own[j] == own[k]):
                    met(k, j)
        asked = (root != root[k]) & (lives | lives[k])
        if cross:
            asked &= own != own[k]
        for j in np.sort(tree.query(counts[k], int(sizes[k]), asked)).tolist():
            if root[j] != root[k] and met(k, j):
                recent = [k, j, *(x for x in recent if x not in (k, j))][:RECENT]
    return links


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _first_parts(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size of the set, its digest (null if empty) and its first n-grams in the order of their hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [ngrams(x, n) for x in part.column(1).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                firsts = [s[: 2 * spare(len(s), percent) + 1] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], ["doc_id", "size", "digest", "first"])

    return docs.mapInArrow(run, "doc_id long, size long, digest binary, first array<long>")


def _bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(IDS))


def id_bits(ids: DataFrame) -> np.ndarray:
    """The table of bits that the ids set, in bytes."""

    def run(table: pa.Table) -> pa.Table:
        page = np.zeros(PAGE // 8, np.uint8)
        at = table.column("at").to_numpy()
        np.bitwise_or.at(page, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([page.tobytes()], pa.binary())})

    bit = _bit(F.col("doc_id"))
    places = ids.select(F.floor(bit / PAGE).cast("int").alias("page"), (bit % PAGE).alias("at")).distinct()
    out = np.zeros(IDS // 8, np.uint8)
    # at most IDS / PAGE pages of PAGE / 8 bytes
    pages = places.groupBy("page").applyInArrow(run, "page int, bits binary").toArrow()
    for page, bits in zip(pages.column("page").to_pylist(), pages.column("bits").to_pylist(), strict=True):
        out[page * (PAGE // 8) : (page + 1) * (PAGE // 8)] = np.frombuffer(bits, np.uint8)
    return out


def _set_in(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows but those with doc_id and digest of gone. Only rows whose bit some id of gone sets are joined with it."""
    shared = rows.sparkSession.sparkContext.broadcast(id_bits(gone))

    @F.pandas_udf("boolean")
    def hit(at: pd.Series) -> pd.Series:
        return pd.Series(_set_in(shared.value, at.to_numpy()))

    told = hit(_bit(F.col("doc_id")))
    return rows.where(~told).unionByName(rows.where(told).join(gone, ["doc_id", "digest"], "left_anti"))


def _whole_sets(docs: DataFrame, n: int, percent: int, ids: np.ndarray) -> DataFrame:
    """doc_id, the set (sorted int64 as bytes), its size band, and its parts and those it may leave out to meet sets of this
    band and of the one above, of documents whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in it:
            batch = batch.filter(pa.array(_set_in(ids, batch.column(2).to_numpy())))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [ngrams(x, n) for x in part.column(1).to_pylist()]
                bands = [size_band(len(s), percent) if len(s) else 0 for s in sets]
                columns = [part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(bands, pa.int32())]
                for up in (0, 1):
                    told = [dealt_parts(band + up, percent) for band in bands]
                    columns.append(pa.array([out for _, out in told], pa.int32()))
                    columns.append(pa.array([part_hashes(s, band + up, m) for s, band, (m, _) in zip(sets, bands, told, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "grams", "band", "out", "parts", "out_above", "parts_above"])

    known = docs.where("doc_id is not null").select("doc_id", "text", _bit(F.col("doc_id")).alias("bit"))
    return known.mapInArrow(run, "doc_id long, grams binary, band int, out int, parts array<long>, out_above int, parts_above array<long>").where("octet_length(grams) > 0")


def _shared(parts: DataFrame) -> DataFrame:
    """Hashes that occur twice or more, with their count and least document."""
    return parts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub")).where("n > 1")


def _left_parts(sets: DataFrame) -> DataFrame:
    """doc_id and h of the parts that occur twice or more, but those each set may leave out: the most frequent ones."""
    sides = F.array(F.struct(F.col("band").alias("level"), "out", "parts"), F.struct((F.col("band") + 1).alias("level"), F.col("out_above").alias("out"), F.col("parts_above").alias("parts")))
    parts = sets.select("doc_id", F.explode(sides).alias("p")).select("doc_id", "p.level", "p.out", F.explode("p.parts").alias("h"))
    # stored, so that a hot part's side of the join can be split
    often = parts.join(stored(_shared(parts).select("h", "n"), "shared"), "h")
    place = F.row_number().over(Window.partitionBy("doc_id", "level").orderBy(F.desc("n"), "h"))
    return stored(often.withColumn("place", place).where("place > out").select("doc_id", "h"), "left-parts")


def _in_block(rows: DataFrame, percent: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.int64) for x in table.column("grams").to_pylist()]
        links = block_links(table.column("doc_id").to_pylist(), sets, table.column("resident").to_pylist(), table.column("chunk").to_pylist(), percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("block", "band", "i", "j").applyInArrow(run, "a long, b long")


def links(found: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links between representatives: enough to connect all that is connected. found: first parts by class."""
    parts = found.select("doc_id", "size", F.explode("first").alias("h"))
    shared = stored(_shared(parts).select("h"), "twice")
    least = F.ceil(F.col("size") * percent / 100)
    twice = parts.join(shared, "h", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    near = twice.where(F.col("n") > least - F.ceil(least * percent / 100)).select("doc_id")
    sets = stored(_whole_sets(docs, n, percent, id_bits(near)), "sets")
    parts = _left_parts(sets)
    stars = parts.join(stored(_shared(parts), "hubs"), "h").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    blocks = components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("block"))
    ratio = 100 / percent
    rows = stored(sets.join(blocks, "doc_id").select("doc_id", "grams", "block", "band"), "blocked")
    placed = rows.select("doc_id", "block", F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(True).alias("resident")), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("resident")))).alias("p"))
    placed = placed.select("doc_id", "block", "p.band", "p.resident")
    full = placed.groupBy("block", "band").agg(F.count(F.lit(1)).alias("rows"), F.max("resident").alias("lived_in")).where("lived_in and rows > 1")
    fit = F.greatest(F.least(F.lit(CHUNK_ROWS), F.floor(CHUNK_GRAMS / F.pow(F.lit(ratio), F.col("band") + 1))), F.lit(1))
    full = stored(full.select("block", "band", F.ceil(F.col("rows") / fit).cast("int").alias("chunks")), "blocks")
    dealt = placed.join(full, ["block", "band"]).select("doc_id", "block", "band", "resident", "chunks", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"))
    meets = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.withColumn("other", meets).select("doc_id", "block", "band", "resident", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return _in_block(dealt.join(rows.select("doc_id", "grams"), "doc_id"), percent)


def classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(_first_parts(texts, n, percent), "first-parts")
    known = found.where("digest is not null and doc_id is not null")
    copies = known.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = stored(copies, "copies")
    again = stored(known.select("doc_id", "digest").join(copies, "digest").where("doc_id <> first_id").select("doc_id", "digest"), "later-copies")
    heads = _without(known.select("doc_id", "size", "first", "digest"), again).select("doc_id", "size", "first")
    joined = components(links(heads, texts, n, percent))
    members = known.select("doc_id", "size", "digest").join(copies, "digest", "left").select("doc_id", "size", F.coalesce("first_id", "doc_id").alias("class"))
    out = members.join(joined, members["class"] == joined["node"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "class").alias("component_id"))
    alone = found.where("digest is null or doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay if one document of each group is kept, all their columns as they are.

    Rows with the least id of their group stay; of several such rows with one id, all with that id (they are one
    document); rows without an id stay.
    """
    gone = classes(docs, n, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
