"""Near-duplicate embeddings: navigable small-world graphs per shard, searched by every vector.

Equal vectors are one class. Class vectors are dealt into shards; each shard builds a hierarchical navigable small-world
graph, and every class vector is searched in every shard's graph: each pair of shards meets in one task, which searches
the vectors of either in the other's graph. A search keeps a beam of the closest vectors found; from those above the
threshold it follows the graph's links both ways over others above it, as a graph may hold no link to a vector in a dense
group, however wide the beam. A search that would meet more links than the shard has vectors compares its vector with all
of them instead. In a shard whose audit (a few searches of vectors of all shards compared with brute force over the shard,
without a vector's match with itself) finds less than RECALL of the links, beams widen for all until the audit passes or a
beam would meet as many links; then every vector is compared with the shard's. Pairs found are verified by their cosine in
double precision. Shards and graphs depend on the vectors alone, so that a table gives the same ones each time.
No pairs leave a task: it gives each vector's number of links and a spanning forest of the
links, at most one row a vector. Components of these links are the result; the least recall that the audits measured
comes with it.

Each vector meets every shard, which is the method's cost: the graphs are shuffled once for each shard there is.

Cases: vectors that are null, empty, zero, or with null or non-finite components are alone with 0 links; vectors of
different dimensions have no links, and those of each dimension are linked among themselves; rows with the same id are
separate vectors with their own links; a null id links as others do, is never a component's id, and is kept if it is
alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from trustmill.llm.common import stored
from trustmill.llm.components import components

#: Neighbours kept a node (twice as many on the ground level), beam while building, first beam of a search.
DEGREE, BUILD_BEAM, BEAM, RECALL, AUDITED = 12, 48, 32, 0.98, 64
#: Links an audit needs, vectors of all shards it may ask.
LINKS, POOL = 256, 4096
#: Nodes of a beam that a search expands at once (a quarter of the beam, so many at most), and vectors that join a graph in one round;
#: numbers of gathered vectors that are held at once.
EXPANDED, ROUND, FLOATS = 64, 512, 1 << 22
#: Vectors of a shard at most (the links between two shards are held as bits, SHARD_ROWS^2 / 8 bytes), queries searched
#: at once (fewer, so that their beams hold CELLS nodes at most), queries whose results are held, and shards that a table is
#: dealt into if each has SHARE_ROWS vectors.
SHARD_ROWS, QUERY_ROWS, CELLS, HELD_ROWS, SHARES, SHARE_ROWS = 20_000, 512, 1 << 20, 2048, 3, 2000


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors.

    Vectors join in rounds, each as large as the graph so far: a round's vectors are searched side by side in the graph
    before it and linked to each other by brute force, which lets numpy do the work of many insertions at once.
    """

    def __init__(self, vectors: np.ndarray, seed: int = 1, round_rows: int = ROUND):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(rng.random(n)) / math.log(DEGREE)).astype(int), 6)
        self.members = [np.flatnonzero(levels >= k) for k in range(int(levels.max(initial=0)) + 1)]
        self.links = [np.full((n, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k in range(len(self.members))]
        self.entry = int(self.members[-1][0]) if n else -1
        for level in range(len(self.members) - 1, -1, -1):
            self._build(level, round_rows)

    def _build(self, level: int, round_rows: int) -> None:
        rows, done, width = self.members[level], 0, self.links[level].shape[1]
        # upper levels' members come first, as the way down leads to them
        if level + 1 < len(self.members):
            upper = self.members[level + 1]
            rows = np.concatenate([upper, np.setdiff1d(rows, upper, assume_unique=True)])
        joined = np.zeros(len(self.x), bool)
        while done < len(rows):
            fresh = rows[done : done + max(32, min(round_rows, done))]
            near, score = np.empty((len(fresh), 0), np.int32), np.empty((len(fresh), 0), np.float32)
            if done:
                start = self._descend(self.x[fresh], level)
                start[~joined[start]] = rows[0]  # members of the upper level that join this one later
                near, score = self._search(self.x[fresh], level, BUILD_BEAM, start)
            joined[fresh] = True
            among = self.x[fresh] @ self.x[fresh].T
            np.fill_diagonal(among, -2)
            near = np.hstack([near, np.broadcast_to(fresh.astype(np.int32), (len(fresh), len(fresh)))])
            score = np.hstack([score, among])
            top = np.argsort(-score, axis=1, kind="stable")[:, : min(3 * width, score.shape[1])]
            near, score = np.take_along_axis(near, top, 1), np.take_along_axis(score, top, 1)
            near = np.where(score > -2, near, -1)
            chosen = self._diverse(near, score, width // 2)
            self.links[level][fresh, : chosen.shape[1]] = chosen
            at, k = np.nonzero(chosen >= 0)
            self._link_back(level, chosen[at, k], fresh[at])
            done += len(fresh)

    def _diverse(self, near: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """For each row of candidates (best first, -1 for none) those closer to the new vector than to one chosen before,
        then the closest of the rest; -1 where there are fewer than `most`."""
        step = max(1, FLOATS // (near.shape[1] * max(near.shape[1], self.x.shape[1])))
        if len(near) > step:
            return np.concatenate([self._diverse(near[lo : lo + step], score[lo : lo + step], most) for lo in range(0, len(near), step)])
        x = self.x[near]
        between = x @ x.transpose(0, 2, 1)
        bad, chosen, count = near < 0, np.zeros(near.shape, bool), np.zeros(len(near), int)
        for k in range(near.shape[1]):
            new = ~bad[:, k] & (count < most)
            chosen[:, k] = new
            count += new
            if (count >= most).all():
                break
            bad |= new[:, None] & (between[:, k] >= score)
        order = np.argsort(np.where(chosen, 0, np.where(near < 0, 2, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(near, order, 1)

    def _link_back(self, level: int, nodes: np.ndarray, rows: np.ndarray) -> None:
        """Links from nodes to rows, pair by pair; of a node with too many the diverse ones stay."""
        links = self.links[level]
        width = links.shape[1]
        fresh = ~(links[nodes] == rows[:, None]).any(axis=1)
        order = np.argsort(nodes[fresh], kind="stable")
        nodes, rows = nodes[fresh][order], rows[fresh][order]
        each, first, count = np.unique(nodes, return_index=True, return_counts=True)
        by_count = np.argsort(count, kind="stable")
        for lo in range(0, len(each), ROUND):  # nodes with as many new links together
            part = by_count[lo : lo + ROUND]
            place = np.arange(count[part].max())
            new = np.where(place < count[part, None], rows[np.minimum(first[part, None] + place, len(rows) - 1)], -1)
            near = np.hstack([links[each[part]], new.astype(np.int32)])
            score = np.full(near.shape, -2, np.float32)
            n, c = np.nonzero(near >= 0)
            score[n, c] = self._cosines(near[n, c], self.x, each[part][n])
            top = np.argsort(-score, axis=1, kind="stable")[:, : 3 * width]
            near, score = np.take_along_axis(near, top, 1), np.take_along_axis(score, top, 1)
            over = near[:, width:].max(axis=1, initial=-1) >= 0
            links[each[part][~over]] = near[~over, :width]
            if over.any():
                links[each[part][over]] = self._diverse(near[over], score[over], width)

    def _cosines(self, nodes: np.ndarray, queries: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of each node with the query of that number."""
        out, step = np.empty(len(nodes), np.float32), max(1, FLOATS // self.x.shape[1])
        for lo in range(0, len(nodes), step):
            part = slice(lo, lo + step)
            out[part] = np.einsum("kd,kd->k", self.x[nodes[part]], queries[which[part]])
        return out

    def _descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """The closest node found on the levels above, for each query."""
        at = np.full(len(queries), self.entry, np.int32)
        for upper in range(len(self.members) - 1, level, -1):
            near, _ = self._search(queries, upper, 4, at)
            at = near[:, 0]
        return at

    def _search(self, queries: np.ndarray, level: int, beam: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The beam closest nodes found for each query, best first (-1 and -2 where there are fewer)."""
        links, n, size = self.links[level], len(queries), len(self.x)
        out_ids, out_score = np.empty((n, beam), np.int32), np.empty((n, beam), np.float32)
        ids, score = np.full((n, beam), -1, np.int32), np.full((n, beam), -2, np.float32)
        ids[:, 0] = start
        score[:, 0] = np.einsum("qd,qd->q", self.x[start], queries)
        todo = score.copy()  # scores of nodes that are not expanded yet, else -2
        met = np.zeros(n * size, np.int32)  # 0, or the place in the last step that met the node
        active = np.arange(n)
        met[active * size + start] = 1
        at_once = min(EXPANDED, max(1, beam // 4))
        while len(active):
            # expand the best open nodes of each query, of which there is one
            pick = np.argpartition(todo, beam - at_once, axis=1)[:, beam - at_once :] if at_once < beam else np.zeros((len(active), 1), int)
            near = links[np.take_along_axis(ids, pick, 1)]
            near[np.take_along_axis(todo, pick, 1) <= -2] = -1
            np.put_along_axis(todo, pick, np.float32(-2), 1)
            near = near.reshape(len(active), -1)
            key = (active * size)[:, None] + near
            place = np.flatnonzero((near >= 0) & (met[key] == 0))
            value = np.full(near.shape, -2, np.float32)
            key = key.ravel()[place]
            met[key] = number = np.arange(1, len(place) + 1, dtype=np.int32)
            place = place[met[key] == number]  # a node met twice in one step counts once
            value.ravel()[place] = self._cosines(near.ravel()[place], queries, active[place // near.shape[1]])
            all_score = np.hstack([score, value])
            top = np.argpartition(all_score, near.shape[1], axis=1)[:, near.shape[1] :]
            ids, score, todo = (np.take_along_axis(a, top, 1) for a in (np.hstack([ids, near]), all_score, np.hstack([todo, value])))
            ended = ~(todo > -2).any(axis=1)
            if ended.any():
                out_ids[active[ended]], out_score[active[ended]] = ids[ended], score[ended]
                active, ids, score, todo = (a[~ended] for a in (active, ids, score, todo))
        top = np.argsort(-out_score, axis=1, kind="stable")
        out_ids, out_score = np.take_along_axis(out_ids, top, 1), np.take_along_axis(out_score, top, 1)
        return np.where(out_score > -2, out_ids, -1), out_score

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return self._search(queries, 0, min(beam, len(self.x)), self._descend(queries, 0))

    @cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The ground level's links both ways: where each node's begin (and the last one's end), and the nodes they lead to."""
        n, (at, k) = len(self.x), np.nonzero(self.links[0] >= 0)
        to = self.links[0][at, k].astype(np.int64)
        pairs = np.unique(np.concatenate([at * n + to, to * n + at]))
        return np.searchsorted(pairs, np.arange(n + 1) * n), pairs % n

    def _spread(self, queries: np.ndarray, found: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
        """Queries' nodes (query * nodes + node) with all that links lead to, either way, over nodes with such a cosine; and
        which queries met more links than there are nodes, so that theirs are not complete."""
        size, (first, others) = len(self.x), self.neighbours
        met, links = np.zeros(len(queries) * size, bool), np.zeros(len(queries), np.int64)
        met[found] = True
        out, fresh = [found], found
        while len(fresh):
            count = np.diff(first)[fresh % size]
            links += np.bincount(fresh // size, count, len(queries)).astype(np.int64)
            go = links[fresh // size] <= size
            fresh, count = fresh[go], count[go]
            ends, new = np.cumsum(count), []
            for part in np.split(np.arange(len(fresh)), np.searchsorted(ends, np.arange(CELLS, count.sum(), CELLS))):
                own, c = fresh[part], count[part]
                place = np.arange(c.sum()) + np.repeat(first[own % size] - np.cumsum(c) + c, c)
                near = np.repeat(own - own % size, c) + others[place]
                near = np.unique(near[~met[near]])
                met[near] = True
                new.append(near[self._cosines(near % size, queries, near // size) >= low])
            fresh = np.concatenate(new)
            out.append(fresh)
        return np.sort(np.concatenate(out)), links > size

    def above(self, queries: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
        """For each query the nodes found with a cosine of about the threshold or more."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(queries)
        size, low, rows = len(self.x), threshold - 1e-5, max(1, min(QUERY_ROWS, CELLS // beam))
        whole = [np.arange(len(queries))] if beam >= size else []
        for lo in range(0, len(queries) if beam < size else 0, rows):
            part = queries[lo : lo + rows]
            ids, score = self.search(part, beam)
            which, k = np.nonzero(score >= low)
            found, dense = self._spread(part, which * size + ids[which, k], low)
            which, first = np.unique(found // size, return_index=True)
            for k, nodes in zip(which.tolist(), np.split((found % size).astype(np.int32), first[1:]), strict=False):
                out[lo + k] = nodes
            whole.append(lo + np.flatnonzero(dense))
        left, rows = np.concatenate(whole) if whole else np.arange(0), max(1, FLOATS // max(1, size))
        for lo in range(0, len(left), rows):
            for k, near in zip(left[lo : lo + rows].tolist(), queries[left[lo : lo + rows]] @ self.x.T >= low, strict=True):
                out[k] = np.flatnonzero(near).astype(np.int32)
        return out


def audited_beam(graph: SmallWorld, threshold: float, beam: int = BEAM, queries: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[int, float]:
    """The first beam, doubling from the given one, with which a sample of searches finds RECALL of the links; the number of
    nodes if beams that meet fewer links than that do not.

    own: each query's position in the graph or -1; a vector's match with itself is no link. Queries of all shards (at
    first the given ones, in random order) are asked until LINKS links are known, at most all and every vector of the graph."""
    n = len(graph.x)
    order = np.random.default_rng(2).permutation(n)
    asked, at = graph.x[order], order
    if queries is not None:
        first = np.random.default_rng(3).permutation(len(queries))
        asked, at = np.concatenate([np.asarray(queries, np.float32)[first], asked]), np.r_[own[first], order]
    done, size, total, who, true = 0, AUDITED, 0, [], []
    while done < len(asked) and (not done or total < LINKS):
        for lo in range(done, min(size, len(asked)), QUERY_ROWS):
            part = slice(lo, min(lo + QUERY_ROWS, size, len(asked)))
            near = asked[part] @ graph.x.T >= threshold + 1e-5
            inside = np.flatnonzero(at[part] >= 0)
            near[inside, at[part][inside]] = False
            for k in np.flatnonzero(near.any(axis=1)):
                who.append(lo + int(k))
                true.append(np.flatnonzero(near[k]))
            total += int(near.sum())
        done, size = size, size * 2
    while True:
        found = graph.above(asked[who], threshold, beam) if who else []
        hits = sum(int(np.isin(t, f).sum()) for t, f in zip(true, found, strict=True))
        recall = hits / total if total else 1.0
        if recall >= RECALL or beam >= n:
            return beam, recall
        beam = 2 * beam if 2 * beam * graph.links[0].shape[1] < n else n


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, the vector as bytes of its own precision, its digest and its dimension; null but for vec_id for vectors
    that can have no links."""
    kind = np.float32 if isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else np.float64
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding" if kind == np.float32 else F.col("embedding").cast("array<double>").alias("embedding"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            vectors = []
            for value in batch.column(1):
                items = value.values if value.is_valid else None
                x = None if items is None or not len(items) or items.null_count else items.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
                vectors.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            digests = [v and xxhash.xxh3_128_digest(v) for v in vectors]
            sizes = [v and len(v) // kind().itemsize for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["vec_id", "v", "digest", "d"])

    return plain.mapInArrow(run, "vec_id long, v binary, digest binary, d int")


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    data = b"".join(x.as_py() for x in column)
    return np.frombuffer(data, np.float32 if len(data) == 4 * d * len(column) else np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dealt(rows: DataFrame, groups: int | None, *keys: str) -> DataFrame:
    """Rows dealt to more tasks than there are groups: groups that take long but hold few bytes would share a task else."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 4 * (groups or 0)), *keys)


def graphs(classes: DataFrame, threshold: float, shard_rows: int) -> DataFrame:
    """d, shard, shards (of that dimension), recall and graph. classes: node, copies, v, d."""
    n = F.col("n")
    shards = F.greatest(F.ceil(n / shard_rows), F.least(F.lit(SHARES), F.floor(n / SHARE_ROWS)), F.lit(1)).cast("int")
    # one row a dimension
    sizes = classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).select("d", shards.alias("shards"))
    held = classes.join(F.broadcast(sizes), "d").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    picked = classes.orderBy(F.xxhash64("v", F.lit(2)), "v").limit(POOL).select("node", "v", "d").toArrow()
    pool = {}
    for d in set(picked.column("d").to_pylist()):
        own = picked.filter(pa.array([x == d for x in picked.column("d").to_pylist()])).sort_by("v")
        pool[d] = (own.column("node").to_numpy(), _matrix(own.column("v"), d))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("v").take(np.random.default_rng(0).permutation(len(table)))
        d = table.column("d")[0].as_py()
        nodes, x = table.column("node").to_numpy(), _matrix(table.column("v"), d)
        graph = SmallWorld(_unit(x))
        others, y = pool.get(d, (np.empty(0, np.int64), np.ones((0, d))))
        order = np.argsort(nodes)
        at = order[np.minimum(np.searchsorted(nodes, others, sorter=order), len(nodes) - 1)]
        beam, recall = audited_beam(graph, threshold, queries=_unit(y) if len(y) else None, own=np.where(nodes[at] == others, at, -1))
        parts = {"nodes": nodes, "copies": table.column("copies").to_numpy(), "x": x, "level0": graph.links[0], "entry": np.array([graph.entry]), "beam": np.array([beam])}
        for k in range(1, len(graph.links)):
            parts[f"level{k}"] = graph.links[k][graph.members[k]]
            parts[f"members{k}"] = graph.members[k].astype(np.int32)
        out = io.BytesIO()
        np.savez(out, **parts)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in ("d", "shard", "shards")}, "recall": pa.array([recall]), "graph": pa.array([out.getvalue()], pa.binary())})

    held = _dealt(held.select("node", "copies", "v", "d", "shard", "shards"), sizes.agg(F.sum("shards")).first()[0], "d", "shard")
    return held.groupBy("d", "shard").applyInArrow(build, "d int, shard int, shards int, recall double, graph binary")


class Shard:
    """A shard's graph with its vectors, read back."""

    def __init__(self, data: bytes):
        parts = np.load(io.BytesIO(data))
        self.nodes, self.copies, self.beam, self.unit = parts["nodes"], parts["copies"], int(parts["beam"][0]), _unit(parts["x"])
        graph = SmallWorld.__new__(SmallWorld)
        graph.x = np.ascontiguousarray(self.unit, np.float32)
        graph.entry = int(parts["entry"][0])
        graph.links, graph.members = [parts["level0"]], [np.arange(len(self.nodes))]
        while f"level{len(graph.links)}" in parts:
            k = len(graph.links)
            members = parts[f"members{k}"]
            links = np.full((len(self.nodes), parts[f"level{k}"].shape[1]), -1, np.int32)
            links[members] = parts[f"level{k}"]
            graph.links.append(links)
            graph.members.append(members)
        self.graph = graph

    def links(self, other: Shard, threshold: float):
        """For each vector of the other shard its number and the verified links into this one, never to itself."""
        for at in range(0, len(other.nodes), HELD_ROWS):
            part = other.unit[at : at + HELD_ROWS]
            for k, near in enumerate(self.graph.above(part.astype(np.float32), threshold, self.beam)):
                near = near[self.unit[near] @ part[k] >= threshold]
                yield at + k, near[near != at + k] if other is self else near


def met(a: Shard, b: Shard, threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Numbers of links of the vectors (of either shard) in the pair of shards, and a spanning forest of these links."""
    bits = np.zeros((len(a.nodes), -(-len(b.nodes) // 8)), np.uint8)
    for k, near in b.links(a, threshold):  # row k
        np.bitwise_or.at(bits[k], near >> 3, (128 >> (near & 7)).astype(np.uint8))
        if a is b:  # column k is found by the same search
            bits[near, k >> 3] |= np.uint8(128 >> (k & 7))
    for k, near in a.links(b, threshold) if a is not b else ():  # column k
        bits[near, k >> 3] |= np.uint8(128 >> (k & 7))
    some = np.flatnonzero(bits.any(axis=1))
    by_a, by_b = np.zeros(len(a.nodes), np.int64), np.zeros(len(b.nodes), np.int64)
    root = np.arange(len(a.nodes) if a is b else len(a.nodes) + len(b.nodes))
    shift, forest = 0 if a is b else len(a.nodes), []
    for k in some.tolist():
        near = np.flatnonzero(np.unpackbits(bits[k], count=len(b.nodes)))
        by_a[k] = b.copies[near].sum()
        by_b[near] += a.copies[k]
        roots, first = np.unique(root[near + shift], return_index=True)
        new = roots != root[k]
        if new.any():
            forest += [(int(a.nodes[k]), int(b.nodes[near[f]])) for f in first[new]]
            root[np.isin(root, roots[new])] = root[k]
    degrees = dict(zip(a.nodes[by_a > 0].tolist(), by_a[by_a > 0].tolist(), strict=True))
    if a is not b:
        degrees |= dict(zip(b.nodes[by_b > 0].tolist(), by_b[by_b > 0].tolist(), strict=True))
    return degrees, forest


def links(built: DataFrame, threshold: float) -> DataFrame:
    """node, other (null, or a link of the spanning forests) and linked (null, or a part of the node's number of links)."""
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    groups = built.agg(F.sum((F.col("shards") + 1) / 2).cast("int")).first()[0]  # n shards have n * (n + 1) / 2 pairs
    pairs = built.select("d", "shard", "graph", other.alias("other")).select("d", "shard", "graph", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        both = [Shard(x.as_py()) for x in table.column("graph")]
        degrees, forest = met(both[0], both[-1], threshold)
        nodes = [*degrees, *(a for a, _ in forest)]
        others, linked = [None] * len(degrees) + [b for _, b in forest], [*degrees.values()] + [None] * len(forest)
        return pa.table({"node": pa.array(nodes, pa.int64()), "other": pa.array(others, pa.int64()), "linked": pa.array(linked, pa.int64())})

    return _dealt(pairs, groups, "d", "i", "j").groupBy("d", "i", "j").applyInArrow(run, "node long, other long, linked long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (the least that an audit measured) for every row."""
    rows = unit_vectors(embeddings)
    same = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("d").alias("d"), F.first("v").alias("v"))
    classes = stored(same.select(F.monotonically_increasing_id().alias("node"), "*"), "vector-classes")
    built = stored(graphs(classes, threshold, shard_rows), "graphs")
    recall = built.agg(F.coalesce(F.min("recall"), F.lit(1.0))).first()[0]
    found = stored(links(built, threshold), "vector-links")
    degree = found.where("linked is not null").groupBy("node").agg(F.sum("linked").alias("linked"))
    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.select("node", "digest", "least", "copies").join(degree, "node", "left").join(joined, "node", "left")
    known = known.select("digest", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("digest", "n_links", "component_id")
    linked = rows.where("digest is not null").join(known, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("recall"))
