"""The trie of conversations' prefixes, by partition refinement.

Turns are numbered by a range sort whose last key is a row's own number, so that neither a long conversation nor one with
very many equal rows is sorted in one task. Each conversation c is then rebuilt: the first h turns of the conversation
c - c % BASES, and its own turns after its first h, with h = crc32(c as text) % HEADS.

Refinement starts with one class of all conversations, named by its least id. In each round every active class walks
along the turns that all its members share; where one ends or two differ the class is split by the next turn. A class of
one member is retired at once: the rest of its turns is a unary chain and is given out as it is. So are the turns that a
whole class shares: a chain of nodes with as many members. Rounds are as many as there are splits on one path, not turns.
Classes meet in groups that are combined before the shuffle; only a turn's digest and length go along, never its text.

Fold back: leaves and saved tokens of the classes of a round are summed by the class they came from, last round first.
Ids of the conversations that end at one node are cut into runs by a range sort, and the runs pass in order through one
hash, which cannot be computed in parts; a run is one row of up to RUN ids.

Cases: rows without a conversation's id belong to none; null turns come first; equal turns are ordered by role and text;
repeated rows are turns of their own; null roles and texts are empty; a negative id's remainder has its sign, as in SQL;
conversations that are left without turns end at the root; an empty table has no root and gives no rows; other columns
are not read. Turns are told apart by SHA-256 digests of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustmill.llm.common import stored

BASES, HEADS, RUN = 100, 6, 1000
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), key and signs of every turn."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "row"]
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("key")
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", key, F.length("text").alias("signs"), F.monotonically_increasing_id().alias("at"))
    rows = stored(placed, "turns").withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # a row for each conversation and each partition that it reaches into
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(runs.select("conv", "part", "first", before.alias("before")), ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "key", "signs")


def _rebuilt(numbered: DataFrame, bases: int, heads: int) -> DataFrame:
    """conv, size, pos, key and signs of every rebuilt turn, and of the textless root as the turn 0 of each."""
    sizes = stored(numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "sizes")
    plan = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % bases).alias("base"), (F.crc32(F.col("conv").cast("string")) % heads).alias("own"))
    plan = plan.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("there")), "base", "left")
    plan = plan.withColumn("taken", F.least("own", F.coalesce("there", F.lit(0)))).withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("own"), F.lit(0)))
    first = numbered.where(F.col("pos") < heads).select(F.col("conv").alias("base"), "pos", "key", "signs")
    head = plan.join(first, "base").where("pos <= taken").select("conv", "size", "pos", "key", "signs")
    tail = numbered.join(plan, "conv").where("pos > own").select("conv", "size", (F.col("pos") - F.col("own") + F.col("taken")).alias("pos"), "key", "signs")
    root = plan.select("conv", "size", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("key"), F.lit(0).alias("signs"))
    return head.unionByName(tail).unionByName(root)


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order as text, up to RUN of one node to a row."""
    for batch in it:
        cls, depth, conv = (batch.column(x).to_numpy() for x in ("cls", "depth", "conv"))
        edges = [0, *(1 + np.flatnonzero((cls[1:] != cls[:-1]) | (depth[1:] != depth[:-1]))), len(cls)] if len(cls) else []
        cuts = [(lo, min(lo + RUN, hi)) for start, hi in zip(edges, edges[1:]) for lo in range(start, hi, RUN)]
        at = [lo for lo, _ in cuts]
        texts = [",".join(map(str, conv[lo:hi].tolist())) for lo, hi in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(depth[at]), pa.array(conv[at]), pa.array(texts, pa.string())], ["cls", "depth", "first", "ids"])


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a node in order passed through one hash."""
    node, state, done = None, None, []

    def close() -> None:
        if node:
            done.append((*node, state.hexdigest()))

    for batch in it:
        for cls, depth, ids in zip(*(batch.column(x).to_pylist() for x in ("cls", "depth", "ids")), strict=True):
            if (cls, depth) == node:
                state.update(b"," + ids.encode())
            else:
                close()
                node, state = (cls, depth), hashlib.sha256(ids.encode())
        if len(done) > 10_000:
            yield _digests(done)
            done = []
    close()
    if done:
        yield _digests(done)


def _digests(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends"])


def _empty_hash(ends: Column | str) -> Column:
    return F.coalesce(ends, F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")


def _split(active: DataFrame, number: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round: the classes' turns, the classes with the end of their chain, their children, and the turns that go on."""
    turns = stored(
        active.groupBy("cls", "pos").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("signs").alias("signs"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.max("parent").alias("parent"), F.max("top").alias("top")),
        f"turns-{number}",
    )
    last = turns.groupBy("cls").agg(
        F.max("n").alias("n_convs"), F.max("parent").alias("parent"), F.max("top").alias("top"), F.least(F.min("size"), F.min(F.when(F.col("low") != F.col("high"), F.col("pos") - 1))).alias("end")
    )
    own = turns.join(last.select("cls", "end"), "cls").where("pos <= end").groupBy("cls").agg(F.sum("signs").alias("signs"))
    classes = stored(last.join(own, "cls").select("cls", "parent", "top", "end", "n_convs", ((F.col("n_convs") - 1) * F.col("signs")).alias("own")), f"classes-{number}")
    rest = active.join(classes.select("cls", "end"), "cls").where("pos > end")
    heads = rest.where("pos = end + 1")
    children = stored(heads.groupBy("cls", "key").agg(F.min("conv").alias("child"), F.count(F.lit(1)).alias("members")), f"children-{number}")
    moved = heads.select("conv", "cls", "key").join(children, ["cls", "key"]).select("conv", "child", "members")
    onward = stored(rest.join(moved, "conv").select("conv", F.col("child").alias("cls"), F.col("cls").alias("parent"), (F.col("end") + 1).alias("top"), "size", "pos", "key", "signs", "members"), f"active-{number}")
    return turns, classes, children, onward


def trie(conversations: DataFrame, bases: int = BASES, heads: int = HEADS) -> DataFrame:
    """A row for each node: its least member and depth, its parent, members, children, leaves, saved tokens and ends."""
    spark = conversations.sparkSession
    rebuilt = stored(_rebuilt(_numbered(conversations), bases, heads), "rebuilt")
    least = rebuilt.where("pos = 0").agg(F.min("conv")).first()[0]
    if least is None:
        return spark.createDataFrame([], ", ".join(f"{x} {'string' if x == 'ends_sha256' else 'long'}" for x in NODE))
    # not a literal: joins on one would have no key
    rounds, active = [], rebuilt.select("conv", (F.col("conv") * 0 + F.lit(least).cast("long")).alias("cls"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("top"), "size", "pos", "key", "signs")
    while True:
        turns, classes, children, onward = _split(active, len(rounds))
        rounds.append((active, turns, classes, children, onward))
        if children.where("members > 1").isEmpty():
            break
        active = onward.where("members > 1").drop("members")

    nodes, ends, folded = [], [], None
    for active, turns, classes, children, onward in reversed(rounds):
        kids = children.groupBy("cls").agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("members") == 1).alias("single"))
        now = classes.join(kids, "cls", "left").na.fill(0, ["n_children", "single"])
        if folded is None:
            now = now.withColumns({"leaves": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
        else:
            under = folded.groupBy(F.col("parent").alias("cls")).agg(F.sum("n_leaves").alias("leaves"), F.sum(F.col("own") + F.col("below")).alias("below"))
            now = now.join(under, "cls", "left").na.fill(0, ["leaves", "below"])
        folded = stored(now.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("single") + F.col("leaves"))), "folded")
        chain = turns.select("cls", "pos", "signs").join(folded, "cls").where("pos <= end")
        after = F.sum((F.col("n_convs") - 1) * F.col("signs")).over(Window.partitionBy("cls").orderBy(F.desc("pos")))
        nodes.append(
            chain.select(
                F.col("cls").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("cls")).alias("parent_conv_id"), "n_convs",
                F.when(F.col("pos") == F.col("end"), F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("below") + after).alias("saved_tokens"),
            )
        )
        ends.append(active.where("pos = top").join(classes.select("cls", "end"), "cls").where("size = end").select("cls", F.col("end").alias("depth"), "conv"))
        one, last = F.lit(1).cast("long"), F.col("pos") == F.col("size")
        nodes.append(
            onward.where("members = 1").select(
                F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
                F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), _empty_hash(F.when(last, F.sha2(F.col("conv").cast("string"), 256))),
            )
        )

    def together(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return out

    ordered = together(ends).repartitionByRange("cls", "depth", "conv").sortWithinPartitions("cls", "depth", "conv")
    runs = stored(ordered.mapInArrow(_runs, "cls long, depth long, first long, ids string"), "ends")
    hashes = runs.repartition("cls", "depth").sortWithinPartitions("cls", "depth", "first").mapInArrow(_hashed, "conv_id long, depth long, ends string")
    inner = together(nodes[::2]).join(hashes, ["conv_id", "depth"], "left").select(*NODE[:-1], _empty_hash(F.col("ends")))
    return together([inner, *nodes[1::2]]).select(*NODE)


#: CRC-32 of an id as decimal text: its polynomial is a fixed value.
_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(CAST(c AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), CAST(i AS INT) + 1, 1)) AS BIGINT))), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"
)


def oracle() -> str:
    return f"""WITH own AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, l, {_CRC} % {HEADS} AS h FROM own),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM h a LEFT JOIN own b ON b.c = a.c - a.c % {BASES}),
prefixes AS (SELECT c, d, l[1:d] AS p, len(l) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE length(l[d].x) END AS signs FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, any_value(signs) AS signs, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
paths AS (SELECT m.c, m.d, n.conv_id AS node FROM prefixes m JOIN n ON m.p = n.p AND m.d = n.d),
k AS (SELECT n.conv_id, n.d, n.n, n.signs, n.ends_sha256, paths.node AS parent FROM n LEFT JOIN paths ON paths.c = n.conv_id AND paths.d = n.d - 1),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM k WHERE d > 0 GROUP BY parent, d),
full_ AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN kids ON kids.parent = k.conv_id AND kids.d = k.d),
sums AS (SELECT paths.node AS conv_id, paths.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n - 1) * x.signs) AS saved FROM full_ x JOIN paths ON paths.c = x.conv_id AND paths.d <= x.d GROUP BY paths.node, paths.d)
SELECT f.conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256 FROM full_ f JOIN sums s ON s.conv_id = f.conv_id AND s.d = f.d"""
