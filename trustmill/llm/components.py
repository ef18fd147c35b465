"""Connected components of a graph given by its edges, by alternating stars.

Each round links every node's larger neighbours to the least one, then its smaller ones; both keep components whole and
draw them together to stars around their least node in a logarithmic number of rounds. Rounds are written to the
shared folder, so that no lineage grows. Degrees may be large: minima are combined before the shuffle and stored, so that
a node with very many edges is a side of a join that adaptive execution can split.

Cases: edges with a null end and edges from a node to itself connect nothing; repeated edges count once; without edges
there are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustmill.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Gives node and component (the least node reachable) for every node with an edge."""
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    now = stored(edges.where("a <> b").select(*ends).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
        now = stored(small.where("a <> b").distinct(), "edges")
        state, before = _state(now), state
        if state == before:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
