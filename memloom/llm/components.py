"""Connected components of an edge table, by alternating large and small stars.

Each round hangs a node's neighbours on the smallest of them; rounds are few
(a logarithm of the longest chain), all data stays in tables, and every step
is written in the shared folder, so lineage does not grow.  A node's smallest
neighbour is a partial sum; it is written before it is joined back, so that
adaptive execution can split a join in which one node has very many edges.
Rounds end once the edges are stars, whose centres are the components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest of the node and all its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    out = durable(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "stars")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the smallest of those; ``edges`` go from larger to smaller."""
    least = durable(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = durable(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    discard(least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges`` are stars apart from each other: nothing hangs on two nodes, or hangs and is hung on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Repeated edges and loops are harmless; rows with a null end are ignored;
    no edges give no rows."""
    loops = edges.where("a is not null and b is not null").select("a", "b")
    now = durable(loops.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        large = _large_star(now)
        small = _small_star(large)
        discard(now, large)
        now = small
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
