"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import discard, mark, stored

#: Edges, of two keys of sixteen bytes, whose nodes are broadcast; a round over so few is one job.
FEW_EDGES = 50_000


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).distinct()


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """The edges with m, the smallest neighbour of u.

    The table of nodes is broadcast if there are ``few``. Else it is stored first: then both sides of the join are plain
    shuffles, of which Spark splits the parts that nodes with many edges make too large.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(F.broadcast(least) if few else stored(least, "least"), "u")


def large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Each node's larger neighbours go to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _distinct(_with_least(both, few).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")))


def small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ends = F.explode(F.array(F.col("v"), F.col("u"))).alias("u")
    return _distinct(_with_least(down, few).select(ends, F.col("m").alias("v")))


def are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: neither star changes such edges, if v is the smaller end."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")
    nodes = edges.select(ends).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("root"))
    return nodes.where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("root") == 0))).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is its component's smallest node.

    ``edges`` has u and v. No node's neighbours are gathered in one row; rounds are stored in the shared folder,
    and deleted when the next one is. A round ends them if it leaves stars, so none is run only to see that nothing changes.
    """
    begun = mark()
    edges = stored(_distinct(edges.select("u", "v")), "edges")
    while True:
        few = edges.count() <= FEW_EDGES
        large = large_star(edges, few)
        edges = stored(small_star(large if few else stored(large, "edges"), few), "edges")
        discard(edges.sparkSession, begun, keep=1)
        if are_stars(edges):
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
