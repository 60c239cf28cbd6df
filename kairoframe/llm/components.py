"""Connected components of a graph whose edges are a DataFrame.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond"): each is a join of the edges with the
minimum of each node's neighbours, so nothing is gathered per node and a node
with very many neighbours costs no more than its edges.  Each round's edges
are a table in the shared folder; that cuts the lineage, and as both sides of
the joins are plain scans of such tables, Spark can split skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Loops and repeated edges are fine; null ends are ignored.  No edges, no
    rows.  Raises if the rounds did not settle (they do in about log n).
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = common.staged(edges, "edges")
    before = None
    for _ in range(max_rounds):
        for large in (True, False):
            last, edges = edges, _star(edges, large)
            common.release(last)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round; edges are (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        linked = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = common.staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        ends = F.array(*[F.struct(F.col(x).alias("x"), F.col("m").alias("y")) for x in ("b", "a")])
        linked = edges.join(least, "a").select(F.explode(ends).alias("e")).select(F.greatest("e.x", "e.y").alias("a"), F.least("e.x", "e.y").alias("b"))
    out = common.staged(linked.filter("a != b").distinct(), "star")
    common.release(least)
    return out
