"""Connected components by alternating star operations, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, settled, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the least node that can be reached.

    Each round links every node's larger neighbours to its least neighbour, then every node and its smaller neighbours
    to the least of these, until a round changes no link; the number of rounds grows with the logarithm of a component's
    size. Links are kept as tables in the shared folder between rounds. Loops and repeated links do no harm, null ends
    are left out.
    """
    spark = links.sparkSession
    with scratch(spark):
        edges = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        n, changed = edges.count(), True
        while changed:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small_edges = written(large.where("u <> v"), "large-star")
            least = written(small_edges.groupBy("u").agg(F.min("v").alias("m")), "least")
            joined = small_edges.join(least, "u")
            small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            after = written(small.where("u <> v").distinct(), "small-star")
            n_after = after.count()
            changed = n_after != n or after.join(edges, ["u", "v"], "left_anti").limit(1).count() > 0
            edges, n = after, n_after
        return settled(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, root) of every node of ``parents`` (node, up), in which each node has one row; roots have themselves as up.

    Pointers are doubled until all lead to a root: rounds grow with the logarithm of a path's length. To be called within
    a ``scratch`` scope; there must be no circles.
    """
    found = written(parents.select("node", F.col("up").alias("root")), "pointers")
    while True:
        above = found.where("node <> root").select(F.col("node").alias("a_node"), F.col("root").alias("a_root"))
        moved = found.join(above, F.col("root") == F.col("a_node"), "left")
        if moved.where("a_root is not null").limit(1).count() == 0:
            return found
        found = written(moved.select("node", F.coalesce("a_root", "root").alias("root")), "pointers")
