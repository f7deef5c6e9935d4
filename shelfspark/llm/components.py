"""Connected components of an undirected graph given as a table of links."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): the smallest node that each linked node reaches; roots map to themselves.

    Alternates large-star and small-star steps, each a minimum per node and one join, until the links are stars. No
    neighbour list is ever gathered, so a node with very many links costs rows, not memory. Nulls, loops and repeated links
    are ignored; without links the result is empty.
    """
    edges = links.filter("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct()
    before = None
    while True:
        edges, state = _stored(edges)
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").selectExpr("v as u", "m as v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").selectExpr("v as u", "m as v")
        edges = moved.unionByName(low.selectExpr("u", "m as v")).distinct()
    return edges.selectExpr("u as node", "v as root").unionByName(edges.selectExpr("v as node", "v as root")).distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links written once, with their number and a sum that tells whether they changed."""
    seen = Observation()
    stored = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")), "links")
    return stored, (seen.get["n"], seen.get["x"])
