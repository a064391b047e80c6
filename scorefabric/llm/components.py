"""Connected components of a link table, by contraction: every step is a join or an aggregate that combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of the component.

    Each round points every node at its least neighbour, follows the pointers to their ends by doubling, and replaces
    links by the links between ends. Links shrink by half at least, so rounds are logarithmic. Rows with a null end or
    a = b are no links; an empty table gives no rows.
    """
    both = links.where("a <> b").select("a", "b")
    edges = materialise(both.union(both.select("b", "a")).distinct(), "links")
    roots: DataFrame | None = None
    while not edges.isEmpty():
        point = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        point = materialise(point, "pointers")
        while True:
            ahead = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = materialise(point.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
            point = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = point.select("node", F.col("to").alias("root"))
        else:
            roots = materialise(roots.join(point.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        ends = point.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        one = edges.join(ends, "a").select(F.col("ra").alias("a"), "b")
        edges = materialise(one.join(ends.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b").select("a", F.col("rb").alias("b")).where("a <> b").distinct(), "links")
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
