"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import discard, materialise


def connected_components(links: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long).

    The component is the smallest node that can be reached. Alternating large
    and small stars: each round hangs every node on the smallest neighbour it
    knows, so the table never outgrows the links and a hub is first reduced to
    its minimum before any join. Each round is a table in the shared folder,
    and it ends when every node hangs on one root. Self links and nulls are
    ignored; no links give an empty table.
    """
    # in order of (greater, less), from the first round on without repeats
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), label)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        discard(before)
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 0 and up + down > 1").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
