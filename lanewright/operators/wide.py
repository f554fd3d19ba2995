"""Graph fixpoints for areas that do not fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.operators.graph import arcs
from lanewright.scratch import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(area_id, id, component), as ``graph.components`` gives it, by joins.

    Each round a node takes the smallest label among its own and its
    neighbours', then the label of that label; rounds are written tables, so
    neither lineage nor size estimates grow. It ends when a round changes
    nothing, after about as many rounds as the logarithm of the longest path.
    """
    links = written(arcs(edges).select("area_id", "u", "v").distinct(), "links")
    held = written(links.groupBy("area_id", F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("component")), "labels")
    label = held
    while True:
        around = links.join(label.select("area_id", F.col("id").alias("v"), "component"), ["area_id", "v"]).groupBy("area_id", F.col("u").alias("id")).agg(F.min("component").alias("near"))
        hooked = label.join(around, ["area_id", "id"]).select("area_id", "id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = hooked.select("area_id", F.col("id").alias("now"), F.col("now").alias("further"))
        new = written(hooked.join(jump, ["area_id", "now"], "left").select("area_id", "id", "was", F.least("now", F.coalesce("further", "now")).alias("component")), "labels")
        discard(held)
        held, label = new, new.select("area_id", "id", "component")
        if new.where("was <> component").isEmpty():
            discard(links)
            return label
