"""One request from a saved response to its runs, phase by phase."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.operators.graph import edges_from_ways
from lanewright.plans.route_plan import Plan, plan
from lanewright.sources import osm

PHASES = ("building", "elevation", "elevation_failed", "solving", "done")


class NoStreets(ValueError):
    """The response holds no street to plan."""


def plan_response(items: DataFrame, requests: DataFrame, heights: DataFrame | None = None, on_phase: Callable[[str], None] = lambda _: None) -> Plan:
    """Plan requests over an element table, telling ``on_phase`` what goes on.

    ``heights`` are the batches of ``osm.with_elevation``; if some area's are
    incomplete the plan goes on without its elevations, after
    'elevation_failed'. Without any street it raises NoStreets.
    """
    on_phase("building")
    nodes = osm.nodes_of(items)
    edges = edges_from_ways(nodes, osm.ways_of(items))
    if edges.isEmpty():
        raise NoStreets("no streets found in that area")
    if heights is not None:
        on_phase("elevation")
        nodes = osm.with_elevation(nodes, heights)
        known = nodes.groupBy("area_id").agg(F.count("ele").alias("n")).where("n = 0")
        if not known.isEmpty():
            on_phase("elevation_failed")
    on_phase("solving")
    out = plan(nodes, edges, requests)
    on_phase("done")
    return out
