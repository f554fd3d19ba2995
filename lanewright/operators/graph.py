"""Street graphs as two tables: nodes, and edges with src < dst.

An edge stands once, whatever its direction; ids are strings and compare by
code point. Every operator works on many areas at once, keyed by area_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright import schemas
from lanewright.functions.scalar import haversine, planar2

KEY = ["area_id"]


def segments(ways: DataFrame) -> DataFrame:
    """(.., u, v) of consecutive references of each way, without a shuffle."""
    refs = F.col("refs")
    pairs = F.when(F.size(refs) >= 2, F.transform(F.sequence(F.lit(1), F.size(refs) - 1), lambda i: F.struct((i - 1).alias("pos"), F.get(refs, i - 1).alias("u"), F.get(refs, i).alias("v"))))
    return ways.select("*", F.explode(pairs).alias("_s")).select(*[c for c in ways.columns if c not in ("refs", "tags")], "_s.pos", "_s.u", "_s.v")


def missing_refs(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """References of ways that no node has."""
    refs = ways.select(*[c for c in ways.columns if c not in ("refs", "tags")], F.explode("refs").alias("id"))
    return refs.join(nodes.select("area_id", "id"), ["area_id", "id"], "left_anti")


def undirected(pairs: DataFrame) -> DataFrame:
    """Edges of (area_id, u, v, len): one for each pair of ends, the shortest.

    Self-loops and lengths of zero or less go.
    """
    rows = pairs.where((F.col("u") != F.col("v")) & (F.col("len") > 0))
    return rows.groupBy("area_id", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.min("len").alias("len"))


def edges_from_ways(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Edges between consecutive nodes of the ways, by great circle. A segment
    with a missing end goes; the gap is not bridged."""
    a = nodes.select("area_id", F.col("id").alias("u"), F.col("lat").alias("_y1"), F.col("lon").alias("_x1"))
    b = nodes.select("area_id", F.col("id").alias("v"), F.col("lat").alias("_y2"), F.col("lon").alias("_x2"))
    both = segments(ways).select("area_id", "u", "v").join(a, ["area_id", "u"]).join(b, ["area_id", "v"])
    return undirected(both.select("area_id", "u", "v", haversine("_y1", "_x1", "_y2", "_x2").alias("len")))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of each edge as (area_id, u, v, len), in one pass."""
    way = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    return edges.select("area_id", "len", F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("a")).select("area_id", "a.u", "a.v", "len")


def degrees(edges: DataFrame) -> DataFrame:
    return arcs(edges).groupBy("area_id", F.col("u").alias("id")).agg(F.count("*").alias("degree"))


def odd_nodes(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree % 2 = 1")


def total_length(edges: DataFrame) -> DataFrame:
    return edges.groupBy("area_id").agg(F.sum("len").alias("bare_m"))


def shape(edges: DataFrame) -> DataFrame:
    """(area_id, nodes, edges, total): nodes that an edge touches."""
    ends = arcs(edges).groupBy("area_id").agg(F.countDistinct("u").alias("nodes"))
    return edges.groupBy("area_id").agg(F.count("*").alias("edges"), F.sum("len").alias("total")).join(ends, "area_id")


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends in (area_id, id)."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.select("area_id", F.col("id").alias(end)), ["area_id", end], "left_semi")
    return out.select("area_id", "src", "dst", "len")


def nearest_node(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(.., id, d2) of the node of its area nearest to each point of (area_id,
    lat, lon, ..), in plain squared degrees; the smallest id of equals."""
    p = points.withColumnRenamed("lat", "_lat").withColumnRenamed("lon", "_lon")
    keys = [c for c in p.columns]
    d2 = planar2("lat", "lon", "_lat", "_lon")
    best = nodes.select("area_id", "id", "lat", "lon").join(p, "area_id").groupBy(*keys).agg(F.min(F.struct(d2.alias("d2"), F.col("id"))).alias("m"))
    return best.select(*[F.col(c).alias(c.removeprefix("_")) for c in keys], "m.id", "m.d2")


def _labels(frame: pd.DataFrame) -> pd.DataFrame:
    """Smallest id of each node's component, by hooking and pointer jumping."""
    ids, ends = np.unique(np.concatenate([frame["src"].to_numpy(str), frame["dst"].to_numpy(str)]), return_inverse=True)
    a, b = ends[: len(frame)], ends[len(frame) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"area_id": frame["area_id"].iat[0], "id": ids, "component": ids[label]})


def components(edges: DataFrame) -> DataFrame:
    """(area_id, id, component): the smallest id of the node's component. One
    grouped call an area; nodes without an edge have no row."""
    return edges.select("area_id", "src", "dst").groupBy("area_id").applyInPandas(_labels, "area_id string, id string, component string")


def largest_component(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(area_id, component) with the most nodes; the smallest label of equals."""
    counts = (components(edges) if labels is None else labels).groupBy("area_id", "component").agg(F.count("*").alias("n"))
    best = counts.groupBy("area_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("component"))).alias("b"))
    return best.select("area_id", "b.component", (-F.col("b.m")).alias("n"))


def _largest_edges(frame: pd.DataFrame) -> pd.DataFrame:
    labels = _labels(frame)
    sizes = labels.groupby("component").size()
    # the index is in order, so the first of the largest is the smallest label
    best = sizes.index[int(sizes.to_numpy().argmax())]
    inside = set(labels.loc[labels["component"] == best, "id"])
    return frame[frame["src"].isin(inside)]


def keep_largest(edges: DataFrame) -> DataFrame:
    """The edges of each area's largest component, in one grouped call an area."""
    return edges.select("area_id", "src", "dst", "len").groupBy("area_id").applyInPandas(_largest_edges, schemas.EDGES)


def is_junction(degree: str | Column = "degree") -> Column:
    return (F.col(degree) if isinstance(degree, str) else degree) != 2


def isolated_loops(edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(area_id, component) of the components without any junction."""
    nodes = degrees(edges).withColumn("junction", is_junction())
    if keep is not None:
        nodes = nodes.join(keep.select("area_id", "id", F.lit(True).alias("_keep")), ["area_id", "id"], "left").withColumn("junction", F.col("junction") | F.col("_keep").isNotNull())
    return nodes.join(components(edges), ["area_id", "id"]).groupBy("area_id", "component").agg(F.bool_or("junction").alias("any")).where("not any").select("area_id", "component")


def covered_gap(edges: DataFrame, walked: DataFrame) -> DataFrame:
    """Edges that no row (area_id, a, b) of a walk passes; empty if all are."""
    done = walked.select("area_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return edges.join(done, ["area_id", "src", "dst"], "left_anti").select("area_id", "src", "dst", "len")


def multigraph(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """(area_id, src, dst, len, mult): once for the edge, once for every
    (area_id, a, b) that passes it again."""
    again = extra.select("area_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).groupBy("area_id", "src", "dst").agg(F.count("*").alias("_n"))
    return edges.join(again, ["area_id", "src", "dst"], "left").select("area_id", "src", "dst", "len", (F.lit(1) + F.coalesce("_n", F.lit(0))).alias("mult"))


def cut_edges(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """(area_id, cuts): edges whose ends lie in different zones of (area_id, id, zone)."""
    z = zones.select("area_id", "id", "zone")
    a, b = z.select("area_id", F.col("id").alias("src"), F.col("zone").alias("z1")), z.select("area_id", F.col("id").alias("dst"), F.col("zone").alias("z2"))
    return edges.join(a, ["area_id", "src"]).join(b, ["area_id", "dst"]).groupBy("area_id").agg(F.count_if(F.col("z1") != F.col("z2")).alias("cuts"))


def csr(edges: DataFrame) -> DataFrame:
    """(area_id, id, number, first, near, len): compressed rows of each area.

    Nodes are numbered from 0 in id order; ``near`` and ``len`` are a node's
    neighbours by number, in order, and the lengths to them; ``first`` is where
    they start in the area's concatenation of all rows. A node's row holds its
    own arcs alone; the running sums are over the nodes of one area.
    """
    w = Window.partitionBy("area_id").orderBy("id")
    nodes = degrees(edges).select("area_id", "id", (F.row_number().over(w) - 1).alias("number"), (F.sum("degree").over(w) - F.col("degree")).alias("first"))
    other = nodes.select("area_id", F.col("id").alias("v"), F.col("number").alias("to"))
    rows = arcs(edges).join(other, ["area_id", "v"]).groupBy("area_id", F.col("u").alias("id")).agg(F.array_sort(F.collect_list(F.struct("to", "len"))).alias("a"))
    return nodes.join(rows, ["area_id", "id"]).select("area_id", "id", "number", "first", F.col("a.to").alias("near"), F.col("a.len").alias("len"))


def nearest_centroid(nodes: DataFrame, centres: list[tuple[int, float, float]]) -> DataFrame:
    """``nodes`` with zone: the nearest of (zone, lat, lon), in plain squared
    degrees; the lowest zone of equally near ones. The centres are literals of
    the expression, so nothing is joined."""
    far = [F.struct(planar2("lat", "lon", F.lit(y), F.lit(x)).alias("d2"), F.lit(z).alias("zone")) for z, y, x in centres]
    return nodes.withColumn("zone", F.array_min(F.array(*far))["zone"])


def edge_zones(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """(area_id, src, dst, len, zone): an edge belongs to the zone of its smaller
    end, so no street falls between two zones."""
    return edges.join(zones.select("area_id", F.col("id").alias("src"), "zone"), ["area_id", "src"]).select("area_id", "src", "dst", "len", "zone")


def make_graph(spark, nodes: list[tuple], links: list[tuple], area_id: str = "g") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of plain lists (id, lat, lon[, ele]) and (u, v, len). Of a
    repeated node the last counts, of a repeated edge the shortest."""
    last = {str(n[0]): (area_id, str(n[0]), float(n[1]), float(n[2]), None if len(n) < 4 or n[3] is None else float(n[3])) for n in nodes}
    rows = [(area_id, str(u), str(v), float(d)) for u, v, d in links]
    return spark.createDataFrame(list(last.values()), schemas.NODES), undirected(spark.createDataFrame(rows, "area_id string, u string, v string, len double"))


