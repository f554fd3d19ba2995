"""Whole-area operators: one grouped call an area around the solver.

A street plan needs a whole connected network at once, and one fits a task
many times over; so areas are what runs in parallel. Input frames are put in
id order first, for rows of a group come in any order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright import schemas
from lanewright.operators import solver


def net_of(frame: pd.DataFrame, nodes=()) -> solver.Net:
    return solver.Net(zip(frame["src"], frame["dst"], frame["len"], strict=True), nodes)


def _each(edges: DataFrame, schema: str, rows, columns: list[str] | None = None) -> DataFrame:
    """``rows(net)`` of each area, as tuples after the area id."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        area = frame["area_id"].iat[0]
        return pd.DataFrame([(area, *r) for r in rows(net_of(frame))], columns=names)

    return edges.select("area_id", "src", "dst", "len").groupBy("area_id").applyInPandas(run, schema)


def _with_nodes(edges: DataFrame, nodes: DataFrame, schema: str, rows) -> DataFrame:
    """``rows(net, lat, lon)`` of each area; nodes without an edge take part."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(links: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if not len(places):
            return pd.DataFrame(columns=names)
        area = places["area"].iat[0]
        places = places.sort_values("id")
        net = net_of(links, places["id"])
        at = places.set_index("id").reindex(net.ids)
        return pd.DataFrame([(area, *r) for r in rows(net, at["lat"].to_numpy(float), at["lon"].to_numpy(float))], columns=names)

    both = edges.select("area_id", "src", "dst", "len").groupBy("area_id").cogroup(nodes.select(F.col("area_id").alias("area"), "id", "lat", "lon").groupBy("area"))
    return both.applyInPandas(run, schema)


def distances_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(area_id, source, id, dist) over the network from (area_id, source)."""

    def run(links: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(links):
            net = net_of(links)
            for s in sorted(set(starts["source"])):
                if s in net.index:
                    out += [(links["area_id"].iat[0], s, net.ids[u], d) for u, d in solver.spread(net, net.index[s])]
        return pd.DataFrame(out, columns=["area_id", "source", "id", "dist"])

    both = edges.groupBy("area_id").cogroup(sources.select(F.col("area_id").alias("area"), "source").groupBy("area"))
    return both.applyInPandas(run, "area_id string, source string, id string, dist double")


def paths(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(area_id, source, target, dist, path) of (area_id, source, target); a
    null path where there is none."""

    def run(links: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        net = net_of(links)
        for area, s, t in wanted[["area", "source", "target"]].itertuples(index=False):
            path = solver.route(net, net.index[s], net.index[t]) if s in net.index and t in net.index else None
            length = None if path is None else sum(net.edge(a, b) for a, b in zip(path, path[1:], strict=False))
            out.append((area, s, t, length, None if path is None else [net.ids[u] for u in path]))
        return pd.DataFrame(out, columns=["area_id", "source", "target", "dist", "path"])

    both = edges.groupBy("area_id").cogroup(ends.select(F.col("area_id").alias("area"), "source", "target").groupBy("area"))
    return both.applyInPandas(run, "area_id string, source string, target string, dist double, path array<string>")


def nearest_odd(edges: DataFrame, k: int = solver.DEFAULT_K) -> DataFrame:
    """(area_id, id, rank, other, dist): the k odd nodes nearest to each odd node
    over the network."""

    def rows(net):
        odd = set(net.odd())
        for u in sorted(odd):
            for n, (v, d) in enumerate(solver.nearest(net, u, k, odd), 1):
                yield net.ids[u], n, net.ids[v], d

    return _each(edges, "area_id string, id string, rank int, other string, dist double", rows)


def odd_distances(edges: DataFrame) -> DataFrame:
    """(area_id, id, reached, nearest, farthest): of each odd node the number of
    others in reach and the least and greatest distance to them."""

    def rows(net):
        odd = set(net.odd())
        for u in sorted(odd):
            far = [d for v, d in solver.spread(net, u) if v in odd and v != u]
            yield net.ids[u], len(far), min(far, default=None), max(far, default=None)

    return _each(edges, "area_id string, id string, reached long, nearest double, farthest double", rows)


def nearest_target(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(area_id, source, target, dist): the nearest over the network of the
    targets in (area_id, source, targets array); of equally near ones the
    smallest. A source that is a target is its own; null if none is in reach."""

    def run(links: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        net = net_of(links)
        for area, s, targets in wanted[["area", "source", "targets"]].itertuples(index=False):
            inside = {net.index[t] for t in targets if t in net.index}
            hit = solver.first_of(net, net.index[s], inside) if s in net.index else None
            out.append((area, s, None if hit is None else net.ids[hit[0]], None if hit is None else hit[1]))
        return pd.DataFrame(out, columns=["area_id", "source", "target", "dist"])

    both = edges.groupBy("area_id").cogroup(ends.select(F.col("area_id").alias("area"), "source", "targets").groupBy("area"))
    return both.applyInPandas(run, "area_id string, source string, target string, dist double")


def matching(edges: DataFrame, k: float | None = None) -> DataFrame:
    """(area_id, u, v, dist): the odd nodes of each area in pairs."""
    return _each(edges, "area_id string, u string, v string, dist double", lambda net: [(net.ids[u], net.ids[v], d) for u, v, d in solver.match(net, net.odd(), k)])


def augmented(edges: DataFrame, k: float | None = None) -> DataFrame:
    """(area_id, src, dst, len, mult): how often each edge is walked so that all
    degrees are even."""
    return _each(edges, "area_id string, src string, dst string, len double, mult int", lambda net: [(net.ids[u], net.ids[v], net.length[u, v], n) for (u, v), n in solver.augment(net, k).items()])


def closed_walks(edges: DataFrame, k: float | None = None) -> DataFrame:
    """(area_id, component, pos, a, b, len): a closed walk over each component."""

    def rows(net):
        times = solver.augment(net, k)
        for c, part in enumerate(solver.pieces(net)):
            inside = set(part)
            own = {e: n for e, n in times.items() if e[0] in inside}
            for pos, (a, b) in enumerate(solver.circuit(net, own, part[0])):
                yield c, pos, net.ids[a], net.ids[b], net.edge(a, b)

    return _each(edges, "area_id string, component int, pos int, a string, b string, len double", rows)


def contracted(edges: DataFrame, cap: float = float("inf"), keep: DataFrame | None = None) -> DataFrame:
    """(area_id, src, dst, len, via) with chains of degree-2 nodes made one edge;
    via lists the nodes between, from src to dst. ``keep`` has (area_id, id) of
    nodes that stay."""

    def run(links: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if not len(links):
            return pd.DataFrame(columns=["area_id", "src", "dst", "len", "via"])
        net = net_of(links)
        area = links["area_id"].iat[0]
        rows = solver.contract(net, cap, [net.index[n] for n in kept["id"] if n in net.index])
        return pd.DataFrame([(area, net.ids[u], net.ids[v], d, [net.ids[m] for m in via]) for u, v, d, via in rows], columns=["area_id", "src", "dst", "len", "via"])

    kept = edges.select("area_id", F.col("src").alias("id")).where(F.lit(False)) if keep is None else keep
    kept = kept.select(F.col("area_id").alias("area"), F.col("id").alias("id"))
    both = edges.select("area_id", "src", "dst", "len").groupBy("area_id").cogroup(kept.groupBy("area"))
    return both.applyInPandas(run, schemas.CONTRACTED)


def clusters(nodes: DataFrame, k: int) -> DataFrame:
    """(area_id, id, zone, zones): k-means over the nodes of each area."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        zone, zones = solver.cluster(frame["lat"].to_numpy(float), frame["lon"].to_numpy(float), k)
        return pd.DataFrame({"area_id": frame["area_id"], "id": frame["id"], "zone": zone, "zones": zones})

    return nodes.select("area_id", "id", "lat", "lon").groupBy("area_id").applyInPandas(run, "area_id string, id string, zone int, zones int")


def grown_zones(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(area_id, id, zone): zones grown step by step from k seeds."""
    return _with_nodes(edges, nodes, "area_id string, id string, zone int", lambda net, lat, lon: zip(net.ids, solver.grow(net, lat, lon, k).tolist(), strict=True))


def settled_zones(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(area_id, id, zone): k-means zones after a local search for fewer cuts."""
    return _with_nodes(edges, nodes, "area_id string, id string, zone int", lambda net, lat, lon: zip(net.ids, solver.settle(net, solver.cluster(lat, lon, k)[0]).tolist(), strict=True))


def covered_by_zones(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(area_id, kind, bare, covered, cuts) if each zone is walked by itself, for
    the zones of each kind: 'one', 'kmeans', 'grown' and 'settled'."""

    def rows(net, lat, lon):
        means = solver.cluster(lat, lon, k)[0]
        for kind, zone in (("one", [0] * len(lat)), ("kmeans", means), ("grown", solver.grow(net, lat, lon, k)), ("settled", solver.settle(net, means))):
            covered = 0.0
            for z in sorted({int(zone[u]) for u, _ in net.length}):
                part = solver.Net((net.ids[u], net.ids[v], d) for (u, v), d in net.length.items() if zone[u] == z)
                covered += sum(part.length[e] * n for e, n in solver.augment(part).items())
            yield kind, net.total(), covered, sum(int(zone[u] != zone[v]) for u, v in net.length)

    return _with_nodes(edges, nodes, "area_id string, kind string, bare double, covered double, cuts int", rows)


def matching_gap(edges: DataFrame) -> DataFrame:
    """(area_id, bare, plain, swapped): the length of the plainest matching, and
    after swaps between all pairs."""

    def rows(net):
        far = solver.odd_distances(net)
        plain = solver.in_order(far)
        yield net.total(), sum(d for *_, d in plain), sum(d for *_, d in solver.all_swaps(plain, far))

    return _each(edges, "area_id string, bare double, plain double, swapped double", rows)
