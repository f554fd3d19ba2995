"""Plans: runs under a length cap that together pass every street."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright import schemas
from lanewright.operators import graph, runs, solver
from lanewright.operators.areas import net_of
from lanewright.scratch import written

#: Requests of one area that one call solves, one after the other.
TOGETHER = 8
_COLUMNS = [c.split()[0] for c in schemas.WALK.split(", ")]


@dataclass(frozen=True)
class Plan:
    walk: DataFrame
    runs: DataFrame
    stats: DataFrame
    full: DataFrame


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    y, x = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    return 2 * 6_371_000.0 * math.asin(math.sqrt(y * y + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * x * x))


def _solve(rows: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
    """The walks of some requests over the network of their area, which is built
    once; requests that share cap and start share its contraction."""
    asks = rows[rows["request_id"].notna()].sort_values("request_id")
    links = rows[rows["src"].notna()]
    out: list[tuple] = []
    if len(links):
        full = net_of(links)
        where = places.drop_duplicates("id").set_index("id").reindex(full.ids)
        lat, lon = where["lat"].to_numpy(float), where["lon"].to_numpy(float)
        contracted: dict = {}
        for _, ask in asks.iterrows():
            out += _walk(ask, full, lat, lon, contracted)
    return pd.DataFrame(out, columns=_COLUMNS)


def _walk(ask: pd.Series, full: solver.Net, lat, lon, contracted: dict) -> list[tuple]:
    cap = float(ask["max_m"])

    def nearest(ids: list[int], y: float, x: float) -> int:
        return min(ids, key=lambda u: ((lat[u] - y) ** 2 + (lon[u] - x) ** 2, u))

    start = None if pd.isna(ask["start_lat"]) else nearest(range(len(full.ids)), ask["start_lat"], ask["start_lon"])
    if (cap, start) not in contracted:
        contracted[cap, start] = solver.contract(full, cap, [] if start is None else [start])
    merged = contracted[cap, start]
    via = {(full.ids[u], full.ids[v]): [full.ids[m] for m in mid] for u, v, _, mid in merged}
    bare = sum(d for _, _, d, _ in merged)
    used = sorted({u for e in merged for u in e[:2]})
    zones = max(1, int(bare / (solver.ZONE_CAPS * cap) + 0.5)) if ask["cluster"] else 1
    label, zones = solver.cluster(lat[used], lon[used], zones)
    zone_of = dict(zip(used, label.tolist(), strict=True))
    # an edge belongs to the zone of its smaller end, so no street falls between
    by_zone: dict[int, list] = {}
    for u, v, d, _ in merged:
        by_zone.setdefault(zone_of[u], []).append((u, v, d))
    order, home = sorted(by_zone), None
    if start is not None:
        centre = {}
        for z, part in by_zone.items():
            ends = sorted({n for u, v, _ in part for n in (u, v)})
            centre[z] = _metres(lat[start], lon[start], lat[ends].mean(), lon[ends].mean())
        order.sort(key=lambda z: (centre[z], z))
        # the first run leaves from the anchor, so a zone with a street of it leads
        home = next((z for z in order if any(start in e[:2] for e in by_zone[z])), None)
        order.sort(key=lambda z: z != home)
    k = None if pd.isna(ask["match_k"]) else float(ask["match_k"])
    out, at, run, component = [], start, 0, 0
    for z in order:
        net = solver.Net((full.ids[u], full.ids[v], d) for u, v, d in by_zone[z])
        place = [full.index[n] for n in net.ids]
        times = solver.augment(net, k)
        pieces = solver.pieces(net)
        if home is not None and z == home:
            pieces.sort(key=lambda part: net.index[full.ids[start]] not in part)
        for part in pieces:
            inside = set(part)
            first = part[0]
            if at is not None:
                here = min(part, key=lambda u: ((lat[place[u]] - lat[at]) ** 2 + (lon[place[u]] - lon[at]) ** 2, u))
                first = here
            walk = solver.circuit(net, {e: n for e, n in times.items() if e[0] in inside}, first)
            parts = solver.split((net.edge(a, b) for a, b in walk), cap)
            for pos, ((a, b), r) in enumerate(zip(walk, parts, strict=True)):
                x, y = net.ids[a], net.ids[b]
                mid = via[(x, y) if x < y else (y, x)]
                out.append((ask["request_id"], ask["area_id"], run + r + 1, z, component, pos, x, y, net.edge(a, b), mid if x < y else mid[::-1], zones))
            if walk:
                run += parts[-1] + 1
                at = place[walk[-1][1]]
            component += 1
    return out


def plan(nodes: DataFrame, edges: DataFrame, requests: DataFrame, all_components: bool = False) -> Plan:
    """Plan every request (request_id, area_id, max_m, start_lat, start_lon,
    cluster, match_k) over its area's streets.

    The largest component of an area is planned; with ``all_components`` each
    one, in order of its smallest node. Its chains are contracted, odd nodes
    matched, every piece walked in a closed walk that starts near the end of
    the last one, and the walk cut by the cap. With a start the first run leaves
    from the node nearest to it, in whichever zone or piece that is. One grouped call for TOGETHER
    requests of an area; the walks are written to the shared folder, so that
    nothing is solved twice, and what comes after is joins, windows and sums.

    An area without streets gives no runs and zero statistics.
    """
    kept = written(edges if all_components else graph.keep_largest(edges), "streets")
    number = F.row_number().over(Window.partitionBy("area_id").orderBy("request_id"))
    dealt = requests.withColumn("part", F.floor((number - 1) / TOGETHER).cast("int"))
    parts = dealt.select("area_id", "part").distinct()
    both = kept.join(parts, "area_id").unionByName(dealt, allowMissingColumns=True)
    here = nodes.join(parts, "area_id").select(F.col("area_id").alias("area"), F.col("part").alias("p"), "id", "lat", "lon")
    walk = both.groupBy("area_id", "part").cogroup(here.groupBy("area", "p")).applyInPandas(_solve, schemas.WALK)
    walk = written(walk, "walks")
    table = runs.run_table(walk, nodes)
    # contraction keeps the total, so the full network's length is the bare one
    full = kept.join(requests.select("request_id", "area_id"), "area_id").select("request_id", "area_id", "src", "dst", "len")
    return Plan(walk, table, runs.plan_stats(walk, table, kept, requests), full)
