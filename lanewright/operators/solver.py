"""The sequential half of a plan: plain Python for one area at a time.

Runs inside grouped functions. Nodes are numbered in id order, so every tie is
broken by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np

#: Candidate partners of an odd node, by preset, and the default.
PRESETS = {"fast": 2, "best": 12}
DEFAULT_K = PRESETS["fast"]
ROUNDS = 40
SWEEPS = 12
LLOYD = 12
REFINE = 50
ZONE_CAPS = 6


class Net:
    """Adjacency of one area: ids in order, and (neighbour, length) lists."""

    def __init__(self, edges: Iterable[tuple[str, str, float]], nodes: Iterable[str] = ()):
        edges = list(edges)
        self.ids = sorted({n for a, b, _ in edges for n in (a, b)} | set(nodes))
        self.index = {n: k for k, n in enumerate(self.ids)}
        best: dict[tuple[int, int], float] = {}
        for a, b, d in edges:
            u, v = sorted((self.index[a], self.index[b]))
            if u != v and d < best.get((u, v), float("inf")):
                best[u, v] = d
        self.length = dict(sorted(best.items()))
        self.near: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        for (u, v), d in self.length.items():
            self.near[u].append((v, d))
            self.near[v].append((u, d))

    def odd(self) -> list[int]:
        return [k for k, n in enumerate(self.near) if len(n) % 2]

    def edge(self, u: int, v: int) -> float:
        return self.length[(u, v) if u < v else (v, u)]

    def total(self) -> float:
        return sum(self.length.values())


def spread(net: Net, source: int):
    """Nodes in order of (distance, node) from the source, as they are settled."""
    reach = {source: 0.0}
    heap = [(0.0, source)]
    done = set()
    while heap:
        d, u = heappop(heap)
        if u in done:
            continue
        done.add(u)
        yield u, d
        for v, w in net.near[u]:
            if v not in done and d + w < reach.get(v, float("inf")):
                reach[v] = d + w
                heappush(heap, (d + w, v))


def distances(net: Net, source: int) -> dict[int, float]:
    return dict(spread(net, source))


def nearest(net: Net, source: int, k: int, wanted) -> list[tuple[int, float]]:
    """The k wanted nodes nearest to the source, itself left out."""
    out: list[tuple[int, float]] = []
    if k > 0:
        for u, d in spread(net, source):
            if u != source and u in wanted:
                out.append((u, d))
                if len(out) == k:
                    break
    return out


def first_of(net: Net, source: int, targets) -> tuple[int, float] | None:
    """The nearest target; the source counts if it is one."""
    return next(((u, d) for u, d in spread(net, source) if u in targets), None)


def route(net: Net, source: int, target: int) -> list[int] | None:
    """A shortest path, at each node from the smallest of equally near ones that
    were settled before it; or None."""
    reach, came, done = {source: 0.0}, {source: source}, set()
    heap = [(0.0, source)]
    while heap and target not in done:
        d, u = heappop(heap)
        if u in done:
            continue
        done.add(u)
        for v, w in net.near[u]:
            if v not in done:
                before = reach.get(v, float("inf"))
                if d + w < before:
                    reach[v], came[v] = d + w, u
                    heappush(heap, (d + w, v))
                elif d + w == before:
                    came[v] = min(came[v], u)
    if target not in done:
        return None
    path = [target]
    while path[-1] != source:
        path.append(came[path[-1]])
    return path[::-1]


def match(net: Net, odd: list[int], k: float | None = None) -> list[tuple[int, int, float]]:
    """Pairs of odd nodes at little total distance, as (u, v, distance), u < v.

    Rounds of greedy choice: every node left names its ``k`` nearest, and the
    pairs are taken in order of (distance, nodes). Who never finds a free
    partner that way takes the nearest free node of all; unreachable ones stay
    single. Then pairs swap partners while that helps.
    """
    k = int(k) if k is not None and k > 0 else DEFAULT_K
    free, mate, known = set(odd), {}, {}

    def pair(u: int, v: int, d: float) -> None:
        mate[u], mate[v] = v, u
        known[min(u, v), max(u, v)] = d
        free.difference_update((u, v))

    for _ in range(ROUNDS):
        found = {}
        for u in sorted(free):
            for v, d in nearest(net, u, k, free):
                found.setdefault((min(u, v), max(u, v)), d)
        if not found:
            break
        for edge, d in found.items():
            known.setdefault(edge, d)
        for (u, v), d in sorted(found.items(), key=lambda x: (x[1], x[0])):
            if u in free and v in free:
                pair(u, v, known[u, v])
    for u in sorted(free):
        if u in free and (hit := nearest(net, u, 1, free)):
            pair(u, *hit[0])
    swap(mate, known)
    return sorted((u, v, known[u, v]) for u, v in mate.items() if u < v)


def swap(mate: dict[int, int], known: dict[tuple[int, int], float]) -> None:
    """Trade partners between two pairs where both new distances are known and
    their sum is less, the better way of the two; at most SWEEPS times over all
    nodes."""
    far = lambda u, v: known.get((u, v) if u < v else (v, u))
    friends: dict[int, list[int]] = {}
    for u, v in sorted(known):
        friends.setdefault(u, []).append(v)
        friends.setdefault(v, []).append(u)
    for _ in range(SWEEPS):
        better = False
        for a in sorted(mate):
            for c in friends.get(a, ()):
                b, d = mate[a], mate.get(c)
                if d is None or c == b:
                    continue
                sums = [(x + y, p, q) for p, q in ((c, d), (d, c)) if (x := far(a, p)) is not None and (y := far(b, q)) is not None]
                new, p, q = min(sums, default=(float("inf"), c, d))
                if new < far(a, b) + far(c, d) - 1e-9:
                    mate[a], mate[p], mate[b], mate[q] = p, a, q, b
                    better = True
        if not better:
            break


def augment(net: Net, k: float | None = None) -> dict[tuple[int, int], int]:
    """How often each edge is walked so that every node has an even degree:
    once, and again for each path between matched odd nodes that uses it."""
    times = dict.fromkeys(net.length, 1)
    odd = net.odd()
    if len(odd) >= 2:
        for u, v, _ in match(net, odd, k):
            path = route(net, u, v) or []
            for a, b in zip(path, path[1:], strict=False):
                times[min(a, b), max(a, b)] += 1
    return times


def circuit(net: Net, times: dict[tuple[int, int], int], start: int | None = None) -> list[tuple[int, int]]:
    """A closed walk over each edge as often as given, from ``start`` if it has
    an edge, else from the smallest node; the smallest open neighbour first."""
    left = {e: n for e, n in times.items() if n > 0}
    if not left:
        return []
    turn = [0] * len(net.ids)
    order = [[v for v, _ in sorted(n)] for n in net.near]
    if start is None or not any(start in e for e in left):
        start = min(min(e) for e in left)
    trail, out = [start], []
    while trail:
        u = trail[-1]
        while turn[u] < len(order[u]):
            v = order[u][turn[u]]
            e = (u, v) if u < v else (v, u)
            if left.get(e):
                left[e] -= 1
                trail.append(v)
                break
            turn[u] += 1
        else:
            out.append(trail.pop())
    out.reverse()
    return list(zip(out, out[1:], strict=False))


def split(lengths: Iterable[float], cap: float) -> list[int]:
    """The run number of each step: a new run where the next would pass the cap.
    A step longer than the cap is a run by itself."""
    out, run, total = [], 0, 0.0
    for k, d in enumerate(lengths):
        if k and total > 0 and total + d > cap:
            run, total = run + 1, 0.0
        total += d
        out.append(run)
    return out


def pieces(net: Net) -> list[list[int]]:
    """Connected components, each in order, by their smallest node."""
    seen: set[int] = set()
    out = []
    for k in range(len(net.ids)):
        if k not in seen and net.near[k]:
            part = [u for u, _ in spread(net, k)]
            seen.update(part)
            out.append(sorted(part))
    return out


def contract(net: Net, cap: float = float("inf"), keep: Iterable[int] = ()) -> list[tuple[int, int, float, list[int]]]:
    """Edges (u, v, length, nodes between) with chains of degree 2 made one, u < v.

    A chain stays as it is where it would be a loop, would lie beside an edge
    that is there already, or is longer than the cap. Of chains between the
    same two junctions the one with the fewest nodes is made one first (then
    the shortest, then that with the smallest nodes). A direct edge always
    holds its place, over the cap or not. Rings without a junction stay.
    """
    keep = set(keep)
    anchor = [len(n) != 2 or k in keep for k, n in enumerate(net.near)]
    out: list[tuple[int, int, float, list[int]]] = []
    walked: set[tuple[int, int]] = set()
    chains = []
    for j, near in enumerate(net.near):
        if not anchor[j]:
            continue
        for step, _ in near:
            if (j, step) in walked:
                continue
            path = [j, step]
            while not anchor[path[-1]]:
                (a, _), (b, _) = net.near[path[-1]]
                path.append(b if a == path[-2] else a)
            walked.update(((path[0], path[1]), (path[-1], path[-2])))
            if path[0] > path[-1] or (path[0] == path[-1] and path[1] > path[-2]):
                path.reverse()
            chains.append((len(path), sum(net.edge(a, b) for a, b in zip(path, path[1:], strict=False)), path))
    taken: set[tuple[int, int]] = set()
    on_chain = {n for _, _, path in chains for n in path}
    for size, length, path in sorted(chains):
        ends = path[0], path[-1]
        if size == 2 or (ends[0] != ends[1] and ends not in taken and length <= cap):
            taken.add(ends)
            out.append((*ends, length, path[1:-1]))
        else:
            out += [(min(a, b), max(a, b), net.edge(a, b), []) for a, b in zip(path, path[1:], strict=False)]
    out += [(u, v, d, []) for (u, v), d in net.length.items() if u not in on_chain]
    return sorted(out, key=lambda e: (e[0], e[1]))


def seeds(lon: np.ndarray, k: int) -> np.ndarray:
    """k places spread evenly over the nodes in order of (longitude, id)."""
    by = np.argsort(lon, kind="stable")
    return by[[i * (len(lon) - 1) // (k - 1) for i in range(k)]] if k > 1 else by[:1]


def cluster(lat: np.ndarray, lon: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(zone of each node, zones): LLOYD rounds of k-means in plain degrees. The
    lowest zone of equally near ones; an empty zone keeps its centre."""
    if k <= 1 or len(lat) <= k:
        return np.zeros(len(lat), np.int64), 1
    at = seeds(lon, k)
    centre = np.stack([lat[at], lon[at]], 1)
    zone = np.zeros(len(lat), np.int64)
    for _ in range(LLOYD):
        zone = ((lat[:, None] - centre[:, 0]) ** 2 + (lon[:, None] - centre[:, 1]) ** 2).argmin(1)
        size = np.bincount(zone, minlength=k)
        sums = np.stack([np.bincount(zone, lat, k), np.bincount(zone, lon, k)], 1)
        centre = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centre)
    return zone, k


def grow(net: Net, lat: np.ndarray, lon: np.ndarray, k: int) -> np.ndarray:
    """Zones by the number of steps from seeds; the lowest seed of equals. Nodes
    out of reach go with the nearest seed in plain degrees."""
    zone = np.full(len(lat), -1)
    if k <= 1:
        return np.zeros(len(lat), np.int64)
    at = seeds(lon, k)
    wave: list[int] = []
    for z, s in enumerate(at):
        if zone[s] < 0:
            zone[s] = z
            wave.append(int(s))
    while wave:
        claims: dict[int, int] = {}
        for u in wave:
            for v, _ in net.near[u]:
                if zone[v] < 0:
                    claims[v] = min(claims.get(v, k), int(zone[u]))
        for v, z in claims.items():
            zone[v] = z
        wave = list(claims)
    lost = zone < 0
    if lost.any():
        zone[lost] = ((lat[lost, None] - lat[at]) ** 2 + (lon[lost, None] - lon[at]) ** 2).argmin(1)
    return zone


def settle(net: Net, zone: np.ndarray) -> np.ndarray:
    """Move nodes to the zone most of their neighbours are in, one by one in
    order, while that is strictly more than now; at most REFINE times over."""
    zone = zone.copy()
    for _ in range(REFINE):
        moved = False
        for u, near in enumerate(net.near):
            votes: dict[int, int] = {}
            for v, _ in near:
                votes[int(zone[v])] = votes.get(int(zone[v]), 0) + 1
            best = min(votes, key=lambda z: (-votes[z], z), default=int(zone[u]))
            if votes.get(best, 0) > votes.get(int(zone[u]), 0):
                zone[u], moved = best, True
        if not moved:
            break
    return zone


def odd_distances(net: Net) -> dict[int, dict[int, float]]:
    """Distances between all odd nodes; those out of reach are infinite."""
    odd = net.odd()
    out = {}
    for u in odd:
        d = distances(net, u)
        out[u] = {v: d.get(v, float("inf")) for v in odd if v != u}
    return out


def in_order(far: dict[int, dict[int, float]]) -> list[tuple[int, int, float]]:
    """The plainest matching: each free node in turn takes its nearest free one."""
    free, out = set(far), []
    for u in sorted(far):
        if u in free:
            free.discard(u)
            d, v = min(((far[u][v], v) for v in free), default=(float("inf"), -1))
            if d < float("inf"):
                free.discard(v)
                out.append((u, v, d))
    return out


def all_swaps(pairs: list[tuple[int, int, float]], far: dict[int, dict[int, float]]) -> list[tuple[int, int, float]]:
    """Trade partners between any two pairs until nothing gains over 1e-6."""
    pairs = list(pairs)
    gain = True
    while gain:
        gain = False
        for i in range(len(pairs)):
            for j in range(i + 1, len(pairs)):
                (a, b, p), (c, d, q) = pairs[i], pairs[j]
                first, second = far[a][c] + far[b][d], far[a][d] + far[b][c]
                if min(first, second) < p + q - 1e-6:
                    x, y = ((a, c), (b, d)) if first <= second else ((a, d), (b, c))
                    pairs[i], pairs[j] = (*x, far[x[0]][x[1]]), (*y, far[y[0]][y[1]])
                    gain = True
    return pairs
