"""The in-area solver: plain Python, known answers and invariants."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewright.operators import solver
from lanewright.operators.solver import Net


def grid(rows, cols, seed=0, holes=0.0, middles=False):
    rng = random.Random(seed)
    gone = {(r, c) for r in range(rows) for c in range(cols) if rng.random() < holes}
    out = []
    for r in range(rows):
        for c in range(cols):
            for q in ((r, c + 1), (r + 1, c)):
                if (r, c) not in gone and q not in gone and q[0] < rows and q[1] < cols:
                    a, b, d = f"{r:02}_{c:02}", f"{q[0]:02}_{q[1]:02}", 100.0 + rng.randrange(80)
                    out += [(a, f"{a}~{b}", d / 2), (f"{a}~{b}", b, d / 2)] if middles else [(a, b, d)]
    return out


def largest(net):
    part = set(max(solver.pieces(net), key=len))
    return Net((net.ids[u], net.ids[v], d) for (u, v), d in net.length.items() if u in part)


def test_shortest_of_parallel_edges_counts():
    net = Net([("a", "b", 71), ("b", "a", 23), ("a", "b", 58)])
    assert net.length == {(0, 1): 23} and net.near == [[(1, 23)], [(0, 23)]]


def test_shortest_paths():
    net = Net([("a", "b", 1), ("b", "c", 1), ("a", "c", 4), ("c", "d", 1), ("x", "y", 1)])
    assert solver.distances(net, 0) == {0: 0, 1: 1, 2: 2, 3: 3}
    assert solver.route(net, 0, 3) == [0, 1, 2, 3] and solver.route(net, 0, 0) == [0] and solver.route(net, 0, 4) is None
    assert solver.nearest(net, 0, 2, {0, 2, 3}) == [(2, 2), (3, 3)] and solver.first_of(net, 0, {0, 3}) == (0, 0.0) and solver.first_of(net, 0, {5}) is None


def test_a_chain_becomes_one_edge():
    net = Net([("a", "x", 30), ("x", "b", 70), ("a", "c", 1), ("a", "d", 1), ("b", "e", 1), ("b", "f", 1)])
    merged = {(net.ids[u], net.ids[v]): (d, [net.ids[m] for m in via]) for u, v, d, via in solver.contract(net)}
    assert merged["a", "b"] == (100, ["x"])
    kept = solver.contract(net, keep=[net.index["x"]])
    assert sum(d for *_, d, _ in kept) == net.total() and any(net.ids[v] == "x" for _, v, *_ in kept)


def test_a_chain_beside_an_edge_stays():
    net = Net([("a", "x", 30), ("x", "b", 30), ("a", "b", 100), ("a", "c", 1), ("b", "d", 1)])
    rows = solver.contract(net)
    assert sorted((net.ids[u], net.ids[v]) for u, v, *_ in rows) == [("a", "b"), ("a", "c"), ("a", "x"), ("b", "d"), ("b", "x")]


def test_an_edge_over_the_cap_keeps_its_place():
    net = Net([("a", "b", 500), ("a", "x", 30), ("x", "b", 30), ("a", "c", 1), ("b", "d", 1)])
    assert sum(d for *_, d, _ in solver.contract(net, cap=100)) == net.total()


def test_long_chains_and_rings_stay():
    chain = Net([("a", "x", 60), ("x", "b", 60), ("a", "c", 1), ("a", "d", 1), ("b", "e", 1), ("b", "f", 1)])
    assert all(not via for *_, via in solver.contract(chain, cap=100))
    ring = Net([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)])
    assert len(solver.contract(ring)) == 3
    loop = Net([("j", "a", 1), ("a", "b", 1), ("b", "j", 1), ("j", "k", 1)])
    assert sum(d for *_, d, _ in solver.contract(loop)) == 4 and len(solver.contract(loop)) == 4


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 9), st.integers(2, 9), st.integers(0, 99), st.sampled_from([0.0, 0.15, 0.3]), st.booleans(), st.sampled_from([None, 1, 2, 12, 0.5]))
def test_a_walk_covers_every_street(rows, cols, seed, holes, middles, k):
    net = Net(grid(rows, cols, seed, holes, middles))
    if not net.length:
        return
    net = largest(net)
    odd = net.odd()
    pairs = solver.match(net, odd, k)
    ends = [n for u, v, _ in pairs for n in (u, v)]
    assert sorted(ends) == odd and all(u < v for u, v, _ in pairs)
    assert all(d == pytest.approx(solver.distances(net, u)[v]) for u, v, d in pairs)
    times = solver.augment(net, k)
    degree = np.zeros(len(net.ids), int)
    for (u, v), n in times.items():
        assert n >= 1
        degree[[u, v]] += n
    assert not (degree % 2).any()
    assert sum(net.length[e] * (n - 1) for e, n in times.items()) == pytest.approx(sum(d for *_, d in pairs))
    walk = solver.circuit(net, times, len(net.ids) - 1)
    assert len(walk) == sum(times.values()) and walk[0][0] == walk[-1][1] == len(net.ids) - 1
    assert all(a[1] == b[0] for a, b in zip(walk, walk[1:], strict=False))
    lengths = [net.edge(a, b) for a, b in walk]
    runs = solver.split(lengths, 500)
    totals = np.bincount(runs, lengths)
    assert all(t <= 500 or runs.count(r) == 1 for r, t in enumerate(totals))
    merged = solver.contract(net, 500)
    assert sum(d for *_, d, _ in merged) == pytest.approx(net.total())
    small = Net((net.ids[u], net.ids[v], d) for u, v, d, _ in merged)
    assert sorted(small.ids[u] for u in small.odd()) == sorted(net.ids[u] for u in odd)
    assert sum(1 + len(via) for *_, via in merged) == len(net.length)


def test_matching_is_better_than_the_plainest_and_order_free():
    edges = grid(14, 14, 3, 0.2)
    net = largest(Net(edges))
    far = solver.odd_distances(net)
    plain = sum(d for *_, d in solver.in_order(far))
    ours = sum(d for *_, d in solver.match(net, net.odd(), 12))
    assert ours < plain and sum(d for *_, d in solver.all_swaps(solver.in_order(far), far)) <= plain
    shuffled = list(edges)
    random.Random(1).shuffle(shuffled)
    again = largest(Net((b, a, d) for a, b, d in shuffled))
    assert solver.match(again, again.odd()) == solver.match(net, net.odd())


def test_stragglers_find_each_other():
    net = Net([("a", "m", 1), ("b", "m", 1), ("c", "m", 1)])
    assert len(solver.match(net, net.odd(), 0.5)) == 2


def test_presets():
    assert solver.PRESETS == {"fast": 2, "best": 12} and solver.DEFAULT_K == 2


def test_split_at_exactly_the_cap():
    assert solver.split([50, 50, 1], 100) == [0, 0, 1] and solver.split([], 5) == [] and solver.split([9, 1, 9], 5) == [0, 1, 2]


def test_zones():
    lat, lon = np.array([0.0, 0.0, 0.0, 0.0, 9.0]), np.array([0.0, 1.0, 10.0, 11.0, 5.0])
    zone, k = solver.cluster(lat, lon, 2)
    assert k == 2 and zone[0] == zone[1] != zone[2] == zone[3]
    assert solver.cluster(lat, lon, 1)[1] == 1 and solver.cluster(lat, lon, 7)[1] == 1
    net = Net([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], ["a", "b", "c", "d", "e"])
    grown = solver.grow(net, lat, lon, 2)
    assert grown.tolist() == [0, 0, 1, 1, 0]


def test_route_over_an_edge_shorter_than_the_float_spacing():
    net = Net([("a", "b", 1e6), ("b", "c", 1e-12), ("c", "d", 1e6)])
    assert solver.route(net, 0, 3) == [0, 1, 2, 3] and solver.route(net, 3, 0) == [3, 2, 1, 0]


def test_the_better_of_two_rewirings_is_taken():
    known = {(0, 1): 10.0, (2, 3): 10.0, (0, 2): 9.0, (1, 3): 9.0, (0, 3): 1.0, (1, 2): 1.0}
    mate = {0: 1, 1: 0, 2: 3, 3: 2}
    solver.swap(mate, known)
    assert mate == {0: 3, 3: 0, 1: 2, 2: 1}
