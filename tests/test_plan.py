"""Plans as a whole: coverage, caps, anchors, climbs, statistics."""

import pytest
from pyspark.sql import functions as F

from lanewright import schemas
from lanewright.operators import areas, graph, runs
from lanewright.plans import route_plan
from lanewright.plans.route_plan import plan
from lanewright.sources import city, gpx

MI = 1609.344


def request(spark, area="grid", cap=5 * MI, lat=None, lon=None, cluster=False, k=None):
    return spark.createDataFrame([("q", area, cap, lat, lon, cluster, k)], schemas.REQUESTS)


def missed(p):
    steps = p.walk.select("area_id", F.explode(F.arrays_zip(F.concat(F.array("a"), "via").alias("a"), F.concat("via", F.array("b")).alias("b"))).alias("z")).select("area_id", "z.a", "z.b")
    return graph.covered_gap(p.full.select("area_id", "src", "dst", "len"), steps).count()


@pytest.mark.parametrize("holes,diag,cluster,k", [(None, 0, False, None), ([(2, 4, 2, 4)], 5, True, 12.0)])
def test_every_street_in_runs_under_the_cap(spark, holes, diag, cluster, k):
    nodes, edges = city.grid(spark, 8, 7, 0.2, 0.3, holes, diag)
    p = plan(nodes, edges, request(spark, lat=40.70, lon=-74.02, cluster=cluster, k=k))
    assert missed(p) == 0
    table = p.runs.orderBy("run_id").collect()
    assert all(r.length_m <= 5 * MI + 1e-6 for r in table) and [r.run_id for r in table] == list(range(1, len(table) + 1))
    assert (table[0].coords[0].lat, table[0].coords[0].lon) == (pytest.approx(40.70), pytest.approx(-74.02))
    assert all(r.elev_gain_m is None for r in table)
    s = p.stats.first()
    assert s.n_runs == len(table) and s.segments == edges.count() and s.covered_mi >= s.bare_mi and s.total_gain_m is None
    again = plan(nodes, edges, request(spark, lat=40.70, lon=-74.02, cluster=cluster, k=k)).walk.collect()
    assert sorted(map(str, again)) == sorted(map(str, p.walk.collect()))


def test_only_a_single_step_may_pass_the_cap(spark):
    nodes, edges = graph.make_graph(spark, [("a", 40.0, -74.0), ("b", 40.01, -74.0), ("c", 40.2, -74.0), ("d", 40.21, -74.0)], [("a", "b", MI), ("b", "c", 9 * MI), ("c", "d", MI)])
    p = plan(nodes, edges, request(spark, "g"))
    assert missed(p) == 0 and all(r.length_mi <= 5.001 or len(r.coords) == 2 for r in p.runs.collect())


def test_climb(spark):
    places = [("a", 40.0, -74.0, 0), ("b", 40.01, -74.0, 10), ("c", 40.02, -74.0, 4), ("d", 40.03, -74.0, 9)]
    nodes, edges = graph.make_graph(spark, places, [("a", "b", 100), ("b", "c", 100), ("c", "d", 100)])
    p = plan(nodes, edges, request(spark, "g", lat=40.0, lon=-74.0))
    r, s = p.runs.first(), p.stats.first()
    assert (r.elev_gain_m, r.elev_loss_m, s.total_gain_m, s.total_loss_m) == (21, 21, 21, 21)
    text = gpx.tracks(p.runs).first()
    assert text.file_name == "run_1.gpx" and text.gpx.count("<trkpt") == 7 and "<ele>10</ele>" in text.gpx and 'lat="40" lon="-74"' in text.gpx


def test_one_edge_and_no_edge(spark):
    nodes, edges = graph.make_graph(spark, [("a", 40.0, -74.0), ("b", 40.01, -74.0)], [("a", "b", 100)])
    p = plan(nodes, edges, request(spark, "g"))
    assert p.stats.first().segments == 1 and p.walk.count() == 2 and p.stats.first().overhead_pct == 100.0
    nothing = plan(nodes, edges.where("false"), request(spark, "g")).stats.first()
    assert (nothing.n_runs, nothing.segments, nothing.bare_mi, nothing.overhead_pct) == (0, 0, 0.0, 0.0)


def test_points_along_streets_change_nothing(spark):
    nodes, edges = city.grid(spark, 7, 6, 0.2, 0.3, [(2, 3, 2, 4)])
    mid = edges.withColumn("m", F.concat_ws("~", "src", "dst"))
    ends = [nodes.select(F.col("id").alias(e), F.col("lat").alias(f"y{e}"), F.col("lon").alias(f"x{e}")) for e in ("src", "dst")]
    more = mid.join(ends[0], "src").join(ends[1], "dst").select("area_id", F.col("m").alias("id"), ((F.col("ysrc") + F.col("ydst")) / 2).alias("lat"), ((F.col("xsrc") + F.col("xdst")) / 2).alias("lon"), F.lit(None).cast("double").alias("ele"))
    halves = mid.select("area_id", F.col("src").alias("u"), F.col("m").alias("v"), (F.col("len") / 2).alias("len")).unionByName(mid.select("area_id", F.col("m").alias("u"), F.col("dst").alias("v"), (F.col("len") / 2).alias("len")))
    a = plan(nodes, edges, request(spark)).stats.first()
    p = plan(nodes.unionByName(more), graph.undirected(halves), request(spark))
    b = p.stats.first()
    assert missed(p) == 0 and (a.covered_mi, a.bare_mi, a.overhead_pct) == (b.covered_mi, b.bare_mi, b.overhead_pct) and b.segments == 2 * a.segments


def test_all_components_on_request(spark):
    nodes, edges = graph.make_graph(spark, [(n, 40 + k / 100, -74.0) for k, n in enumerate("abcxy")], [("a", "b", 100), ("b", "c", 100), ("x", "y", 100)])
    assert plan(nodes, edges, request(spark, "g")).stats.first().segments == 2
    whole = plan(nodes, edges, request(spark, "g"), all_components=True)
    assert whole.stats.first().segments == 3 and missed(whole) == 0


def test_contracted_edges_list_the_nodes_between(spark):
    _, edges = graph.make_graph(spark, [], [("a", "x", 30), ("x", "b", 70), ("a", "c", 1), ("a", "d", 1), ("b", "e", 1), ("b", "f", 1)])
    rows = {(r.src, r.dst): (r.len, r.via) for r in areas.contracted(edges).collect()}
    assert rows["a", "b"] == (100.0, ["x"])


def test_split_as_an_expression(spark):
    steps = spark.createDataFrame([("k", p, d) for p, d in enumerate([50.0, 50.0, 1.0, 200.0, 5.0])], "key string, pos int, len double")
    got = runs.split_runs(steps, ["key"], "pos", "len", 100.0).orderBy("pos")
    assert [r.run for r in got.collect()] == [0, 0, 1, 2, 3]


def test_two_ways_to_components(spark):
    _, edges = city.grid(spark, 9, 9, holes=[(0, 9, 4, 5), (4, 5, 0, 9)])
    labels = graph.components(edges)
    assert labels.select("component").distinct().count() == 4
    reach = areas.distances_from(edges, labels.select("area_id", F.col("component").alias("source")).distinct())
    assert labels.join(reach, (reach.id == labels.id) & (reach.source == labels.component)).count() == labels.count()


def test_each_request_is_solved_once(spark, tmp_path, monkeypatch):
    """Whatever is read of the plan; requests of one area share a call."""
    nodes, edges = city.grid(spark, 6, 5, 0.2, 0.3)
    mark = str(tmp_path / "calls")
    solve = route_plan._solve

    def counted(rows, places):
        with open(mark, "a") as f:
            f.write(" ".join(rows["request_id"].dropna()) + "\n")
        return solve(rows, places)

    monkeypatch.setattr(route_plan, "_solve", counted)
    asks = spark.createDataFrame([(f"q{k:02}", "grid", (3 + k) * MI, 40.70, -74.02, k % 2 == 1, None) for k in range(11)], schemas.REQUESTS)
    p = plan(nodes, edges, asks)
    for table in (p.walk, p.runs, p.stats, p.full):
        assert table.count() > 0
    assert p.stats.where("n_runs > 0 and covered_mi >= bare_mi").count() == 11
    calls = open(mark).read()
    assert len(calls.splitlines()) == 2 and sorted(calls.split()) == [f"q{k:02}" for k in range(11)]


def first_point(p):
    return p.walk.orderBy("run_id", "pos").first().a


def test_first_run_leaves_from_the_anchor_of_another_zone(spark):
    """No street of the start, node 21, is in the zone whose centre is nearest."""
    name = lambda r, c: str(37 * (10 * r + c) % 100)
    at = lambda r, c: (40.70 + r * 0.0036, -74.02 + c * 0.0052)
    cells = [(r, c) for r in range(10) for c in range(10)]
    links = [(name(r, c), name(r, c + 1), 0.27 * MI) for r, c in cells if c < 9] + [(name(r, c), name(r + 1, c), 0.25 * MI) for r, c in cells if r < 9]
    nodes, edges = graph.make_graph(spark, [(name(*x), *at(*x)) for x in cells], links)
    p = plan(nodes, edges, request(spark, "g", 1.5 * MI, *at(3, 3), cluster=True))
    assert first_point(p) == "21" and missed(p) == 0 and p.stats.first().zones == 5


def test_first_run_leaves_from_the_anchor_of_a_later_piece(spark):
    nodes, edges = graph.make_graph(spark, [(n, 40 + k / 100, -74.0) for k, n in enumerate("abcxy")], [("a", "b", 100), ("b", "c", 100), ("x", "y", 100)])
    p = plan(nodes, edges, request(spark, "g", lat=40.04, lon=-74.0), all_components=True)
    assert first_point(p) == "y" and missed(p) == 0
