"""Responses, filters, look-ups, cache, cooldown, scalar functions."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lanewright.functions import scalar as S
from lanewright.operators import cache, graph, runs
from lanewright.sources import gpx, osm
from lanewright.streaming import gate


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def response(spark, tmp_path, elements, area="g"):
    (tmp_path / "r.json").write_text(json.dumps({"area_id": area, "elements": elements}) + "\n{broken\n")
    return osm.elements(osm.read_responses(spark, str(tmp_path / "r.json")))


def node(i, lat, lon):
    return {"type": "node", "id": i, "lat": lat, "lon": lon}


def test_grid_response(spark, tmp_path):
    nodes = [node(r * 3 + c + 1, 40 + r * 0.01, -74 + c * 0.01) for r in range(3) for c in range(3)]
    ways = [{"type": "way", "id": 100 + r, "nodes": [r * 3 + 1, r * 3 + 2, r * 3 + 3]} for r in range(3)] + [{"type": "way", "id": 200 + c, "nodes": [c + 1, c + 4, c + 7]} for c in range(3)]
    items = response(spark, tmp_path, nodes + ways)
    assert osm.nodes_of(items).count() == 9 and graph.edges_from_ways(osm.nodes_of(items), osm.ways_of(items)).count() == 12


def test_missing_references_leave_a_gap(spark, tmp_path):
    items = response(spark, tmp_path, [node(1, 40, -74), node(2, 40.01, -74), node(3, 40.02, -74), node(1, 40.005, -74), {"type": "way", "nodes": [1, 2, 999, 3]}, {"type": "way", "nodes": [2]}, {"type": "relation"}])
    nodes, ways = osm.nodes_of(items), osm.ways_of(items)
    edges = graph.edges_from_ways(nodes, ways).collect()
    assert [(e.src, e.dst) for e in edges] == [("1", "2")] and nodes.where("id = '1'").first().lat == 40.005
    assert [r.id for r in graph.missing_refs(nodes, ways).collect()] == ["999"]


@pytest.mark.parametrize("tags,nets", [
    ({"highway": "residential"}, {"walk", "drive", "bike"}), ({"highway": "footway"}, {"walk"}), ({"highway": "motorway"}, {"drive"}), ({"highway": "steps", "foot": "unknown"}, set()),
    ({"highway": "path", "bicycle": "no"}, {"walk"}), ({}, set()), ({"highway": "trunk_link"}, {"drive", "bike"}), ({"highway": "service", "foot": "no"}, {"drive", "bike"}),
])
def test_networks(spark, tags, nets):
    row = spark.createDataFrame([(tags,)], "tags map<string,string>")
    got = {n for n in ("walk", "drive", "bike") if row.where(osm.in_network(n)).count()}
    assert got == nets and (row.where(osm.in_network("boat")).count() == 1) == ("walk" in nets)


def test_endpoints(spark):
    rows = [("a", 0, "x", 503, 0), ("a", 1, "y", 200, 5), ("b", 0, "x", 400, 0), ("b", 1, "y", 200, 5), ("c", 0, "x", 200, 0), ("c", 1, "y", 200, 0), ("d", 0, "x", None, 0), ("d", 1, "y", 429, 0), ("e", 0, "x", 200, 3), ("e", 1, "y", 500, 0)]
    got = {r.request_id: (r.endpoint, r.tries, r.message) for r in osm.choose_endpoint(spark.createDataFrame(rows, "request_id string, ord int, endpoint string, status int, n_elements int")).collect()}
    assert got["a"] == ("y", 2, None) and got["b"] == (None, 1, "the query was rejected") and got["c"] == ("y", 2, None) and got["e"][:2] == ("x", 1)
    assert got["d"][:2] == (None, 2) and "rate limited" in got["d"][2]


def test_addresses(spark):
    names = spark.createDataFrame([("Main  St 1", 1.0, 2.0, 2), ("main st 1", 3.0, 4.0, 1)], "name string, lat double, lon double, ord int")
    got = osm.geocode(spark.createDataFrame([(" MAIN\tst 1 ",), ("else",)], "q string"), names).collect()
    assert {(r.q, r.lat, r.found) for r in got} == {(" MAIN\tst 1 ", 3.0, True), ("else", None, False)}


def test_elevation_is_all_or_nothing(spark):
    nodes = spark.createDataFrame([(a, f"{k:04}", 1.0, 1.0, None) for a in "ab" for k in range(600)], "area_id string, id string, lat double, lon double, ele double")
    heights = spark.createDataFrame([(a, k // 500, k % 500, float(k)) for a in "ab" for k in range(600) if a == "a" or k < 500], "area_id string, batch int, place int, ele double")
    got = osm.with_elevation(nodes, heights)
    assert got.where("area_id = 'a' and ele = cast(id as double)").count() == 600 and got.where("area_id = 'b' and ele is not null").count() == 0


def test_small_encoding_is_lossless(spark, tmp_path):
    nodes = [node(10**9 + k * 7 % 31, round(40.7 + k * 0.0012345, 7), round(-74.1 - k * 0.0054321, 7)) for k in range(12)]
    ways = [{"type": "way", "nodes": [n["id"] for n in nodes[k : k + 4]], "tags": {"highway": "x"}} for k in (0, 5)]
    items = response(spark, tmp_path, ways[:1] + nodes[::-1] + ways[1:])
    back = cache.expand(cache.slim(items)).orderBy("pos").collect()
    assert [(r.id, r.lat, r.lon) for r in back if r.type == "node"] == [(n["id"], n["lat"], n["lon"]) for n in sorted(nodes, key=lambda n: n["id"])]
    assert [r.nodes for r in back if r.type == "way"] == [w["nodes"] for w in ways]


def test_keys(spark):
    assert one(spark, S.area_key(F.lit("walk"), F.lit(1931.2), F.lit(48.1370061), F.lit(11.5754949))) == ("walk|1931|48.1370|11.5755",)
    assert one(spark, S.address_key(F.lit("\u3000 12\t Upper \n\x0b ROW\ufeff  "))) == ("12 upper row",)


@pytest.mark.parametrize("now,last,left", [(5000, None, 0), (1000, 1000, 60000), (31000, 1000, 30000), (61000, 1000, 0), (99000, 1000, 0)])
def test_cooldown(spark, now, last, left):
    assert one(spark, S.cooldown_left(F.lit(now), F.lit(last).cast("bigint"))) == (left,)


def test_store():
    s = cache.Store(100, ttl_ms=500, most=60)
    assert s.put("A", 30, 1000) == (True, []) and s.put("B", 30, 1001) == (True, []) and s.put("C", 30, 1002) == (True, [])
    assert s.get("A", 1400) and s.peek("B", 1400)
    assert s.put("D", 30, 1401) == (True, ["B"]) and not s.peek("B", 1402)
    assert s.peek("A", 1500) and not s.peek("A", 1501) and not s.get("A", 1501) and "A" not in s.records
    assert s.put("D", 61, 1402) == (False, []) and "D" in s.records
    assert s.put("E", 60, 1403)[0] and cache.Store(10).put("F", 20, 0) == (False, [])


def test_replay(spark):
    rows = [("n", 1, "put", "A", 30, 0), ("n", 2, "put", "B", 30, 1), ("n", 3, "get", "A", 0, 2), ("n", 4, "put", "D", 60, 3), ("n", 5, "get", "B", 0, 4), ("m", 1, "get", "A", 0, 5)]
    got = {(r.namespace, r.seq): (r.ok, r.evicted) for r in cache.replay(spark.createDataFrame(rows, "namespace string, seq long, op string, key string, size long, at long"), 100).collect()}
    assert got["n", 4] == (True, ["B"]) and got["n", 5] == (False, []) and got["m", 1] == (False, [])


def test_age_limit(spark):
    puts = spark.createDataFrame([("k", 1000)], "key string, t long")
    asks = spark.createDataFrame([("k", 1400), ("k", 1500), ("k", 1501), ("k", 999), ("x", 1400)], "key string, now long")
    assert {(r.key, r.now): r.hit for r in cache.peek(asks, puts, 500).collect()} == {("k", 1400): True, ("k", 1500): True, ("k", 1501): False, ("k", 999): False, ("x", 1400): False}


def test_streams_agree_with_tables(spark, tmp_path):
    rows = [(f"u{k % 3}", k, k * 700 % 9000, "put" if k % 4 == 0 else "get") for k in range(60)]
    events = spark.createDataFrame(rows, "key string, seq long, at long, op string")
    events.write.parquet(str(tmp_path / "in"))

    def run(make, name):
        stream = make(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    got = run(lambda s: gate.cooldown_stream(s.select("key", "seq", "at"), 2000), "gate")
    want = cache.cooldown_gate(events.select("key", "seq", "at"), ["key"], 2000)
    assert sorted((r.key, r.seq, r.accepted) for r in got.collect()) == sorted((r.key, r.seq, r.accepted) for r in want.collect())
    hits = {(r.key, r.seq): r.hit for r in run(lambda s: gate.ttl_stream(s, 1500), "hits").collect()}
    for key, seq, at, op in rows:
        puts = [(a, q) for k, q, a, o in rows if k == key and o == "put" and (a, q) <= (at, seq)]
        assert op == "put" or hits[key, seq] == (bool(puts) and at - max(puts)[0] <= 1500)


def test_scalars(spark):
    assert one(spark, S.half_up(F.lit(-2.5)).cast("int"), S.half_up(F.lit(2.5)).cast("int")) == (-2, 3)
    assert (S.exact_fixed(1.005, 2), S.exact_fixed(2.5, 0), S.exact_fixed(-2.5, 0), S.exact_fixed(None, 1)) == (1.0, 3.0, -3.0, None)
    assert one(spark, S.xml_escape(F.lit("'Salt' & <Pepper> \"lane\""))) == ("&apos;Salt&apos; &amp; &lt;Pepper&gt; &quot;lane&quot;",)
    assert one(spark, S.number_text(F.lit(-74.0)), S.number_text(F.lit(0.0001)), S.number_text(F.lit(40.728498))) == ("-74", "0.0001", "40.728498")
    assert one(spark, S.uri_component(F.lit("a b&c=é(1)*"))) == ("a%20b%26c%3D%C3%A9(1)*",)
    assert one(spark, S.from_fixed7(S.to_fixed7(F.lit(40.1234567))), S.color(F.lit(1), F.lit(4))) == (40.1234567, "hsl(90,70%,62%)")
    assert one(spark, S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0] == pytest.approx(111194.93, abs=0.01)


def test_track_text(spark):
    coords = F.array(F.struct(F.lit(40.5).alias("lat"), F.lit(-74.0).alias("lon"), F.lit(None).cast("double").alias("ele")), F.struct(F.lit(40.6).alias("lat"), F.lit(-74.25).alias("lon"), F.lit(12.5).alias("ele")))
    text = one(spark, gpx.track(coords, F.lit("A & B")))[0]
    assert text.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1"') and text.endswith("\n  </trkseg></trk>\n</gpx>")
    assert "<name>A &amp; B</name>" in text and '      <trkpt lat="40.5" lon="-74"></trkpt>\n      <trkpt lat="40.6" lon="-74.25"><ele>12.5</ele></trkpt>' in text


def test_area_scan(spark):
    nodes = spark.createDataFrame([("g", "a", 40.0, -74.0), ("g", "b", 40.001, -74.0), ("g", "c", 41.0, -74.0), ("g", "d", 42.0, -74.0)], "area_id string, id string, lat double, lon double")
    ways = spark.createDataFrame([("g", 1, ["b", "c"], {"highway": "path"}), ("g", 2, ["c", "d"], {"highway": "path"}), ("g", 3, ["a", "b"], {"highway": "trunk"})], "area_id string, pos int, refs array<string>, tags map<string,string>")
    n, w = osm.area_scan(nodes, ways, 40.0, -74.0, 500)
    assert [r.pos for r in w.collect()] == [1] and sorted(r.id for r in n.collect()) == ["b", "c"]


def test_area_scan_sees_streets_that_pass_through(spark):
    """A long street between two nodes out of reach, also across 180 degrees."""
    for lon in (10.0, 179.9995):
        wrap = lambda x: (x + 540) % 360 - 180
        places = [("a", 0.001, lon - 0.02), ("b", 0.001, lon + 0.02), ("c", 0.05, lon), ("d", 0.06, lon), ("e", 0.0, lon + 0.001), ("f", 0.05, lon + 0.03)]
        nodes = spark.createDataFrame([("g", i, y, wrap(x), None) for i, y, x in places], "area_id string, id string, lat double, lon double, ele double")
        ways = spark.createDataFrame([("g", 1, ["a", "b"], {"highway": "residential"}), ("g", 2, ["c", "d"], {"highway": "residential"}), ("g", 3, ["e", "f"], {"highway": "residential"})], "area_id string, pos int, refs array<string>, tags map<string,string>")
        found, kept = osm.area_scan(nodes, ways, 0.0, wrap(lon), 500)
        assert {r.pos for r in kept.collect()} == {1, 3} and {r.id for r in found.collect()} == {"a", "b", "e", "f"}


def test_written_tracks(spark, tmp_path):
    point = lambda y: (y, -74.0, None)
    table = spark.createDataFrame([(q, r, [point(40.0 + r), point(41.0)]) for q in ("q1", "q2") for r in (1, 2)], "request_id string, run_id int, coords array<struct<lat:double,lon:double,ele:double>>")
    gpx.write_tracks(table, str(tmp_path / "gpx"), "Walk ")
    files = {p.relative_to(tmp_path / "gpx").parts[:2]: p.read_text() for p in (tmp_path / "gpx").rglob("*.txt")}
    assert set(files) == {(f"request_id={q}", f"run_id={r}") for q in ("q1", "q2") for r in (1, 2)}
    want = {(r.request_id, r.run_id): r.gpx for r in gpx.tracks(table, "Walk ").collect()}
    assert all(files[f"request_id={q}", f"run_id={r}"] == t + "\n" for (q, r), t in want.items())


def test_saved_plan(spark, tmp_path):
    (tmp_path / "plan.json").write_text('{"center": [1.5, 2.5],\n "runs": [{"id": 1, "length_mi": 2.0, "zone": 0, "color": "red", "coords": [[1.0, 2.0], [1.5, 2.0]]}],\n "stats": {"n_runs": 1, "zones": 1}}')
    r = osm.read_demo(spark, str(tmp_path / "plan.json")).first()
    assert r.center == [1.5, 2.5] and r.runs[0].coords == [[1.0, 2.0], [1.5, 2.0]] and (r.stats.n_runs, r.stats.bare_mi) == (1, None)


def test_store_with_a_failing_medium():
    """A write that raises makes older records go; with none left the put fails."""
    held, room = {}, [2]

    def write(key, value):
        if len(held) >= room[0]:
            raise OSError("no space")
        held[key] = value

    def remove(key):
        held.pop(key, None)
        raise OSError("not now")

    s = cache.Store(1000, write=write, remove=remove)
    assert s.put("A", 1, 0, "a") == (True, []) and s.put("B", 1, 1, "b") == (True, []) and s.get("A", 2)
    assert s.put("C", 1, 3, "c") == (True, ["B"]) and set(held) == {"A", "C"} == set(s.records) and s.used == 4
    room[0] = 0
    assert s.put("D", 1, 4) == (False, ["A", "C"]) and not s.records and s.used == 0 and not held


def test_long_keys_take_time_in_proportion(spark):
    """One key of many rows: cut into runs, and gated, in one pass."""
    n = 100_000
    rows = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("pos"), F.lit(1.0).alias("len"), F.col("id").alias("seq"), (F.col("id") * 10).alias("at"))
    t = time.time()
    assert runs.split_runs(rows.select("key", "pos", "len"), ["key"], "pos", "len", 10.0).where(F.col("run") != F.floor(F.col("pos") / 10)).count() == 0
    gated = cache.cooldown_gate(rows.select("key", "seq", "at"), ["key"], 30)
    assert gated.where("accepted").count() == -(-n // 3) and time.time() - t < 30
