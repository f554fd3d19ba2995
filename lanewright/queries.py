"""Registered queries over the fixture city and the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright import schemas
from lanewright.functions import scalar as S
from lanewright.operators import areas, cache, graph, runs, wide
from lanewright.plans import route_plan
from lanewright.scratch import scratch_dir
from lanewright.sources import city, gpx, osm
from lanewright.streaming import gate

#: A point within every block, and the plan's cap: five miles.
LAT, LON, CAP_M, RADIUS_M = 40.7345, -73.9712, 8046.72, 1500.0
HOURS_6 = 6 * 3600 * 1000


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _city(spark, sf):
    return city.city_nodes(spark, sf), city.city_edges(spark, sf)


def _r6(c):
    return S.rounded(c, 6)


def _r3(c):
    return S.rounded(c, 3)


def city_nodes(spark, sf):
    return city.city_nodes(spark, sf)


def city_ways(spark, sf):
    return city.city_ways(spark, sf).select("area_id", "way_id", F.array_join("refs", ",").alias("refs"), F.element_at("tags", "highway").alias("highway"), F.element_at("tags", "foot").alias("foot"), F.element_at("tags", "bicycle").alias("bicycle"))


def way_segments(spark, sf):
    return graph.segments(city.city_ways(spark, sf)).select("area_id", "way_id", "pos", "u", "v")


def dangling_refs(spark, sf):
    return graph.missing_refs(city.city_nodes(spark, sf), city.city_ways(spark, sf)).select("area_id", "way_id", "id")


def edge_dedup_min(spark, sf):
    """Co-purchase links: customers and dates as ends, the least price as length."""
    o = _t(spark, sf, "orders").select(F.lit("o").alias("area_id"), F.col("o_custkey").cast("string").alias("u"), (F.col("o_orderkey") % 97).cast("string").alias("v"), F.col("o_totalprice").alias("len"))
    return graph.undirected(o)


def haversine_lengths(spark, sf):
    return city.city_edges(spark, sf).select("area_id", "src", "dst", _r6("len").alias("len"))


def node_degree(spark, sf):
    return graph.degrees(city.city_edges(spark, sf))


def odd_nodes(spark, sf):
    return graph.odd_nodes(city.city_edges(spark, sf)).select("area_id", "id")


def bare_length(spark, sf):
    return graph.total_length(city.city_edges(spark, sf)).select("area_id", _r3("bare_m").alias("bare_m"))


def graph_shape(spark, sf):
    return graph.shape(city.city_edges(spark, sf)).select("area_id", "nodes", "edges", _r3("total").alias("total"))


def nearest_node(spark, sf):
    nodes = city.city_nodes(spark, sf)
    points = nodes.select("area_id").distinct().select("area_id", F.lit(LAT).alias("lat"), F.lit(LON).alias("lon"))
    return graph.nearest_node(nodes, points).select("area_id", "id", S.rounded("d2", 9).alias("d2"))


def _filter(net):
    def query(spark, sf):
        return city.city_ways(spark, sf).where(osm.in_network(net)).select("area_id", "way_id")

    return query


def radius_ways(spark, sf):
    ways = city.city_ways(spark, sf).withColumn("pos", F.col("way_id"))
    nodes, kept = osm.area_scan(city.city_nodes(spark, sf), ways, LAT, LON, RADIUS_M)
    return kept.select("area_id", F.col("way_id").alias("id"), F.lit("way").alias("kind")).unionByName(nodes.select("area_id", "id", F.lit("node").alias("kind")))


def element_filter(spark, sf):
    items = osm.elements(_responses(spark, sf))
    return items.groupBy("area_id", "type").agg(F.count("*").alias("n"))


def _responses(spark, sf):
    """The city as map responses: one JSON text an area, parsed again."""
    nodes = city.city_nodes(spark, sf).select("area_id", F.struct(F.lit("node").alias("type"), F.col("id").cast("bigint").alias("id"), "lat", "lon", F.lit(None).cast("array<bigint>").alias("nodes")).alias("e"), F.concat(F.lit("0"), F.lpad("id", 9, "0")).alias("k"))
    ways = city.city_ways(spark, sf).select("area_id", F.struct(F.lit("way").alias("type"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.col("refs").cast("array<bigint>").alias("nodes")).alias("e"), F.concat(F.lit("1"), "way_id").alias("k"))
    both = nodes.unionByName(ways).groupBy("area_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]).alias("elements"))
    text = both.select("area_id", F.to_json(F.struct("elements")).alias("json"))
    return text.select("area_id", F.from_json("json", schemas.RESPONSE).alias("data"))


def osm_parse(spark, sf):
    """JSON responses to edges, through the parser."""
    items = osm.elements(_responses(spark, sf))
    edges = graph.edges_from_ways(osm.nodes_of(items), osm.ways_of(items))
    return edges.select("area_id", "src", "dst", _r6("len").alias("len"))


def components(spark, sf):
    return graph.components(city.city_edges(spark, sf))


def components_wide(spark, sf):
    """The same labels by rounds of joins, for areas too large for one task."""
    return wide.components(city.city_edges(spark, sf))


def largest_component(spark, sf):
    return graph.largest_component(city.city_edges(spark, sf))


def junctions(spark, sf):
    return graph.degrees(city.city_edges(spark, sf)).where(graph.is_junction()).select("area_id", "id")


def _rings(spark, sf):
    """A ring of three to six nodes for each nation, an area for each region;
    every third ring has a tail, and every fifth a chord."""
    n = _t(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("area_id"), F.col("n_nationkey").alias("n"), (3 + F.col("n_nationkey") % 4).alias("m"))
    name = lambda i: F.concat(F.lit("n"), F.col("n").cast("string"), F.lit("_"), i.cast("string"))
    ring = n.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i")).select("area_id", name(F.col("i")).alias("u"), name((F.col("i") + 1) % F.col("m")).alias("v"))
    tail = n.where("n % 3 = 0").select("area_id", name(F.lit(0)).alias("u"), name(F.lit("t")).alias("v"))
    chord = n.where("n % 5 = 0 and m > 3").select("area_id", name(F.lit(0)).alias("u"), name(F.lit(2)).alias("v"))
    return graph.undirected(ring.unionByName(tail).unionByName(chord).withColumn("len", F.lit(1.0)))


def isolated_loops(spark, sf):
    return graph.isolated_loops(_rings(spark, sf))


def csr_arrays(spark, sf):
    c = graph.csr(city.city_edges(spark, sf))
    return c.select("area_id", "id", F.col("number").cast("bigint").alias("number"), F.col("first").cast("bigint").alias("first"), F.array_join(F.col("near").cast("array<string>"), ",").alias("near"), F.array_join(F.transform("len", lambda d: S.rounded(d, 0).cast("bigint").cast("string")), ",").alias("len"))


def multigraph(spark, sf):
    """Each street once, and once more for each way that passes it."""
    extra = graph.segments(city.city_ways(spark, sf)).select("area_id", F.col("u").alias("a"), F.col("v").alias("b"))
    return graph.multigraph(city.city_edges(spark, sf), extra).select("area_id", "src", "dst", _r6("len").alias("len"), F.col("mult").cast("bigint").alias("mult"))


def nearest_target(spark, sf):
    """From the corner of each largest component to the nearest odd node whose
    id ends in 7."""
    edges = city.city_edges(spark, sf)
    targets = graph.odd_nodes(edges).where(F.col("id").endswith("7")).groupBy("area_id").agg(F.collect_set("id").alias("targets"))
    start = graph.largest_component(edges).select("area_id", F.col("component").alias("source"))
    return areas.nearest_target(edges, start.join(targets, "area_id")).select("area_id", "source", "target", _r3("dist").alias("dist"))


def subgraph(spark, sf):
    nodes, edges = _city(spark, sf)
    return graph.subgraph(edges, nodes.where(F.col("lon") < -73.96)).select("area_id", "src", "dst", _r6("len").alias("len"))


def sssp_corner(spark, sf):
    _, edges = _city(spark, sf)
    start = graph.largest_component(edges).select("area_id", F.col("component").alias("source"))
    return areas.distances_from(edges, start).select("area_id", "source", "id", _r3("dist").alias("dist"))


def shortest_paths(spark, sf):
    """The path between the ends of each largest component, node by node."""
    _, edges = _city(spark, sf)
    labels = graph.components(edges)
    ends = labels.join(graph.largest_component(edges, labels).select("area_id", "component"), ["area_id", "component"]).groupBy("area_id").agg(F.min("id").alias("source"), F.max("id").alias("target"))
    return areas.paths(edges, ends).select("area_id", "source", "target", _r3("dist").alias("dist"), F.array_join("path", ",").alias("path"))


def odd_distances(spark, sf):
    """Out of the area of the most odd nodes: distances between them, summed."""
    d = areas.odd_distances(graph.keep_largest(city.city_edges(spark, sf)))
    return d.select("area_id", "id", "reached", _r3("nearest").alias("nearest"), _r3("farthest").alias("farthest"))


def nearest_odd(spark, sf):
    d = areas.nearest_odd(graph.keep_largest(city.city_edges(spark, sf)), 2)
    return d.select("area_id", "id", "rank", "other", _r3("dist").alias("dist"))


def seeds_lon(spark, sf):
    nodes = city.city_nodes(spark, sf)
    w = Window.partitionBy("area_id")
    at = nodes.select("area_id", "id", (F.row_number().over(w.orderBy("lon", "id")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    picks = at.select("area_id", "id", "k", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seed"))
    return picks.where(F.col("k") == F.floor(F.col("seed") * (F.col("n") - 1) / 3)).select("area_id", "seed", "id")


def kmeans_zones(spark, sf):
    """The k-means zone of every node."""
    return areas.clusters(city.city_nodes(spark, sf), 4).select("area_id", "id", "zone")


def _near_seed(spark, sf):
    """(area_id, id, zone): the nearest of three fixed centres, in plain degrees."""
    centres = [(0, 40.715, -74.0), (1, 40.735, -73.97), (2, 40.755, -73.93)]
    return graph.nearest_centroid(city.city_nodes(spark, sf), centres).select("area_id", "id", "zone")


def nearest_centroid(spark, sf):
    return _near_seed(spark, sf)


def edge_zone(spark, sf):
    return graph.edge_zones(city.city_edges(spark, sf), _near_seed(spark, sf)).select("area_id", "src", "dst", "zone")


def _centres(spark, sf):
    zone_edges = edge_zone(spark, sf)
    touched = zone_edges.select("area_id", "zone", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return touched.join(city.city_nodes(spark, sf), ["area_id", "id"]).groupBy("area_id", "zone").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def zone_center(spark, sf):
    return _centres(spark, sf).select("area_id", "zone", _r6("lat").alias("lat"), _r6("lon").alias("lon"))


def zone_order(spark, sf):
    d = S.haversine(F.lit(LAT), F.lit(LON), "lat", "lon")
    return _centres(spark, sf).select("area_id", "zone", F.row_number().over(Window.partitionBy("area_id").orderBy(d, "zone")).alias("place"))


def zone_count(spark, sf):
    bare = graph.total_length(city.city_edges(spark, sf))
    return bare.select("area_id", F.greatest(F.lit(1).cast("bigint"), S.half_up(F.col("bare_m") / (6 * CAP_M)).cast("bigint")).alias("zones"))


def cut_edges(spark, sf):
    return graph.cut_edges(city.city_edges(spark, sf), _near_seed(spark, sf))


def bfs_partition(spark, sf):
    """Every node in reach goes with its seed, however many steps away; the SQL
    follows 60 of them and takes what lies beyond as out of reach."""
    nodes, edges = _city(spark, sf)
    return areas.grown_zones(edges, nodes, 3)


def mincut_zones(spark, sf):
    nodes, edges = _city(spark, sf)
    return graph.cut_edges(edges, areas.settled_zones(edges, nodes, 3))


def split_runs(spark, sf):
    """Orders of each customer, cut where their prices would pass 500,000."""
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return runs.split_runs(o, ["o_custkey"], "o_orderkey", "o_totalprice", 500000.0).select("o_custkey", "o_orderkey", "run")


def _lines(spark, sf):
    """Each way as a run over its open nodes."""
    refs = city.city_ways(spark, sf).select("area_id", "way_id", F.posexplode("refs").alias("pos", "id"))
    return refs.join(city.city_nodes(spark, sf), ["area_id", "id"])


def run_elevation(spark, sf):
    return runs.climbs(_lines(spark, sf), ["area_id", "way_id"])


def total_climb(spark, sf):
    """Sums over the climbs of an area, which are rounded already."""
    return run_elevation(spark, sf).groupBy("area_id").agg(F.sum("elev_gain_m").alias("total_gain_m"), F.sum("elev_loss_m").alias("total_loss_m"))


def gpx_export(spark, sf):
    lines = _lines(spark, sf).groupBy("area_id", "way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon", "ele"))), lambda p: F.struct(S.rounded(p["lat"], 6).alias("lat"), S.rounded(p["lon"], 6).alias("lon"), S.rounded(p["ele"], 2).alias("ele"))).alias("coords"))
    return lines.select("area_id", "way_id", gpx.track(F.col("coords"), F.concat(F.lit('North & "South" < '), F.col("way_id"))).alias("gpx"))


def bounding_box(spark, sf):
    """The box of each area, padded by a tenth on every side."""
    b = city.city_nodes(spark, sf).groupBy("area_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    pad = lambda c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * 0.1
    return b.select("area_id", *[_r6(F.col(f"{n}_{c}") + s * pad(c)).alias(f"{c}_{n}") for c in ("lat", "lon") for n, s in (("lo", -1), ("hi", 1))])


def xml_escape(spark, sf):
    return _t(spark, sf, "pages").select("page_id", S.xml_escape("html").alias("escaped"))


def uri_encode(spark, sf):
    return _t(spark, sf, "pages").select("page_id", S.uri_component("url").alias("encoded"))


def overpass_key(spark, sf):
    return city.city_nodes(spark, sf).select("area_id", "id", S.area_key(F.lit("walk"), F.col("id").cast("double") + 0.25, F.col("lat") + 0.00001, F.col("lon") - 0.00001).alias("key"))


def geocode_key(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", S.address_key("text").alias("key"))


def geocode_lookup(spark, sf):
    c = _t(spark, sf, "customer")
    gazetteer = _t(spark, sf, "supplier").select(F.regexp_replace("s_name", "Supplier", "Customer").alias("name"), F.col("s_acctbal").alias("lat"), F.col("s_nationkey").cast("double").alias("lon"), F.col("s_suppkey").alias("ord"))
    return osm.geocode(c.select("c_custkey", F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("q")), gazetteer).select("c_custkey", "lat", "lon", "found")


def _slimmed(spark, sf):
    return cache.slim(osm.elements(_responses(spark, sf)))


def slim_encode(spark, sf):
    j = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _slimmed(spark, sf).select("area_id", "v", j("i"), j("a"), j("o"), F.size("w").cast("bigint").alias("ways"))


def slim_expand(spark, sf):
    return cache.expand(_slimmed(spark, sf)).where("type = 'node'").select("area_id", F.col("id").cast("string").alias("id"), S.rounded("lat", 7).alias("lat"), S.rounded("lon", 7).alias("lon"))


def _events(spark, sf):
    e = _t(spark, sf, "events")
    return e.select(F.col("user_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value")


def cooldown_gate(spark, sf):
    return cache.cooldown_gate(_events(spark, sf), ["user_id"], HOURS_6).select("user_id", "seq", "accepted")


def cooldown_left(spark, sf):
    w = Window.partitionBy("user_id").orderBy("at", "seq")
    e = _events(spark, sf).withColumn("last", F.lag("at").over(w))
    left = S.cooldown_left("at", "last", HOURS_6)
    return e.select("user_id", "seq", left.alias("left_ms"), S.seconds_up(left).alias("left_s"))


def ttl_hits(spark, sf):
    """Views look for the user's newest purchase within three days."""
    e = _events(spark, sf)
    kinds = F.col("event_type").isin("purchase", "signup")
    asks = e.where(~kinds).select("seq", F.col("user_id").alias("key"), F.col("at").alias("now"))
    return cache.peek(asks, e.where(kinds).select(F.col("user_id").alias("key"), F.col("at").alias("t")), 3 * 24 * 3600 * 1000).select("seq", "hit")


def lru_order(spark, sf):
    e = _events(spark, sf).select((F.col("user_id") % 10).alias("store"), F.col("user_id").alias("key"), "at", "seq")
    return cache.recency(e, ["store"])


def _cache_events(spark, sf):
    e = _events(spark, sf)
    op = F.when(F.col("event_type").isin("purchase", "signup"), "put").when(F.col("seq") % 17 == 0, "drop").when(F.col("seq") % 5 == 0, "peek").otherwise("get")
    return e.select((F.col("user_id") % 8).cast("string").alias("namespace"), F.row_number().over(Window.partitionBy(F.col("user_id") % 8).orderBy("at", "seq")).cast("bigint").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), (F.abs("value") * 10 + 10).cast("bigint").alias("size"), "at")


def cache_replay(spark, sf):
    """A limited store under puts, gets, peeks and drops, by namespace."""
    return cache.replay(_cache_events(spark, sf), 6000, 3 * 24 * 3600 * 1000, 4000).select("namespace", "seq", "op", "key", "ok", F.array_join("evicted", ",").alias("evicted"))


def would_use_network(spark, sf):
    e = _events(spark, sf)
    asks = e.where("event_type = 'view' or event_type = 'click'").select("seq", (F.col("seq") % 11 == 0).alias("demo"), F.col("user_id").alias("key"), F.col("at").alias("now"), F.lit(1931.2).alias("radius_m"), F.lit("walk").alias("net"))
    puts = e.groupBy("user_id").agg(F.max("at").alias("t"))
    places = puts.select(F.col("user_id").alias("key"), "t", (40.0 + F.col("user_id") % 50 * 0.25).alias("lat"), (-74.0 + F.col("user_id") % 3 * 0.5).alias("lon"))
    known = places.where("key % 4 <> 0").groupBy(S.area_key(F.lit("walk"), F.lit(1931.2), "lat", "lon").alias("key")).agg(F.max("t").alias("t"))
    return cache.would_use_network(asks, places, known, 5 * 24 * 3600 * 1000).select("seq", "network")


def _attempts(spark, sf):
    """Each order as a request of up to three tries, with made-up answers."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"))
    n = (F.col("o_orderkey") * 7 + F.col("ord") * 5) % 9
    status = F.when(n < 3, 200).when(n == 3, 429).when(n == 4, 503).when(n == 5, 400).when(n == 6, 500).when(n == 7, 404)
    return o.select(F.col("o_orderkey").alias("request_id"), "ord", F.concat(F.lit("mirror"), F.col("ord").cast("string")).alias("endpoint"), status.cast("int").alias("status"), F.when(n == 0, 0).otherwise(10).alias("n_elements"))


def failover_choice(spark, sf):
    return osm.choose_endpoint(_attempts(spark, sf))


def status_message(spark, sf):
    return _attempts(spark, sf).where("status is not null").select("request_id", "ord", osm.status_message(F.col("status")).alias("message"))


def elevation_lookup(spark, sf):
    """Elevations from positional batches; the last area misses one of them."""
    nodes = city.city_nodes(spark, sf)
    w = Window.partitionBy("area_id").orderBy("id")
    n = F.row_number().over(w) - 1
    heights = nodes.select("area_id", F.floor(n / 100).cast("int").alias("batch100"), F.floor(n / osm.ELEVATION_BATCH).cast("int").alias("batch"), (n % osm.ELEVATION_BATCH).cast("int").alias("place"), "ele")
    heights = heights.where(~((F.col("area_id") == "0") & (F.col("batch100") == 1)))
    return osm.with_elevation(nodes, heights).select("area_id", "id", "ele")


def hue_palette(spark, sf):
    n = _t(spark, sf, "nation")
    return n.select("n_nationkey", S.rounded(S.hue("n_nationkey", F.lit(25)), 6).alias("hue"), S.color("n_nationkey", F.lit(25)).alias("color"))


def units(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", S.rounded(S.miles("o_totalprice"), 2).alias("miles"), S.feet("o_totalprice").alias("feet"), S.half_up(F.col("o_totalprice") - 100000.5).cast("bigint").alias("whole"), S.to_fixed7(F.col("o_totalprice") / 1000000).alias("fixed"))


def json_round_trip(spark, sf):
    """Event properties through text and back; what does not parse is null."""
    e = _t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_id").alias("t"), F.col("event_type").alias("d")))).alias("j"))
    return e.select("event_id", F.from_json("j", "t bigint, d string").alias("r")).select("event_id", "r.t", "r.d")


def synthetic_grid(spark, sf):
    _, edges = city.grid(spark, 30, 16, holes=[(6, 10, 3, 6), (18, 24, 9, 13)], diag_every=5)
    return edges.select("src", "dst", _r6("len").alias("len"))


def matching_parity(spark, sf):
    """Each odd node of the largest components in one pair, none with itself."""
    edges = graph.keep_largest(city.city_edges(spark, sf))
    m = areas.matching(edges)
    ends = m.select("area_id", F.explode(F.array("u", "v")).alias("id"))
    return ends.groupBy("area_id").agg(F.count("*").alias("ends"), F.countDistinct("id").alias("odd"))


def augmented_parity(spark, sf):
    """Nodes whose degree is odd with each edge taken as often as it is walked."""
    a = areas.augmented(graph.keep_largest(city.city_edges(spark, sf)))
    ends = a.select("area_id", "mult", F.explode(F.array("src", "dst")).alias("id")).groupBy("area_id", "id").agg(F.sum("mult").alias("d"))
    return ends.groupBy("area_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("d") % 2 == 1).alias("odd"))


def euler_check(spark, sf):
    """Closed walks: edges passed, breaks in the chain, and open ends."""
    walk = areas.closed_walks(graph.keep_largest(city.city_edges(spark, sf)))
    w = Window.partitionBy("area_id", "component").orderBy("pos")
    s = walk.withColumn("gap", F.coalesce((F.lag("b").over(w) != F.col("a")).cast("int"), F.lit(0)))
    ends = s.groupBy("area_id", "component").agg(F.min_by("a", "pos").alias("first"), F.max_by("b", "pos").alias("last"), F.sum("gap").alias("gaps"))
    passed = walk.groupBy("area_id").agg(F.countDistinct(F.least("a", "b"), F.greatest("a", "b")).alias("edges"))
    return ends.groupBy("area_id").agg(F.sum("gaps").alias("gaps"), F.count_if(F.col("first") != F.col("last")).alias("open")).join(passed, "area_id")


def contraction(spark, sf):
    """Contracted networks keep length, odd nodes and every street."""
    edges = graph.keep_largest(city.city_edges(spark, sf))
    c = areas.contracted(edges, CAP_M)
    odd = graph.odd_nodes(c).groupBy("area_id").agg(F.count("*").alias("odd"))
    streets = c.groupBy("area_id").agg(F.sum(F.size("via") + 1).alias("segments"), _r3(F.sum("len")).alias("bare_m"))
    return streets.join(odd, "area_id")


def _requests(spark, sf):
    blocks = city.city_nodes(spark, sf).select("area_id").distinct()
    return blocks.select(F.concat(F.lit("q"), "area_id").alias("request_id"), "area_id", F.lit(CAP_M).alias("max_m"), F.lit(LAT).alias("start_lat"), F.lit(LON).alias("start_lon"), (F.col("area_id").cast("int") % 2 == 1).alias("cluster"), F.lit(None).cast("double").alias("match_k"))


def _plan(spark, sf):
    nodes, edges = _city(spark, sf)
    return nodes, route_plan.plan(nodes, edges, _requests(spark, sf))


def run_table(spark, sf):
    _, p = _plan(spark, sf)
    return p.runs.select("request_id", "run_id", "zone", "length_mi", F.size("coords").alias("points"), "elev_gain_m", "elev_loss_m")


def run_files(spark, sf):
    _, p = _plan(spark, sf)
    return gpx.tracks(p.runs)


def plan_summary(spark, sf):
    _, p = _plan(spark, sf)
    return p.stats


def plan_stats(spark, sf):
    """What does not depend on the way a plan is found."""
    _, p = _plan(spark, sf)
    return p.stats.select("request_id", "intersections", "segments", "bare_mi", (F.col("covered_mi") >= F.col("bare_mi")).alias("covers"), (F.col("n_runs") >= F.ceil(F.col("bare_mi") / 5.0)).alias("enough_runs"))


def plan_checks(spark, sf):
    """Streets that no run passes, runs over the cap, and first points that are
    not the anchor: all zero."""
    nodes, p = _plan(spark, sf)
    steps = p.walk.select("area_id", F.explode(F.arrays_zip(F.concat(F.array("a"), "via").alias("a"), F.concat("via", F.array("b")).alias("b"))).alias("z")).select("area_id", "z.a", "z.b")
    missed = graph.covered_gap(p.full.select("area_id", "src", "dst", "len"), steps).groupBy("area_id").agg(F.count("*").alias("n"))
    long = p.walk.groupBy("area_id", "run_id").agg(F.sum("len").alias("m"), F.count("*").alias("k")).where((F.col("m") > CAP_M + 1e-6) & (F.col("k") > 1)).groupBy("area_id").agg(F.count("*").alias("n"))
    ends = p.full.select("area_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    anchors = graph.nearest_node(nodes.join(ends, ["area_id", "id"], "left_semi"), p.stats.select("area_id", F.lit(LAT).alias("lat"), F.lit(LON).alias("lon")))
    first = p.walk.groupBy("area_id").agg(F.min_by("a", F.struct("run_id", "pos")).alias("first")).join(anchors.select("area_id", "id"), "area_id").select("area_id", (F.col("first") != F.col("id")).cast("int").alias("off"))
    out = p.stats.select("area_id").join(missed.withColumnRenamed("n", "missed"), "area_id", "left").join(long.withColumnRenamed("n", "long"), "area_id", "left").join(first, "area_id", "left")
    return out.select("area_id", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in ("missed", "long", "off")])


def plan_accounts(spark, sf):
    """What a plan must add up to, whichever way it was found: lengths of runs
    against their steps, breaks between steps, walks that do not close, lost run
    numbers, repeated streets against the length over the bare one."""
    _, p = _plan(spark, sf)
    key = ["request_id"]
    w = Window.partitionBy("request_id", "zone", "component").orderBy("run_id", "pos")
    steps = p.walk.select("*", F.lag("b").over(w).alias("before"), F.first("a").over(w).alias("first"), F.lead("a").over(w).isNull().alias("last"))
    breaks = steps.groupBy(*key).agg(F.count_if(F.col("before") != F.col("a")).alias("breaks"), F.count_if(F.col("last") & (F.col("first") != F.col("b"))).alias("open"), F.sum("len").alias("covered"))
    long = p.walk.groupBy("request_id", "run_id").agg(F.sum("len").alias("m"), F.sum(F.size("via") + 1).alias("links"))
    runs_ = p.runs.join(long, ["request_id", "run_id"]).groupBy(*key).agg(
        F.count_if(F.abs(F.col("m") - F.col("length_m")) > 1e-6).alias("lengths_off"), F.count_if(F.size("coords") != F.col("links") + 1).alias("points_off"),
        (F.max("run_id") - F.count("*")).cast("bigint").alias("numbers_off"),
    )
    streets = p.walk.groupBy("request_id", F.least("a", "b"), F.greatest("a", "b")).agg(F.min("len").alias("len"), F.count("*").alias("n"))
    again = streets.groupBy(*key).agg(F.sum(F.col("len") * (F.col("n") - 1)).alias("again"))
    bare = p.full.groupBy(*key).agg(F.sum("len").alias("bare"), F.count("*").alias("segments"))
    out = bare.join(breaks, key).join(runs_, key).join(again, key).join(p.stats.select("request_id", "overhead_pct"), key)
    over = 100 * (F.col("covered") - F.col("bare")) / F.col("bare")
    return out.select("request_id", _r3("bare").alias("bare_m"), "segments", "breaks", "open", "lengths_off", "points_off", "numbers_off", (F.abs(F.col("covered") - F.col("bare") - F.col("again")) < 1e-3).alias("repeats_agree"), (F.abs(F.col("overhead_pct") - over) <= 0.05 + 1e-9).alias("overhead_agrees"))


def zone_costs(spark, sf):
    """Distance over the bare length by ways of zoning, in percent."""
    nodes, edges = _city(spark, sf)
    kept = graph.keep_largest(edges)
    ends = kept.select("area_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    inside = nodes.join(ends, ["area_id", "id"], "left_semi")
    c = areas.covered_by_zones(kept, inside, 3)
    return c.select("area_id", "kind", _r3("bare").alias("bare"), S.rounded(100 * (F.col("covered") - F.col("bare")) / F.col("bare"), 1).alias("overhead"), "cuts")


def seams_or_matching(spark, sf):
    """Which costs more, seams between zones or the plain matching."""
    costs = zone_costs(spark, sf).groupBy("area_id").pivot("kind", ["one", "kmeans"]).agg(F.first("overhead"))
    gap = areas.matching_gap(graph.keep_largest(city.city_edges(spark, sf))).select("area_id", (100 * (F.col("plain") - F.col("swapped")) / F.col("bare")).alias("gap"))
    both = costs.join(gap, "area_id").agg(F.avg(F.col("kmeans") - F.col("one")).alias("seam"), F.avg("gap").alias("gap"))
    verdict = F.when(F.col("seam") > 2 * F.col("gap"), "seams").when(F.col("gap") > 2 * F.col("seam"), "matching").otherwise("comparable")
    return both.select(S.rounded("seam", 1).alias("seam"), S.rounded("gap", 1).alias("gap"), verdict.alias("verdict"))


def _streamed(spark, sf, flow):
    """The rows of ``flow`` over the events as a stream; one pass over what is there."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    op = F.when(F.col("event_type").isin("purchase", "signup"), "put").otherwise("get").alias("op")
    keyed = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), op)
    out = scratch_dir(spark, "gate")
    query = flow(keyed).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def cooldown_stream(spark, sf):
    rows = _streamed(spark, sf, lambda e: gate.cooldown_stream(e.drop("op"), HOURS_6))
    return rows.select(F.col("key").cast("bigint").alias("user_id"), "seq", "accepted")


def ttl_stream(spark, sf):
    rows = _streamed(spark, sf, lambda e: gate.ttl_stream(e, 3 * 24 * 3600 * 1000))
    return rows.select(F.col("key").cast("bigint").alias("user_id"), "seq", "hit")


def demo_plan(spark, sf):
    """A saved plan, read from its file and coloured as its viewer would."""
    saved = {"center": [40.0, -74.0], "runs": [{"id": k + 1, "length_mi": 4.5 - k, "zone": 0, "coords": [[40.0, -74.0], [40.0 + k, -74.0]]} for k in range(3)], "stats": {"n_runs": 3, "zones": 1, "bare_mi": 9.0, "covered_mi": 10.5, "overhead_pct": 16.7, "intersections": 4, "segments": 5}}
    path = scratch_dir(spark, "demo")
    spark.createDataFrame([(json.dumps(saved, indent=1),)], "value string").coalesce(1).write.text(path)
    plan = osm.read_demo(spark, path)
    return plan.select(F.posexplode("runs").alias("k", "r"), "stats").select("r.id", "r.length_mi", F.coalesce("r.color", S.color("k", F.col("stats.n_runs"))).alias("color"), F.size("r.coords").alias("points"))


QUERIES = {
    f.__name__: f
    for f in (
        city_nodes, city_ways, way_segments, dangling_refs, edge_dedup_min, haversine_lengths, node_degree, odd_nodes, bare_length, graph_shape, nearest_node,
        radius_ways, element_filter, osm_parse, components, components_wide, largest_component, junctions, isolated_loops, subgraph, sssp_corner, shortest_paths, odd_distances,
        nearest_odd, seeds_lon, kmeans_zones, nearest_centroid, edge_zone, zone_center, zone_order, zone_count, cut_edges, bfs_partition, mincut_zones, split_runs,
        run_elevation, total_climb, gpx_export, bounding_box, xml_escape, uri_encode, overpass_key, geocode_key, geocode_lookup, slim_encode, slim_expand,
        cooldown_gate, cooldown_left, ttl_hits, lru_order, cache_replay, would_use_network, failover_choice, status_message, elevation_lookup, hue_palette, units,
        json_round_trip, synthetic_grid, matching_parity, augmented_parity, euler_check, contraction, run_table, run_files, plan_summary, plan_stats, plan_checks,
        plan_accounts, zone_costs, seams_or_matching, cooldown_stream, ttl_stream, demo_plan, csr_arrays, multigraph, nearest_target,
    )
} | {f"area_filter_{net}": _filter(net) for net in osm.NETWORKS}
