"""From a response to runs; the client's cache; wide components."""

import pytest
from pyspark.sql import functions as F

from lanewright import schemas
from lanewright.operators import cache, graph, wide
from lanewright.plans.session import NoStreets, plan_response
from lanewright.sources import city


def items(spark, rows, cols):
    nodes = [("g", r * cols + c, "node", r * cols + c + 1, 40.72 + r * 0.0026, -73.995 + c * 0.0042, None) for r in range(rows) for c in range(cols)]
    lines = [[r * cols + c + 1 for c in range(cols)] for r in range(rows)] + [[r * cols + c + 1 for r in range(rows)] for c in range(cols)]
    ways = [("g", 1000 + k, "way", None, None, None, refs) for k, refs in enumerate(lines)]
    return spark.createDataFrame(nodes + ways, "area_id string, pos int, type string, id long, lat double, lon double, nodes array<long>").withColumn("tags", F.lit(None).cast("map<string,string>"))


def test_phases(spark):
    table = items(spark, 6, 5)
    ask = spark.createDataFrame([("q", "g", 8046.72, 40.72, -73.995, False, None)], schemas.REQUESTS)
    seen = []
    p = plan_response(table, ask, on_phase=seen.append)
    assert seen == ["building", "solving", "done"] and p.stats.first().segments == 6 * 4 + 5 * 5
    heights = spark.createDataFrame([("g", 0, k, float(k)) for k in range(30)], "area_id string, batch int, place int, ele double")
    seen.clear()
    assert plan_response(table, ask, heights, seen.append).stats.first().total_gain_m > 0 and seen == ["building", "elevation", "solving", "done"]
    seen.clear()
    assert plan_response(table, ask, heights.where("place < 9"), seen.append).stats.first().total_gain_m is None and "elevation_failed" in seen
    with pytest.raises(NoStreets):
        plan_response(table.where("type = 'node'"), ask)


def test_client_cache():
    now = [1000]
    c = cache.AreaCache(cache.Store(200, ttl_ms=500, most=150), lambda: now[0])
    assert c.last_fetch() is None and c.cooling() == 0
    assert c.put_area("walk|1", "slim", 60) and c.put_address("x", (1.0, 2.0)) and c.get_area("walk|1") == "slim" and c.peek_address("x") == (1.0, 2.0)
    assert c.put_area("walk|2", "slim2", 100) and c.get_address("x") is None and c.has_area("walk|1")
    c.note_fetch(1000)
    now[0] = 1501
    assert c.cooling(600) == 99 and not c.has_area("walk|1") and c.get_area("walk|1") is None and not c.put_area("walk|3", "", 151)


def test_wide_components_agree(spark):
    _, edges = city.grid(spark, 12, 9, holes=[(0, 12, 4, 5), (5, 6, 0, 9)])
    _, chain = graph.make_graph(spark, [], [(f"n{k:03}", f"n{k + 1:03}", 1.0) for k in range(120)], "chain")
    both = edges.unionByName(chain)
    key = lambda df: sorted((r.area_id, r.id, r.component) for r in df.collect())
    assert key(wide.components(both)) == key(graph.components(both))
