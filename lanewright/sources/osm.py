"""Street data: saved map responses, way filters, area scans, look-ups."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright import schemas
from lanewright.functions.scalar import address_key, haversine
from lanewright.operators.graph import segments

# Tag patterns of the three networks. They match anywhere in a
# value; a "not" pattern holds where the tag is missing.
NETWORKS = {
    "walk": {"highway": ("not", "motorway|motorway_link|trunk|trunk_link|construction|proposed|raceway"), "foot": ("not", "no")},
    "drive": {"highway": ("is", "motorway|trunk|primary|secondary|tertiary|unclassified|residential|living_street|service")},
    "bike": {"highway": ("not", "motorway|motorway_link|footway|steps|construction|proposed"), "bicycle": ("not", "no")},
}
ELEVATION_BATCH = 500


def read_responses(spark: SparkSession, path: str, area_col: str = "area_id") -> DataFrame:
    """(area_id, data) from lines of JSON {area_id, elements}; a line that does
    not parse has a null ``data``."""
    return spark.read.text(path).select(F.get_json_object("value", f"$.{area_col}").alias("area_id"), F.from_json("value", schemas.RESPONSE).alias("data"))


def elements(responses: DataFrame) -> DataFrame:
    """One row per element with its position in the response."""
    return responses.select("area_id", F.posexplode("data.elements").alias("pos", "e")).select("area_id", "pos", "e.*")


def nodes_of(items: DataFrame) -> DataFrame:
    """Nodes of an element table; the last one with an id counts."""
    last = items.where("type = 'node'").groupBy("area_id", "id").agg(F.max_by(F.struct("lat", "lon"), "pos").alias("p"))
    return last.select("area_id", F.col("id").cast("string").alias("id"), "p.lat", "p.lon", F.lit(None).cast("double").alias("ele"))


def ways_of(items: DataFrame) -> DataFrame:
    """(area_id, pos, refs, tags) of the ways that have a list of nodes."""
    return items.where("type = 'way' and nodes is not null").select("area_id", "pos", F.transform("nodes", lambda n: n.cast("string")).alias("refs"), "tags")


def in_network(net: str | None, tags: str | Column = "tags") -> Column:
    """Whether a way belongs to a network; an unknown name means walk."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    out = tags["highway"].isNotNull()
    for key, (kind, pattern) in NETWORKS.get(net or "walk", NETWORKS["walk"]).items():
        hit = tags[key].rlike(pattern)
        out = out & (F.coalesce(hit, F.lit(False)) if kind == "is" else F.coalesce(~hit, F.lit(True)))
    return out


def _box(lat: float, lon: float, radius_m: float) -> tuple[float, list[tuple[float, float]]]:
    """Degrees of latitude, and the ranges of longitude, that a circle spans: two
    ranges across +-180 degrees, the whole round at a pole."""
    dlat = math.degrees(radius_m / 6_371_000.0) * 1.000001
    if abs(lat) + dlat >= 89.999:
        return dlat, [(-180.0, 180.0)]
    dlon = dlat / math.cos(math.radians(abs(lat) + dlat))
    if dlon >= 180:
        return dlat, [(-180.0, 180.0)]
    lo, hi = lon - dlon, lon + dlon
    if lo < -180:
        return dlat, [(-180.0, hi), (lo + 360, 180.0)]
    return dlat, [(lo, hi)] if hi <= 180 else [(lo, 180.0), (-180.0, hi - 360)]


def near(lat: float, lon: float, radius_m: float, lat_col: str = "lat", lon_col: str = "lon") -> Column:
    """Within a radius of a point. The box around it comes first, as plain range
    predicates that reach the Parquet reader."""
    dlat, ranges = _box(lat, lon, radius_m)
    inside = functools.reduce(Column.__or__, [F.col(lon_col).between(x, y) for x, y in ranges])
    return F.col(lat_col).between(lat - dlat, lat + dlat) & inside & (haversine(F.lit(lat), F.lit(lon), lat_col, lon_col) <= radius_m)


def passes(lat: float, lon: float, radius_m: float, lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Whether the straight line between two places comes within a radius of a
    point, on the plane that touches the globe there."""
    metre = math.radians(1) * 6_371_000.0
    turn = lambda c: F.pmod(F.col(c) - lon + 540.0, F.lit(360.0)) - 180.0
    x1, x2 = (turn(c) * metre * math.cos(math.radians(lat)) for c in (lon1, lon2))
    y1, y2 = ((F.col(c) - lat) * metre for c in (lat1, lat2))
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(x1 * dx + y1 * dy), dx * dx + dy * dy))), F.lit(0.0))
    x, y = x1 + along * dx, y1 + along * dy
    return x * x + y * y <= radius_m * radius_m


def area_scan(nodes: DataFrame, ways: DataFrame, lat: float, lon: float, radius_m: float, net: str = "walk") -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an area: whole ways of the network that have a node
    within the radius or pass through it between two nodes, and all their
    nodes."""
    kept = ways.where(in_network(net))
    place = lambda end, k: nodes.select("area_id", F.col("id").alias(end), F.col("lat").alias(f"_y{k}"), F.col("lon").alias(f"_x{k}"))
    refs = kept.select("area_id", "pos", F.explode("refs").alias("id"))
    inside = refs.join(nodes.where(near(lat, lon, radius_m)).select("area_id", "id"), ["area_id", "id"], "left_semi").select("area_id", "pos")
    lines = segments(kept.select("area_id", F.col("pos").alias("way"), "refs")).join(place("u", 1), ["area_id", "u"]).join(place("v", 2), ["area_id", "v"])
    crossing = lines.where(passes(lat, lon, radius_m, "_y1", "_x1", "_y2", "_x2")).select("area_id", F.col("way").alias("pos"))
    hit = inside.unionByName(crossing).distinct()
    kept = kept.join(hit, ["area_id", "pos"], "left_semi")
    members = refs.join(hit, ["area_id", "pos"], "left_semi").select("area_id", "id").distinct()
    return nodes.join(members, ["area_id", "id"], "left_semi"), kept


def status_message(status: Column) -> Column:
    """What to tell the user about a failed request."""
    return (
        F.when(status == 429, "rate limited: wait a minute before the next plan")
        .when(status.isin(502, 503, 504), "servers overloaded: try again in a minute or choose a smaller area")
        .when(status == 400, "the query was rejected")
        .otherwise(F.concat(F.lit("server error "), status.cast("string")))
    )


def choose_endpoint(attempts: DataFrame) -> DataFrame:
    """(request_id, endpoint, tries, message) from (request_id, ord, endpoint,
    status, n_elements); status null is a network failure.

    Endpoints are asked one after the other. An answer is taken if it has
    elements or no other endpoint is left; a refusal (4xx but 429) ends the
    search; anything else goes on. Without an answer the last message counts.
    """
    w = Window.partitionBy("request_id").orderBy("ord")
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    last = F.lead("ord").over(w).isNull()
    taken = ok & ((F.col("n_elements") != 0) | last)
    refused = F.coalesce(F.col("status").between(400, 499) & (F.col("status") != 429), F.lit(False))
    said = F.when(taken, F.lit(None).cast("string")).when(F.col("status").isNull(), "no connection").when(ok, "no data for that area").otherwise(status_message(F.col("status")))
    ended = F.max((taken | refused).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tried = attempts.select("request_id", "ord", "endpoint", taken.alias("taken"), said.alias("said"), F.coalesce(ended, F.lit(0)).alias("ended")).where("ended = 0")
    out = tried.groupBy("request_id").agg(F.min(F.when(F.col("taken"), F.col("endpoint"))).alias("endpoint"), F.count("*").alias("tries"), F.max_by("said", "ord").alias("message"))
    return out.select("request_id", "endpoint", "tries", "message")


def geocode(queries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``queries`` (.., q) with lat, lon and found: the gazetteer's first row
    (least ord) of the same normalised name. (name, lat, lon, ord) may be of any
    size; Spark broadcasts it if it is small."""
    first = gazetteer.groupBy(address_key("name").alias("_key")).agg(F.min_by(F.struct("lat", "lon"), "ord").alias("_p"))
    out = queries.withColumn("_key", address_key("q")).join(first, "_key", "left")
    return out.select(*queries.columns, F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"), F.col("_p").isNotNull().alias("found"))


def with_elevation(nodes: DataFrame, heights: DataFrame) -> DataFrame:
    """``nodes`` with ``ele`` from (area_id, batch, place, ele): the answers of
    requests of ELEVATION_BATCH nodes in id order, matched by position.

    All or nothing: if a batch of an area is missing, the area keeps no
    elevations at all, so climbs are never partial.
    """
    order = Window.partitionBy("area_id").orderBy("id")
    placed = nodes.drop("ele").withColumn("_n", F.row_number().over(order) - 1)
    placed = placed.withColumn("batch", F.floor(F.col("_n") / ELEVATION_BATCH).cast("int")).withColumn("place", (F.col("_n") % ELEVATION_BATCH).cast("int"))
    got = heights.select("area_id", "batch", "place", "ele", F.lit(True).alias("_got"))
    joined = placed.join(got, ["area_id", "batch", "place"], "left")
    whole = F.min(F.col("_got").isNotNull().cast("int")).over(Window.partitionBy("area_id")) == 1
    return joined.withColumn("ele", F.when(whole, F.col("ele"))).select("area_id", "id", "lat", "lon", "ele")


def read_demo(spark: SparkSession, path: str) -> DataFrame:
    """A saved plan: (center, runs, stats)."""
    return spark.read.schema(schemas.DEMO).option("multiLine", True).json(path)
