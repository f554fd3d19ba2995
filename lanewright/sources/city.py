"""Synthetic street grids, and the fixture city that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.scalar import haversine

SIDE = 20
BLOCK = SIDE * SIDE


def grid(spark: SparkSession, rows: int, cols: int, ns_mi: float = 0.05, ew_mi: float = 0.15, holes: list[tuple[int, int, int, int]] | None = None, diag_every: int = 0, diag_mi: float = 0.158, area_id: str = "grid") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a street grid with given edge lengths in miles.

    Holes are half-open (row, row, column, column) boxes without nodes; with
    ``diag_every`` a diagonal leaves each node whose row + column it divides.
    """
    cell = spark.range(rows * cols).select((F.col("id").cast("int")).alias("n"))
    cell = cell.select("n", F.expr(f"n div {cols}").cast("int").alias("r"), (F.col("n") % cols).alias("c"))
    for r0, r1, c0, c1 in holes or []:
        cell = cell.where(~(F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)))
    nodes = cell.select(F.lit(area_id).alias("area_id"), F.col("n").cast("string").alias("id"), (40.70 + F.col("r") * 0.0036).alias("lat"), (-74.02 + F.col("c") * 0.0052).alias("lon"), F.lit(None).cast("double").alias("ele"))
    steps = [(0, 1, ew_mi, F.lit(True)), (1, 0, ns_mi, F.lit(True))]
    if diag_every:
        steps.append((1, 1, diag_mi, (F.col("r") + F.col("c")) % diag_every == 0))
    there = cell.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("n").alias("n2"))
    parts = [cell.where(when).withColumn("r2", F.col("r") + dr).withColumn("c2", F.col("c") + dc).join(there, ["r2", "c2"]).select("n", "n2", F.lit(mi * 1609.344).alias("len")) for dr, dc, mi, when in steps]
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    a, b = F.col("n").cast("string"), F.col("n2").cast("string")
    return nodes, links.select(F.lit(area_id).alias("area_id"), F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "len")


def city_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts laid out on 20 x 20 blocks, with the columns of node and tags."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice", "p_type", "p_brand")
    p = F.col("p_partkey")
    at = p % BLOCK
    return part.select(
        p.alias("p"), F.expr(f"p_partkey div {BLOCK}").alias("block"), F.expr(f"(p_partkey % {BLOCK}) div {SIDE}").alias("r"), (at % SIDE).alias("c"),
        (F.col("p_size") % 3 != 0).alias("open"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") - 900).alias("ele"), "p_type", "p_brand",
    )


def city_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = city_cells(spark, sf_dir).where("open")
    return cell.select(F.col("block").cast("string").alias("area_id"), F.col("p").cast("string").alias("id"), (F.lit(40.70) + F.col("r") * 0.0036).alias("lat"), (F.lit(-74.02) + F.col("c") * 0.0052).alias("lon"), "ele")


def city_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area_id, way_id, refs, tags): one way a row and a column of a block,
    with the holes among its references, and two-node diagonals."""
    cell = city_cells(spark, sf_dir)
    along = lambda fixed, step, kind: (
        cell.groupBy("block", fixed)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(step, "p"))), lambda s: s["p"].cast("string")).alias("refs"), F.min_by("p_type", "p").alias("kind"), F.min_by("p_brand", "p").alias("brand"))
        .select("block", F.concat_ws("-", F.lit(kind), F.col("block").cast("string"), F.col(fixed).cast("string")).alias("way_id"), "refs", "kind", "brand")
    )
    diagonal = cell.where((F.col("r") < SIDE - 1) & (F.col("c") < SIDE - 1) & ((F.col("r") + F.col("c")) % 5 == 0)).select(
        "block", F.concat_ws("-", F.lit("d"), F.col("p").cast("string")).alias("way_id"), F.array(F.col("p").cast("string"), (F.col("p") + SIDE + 1).cast("string")).alias("refs"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand")
    )
    ways = along("r", "c", "r").unionByName(along("c", "r", "c")).unionByName(diagonal)
    highway = (
        F.when(F.col("kind") == "MEDIUM", "residential").when(F.col("kind") == "STANDARD", "footway").when(F.col("kind") == "LARGE", "motorway_link")
        .when(F.col("kind") == "PROMO", "primary").when(F.col("kind") == "SMALL", F.lit(None).cast("string")).otherwise("unclassified")
    )
    foot = F.when(F.col("brand").endswith("1"), "no").when(F.col("brand").endswith("2"), "unknown").when(F.col("brand").endswith("3"), "yes")
    bicycle = F.when(F.col("brand").endswith("4"), "no").when(F.col("brand").endswith("5"), "designated")
    tags = F.map_filter(F.create_map(F.lit("highway"), highway, F.lit("foot"), foot, F.lit("bicycle"), bicycle), lambda _, v: v.isNotNull())
    return ways.select(F.col("block").cast("string").alias("area_id"), "way_id", "refs", tags.alias("tags"))


def city_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanewright.operators.graph import edges_from_ways

    return edges_from_ways(city_nodes(spark, sf_dir), city_ways(spark, sf_dir))
