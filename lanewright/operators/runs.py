"""From walks to runs: splitting, coordinates, climb, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from lanewright.functions.scalar import M_PER_MI, half_up, rounded


def in_order(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Callable], inputs: list[str], result: str, kind: pa.DataType) -> DataFrame:
    """``rows`` with a column ``result``: a fold along the rows of each key.

    ``fold()`` gives a fresh function for a key; it takes a row's ``inputs``
    and returns the row's result. Rows are dealt by key and sorted by Spark,
    and pass in Arrow batches, so a key of any length needs no more memory than
    a batch, and time in proportion to its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, step = None, fold()
        for batch in batches:
            out = []
            key_rows = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for key, *values in zip(key_rows, *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if key != held:
                    held, step = key, fold()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, result])

    schema = StructType([*rows.schema.fields, StructField(result, from_arrow_type(kind))])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def split_runs(steps: DataFrame, keys: list[str], pos: str, length: str, cap: float) -> DataFrame:
    """``steps`` with ``run`` (from 0): the walk of each key, cut by the cap. A
    new run starts where the sum since the last start would pass it; a longer
    step is a run by itself."""

    def fold():
        run, total = -1, 0.0

        def step(d: float) -> int:
            nonlocal run, total
            if run < 0 or total + d > cap:
                run, total = run + 1, 0.0
            total += d
            return run

        return step

    return in_order(steps, keys, [pos], fold, [length], "run", pa.int32())


def coordinates(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, area_id, run_id, pos, id, lat, lon, ele): the points of each
    run through a, the nodes between and b of every step; a point at the place
    of the one before it goes, whatever its elevation."""
    points = walk.select("request_id", "area_id", "run_id", "pos", F.posexplode(F.concat(F.array("a"), F.coalesce("via", F.array().cast("array<string>")), F.array("b"))).alias("k", "id"))
    placed = points.join(nodes.select("area_id", "id", "lat", "lon", "ele"), ["area_id", "id"])
    w = Window.partitionBy("request_id", "run_id").orderBy("pos", "k")
    # of two equal neighbours the first stays, so a look at the one before is enough
    same = F.lag("lat").over(w).eqNullSafe(F.col("lat")) & F.lag("lon").over(w).eqNullSafe(F.col("lon")) & F.lag("id").over(w).isNotNull()
    kept = placed.withColumn("_same", same).where("not _same")
    return kept.select("request_id", "area_id", "run_id", F.row_number().over(w).alias("pos"), "id", "lat", "lon", "ele")


def climbs(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., elev_gain_m, elev_loss_m) over neighbours that both have an
    elevation; null if there are none, for flat is not unknown."""
    w = Window.partitionBy(*keys).orderBy("pos")
    step = points.select(*keys, (F.col("ele") - F.lag("ele").over(w)).alias("d"))
    up, down = F.sum(F.greatest("d", F.lit(0.0))), F.sum(F.greatest(-F.col("d"), F.lit(0.0)))
    known = F.count("d") > 0
    return step.groupBy(*keys).agg(F.when(known, half_up(up)).cast("bigint").alias("elev_gain_m"), F.when(known, half_up(down)).cast("bigint").alias("elev_loss_m"))


def run_table(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a run: request_id, area_id, run_id, zone, length_mi, length_m,
    coords, elev_gain_m, elev_loss_m."""
    keys = ["request_id", "area_id", "run_id"]
    heads = walk.groupBy(*keys).agg(F.min("zone").alias("zone"), F.sum("len").alias("length_m"))
    points = coordinates(walk, nodes)
    lines = points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon", "ele"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["ele"].alias("ele"))).alias("coords"))
    out = heads.join(lines, keys).join(climbs(points, keys), keys)
    return out.select(*keys, "zone", rounded(F.col("length_m") / M_PER_MI, 2).alias("length_mi"), "length_m", "coords", "elev_gain_m", "elev_loss_m")


def plan_stats(walk: DataFrame, runs: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """One row a request: intersections (nodes of the area's planned network, as
    the name has it), segments, bare_mi, covered_mi, overhead_pct, n_runs,
    zones, total_gain_m, total_loss_m. A request without a street gets zeros."""
    ends = edges.select("area_id", F.explode(F.array("src", "dst")).alias("id"))
    n = ends.groupBy("area_id").agg(F.countDistinct("id").alias("intersections"))
    bare = edges.groupBy("area_id").agg(F.count("*").alias("segments"), F.sum("len").alias("bare")).join(n, "area_id")
    done = walk.groupBy("request_id").agg(F.sum("len").alias("covered"), F.max("zones").alias("zones"))
    climb = runs.groupBy("request_id").agg(F.count("*").alias("n_runs"), F.sum("elev_gain_m").alias("total_gain_m"), F.sum("elev_loss_m").alias("total_loss_m"))
    out = requests.select("request_id", "area_id").join(bare, "area_id", "left")
    for t in (done, climb):
        out = out.join(t, "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    over = F.when(F.col("bare") > 0, rounded(100 * (F.col("covered") - F.col("bare")) / F.col("bare"), 1)).otherwise(0.0)
    return out.select(
        "request_id", "area_id", zero("intersections").alias("intersections"), zero("segments").alias("segments"),
        rounded(F.coalesce("bare", F.lit(0.0)) / M_PER_MI, 1).alias("bare_mi"), rounded(F.coalesce("covered", F.lit(0.0)) / M_PER_MI, 1).alias("covered_mi"),
        over.alias("overhead_pct"), zero("n_runs").alias("n_runs"), F.coalesce("zones", F.lit(1)).alias("zones"), "total_gain_m", "total_loss_m",
    )
