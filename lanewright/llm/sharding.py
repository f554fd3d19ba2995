"""A uniform shuffle into shards of exact sizes. DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import CONTENT, content_rows, exploded, materialise, text_or_empty, utf8_size

#: Rows of one source bucket, and of one bucket of a shard, on average. The
#: number of buckets depends on the rows alone, not on the cluster, and stops at
#: MOST_BUCKETS, which bounds the matrix: 8192 x 40 counts of 8 bytes are 2.6 MB.
BUCKET_ROWS = 4_000
MOST_BUCKETS = 8192


def communication_matrix(rows_per_bucket: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each bucket sends to each shard.

    Drawn as a uniform random permutation of all rows would have it: bucket by
    bucket, a multivariate hypergeometric draw from the room that the shards
    have left. Row sums are the buckets' rows; column sums differ by one at
    most.
    """
    total = sum(rows_per_bucket)
    rng = np.random.default_rng(seed)
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    out = np.zeros((len(rows_per_bucket), shards), np.int64)
    for k, n in enumerate(rows_per_bucket):
        out[k] = rng.multivariate_hypergeometric(room, n, method="marginals")
        room -= out[k]
    return out


def _hash(columns: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def assign_shards(rows: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """``rows`` plus shard (int) and slot (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most. A bucket is a hash of the row, not a
    physical partition, so a task that runs again after a loss repeats its
    result. ``rows`` should be narrow and cheap to read twice (a written
    table). Fully equal rows get different slots, in any order. No rows give no
    rows.
    """
    spark = rows.sparkSession
    columns = rows.columns
    total = rows.count()
    buckets = int(min(MOST_BUCKETS, max(1, -(-total // BUCKET_ROWS))))
    dealt = rows.withColumn("_bucket", F.pmod(_hash(columns, seed), F.lit(buckets)).cast("int"))
    counts = {r["_bucket"]: r["n"] for r in dealt.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}  # at most MOST_BUCKETS rows
    sizes = [counts.get(k, 0) for k in range(buckets)]
    ends = communication_matrix(sizes, shards, seed).cumsum(axis=1)
    matrix = spark.createDataFrame([(k, row) for k, row in enumerate(ends.tolist())], "_bucket int, _ends array<bigint>")
    local = Window.partitionBy("_bucket").orderBy(_hash(columns, seed + 1), *columns)
    sent = (
        dealt.withColumn("_rank", F.row_number().over(local))
        .join(F.broadcast(matrix), "_bucket")
        # the shard is the first one whose running count reaches the rank
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int"))
        .withColumn("_part", F.pmod(_hash(columns, seed + 2), F.lit(max(1, buckets // shards * 2))).cast("int"))
        .select(*columns, "shard", "_part")
    )
    sent = materialise(sent, "shards")
    # the second permutation: order within a part by hash, parts laid end to end
    parts = sent.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    again = Window.partitionBy("shard", "_part").orderBy(_hash(columns, seed + 3), *columns)
    # at most shards x MOST_BUCKETS / 20 rows
    return (
        sent.withColumn("_at", F.row_number().over(again))
        .join(F.broadcast(starts), ["shard", "_part"])
        .select(*columns, "shard", (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"))
    )


def shard_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    The law is `rows`: shard counts at most one apart. Equal texts are spread
    like any other rows. size is the UTF-8 bytes plus 16; a null text has none
    and a checksum of 0. Null and repeated ids are ids like others; no rows give
    no rows. Texts are read once; only narrow rows are exchanged.
    """
    text = text_or_empty(text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), (utf8_size(text) + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign_shards(materialise(exploded(narrow), "sizes"), shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """``docs`` with all its columns plus shard and slot.

    Only three numbers a row travel through the two permutations: 128 bits that
    name its content, and its number among equal rows, which comes from their
    count. They find the rows again in one join; of equal rows one travels.
    Null and repeated ids are like others. A column of docs named shard or slot
    is replaced. No rows give no rows.
    """
    docs = docs.drop("shard", "slot")
    keyed, names = content_rows(docs)
    narrow = materialise(exploded(keyed.select(*CONTENT)), "rows")
    placed = assign_shards(narrow, shards, seed).select(*CONTENT, "shard", "slot")
    return keyed.dropDuplicates(CONTENT).join(placed, CONTENT).select(*names, "shard", "slot").toDF(*docs.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shards as folders shard=0, shard=1, ... in slot order."""
    placed = shard_documents(docs, **options)
    placed.repartition("shard", F.floor(F.col("slot") / F.lit(1_000_000))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
