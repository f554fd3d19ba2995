"""Helpers shared by the text operators: scratch tables, text normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.scratch import discard as discard
from lanewright.scratch import written as materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def utf8_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Up to so many ids are broadcast (8 bytes each, so 8 MB); more are joined by
#: a shuffle.
BROADCAST_IDS = 1_000_000


def _fits(ids: DataFrame) -> bool:
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def only_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is in ``ids`` (a written table, one column id_col)."""
    return rows.join(F.broadcast(ids) if _fits(ids) else ids, id_col, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not in ``ids`` (a written table); null ids stay."""
    return rows.join(F.broadcast(ids) if _fits(ids) else ids, id_col, "left_anti")


def distinct_ids(rows: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own."""
    return rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n")).where("id is null or n > 1").isEmpty()


def keyed_rows(docs: DataFrame, id_col: str, nulls_first: bool = False) -> tuple[DataFrame, list[str], str]:
    """``docs`` under plain column names, these names, and the column that tells
    rows apart in order of their ids.

    That is the id itself, unless an id is null or repeated. Then rows are
    numbered in order of (id, row hash): one sort of the whole table, written
    to the shared folder.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain, key = docs.toDF(*names), names[docs.columns.index(id_col)]
    if distinct_ids(plain, key):
        return plain, names, key
    by = F.col(key).cast("long")
    # the last key only spreads equal rows
    order = [by.asc_nulls_first() if nulls_first else by.asc_nulls_last(), F.col("_hash"), F.col("_any")]
    ordered = plain.select("*", F.xxhash64(*names).alias("_hash"), F.monotonically_increasing_id().alias("_any")).orderBy(*order)
    return materialise(ordered.select(*names, F.monotonically_increasing_id().alias("_number")), "numbered"), names, "_number"


#: 128 bits that name the content of a row.
CONTENT = ["_content1", "_content2"]


def content_rows(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` under plain column names plus CONTENT, and these names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    return plain.select("*", *[F.xxhash64(F.lit(k), *names).alias(c) for k, c in enumerate(CONTENT)]), names


def exploded(rows: DataFrame) -> DataFrame:
    """``rows`` with _copy, which counts equal rows from 1. Equal rows are counted
    with map-side sums, so a row that a third of the table repeats is no hot key."""
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    return counts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")
