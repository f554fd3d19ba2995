"""Exact duplicates by a heavy-hitter split. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import ascii_lower, keyed_rows, materialise, shuffle_parts, text_or_empty

#: A digest is frequent from this share of the rows on. There can be no more
#: than 1/SUPPORT such digests, which bounds what is broadcast (about 1 MB),
#: and the largest group left for the shuffle is 1/10,000 of the rows.
SUPPORT = 1e-4
#: Counters that the frequent-items sketch keeps in each of its cells.
COUNTERS = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(text_or_empty(text_col)).cast("binary"), 256).alias("text_sha256"))


def frequent_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(text_sha256, keep_id, group_size) of the digests with a share of ``support``.

    Misra-Gries counters (``approx_top_k``, a sketch of that family) propose
    64-bit keys: rows are dealt into cells by key, so the counters of one cell
    only meet the keys of that cell and no task merges them all. The proposals
    are verified by counting their rows exactly. A frequent digest that the
    counters miss is merely shuffled like any other.
    """
    spark = rows.sparkSession
    total = rows.count()
    least = max(2, int(total * support))
    keyed = rows.withColumn("key", F.xxhash64("text_sha256"))
    cells = max(64, shuffle_parts(spark))
    found = (
        keyed.groupBy(F.pmod(F.col("key"), F.lit(cells)).alias("cell"))
        .agg(F.expr(f"approx_top_k(key, {COUNTERS // 4}, {COUNTERS})").alias("top"))
        .select(F.explode("top").alias("top"))
        .where(F.col("top.count") >= least)
        # a sum of all counts is the number of rows, so no more than this many can be frequent
        .orderBy(F.desc("top.count"), "top.item")
        .limit(int(2 / support))
        .select(F.col("top.item").alias("key"))
    )
    winners = (
        keyed.join(F.broadcast(found), "key", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= least)
    )
    return materialise(winners, "frequent")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty, and all empty texts are one group. The row with the largest id
    stays. Rows that repeat an id and a text all count in group_size and all
    carry kept = (doc_id = keep_id). A null id counts in group_size and is
    never kept; keep_id is null if a group has no other. No rows give no rows;
    further columns are not looked at.

    Digests are written once to the shared folder. Rows of a frequent digest
    get their verdict map-side from the broadcast winners; the others are
    shuffled by digest, no group of them over ``support`` of the rows.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    winners = frequent_digests(rows, support)
    hot = rows.join(F.broadcast(winners), "text_sha256")
    same = Window.partitionBy("text_sha256")
    cold = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "*", F.max("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size")
    )
    return hot.unionByName(cold).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each
    group, that of the largest id (a null id only where the group has no
    other, and of rows with one id the one of the greatest row hash)."""
    plain, names, key = keyed_rows(docs, id_col, nulls_first=True)
    keep = exact_duplicates(plain, key, names[docs.columns.index(text_col)]).where("kept").select(F.col("doc_id").alias(key))
    return plain.join(keep, key, "left_semi").select(*names).toDF(*docs.columns)
