"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import CONTENT, content_rows, discard, exploded, materialise

#: No document is taken more often than this.
MOST_COPIES = 3
#: Rows of one rank window, on average.
WINDOW_ROWS = 20_000
#: Up to so many sources their rates are broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 100_000
NEWTON_ROUNDS = 60
#: Roundings that each source chooses from.
PHASES = 64
#: Constraints are met to this relative error.
TOLERANCE = 1e-13


def word_count(text_col: str = "text"):
    """Number of runs free of space, tab, LF, VT, FF and CR; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share
    the words of all. A target stops at ``most`` times its source's words and
    the excess is shared again by weight until none is above. In order of
    words per weight the stopped sources come first, so one pass of running
    sums finds the level at which the rest share.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    every = Window.partitionBy()
    # one row per source from here on
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    ranked = per.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    shared = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("_all"),
        F.sum("weight").over(every).alias("_weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_stopped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_gone"),
    ).withColumn("_level", (F.col("_all") - most * F.col("_stopped")) / (F.col("_weights") - F.col("_gone")))
    # the first source that has room for its share sets the level
    level = F.min(F.when(F.col("_level") * F.col("weight") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("_gone"), F.col("_level").alias("level")))).over(every)
    free = shared.withColumn("_at", level["level"])
    target = F.least((most * F.col("source_size")).cast("double"), F.col("_at") * F.col("weight"))
    return free.select("source", "source_size", "weight", target.alias("target"))


def balance(targets: DataFrame) -> DataFrame:
    """``targets`` plus rate: how often each document of the source is taken.

    Entropy balancing: of all non-negative document rates that meet the token
    constraint of every source, take those nearest to 1 in relative entropy,
    words as base measure. They are exp(lambda[source]): the lambdas minimise
    the convex dual sum(mass * exp(lambda)) - sum(lambda * target). A document
    enters the dual only through its source, so the words of each source are
    summed once, with map-side partial sums, and every Newton round runs over
    that table in Spark; only the largest relative error returns to the
    driver. The step is damped at 1, which keeps Newton's method monotone.
    Sources without words or without a target get the limits 1 and 0.
    """
    active = (F.col("source_size") > 0) & (F.col("target") > 0)
    held = state = materialise(targets.withColumn("_lambda", F.lit(0.0)), "dual")
    mass = F.col("source_size").cast("double")
    for _ in range(NEWTON_ROUNDS // 6):
        lam = F.col("_lambda")
        for _ in range(6):
            gradient = mass * F.exp(lam) - F.col("target")
            lam = F.when(active, lam - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gradient / (mass * F.exp(lam))))).otherwise(F.lit(0.0))
            state = state.withColumn("_lambda", lam)
            lam = F.col("_lambda")
        state = materialise(state, "dual")
        discard(held)
        held = state
        error = state.where(active).agg(F.max(F.abs(mass * F.exp("_lambda") - F.col("target")) / F.col("target"))).first()[0]
        if error is None or error < TOLERANCE:
            break
    rate = F.when(F.col("source_size") <= 0, 1.0).when(F.col("target") <= 0, 0.0).otherwise(F.exp("_lambda"))
    return state.withColumn("rate", rate).drop("_lambda")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_COPIES, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies,
    taken; and the columns ``keys``, which order rows of one id.

    Rates are rounded into whole copies along each source's documents in
    order of size: after the i-th document floor(rate * i + phase) copies have
    been taken. Neighbours have like sizes, so with any phase a source's words
    differ from its target by about the size of its longest document at most;
    of PHASES phases each source takes the one that comes nearest (the lowest
    of equals). No document is taken more than ceil(rate) <= ``most`` times.

    A null text has size 0; documents without words get copies like others and
    take no words. Null sources are one source, weighed last. The order within
    one size is (cell of the id, id): rows with equal ids are dealt over the
    cells and interchangeable.
    No rows give no rows. Positions are found without ordering a source in one
    task: counts per (source, size, cell) are summed first, and only rows of
    one cell, about WINDOW_ROWS of them, are ranked together.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *keys)
    rows = materialise(exploded(narrow), "words")
    targets = materialise(balance(source_targets(rows, most)), "targets")
    small = targets.count() <= BROADCAST_SOURCES
    cells = int(rows.count() // WINDOW_ROWS + 1)
    cell = ["source", "size", "_cell"]
    rows = rows.withColumn("_cell", F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)) + F.col("_copy") - 1, F.lit(cells)))
    counts = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    # first over the sizes of a source, then over the cells of a size
    sized = counts.groupBy("source", "size").agg(F.sum("_n").alias("_m"))
    ahead = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.select("source", "size", "_m", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy("source", "size").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # whole sizes at a time, the words that each phase would take
    taken = lambda at, phase: F.floor(F.col("rate") * at + phase + F.lit(1e-7))
    phased = sized.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    phased = phased.select("t.source", "target", "rate", "size", "_m", "_ahead", F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1))).alias("_k"))
    phase = (F.col("_k") + 0.5) / PHASES
    words = phased.groupBy("source", "target", "_k").agg(F.sum(F.col("size") * (taken(F.col("_ahead") + F.col("_m"), phase) - taken(F.col("_ahead"), phase))).alias("_words"))
    best = words.groupBy("source").agg(F.min_by("_k", F.struct(F.abs(F.col("_words") - F.col("target")), F.col("_k"))).alias("_k"))
    targets = targets.alias("t").join(best.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source"))).select("t.*", ((F.col("_k") + 0.5) / PHASES).alias("phase"))
    targets = materialise(targets, "phases")
    offsets = counts.withColumn("_inner", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    offsets = offsets.alias("o").join(sized.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")) & (F.col("o.size") == F.col("s.size")))
    offsets = offsets.select("o.source", "o.size", "o._cell", (F.col("_ahead") + F.col("_inner")).alias("_offset"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id", *keys, "_copy")))
    same = F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.size") == F.col("o.size")) & (F.col("r._cell") == F.col("o._cell"))
    placed = ranked.alias("r").join(offsets.alias("o"), same).select("r.doc_id", *[f"r.{k}" for k in keys], "r.source", "r.size", (F.col("_offset") + F.col("_rank")).alias("_at"))
    hint = F.broadcast if small else (lambda x: x)
    joined = placed.alias("p").join(hint(targets.alias("t")), F.col("p.source").eqNullSafe(F.col("t.source")))
    copies = F.least(F.lit(most), taken(F.col("_at"), F.col("phase")) - taken(F.col("_at") - 1, F.col("phase"))).cast("int")
    return joined.select("doc_id", *keys, "p.source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_COPIES) -> DataFrame:
    """``docs`` with each row repeated by its copies; rows of 0 copies go.

    Rows are told apart by 128 bits of their content, so rows with a null id
    and rows that repeat an id have copies of their own; fully equal rows share
    the sum of their copies. Null texts and sources, empty tables and columns
    of any name are as in ``mix_sources``.
    """
    keyed, names = content_rows(docs)
    own = dict(zip(docs.columns, names, strict=True))
    copies = mix_sources(keyed, own[id_col], own[text_col], own[source_col], most, tuple(CONTENT))
    copies = copies.groupBy(*CONTENT).agg(F.sum("copies").alias("_sum")).where("_sum > 0")
    # the join finds its rows dealt by content already
    out = keyed.dropDuplicates(CONTENT).join(copies, CONTENT)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_sum"))).select(*names).toDF(*docs.columns)
