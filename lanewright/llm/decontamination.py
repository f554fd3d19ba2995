"""Benchmark passages in training text: rare word seeds, then alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.hashing import IS_LETTER, U, buffers, chunks, ngram_hashes, slices, word_hashes

#: Words of a seed.
SEED = 3
#: A seed is rare if its words meet by chance at no more than this share of
#: all positions, or if it is one of its item's KEEP rarest. A hit of a rare seed
#: is aligned at once, one of another seed if a bound of its score allows.
RARE = 1e-8
KEEP = 8
#: Score of an equal word, of another word, and of a word left out.
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: Share of an item's best score from which a passage counts as a copy.
SCORE = 0.5
#: Bytes of benchmark text that are broadcast in one pass over the corpus, at
#: most (as hashes, about three times that); a larger benchmark takes passes.
PASS_BYTES = 8 << 20


def _words(text_column) -> Iterator[np.ndarray]:
    data, offs = buffers(pc.utf8_lower(text_column))
    for _, _, part, at in chunks(data, offs):
        words, first = word_hashes(part, at, IS_LETTER)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield words[a:b]


def word_shares(texts: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """The share of the corpus's words that each wanted word hash (sorted) has.

    Counted over every word of every text; each task sends its sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros(len(wanted), np.int64), 0
        for batch in slices(batches):
            data, offs = buffers(pc.utf8_lower(batch.column(0)))
            for _, _, part, at in chunks(data, offs):
                words, _ = word_hashes(part, at, IS_LETTER)
                total += len(words)
                where = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
                sums += np.bincount(where[wanted[where] == words], minlength=len(wanted))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], total))], ["word", "n"])

    rows = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a benchmark word at most
    counts = {r["word"]: r["n"] for r in rows}
    total = max(1, counts.pop(-1, 0))
    shares = np.full(len(wanted), 0.5 / total)
    for k, n in counts.items():
        shares[k] = n / total
    return shares


class Seeds:
    """Seeds of benchmark items, by hash, and which of them are rare."""

    def __init__(self, items: list[tuple[int, np.ndarray]], wanted: np.ndarray, shares: np.ndarray):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        hashes, owners, rare = [], [], []
        for k, (_, words) in enumerate(items):
            if len(words) < SEED:
                continue
            grams, _ = ngram_hashes(words, np.array([0, len(words)]), SEED)
            share = shares[np.searchsorted(wanted, words)]
            chance = np.prod([share[j : len(share) - SEED + 1 + j] for j in range(SEED)], axis=0)
            hashes.append(grams)
            owners.append(np.full(len(grams), k))
            rare.append(chance <= RARE)
            rare[-1][np.argsort(chance, kind="stable")[:KEEP]] = True
        places = [np.arange(len(g)) for g in hashes]
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        hashes, owners, places, rare = join(hashes, U), join(owners, np.int64), join(places, np.int64), join(rare, bool)
        by = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.places, self.rare = hashes[by], owners[by], places[by], rare[by]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position in the text, item, position in the item, rare) of equal seeds."""
        lo = np.searchsorted(self.hashes, grams, "left")
        found = np.flatnonzero((lo < len(self.hashes)) & (self.hashes[np.minimum(lo, len(self.hashes) - 1)] == grams)) if len(self.hashes) else np.empty(0, np.int64)
        lo = lo[found]
        many = np.searchsorted(self.hashes, grams[found], "right") - lo
        row = np.repeat(np.arange(len(found)), many)
        at = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return found[row], self.owners[at], self.places[at], self.rare[at]


def align(text: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: best local score over words, as a share of the score of
    an unchanged item, and the words [start, end) of the text that it spans.

    A row of the table at a time; gaps along a row are a running maximum.
    """
    n = len(item)
    steps = np.arange(n + 1) * -GAP
    best, end = 0.0, 0
    above = np.zeros(n + 1)
    since = np.zeros(n + 1, np.int64)
    best_from = 0
    for i, word in enumerate(text):
        diagonal = above[:-1] + np.where(item == word, MATCH, MISMATCH)
        up = above[1:] + GAP
        row = np.zeros(n + 1)
        row[1:] = np.maximum(0.0, np.maximum(diagonal, up))
        origin = np.full(n + 1, i + 1)
        origin[1:] = np.where(row[1:] <= 0, i + 1, np.where(diagonal >= up, np.where(above[:-1] > 0, since[:-1], i), since[1:]))
        lifted = np.maximum.accumulate(row + steps)
        source = np.maximum.accumulate(np.where(row + steps >= lifted, np.arange(n + 1), 0))
        row, since = lifted - steps, origin[source]
        above = row
        k = int(row.argmax())
        if row[k] > best:
            best, end, best_from = float(row[k]), i + 1, int(since[k])
    return best / (MATCH * n), best_from, end


def spare_words(n: int, least: float) -> int:
    """By how many words the longest copy of an item of ``n`` words that can
    still reach the least score is longer than the item."""
    return int(n * (1 + MATCH * (1 - least) / -GAP)) + 1


def among(text: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which words of ``text`` occur in ``side``; a small table is quicker than a sort."""
    return (text[:, None] == side).any(axis=1) if len(text) * len(side) <= 1 << 16 else np.isin(text, side)


def most(words: np.ndarray, item: np.ndarray, at: int, place: int, least: float) -> float:
    """No alignment of text and item that passes through a seed, at ``at`` in the
    text and ``place`` in the item, scores more. To either side of the seed every
    text word is a match if that side of the item has the word, and a loss if not;
    an alignment ends where that sum is largest, at best."""
    spare = spare_words(len(item), least)
    before, after = item[:place], item[place + SEED :]
    left = words[max(0, at - place - spare) : at][::-1]
    right = words[at + SEED : at + SEED + len(after) + spare]
    loss = max(MISMATCH, GAP)
    score = MATCH * SEED
    for text, side in ((left, before), (right, after)):
        if len(text) and len(side):
            score += min(MATCH * len(side), np.where(among(text, side), MATCH, loss).cumsum().max(initial=0.0))
    return score / (MATCH * len(item))


def matches(words: np.ndarray, seeds: Seeds, least: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, start, end) of the best alignment of each item that a seed
    of the text points to; hits that one copy can explain share a window. Every
    seed is looked up; hits of frequent seeds that cannot reach the least score
    are left out before the alignment."""
    if len(words) < SEED:
        return
    grams, _ = ngram_hashes(words, np.array([0, len(words)]), SEED)
    at, owner, place, rare = seeds.hits(grams)
    keep = rare.copy()
    for k in np.flatnonzero(~rare):
        keep[k] = most(words, seeds.words[owner[k]], at[k], place[k], least) >= least
    at, owner, place = at[keep], owner[keep], place[keep]
    by = np.lexsort((at, owner))
    at, owner, place = at[by], owner[by], place[by]
    edges = np.flatnonzero(np.diff(owner)) + 1
    for a, b in zip(np.append(0, edges), np.append(edges, len(owner)), strict=True):
        if a == b:
            continue
        item = seeds.words[owner[a]]
        n = len(item)
        spare = spare_words(n, least)
        lo, hi = np.maximum(0, at[a:b] - place[a:b] - spare), np.minimum(len(words), at[a:b] - place[a:b] + n + spare)
        reach = np.maximum.accumulate(hi)
        new = np.ones(b - a, bool)
        new[1:] = lo[1:] > reach[:-1]
        first = np.flatnonzero(new)
        best = (0.0, 0, 0)
        for x, y in zip(first, np.append(first[1:], b - a), strict=True):
            start = int(lo[x:y].min())
            score, s, e = align(words[start : int(hi[x:y].max())], item)
            if score > best[0]:
                best = (score, start + s, start + e)
            if best[0] >= 1:
                break
        if best[0] >= least:
            yield seeds.ids[owner[a]], *best


def seed_tables(texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id") -> Iterator:
    """Broadcast seeds of the benchmark, in passes of about PASS_BYTES."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col("text").isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // PASS_BYTES) or 1

    def part(k: int) -> list[tuple[int, np.ndarray]]:
        rows = sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect())  # about PASS_BYTES
        return [(i, w) for (i, _), w in zip(rows, _words(pa.array([t for _, t in rows], pa.string())), strict=True)]

    # the words of all passes are counted in one scan of the corpus
    wanted = np.empty(0, U)
    for k in range(passes):
        wanted = np.unique(np.concatenate([wanted, *[w for _, w in part(k)]]))
    if len(wanted):
        shares = word_shares(texts.select("text"), wanted)
        for k in range(passes):
            yield texts.sparkSession.sparkContext.broadcast(Seeds(part(k), wanted, shares))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", least: float = SCORE) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): each benchmark item that
    a document holds a whole, edited or paraphrased copy of.

    Words are runs of letters and digits in lower case. Every SEED-word
    sequence of an item is looked up at every position of every text; the
    words around a hit are aligned with the item, and the best alignment counts
    if its score is ``least`` of an unchanged copy's or more. Hits of rare seeds
    are aligned at once; those of other seeds are aligned if a bound from the
    words around them leaves the least score in reach, so none that counts is
    lost. Rarity is the product of the words' shares of the corpus, so a passage
    that was copied a million times keeps its seeds. Each document and item give one row at most:
    the best passage, the first of equals.

    Null and empty texts hold nothing; items of under SEED words, empty or null
    are never found; of items that repeat an id each counts by itself, and the
    best is kept. Rows that repeat a document give one row for each item; rows
    with a null id give none. Empty tables give no rows.

    The benchmark is broadcast in passes of PASS_BYTES; the corpus is read once
    for the words' shares and once a pass, and is not shuffled.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, score double, start_word int, end_word int"
    out = spark.createDataFrame([], schema)
    for shared in seed_tables(texts, benchmark, item_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = [(d, *m) for d, w in zip(batch.column(0).to_pylist(), _words(batch.column(1)), strict=True) for m in matches(w, shared.value, least)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.score", "m.start_word", "m.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", least: float = SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item;
    they are dropped where they are read."""
    at = docs.columns.index(text_col)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    out = docs
    for shared in seed_tables(texts, benchmark, item_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = [next(matches(w, shared.value, least), None) is None for w in _words(batch.column(at))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
