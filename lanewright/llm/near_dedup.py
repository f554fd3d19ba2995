"""Near duplicates: an inverted join on MinHash signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import discard, keyed_rows, materialise, only_ids, without_ids
from lanewright.llm.components import connected_components
from lanewright.llm.hashing import U, buffers, chunks, mix, ngram_hashes, slices, word_hashes

#: Coordinates of a signature (a power of two: the coordinate's number takes
#: the low bits of a token, the least hash value the rest).
COORDINATES = 16
#: Lists of more documents are long: they are contracted around pivots before
#: what is left of them is compared.
BLOCK = 256
#: Documents of one cell of a long list, and shingles of them, on average.
CELL = 2048
CELL_SHINGLES = 1 << 20
#: Pivots of a long list. They only save comparisons: what they leave is
#: compared whole.
PIVOTS = 128
#: Links of one task that are made a forest at once, which bounds the links of
#: a node there.
FOREST = 20_000
#: A token is frequent if it stands in this share of all signatures. There are
#: COORDINATES / FREQUENT frequent tokens at most (16,000), which bounds the
#: broadcast to 256 KB.
FREQUENT = 1e-3
#: A pair at the similarity threshold is lost with this probability at most.
MISS = 1e-5

_rng = np.random.default_rng(77)
_XOR = _rng.integers(1, 1 << 63, COORDINATES, dtype=U)
_MUL = _rng.integers(1, 1 << 63, COORDINATES, dtype=U) | U(1)
_LAST = U(0xFFFFFFFFFFFFFFFF)


def least_collisions(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest m so that a pair of similarity ``percent`` agrees on fewer
    than m coordinates with a probability of ``miss`` at most."""
    p, tail, m = percent / 100, 0.0, 0
    while m < coordinates and (tail := tail + comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)) <= miss:
        m += 1
    return max(1, m)


def shingle_sets(texts, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text."""
    data, offs = buffers(texts)
    for _, _, part, at in chunks(data, offs):
        grams, begin = ngram_hashes(*word_hashes(part, at), n)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            yield np.unique(grams[a:b])


def signature(hashes: np.ndarray) -> np.ndarray:
    """Tokens of a non-empty shingle set: least value of each coordinate, and its number."""
    out = np.empty(COORDINATES, U)
    for a in range(0, len(hashes), 1 << 16):
        z = (hashes[a : a + (1 << 16), None] ^ _XOR) * _MUL
        z = ((z ^ (z >> U(32))) * U(0xD6E8FEB86659FD93)).min(axis=0)
        out = np.minimum(out, z) if a else z
    return (out & ~U(COORDINATES - 1)) | np.arange(COORDINATES, dtype=U)


def digest(hashes: np.ndarray) -> bytes:
    """Sixteen bytes that name a shingle set."""
    return np.array([hashes.sum(dtype=U), mix(hashes).sum(dtype=U)], U).tobytes()


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, digests, tokens = [], [], []
            for s in shingle_sets(batch.column(1), n):
                counts.append(len(s))
                digests.append(digest(s) if len(s) else None)
                tokens.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "n_shingles", "digest", "tokens"])

    return run


def _order(tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Keys of the global token order: frequent tokens last, by frequency."""
    if not len(hot):
        return tokens >> U(1)
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    return np.where(hot[at] == tokens, (U(1) << U(63)) + rank[at], tokens >> U(1))


def _post(hot: np.ndarray, rank: np.ndarray, prefix: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tokens = np.frombuffer(b"".join(f["tokens"]), U).reshape(-1, COORDINATES)
            first = np.argsort(_order(tokens, hot, rank), axis=1)[:, :prefix]
            again = {c: np.repeat(f[c].to_numpy(), prefix) for c in ("digest", "rep", "n_shingles")}
            yield pd.DataFrame({"token": np.take_along_axis(tokens, first, 1).ravel().view(np.int64)} | again)

    return run


def _like(size: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether set sizes allow for the similarity."""
    return 100 * np.minimum(size, other) >= percent * np.maximum(size, other)


def _matches(block: pd.DataFrame, hot: np.ndarray, rank: np.ndarray, least: int, percent: int) -> np.ndarray:
    """(x, y) positions in a block of the pairs that it has to confirm.

    A pair counts its collisions over the whole signature, and belongs to its
    first common token alone, so no pair is confirmed in two lists. Pairs of
    one class, and pairs whose set sizes rule the similarity out, are left.
    """
    tokens = np.frombuffer(b"".join(block["tokens"]), U).reshape(-1, COORDINATES)
    size, label = block["n_shingles"].to_numpy(), block["label"].to_numpy()
    key = _order(tokens, hot, rank)
    here = _order(np.array([block["token"].iat[0]], np.int64).view(U), hot, rank)[0]
    long = block["long"].iat[0]
    if long:
        # visitors meet the cell's own; two that both go visiting meet once
        visits, other = block["visits"].to_numpy(bool), block["other"].to_numpy(bool)
        name = np.unique(block["digest"].to_numpy(), return_inverse=True)[1]
        rows, columns = np.flatnonzero(visits), np.flatnonzero(~visits)
    else:
        rows = columns = np.arange(len(block))
    found = []
    for a in range(0, len(rows), 256):
        x = rows[a : a + 256]
        shape = len(x), len(columns)
        count, first = np.zeros(shape, np.uint8), np.full(shape, _LAST)
        for k in range(COORDINATES):
            same = tokens[x, k, None] == tokens[columns, k]
            count += same
            np.minimum(first, np.where(same, key[x, k, None], _LAST), out=first)
        ok = (count >= least) & (first == here) & (label[x, None] != label[columns])
        ok &= _like(size[x, None], size[columns], percent)
        ok &= (~other[columns] | (name[x, None] < name[columns])) if long else (x[:, None] < columns)
        at = np.argwhere(ok)
        found.append(np.stack([x[at[:, 0]], columns[at[:, 1]]], 1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of a sorted partition, across its batches."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        values = [f[k].to_numpy() for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        edges = [0, *cut.tolist(), len(f)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = f.iloc[a:b]
            if a == 0 and held and all(held[-1][k].iat[0] == part[k].iat[0] for k in keys):
                held.append(part)
                continue
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


_KEYS = ["token", "i", "j"]
_BLOCK = "token long, i int, j int, long boolean, visits boolean, other boolean, digest binary, rep long, label long, n_shingles long, tokens binary"


def _collide(hot: np.ndarray, rank: np.ndarray, least: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, rows = [], 0
        for block in _groups(frames, _KEYS):
            if len(block) < 2:
                continue
            pairs = _matches(block, hot, rank, least, percent)
            if len(pairs):
                ready.append(block.iloc[np.unique(pairs)])
                rows += len(ready[-1])
                if rows > 5000:
                    yield pd.concat(ready)
                    ready, rows = [], 0
        if ready:
            yield pd.concat(ready)

    return run


_MET = "token long, cell int, digest binary, rep long, label long, pivot boolean, n_shingles long"


def _meet(least: int, percent: int):
    """The documents of a cell that may be like one of its pivots, and those pivots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _groups(frames, ["token", "cell"]):
            pairs = _pivot_pairs(cell, percent)
            if len(pairs):
                tokens = np.frombuffer(b"".join(cell["tokens"]), U).reshape(-1, COORDINATES)
                pairs = pairs[(tokens[pairs[:, 0]] == tokens[pairs[:, 1]]).sum(axis=1) >= least]
            if len(pairs):
                yield cell.drop(columns="tokens").iloc[np.unique(pairs)]

    return run


def _pivot_pairs(cell: pd.DataFrame, percent: int) -> np.ndarray:
    size, label, pivot = cell["n_shingles"].to_numpy(), cell["label"].to_numpy(), cell["pivot"].to_numpy(bool)
    x, y = np.flatnonzero(~pivot), np.flatnonzero(pivot)
    at = np.argwhere((label[x][:, None] != label[y]) & _like(size[x][:, None], size[y], percent))
    return np.stack([x[at[:, 0]], y[at[:, 1]]], 1)


def _confirm_stars(percent: int):
    """Links between the documents of a cell and its pivots: (document, pivot),
    and (pivot, pivot) where a document links two."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _groups(frames, ["token", "cell"]):
            yield _forest(list(_linked(cell, _pivot_pairs(cell, percent), percent)), set(cell.loc[cell["pivot"], "rep"].tolist()))

    return run


def _linked(block: pd.DataFrame, pairs: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """The ids of the pairs whose full sets are similar."""
    if not len(pairs):
        return iter(())
    sets = [np.frombuffer(s, U) for s in block["shingles"]]
    size, reps = block["n_shingles"].to_numpy(), block["rep"].to_numpy()
    both = _shared(sets, pairs)
    links = pairs[100 * both >= percent * (size[pairs[:, 0]] + size[pairs[:, 1]] - both)]
    return zip(reps[links[:, 0]].tolist(), reps[links[:, 1]].tolist(), strict=True)


def _shared(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    if len(pairs) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in pairs], np.int64)
    # many pairs: matrix products over the shingles that two sets or more have
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    where, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    rank = np.cumsum(many > 1) - 1
    use = many[where] > 1
    row, col = row[use], rank[where[use]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    (x, left), (y, right) = (np.unique(pairs[:, k], return_inverse=True) for k in (0, 1))
    out = np.zeros((len(x), len(y)), np.float32)
    width = 1024
    for a in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        lo, hi = np.searchsorted(col, [a, a + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        out += m[x] @ m[y].T
    return out[left, right].astype(np.int64)


def _forest(edges: list[tuple[int, int]], centres: set[int] = frozenset()) -> pd.DataFrame:
    """The same components with at most one edge (a, b) a node: b is the least
    of the component's ``centres``, if it has any, else its least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for x, y in edges:
        x, y = root(x), root(y)
        if x != y:
            x, y = sorted((x, y), key=lambda k: (k not in centres, k))
            parent[y] = x
    return pd.DataFrame([(x, root(x)) for x in parent if root(x) != x], columns=["a", "b"], dtype=np.int64)


def _confirm(hot: np.ndarray, rank: np.ndarray, least: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges: list[tuple[int, int]] = []
        for block in _groups(frames, _KEYS):
            edges += _linked(block, _matches(block, hot, rank, least, percent), percent)
            if len(edges) > FOREST:
                yield _forest(edges)
                edges = []
        yield _forest(edges)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, sets, total = [], [], 0
            for s in shingle_sets(batch.column(0), n):
                names.append(digest(s))
                sets.append(s.tobytes())
                total += len(sets[-1])
                if total > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])
                    names, sets, total = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    return run


def _sets_of(rows: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(digest, shingles) of the texts of ``ids``, once each."""
    return only_ids(rows, materialise(ids, "involved"), "doc_id").select("text").mapInArrow(_sets(shingle), "digest binary, shingles binary").dropDuplicates(["digest"])


def _cell(cells: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(salt)), F.col(cells)).cast("int")


def _cells(n: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(n / F.lit(CELL), shingles / F.lit(CELL_SHINGLES))).cast("int")


def star_links(rows: DataFrame, reps: DataFrame, big: DataFrame, least: int, percent: int, shingle: int) -> DataFrame:
    """(a, b) links from documents of long lists to pivots of these lists: true
    links, but not all of them.

    Each document goes to one of its long lists, by a hash of the token that
    like documents agree on. PIVOTS documents of a list, spread by hash, are
    copied to all its cells and are compared on full sets with the documents
    there, so a document carries its set once.
    """
    signed, columns = reps.select("digest", "tokens"), [c.split()[0] for c in _MET.split(", ")]
    big = big.withColumn("cells", _cells(F.col("n"), F.col("v"))).withColumn("label", F.col("rep"))
    row = F.struct("rep", "label", "n_shingles", "token", "cells")
    near = big.groupBy("digest").agg(F.min_by(row, F.xxhash64("token")).alias("p")).join(signed, "digest")
    near = near.select("digest", "tokens", "p.*").select("*", _cell("cells", 7).alias("cell"), F.lit(False).alias("pivot"))
    seat = F.pmod(F.xxhash64("digest", F.lit(100)), F.lit(PIVOTS))
    seats = big.groupBy("token", seat).agg(F.min_by(F.struct("digest", "rep", "label", "n_shingles", "cells"), F.xxhash64("digest", F.lit(200))).alias("p"))
    seats = seats.select("token", "p.*").join(signed, "digest")
    pivots = seats.select("*", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(True).alias("pivot"))
    met = near.unionByName(pivots).select(*columns, "tokens").repartition("token", "cell").sortWithinPartitions("token", "cell")
    met = materialise(met.mapInPandas(_meet(least, percent), _MET), "met")
    full = met.join(_sets_of(rows, met.select(F.col("rep").alias("doc_id")).distinct(), shingle), "digest")
    full = full.repartition("token", "cell").sortWithinPartitions("token", "cell")
    return full.mapInPandas(_confirm_stars(percent), "a long, b long")


def blocks(posts: DataFrame, lists: DataFrame, reps: DataFrame, big: DataFrame | None) -> DataFrame:
    """Rows of the groups whose pairs are compared, see _BLOCK.

    A list of BLOCK rows or less is a group. Of a longer list the rows outside
    its largest class visit its cells, about CELL at a time. A long list of one
    class has no rows.
    """
    whole = [F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("long"), F.lit(False).alias("visits"), F.lit(True).alias("other")]
    out = posts.join(lists.where(F.col("n") <= BLOCK), "token").select("token", "digest", *whole)
    if big is not None:
        tagged = big.join(reps.select("digest", "label"), "digest")
        sizes = tagged.groupBy("token", "label").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
        top = F.max(F.struct("m", "label", "w")).alias("t")
        open_ = sizes.groupBy("token").agg(F.sum("m").alias("n"), F.sum("w").alias("v"), top, F.count("*").alias("labels")).where("labels > 1")
        open_ = open_.select("token", F.col("t.label").alias("top"), _cells(F.col("n"), F.col("v")).alias("cells"), _cells(F.col("n") - F.col("t.m"), F.col("v") - F.col("t.w")).alias("seats"))
        long = tagged.join(open_, "token").withColumn("other", F.col("label") != F.col("top"))
        every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        place = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), F.lit(v).alias("visits"))
        home = F.transform(every("seats"), lambda j: place(_cell("cells", 5), j, False))
        away = F.when(F.col("other"), F.transform(every("cells"), lambda i: place(i, _cell("seats", 6), True))).otherwise(F.array())
        long = long.withColumn("at", F.explode(F.concat(home, away)))
        out = out.unionByName(long.select("token", "digest", "at.i", "at.j", F.lit(True).alias("long"), "at.visits", "other"))
    return out.join(reps, "digest").select(*[c.split()[0] for c in _BLOCK.split(", ")])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``shingle``-word shingles have a Jaccard
    similarity of ``percent`` or more are linked; component_id is the smallest
    doc_id that can be reached over links and kept marks that document.
    A text of fewer words is one shingle; a text without words, empty or null
    is linked with nothing, and kept. Rows with a null id get n_shingles and a
    null component and are kept. Rows that repeat an id are one document: a
    link of any of their texts counts. No rows give no rows; other columns are
    not read.

    1. Each set is signed by the least hash of COORDINATES hash functions.
       Equal sets are one representative from here on, so exact copies,
       however many, are never compared.
    2. A representative is posted under each (coordinate, value) token of its
       prefix. Two signatures that agree on m coordinates share a token among
       the first COORDINATES - m + 1 of any global order of tokens; frequent
       tokens come last in it, so long lists are skipped where that loses
       nothing. ``least_collisions`` sets m.
    3. Lists over BLOCK documents, as large groups of near copies make them,
       are contracted: documents are confirmed against pivots of their list,
       and linked ones are a class from here on (``star_links``).
    4. Lists of one document, and long lists of one class, are dropped before
       signatures travel. A group counts the collisions of its pairs of
       different classes and retains documents with a match (``blocks``).
    5. Retained pairs are confirmed on full shingle sets, each pair in the
       list of its first common token only.
    6. Links become components in rounds of joins.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(rows.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, digest binary, tokens binary"), "signed")
    sets = signed.where("digest is not null and doc_id is not null").groupBy("digest")
    reps = materialise(sets.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")), "reps")
    least = least_collisions(percent)
    hot, rank = frequent_tokens(reps)

    post = _post(hot, rank, COORDINATES - least + 1)
    posts = materialise(reps.select("digest", "rep", "n_shingles", "tokens").mapInPandas(post, "token long, digest binary, rep long, n_shingles long"), "posts")
    lists = posts.groupBy("token").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("v")).where("n > 1")
    big = materialise(posts.join(lists.where(F.col("n") > BLOCK), "token"), "long")
    labelled, stars = reps.withColumn("label", F.col("rep")), None
    if big.isEmpty():
        big = None
    else:
        stars = materialise(star_links(rows, reps, big, least, percent, shingle), "stars")
        # pivots of one document hang on the least of them; two steps up name the class
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        up = stars.join(low, "a").where("b <> m").select(F.col("b").alias("a"), "m").unionByName(low)
        one = up.groupBy(F.col("a").alias("rep")).agg(F.min("m").alias("b"))
        two = one.join(one.select(F.col("rep").alias("b"), F.col("b").alias("c")), "b", "left").select("rep", F.coalesce("c", "b").alias("label"))
        labelled = materialise(reps.join(two, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "classes")

    dealt = blocks(posts, lists, labelled, big).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "digest")
    retained = materialise(dealt.mapInPandas(_collide(hot, rank, least, percent), _BLOCK), "retained")

    full = retained.join(_sets_of(rows, retained.select(F.col("rep").alias("doc_id")).distinct(), shingle), "digest")
    full = full.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "digest")
    links = full.mapInPandas(_confirm(hot, rank, least, percent), "a long, b long")
    if stars is not None:
        links = links.unionByName(stars)
    reached = connected_components(links, "near").withColumnRenamed("node", "rep")
    for table in (posts, retained, *(() if stars is None else (big, stars, labelled))):
        discard(table)

    named = reps.join(reached, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = signed.join(named, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def frequent_tokens(reps: DataFrame, share: float = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that stand in ``share`` of the signatures, in order, and their
    ranks by frequency. There are COORDINATES / share of them at most."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"token": np.frombuffer(b"".join(f["tokens"]), np.int64)})

    many = reps.select("tokens").mapInPandas(spread, "token long").groupBy("token").agg(F.count("*").alias("n"))
    found = many.where(F.col("n") >= max(8, int(reps.count() * share))).collect()
    found = sorted((r["n"], r["token"]) for r in found)
    tokens = np.array([t for _, t in found], np.int64).view(U)
    by = np.argsort(tokens)
    return tokens[by], by.astype(U)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each
    group, that of the smallest id (null ids last), and rows without words.

    If an id is null or repeated, rows are numbered in order of (id, row hash)
    first, which sorts the documents once, and groups are those of numbers; so
    repeated rows and rows without an id are judged like others.
    """
    plain, names, key = keyed_rows(docs, id_col)
    gone = near_duplicates(plain, key, names[docs.columns.index(text_col)], shingle, percent).where("not kept").select(F.col("doc_id").alias(key))
    return without_ids(plain, materialise(gone, "gone"), key).select(*names).toDF(*docs.columns)
