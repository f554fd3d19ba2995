"""Repeated byte strings by prefix doubling over sampled positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import keyed_rows, materialise, only_ids
from lanewright.llm.hashing import CHUNK_BYTES, Prefix, U, buffers, chunks, mix, slices

#: Bytes of the first rank; the sampled position carries it.
FIRST = 32
#: Positions of one piece take so many low bits in the comparison of ranks.
PIECE_BITS = 20
#: Bytes of text whose equal contexts are settled before the shuffle.
SLICE = 8 << 20
#: Contexts of one first rank that are compared in one task; more are dealt.
GROUP = 20_000


def sampled(part: np.ndarray, offs: np.ndarray, length: int, first: int) -> tuple[np.ndarray, ...]:
    """Anchors of one piece: text, lowest and highest window start, position, rank, context.

    Each window of ``length`` bytes within a text picks the position in it at
    which the hash of ``first`` bytes is least (the leftmost of equals). Equal
    windows pick alike, so the anchors are a sample that any two equal windows
    share. The context of an anchor is the bytes that all windows which picked
    it cover.
    """
    n = len(part)
    prefix = Prefix(part)
    at = np.arange(n - first + 1)
    rank = mix(prefix.raw(at, at + first))
    least = (rank & ~U((1 << PIECE_BITS) - 1)) | at.astype(U)
    span, width = 1, length - first + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    picked = (least & U((1 << PIECE_BITS) - 1)).astype(np.int64)
    start = np.arange(len(picked))
    text = np.searchsorted(offs, start, "right") - 1
    inside = start + length <= offs[text + 1]
    start, picked, text = start[inside], picked[inside], text[inside]
    if not len(start):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, U),) * 2
    new = np.ones(len(start), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(start)) - 1
    lo, hi, anchor = start[a], start[b], picked[a]
    context = mix(prefix.raw(lo, hi + length) + (anchor - lo).astype(U) * U(0x9E3779B97F4A7C15) + (hi - lo).astype(U) * U(0xC2B2AE3D27D4EB4F))
    return text[a], lo, hi, anchor, rank[anchor], context


def pieces(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, shift of its positions, bytes, offsets); a long text comes in
    pieces that overlap by ``length`` - 1 bytes, so each window is in one."""
    most = CHUNK_BYTES - 1
    for a, _, part, at in chunks(data, offs, most):
        if len(part) <= most:
            yield a, 0, part, at
            continue
        for shift in range(0, len(part) - length + 1, most - length + 1):
            piece = part[shift : shift + most]
            yield a, shift, piece, np.array([0, len(piece)])


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one document that touch become one."""
    by = np.lexsort((lo, doc))
    doc, lo, hi = doc[by], lo[by], hi[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)
    a = np.flatnonzero(new)
    return doc[a], lo[a], hi[np.append(a[1:], len(doc)) - 1] if len(a) else hi[:0]


_RANKS = "rank long, context long, doc long, at long, lo long, hi long"


def _rank_batches(length: int, first: int):
    """Rows of anchors. Contexts that stand earlier in the slice are known
    repeats: they come as ranges (at = -1), the others once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offs = buffers(batch.column(1))
            found = []
            for a, shift, part, at in pieces(data, offs, length):
                if len(part) >= length:
                    text, lo, hi, anchor, rank, context = sampled(part, at, length, first)
                    base = shift - at[text]
                    found.append((ids[a + text], lo + base, hi + base, anchor + base, rank, context))
            if not found:
                continue
            doc, lo, hi, anchor, rank, context = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((anchor, doc, context))
            doc, lo, hi, anchor, rank, context = (x[by] for x in (doc, lo, hi, anchor, rank, context))
            seen = np.zeros(len(doc), bool)
            seen[1:] = context[1:] == context[:-1]
            rd, rl, rh = _merged(doc[seen], lo[seen], hi[seen])
            new = ~seen
            columns = (
                np.concatenate([rank[new].view(np.int64), mix(rd.astype(U)).view(np.int64)]),
                np.concatenate([context[new].view(np.int64), np.zeros(len(rd), np.int64)]),
                np.concatenate([doc[new], rd]),
                np.concatenate([anchor[new], np.full(len(rd), -1)]),
                np.concatenate([lo[new], rl]),
                np.concatenate([hi[new], rh]),
            )
            for a in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in columns], ["rank", "context", "doc", "at", "lo", "hi"])

    return run


_CONTEXTS = "rank long, deal int, dealt boolean, doc long, at long, lo long, hi long, bytes binary"


def _cut(length: int):
    """The bytes of the listed contexts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            size = 0
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer()
                for w in wanted.as_py():
                    cut = raw[w["lo"] : w["hi"] + length].to_pybytes()
                    for column, value in zip(out, (w["rank"], w["deal"], w["dealt"], doc, w["at"], w["lo"], w["hi"], cut), strict=True):
                        column.append(value)
                    size += len(cut)
                if size > 1 << 22:
                    yield _contexts(out)
                    out, size = [[] for _ in range(8)], 0
            yield _contexts(out)

    return run


def _contexts(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rank", "deal", "dealt", "doc", "at", "lo", "hi", "bytes"])


_WINDOWS = "name long, doc long, lo long, hi long, settled boolean"


def _second_ranks(length: int):
    """Ranks the full windows of contexts that share a first rank.

    Input is sorted by rank. All windows of a rank that was not dealt meet
    here, so the later ones of equal windows are repeats. Of a dealt rank the
    first ones go on, by name, and the rest are repeats already.
    """

    def judge(t: pa.Table) -> pa.RecordBatch:
        rank, doc, at, lo, hi = (t.column(c).to_numpy() for c in ("rank", "doc", "at", "lo", "hi"))
        dealt = t.column("dealt").to_numpy(zero_copy_only=False).astype(bool)
        data, offs = buffers(t.column("bytes").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        many = hi - lo + 1
        row = np.repeat(np.arange(len(many)), many)
        step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        begin, start = offs[row] + step, lo[row] + step
        # a window that equals another has its anchor at the same distance
        name = mix(Prefix(data).raw(begin, begin + length) + mix(rank[row].view(U)) + (at[row] - start).astype(U) * U(0x9E3779B97F4A7C15))
        by = np.lexsort((start, doc[row], name))
        name, row, start = name[by], row[by], start[by]
        later = np.zeros(len(name), bool)
        later[1:] = name[1:] == name[:-1]
        rd, rl, rh = _merged(doc[row[later]], start[later], start[later])
        on = ~later & dealt[row]
        columns = (
            pa.array(np.concatenate([np.zeros(len(rd), np.int64), name[on].view(np.int64)])),
            pa.array(np.concatenate([rd, doc[row[on]]])),
            pa.array(np.concatenate([rl, start[on]])),
            pa.array(np.concatenate([rh, start[on]])),
            pa.array(np.concatenate([np.ones(len(rd), bool), np.zeros(int(on.sum()), bool)])),
        )
        return pa.RecordBatch.from_arrays(list(columns), ["name", "doc", "lo", "hi", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= 20_000:
                t = pa.Table.from_batches(held)
                rank = t.column("rank").to_numpy()
                cut = int(np.searchsorted(rank, rank[-1]))  # the last rank may go on
                if cut:
                    yield judge(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    size = t.num_rows - cut
        if held:
            yield judge(pa.Table.from_batches(held))

    return run


_SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def spans_of(n: int, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest runs of bytes covered by windows that start in lo..hi."""
    if not len(lo):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by = np.argsort(lo, kind="stable")
    lo, end = lo[by], np.maximum.accumulate(hi[by] + length)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    a = np.flatnonzero(new)
    return lo[a], end[np.append(a[1:], len(lo)) - 1]


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offs = buffers(batch.column(1))
            out: list[list] = [[] for _ in range(7)]
            ranges = batch.column(2)
            flat = ranges.flatten()
            lo, hi = (flat.field(k).to_numpy() for k in (0, 1))
            ends = np.cumsum(np.where(ranges.is_null().to_numpy(zero_copy_only=False), 0, ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                raw = data[offs[k] : offs[k + 1]]
                a, b = (ends[k - 1] if k else 0), ends[k]
                s, e = spans_of(len(raw), lo[a:b], hi[a:b], length)
                if len(s):
                    kept = hashlib.sha256()
                    for x, y in zip(np.append(0, e), np.append(s, len(raw)), strict=True):
                        kept.update(raw[x:y])
                else:
                    kept = hashlib.sha256(raw)
                values = (doc, len(raw), int((e - s).sum()), len(s), kept.hexdigest(), s.tolist(), e.tolist())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, first: int = FIRST) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    and the removed byte ranges as starts and ends (end exclusive).

    A byte is removed if a string of ``length`` bytes that covers it also
    starts earlier: in a document of a smaller id, or earlier in the same one.
    Strings are judged on the input, and lie within one document. A null text
    is empty; texts under ``length`` bytes lose nothing. If an id is null or
    repeated, every row is a document of its own, in order of (id, row hash),
    null ids last. No rows give no rows; other columns are not read.

    Prefix doubling ranks the strings that start at a position by ever longer
    prefixes, and drops what is unique. Here positions are sampled first (see
    ``sampled``), for a table of every byte position would be some twenty
    times the input.

    1. Spark sorts (rank of ``first`` bytes, context, document, position) rows
       of the sample. A rank with one context is settled: its windows are new
       at the first place of the context and repeats at all others. Equal
       contexts of one slice are settled before the shuffle, so a text copied
       into a third of all rows sends one row a slice.
    2. Contexts that share their first rank with other contexts get the next
       rank, of all ``length`` bytes, for each window: texts are read again
       for those contexts only, sorted by rank, and windows are named and
       compared. A rank with over GROUP contexts is dealt to many tasks, whose
       first windows are aggregated by name.
    3. Ranges of repeats meet their texts in one join.

    Ranks are 64-bit names; contexts are equal if 128 bits agree.
    """
    return _with_ranges(docs, id_col, text_col, length, first).mapInArrow(_apply(length), _SPANS)


def _with_ranges(docs: DataFrame, id_col: str, text_col: str, length: int, first: int) -> DataFrame:
    """(doc_id, text, ranges): the first places (lo, hi) of repeated strings."""
    plain, (own, text), key = keyed_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id")
    rows = plain.select(F.col(key).alias("doc_id"), F.col(own).alias("own"), F.col(text).alias("text"))
    clear = rows.select("doc_id", "text")
    ranks = clear.where(F.octet_length("text") >= length).mapInArrow(_rank_batches(length, first), _RANKS).repartition("rank")
    known = F.col("at") < 0
    place = F.row_number().over(Window.partitionBy("rank", "context").orderBy("doc", "at"))
    contexts = F.count_if((F.col("place") == 1) & ~known).over(Window.partitionBy("rank"))
    placed = ranks.withColumn("place", place).withColumn("repeat", known | (F.col("place") > 1)).withColumn("contexts", contexts)
    # a first place is of interest only if its windows may stand elsewhere
    placed = placed.where("repeat or contexts > 1")
    once = lambda c: F.when(~F.col("repeat"), F.col(c)).alias(c)
    settled = materialise(placed.select(once("rank"), "doc", "at", "lo", "hi", "repeat", once("contexts")), "ranks")

    open_ = settled.where("not repeat")
    deals = F.ceil(F.col("contexts") / F.lit(GROUP)).cast("int")
    wanted = open_.select("doc", F.struct("rank", F.pmod(F.xxhash64("doc", "at"), deals).cast("int").alias("deal"), (deals > 1).alias("dealt"), "at", "lo", "hi").alias("w"))
    wanted = wanted.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("w").alias("wanted"))
    ids = materialise(open_.select(F.col("doc").alias("doc_id")).distinct(), "open")
    again = only_ids(clear, ids, "doc_id")
    contexts = again.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_cut(length), _CONTEXTS)
    contexts = contexts.repartition("rank", "deal").sortWithinPartitions("rank", "deal")
    windows = materialise(contexts.mapInArrow(_second_ranks(length), _WINDOWS), "windows")
    named = windows.where("not settled")
    least = named.groupBy("name").agg(F.min(F.struct("doc", "lo")).alias("least"))
    late = named.join(least, "name").where(F.struct("doc", "lo") != F.col("least")).select("doc", "lo", "hi")

    repeats = settled.where("repeat").select("doc", "lo", "hi").unionByName(windows.where("settled").select("doc", "lo", "hi")).unionByName(late)
    by_doc = repeats.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return rows.join(by_doc, "doc_id", "left").select(F.col("own").alias("doc_id"), "text", "ranges")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(doc_id, text): each row's text without its repeated strings. A character
    that loses some of its bytes goes as a whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                lo, hi = (np.array([r[c] for r in ranges or []], np.int64) for c in ("lo", "hi"))
                starts, ends = spans_of(len(raw), lo, hi, length)
                kept = b"".join(raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)], strict=True))
                out.append(kept.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return _with_ranges(docs, id_col, text_col, length, FIRST).mapInArrow(cut, "doc_id long, text string")
