"""Token counts by a two-tier look-up of pre-token lengths."""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Entries of the broadcast table, and the longest pre-token in it.
FREQUENT = 50_000
LONGEST = 48
#: Rows of the sample that fills the table, as expected of a draw row by row
#: (which equal texts do not sway), and bytes of a row at most. The table only
#: saves time: counts do not depend on it.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 1 << 20
#: Entries of a worker's cache of misses before it starts afresh (about 60 MB).
CACHE = 400_000

# Fixed value: the pre-tokenizer pattern of byte-level BPE.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Characters whose class does not depend on a library's Unicode version. A text
# with any other is left to the tokenizer as a whole.
UNSURE = regex.compile("[^\\t\\n\\r\\x20-\\x7e\\xa0-\\u024f\\u0391-\\u03a1\\u03a3-\\u03ff\\u0410-\\u044f\\u2010-\\u2027\\u20ac]")


class Counts(dict):
    """Pre-token -> number of tokens: the broadcast table, then own misses."""

    def __init__(self, kind: str, model: bytes, frequent: dict[str, int]):
        super().__init__(frequent)
        self.kind, self.frequent = kind, frequent
        if kind == "json":
            self.tokenizer = Tokenizer.from_str(model.decode())
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            spec = json.loads(model)
            pre = spec.get("pre_tokenizer") or {}
            # only the plain byte-level scheme takes pieces apart as PRE_TOKENS does
            self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            special = [t["content"] for t in spec.get("added_tokens", [])]
            self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        else:
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_proto=model)
            self.plain, self.special = False, None

    def whole(self, text: str) -> int:
        if self.kind == "json":
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return len(self.tokenizer.encode(text, num_threads=1))

    def __missing__(self, piece: str) -> int:
        n = self.whole(piece)
        if len(piece) <= LONGEST:
            if len(self) > len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.plain or UNSURE.search(text) or (self.special and self.special.search(text)):
            return self.whole(text)
        if len(text) < 1 << 20:
            return sum(map(self.__getitem__, PRE_TOKENS.findall(text)))
        return sum(self[m[0]] for m in PRE_TOKENS.finditer(text))


@functools.lru_cache(2)
def _counts(kind: str, model: bytes, packed: str) -> Counts:
    pieces, _, lengths = packed.rpartition("\x00\x00")
    frequent = dict(zip(pieces.split("\x00"), lengths.encode("latin-1"), strict=True)) if pieces else {}
    return Counts(kind, model, frequent)


def frequent_lengths(docs: DataFrame, text_col: str, counts: Counts) -> str:
    """The FREQUENT most frequent pre-tokens of a bounded sample with their
    numbers of tokens, packed: pieces between zero characters, then lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(p for p in PRE_TOKENS.findall(text) if len(p) <= LONGEST and "\x00" not in p)
        top = seen.most_common(2 * FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    text = F.col(text_col)
    sample = docs.select(text.alias("text")).sample(share, seed=17).where(F.octet_length("text") <= SAMPLE_BYTES)
    top = sample.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT)
    table = {r["piece"]: counts.whole(r["piece"]) for r in top.collect()}  # at most FREQUENT rows
    table = {p: n for p, n in table.items() if n < 256}
    return "\x00".join(table) + "\x00\x00" + "".join(map(chr, table.values())) if table else ""


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Tokens are those that the library of the tokenizer file (tokenizers for
    .json, sentencepiece for .model) gives for the whole text, without begin,
    end or added special tokens; special strings inside a text are handled as
    the library does by default. A null text is empty and has 0 tokens. Rows
    that repeat an id are counted each; no rows give no rows.

    The file's bytes (1-2 MB) and a table of frequent pre-tokens (at most
    FREQUENT entries, under 1 MB) are broadcast. A text is cut into
    pre-tokens, whose lengths come from that table, else from the worker's
    cache, else from the library; no pre-token is shuffled to be counted.
    """
    spark = docs.sparkSession
    kind = "json" if tokenizer.endswith(".json") else "model"
    model = Path(tokenizer).read_bytes()
    counts = Counts(kind, model, {})
    packed = frequent_lengths(docs, text_col, counts) if counts.plain else ""
    shared = spark.sparkContext.broadcast((kind, model, packed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _counts(*shared.value)
        for batch in batches:
            n = [table.count(t) for t in (x.as_py() or "" for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), size.alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
