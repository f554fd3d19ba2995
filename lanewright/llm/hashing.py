"""Vectorised hashing of whole texts, bytes and word n-grams with numpy.

A batch of texts is one byte buffer plus offsets. A prefix sum of
``value(byte) * BASE**i`` (mod 2**64) gives the hash of any byte range in two
look-ups, so every word, shingle or window of a batch is hashed without a
Python loop over characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Texts are hashed in runs of about so many bytes, which bounds memory.
CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
#: Space and the five control characters from tab to carriage return.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1, 0 if have is None else 2 * len(have))
        steps = np.full(size, base, U)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes, without copying, so that
    what is worked out for a slice stays small."""
    for batch in batches:
        step = max(1, int(limit * batch.num_rows / max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first, last+1, bytes, offsets)."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Prefix:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((_FOLDED if fold else _VALUE)[data] * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(BASE_INV, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


#: Letters and digits, where every byte of a non-ASCII character counts as one.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[48:58] = IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def word_spans(data: np.ndarray, offs: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text (with an end mark).

    A word is a longest run without space, tab, line feed, vertical tab, form
    feed or carriage return, within one text; or of the bytes ``within`` marks.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~_IS_SPACE[data] if within is None else within[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offs[offs < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offs[offs > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lowered, and the first word of each text."""
    starts, ends, first = word_spans(data, offs, within)
    return mix(Prefix(data, fold=True).raw(starts, ends) + U(0x1D8E4E27C47D124F) * (ends - starts).astype(U)), first


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences of each text and the first of each text.

    A text of 1 to n-1 words has one sequence, the whole of it.
    """
    per_text = np.diff(first)
    counts = np.where(per_text >= n, per_text - n + 1, np.minimum(per_text, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=begin[1:])
    text = np.repeat(np.arange(len(per_text)), counts)
    at = np.arange(begin[-1]) - begin[text] + first[:-1][text]
    length = np.minimum(per_text, n)[text]
    out = np.zeros(len(at), U)
    for k in range(n):
        use = length > k
        out[use] += words[at[use] + k] * powers(0xD6E8FEB86659FD93, n + 1)[k + 1]
    return mix(out + length.astype(U) * U(0xA0761D6478BD642F)), begin
