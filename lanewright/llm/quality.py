"""Text quality by a naive-Bayes support vector machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.hashing import Prefix, buffers, chunks, slices, word_spans

#: Features are hashed into 2**BITS numbers, which bounds all that is counted,
#: sent to the driver and broadcast (4 MB).
BITS = 18
#: Labelled rows to learn from at most, by least id hash. It bounds the ids that
#: are broadcast to pick their texts map-side (under 2 MB).
LABELLED_ROWS = 100_000
#: Of these, rows that the margin is fitted on, and calibrated on, at most; the
#: log-count ratios use them all.
FIT_ROWS = 6_000
CALIBRATE_ROWS = 3_000
#: Passes of dual coordinate descent, and the cost of a hinge loss.
PASSES = 12
COST = 1.0
SMOOTH = 1.0

_MUL = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - BITS)
#: Class of a byte: lower, upper, digit, part of a non-ASCII letter, other.
_CLASS = np.full(256, 4, np.uint32)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_SHARES = np.array([0.01, 0.05, 0.2, 0.5, 0.8])


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * _MUL
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return (x * _MUL) >> _SHIFT


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A small number for the look of each word: how it begins and ends, its
    length, whether it is all capitals, whether it repeats the last ones."""
    begin, last = data[starts], data[ends - 1].astype(np.uint32)
    kind = _CLASS[last]
    end = np.where(kind < 4, kind, last + 4)
    lower = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLASS[data] == 0, out=lower[1:])
    capital = (lower[ends] == lower[starts]) & (_CLASS[begin] == 1) & (ends - starts > 1)
    hashes = Prefix(data).raw(starts, ends)
    again = np.zeros(len(starts), np.uint32)
    for back in (2, 1):
        if len(starts) > back:
            same = np.zeros(len(starts), bool)
            same[back:] = hashes[back:] == hashes[:-back]
            for k in range(back):
                at = first[:-1] + k
                same[at[at < len(same)]] = False
            again[same] = back
    size = np.minimum((ends - starts) // 4, 6).astype(np.uint32)
    return (((end * 5 + _CLASS[begin]) * 7 + size) * 2 + capital) * 3 + again


def features(texts) -> Iterator[np.ndarray]:
    """The sorted feature numbers of each text: indicators of three-byte
    sequences, of one and two word shapes, and of the share that a shape has.

    Only the text is looked at. An empty text has none.
    """
    data, offs = buffers(texts)
    for _, _, part, at in chunks(data, offs):
        wide = part.astype(np.uint32)
        grams = _hashed(wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16)), 1) if len(part) > 2 else np.empty(0, np.uint32)
        starts, ends, first = word_spans(part, at)
        shapes = _shapes(part, starts, ends, first) if len(starts) else np.empty(0, np.uint32)
        one = _hashed(shapes, 2)
        two = _hashed(shapes[:-1] * np.uint32(65537) + shapes[1:], 3) if len(shapes) else one
        for k in range(len(at) - 1):
            a, b, x, y = at[k], at[k + 1], first[k], first[k + 1]
            found = [grams[a : max(a, b - 2)], two[x : max(x, y - 1)]]
            if y > x:
                kinds, where, counts = np.unique(one[x:y], return_index=True, return_counts=True)
                share = np.searchsorted(_SHARES, counts / (y - x)).astype(np.uint32)
                found += [kinds, _hashed(shapes[x:y][where] * np.uint32(8) + share, 4)]
                # how much of the text repeats the word before
                found.append(_hashed(np.searchsorted(_SHARES, [(shapes[x:y] % 3 > 0).mean()]).astype(np.uint32), 5))
            yield np.unique(np.concatenate(found))


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = weights over
    the features, divided by the length of the ratio vector, plus bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    @property
    def fitted(self) -> bool:
        """Whether there were rows of both classes to learn from."""
        return bool(self.weights.any())

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum(dtype=np.float64) / max(1e-9, np.sqrt(self.squares[x].sum(dtype=np.float64)))) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30))))


def log_ratios(rows: DataFrame) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of each feature: p and q count the rows of
    label 1 and 0 that have it, plus SMOOTH, over all rows (text, label).

    Each task sums its rows into one vector and sends the features it saw.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in slices(batches):
            for x, label in zip(features(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen[label][x] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0][at]), pa.array(seen[1][at])], ["feature", "zeros", "ones"])

    sums = rows.mapInArrow(count, "feature long, zeros long, ones long").groupBy("feature").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    p, q = np.full(1 << BITS, SMOOTH), np.full(1 << BITS, SMOOTH)
    for r in sums.toLocalIterator():  # 2**BITS rows at most
        p[r["feature"]] += r["ones"]
        q[r["feature"]] += r["zeros"]
    return np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)


def descend(rows: list[tuple[np.ndarray, int]], ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss on unit ratio vectors.

    One dual variable a row, visited in a seeded random order; the bias is one
    more feature of value 1.
    """
    vectors = []
    for x, _ in rows:
        v = ratios[x].astype(np.float64)
        vectors.append(v / max(1e-9, np.sqrt(v @ v)))
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(5)
    for _ in range(PASSES):
        for k in rng.permutation(len(rows)):
            (x, label), v = rows[k], vectors[k]
            sign = 1 if label else -1
            slope = sign * (weights[x] @ v + bias) - 1 + alpha[k] / (2 * COST)
            new = max(0.0, alpha[k] - slope / (v @ v + 1 + 1 / (2 * COST)))
            if (step := (new - alpha[k]) * sign) != 0:
                weights[x] += step * v
                bias += step
            alpha[k] = new
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with targets
    drawn in from 0 and 1; the identity if there is a single class."""
    ones, zeros = int(labels.sum()), int((labels == 0).sum())
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * w * [1, 0]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w = w - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, text, label); label is 0 or 1.

    Rows without a label or with a null text are left out. With no rows, or of
    one class only, the margin is constant and scores are the class's share.
    """
    order = F.xxhash64("doc_id", F.lit(3)).alias("order")
    rows = labelled.where("label in (0, 1) and text is not null").select(order, "text", F.col("label").cast("int").alias("label"))
    ratios = log_ratios(rows.select("text", "label"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [f.astype(np.int32).tobytes() for f in features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "label"])

    # the bounded sample: distinct rows of least hash, found by their hashes alone
    own = rows.select(F.struct("order", F.xxhash64("text").alias("text"), "label").alias("own"), "text", "label")
    last = own.select("own").distinct().orderBy("own").limit(FIT_ROWS + CALIBRATE_ROWS).agg(F.max("own").alias("own"))
    chosen = own.alias("o").join(F.broadcast(last.alias("l")), F.col("o.own") <= F.col("l.own")).groupBy("o.own").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    chosen = chosen.select("text", "label").mapInArrow(sample, "x binary, label int").collect()  # as many rows as the bound at most
    data = sorted(((r["x"], r["label"]) for r in chosen), key=lambda x: x)
    data = [(np.frombuffer(x, np.int32), label) for x, label in data]
    if len({label for _, label in data}) < 2:
        share = float(np.mean([label for _, label in data])) if data else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    order = np.random.default_rng(9).permutation(len(data))
    cut = len(data) * FIT_ROWS // (FIT_ROWS + CALIBRATE_ROWS)
    train, rest = [data[k] for k in order[:cut]], [data[k] for k in order[cut:]]
    weights, bias = descend(train, ratios)
    model = Model((weights * ratios).astype(np.float32), ratios**2, bias, 1.0, 0.0)
    slope, shift = calibrate(np.array([model.margin(x) for x, _ in rest]), np.array([label for _, label in rest]))
    return Model(model.weights, model.squares, bias, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row; the model (2 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(x) for x in features(batch.column(1))], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out():
    """Whether a row is kept from learning: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of the labelled rows of ``docs`` that are not held out (the
    LABELLED_ROWS of them with the least id hash, if there are more)."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(~held_out() & F.col("label").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(LABELLED_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return fit(texts.join(F.broadcast(known), "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    A naive-Bayes SVM: n-gram indicators are scaled by the log ratio of the
    shares that the two classes' rows give a feature, and a linear hinge-loss
    model is fitted on them by dual coordinate descent; a logistic curve on
    other rows turns margins into scores. predicted is 1 from ``threshold`` on.
    Labels, lang, source and id are not inputs of a score. An empty or null
    text has no features and gets the score of the bias alone. Of several
    labels of one id the largest counts. Null ids are not held out and never
    learnt from. No rows give no rows; without labels every score is 0.5.
    """
    scored = score(docs, learn(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does
    not reject. Rows are scored and dropped where they are read. If there are no
    usable labels of both classes, no classifier is fitted and all rows stay."""
    model = learn(docs, labels, id_col, text_col, **options)
    if not model.fitted:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([shared.value.score(x) >= threshold for x in features(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
