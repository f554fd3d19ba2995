import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lanewright.llm import suffix_dedup


def brute(rows, length):
    """The rule as stated, over a set of all strings seen so far."""
    seen, out = set(), []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def check(docs, length=100):
    # rows of one id go by the hash of the row
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = [(r.doc_id, r.text) for r in sorted(keyed, key=lambda r: (r.doc_id is None, r.doc_id, r.h))]
    got = suffix_dedup.repeated_spans(docs, length=length).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(brute(rows, length), key=str)
    assert all(sum(e - s for s, e in zip(r.starts, r.ends, strict=True)) == r.n_removed for r in got)


def test_edge_rows(edge):
    check(edge)


def test_documents(documents):
    check(documents)


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed, monkeypatch):
    """Few letters, shared pieces at odd places, pieces cut by chunk borders."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abß ") for _ in range(rng.randrange(60, 400))) for _ in range(6)]
    rows = []
    for k in range(40):
        parts = [rng.choice(pool)[rng.randrange(0, 40) :] if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(rng.randrange(0, 300))) for _ in range(rng.randrange(0, 6))]
        rows.append((k * 3 % 101, "".join(parts)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_crowded_rank_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 5)
    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh") for _ in range(80))
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(k, letters(150) + common + (letters(10) * 3 if k % 3 else letters(40))) for k in range(40)]
    rows += [(100 + k, t[100:260]) for k, t in rows[:20]]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    check(spark.createDataFrame([(1, text), (1, text + "x"), (2, text), (3, text), (3, text), (None, text), (None, text[::-1]), (None, text[::-1])], "doc_id long, text string"))


def test_stripped_texts(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdéfgh") for _ in range(300))
    out = {r.doc_id: r.text for r in suffix_dedup.strip_repeats(spark.createDataFrame([(1, text), (2, "new " + text + " end"), (3, None)], "doc_id long, text string")).collect()}
    assert out == {1: text, 2: "new  end", 3: ""}


def test_nothing(empty):
    assert suffix_dedup.repeated_spans(empty).count() == 0
