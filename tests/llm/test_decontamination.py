import random
import re

import numpy as np
import pytest

from lanewright.llm import decontamination as dc

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def table(a, b):
    """The full alignment table, cell by cell: the best local score."""
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (dc.MATCH if x == y else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best / (dc.MATCH * len(b)) if len(b) else 0.0


@pytest.mark.parametrize("seed", range(20))
def test_alignment_scores(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 12))
    score, start, end = dc.align(a, b)
    assert score == pytest.approx(table(a, b))
    if score:
        assert 0 <= start < end <= len(a) and table(a[start:end], b) == pytest.approx(score)


def test_words_among_others():
    rng = np.random.default_rng(3)
    for n, m in ((5, 7), (300, 400), (1, 1)):
        a, b = rng.integers(0, 500, n).astype(np.uint64), rng.integers(0, 500, m).astype(np.uint64)
        assert (dc.among(a, b) == np.isin(a, b)).all()


@pytest.mark.parametrize("seed", range(12))
def test_frequent_seeds_lose_nothing(seed):
    """The bound leaves out no hit that an alignment would have accepted: all
    seeds taken as frequent give the rows that all seeds taken as rare give."""
    rng = np.random.default_rng(seed)
    kinds = int(rng.choice([4, 12, 60]))
    draw = lambda n: rng.integers(0, kinds, n).astype(np.uint64)
    items = [(k, draw(rng.integers(3, 40))) for k in range(8)]
    texts = [draw(300)]
    for _, item in items:
        copy = item.copy()
        copy[rng.random(len(copy)) < 0.25] = rng.integers(0, kinds)
        texts.append(np.concatenate([draw(60), copy, draw(60), draw(40), item[rng.random(len(item)) < 0.8]]))
    wanted = np.arange(kinds, dtype=np.uint64)
    seeds = dc.Seeds(items, wanted, np.full(kinds, 1 / kinds))
    found = []
    for rare in (True, False):
        seeds.rare[:] = rare
        found.append([list(dc.matches(t, seeds, dc.SCORE)) for t in texts])
    accepted = [[m[:2] for m in rows] for rows in found[0]]
    assert accepted == [[m[:2] for m in rows] for rows in found[1]] and any(accepted)


def test_documents(spark, documents, sf_dir):
    """Short texts against every item by the full table; whole copies in all texts."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(documents, items).collect()}
    bench = [(r.item_id, WORD.findall(r.text.lower())) for r in items.collect()]
    for d in documents.collect():
        words = WORD.findall(d.text.lower())
        line = f" {' '.join(words)} "
        for i, item in bench:
            if f" {' '.join(item)} " in line:
                assert got[d.doc_id, i] == 1
            elif len(words) < 120 and any(" ".join(item[k : k + 3]) in line for k in range(len(item) - 2)):
                score = table(words, item)
                assert ((d.doc_id, i) in got) == (score >= dc.SCORE)


def test_edited_copies_and_clean_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(12)]
    rows, want = [], set()
    for k in range(60):
        i, text = rng.choice(items)
        w = text.split()
        if k % 3 == 0:  # a copy with some words changed, left out and put in
            for _ in range(5):
                w[rng.randrange(len(w))] = word()
            del w[rng.randrange(len(w))]
            w.insert(rng.randrange(len(w)), word())
            want.add((k, i))
        elif k % 3 == 1:  # a few words only
            w = w[:6]
        else:
            w = [word() for _ in range(30)]
        rows.append((k, " ".join(word() for _ in range(50)) + " " + " ".join(w).capitalize() + ". " + " ".join(word() for _ in range(50))))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()} == want
    assert {r.doc_id for r in dc.drop_contaminated(docs, bench).collect()} == set(range(60)) - {d for d, _ in want}


def test_passes_agree(spark, documents, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(str, dc.contaminated(documents, items).collect()))
    monkeypatch.setattr(dc, "PASS_BYTES", 3000)
    assert sorted(map(str, dc.contaminated(documents, items).collect())) == whole and whole


def test_copy_with_frequent_seeds_only(spark):
    """A copy that keeps none of its item's rare seeds is found by the others."""
    often = [f"w{k}" for k in range(14)]
    item = often[:7] + [f"only{k}" for k in range(10)] + often[7:]
    copy = often[:7] + [w for k in range(10) for w in ([f"only{k}", "x"] if k % 2 else [f"only{k}"])] + often[7:]
    rows = [(k, " ".join(often)) for k in range(400)] + [(1000, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in dc.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    words = [WORD.findall(t) for _, t in rows]
    assert found.keys() == {i for (i, _), w in zip(rows, words, strict=True) if table(w, item) >= dc.SCORE} and 1000 in found
    assert found[1000] == pytest.approx(table(copy, item))


def test_edge_rows(spark, edge, edge_rows):
    text = dict(edge_rows)[18]
    bench = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "one"), (None, text), (5, text.split(" ", 20)[-1]), (5, "quite other words here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(edge, bench).collect()}
    assert got == {(18, 1), (18, 5)}
    out = dc.drop_contaminated(edge, bench)
    assert out.columns == edge.columns and out.count() == edge.count() - 1


def test_nothing(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(edge, none).count() == 0 and dc.drop_contaminated(edge, none).count() == edge.count()
    assert dc.contaminated(empty, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_recall_of_edited_copies(spark, sf_dir):
    """Benchmark items with a tenth to a third of their words changed, left out
    or added: every copy that the full alignment accepts is found by its seeds."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    corpus = [w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect() for w in WORD.findall((r.text or "").lower())][:20000]
    rng = random.Random(8)
    rows, want = [], set()
    for k in range(150):
        item, text = rng.choice(items)
        rate, words = rng.choice([0.1, 0.2, 0.33]), WORD.findall(text.lower())
        copy = []
        for w in words:
            x = rng.random()
            copy += [rng.choice(corpus)] if x < 0.6 * rate else [] if x < 0.8 * rate else [w, rng.choice(corpus)] if x < rate else [w]
        a = rng.randrange(len(corpus) - 120)
        rows.append((k, " ".join(corpus[a : a + 60] + copy + corpus[a + 60 : a + 120])))
        if table(WORD.findall(rows[-1][1]), words) >= dc.SCORE:
            want.add((k, item))
    found = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert len(want) > 100 and want <= {(r.doc_id, r.item_id) for r in found.collect()}
