import itertools
import random
import re

import numpy as np
import pytest

from lanewright.llm import near_dedup
from lanewright.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_edge_rows(edge, edge_rows, n, percent):
    assert result(near_dedup.near_duplicates(edge, shingle=n, percent=percent)) == brute(edge_rows, n, percent)


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert result(near_dedup.near_duplicates(documents, shingle=3, percent=85)) == brute(rows, 3, 85)


def edited(n, words, edits, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        w = [f"w{j}" for j in range(words)]
        for _ in range(rng.randrange(1, edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("pivots", [64, 1])
def test_large_group_over_many_cells(spark, monkeypatch, pivots):
    """Edited copies of two texts, more than a list may hold, with links at
    either side of the threshold: exact sets decide, whatever pivots find."""
    for name, value in {"BLOCK": 100, "CELL": 60, "PIVOTS": pivots}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rows = edited(420, 120, 6) + [(1000 + i, t.replace("w7 ", "v7 ")) for i, t in edited(150, 120, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(near_dedup.near_duplicates(docs, shingle=3, percent=85)) == brute(rows, 3, 85)


def test_rows_grow_with_the_group_not_with_its_square(spark, monkeypatch):
    """Near copies of one text, edits at random: every table and every group of
    pairs to compare grows in proportion to the copies."""
    sums = {}
    write, blocks = near_dedup.materialise, near_dedup.blocks

    def counted(df, n):
        sums[n] = sums.get(n, 0) + df.count()
        return df

    for n in (1000, 2000):
        monkeypatch.setattr(near_dedup, "materialise", lambda df, label, n=n: counted(write(df, label), n))
        monkeypatch.setattr(near_dedup, "blocks", lambda *a, n=n: counted(blocks(*a), n))
        out = near_dedup.near_duplicates(spark.createDataFrame(edited(n, 60, 1), "doc_id long, text string").repartition(4))
        assert out.where("kept").count() == 1
    assert sums[2000] < 2.5 * sums[1000]


def test_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(edge):
    out = near_dedup.drop_near_duplicates(edge)
    assert out.columns == edge.columns
    assert {r.doc_id for r in out.collect()} >= {1, 4, 5, 6, 9, None} and out.where("doc_id in (2, 3, 14, 16)").count() == 0


def test_one_row_of_null_and_repeated_ids_stays(spark):
    text = [" ".join(f"t{k}w{j}" for j in range(60)) for k in range(6)]
    rows = [(5, text[0])] * 4 + [(None, text[0] + " tail"), (None, text[1]), (None, text[1]), (None, text[1] + " tail"), (3, text[2]), (3, text[3]), (2, text[3] + " tail"), (4, text[4]), (None, text[5])]
    rows += [(None, None), (None, None), (6, ""), (6, "")]
    out = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((r.doc_id or 0, (r.text or "").split(" ")[0]) for r in out)
    assert got == [(0, ""), (0, ""), (0, "t1w0"), (0, "t5w0"), (2, "t3w0"), (3, "t2w0"), (4, "t4w0"), (5, "t0w0"), (6, ""), (6, "")]


def test_least_collisions_bounds_the_miss():
    from math import comb

    for percent in (60, 80, 85, 95):
        m = near_dedup.least_collisions(percent)
        tail = lambda k: sum(comb(16, j) * (percent / 100) ** j * (1 - percent / 100) ** (16 - j) for j in range(k))  # noqa: E731, B023
        assert m == 1 or tail(m) <= near_dedup.MISS


def test_matrix_and_single_intersections_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(12)]
    pairs = np.array(list(itertools.combinations(range(12), 2)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    assert near_dedup._shared(sets, pairs).tolist() == want and near_dedup._shared(sets, pairs[:3]).tolist() == want[:3]


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 300)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
