import re
from collections import defaultdict

import pytest

from lanewright.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes):
    """Targets by the rule as stated: share by weight, stop at 3 times, reshare."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return stopped | share
        stopped |= {s: 3 * sizes[s] for s in over}


def check(df, rows):
    got = df.collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets, taken, longest = water_fill(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken in [r.size * c for c in range(4)] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] + 1
    return got


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    first = check(mixing.mix_sources(documents), rows)
    again = mixing.mix_sources(documents.repartition(7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_edge_rows(edge, edge_rows):
    rows = [(r.doc_id, r.text, r.source) for r in edge.collect()]
    check(mixing.mix_sources(edge), rows)


def test_small_sources_stop_and_the_excess_is_shared(spark):
    rows = [(k, "w " * 100, "a") for k in range(50)] + [(100 + k, "w " * 3, "b") for k in range(20)] + [(200, "w w", "c"), (201, None, None), (202, "", "d")]
    got = check(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")), rows)
    assert {r.source: r.target for r in got}["b"] == 180.0


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 50)
    rows = [(k, "w " * 10, "a") for k in range(400)] + [(1000 + k, "w " * (k % 13), "b") for k in range(200)]
    check(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")), rows)


def test_rows_are_repeated(spark):
    rows = [(k, "w " * 10, "a") for k in range(40)] + [(100 + k, "w " * 10, "b") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: c for k, c in copies.items() if c}


def test_null_and_repeated_ids_keep_their_own_copies(spark):
    rows = [(7, "w " * 10 + f"x{k}", "a") for k in range(60)] + [(8, "w " * 11, "a")] * 60 + [(None, "w " * 12 + f"x{k % 9}", "b") for k in range(40)] + [(100 + k, "w " * 10, "c") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    taken = defaultdict(int)
    for r in out.collect():
        taken[r.source] += len(WORD.findall(r.text))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    targets = water_fill(sizes)
    assert targets["a"] < sizes["a"] / 2 and all(abs(taken[s] - t) <= 14 for s, t in targets.items())


def test_columns_of_any_name_keep_their_values(spark):
    names = ["_copy", "_copies", "_sum", "_content1", "copies", "c0", "_n"]
    rows = [(k, "w " * 10, "ab"[k % 2], *[f"{n}{k}" for n in names]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) and 28 <= len(got) <= 32


def test_nothing(empty):
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
