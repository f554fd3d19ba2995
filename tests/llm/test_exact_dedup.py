import hashlib
from collections import defaultdict

from lanewright.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        text = (t or "").translate(LOWER)
        ids = [x for x in groups[text] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[text]), i is not None and i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_edge_rows(edge, edge_rows):
    got = exact_dedup.exact_duplicates(edge)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(edge_rows)


def test_frequent_and_rare_groups_agree(spark):
    rows = [(k, "hot") for k in range(3000)] + [(10000 + k, f"text {k // 2}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for support in (1e-4, 0.2):
        got = exact_dedup.exact_duplicates(docs, support=support)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_nothing(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_kept_rows_keep_their_columns(edge):
    out = exact_dedup.drop_exact_duplicates(edge)
    assert out.columns == edge.columns and out.where("doc_id in (2, 3)").count() == 2 and out.where("doc_id = 1").count() == 0


def test_null_and_repeated_ids_keep_one_row_of_each_text(spark):
    rows = [(None, "a", "x"), (None, "A", "y"), (1, "b", "x"), (1, "b", "x"), (1, "c", "x"), (2, "B", "z"), (None, "b", "n"), (None, None, "e"), (3, "", "e")]
    out = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, c0 string").repartition(3))
    assert out.columns == ["doc_id", "text", "c0"]
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in out.collect()), key=str)
    assert got == [(1, "c"), (2, "b"), (3, ""), (None, "a")]
