import zlib
from collections import Counter

import numpy as np

from lanewright.llm import sharding


def check(got, rows, shards=40):
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    sizes = [counts[k] for k in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_edge_rows(edge, edge_rows):
    check(sharding.shard_table(edge).collect(), edge_rows)


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    first = sharding.shard_table(documents).collect()
    check(first, rows)
    again = sharding.shard_table(documents.repartition(9)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = [(k, f"t{k % 7}") for k in range(3000)]
    check(sharding.shard_table(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect(), rows, 10)


def test_matrix_has_the_sums_of_a_permutation():
    rows = [5, 0, 17, 1, 100]
    m = sharding.communication_matrix(rows, 7, 1)
    assert m.sum(1).tolist() == rows and set(m.sum(0).tolist()) <= {17, 18} and (m >= 0).all()
    # a bucket's rows go to the shards in proportion, on average
    mean = np.mean([sharding.communication_matrix([30, 70], 5, s)[0] for s in range(300)], axis=0)
    assert np.allclose(mean, 6, atol=0.5)


def test_rows_and_copies_keep_their_columns(edge, spark):
    twice = edge.unionByName(edge)
    out = sharding.shard_documents(twice, shards=6)
    assert out.columns == [c for c in edge.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    got = out.collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 2 * edge.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in sizes.items())


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 4


def test_nothing(empty):
    assert sharding.shard_table(empty).count() == 0 and sharding.shard_documents(empty).count() == 0
