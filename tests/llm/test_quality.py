import random
import zlib

import numpy as np
import pytest

from lanewright.llm import quality


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")


@pytest.fixture(scope="module")
def more(spark, sf_dir):
    return spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")


def test_held_out_accuracy(more, labels):
    got = quality.quality_scores(more, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == more.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    test = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in test]) > 0.95 and np.mean([r.predicted for r, q in test if q]) > 0.95


def test_held_out_labels_are_not_read(spark, more, labels):
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.quality_scores(more, x).collect()) for x in (labels, flipped))
    assert a == b


def test_edge_rows(spark, edge, labels):
    known = labels.unionByName(spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 1), (3, None, None), (17, 0, 0)], "doc_id long, quality int, toxic int"))
    got = quality.quality_scores(edge, known).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    empties = {r.score for r in got if r.doc_id in (4, 5)}
    assert len(empties) == 1
    out = quality.keep_good(edge, known)
    assert out.columns == edge.columns


@pytest.mark.parametrize("rows,share", [([], 0.5), ([(k, 1, 0) for k in range(30)], 0.99)])
def test_without_two_classes(spark, documents, rows, share):
    known = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality.quality_scores(documents, known).collect()} == {round(share, 6)}


@pytest.mark.parametrize("rows", [[], [(k, None, 0) for k in range(30)], [(k, 0, 0) for k in range(30)]])
def test_all_rows_stay_without_a_classifier(spark, documents, rows):
    known = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    out = quality.keep_good(documents, known)
    assert out.columns == documents.columns and sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in documents.collect())


def test_descent_separates():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.concatenate([rng.integers(10, 200, 15), [k % 2]])).astype(np.int64), k % 2) for k in range(200)]
    p, q = np.ones(1 << quality.BITS), np.ones(1 << quality.BITS)
    for x, label in rows:
        (p if label else q)[x] += 1
    ratios = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    weights, bias = quality.descend(rows, ratios)
    assert all((weights[x] @ ratios[x] / np.sqrt(ratios[x] @ ratios[x]) + bias > 0) == bool(label) for x, label in rows)


def test_features_do_not_depend_on_the_batch():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab C!é\n") for _ in range(rng.randrange(0, 60))) for _ in range(50)] + ["", "a", "ab"]
    together = [f.tolist() for f in quality.features(quality.pa.array(texts))]
    assert together == [next(quality.features(quality.pa.array([t]))).tolist() for t in texts]


def test_nothing(spark, empty, labels):
    assert quality.quality_scores(empty, labels).count() == 0
