from collections import Counter

import corpus_pipeline
from lanewright.llm import decontamination, mixing, near_dedup, quality


def test_each_stage_does_its_operator_s_work(spark, sf_dir):
    """Every stage on what the one before it kept, against its operator's verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns = docs.columns
    (_, good), (_, distinct), (_, clean), (_, mixed), (_, sharded) = corpus_pipeline.STAGES
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    a = good(spark, docs, sf_dir).cache()
    scores = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert a.columns == columns and ids(a) == ids(scores.where("predicted = 1"))

    b = distinct(spark, a, sf_dir).cache()
    assert b.columns == columns and ids(b) == ids(near_dedup.near_duplicates(a).where("kept"))

    c = clean(spark, b, sf_dir).cache()
    bad = set(ids(decontamination.contaminated(b, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))))
    assert c.columns == columns and ids(c) == [i for i in ids(b) if i not in bad]

    d = mixed(spark, c, sf_dir).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(c).collect()}
    assert d.columns == columns and Counter(ids(d)) == Counter({i: n for i, n in copies.items() if n})

    e = sharded(spark, d, sf_dir).collect()
    sizes = Counter(r.shard for r in e)
    assert sorted(r.doc_id for r in e) == ids(d) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(40))
    assert all(sorted(r.slot for r in e if r.shard == k) == list(range(n)) for k, n in sizes.items())

    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.shard, r.slot) for r in run.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in e)


def test_stages_take_odd_rows(spark, edge, empty, sf_dir):
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()
