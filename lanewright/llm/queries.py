"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanewright.llm import decontamination, exact_dedup, license_scan, mixing, near_dedup, pii, quality, sharding, suffix_dedup, token_count

#: File name of the tokenizer whose tokens are counted.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one group; ties of an id are kept together."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without words are linked with nothing; rows of one id are one document."""
    return near_dedup.near_duplicates(table(spark, sf_dir), shingle=3, percent=85)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 0; null sources are one source, weighed last; equal rows are interchangeable."""
    return mixing.mix_sources(table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; rows with null or repeated ids are documents of their own."""
    spans = suffix_dedup.repeated_spans(table(spark, sf_dir))
    return spans.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no tokens; repeated rows are counted each."""
    return token_count.token_counts(table(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 16 and checksum 0; repeated rows get places of their own."""
    return sharding.shard_table(table(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts hold nothing; repeated rows are judged each."""
    return pii.personal_data(table(spark, sf_dir)).drop("spans_found")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty and null texts get the score of the bias; of several labels of an id the largest counts."""
    return quality.quality_scores(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts hold no notice; rows that repeat an id count as one."""
    return license_scan.licences(table(spark, sf_dir), phrases=license_scan.PHRASES)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts hold nothing; rows that repeat a document give one row an item."""
    return decontamination.contaminated(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_minhash_near_dedup, op3_source_mixing, op4_suffix_dedup, op5_token_counts, op6_sharding,
    op7_pii, op8_quality, op9_license_scan, op10_decontamination,
)}

ORACLE_SQL = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) keep_id, count(*) OVER (PARTITION BY t) group_size, doc_id = max(doc_id) OVER (PARTITION BY t) kept, sha256(t) text_sha256 FROM d""",
    "op2_minhash_near_dedup": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(2, len(w) - 1)) END, lambda i: array_to_string(w[i:i+2], ' '))) g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) n, hash(list_sort(g)) x, g FROM s),
r AS (SELECT x, min(doc_id) rep, any_value(n) n, arg_min(g, doc_id) g FROM n WHERE n > 0 GROUP BY x),
post AS (SELECT rep, n, unnest(g) g FROM r),
met AS (SELECT a.rep a, b.rep b, a.n na, b.n nb, count(*) c FROM post a JOIN post b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM met WHERE 100 * c >= 85 * (na + nb - c)),
arc AS (SELECT a u, b v FROM link UNION ALL SELECT b, a FROM link),
reach(u, v) AS (SELECT rep, rep FROM r UNION SELECT x.u, a.v FROM reach x JOIN arc a ON a.u = x.v),
part AS (SELECT u rep, min(v) component FROM reach GROUP BY 1)
SELECT n.doc_id, n.n n_shingles, coalesce(component, n.doc_id) component_id, n.doc_id = coalesce(component, n.doc_id) kept FROM n LEFT JOIN r ON r.x = n.x AND n.n > 0 LEFT JOIN part p ON p.rep = r.rep""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) x FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) i FROM d WHERE len(h) >= 200)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) k FROM w) WHERE k > 1),
mark AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END new FROM late),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) r FROM mark),
span AS (SELECT doc_id, r, min(i) a, max(i) + 100 b FROM run GROUP BY 1, 2),
gap AS (SELECT s.doc_id, s.a, s.b, coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) f FROM span s),
cut AS (SELECT g.doc_id, CAST(sum(g.b - g.a) AS BIGINT) removed, count(*) spans, string_agg(substr(d.h, 2 * g.f + 1, 2 * (g.a - g.f)), '' ORDER BY g.a) front, max(g.b) e FROM gap g JOIN d ON d.doc_id = g.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) n_bytes, coalesce(removed, 0) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE front || substr(h, 2 * e + 1) END)) kept_sha256 FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id""",
    "op3_source_mixing": """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) s FROM d GROUP BY 1),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 w FROM per),
filled AS (SELECT *, sum(s) OVER () total, sum(w) OVER () weights, coalesce(sum(s) OVER o, 0) stopped, coalesce(sum(w) OVER o, 0) gone FROM weighed
 WINDOW o AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, CAST(total - 3 * stopped AS DOUBLE) / CAST(weights - gone AS DOUBLE) lev FROM filled),
target AS (SELECT source, s source_size, least(CAST(3 * s AS DOUBLE), (SELECT arg_min(lev, gone) FROM levels WHERE lev * w <= 3 * s) * w) target FROM levels),
placed AS (SELECT d.doc_id, d.size, t.source, t.source_size, t.target, CASE WHEN source_size <= 0 THEN 1.0::DOUBLE ELSE target / source_size END rate,
 row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id % ((SELECT count(*) FROM d) // 20000 + 1), doc_id) i FROM d JOIN target t ON t.source IS NOT DISTINCT FROM d.source),
phased AS (SELECT *, k, size * least(3, CAST(floor(rate * i + (k + 0.5::DOUBLE) / 64 + 1e-7::DOUBLE) - floor(rate * (i - 1) + (k + 0.5::DOUBLE) / 64 + 1e-7::DOUBLE) AS BIGINT)) taken FROM placed, range(64) x(k)),
sums AS (SELECT source, k, abs(sum(taken) - any_value(target)) off FROM phased GROUP BY 1, 2),
best AS (SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, k) p FROM sums) WHERE p = 1)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) taken FROM phased p JOIN best b ON b.source IS NOT DISTINCT FROM p.source AND b.k = p.k""",
}
