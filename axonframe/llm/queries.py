"""The operators' queries on the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .common import read
from .embedding_dedup import near_vectors
from .licenses import ALL, notices
from .mixing import mixed_sizes
from .packing import pack
from .quality import judge
from .simhash import near_duplicates
from .substring import repeated_passages
from .token_count import count_tokens
from .toxicity import severity


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(read(spark, sf_dir, "documents"), ALL)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False).drop("ids")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents")).drop("doc_key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_nearest": op2_nearest,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
}
_DIRECTION = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0"

#: Brute force: all pairs of vectors. For small tables only, as an oracle should be.
EMBEDDING_DEDUP_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_DIRECTION}),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node WHERE reach.root < link.b),
label AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, label.component_id, e.vec_id = label.component_id AS kept
FROM embeddings e JOIN label ON label.node = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id"""

#: The same sampling: sums and row numbers over each whole source, no cells needed.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
b AS (SELECT *, CAST(floor(8.0 * sqrt(sqrt(CAST(size AS DOUBLE)))) AS INTEGER) AS band, CAST('0x' || substr(md5('10:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS spread, count(*) OVER () AS n_all FROM d),
p AS (SELECT *, spread % CAST(ceil(count(*) OVER (PARTITION BY source, band) / greatest(1.0, sqrt(CAST(n_all AS DOUBLE)))) AS BIGINT) AS part FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, part, size, doc_id) AS place FROM p),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT *, CAST([5, 2, 1][CAST((k - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight, 2.0 * source_size AS most FROM k),
r AS (SELECT *, most / weight AS ratio FROM w),
l AS (SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
a AS (SELECT level AS mark FROM l WHERE level <= ratio ORDER BY ratio, k LIMIT 1),
t AS (SELECT source, source_size, least(most, mark * weight) AS target, CAST(CAST('0x' || substr(md5('10:offset:' || CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift FROM l CROSS JOIN a),
c AS (SELECT o.doc_id, o.size, t.source_size, t.target, o.place, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(shift + rate * place) - floor(shift + rate * (place - 1)), 2) * size AS BIGINT) AS taken FROM c"""

#: Trained models, tokenizers, XXH64 fingerprints and approximate search have no SQL form.
ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": EMBEDDING_DEDUP_SQL, "op10_mixing": MIXING_SQL}
