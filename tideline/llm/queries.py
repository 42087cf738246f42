"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.bpe import encode_texts, token_counts
from tideline.llm.captions import caption_runs
from tideline.llm.knn import neighbour_pairs, neighbours, recall
from tideline.llm.packing import fill_report, pack
from tideline.llm.pair_defects import pair_defects
from tideline.llm.subjects import agreement, subject_areas
from tideline.registry import Registry
from tideline.sources.tables import table

R = Registry()

CAPACITY = 2048


#: Brute force; at the scale of the correctness check it takes seconds.
P1_SQL = """WITH v AS (SELECT vec_id, CAST(matrix AS DOUBLE[]) AS m, len(matrix) AS d FROM nano_vectors WHERE vec_id IS NOT NULL AND matrix IS NOT NULL AND len(matrix) = embedding_dim
  AND len(list_filter(matrix, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(matrix, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, d, list_transform(m, lambda x: x / n) AS w FROM (SELECT *, sqrt(list_inner_product(m, m)) AS n FROM v)),
s AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.w, b.w), 6) AS sim FROM u a JOIN u b ON a.d = b.d AND a.vec_id <> b.vec_id),
n AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM s WHERE sim >= 0.8) WHERE r <= 10)
SELECT DISTINCT least(i, j) AS vec_id_a, greatest(i, j) AS vec_id_b FROM n"""


@R.query("p1_found", P1_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which at least one is a nearest neighbour of the other."""
    return neighbour_pairs(neighbours(table(spark, sf_dir, "nano_vectors")))


@R.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisive defect of each defective response."""
    return pair_defects(table(spark, sf_dir, "responses")).where("rank = 0").select("response_id", "defect")


@R.query("p2_all")
def p2_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered defect of each response."""
    return pair_defects(table(spark, sf_dir, "responses"))


@R.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events that repeat the same caption."""
    return caption_runs(table(spark, sf_dir, "vdb_events")).select("store_no", "first_pos", "last_pos", "event_count")


@R.query("p4_runs")
def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their whole duration and common caption, where neighbours stand at most 30 s apart."""
    return caption_runs(table(spark, sf_dir, "vdb_events"), gap=30.0)


@R.query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id")


@R.query("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, sized in tokens, packed into containers of 2,048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return pack(token_counts(docs, "doc_id"), "doc_id", "n_tokens", CAPACITY, n_items=docs.count())


@R.query("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing keeps and how near it comes to the least number of containers."""
    return fill_report(p7_containers(spark, sf_dir), CAPACITY)


@R.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that each document is about."""
    return _subjects(spark, sf_dir).select("doc_id", "area")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"))


@R.query("p8_agreement")
def p8_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the areas against the raters' labels, on which nothing is fitted."""
    return agreement(_subjects(spark, sf_dir), table(spark, sf_dir, "doc_area_labels"))


@R.query("p1_recall")
def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index against brute force, for every vector whose id 50 divides against all vectors."""
    df = table(spark, sf_dir, "nano_vectors")
    return recall(df, neighbours(df))
