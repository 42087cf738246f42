"""Queries of the general data-preparation operators (periods and gaps, nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.run_bitmap import periods_and_gaps, spans_of
from tideline.operators.structural_json import array_links, json_nodes, question_links
from tideline.plans.base import QA, _held, json_scalar
from tideline.registry import Registry
from tideline.sources.tables import table

R = Registry()

P3_SQL = """
WITH spans AS (
  SELECT 'store' AS owner_kind, CAST(store_no AS VARCHAR) AS owner_key, duration AS d FROM vdb_events
  UNION ALL
  SELECT 'entity', id, u.d FROM (SELECT id, unnest(durations) AS d FROM vdb_entities) u
), ends AS (
  SELECT owner_kind, owner_key, CAST(round(d[1] * 1000) AS BIGINT) AS s, CAST(round(d[2] * 1000) AS BIGINT) AS e
  FROM spans WHERE len(d) = 2 AND d[1] IS NOT NULL AND d[2] IS NOT NULL AND isfinite(d[1]) AND isfinite(d[2])
    AND owner_key IS NOT NULL
), ok AS (SELECT * FROM ends WHERE e > s),
flagged AS (
  SELECT *, max(e) OVER (PARTITION BY owner_kind, owner_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ok
), numbered AS (
  SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY owner_kind, owner_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flagged
), periods AS (
  SELECT owner_kind, owner_key, min(s) AS s, max(e) AS e FROM numbered GROUP BY owner_kind, owner_key, island
), gaps AS (
  SELECT owner_kind, owner_key, lag(e) OVER (PARTITION BY owner_kind, owner_key ORDER BY s) AS s, s AS e FROM periods
)
SELECT owner_kind, owner_key, 'period' AS piece, s AS start_ms, e AS end_ms FROM periods
UNION ALL
SELECT owner_kind, owner_key, 'gap', s, e FROM gaps WHERE s IS NOT NULL
"""


@R.query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of every store and every entity."""
    events = table(spark, sf_dir, "vdb_events").select(*spans_of("store", F.col("store_no"), F.col("duration")))
    entities = (
        table(spark, sf_dir, "vdb_entities").select("id", F.explode("durations").alias("span")).select(*spans_of("entity", F.col("id"), F.col("span")))
    )
    return periods_and_gaps(events.unionByName(entities))


_OPTIONS = f"""qo AS (SELECT file_id, video_no, question_no, {_held("(q -> 'options')")} AS o FROM qq WHERE (q -> 'options') IS NOT NULL),
ol AS (SELECT file_id, video_no, question_no, unnest(range(len(l))) AS no, unnest(l) AS o FROM (SELECT file_id, video_no, question_no, CASE json_type(o) WHEN 'ARRAY' THEN CAST(o AS JSON[])
  WHEN 'OBJECT' THEN list_transform(list_sort(json_keys(o)), lambda k: json_extract(o, '$."' || k || '"')) ELSE CAST([] AS JSON[]) END AS l FROM qo))"""

P5_SQL = f"""WITH {QA}, {_OPTIONS}, en AS (SELECT id, unnest(range(len(events))) AS no, unnest(events) AS c, 'event' AS kind FROM vdb_entities WHERE id IS NOT NULL
  UNION ALL SELECT id, unnest(range(len(frame_indices))), CAST(unnest(frame_indices) AS VARCHAR), 'frame' FROM vdb_entities WHERE id IS NOT NULL)
SELECT DISTINCT * FROM (SELECT 'entity' AS src, id AS parent_key, kind AS child_kind, no AS child_no, c AS child_key FROM en WHERE c IS NOT NULL
  UNION ALL SELECT 'qa', file_id || ':' || video_no, 'question', question_no, coalesce({json_scalar("(q -> 'question_id')")}, {json_scalar("(q -> 'uid')")}, '') FROM qq
  UNION ALL SELECT 'qa', file_id || ':' || video_no || ':' || question_no, 'option', no, {json_scalar('o')} FROM ol WHERE {json_scalar('o')} IS NOT NULL)"""


@R.query("p5_found", P5_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of entities (events, frames) and of question files (questions, options)."""
    entities = array_links(table(spark, sf_dir, "vdb_entities"), "id", {"events": "event", "frame_indices": "frame"}, "entity")
    return entities.unionByName(question_links(table(spark, sf_dir, "qa_files"))).distinct()


@R.query("p5_nodes")
def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every complete payload with its parent, place and member name."""
    return json_nodes(table(spark, sf_dir, "qa_files"), "file_id", "payload")
