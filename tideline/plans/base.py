"""Base views of the data directory, in Spark and as SQL of the same meaning.

``ev``: events with a usable span, one row per (store, place), the latest delivery. ``br``: which
entity occurs in which event, with repetitions of the latest delivery. ``vec``: usable vectors.
``qn``: questions of the question files for every store of their video, numbered within the store.
``sd``: seeds of these questions (a stand-in: every event is a seed of up to three questions of its
store, with a score or, where the question's time names it, none). ``gt``: true segments of the
questions, as their time references give them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.timetext import segments_of, valid_reference
from tideline.operators.ordering import numbered
from tideline.sources import stores
from tideline.sources.tables import table



def _held(x: str) -> str:
    """JSON text in a JSON string counts as what it holds."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid(({x} ->> '$')) THEN CAST(({x} ->> '$') AS JSON) ELSE {x} END"


def _list(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] ELSE CAST([] AS JSON[]) END"


def json_scalar(x: str) -> str:
    return f"CASE WHEN json_type({x}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN ({x} ->> '$') END"


QA = f"""q0 AS (SELECT file_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM (SELECT file_id, CASE WHEN starts_with(payload, chr(65279)) THEN substr(payload, 2) ELSE payload END AS t FROM qa_files WHERE file_id IS NOT NULL AND payload IS NOT NULL)),
q1 AS (SELECT file_id, {_held('j')} AS j FROM q0 WHERE j IS NOT NULL),
q2 AS (SELECT file_id, CASE WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.videos') THEN (j -> 'videos') ELSE j END AS j FROM q1),
q3 AS (SELECT file_id, {_held('j')} AS j FROM q2),
q4 AS (SELECT file_id, unnest(range(len(l))) AS video_no, unnest(l) AS j FROM (SELECT file_id, {_list('j')} AS l FROM q3)),
qv AS (SELECT * FROM (SELECT file_id, video_no, {_held('j')} AS j FROM q4) WHERE json_type(j) = 'OBJECT'),
q5 AS (SELECT file_id, video_no, {_held("(j -> 'qa')")} AS q FROM qv WHERE (j -> 'qa') IS NOT NULL),
q6 AS (SELECT file_id, video_no, unnest(range(len(l))) AS question_no, unnest(l) AS q FROM (SELECT file_id, video_no, {_list('q')} AS l FROM q5)),
qq AS (SELECT * FROM (SELECT file_id, video_no, question_no, {_held('q')} AS q FROM q6) WHERE json_type(q) = 'OBJECT'),
vk AS (SELECT file_id, video_no, coalesce({json_scalar("(j -> 'video_key')")}, {json_scalar("(j -> 'key')")}) AS video_key FROM qv)"""

QN = f"""{QA},
qn AS (SELECT store_no, row_number() OVER (PARTITION BY store_no ORDER BY file_id, video_no, question_no) - 1 AS question_id, file_id, video_no, question_no, {json_scalar("(q -> 'time_reference')")} AS ref, q
  FROM qq JOIN vk USING (file_id, video_no) JOIN (SELECT DISTINCT store_no, video_key FROM video_stores WHERE store_no IS NOT NULL) USING (video_key))"""

EV = f"""{QN},
ev AS (
  SELECT store_no, pos, id AS event_id, description, duration[1] AS s, duration[2] AS e,
         CAST(round(duration[1] * 1000) AS BIGINT) AS ms, CAST(round(duration[2] * 1000) AS BIGINT) AS me
  FROM (SELECT *, row_number() OVER (PARTITION BY store_no, pos ORDER BY loaded_at DESC) AS rn
        FROM vdb_events WHERE store_no IS NOT NULL AND pos IS NOT NULL)
  WHERE rn = 1 AND len(duration) = 2 AND duration[1] IS NOT NULL AND duration[2] IS NOT NULL AND duration[2] > duration[1]
)"""

BR = """br AS (
  SELECT store_no, entity_id, ord, event_id FROM (
    SELECT store_no, id AS entity_id, unnest(range(len(events))) AS ord, unnest(events) AS event_id
    FROM (SELECT *, row_number() OVER (PARTITION BY store_no, id ORDER BY loaded_at DESC, len(coalesce(events, [])) DESC) AS rn
          FROM vdb_entities WHERE store_no IS NOT NULL AND id IS NOT NULL)
    WHERE rn = 1 AND events IS NOT NULL)
  WHERE event_id IS NOT NULL
)"""

VEC = """vec AS (
  SELECT vec_id, store_no, video_key, vec_kind, owner_id, CAST(matrix AS DOUBLE[]) AS v
  FROM nano_vectors
  WHERE vec_id IS NOT NULL AND matrix IS NOT NULL AND len(matrix) = embedding_dim
    AND len(list_filter(matrix, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(matrix, lambda x: x <> 0)) > 0
)"""

SD = f"""{EV}, nq AS (SELECT store_no, count(*) AS n FROM qn GROUP BY store_no), sd AS (
  SELECT store_no, (pos + k) % n AS question_id, pos AS ord, event_id, s, e,
         CASE WHEN (pos + k) % 5 = 0 THEN NULL ELSE ((pos * 37 + k * 11) % 101) / 101.0 END AS score
  FROM (SELECT ev.*, coalesce(nq.n, 1) AS n, unnest(range(least(3, coalesce(nq.n, 1)))) AS k FROM ev LEFT JOIN nq ON nq.store_no = ev.store_no)
)"""


def _sec(x: str) -> str:
    """Seconds of a time text, by its first three digit parts."""
    p = f"list_filter(list_transform(string_split_regex({x}, '[:.]'), lambda p: trim(p)), lambda p: regexp_full_match(p, '[0-9]+'))"
    n = lambda i: f"CAST(({p})[{i}] AS BIGINT)"
    return f"CASE len({p}) WHEN 0 THEN NULL WHEN 1 THEN {n(1)} WHEN 2 THEN {n(1)} * 60 + {n(2)} ELSE {n(1)} * 3600 + {n(2)} * 60 + {n(3)} END"


def segments_sql(source: str, keys: str, ref: str) -> str:
    """``name`` CTEs that give (keys, i, gs, ge, point) of the time references of ``source``."""
    return f"""tr0 AS (SELECT {keys}, trim({ref}) AS t FROM {source} WHERE trim({ref}) NOT IN ('', 'N/A', 'None', 'None-None')),
tr1 AS (SELECT {keys}, 0 AS i, CASE WHEN a = '' THEN b ELSE a END AS a, CASE WHEN b = '' THEN a ELSE b END AS b FROM (SELECT {keys}, trim(split_part(t, '-', 1)) AS a, trim(substr(t, instr(t, '-') + 1)) AS b FROM tr0 WHERE contains(t, '-'))),
tr2 AS (SELECT {keys}, i, {_sec('a')} AS gs, {_sec('b')} AS ge FROM tr1),
tr3 AS (SELECT {keys}, list_filter(list_transform(string_split(t, ','), lambda x: {_sec('x')}), lambda x: x IS NOT NULL) AS l FROM tr0 WHERE NOT contains(t, '-')),
tr AS (SELECT {keys}, i, gs, ge, FALSE AS point FROM tr2 WHERE gs IS NOT NULL AND ge IS NOT NULL AND ge >= gs UNION ALL SELECT {keys}, i, x, x + 1, TRUE FROM (SELECT {keys}, unnest(range(len(l))) AS i, unnest(l) AS x FROM tr3))"""


def valid_sql(ref: str) -> str:
    """Whether an evaluation counts a time reference."""
    one = lambda x: f"(trim({x}) NOT IN ('', 'None') AND ({_sec(x)}) IS NOT NULL)"
    a, b = f"split_part(trim({ref}), '-', 1)", f"substr(trim({ref}), instr(trim({ref}), '-') + 1)"
    points = f"list_filter(string_split(trim({ref}), ','), lambda x: trim(x) <> '')"
    listed = f"len({points}) > 0 AND len(list_filter({points}, lambda x: ({_sec('x')}) IS NULL)) = 0"
    return f"coalesce(trim({ref}) NOT IN ('', 'N/A', 'None', 'None-None') AND CASE WHEN contains({ref}, '-') THEN {one(a)} AND {one(b)} ELSE {listed} END, FALSE)"


GT = segments_sql("qn", "store_no, question_id", "ref") + """,
gt AS (SELECT store_no, question_id, question_id * 1000 + i AS seg, gs, ge, point FROM tr)"""


#: Number of a question by the id that the files give it (the first of a store, if several have one id).
QI = f"qi AS (SELECT store_no, ask_id, min(question_id) AS qno FROM (SELECT store_no, question_id, coalesce({json_scalar("(q -> 'question_id')")}, {json_scalar("(q -> 'uid')")}) AS ask_id FROM qn) WHERE ask_id IS NOT NULL GROUP BY ALL)"


def question_ids(questions: DataFrame) -> DataFrame:
    """store_no, ask_id (text of a question's id in its file), qno (its number in the store). ``questions``:
    :func:`store_questions`."""
    return questions.where("asked_id is not null").groupBy("store_no", F.col("asked_id").alias("ask_id")).agg(F.min("question_id").alias("qno"))


def _usable_span(df: DataFrame) -> DataFrame:
    s, e = F.get("duration", F.lit(0)), F.get("duration", F.lit(1))
    return df.where((F.size("duration") == 2) & s.isNotNull() & e.isNotNull() & (e > s))


def events(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "vdb_events").where("store_no is not null and pos is not null")
    w = Window.partitionBy("store_no", "pos").orderBy(F.desc("loaded_at"))
    one = raw.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    s, e = F.get("duration", F.lit(0)), F.get("duration", F.lit(1))
    return _usable_span(one).select(
        "store_no", "pos", F.col("id").alias("event_id"), "description", s.alias("s"), e.alias("e"), F.round(s * 1000).cast("bigint").alias("ms"), F.round(e * 1000).cast("bigint").alias("me")
    )


def bridge(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "vdb_entities").where("store_no is not null and id is not null")
    n = F.size(F.coalesce("events", F.array().cast("array<string>")))
    w = Window.partitionBy("store_no", "id").orderBy(F.desc("loaded_at"), n.desc())
    one = raw.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return one.select("store_no", F.col("id").alias("entity_id"), F.posexplode("events").alias("ord", "event_id")).where("event_id is not null").withColumn("ord", F.col("ord").cast("bigint"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.exists("matrix", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        table(spark, sf, "nano_vectors")
        .where((F.size("matrix") == F.col("embedding_dim")) & F.col("vec_id").isNotNull())
        .where(~bad & F.exists("matrix", lambda x: x != 0))
        .select("vec_id", "store_no", "video_key", "vec_kind", "owner_id", F.col("matrix").cast("array<double>").alias("v"))
    )


def store_questions(spark: SparkSession, sf: str, placed: DataFrame | None = None) -> DataFrame:
    """Questions of every store of their video, numbered from 0 in order of file, video and place: store_no,
    question_id, file_id, video_no, question_no, asked_id (the question's own id), time_reference and the other fields.
    Numbering works in blocks of files, so that a store with very many questions is not one task. ``placed``: the
    questions of the files, if they are read already."""
    place = table(spark, sf, "video_stores").where("store_no is not null").select("store_no", "video_key").distinct()
    q = (stores.placed_questions(table(spark, sf, "qa_files")) if placed is None else placed).join(place, "video_key")
    q = q.withColumnRenamed("question_id", "asked_id")
    return numbered(q, ["store_no"], "file_id", "question_id", block=64, then=("video_no", "question_no")).drop("group_size")


def seeds(spark: SparkSession, sf: str, placed: DataFrame | None = None) -> DataFrame:
    place = table(spark, sf, "video_stores").where("store_no is not null").select("store_no", "video_key").distinct()
    n = stores.question_counts(table(spark, sf, "qa_files")) if placed is None else placed.groupBy("video_key").agg(F.count("*").alias("n"))
    n = n.join(place, "video_key").groupBy("store_no").agg(F.sum("n").alias("_n"))
    ev = events(spark, sf).join(n, "store_no", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    ev = ev.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(3), F.col("_n")) - 1)))
    score = F.when((F.col("pos") + F.col("_k")) % 5 == 0, None).otherwise(((F.col("pos") * 37 + F.col("_k") * 11) % 101) / F.lit(101.0))
    return ev.select("store_no", ((F.col("pos") + F.col("_k")) % F.col("_n")).alias("question_id"), F.col("pos").alias("ord"), "event_id", "s", "e", score.cast("double").alias("score"))


def truth(spark: SparkSession, sf: str, placed: DataFrame | None = None) -> DataFrame:
    """True segments: store_no, question_id, seg (distinct within the store), gs, ge, point."""
    q = store_questions(spark, sf, placed).select("store_no", "question_id", F.posexplode(segments_of(F.col("time_reference"))).alias("i", "z"))
    return q.select("store_no", "question_id", (F.col("question_id") * 1000 + F.col("i")).alias("seg"), "z.gs", "z.ge", "z.point")


def valid_truth(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`truth` of the questions that an evaluation counts: a range with an empty side has segments but
    does not count, as does a reference with any unreadable time."""
    q = store_questions(spark, sf).where(valid_reference(F.col("time_reference")))
    q = q.select("store_no", "question_id", F.posexplode(segments_of(F.col("time_reference"))).alias("i", "z"))
    return q.select("store_no", "question_id", (F.col("question_id") * 1000 + F.col("i")).alias("seg"), "z.gs", "z.ge", "z.point")


def question_truth(spark: SparkSession, sf: str) -> DataFrame:
    """True segments that the question files give: store_no, file_id, video_no, question_no, seg, gs, ge.
    Questions without a readable time reference, and those of videos without a store, have none."""
    q = store_questions(spark, sf).select("store_no", "file_id", "video_no", "question_no", F.posexplode(segments_of(F.col("time_reference"))).alias("seg", "z"))
    return q.select("store_no", "file_id", "video_no", "question_no", "seg", "z.gs", "z.ge")
