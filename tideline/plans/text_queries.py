"""Queries of parsers, small text forms, writers and prompts. Texts of models, which the tables do not hold, are put
together from the tables' own columns as a model would write them, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import models as M
from tideline.functions import parsing as P
from tideline.plans.base import BR, EV, QN, bridge, events, store_questions, vectors
from tideline.plans.graph_queries import EDGES, edges
from tideline.registry import Registry
from tideline.session import scratch_dir
from tideline.sources import stores
from tideline.sources.tables import table

R = Registry()


def _written(no, body):
    """A JSON text as models write it: plain, fenced, or cut off."""
    return F.when(no % 3 == 0, body).when(no % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.expr("left(body, length(body) - 3)"))


@R.query("parse_query_type", "SELECT response_id, CASE WHEN response_id % 3 = 2 THEN FALSE ELSE coalesce(contains(lower(question), 'how many'), FALSE) END AS counting, CASE WHEN response_id % 3 < 2 AND contains(lower(question), 'after') THEN 'after' ELSE 'none' END AS direction, CASE WHEN response_id % 3 = 2 THEN FALSE ELSE coalesce(contains(lower(question), 'where'), FALSE) END AS spatial, FALSE AS content FROM responses")
def parse_query_type(spark, sf):
    """Type of a question as a model's JSON, with safe defaults for what is missing or unreadable."""
    q = F.lower(F.coalesce("question", F.lit("")))
    word = lambda w: F.contains(q, F.lit(w)).cast("string")
    body = F.concat(F.lit('{"needs_counting": '), word("how many"), F.lit(', "needs_temporal_direction": '), F.when(F.contains(q, F.lit("after")), F.lit('" After "')).otherwise(F.lit("null")), F.lit(', "needs_spatial_positions": '), word("where"), F.lit("}"))
    d = table(spark, sf, "responses").select("response_id", body.alias("body")).withColumn("t", _written(F.col("response_id"), F.col("body"))).withColumn("p", P.query_type(F.col("t")))
    return d.select("response_id", F.col("p.needs_counting").alias("counting"), F.col("p.needs_temporal_direction").alias("direction"), F.col("p.needs_spatial_positions").alias("spatial"), F.col("p.has_content_text").alias("content"))


@R.query("parse_keyword_strategy", "SELECT response_id, CASE WHEN response_id % 3 = 2 THEN 'both' WHEN options IS NULL THEN 'question_only' WHEN method = 'tree' THEN 'both' ELSE 'options_only' END AS strategy FROM responses")
def parse_keyword_strategy(spark, sf):
    """Keyword strategy as a model's JSON; an unknown one, or an unreadable text, is ``both``."""
    s = F.when(F.col("options").isNull(), " Question_Only").when(F.col("method") == "tree", "by tree").otherwise("options_only")
    d = table(spark, sf, "responses").select("response_id", F.concat(F.lit('{"strategy": "'), s, F.lit('"}')).alias("body"))
    return d.select("response_id", P.keyword_strategy(_written(F.col("response_id"), F.col("body"))).alias("strategy"))


def _time_json(q):
    """A temporal analysis put together from a question's time reference: a range, a point, or several."""
    ref = F.coalesce(F.trim("time_reference"), F.lit(""))
    a, b = F.trim(F.get(F.split(ref, "-", 2), F.lit(0))), F.trim(F.get(F.split(ref, "-", 2), F.lit(1)))
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    rng = F.concat(F.lit('{"start": '), text(a), F.lit(', "end": '), text(b), F.lit("}"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.split(ref, ","), lambda x: F.concat(F.lit('"'), F.trim(x), F.lit('"'))), ", "), F.lit("]"))
    loc = F.when(ref.contains("-"), F.concat(F.lit('{"exists": true, "type": "range", "value": '), rng, F.lit("}"))).when(ref.contains(","), F.concat(F.lit('{"exists": true, "type": "multiple", "values": '), listed, F.lit("}")))
    loc = loc.when(ref.rlike("[0-9]"), F.concat(F.lit('{"exists": true, "type": "exact", "value": '), text(ref), F.lit("}"))).otherwise(F.lit('{"exists": false, "type": "position", "value": "end"}'))
    return q.select("store_no", "question_id", F.concat(F.lit('{"localization_time": '), loc, F.lit(', "content_time": {"exists": '), ref.contains(",").cast("string"), F.lit(', "values": '), F.when(ref.contains(","), listed).otherwise(F.lit("[]")), F.lit("}}")).alias("body"))


def _s(x: str) -> str:
    p = f"list_filter(string_split_regex(trim({x}), '[:.]'), lambda p: regexp_full_match(p, '[0-9]+'))"
    n = lambda i: f"CAST(({p})[{i}] AS BIGINT)"
    return f"CASE len({p}) WHEN 0 THEN 0 WHEN 1 THEN {n(1)} WHEN 2 THEN {n(1)} * 60 + {n(2)} ELSE {n(1)} * 3600 + {n(2)} * 60 + {n(3)} END"


_REFS = f"WITH {QN}, r AS (SELECT store_no, question_id, CASE WHEN question_id % 3 = 2 THEN '' ELSE coalesce(trim(ref), '') END AS t, trim(split_part(coalesce(trim(ref), ''), '-', 1)) AS a, trim(substr(coalesce(trim(ref), ''), instr(coalesce(trim(ref), ''), '-') + 1)) AS b FROM qn)"


@R.query("parse_localization_segments", f"""{_REFS} SELECT store_no, question_id, 0 AS place, least({_s('a')}, {_s('b')}) AS gs, greatest({_s('a')}, {_s('b')}) AS ge FROM r WHERE contains(t, '-') AND a <> '' AND b <> ''
UNION ALL SELECT store_no, question_id, i, x, x FROM (SELECT store_no, question_id, unnest(range(len(string_split(t, ',')))) AS i, unnest(list_transform(string_split(t, ','), lambda y: {_s('y')})) AS x, unnest(list_transform(string_split(t, ','), lambda y: trim(y))) AS w FROM r WHERE NOT contains(t, '-') AND contains(t, ',')) WHERE w <> ''
UNION ALL SELECT store_no, question_id, 0, {_s('t')}, {_s('t')} FROM r WHERE NOT contains(t, '-') AND NOT contains(t, ',') AND regexp_matches(t, '[0-9]')""")
def parse_localization_segments(spark, sf):
    """Segments of a localization time: a point, a range or several; none for a position or an unreadable text."""
    d = _time_json(store_questions(spark, sf)).withColumn("z", P.localization_segments(_written(F.col("question_id"), F.col("body"))))
    return d.select("store_no", "question_id", F.explode("z").alias("z")).select("store_no", "question_id", F.col("z.place").cast("bigint").alias("place"), "z.gs", "z.ge")


@R.query("parse_temporal_analysis", f"""{_REFS} SELECT store_no, question_id, contains(t, '-') OR contains(t, ',') OR regexp_matches(t, '[0-9]') AS has_localization, contains(t, ',') AND NOT contains(t, '-') OR contains(t, ',') AS has_content,
CASE WHEN contains(t, '-') THEN {_s('a')} WHEN contains(t, ',') THEN NULL WHEN regexp_matches(t, '[0-9]') THEN {_s('t')} END AS loc_lo, CASE WHEN contains(t, '-') THEN {_s('b')} WHEN contains(t, ',') THEN NULL WHEN regexp_matches(t, '[0-9]') THEN {_s('t')} END AS loc_hi,
CASE WHEN contains(t, ',') THEN list_min(list_transform(string_split(t, ','), lambda y: {_s('y')})) END AS con_lo, CASE WHEN contains(t, ',') THEN list_max(list_transform(string_split(t, ','), lambda y: {_s('y')})) END AS con_hi FROM r""")
def parse_temporal_analysis(spark, sf):
    """Temporal analysis of a question: whether it names a time and contents, and their seconds (of several the least and
    the greatest); nothing of a text that is cut off."""
    d = _time_json(store_questions(spark, sf)).withColumn("p", P.temporal_analysis(_written(F.col("question_id"), F.col("body"))))
    g = lambda c, i: F.get(F.col(f"p.{c}"), F.lit(i))
    return d.select("store_no", "question_id", "p.has_localization", "p.has_content", g("localization", 0).alias("loc_lo"), g("localization", 1).alias("loc_hi"), g("content", 0).alias("con_lo"), g("content", 1).alias("con_hi"))


_CL = lambda i: f"regexp_extract(t, '(\\d{{1,2}}):(\\d{{1,2}})(?::(\\d{{1,2}}))?', {i})"
_CLK = f"CASE WHEN {_CL(1)} <> '' THEN CAST({_CL(1)} AS BIGINT) * 3600 + CAST({_CL(2)} AS BIGINT) * 60 + coalesce(TRY_CAST(nullif({_CL(3)}, '') AS BIGINT), 0) END"


@R.query("parse_display_segments", f"WITH {QN}, v AS (SELECT store_no, question_id, trim(ref) AS t FROM qn WHERE ref IS NOT NULL), c AS (SELECT store_no, question_id, i, t FROM (SELECT store_no, question_id, unnest(range(len(string_split(t, ',')))) AS i, unnest(string_split(t, ',')) AS t FROM v)) SELECT store_no, question_id, 'value' AS source, {_CLK} AS gs FROM v WHERE {_CLK} IS NOT NULL UNION ALL SELECT store_no, question_id, 'content', {_CLK} FROM c WHERE {_CLK} IS NOT NULL")
def parse_display_segments(spark, sf):
    """Clock times that a question's reference shows, as a value and as a list of contents."""
    q = store_questions(spark, sf).where("time_reference is not null")
    z = F.explode(P.display_segments(F.trim("time_reference"), F.split(F.trim("time_reference"), ","))).alias("z")
    return q.select("store_no", "question_id", z).select("store_no", "question_id", "z.source", "z.gs")


@R.query("duration_text", """SELECT store_no, pos, count(*) AS n, min(CASE WHEN len(duration) >= 2 AND duration[1] IS NOT NULL AND duration[2] IS NOT NULL THEN CASE WHEN duration[1] > 10000 OR duration[2] > 10000 THEN printf('%.2fs - %.2fs', duration[1] / 1000, duration[2] / 1000) ELSE printf('%.2fs - %.2fs', duration[1], duration[2]) END ELSE '' END) AS text FROM vdb_events GROUP BY store_no, pos""")
def duration_text(spark, sf):
    """Spans as text, ends over 10000 taken as milliseconds."""
    return table(spark, sf, "vdb_events").groupBy("store_no", "pos").agg(F.count("*").alias("n"), F.min(P.duration_text(F.col("duration"))).alias("text"))


@R.query("question_keys", "SELECT response_id, coalesce(video_key, '') AS video_key, coalesce(TRY_CAST(trim(question_id) AS BIGINT), -1) AS question_no FROM responses")
def question_keys(spark, sf):
    """Keys of results: the video, and the question's number or -1."""
    return table(spark, sf, "responses").select("response_id", F.coalesce("video_key", F.lit("")).alias("video_key"), P.question_key(F.col("question_id")).alias("question_no"))


@R.query("sentence_split", "SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS parts FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)")
def sentence_split(spark, sf):
    """Texts split at points, blanks around and blank parts left out (the parts as md5)."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", P.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("parts"))


@R.query("parse_object_query", "SELECT response_id, CASE WHEN response_id % 3 = 2 THEN coalesce(question, '') ELSE coalesce(method, '') END AS object, CASE WHEN response_id % 3 = 0 THEN prompt_tokens END AS lo, CASE WHEN response_id % 3 = 0 THEN prompt_tokens + 10 END AS hi FROM responses")
def parse_object_query(spark, sf):
    """Object and frame range of a query that a model has put into JSON somewhere in its text, else the text itself."""
    k = F.col("response_id") % 3
    frames = F.when((k == 0) & F.col("prompt_tokens").isNotNull(), F.concat(F.lit('{"start": '), F.col("prompt_tokens").cast("string"), F.lit(', "end": '), (F.col("prompt_tokens") + 10).cast("string"), F.lit("}"))).otherwise(F.lit("null"))
    body = F.concat(F.lit('Here it is: {"object_description": "'), F.coalesce("method", F.lit("")), F.lit('", "frame_range": '), frames, F.lit(', "constraints": []} as asked'))
    d = table(spark, sf, "responses").select("response_id", P.object_query(F.when(k == 2, F.coalesce("question", F.lit(""))).otherwise(body)).alias("p"))
    return d.select("response_id", F.col("p.object_description").alias("object"), "p.lo", "p.hi")


@R.query("parse_nested_list", "SELECT response_id, CASE WHEN options IS NULL THEN NULL ELSE array_to_string(list_transform(options, lambda x: coalesce(x, '?')), '|') END AS items FROM responses")
def parse_nested_list(spark, sf):
    """A member that is a list, or a list held in a JSON string."""
    j = F.to_json("options")
    held = F.when(F.col("response_id") % 2 == 0, F.to_json(F.struct(j.alias("track_ids")))).otherwise(F.concat(F.lit('{"track_ids": '), j, F.lit("}")))
    d = table(spark, sf, "responses").select("response_id", P.nested_list(F.concat(F.lit("```json\n"), held, F.lit("\n```")), "track_ids").alias("l"))
    return d.select("response_id", F.array_join("l", "|", "?").alias("items"))


@R.query("vector_hash")
def vector_hash(spark, sf):
    """md5 of each usable vector's float32 bytes, and how many vectors share it."""
    d = table(spark, sf, "nano_vectors").select("vec_id", "matrix").join(vectors(spark, sf).select("vec_id"), "vec_id").select("vec_id", P.vector_hash()(F.col("matrix")).alias("hash"))
    return d.groupBy("hash").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@R.query("json_safe_sets", f"WITH {EV}, {BR}, s AS (SELECT store_no, entity_id, list_sort(list(DISTINCT event_id)) AS events FROM br GROUP BY ALL) SELECT store_no, entity_id, '{{\"id\":\"' || entity_id || '\",\"n\":' || len(events) || ',\"events\":[' || array_to_string(list_transform(events, lambda x: '\"' || x || '\"'), ',') || ']}}' AS json FROM s")
def json_safe_sets(spark, sf):
    """Entities with their sets of events as JSON, sets sorted."""
    b = bridge(spark, sf).groupBy("store_no", "entity_id").agg(F.collect_list("event_id").alias("events"))
    return b.select("store_no", "entity_id", P.json_safe([F.col("entity_id").alias("id"), F.size(F.array_distinct("events")).alias("n")], ["events"]).alias("json"))


@R.query("prompt_render", f"WITH {EV} SELECT store_no, pos, 'Describe what happens between ' || CAST(floor(s) AS BIGINT) || ' and ' || CAST(floor(e) AS BIGINT) || ' seconds in one sentence.' AS prompt FROM ev")
def prompt_render(spark, sf):
    """Prompts from a template."""
    return events(spark, sf).select("store_no", "pos", P.prompt("caption", s=F.floor("s"), e=F.floor("e")).alias("prompt"))


@R.query("generate_retry", f"WITH {EV}, x AS (SELECT store_no, pos, length(description) % 5 AS k, description FROM ev WHERE description IS NOT NULL) SELECT store_no, pos, CASE WHEN k < 3 THEN upper(description) END AS response, CAST(least(k, 3) AS INT) AS fails FROM x")
def generate_retry(spark, sf):
    """U8: captions asked again until they are answered, at most three times (a stand-in model that answers a text of
    length n at attempt n mod 5)."""
    e = events(spark, sf).where("description is not null").select("store_no", "pos", F.col("description").alias("prompt"))
    return M.generate_with_retry(e, ["store_no", "pos"], "prompt", lambda ps, k: [p.upper() if len(p) % 5 <= k else None for p in ps]).select("store_no", "pos", "response", "fails")


# --- writers: what is written is read again -----------------------------------------------------


def _collections(spark, sf):
    return vectors(spark, sf).where("store_no is not null and vec_kind is not null").select("store_no", "vec_kind", F.col("vec_id").alias("id"), F.col("v").cast("array<float>").alias("v"))


_VR = "SELECT vec_id AS id, CAST(matrix[1] AS DOUBLE) AS x0, len(matrix) AS dim FROM nano_vectors WHERE vec_id IS NOT NULL AND store_no IS NOT NULL AND vec_kind IS NOT NULL AND len(matrix) = embedding_dim AND len(list_filter(matrix, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(matrix, lambda x: x <> 0)) > 0"


@R.query("vector_store_write", _VR)
def vector_store_write(spark, sf):
    """Vector collections written in their native form and read again."""
    path = scratch_dir(spark, "vectors")
    stores.write_vectors(_collections(spark, sf), path)
    return stores.read_vectors(spark, path).select("id", F.get("v", F.lit(0)).cast("double").alias("x0"), F.size("v").alias("dim"))


@R.query("vector_collection_exchange", _VR)
def vector_collection_exchange(spark, sf):
    """Vector collections exported as JSON with a base64 matrix and read again."""
    path = scratch_dir(spark, "collections")
    stores.export_vector_collections(_collections(spark, sf), path)
    got = stores.read_vector_collection(spark, path, lines=True)
    return got.select(F.col("id").cast("bigint").alias("id"), F.get("v", F.lit(0)).cast("double").alias("x0"), F.size("v").alias("dim"))


@R.query("graphml_write", f"WITH {EDGES} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN id LIKE 'Event-%' THEN 'event' WHEN id LIKE 'Entity-%' THEN 'entity' ELSE 'other' END AS kind FROM (SELECT a AS id FROM ed UNION SELECT b FROM ed)) GROUP BY kind UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT a, b FROM ed)")
def graphml_write(spark, sf):
    """The graph written as GraphML and read again: nodes by kind, and edges."""
    e = edges(spark, sf).select("a", "b").distinct().withColumn("weight", F.lit(1.0))
    path = scratch_dir(spark, "graph") + ".graphml"
    stores.write_graphml(e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct(), e, path)
    nodes, back = stores.read_graphml(spark, stores.find_graphml(spark, path))
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).unionByName(back.where("weight = 1").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "n"))


@R.query("results_write", "SELECT store_no, question_id, method, arg_max(response_id, row(created_at, response_id)) AS response_id FROM responses WHERE store_no IS NOT NULL AND created_at IS NOT NULL GROUP BY ALL")
def results_write(spark, sf):
    """Results written with one row per key, the last one, and read again."""
    path = scratch_dir(spark, "results")
    r = table(spark, sf, "responses").where("store_no is not null and created_at is not null").select("store_no", "question_id", "method", "response_id", "created_at")
    stores.write_results(r, path, ["store_no", "question_id", "method"], ["created_at", "response_id"])
    return spark.read.parquet(path).select("store_no", "question_id", "method", "response_id")


@R.query("results_flush", "SELECT 'first' AS run, count(*) FILTER (method = 'tree') AS added FROM responses UNION ALL SELECT 'second', count(*) FILTER (method IS NULL OR method <> 'tree') FROM responses UNION ALL SELECT 'again', 0")
def results_flush(spark, sf):
    """A table flushed in two runs and once more: only what is not there yet is added."""
    path = scratch_dir(spark, "flush")
    r = table(spark, sf, "responses").select("response_id", "method")
    added = [stores.flush(r.where("method = 'tree'"), path, ["response_id"]), stores.flush(r, path, ["response_id"]), stores.flush(r, path, ["response_id"])]
    return spark.createDataFrame(list(zip(("first", "second", "again"), added)), "run string, added bigint")


@R.query("report_write", "SELECT method, count(*) AS n, round(avg(latency_seconds), 3) AS latency FROM responses WHERE method IS NOT NULL GROUP BY method")
def report_write(spark, sf):
    """A report written as CSV and read again."""
    path = scratch_dir(spark, "report")
    r = table(spark, sf, "responses").where("method is not null").groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("latency_seconds"), 3).alias("latency"))
    stores.report(r, path)
    return spark.read.option("header", True).schema("method string, n bigint, latency double").csv(path)


@R.query("dataset_ranges", "SELECT dataset, count(*) AS videos, min(store_no) AS first_no, max(store_no) AS last_no FROM video_stores WHERE dataset IS NOT NULL GROUP BY dataset")
def dataset_ranges(spark, sf):
    """Registry of the data sets with the numbers of their videos."""
    return table(spark, sf, "video_stores").where("dataset is not null").groupBy("dataset").agg(F.count("*").alias("videos"), F.min("store_no").alias("first_no"), F.max("store_no").alias("last_no"))


@R.query("merge_seed_files", "WITH x AS (SELECT coalesce(video_key, '') AS video_key, coalesce(TRY_CAST(trim(question_id) AS BIGINT), -1) AS question_no, CASE method WHEN 'tree' THEN 0 WHEN 'multimode' THEN 1 ELSE 2 END AS f, response_id FROM responses WHERE method IS NOT NULL) SELECT video_key, question_no, count(*) AS n, string_agg(CAST(response_id AS VARCHAR), ',' ORDER BY f, response_id) AS ids FROM x GROUP BY ALL")
def merge_seed_files(spark, sf):
    """Entries of several files with one normalised key put together, in order of the files."""
    r = table(spark, sf, "responses").where("method is not null")
    f = F.when(F.col("method") == "tree", 0).when(F.col("method") == "multimode", 1).otherwise(2)
    x = r.select(F.coalesce("video_key", F.lit("")).alias("video_key"), P.question_key(F.col("question_id")).alias("question_no"), F.struct(f.alias("f"), "response_id").alias("x"))
    return x.groupBy("video_key", "question_no").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda z: z["response_id"].cast("string")), ",").alias("ids"))
