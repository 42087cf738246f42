"""Queries of ingestion, sources, model surfaces, streams, and the flagship slice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import models as M
from tideline.operators import explore as X
from tideline.operators import ingest as G
from tideline.operators import ingest as N
from tideline.operators import intervals as I
from tideline.operators import seeds as S
from tideline.operators.metrics import MEASURES, retrieval_accuracy
from tideline.operators.ordering import numbered, prev_next
from tideline.plans.base import BR, EV, GT, QA, SD, bridge, events, json_scalar, seeds, valid_sql, valid_truth
from tideline.plans.eval_queries import _ACC, _rounded
from tideline.plans.graph_queries import EDGES, PN, edges, relations, top_seeds
from tideline.plans.interval_queries import _FIRST, _ranked, temporal_neighbours
from tideline.plans.list_queries import _NAME, _classes, cache_rows
from tideline.registry import Registry
from tideline.session import checkpointed, scratch_dir
from tideline.sources import stores
from tideline.sources.tables import table
from tideline.streaming import streams as W

R = Registry()


_SLICE = f"""WITH {SD}, {_FIRST}, top AS ({_ranked("score DESC NULLS FIRST, ord", 30)}), {PN},
nb AS (SELECT DISTINCT t.store_no, t.question_id, u.e AS event_id FROM top t JOIN pn ON pn.store_no = t.store_no AND pn.event_id = t.event_id, LATERAL (SELECT pn.p AS e UNION ALL SELECT pn.n) u WHERE u.e IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM top z WHERE z.store_no = t.store_no AND z.question_id = t.question_id AND z.event_id = u.e)),
cnd AS (SELECT store_no, question_id, event_id, 0 AS extra, rnk AS place FROM top UNION ALL SELECT store_no, question_id, event_id, 1, 0 FROM nb),
cap AS (SELECT store_no, question_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY extra, place, event_id) AS slot FROM cnd) WHERE slot <= 80),
pay AS (SELECT store_no, event_id, arg_min(s, pos) AS s, arg_min(e, pos) AS e, arg_min(ms, pos) AS ms, arg_min(me, pos) AS me FROM ev GROUP BY ALL), {GT}, vt AS (SELECT gt.* FROM gt JOIN qn USING (store_no, question_id) WHERE {valid_sql("qn.ref")}),
raw AS (SELECT cap.store_no, cap.question_id, cap.event_id, pay.s, pay.e, pay.ms, pay.me FROM cap JOIN pay ON pay.store_no = cap.store_no AND pay.event_id = cap.event_id),
cf AS (SELECT *, max(me) OVER (PARTITION BY store_no, question_id ORDER BY ms, me ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tp FROM raw),
nc AS (SELECT store_no, question_id, CAST(sum(CASE WHEN tp IS NULL OR ms > tp + 30000 THEN 1 ELSE 0 END) AS BIGINT) AS n_clusters FROM cf GROUP BY ALL),
x AS{_ACC.partition("x AS")[2]}
SELECT acc.store_no, acc.question_id, n_events, n_segments, tp_evt, tp_seg, total_s, hit, {_rounded(MEASURES)}, n_clusters FROM acc LEFT JOIN nc ON nc.store_no = acc.store_no AND nc.question_id = acc.question_id"""


@R.query("flagship_slice", _SLICE)
def flagship_slice(spark, sf):
    """Seeds, temporal neighbours, cap at 80, clusters at a gap of 30 s, accuracy against the truth."""
    top = checkpointed(S.topk_nulls_first(seeds(spark, sf), 30))  # read three times
    capped = S.budget_cap(top, temporal_neighbours(spark, sf, top), 80)
    pay = events(spark, sf).groupBy("store_no", "event_id").agg(F.min("pos").alias("ord"), F.min_by(F.struct("s", "e", "ms", "me"), "pos").alias("x"))
    found = checkpointed(capped.join(pay, ["store_no", "event_id"]).select("store_no", "question_id", "event_id", "ord", "x.s", "x.e", "x.ms", "x.me"))
    spans = found.select(F.concat_ws(":", "store_no", "question_id").alias("q"), F.col("ms").alias("s"), F.col("me").alias("e"))
    n = I.merged(spans, "q", 30_000).groupBy("q").agg(F.count("*").alias("n_clusters"))
    acc = retrieval_accuracy(found, valid_truth(spark, sf)).withColumn("q", F.concat_ws(":", "store_no", "question_id"))
    return acc.join(n, "q", "left").drop("q").withColumns({m: F.round(m, 6) for m in MEASURES})


# --- chunks, registries, sources --------------------------------------------------------------


@R.query("chunks_by_count", f"""WITH {EV}, n AS (SELECT store_no, pos, row_number() OVER (PARTITION BY store_no ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY store_no) AS c FROM ev)
SELECT store_no, pos, r // 6 AS chunk_no, r // 6 - 1 AS tag FROM n WHERE r < c // 6 * 6""")
def chunks_by_count(spark, sf):
    """Chunks of six rows; the partial last one is discarded; rows carry the number of the chunk before."""
    r = numbered(events(spark, sf).select("store_no", "pos"), ["store_no"], "pos").where("rank0 < group_size div 6 * 6")
    return r.select("store_no", "pos", F.floor(F.col("rank0") / 6).alias("chunk_no"), (F.floor(F.col("rank0") / 6) - 1).alias("tag"))


@R.query("dataset_groups", "SELECT store_no, dataset, (row_number() OVER (PARTITION BY dataset ORDER BY store_no) - 1) // 3 + 1 AS video_no FROM video_stores WHERE dataset IS NOT NULL")
def dataset_groups(spark, sf):
    """Three consecutive rows of a data set are one video."""
    v = numbered(table(spark, sf, "video_stores").where("dataset is not null").select("store_no", "dataset"), ["dataset"], "store_no")
    return v.select("store_no", "dataset", (F.floor(F.col("rank0") / 3) + 1).alias("video_no"))


@R.query("store_by_stem", r"""SELECT v.store_no, regexp_extract(v.source_path, '([^/]+)\.[^./]+$', 1) AS stem, count(e.pos) AS n_events FROM video_stores v LEFT JOIN (SELECT DISTINCT video_key, store_no, pos FROM vdb_events) e ON e.store_no = v.store_no AND e.video_key = regexp_extract(v.source_path, '([^/]+)\.[^./]+$', 1) GROUP BY ALL""")
def store_by_stem(spark, sf):
    """Stores resolved by the stem of their source path."""
    v = table(spark, sf, "video_stores").select("store_no", F.regexp_extract("source_path", "([^/]+)\\.[^./]+$", 1).alias("stem"))
    e = table(spark, sf, "vdb_events").select("store_no", F.col("video_key").alias("stem"), "pos").distinct()
    return v.join(e, ["store_no", "stem"], "left").groupBy("store_no", "stem").agg(F.count("pos").alias("n_events"))


@R.query("video_info_upsert", "SELECT source_path, store_no, width FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY created_at DESC, store_no DESC) AS rn FROM video_stores WHERE source_path IS NOT NULL) WHERE rn = 1")
def video_info_upsert(spark, sf):
    """Video info: the last row per path replaces earlier ones."""
    v = table(spark, sf, "video_stores").where("source_path is not null")
    g = v.groupBy("source_path").agg(F.max_by(F.struct("store_no", "width"), F.struct("created_at", "store_no")).alias("x"))
    return g.select("source_path", "x.store_no", "x.width")


@R.query("merge_results", """SELECT store_no, question_id, count(*) AS n, string_agg(CAST(response_id AS VARCHAR), ',' ORDER BY response_id) AS ids FROM responses WHERE method IN ('tree', 'multimode') AND store_no IS NOT NULL GROUP BY store_no, question_id""")
def merge_results(spark, sf):
    """Entries of several result files with the same key put together."""
    r = table(spark, sf, "responses").where("store_no is not null").select("store_no", "question_id", "method", "response_id")
    both = r.where("method = 'tree'").unionByName(r.where("method = 'multimode'"))
    return both.groupBy("store_no", "question_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("response_id")), ",").alias("ids"))


_QQ = rf"""WITH {QA}, b AS (SELECT file_id, video_no, question_no, coalesce(nullif({json_scalar("(q -> 'question_id')")}, ''), {json_scalar("(q -> 'uid')")}) AS question_id, coalesce(nullif({json_scalar("(q -> 'query')")}, ''), {json_scalar("(q -> 'question')")}) AS text,
{json_scalar("(q -> 'answer')")} AS answer, {json_scalar("(q -> 'time_reference')")} AS time_reference, coalesce((q -> 'options'), CAST('null' AS JSON)) AS o, coalesce((q -> 'question_type'), CAST('null' AS JSON)) AS k FROM qq)
SELECT file_id, video_no, question_no, question_id, text, answer, time_reference, trim(regexp_extract(text, '(?s)^(.*?)(?:\n\(A\).*)?$', 1)) AS stem, regexp_extract(text, '(?s)\n(\(A\).*)$', 1) AS inline_options,
CASE json_type(o) WHEN 'ARRAY' THEN array_to_string(list_transform(CAST(o AS VARCHAR[]), lambda x: coalesce(x, '?')), '|') END AS options, CASE json_type(k) WHEN 'ARRAY' THEN array_to_string(list_transform(CAST(k AS VARCHAR[]), lambda x: coalesce(x, '?')), '|') WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN NULL ELSE (k ->> '$') END AS question_type FROM b"""


@R.query("qa_questions", _QQ)
def qa_questions(spark, sf):
    """Questions of all layouts with stem, options in their order, answer, time reference and types."""
    q = stores.questions(table(spark, sf, "qa_files"))
    kind = F.col("question_type")
    kinds = F.when(F.startswith(kind, F.lit("[")), F.array_join(F.from_json(kind, "array<string>"), "|", "?")).otherwise(kind)
    return q.select("file_id", "video_no", "question_no", "question_id", "text", "answer", "time_reference", "stem", "inline_options", F.array_join(F.from_json("options", "array<string>"), "|", "?").alias("options"), kinds.alias("question_type"))


_AK = f"""WITH {QA}, b AS (SELECT file_id, video_no, question_no, coalesce(nullif({json_scalar("(q -> 'question_id')")}, ''), {json_scalar("(q -> 'uid')")}) AS qid, {json_scalar("(q -> 'answer')")} AS answer, CASE json_type((q -> 'options')) WHEN 'ARRAY' THEN CAST((q -> 'options') AS VARCHAR[]) END AS l FROM qq),
c AS (SELECT file_id, video_no, question_no, qid, answer, regexp_replace(CASE WHEN ascii(upper(answer)) >= 65 THEN l[ascii(upper(answer)) - 64] END, '^\\(?[A-Da-d][).:]\\s*', '') AS statement FROM b WHERE answer IS NOT NULL)
SELECT file_id, video_no, 'place' AS key_kind, CAST(question_no AS VARCHAR) AS key, answer, statement FROM c UNION ALL SELECT file_id, video_no, 'id', qid, answer, statement FROM c WHERE qid IS NOT NULL"""


@R.query("qa_answer_keys", _AK)
def qa_answer_keys(spark, sf):
    """Answers under the question's place and under its id, with the chosen option as a statement."""
    q = stores.questions(table(spark, sf, "qa_files"))
    opts = F.from_json("options", "array<string>")
    chosen = F.get(opts, F.ascii(F.upper("answer")) - 65)
    base = q.where("answer is not null").select("file_id", "video_no", F.col("question_no").cast("string").alias("place"), "question_id", "answer", F.regexp_replace(chosen, "^\\(?[A-Da-d][).:]\\s*", "").alias("statement"))
    a = base.select("file_id", "video_no", F.lit("place").alias("key_kind"), F.col("place").alias("key"), "answer", "statement")
    b = base.where("question_id is not null").select("file_id", "video_no", F.lit("id").alias("key_kind"), F.col("question_id").alias("key"), "answer", "statement")
    return a.unionByName(b)


@R.query("entity_rows_merged", """WITH u AS (SELECT store_no, id, unnest(timestamps) AS t FROM vdb_entities WHERE id IS NOT NULL AND store_no IS NOT NULL) SELECT store_no, id AS entity_id, count(DISTINCT t) AS n_times, min(t) AS first_t, max(t) AS last_t FROM u WHERE t IS NOT NULL GROUP BY store_no, id""")
def entity_rows_merged(spark, sf):
    """G14 (arrays): rows of one entity put together with distinct times."""
    u = table(spark, sf, "vdb_entities").where("id is not null and store_no is not null").select("store_no", F.col("id").alias("entity_id"), F.explode("timestamps").alias("t")).where("t is not null")
    return u.groupBy("store_no", "entity_id").agg(F.count_distinct("t").alias("n_times"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@R.query("entity_kmeans_merge")
def entity_kmeans_merge(spark, sf):
    """Entities of one name clustered by all descriptions of all their rows."""
    return G.merge_entities(_described(spark, sf))


def _described(spark, sf):
    e = table(spark, sf, "vdb_entities").where("id is not null and store_no is not null and size(descriptions) > 0")
    first = e.groupBy("store_no", F.col("id").alias("entity_id")).agg(F.min(F.get(F.filter("descriptions", lambda d: d.isNotNull()), F.lit(0))).alias("first"))
    u = e.select("store_no", F.col("id").alias("entity_id"), F.explode("descriptions").alias("d")).where("d is not null")
    whole = u.groupBy("store_no", "entity_id").agg(F.array_join(F.array_sort(F.collect_set("d")), " ").alias("description"))
    named = first.join(whole, ["store_no", "entity_id"]).where("first is not null")
    return named.select("store_no", "entity_id", "description", F.lower(F.substring_index("first", ",", 1)).alias("name"))


@R.query("entity_merge_payload", f"""WITH {_NAME}, e AS (SELECT v.*, nm.class FROM (SELECT *, row_number() OVER (PARTITION BY store_no, id ORDER BY loaded_at DESC, len(coalesce(events, [])) DESC, len(coalesce(descriptions, [])) DESC) AS rn FROM vdb_entities WHERE id IS NOT NULL AND store_no IS NOT NULL) v JOIN nm ON nm.store_no = v.store_no AND nm.entity_id = v.id WHERE rn = 1),
d AS (SELECT store_no, class, string_agg(d, '' ORDER BY id) AS ds, count(d) AS nd FROM (SELECT store_no, class, id, descriptions[1] AS d FROM e) GROUP BY ALL),
t AS (SELECT store_no, class, array_to_string(list_sort(list(DISTINCT x)), ',') AS frames FROM (SELECT store_no, class, unnest(frame_indices) AS x FROM e) WHERE x IS NOT NULL GROUP BY ALL),
g AS (SELECT store_no, class, count(*) AS members FROM e GROUP BY ALL)
SELECT g.store_no, g.class, 'Entity-' || md5(coalesce(d.ds, '')) AS new_id, g.members, d.nd AS descriptions, coalesce(t.frames, '') AS frames FROM g JOIN d ON d.store_no = g.store_no AND d.class = g.class LEFT JOIN t ON t.store_no = g.store_no AND t.class = g.class""")
def entity_merge_payload(spark, sf):
    """G14 (payload): entities of one group (here a class) as one: id of the descriptions put together, distinct frames."""
    m = N.merged_payload(_latest_entities(spark, sf), ["store_no", "class"])
    return m.select("store_no", "class", "new_id", "members", F.size("descriptions").cast("bigint").alias("descriptions"), F.array_join(F.array_sort("frame_indices"), ",").alias("frames"))


def _latest_entities(spark, sf):
    raw = table(spark, sf, "vdb_entities").where("id is not null and store_no is not null")
    size = lambda c: F.desc(F.size(F.coalesce(c, F.array().cast("array<string>"))))
    w = Window.partitionBy("store_no", "id").orderBy(F.desc("loaded_at"), size("events"), size("descriptions"))
    return raw.withColumn("r", F.row_number().over(w)).where("r = 1").withColumnRenamed("id", "entity_id").join(_classes(spark, sf), ["store_no", "entity_id"])


@R.query("entity_relations_rewritten")
def entity_relations_rewritten(spark, sf):
    """G14 (relations): relations with their ends put to the merged entities, those of an entity with itself included."""
    m = G.merge_entities(_described(spark, sf))
    return N.rewritten(relations(spark, sf), m)


_RAW = f"""{BR}, {_NAME}, fd AS (SELECT store_no, id AS entity_id, min(d) AS d FROM (SELECT store_no, id, unnest(descriptions) AS d FROM vdb_entities WHERE store_no IS NOT NULL AND id IS NOT NULL) WHERE d IS NOT NULL GROUP BY ALL),
px AS (SELECT store_no, event_id, arg_min(s, pos) AS s, arg_min(e, pos) AS e FROM ev GROUP BY ALL),
rw AS (SELECT b.store_no, b.event_id, row_number() OVER (PARTITION BY b.store_no, b.event_id ORDER BY b.entity_id) - 1 AS i, coalesce(nm.class, 'unknown') AS name, fd.d AS description, px.s, px.e FROM (SELECT DISTINCT store_no, entity_id, event_id FROM br) b JOIN px ON px.store_no = b.store_no AND px.event_id = b.event_id JOIN fd ON fd.store_no = b.store_no AND fd.entity_id = b.entity_id LEFT JOIN nm ON nm.store_no = b.store_no AND nm.entity_id = b.entity_id),
fe AS (SELECT * FROM (SELECT store_no, event_id, i, name, description, 'Entity-' || md5(name || description) AS entity_id, list_filter([CASE WHEN i IN (0, 1) THEN s END, CASE WHEN i IN (1, 2) THEN (s + e) / 2 END], lambda x: x IS NOT NULL) AS stamps, row_number() OVER (PARTITION BY store_no, event_id, name ORDER BY i) AS rn FROM rw WHERE i <= 2) WHERE rn = 1)"""


def _extracted(spark, sf):
    """Entities of every event as an extraction gives them: place in the list, name, description and the indices of the
    two frames (start and middle of the event) they are seen in, some of which do not exist."""
    ev = events(spark, sf).groupBy("store_no", "event_id").agg(F.min_by(F.struct("s", "e"), "pos").alias("x"))
    d = table(spark, sf, "vdb_entities").where("store_no is not null and id is not null").select("store_no", F.col("id").alias("entity_id"), F.explode("descriptions").alias("d")).where("d is not null").groupBy("store_no", "entity_id").agg(F.min("d").alias("description"))
    b = bridge(spark, sf).select("store_no", "entity_id", "event_id").distinct().join(ev, ["store_no", "event_id"]).join(d, ["store_no", "entity_id"]).join(_classes(spark, sf), ["store_no", "entity_id"], "left")
    i = F.row_number().over(Window.partitionBy("store_no", "event_id").orderBy("entity_id")) - 1
    return b.select("store_no", "event_id", i.alias("place"), F.coalesce("class", F.lit("unknown")).alias("name"), "description", F.array(i - 1, i).alias("index"), F.array(F.col("x.s"), (F.col("x.s") + F.col("x.e")) / 2).alias("timestamps"))


@R.query("entity_format", f"WITH {EV}, {_RAW} SELECT store_no, event_id, name, entity_id, description, len(stamps) AS stamps, round(stamps[1], 6) AS first_stamp FROM fe")
def entity_format(spark, sf):
    """Extracted entities formatted: md5 ids, the first of each name of an event, indices out of range left out,
    entities without a time dropped."""
    e = N.formatted_entities(_extracted(spark, sf))
    return e.select("store_no", "event_id", "name", "entity_id", "description", F.size("stamps").cast("bigint").alias("stamps"), F.round(F.get("stamps", F.lit(0)), 6).alias("first_stamp"))


@R.query("relation_format", f"""WITH {EV}, {_RAW}, rr AS (SELECT store_no, event_id, i, name AS n1, lead(name) OVER (PARTITION BY store_no, event_id ORDER BY i) AS n2 FROM rw)
SELECT a.store_no, a.event_id, 'Relation-' || md5(rr.n1 || rr.n2 || 'next to') AS relation_id, a.entity_id AS entity1, b.entity_id AS entity2, 'next to' AS description FROM rr JOIN fe a ON a.store_no = rr.store_no AND a.event_id = rr.event_id AND a.name = rr.n1 JOIN fe b ON b.store_no = rr.store_no AND b.event_id = rr.event_id AND b.name = rr.n2 WHERE rr.n1 <> rr.n2""")
def relation_format(spark, sf):
    """Relations between formatted entities, by name; those with an unknown end or with itself are dropped."""
    x = _extracted(spark, sf)
    w = Window.partitionBy("store_no", "event_id").orderBy("place")
    r = x.select("store_no", "event_id", F.col("name").alias("name1"), F.lead("name").over(w).alias("name2"), F.lit("next to").alias("description")).where("name2 is not null")
    return N.formatted_relations(r, N.formatted_entities(x)).select("store_no", "event_id", "relation_id", "entity1", "entity2", "description")


@R.query("extraction_validate", f"WITH {EV}, {_RAW}, c AS (SELECT store_no, event_id, count(*) AS n FROM rw GROUP BY ALL) SELECT store_no, event_id, CASE n % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'ok' WHEN 2 THEN 'relation' ELSE 'unreadable' END AS verdict FROM c")
def extraction_validate(spark, sf):
    """Shape of an event's extraction as JSON (some without a description, some with a broken relation, some cut
    off): what is wrong with it first."""
    n = F.col("n")
    e = F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "description", "index"))), lambda x: F.struct(x["name"].alias("Entity_name"), x["description"].alias("Entity_description"), x["index"].alias("Index")))
    g = _extracted(spark, sf).groupBy("store_no", "event_id").agg(e.alias("e"), F.count("*").alias("n"))
    ents = F.when(n % 4 == 0, F.regexp_replace(F.to_json("e"), '"Entity_description":"[^"]*",', "")).otherwise(F.to_json("e"))
    rel = F.when(n % 4 == 2, F.lit('[{"Entity1": "a", "Relation_description": "b"}]')).otherwise(F.lit('[{"Entity1": "a", "Entity2": "b", "Relation_description": "c"}]'))
    text = F.concat(F.lit('{"Entities": '), ents, F.lit(', "Relations": '), rel, F.lit("}"))
    text = F.when(n % 4 == 3, F.substring(text, 1, 40)).otherwise(text)
    return g.select("store_no", "event_id", N.extraction_verdict(text).alias("verdict"))


_CHUNKS = f"""WITH RECURSIVE {EV}, w AS (SELECT store_no, pos, row_number() OVER (PARTITION BY store_no ORDER BY pos) AS rn, list_distinct(list_filter(string_split_regex(lower(coalesce(description, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS ws FROM ev),
st(store_no, rn, pos, first_pos, n, total, pairs, members) AS (SELECT store_no, rn, pos, pos, 1, CAST(0 AS DOUBLE), 0, [ws] FROM w WHERE rn = 1
UNION ALL SELECT store_no, rn, pos, CASE WHEN go THEN first_pos ELSE pos END, CASE WHEN go THEN n + 1 ELSE 1 END, CASE WHEN go THEN total + list_sum(ad) ELSE 0 END, CASE WHEN go THEN pairs + len(ad) ELSE 0 END, CASE WHEN go THEN list_append(members, ws) ELSE [ws] END FROM
  (SELECT *, n < 8 AND (total + list_sum(ad)) / (pairs + len(ad)) > 0.65 AND ad[len(ad)] > 0.65 AS go FROM (SELECT w.store_no, w.rn, w.pos, w.ws, st.first_pos, st.n, st.total, st.pairs, st.members, list_transform(st.members, lambda m: CASE WHEN len(w.ws) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(m, w.ws)) / len(w.ws) END) AS ad FROM st JOIN w ON w.store_no = st.store_no AND w.rn = st.rn + 1)))
SELECT store_no, first_pos, max(pos) AS last_pos, max(n) AS n FROM st GROUP BY store_no, first_pos"""


@R.query("semantic_chunking", _CHUNKS)
def semantic_chunking(spark, sf):
    """Greedy chunks of like captions."""
    return G.semantic_chunks(events(spark, sf))


# --- model surfaces ----------------------------------------------------------------------------


@R.query("embed_text_hash")
def embed_text_hash(spark, sf):
    """Hashed embeddings of captions, a stand-in for a text encoder."""
    e = events(spark, sf).where("description is not null").select("store_no", "pos", M.hash_embedder(16)(F.col("description")).alias("v"))
    return e.select("store_no", "pos", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("x0"), F.size("v").alias("dim"))


@R.query("generate_responses", f"WITH {EV} SELECT store_no, pos, description AS prompt, replace(upper(description), 'ß', 'SS') AS response FROM ev WHERE description IS NOT NULL")
def generate_responses(spark, sf):
    """Batched generation with error text for failed batches (a stand-in model that echoes)."""
    e = events(spark, sf).where("description is not null").select("store_no", "pos", F.col("description").alias("prompt"))
    return M.generate(e, "prompt", lambda ps: [p.upper() for p in ps])


@R.query("detect_udtf", f"""WITH {EV}, l AS (SELECT unnest(['camera', 'red', 'four', 'street']) AS label), d AS (SELECT store_no, pos, label, instr(lower(description), label) - 1 AS a, length(lower(description)) AS n FROM ev, l WHERE description IS NOT NULL) SELECT store_no, pos, label, floor((0.5 + length(label) / (2.0 * n)) * 1000 + 0.5) / 1000 AS score, CAST(a AS INT) AS "at", floor(a / n * 100 + 0.5) / 100 AS x0, floor((a + length(label)) / n * 100 + 0.5) / 100 AS x1 FROM d WHERE a >= 0""")
def detect_udtf(spark, sf):
    """One row per detected label of a caption, by a table function."""
    from pyspark.sql.functions import udtf

    f = udtf(M.Detector, returnType="label string, score double, at int, x0 double, y0 double, x1 double, y1 double")
    spark.udtf.register("tideline_detect", f)
    view = events(spark, sf).where("description is not null").select("store_no", "pos", "description")
    view.createOrReplaceTempView("tideline_captions")
    return spark.sql("SELECT c.store_no, c.pos, d.label, d.score, d.at, d.x0, d.x1 FROM tideline_captions c, LATERAL tideline_detect(c.description, 'camera,red,four,street') d")


@R.query("pair_word_overlap", r"""WITH ev AS (SELECT store_no, pos, description FROM (SELECT *, row_number() OVER (PARTITION BY store_no, pos ORDER BY loaded_at DESC) AS rn FROM vdb_events WHERE store_no IS NOT NULL AND pos IS NOT NULL) WHERE rn = 1 AND description IS NOT NULL),
w AS (SELECT store_no, pos, list_distinct(list_filter(string_split_regex(lower(description), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS a FROM ev), n AS (SELECT store_no, pos, a, lead(a) OVER (PARTITION BY store_no ORDER BY pos) AS b FROM w)
SELECT store_no, pos, round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(b) END, 6) AS score FROM n WHERE b IS NOT NULL""")
def pair_word_overlap(spark, sf):
    """U4: word overlap of a caption with the next, a stand-in for a pair scorer."""
    raw = table(spark, sf, "vdb_events").where("store_no is not null and pos is not null")
    one = raw.withColumn("r", F.row_number().over(Window.partitionBy("store_no", "pos").orderBy(F.desc("loaded_at")))).where("r = 1 and description is not null").select("store_no", "pos", F.col("description").alias("d"))
    n = prev_next(one, "store_no", "pos", "d").where("next_d is not null")
    return n.select("store_no", "pos", F.round(M.word_overlap(F.col("d"), F.col("next_d")), 6).alias("score"))


@R.query("query_objects", r"""SELECT response_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(string_split_regex(question, '[^\p{L}]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{2,}')), lambda x: lower(x)), lambda x: x NOT IN ('what', 'which', 'where', 'how', 'who')))), ',') AS objects FROM responses WHERE question IS NOT NULL""")
def query_objects(spark, sf):
    """Capitalised words of a question without question words."""
    return table(spark, sf, "responses").where("question is not null").select("response_id", F.array_join(M.capitalised_objects(F.col("question"), ["what", "which", "where", "how", "who"]), ",").alias("objects"))


# --- graph exploration by documented rules -----------------------------------------------------

_NRG = f"""{EDGES}, tr AS (SELECT store_no, node, round(sum(t), 6) AS t FROM (SELECT store_no, a AS node, CASE kind WHEN 'belong_to' THEN 0.9 WHEN 'event_time_relation' THEN 0.7 WHEN 'relation' THEN 0.8 ELSE 0.5 END AS t FROM ed UNION ALL SELECT store_no, b, CASE kind WHEN 'belong_to' THEN 0.9 WHEN 'event_time_relation' THEN 0.7 WHEN 'relation' THEN 0.8 ELSE 0.5 END FROM ed) GROUP BY ALL),
en AS (SELECT store_no, node, node LIKE 'Event-%' AS is_ev, CAST(t AS DOUBLE) / max(t) OVER (PARTITION BY store_no, node LIKE 'Event-%') AS energy FROM tr)"""


@R.query("graph_energy", f"WITH {_NRG} SELECT store_no, node, round(energy, 6) AS energy, round(energy / ln(3), 6) AS damped_1, round(energy / ln(7), 6) AS damped_5, energy >= CASE WHEN is_ev THEN 0.7 ELSE 0.6 END AS terminal FROM en")
def graph_energy(spark, sf):
    """Energy of each node by the trust of its edges, damped at iterations 1 and 5, and whether it is a
    terminal by its energy."""
    e = X.energies(edges(spark, sf))
    return e.select("store_no", "node", F.round("energy", 6).alias("energy"), F.round(X.damped(F.col("energy"), 1), 6).alias("damped_1"), F.round(X.damped(F.col("energy"), 5), 6).alias("damped_5"), (F.col("energy") >= X.by_sort(F.col("ev"), X.TERMINAL)).alias("terminal"))


@R.query("graph_triggers", f"WITH {_NRG} SELECT n.store_no, n.events, n.objects, m.edges, n.events > 50 OR n.objects > 100 OR m.edges > 300 AS prune FROM (SELECT store_no, count(*) FILTER (is_ev) AS events, count(*) FILTER (NOT is_ev) AS objects FROM en GROUP BY store_no) n JOIN (SELECT store_no, count(*) AS edges FROM ed GROUP BY store_no) m ON m.store_no = n.store_no")
def graph_triggers(spark, sf):
    """Sizes of each store's graph and whether it is to be pruned."""
    e = edges(spark, sf)
    return X.triggers(e, X.energies(e))


@R.query("graph_shape_strategy", f"""WITH {_NRG}, sh AS (SELECT n.store_no, n.n_events / n.n_objects AS r, 2.0 * m.n_edges / ((n.n_events + n.n_objects) * (n.n_events + n.n_objects - 1)) AS d, abs(n.kept - n.mean) / n.mean AS v FROM
(SELECT store_no, CAST(count(*) FILTER (is_ev) AS DOUBLE) AS n_events, CAST(count(*) FILTER (NOT is_ev) AS DOUBLE) AS n_objects, avg(energy) AS mean, avg(energy) FILTER (energy >= CASE WHEN is_ev THEN 0.3 ELSE 0.25 END) AS kept FROM en GROUP BY store_no) n JOIN (SELECT store_no, count(*) AS n_edges FROM ed GROUP BY store_no) m ON m.store_no = n.store_no WHERE n.n_objects > 0 AND n.n_events > 0)
SELECT store_no, round(r, 6) AS r, round(d, 6) AS d, round(v, 6) AS v, CASE WHEN r > 1.2 THEN 'GROUNDING' WHEN r < 0.6 THEN 'BRIDGING' WHEN d > 0.3 AND v < 0.05 THEN 'LEAPING' WHEN d < 0.1 THEN 'TRIANGULATION' ELSE 'BALANCED' END AS strategy FROM sh""")
def graph_shape_strategy(spark, sf):
    """Shape of each store's graph (events to objects, density, and by how much the mean score changes when weak
    nodes go) and the strategy it calls for."""
    e = edges(spark, sf)
    en = X.energies(e)
    n = en.groupBy("store_no").agg(F.count_if("ev").cast("double").alias("x"), F.count_if(~F.col("ev")).cast("double").alias("y"), F.avg("energy").alias("mean"), F.avg(F.when(F.col("energy") >= X.by_sort(F.col("ev"), X.STAYS), F.col("energy"))).alias("kept"))
    s = n.where("x > 0 and y > 0").join(e.groupBy("store_no").agg(F.count("*").alias("m")), "store_no")
    s = s.select("store_no", (F.col("x") / F.col("y")).alias("r"), (2.0 * F.col("m") / ((F.col("x") + F.col("y")) * (F.col("x") + F.col("y") - 1))).alias("d"), (F.abs(F.col("kept") - F.col("mean")) / F.col("mean")).alias("v"))
    return s.select("store_no", *(F.round(c, 6).alias(c) for c in ("r", "d", "v")), X.strategy(F.col("r"), F.col("d"), F.col("v")).alias("strategy"))


@R.query("graph_prune")
def graph_prune(spark, sf):
    """What stays of each store's best nodes: terminals (seeds among them), nodes that connect, and strong
    ones, after damping until the size is stable."""
    e = edges(spark, sf)
    top = top_seeds(spark, sf).where("rnk = 1").select("store_no", F.col("event_id").alias("node"))
    return X.pruned(e, X.energies(e), top)


# --- streams -----------------------------------------------------------------------------------


def _event_stream(spark, sf):
    s = W.source(spark, f"{sf}/vdb_events.parquet").where("store_no is not null and pos is not null and size(duration) = 2")
    a, b = F.get("duration", F.lit(0)), F.get("duration", F.lit(1))
    return s.where(b > a).select("store_no", "pos", F.round(a * 1000).cast("bigint").alias("ms"), F.round(b * 1000).cast("bigint").alias("me"))


_RAW = "rw AS (SELECT store_no, pos, CAST(round(duration[1] * 1000) AS BIGINT) AS ms, CAST(round(duration[2] * 1000) AS BIGINT) AS me FROM vdb_events WHERE store_no IS NOT NULL AND pos IS NOT NULL AND len(duration) = 2 AND duration[2] > duration[1])"


@R.query("stream_gap_clusters", f"""WITH {_RAW}, fl AS (SELECT *, max(me) OVER (PARTITION BY store_no ORDER BY ms, me, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rw),
isl AS (SELECT *, sum(CASE WHEN top IS NULL OR ms > top + 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY store_no ORDER BY ms, me, pos ROWS UNBOUNDED PRECEDING) AS g FROM fl)
SELECT store_no, min(ms) AS s, max(me) AS e, count(*) AS n FROM isl GROUP BY store_no, g""")
def stream_gap_clusters(spark, sf):
    """Gap clusters of the event stream."""
    return W.windows_of(_event_stream(spark, sf), lambda e: W.gap_clusters(e, 30_000), "gap-clusters")


@R.query("stream_sliding_chunks", f"""WITH {_RAW}, w AS (SELECT store_no, unnest([ms // 20000 * 20000, ms // 20000 * 20000 - 20000]) AS s, ms FROM rw) SELECT store_no, s, count(*) AS n FROM w WHERE ms >= s AND ms < s + 30000 GROUP BY store_no, s""")
def stream_sliding_chunks(spark, sf):
    """Events per sliding chunk of 30 s that shares 10 s with the next."""
    return W.windows_of(_event_stream(spark, sf), lambda e: W.sliding_counts(e, "30 seconds", "20 seconds"), "sliding")


@R.query("stream_tracks", """WITH d AS (SELECT store_no, id AS entity_id, unnest(frame_indices) AS frame FROM vdb_entities WHERE store_no IS NOT NULL AND id IS NOT NULL) SELECT store_no, entity_id, min(frame) AS first_frame, max(frame) AS last_frame, count(frame) AS total_frames FROM d WHERE frame IS NOT NULL GROUP BY ALL""")
def stream_tracks(spark, sf):
    """Running track aggregates of the stream of entity rows."""
    s = W.source(spark, f"{sf}/vdb_entities.parquet").where("store_no is not null and id is not null")
    det = s.select("store_no", F.col("id").alias("entity_id"), F.explode("frame_indices").alias("frame")).where("frame is not null")
    return W.drained(W.running_tracks(det), "update", "tracks", ["store_no", "entity_id"])


@R.query("stream_cache")
def stream_cache(spark, sf):
    """The cross-query cache as keyed state over a stream of seeds."""
    path = scratch_dir(spark, "cache-seeds")
    cache_rows(spark, sf).write.parquet(path)
    return W.drained_cache(W.source(spark, path))
