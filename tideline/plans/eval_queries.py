"""Queries of evaluation: retrieval accuracy, answers, results, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import answers as A
from tideline.functions import models as M
from tideline.functions import timetext as T
from tideline.operators import seeds as S
from tideline.operators.metrics import MEASURES, averaged, retrieval_accuracy
from tideline.plans.base import EV, GT, QA, QI, SD, events, json_scalar, question_ids, question_truth, seeds, segments_sql, store_questions, truth, valid_sql, valid_truth
from tideline.plans.graph_queries import FB, TOP, top_seeds
from tideline.plans.interval_queries import temporal_neighbours
from tideline.registry import Registry
from tideline.sources import stores
from tideline.sources.tables import table

R = Registry()

_ACC = f"""WITH {SD}, {TOP}, {GT}, vt AS (SELECT gt.* FROM gt JOIN qn USING (store_no, question_id) WHERE {valid_sql("qn.ref")}), raw AS (SELECT t.store_no, t.question_id, t.event_id, f.s, f.e FROM top t JOIN (SELECT store_no, question_id, event_id, arg_min(s, ord) AS s, arg_min(e, ord) AS e FROM sd GROUP BY ALL) f USING (store_no, question_id, event_id)),
x AS (SELECT store_no, question_id, event_id, CAST(floor(s) AS BIGINT) AS s, greatest(CAST(floor(e) AS BIGINT), CAST(floor(s) AS BIGINT) + 1) AS e FROM raw),
h AS (SELECT x.store_no, x.question_id, x.event_id, vt.seg FROM x JOIN vt USING (store_no, question_id) WHERE greatest(x.s, vt.gs) < least(x.e, vt.ge)),
nh AS (SELECT store_no, question_id, count(DISTINCT event_id) AS tp_evt, count(DISTINCT seg) AS tp_seg FROM h GROUP BY ALL),
ne AS (SELECT store_no, question_id, count(*) AS n_events, sum(e - s) AS total_s FROM x GROUP BY ALL),
ng AS (SELECT store_no, question_id, count(*) AS n_segments FROM vt GROUP BY ALL),
us AS (SELECT 'x' AS side, store_no, question_id, s, e FROM x UNION ALL SELECT 'g', store_no, question_id, gs, ge FROM vt WHERE ge > gs),
fl AS (SELECT *, max(e) OVER (PARTITION BY side, store_no, question_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tp FROM us),
isl AS (SELECT *, sum(CASE WHEN tp IS NULL OR s > tp THEN 1 ELSE 0 END) OVER (PARTITION BY side, store_no, question_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM fl),
un AS (SELECT side, store_no, question_id, g, min(s) AS s, max(e) AS e FROM isl GROUP BY ALL),
ul AS (SELECT store_no, question_id, sum(e - s) FILTER (side = 'x') AS found_s, sum(e - s) FILTER (side = 'g') AS true_s FROM un GROUP BY ALL),
ub AS (SELECT a.store_no, a.question_id, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS both_s FROM un a JOIN un b ON a.side = 'x' AND b.side = 'g' AND a.store_no = b.store_no AND a.question_id = b.question_id AND greatest(a.s, b.s) < least(a.e, b.e) GROUP BY ALL),
cs AS (SELECT vt.store_no, vt.question_id, vt.seg, CASE WHEN vt.point OR vt.ge = vt.gs THEN CAST(coalesce(bool_or(un.s <= vt.gs AND vt.gs < un.e), FALSE) AS INT) * 1.0
  ELSE coalesce(sum(CASE WHEN greatest(un.s, vt.gs) < least(un.e, vt.ge) THEN least(un.e, vt.ge) - greatest(un.s, vt.gs) END), 0) / (vt.ge - vt.gs) END AS c
  FROM vt LEFT JOIN un ON un.side = 'x' AND un.store_no = vt.store_no AND un.question_id = vt.question_id GROUP BY vt.store_no, vt.question_id, vt.seg, vt.gs, vt.ge, vt.point),
cv AS (SELECT store_no, question_id, avg(c) AS coverage, bool_or(c > 0) AS hit FROM cs GROUP BY ALL),
c AS (SELECT ng.store_no, ng.question_id, n_segments, coalesce(n_events, 0) AS n_events, coalesce(total_s, 0) AS total_s, coalesce(tp_evt, 0) AS tp_evt, coalesce(tp_seg, 0) AS tp_seg, coalesce(found_s, 0) AS found_s, coalesce(true_s, 0) AS true_s, coalesce(both_s, 0) AS both_s, hit, coverage
  FROM ng LEFT JOIN ne USING (store_no, question_id) LEFT JOIN nh USING (store_no, question_id) LEFT JOIN ul USING (store_no, question_id) LEFT JOIN ub USING (store_no, question_id) LEFT JOIN cv USING (store_no, question_id)),
d AS (SELECT *, CASE WHEN n_events = 0 THEN 0.0 ELSE tp_evt / n_events END AS precision_evt, tp_seg / n_segments AS recall_evt, CASE WHEN found_s = 0 THEN 0.0 ELSE both_s / found_s END AS precision_sec, CASE WHEN true_s = 0 THEN 0.0 ELSE both_s / true_s END AS recall_sec FROM c),
acc AS (SELECT store_no, question_id, n_events, n_segments, tp_evt, tp_seg, CAST(total_s AS BIGINT) AS total_s, hit, coverage, precision_evt, recall_evt, CASE WHEN precision_evt + recall_evt <= 0 THEN 0.0 ELSE 2 * precision_evt * recall_evt / (precision_evt + recall_evt) END AS f1_evt,
  tp_seg / (n_segments + n_events - tp_evt) AS iou_evt, CASE WHEN n_events > tp_evt THEN tp_evt / (n_events - tp_evt) WHEN tp_evt > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS snr_evt,
  precision_sec, recall_sec, CASE WHEN precision_sec + recall_sec <= 0 THEN 0.0 ELSE 2 * precision_sec * recall_sec / (precision_sec + recall_sec) END AS f1_sec, CASE WHEN found_s + true_s - both_s = 0 THEN 0.0 ELSE both_s / (found_s + true_s - both_s) END AS iou_sec,
  CASE WHEN found_s > both_s THEN both_s / (found_s - both_s) WHEN both_s > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS snr_sec FROM d)
"""


def accuracy(spark, sf):
    found = top_seeds(spark, sf)  # the first row of each event, with its span
    return retrieval_accuracy(found.select("store_no", "question_id", "event_id", "ord", "s", "e"), valid_truth(spark, sf))


def _rounded(names):
    return ", ".join(f"round({m}, 6) AS {m}" for m in names)


@R.query("retrieval_accuracy_per_query", _ACC + f"SELECT store_no, question_id, n_events, n_segments, tp_evt, tp_seg, total_s, hit, {_rounded(MEASURES)} FROM acc")
def retrieval_accuracy_per_query(spark, sf):
    """A1/A2: hit, precision, recall, F1, IoU and noise ratio of each query, by event and by second."""
    return accuracy(spark, sf).withColumns({m: F.round(m, 6) for m in MEASURES})


def _means(by):
    avg = ", ".join(f"round(avg({m}) FILTER (isfinite({m})), 6) AS {m}" for m in MEASURES)
    head = f"{by}, " if by else ""
    return f"SELECT {head}count(*) AS n_queries, round(avg(CAST(hit AS INT)), 6) AS hit_rate, CAST(sum(total_s) AS BIGINT) AS total_s, {avg}, count(*) FILTER (isinf(snr_evt)) AS inf_evt, count(*) FILTER (isinf(snr_sec)) AS inf_sec FROM acc" + (f" GROUP BY {by}" if by else "")


@R.query("retrieval_accuracy_overall", _ACC + _means(""))
def retrieval_accuracy_overall(spark, sf):
    """A1: means over all queries; infinite noise ratios are counted, not averaged."""
    return averaged(accuracy(spark, sf), [])


_TYPES = "ty AS (SELECT acc.*, unnest(CASE WHEN len(k) = 0 THEN ['other'] ELSE k END) AS query_type FROM acc JOIN (SELECT store_no, question_id, list_distinct(CASE json_type(t) WHEN 'ARRAY' THEN list_filter(CAST(t AS VARCHAR[]), lambda x: x IS NOT NULL AND trim(x) <> '') WHEN 'VARCHAR' THEN list_filter([t ->> '$'], lambda x: trim(x) <> '') ELSE [] END) AS k FROM (SELECT store_no, question_id, coalesce((q -> 'question_type'), CAST('null' AS JSON)) AS t FROM qn)) USING (store_no, question_id))"


@R.query("accuracy_by_query_type", _ACC.rstrip() + f", {_TYPES} " + _means("query_type").replace("FROM acc", "FROM ty"))
def accuracy_by_query_type(spark, sf):
    """A5: the means by type of question; a question can have several types, else it is ``other``."""
    kind = F.col("question_type")
    kinds = F.when(F.startswith(kind, F.lit("[")), F.from_json(kind, "array<string>")).when(kind.isNotNull(), F.array(kind)).otherwise(F.array().cast("array<string>"))
    kinds = F.array_distinct(F.filter(kinds, lambda x: x.isNotNull() & (F.trim(x) != "")))
    q = store_questions(spark, sf).select("store_no", "question_id", F.explode(F.when(F.size(kinds) == 0, F.array(F.lit("other"))).otherwise(kinds)).alias("query_type"))
    return averaged(accuracy(spark, sf).join(q, ["store_no", "question_id"]), ["query_type"])


@R.query("unique_duration_last_wins", f"""WITH {SD}, l AS (SELECT store_no, question_id, event_id, arg_max(e - s, ord) AS d FROM sd GROUP BY ALL), q AS (SELECT store_no, question_id, sum(d) AS d FROM l GROUP BY ALL)
SELECT store_no, round(avg(d), 4) AS mean_s FROM q GROUP BY store_no""")
def unique_duration_last_wins(spark, sf):
    """A4: duration of distinct events per query (the last row of an id, C11), averaged over queries."""
    last = seeds(spark, sf).groupBy("store_no", "question_id", "event_id").agg(F.max_by(F.col("e") - F.col("s"), "ord").alias("d"))
    return last.groupBy("store_no", "question_id").agg(F.sum("d").alias("d")).groupBy("store_no").agg(F.round(F.avg("d"), 4).alias("mean_s"))


_GRID = f"""WITH {SD}, r AS (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY score DESC NULLS FIRST, ord) AS rnk FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, event_id ORDER BY ord) AS r1 FROM sd) WHERE r1 = 1)), {GT},
kk AS (SELECT unnest([3, 5, 10]) AS k), tt AS (SELECT unnest([0, 30000]) AS t),
c AS (SELECT k, t, store_no, question_id, CAST(round(s * 1000) AS BIGINT) AS ms, CAST(round(e * 1000) AS BIGINT) AS me FROM r, kk, tt WHERE rnk <= k),
fl AS (SELECT *, max(me) OVER (PARTITION BY k, t, store_no, question_id ORDER BY ms, me ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tp FROM c),
isl AS (SELECT *, sum(CASE WHEN tp IS NULL OR ms > tp + t THEN 1 ELSE 0 END) OVER (PARTITION BY k, t, store_no, question_id ORDER BY ms, me ROWS UNBOUNDED PRECEDING) AS g FROM fl),
m AS (SELECT k, t, store_no, question_id, g, min(ms) AS ms, max(me) AS me FROM isl GROUP BY ALL),
q AS (SELECT m.k, m.t, m.store_no, m.question_id, CAST(sum(me - ms) AS BIGINT) AS total, bool_or(EXISTS (SELECT 1 FROM gt WHERE gt.store_no = m.store_no AND gt.question_id = m.question_id AND greatest(m.ms, gt.gs * 1000) < least(m.me, gt.ge * 1000))) AS hit FROM m GROUP BY ALL)
SELECT k, t, count(*) AS n_queries, round(avg(CAST(hit AS INT)), 6) AS hit_rate, CAST(sum(total) AS BIGINT) AS total_ms, round(avg(total), 3) AS mean_ms FROM q GROUP BY k, t"""


@R.query("grid_k_t", _GRID)
def grid_k_t(spark, sf):
    """Hit rate and time for each number of seeds and merge gap."""
    from tideline.functions.intervals import overlaps_strict
    from tideline.operators.intervals import merged, overlap_join

    top = S.topk_nulls_first(seeds(spark, sf), 10)
    gt = truth(spark, sf).select(F.concat_ws(":", "store_no", "question_id").alias("q"), (F.col("gs") * 1000).alias("rs"), (F.col("ge") * 1000).alias("re"))
    out = None
    for t in (0, 30_000):  # a parameter grid of fixed size
        rows = top.withColumn("k", F.explode(F.array(F.lit(3), F.lit(5), F.lit(10)))).where("rnk <= k")
        rows = rows.select(F.concat_ws("|", "k", F.concat_ws(":", "store_no", "question_id")).alias("kq"), F.round(F.col("s") * 1000).cast("bigint").alias("s"), F.round(F.col("e") * 1000).cast("bigint").alias("e"))
        m = merged(rows, "kq", t).withColumns({"q": F.substring_index("kq", "|", -1), "k": F.substring_index("kq", "|", 1).cast("int"), "ls": F.col("s"), "le": F.col("e")})
        total = m.groupBy("k", "q").agg(F.sum(F.col("e") - F.col("s")).alias("total"))
        hit = overlap_join(m.select("k", "q", "ls", "le"), gt, ["q"], overlaps_strict, 64_000).select("k", "q").distinct().withColumn("h", F.lit(1))
        part = total.join(hit, ["k", "q"], "left").groupBy("k").agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce("h", F.lit(0))), 6).alias("hit_rate"), F.sum("total").cast("bigint").alias("total_ms"), F.round(F.avg("total"), 3).alias("mean_ms"))
        part = part.withColumn("t", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out.select("k", "t", "n_queries", "hit_rate", "total_ms", "mean_ms")


# --- time references -------------------------------------------------------------------------

@R.query("time_ref_parse", f"WITH {QA}, qr AS (SELECT file_id, video_no, question_no, {json_scalar("(q -> 'time_reference')")} AS ref FROM qq), {segments_sql('qr', 'file_id, video_no, question_no', 'ref')} SELECT file_id, video_no, question_no, i AS seg, gs, ge, point FROM tr")
def time_ref_parse(spark, sf):
    """The time references of all questions as segments; invalid and inverted ones have none."""
    q = stores.questions(table(spark, sf, "qa_files"))
    return q.select("file_id", "video_no", "question_no", F.posexplode(T.segments_of(F.col("time_reference"))).alias("seg", "z")).select("file_id", "video_no", "question_no", "seg", "z.gs", "z.ge", "z.point")


@R.query("time_ref_valid", f"WITH {QA}, qr AS (SELECT file_id, video_no, question_no, {json_scalar("(q -> 'time_reference')")} AS ref FROM qq) SELECT file_id, video_no, question_no, {valid_sql('ref')} AS valid FROM qr")
def time_ref_valid(spark, sf):
    """A3: which time references an evaluation counts."""
    return stores.questions(table(spark, sf, "qa_files")).select("file_id", "video_no", "question_no", T.valid_reference(F.col("time_reference")).alias("valid"))


@R.query("time_ref_questions", f"WITH {QA}, qr AS (SELECT file_id, video_no, question_no, {json_scalar("(q -> 'time_reference')")} AS time_reference FROM qq), {segments_sql('qr', 'file_id, video_no, question_no', 'time_reference')} SELECT qr.*, tr.i AS seg, tr.gs, tr.ge FROM qr LEFT JOIN tr USING (file_id, video_no, question_no)")
def time_ref_questions(spark, sf):
    """The time references of all questions as segments; those without any are kept with none."""
    q = stores.questions(table(spark, sf, "qa_files"))
    z = F.posexplode_outer(T.segments_of(F.col("time_reference"))).alias("seg", "z")
    return q.select("file_id", "video_no", "question_no", "time_reference", z).select("file_id", "video_no", "question_no", "time_reference", "seg", "z.gs", "z.ge")


@R.query("question_segments", f"WITH {EV}, {GT} SELECT store_no, file_id, video_no, question_no, CAST(seg % 1000 AS INT) AS seg, gs, ge FROM gt JOIN qn USING (store_no, question_id)")
def question_segments(spark, sf):
    """A3: true segments of the questions of each store."""
    return question_truth(spark, sf)


@R.query("question_segments_hit", f"WITH {EV}, {GT} SELECT qn.store_no, file_id, video_no, question_no, bool_or(EXISTS (SELECT 1 FROM ev WHERE ev.store_no = gt.store_no AND greatest(ev.s, gt.gs) < least(ev.e, gt.ge))) AS hit FROM gt JOIN qn ON qn.store_no = gt.store_no AND qn.question_id = gt.question_id GROUP BY ALL")
def question_segments_hit(spark, sf):
    """Whether any event of the store hits any segment that the question gives."""
    from tideline.functions.intervals import overlaps_strict
    from tideline.operators.intervals import overlap_join

    keys = ["store_no", "file_id", "video_no", "question_no"]
    gt = question_truth(spark, sf)
    right = gt.select(*keys, F.col("gs").cast("double").alias("rs"), F.col("ge").cast("double").alias("re"))
    met = overlap_join(events(spark, sf).select("store_no", F.col("s").alias("ls"), F.col("e").alias("le")), right, ["store_no"], overlaps_strict)
    met = met.select(*keys).distinct().withColumn("h", F.lit(True))
    return gt.select(*keys).distinct().join(met, keys, "left").select(*keys, F.coalesce("h", F.lit(False)).alias("hit"))


_CLOCK = r"'(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?'"


@R.query("time_clock_text", f"""SELECT response_id, (CASE WHEN contains(lower(question), 'pm') AND h BETWEEN 1 AND 11 THEN h + 12 WHEN NOT contains(lower(question), 'pm') AND contains(lower(question), 'am') AND h = 12 THEN 0 ELSE h END) * 3600 + m * 60 + s AS seconds
FROM (SELECT response_id, question, TRY_CAST(regexp_extract(question, {_CLOCK}, 1) AS BIGINT) AS h, TRY_CAST(regexp_extract(question, {_CLOCK}, 2) AS BIGINT) AS m, coalesce(TRY_CAST(nullif(regexp_extract(question, {_CLOCK}, 3), '') AS BIGINT), 0) AS s FROM responses)""")
def time_clock_text(spark, sf):
    """Clock time in a question's text, by AM and PM if the text has them, as seconds of the day."""
    return table(spark, sf, "responses").select("response_id", T.clock_seconds(F.col("question")).alias("seconds"))


# --- answers ---------------------------------------------------------------------------------

_LET = "CASE WHEN upper(regexp_replace(trim(predicted), '[().\\s]', '', 'g')) IN ('A', 'B', 'C', 'D') THEN upper(regexp_replace(trim(predicted), '[().\\s]', '', 'g')) END"
_GTL = "CASE WHEN upper(regexp_replace(trim(ground_truth), '[().\\s]', '', 'g')) IN ('A', 'B', 'C', 'D') THEN upper(regexp_replace(trim(ground_truth), '[().\\s]', '', 'g')) END"
ANS = f"an AS (SELECT response_id, store_no, question_id, method, response, {_LET} AS letter, {_GTL} AS truth, latency_seconds, prompt_tokens, completion_tokens, created_at FROM responses)"


def answered(spark, sf):
    return table(spark, sf, "responses").select(
        "response_id", "store_no", "question_id", "method", "question", "response", A.normalised_letter(F.col("predicted")).alias("letter"), A.normalised_letter(F.col("ground_truth")).alias("truth"),
        "latency_seconds", "prompt_tokens", "completion_tokens", "created_at",
    )


_FIRST_OF = "CASE WHEN json_valid({0}) AND json_type({0}) = 'OBJECT' THEN coalesce(nullif((CAST({0} AS JSON) ->> 'Answer'), ''), nullif((CAST({0} AS JSON) ->> 'answer'), '')) END"


@R.query("answer_extract", rf"""WITH t AS (SELECT response_id, trim(regexp_replace(response, '(?i)^\s*```[a-z]*\s*|\s*```\s*$', '', 'g'), chr(32)) AS t FROM responses), a AS (SELECT response_id, t, upper({_FIRST_OF.format('t')}) AS w FROM t)
SELECT response_id, coalesce(CASE WHEN w IN ('A', 'B', 'C', 'D') THEN w END, nullif(upper(regexp_extract(t, '(?i)"answer"\s*:\s*"([A-D])"', 1)), ''), nullif(regexp_extract(t, '\b([ABCD])\s*[.)]\s*$', 1), ''), nullif(upper(regexp_extract(t, '^\s*\(?([A-Da-d])[).]?\s*$', 1)), '')) AS letter FROM a""")
def answer_extract(spark, sf):
    """The letter of each response."""
    return table(spark, sf, "responses").select("response_id", A.answer_letter(F.col("response")).alias("letter"))


@R.query("answer_accuracy_rollup", f"""WITH {ANS} SELECT method, store_no, count(*) AS n, count(letter) AS predicted, round(avg(CASE WHEN letter = truth THEN 1 ELSE 0 END), 6) AS accuracy FROM an WHERE truth IS NOT NULL AND store_no IS NOT NULL GROUP BY ROLLUP (method, store_no)""")
def answer_accuracy_rollup(spark, sf):
    """Accuracy over valid ground truth, no prediction being wrong, by method and store and overall."""
    a = answered(spark, sf).where("truth is not null and store_no is not null")
    return a.rollup("method", "store_no").agg(F.count("*").alias("n"), F.count("letter").alias("predicted"), F.round(F.avg(F.when(F.col("letter") == F.col("truth"), 1).otherwise(0)), 6).alias("accuracy"))


@R.query("answer_majority", f"""WITH {ANS}, c AS (SELECT store_no, question_id, letter, count(*) AS n FROM an WHERE letter IS NOT NULL AND store_no IS NOT NULL GROUP BY ALL)
SELECT store_no, question_id, letter, n FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY n DESC, letter) AS rn FROM c) WHERE rn = 1""")
def answer_majority(spark, sf):
    """Most frequent letter of each question, the earlier one on ties."""
    c = answered(spark, sf).where("letter is not null and store_no is not null").groupBy("store_no", "question_id", "letter").agg(F.count("*").alias("n"))
    best = c.groupBy("store_no", "question_id").agg(F.min_by(F.struct("letter", "n"), F.struct(-F.col("n"), F.col("letter"))).alias("b"))
    return best.select("store_no", "question_id", "b.letter", "b.n")


_WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


@R.query("answer_highest_conf", f"""WITH {ANS}, c AS (SELECT an.store_no, an.question_id, an.response_id, an.letter, CASE WHEN len({_WORDS.format('an.response')}) = 0 THEN 0 ELSE len(list_intersect({_WORDS.format('r.question')}, {_WORDS.format('an.response')})) / len({_WORDS.format('an.response')}) END AS score
FROM an JOIN responses r USING (response_id) WHERE letter IS NOT NULL AND an.store_no IS NOT NULL)
SELECT store_no, question_id, response_id, letter, round(coalesce(score, 0), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY round(coalesce(score, 0), 9) DESC, response_id) AS rn FROM c) WHERE rn = 1""")
def answer_highest_conf(spark, sf):
    """The answer of highest score (the pair score of question and response), the first on ties."""
    a = answered(spark, sf).where("letter is not null and store_no is not null").withColumn("score", F.round(M.word_overlap(F.col("question"), F.col("response")), 9))
    best = a.groupBy("store_no", "question_id").agg(F.min_by(F.struct("response_id", "letter", "score"), F.struct(-F.col("score"), F.col("response_id"))).alias("b"))
    return best.select("store_no", "question_id", "b.response_id", "b.letter", F.round("b.score", 6).alias("score"))


_VOTE = f"""{ANS}, w AS (SELECT store_no, question_id, method, response_id, letter, {_WORDS.format('response')} AS ws FROM an WHERE store_no IS NOT NULL AND response IS NOT NULL),
tot AS (SELECT store_no, question_id, method, count(*) AS n FROM w GROUP BY ALL),
pr AS (SELECT a.store_no, a.question_id, a.method, a.letter, avg(CASE WHEN len(b.ws) = 0 THEN 0 ELSE len(list_intersect(a.ws, b.ws)) / len(b.ws) END) AS agree FROM w a JOIN w b ON a.store_no = b.store_no AND a.question_id = b.question_id AND a.method = b.method AND a.letter = b.letter AND a.response_id <> b.response_id GROUP BY ALL),
ag AS (SELECT c.store_no, c.question_id, c.method, c.letter, c.n, coalesce(pr.agree, 0) AS agree FROM (SELECT store_no, question_id, method, letter, count(*) AS n FROM w WHERE letter IS NOT NULL GROUP BY ALL) c LEFT JOIN pr ON pr.store_no = c.store_no AND pr.question_id = c.question_id AND pr.method = c.method AND pr.letter = c.letter),
sc AS (SELECT ag.store_no, ag.question_id, ag.method, ag.letter, 0.3 * ag.n / tot.n + 0.7 * agree AS score FROM ag JOIN tot ON tot.store_no = ag.store_no AND tot.question_id = ag.question_id AND tot.method = ag.method),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, method ORDER BY round(score, 9) DESC, letter) AS rn FROM sc) WHERE rn = 1)"""


def voted(spark, sf):
    """Best answer of each node (store, question, method). The mean pair score within an answer is worked out
    without pairs: each response's share of words that others of its answer have, by word frequencies."""
    a = answered(spark, sf).where("store_no is not null and response is not null")
    node = ["store_no", "question_id", "method"]
    tot = a.groupBy(*node).agg(F.count("*").alias("total"))
    g = [*node, "letter"]
    ws = a.where("letter is not null").select(*g, "response_id", F.explode_outer(M.words_of(F.col("response"))).alias("w"))
    df = ws.where("w is not null").groupBy(*g, "w").agg((F.count("*") - 1).alias("others"))
    per = ws.join(df, [*g, "w"], "left").groupBy(*g, "response_id").agg(F.coalesce(F.try_divide(F.sum("others").cast("double"), F.count("w")), F.lit(0.0)).alias("shared"))
    n = F.count("*")
    ag = per.groupBy(*g).agg(n.alias("n"), F.when(n < 2, F.lit(0.0)).otherwise(F.sum("shared") / (n * (n - 1))).alias("agree"))
    ag = ag.withColumn("agree", F.when(F.col("n") < 2, 0.0).otherwise(F.col("agree")))
    sc = ag.join(tot, node).withColumn("score", 0.3 * F.col("n") / F.col("total") + 0.7 * F.col("agree"))
    best = sc.groupBy(*node).agg(F.min_by(F.struct("letter", "score"), F.struct(-F.round("score", 9), F.col("letter"))).alias("b"))
    return best.select(*node, "b.letter", "b.score")


@R.query("answer_vote_alpha", f"WITH {_VOTE} SELECT store_no, question_id, method, letter, round(score, 6) AS score FROM b")
def answer_vote_alpha(spark, sf):
    """0.3 vote share + 0.7 mean pair score of the responses with the answer; the first letter wins ties."""
    return voted(spark, sf).withColumn("score", F.round("score", 6))


@R.query("ca_candidates", f"""WITH {_VOTE}, d AS (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, letter ORDER BY round(score, 9) DESC, method) AS r1 FROM b)
SELECT store_no, question_id, method, letter FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY round(score, 9) DESC, method) AS r2 FROM d WHERE r1 = 1) WHERE r2 <= 2""")
def ca_candidates(spark, sf):
    """The best node and the best node with another answer."""
    b = voted(spark, sf)
    order = [F.desc(F.round("score", 9)), F.col("method")]
    d = b.withColumn("r1", F.row_number().over(Window.partitionBy("store_no", "question_id", "letter").orderBy(*order))).where("r1 = 1")
    return d.withColumn("r2", F.row_number().over(Window.partitionBy("store_no", "question_id").orderBy(*order))).where("r2 <= 2").select("store_no", "question_id", "method", "letter")


# --- results and reports ---------------------------------------------------------------------


@R.query("results_dedup", f"""WITH {ANS} SELECT store_no, question_id, method, response_id FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, method ORDER BY letter IS NOT NULL DESC, created_at DESC, response_id DESC) AS rn FROM an WHERE store_no IS NOT NULL) WHERE rn = 1""")
def results_dedup(spark, sf):
    """One result per question and method; valid beats invalid, then the later wins."""
    a = answered(spark, sf).where("store_no is not null")
    best = a.groupBy("store_no", "question_id", "method").agg(F.max_by("response_id", F.struct(F.col("letter").isNotNull(), F.col("created_at"), F.col("response_id"))).alias("response_id"))
    return best


@R.query("results_missing", f"""WITH {EV}, {QI}, {ANS}, m AS (SELECT unnest(['events_only', 'frames_only', 'multimode', 'tree']) AS method), d AS (SELECT DISTINCT an.store_no, an.method, qi.qno FROM an JOIN qi ON qi.store_no = an.store_no AND qi.ask_id = an.question_id)
SELECT n.store_no, m.method, n.n AS questions, array_to_string(list_sort(list(g.i) FILTER (d.qno IS NULL)), ',') AS missing FROM (SELECT store_no, count(*) AS n, unnest(range(count(*))) AS i FROM qn GROUP BY store_no) g JOIN (SELECT store_no, count(*) AS n FROM qn GROUP BY store_no) n ON n.store_no = g.store_no, m
LEFT JOIN d ON d.store_no = g.store_no AND d.method = m.method AND d.qno = g.i GROUP BY ALL HAVING count(*) FILTER (d.qno IS NULL) > 0""")
def results_missing(spark, sf):
    """Numbers of the questions of each store that a method has no result for."""
    q = store_questions(spark, sf)
    done = answered(spark, sf).where("store_no is not null").select("store_no", "method", F.col("question_id").alias("ask_id")).join(question_ids(q), ["store_no", "ask_id"]).select("store_no", "method", F.col("qno").alias("i")).distinct()
    n = q.groupBy("store_no").agg(F.count("*").alias("questions"))
    want = n.select("store_no", "questions", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("questions") - 1)).alias("i"))
    want = want.withColumn("method", F.explode(F.array(*(F.lit(x) for x in ("events_only", "frames_only", "multimode", "tree")))))
    left = want.join(done, ["store_no", "method", "i"], "left_anti")
    return left.groupBy("store_no", "method", "questions").agg(F.array_join(F.array_sort(F.collect_list("i")), ",").alias("missing"))


@R.query("results_resume_antijoin", f"""WITH {ANS} SELECT response_id FROM an WHERE method = 'tree' AND NOT EXISTS (SELECT 1 FROM an d WHERE d.method = 'multimode' AND d.store_no = an.store_no AND d.question_id = an.question_id)""")
def results_resume_antijoin(spark, sf):
    """What is left to do: questions of one method that the other has not processed."""
    a = answered(spark, sf)
    return a.where("method = 'tree'").join(a.where("method = 'multimode'").select("store_no", "question_id").distinct(), ["store_no", "question_id"], "left_anti").select("response_id")


_ERRORS = "internal error|error happened|status code|ResponseType\\.|INPUT_LENGTH_ERROR|TOKEN_LIMIT|TIMEOUT|FAILED|exception|traceback"


@R.query("results_valid", rf"""WITH t AS (SELECT response_id, response, coalesce(nullif(regexp_extract(response, '```(?:json)?\s*(\{{.*?\}})\s*```', 1, 's'), ''), regexp_extract(response, '\{{.*\}}', 0, 's')) AS t FROM responses), a AS (SELECT response_id, response, trim({_FIRST_OF.format('t')}) AS w FROM t)
SELECT response_id, coalesce(NOT regexp_matches(response, '(?i)({_ERRORS})') AND w <> '', FALSE) AS valid, coalesce(NOT regexp_matches(response, '(?i)({_ERRORS})') AND upper(w) IN ('A', 'B', 'C', 'D'), FALSE) AS lettered FROM a""")
def results_valid(spark, sf):
    """A response without an error text and with a JSON answer, of any form and of A-D."""
    t = F.col("response")
    return table(spark, sf, "responses").select("response_id", A.valid_answer(t).alias("valid"), A.valid_answer(t, True).alias("lettered"))


_WRONG = f"""{_ACC.rstrip()[5:]}, {QI}, {ANS}, w AS (SELECT an.method, an.response_id, CASE WHEN an.letter = an.truth THEN 'right' WHEN qi.qno IS NULL AND an.letter IS NULL THEN 'not counted' WHEN qi.qno IS NULL THEN 'wrong, no category' WHEN acc.store_no IS NOT NULL AND NOT acc.hit THEN 'wrong retrieval' ELSE 'wrong content' END AS verdict
FROM an LEFT JOIN qi ON qi.store_no = an.store_no AND qi.ask_id = an.question_id LEFT JOIN acc ON acc.store_no = qi.store_no AND acc.question_id = qi.qno WHERE an.truth IS NOT NULL)"""


def attributed(spark, sf):
    a = answered(spark, sf).where("truth is not null").withColumnRenamed("question_id", "ask_id")
    ids = question_ids(store_questions(spark, sf))
    hit = accuracy(spark, sf).select("store_no", F.col("question_id").alias("qno"), "hit")
    there = F.col("qno").isNotNull()
    v = F.when(F.col("letter") == F.col("truth"), "right").when(~there & F.col("letter").isNull(), "not counted").when(~there, "wrong, no category").when(F.col("hit") == F.lit(False), "wrong retrieval").otherwise("wrong content")
    return a.join(ids, ["store_no", "ask_id"], "left").join(hit, ["store_no", "qno"], "left").select("method", "response_id", v.alias("verdict"))


@R.query("wrong_attribution", f"WITH {_WRONG} SELECT response_id, verdict FROM w")
def wrong_attribution(spark, sf):
    """A wrong answer is one of retrieval if the question's time is not hit; of content if it is, or if the
    question has no time that counts."""
    return attributed(spark, sf).select("response_id", "verdict")


@R.query("wrong_report_by_mode", f"WITH {_WRONG} SELECT method, verdict, count(*) AS n FROM w GROUP BY ALL")
def wrong_report_by_mode(spark, sf):
    """Verdicts by method."""
    return attributed(spark, sf).groupBy("method", "verdict").agg(F.count("*").alias("n"))


@R.query("generation_log", f"""WITH {ANS} SELECT method, count(*) AS n, round(avg(CASE WHEN truth IS NOT NULL THEN CASE WHEN letter = truth THEN 1.0 ELSE 0.0 END END), 6) AS accuracy, round(avg(latency_seconds), 6) AS latency, round(avg(prompt_tokens), 6) AS prompt_tokens, CAST(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS BIGINT) AS tokens FROM an GROUP BY method""")
def generation_log(spark, sf):
    """Accuracy over rows with ground truth, latency over all, tokens over rows that have them."""
    return answered(spark, sf).groupBy("method").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("truth").isNotNull(), F.when(F.col("letter") == F.col("truth"), 1.0).otherwise(0.0))), 6).alias("accuracy"), F.round(F.avg("latency_seconds"), 6).alias("latency"),
        F.round(F.avg("prompt_tokens"), 6).alias("prompt_tokens"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).cast("bigint").alias("tokens"),
    )


_LEAF = f"""WITH {SD}, {GT}, r AS (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY score DESC NULLS FIRST, ord) AS rnk FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, event_id ORDER BY ord) AS r1 FROM sd) WHERE r1 = 1)),
lf AS (SELECT store_no, question_id, (rnk - 1) % 3 AS leaf, CAST(floor(s) AS BIGINT) AS s, greatest(CAST(floor(e) AS BIGINT), CAST(floor(s) AS BIGINT) + 1) AS e FROM r WHERE rnk <= 9),
fl AS (SELECT *, max(e) OVER (PARTITION BY store_no, question_id, leaf ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tp FROM lf),
isl AS (SELECT *, sum(CASE WHEN tp IS NULL OR s > tp THEN 1 ELSE 0 END) OVER (PARTITION BY store_no, question_id, leaf ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM fl),
m AS (SELECT store_no, question_id, leaf, min(s) AS s, max(e) AS e FROM isl GROUP BY store_no, question_id, leaf, g),
vt AS (SELECT gt.*, l.leaf FROM gt JOIN qn USING (store_no, question_id) JOIN (SELECT DISTINCT store_no, question_id, leaf FROM lf) l USING (store_no, question_id) WHERE {valid_sql("qn.ref")}),
c AS (SELECT vt.store_no, vt.question_id, vt.leaf, vt.seg, CASE WHEN vt.point OR vt.ge = vt.gs THEN CAST(coalesce(bool_or(m.s <= vt.gs AND vt.gs < m.e), FALSE) AS INT) * 1.0 ELSE coalesce(sum(CASE WHEN greatest(m.s, vt.gs) < least(m.e, vt.ge) THEN least(m.e, vt.ge) - greatest(m.s, vt.gs) END), 0) / (vt.ge - vt.gs) END AS c
  FROM vt LEFT JOIN m ON m.store_no = vt.store_no AND m.question_id = vt.question_id AND m.leaf = vt.leaf GROUP BY vt.store_no, vt.question_id, vt.leaf, vt.seg, vt.gs, vt.ge, vt.point),
l AS (SELECT store_no, question_id, leaf, avg(c) AS c FROM c GROUP BY ALL), q AS (SELECT store_no, question_id, avg(c) AS c FROM l GROUP BY ALL)
SELECT store_no, count(*) AS questions, round(avg(c), 6) AS mean_overlap FROM q GROUP BY store_no"""


@R.query("leaf_overlap_two_level", _LEAF)
def leaf_overlap_two_level(spark, sf):
    """Share of a question's time that the events of a leaf cover, mean over the leaves of the question (its
    best nine seeds dealt to three leaves), then over the questions of each store."""
    from tideline.functions.intervals import truncated_ends
    from tideline.operators.intervals import coverage, merged

    top = S.topk_nulls_first(seeds(spark, sf), 9).withColumn("leaf", ((F.col("rnk") - 1) % 3).cast("bigint"))
    a, b = truncated_ends(F.col("s"), F.col("e"))
    top = top.select("store_no", "question_id", "leaf", F.concat_ws(":", "store_no", "question_id", "leaf").alias("k"), a.alias("s"), b.alias("e"))
    leaves = top.select("store_no", "question_id", "leaf", "k").distinct()
    refs = valid_truth(spark, sf).join(leaves, ["store_no", "question_id"]).select("k", "store_no", "question_id", "leaf", "seg", F.col("gs").alias("s"), F.when(F.col("point"), F.col("gs")).otherwise(F.col("ge")).alias("e"))
    c = coverage(merged(top.select("k", "s", "e"), "k"), refs, "k")
    leaf = c.groupBy("store_no", "question_id", "leaf").agg(F.avg("coverage").alias("c"))
    return leaf.groupBy("store_no", "question_id").agg(F.avg("c").alias("c")).groupBy("store_no").agg(F.count("*").alias("questions"), F.round(F.avg("c"), 6).alias("mean_overlap"))


@R.query("superset_check", f"""WITH {SD}, {TOP}, {FB}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, event_id ORDER BY ord) AS r1 FROM sd WHERE score IS NOT NULL) WHERE r1 = 1),
b AS (SELECT store_no, question_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY score DESC, ord) AS rnk FROM f) WHERE rnk <= 2),
x AS (SELECT store_no, question_id, event_id FROM top UNION SELECT * FROM fb), d AS (SELECT * FROM b EXCEPT SELECT * FROM x)
SELECT q.store_no, q.question_id, count(d.event_id) AS lacking FROM (SELECT DISTINCT store_no, question_id FROM b) q LEFT JOIN d ON d.store_no = q.store_no AND d.question_id = q.question_id GROUP BY ALL""")
def superset_check(spark, sf):
    """For every question, how many of its two best scored seeds the expansion of its top seeds lacks."""
    c = ["store_no", "question_id", "event_id"]
    top = top_seeds(spark, sf)
    base = S.topk_scored(seeds(spark, sf), 2).select(*c)
    lacking = base.join(top.select(*c).unionByName(temporal_neighbours(spark, sf, top).select(*c)).distinct(), c, "left_anti")
    n = lacking.groupBy("store_no", "question_id").agg(F.count("*").alias("lacking"))
    return base.select("store_no", "question_id").distinct().join(n, ["store_no", "question_id"], "left").fillna(0, ["lacking"])


@R.query("clean_text", r"""SELECT doc_id, md5(replace(regexp_replace(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\x00-\x1f\x7f-\x9f]', '', 'g'), '/', ' ')) AS cleaned FROM documents""")
def clean_text(spark, sf):
    """Entities resolved, control characters out, slashes to blanks (as md5)."""
    return table(spark, sf, "documents").select("doc_id", F.md5(A.cleaned(F.col("text"))).alias("cleaned"))


@R.query("md5_event_dedup", """SELECT store_no, 'Event-' || md5(description) AS event_id, min(pos) AS first_pos, arg_max(duration[1], pos) AS last_start, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY store_no, pos ORDER BY loaded_at DESC) AS rn FROM vdb_events WHERE store_no IS NOT NULL AND pos IS NOT NULL) WHERE rn = 1 AND description IS NOT NULL GROUP BY store_no, description""")
def md5_event_dedup(spark, sf):
    """Equal captions are one event with the place of the first and the payload of the last."""
    raw = table(spark, sf, "vdb_events").where("store_no is not null and pos is not null")
    one = raw.withColumn("r", F.row_number().over(Window.partitionBy("store_no", "pos").orderBy(F.desc("loaded_at")))).where("r = 1 and description is not null")
    g = one.groupBy("store_no", "description").agg(F.min("pos").alias("first_pos"), F.max_by(F.struct(F.get("duration", F.lit(0)).alias("s")), "pos").alias("x"), F.count("*").alias("n"))
    return g.select("store_no", F.concat(F.lit("Event-"), F.md5("description")).alias("event_id"), "first_pos", F.col("x.s").alias("last_start"), "n")
