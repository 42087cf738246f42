"""Queries of frames, tracks, event lists, verification and cache."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import timetext as T
from tideline.functions.intervals import holds_closed, overlaps_closed
from tideline.operators import cache as C
from tideline.operators import eventlist as L
from tideline.operators import frames as FR
from tideline.operators import seeds as S
from tideline.operators import tracks as K
from tideline.operators import vector as V
from tideline.operators.intervals import merged, overlap_join
from tideline.operators.ordering import numbered, prev_next
from tideline.plans.base import BR, EV, GT, SD, VEC, bridge, events, json_scalar, seeds, store_questions, truth, vectors
from tideline.plans.graph_queries import FB, PN, TOP, top_seeds
from tideline.plans.interval_queries import temporal_neighbours
from tideline.registry import Registry
from tideline.session import checkpointed
from tideline.sources import stores
from tideline.sources.tables import table

R = Registry()

VS = "vs AS (SELECT store_no, fps, frame_count AS n, width, height, created_at FROM video_stores WHERE fps > 0 AND frame_count IS NOT NULL)"


def _stores(spark, sf):
    return table(spark, sf, "video_stores").where("fps > 0 and frame_count is not null").select("store_no", "fps", F.col("frame_count").alias("n"), "width", "height", "created_at")


def _timed(spark, sf):
    return events(spark, sf).join(_stores(spark, sf), "store_no")


def _rate(target: float, s="s", e="e") -> str:
    lo, hi = f"CAST(floor({s} * fps) AS BIGINT)", f"CAST(floor({e} * fps) AS BIGINT)"
    return f"CASE WHEN {s} = {e} THEN [{lo}] ELSE range({lo}, {hi}, greatest(1, CAST(floor(fps / {target}) AS BIGINT))) END"


@R.query("frames_by_fps", f"WITH {EV}, {VS} SELECT store_no, pos, target, unnest(fr) AS frame FROM (SELECT store_no, pos, 1.0 AS target, {_rate(1.0)} AS fr FROM ev JOIN vs USING (store_no) UNION ALL SELECT store_no, pos, 0.5, {_rate(0.5)} FROM ev JOIN vs USING (store_no))")
def frames_by_fps(spark, sf):
    """frames of each event at one per second and at one per two seconds, the end left out."""
    b = _timed(spark, sf)
    out = None
    for target in (1.0, 0.5):
        part = b.select("store_no", "pos", F.lit(target).alias("target"), F.explode(FR.at_rate(F.col("s"), F.col("e"), F.col("fps"), target)).alias("frame"))
        out = part if out is None else out.unionByName(part)
    return out


@R.query("frames_by_num", f"""WITH {EV}, {VS}, k AS (SELECT ev.store_no, pos, s, e, fps, m FROM ev JOIN vs USING (store_no), (SELECT unnest([1, 2, 4]) AS m)), p AS (SELECT *, unnest(range(m)) AS i FROM k),
q AS (SELECT store_no, pos, m AS n, i AS place, fps, CASE WHEN m = 1 THEN (s + e) / 2 ELSE s + i * (e - s) / (m - 1) END AS x FROM p) SELECT store_no, pos, n, place, round(x, 6) AS t, CAST(floor(x * fps) AS BIGINT) AS frame FROM q""")
def frames_by_num(spark, sf):
    """one, two and four instants of each event with their frames."""
    b = _timed(spark, sf).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    p = b.select("store_no", "pos", "n", "fps", F.posexplode(FR.instants(F.col("s"), F.col("e"), F.col("n"))).alias("place", "x"))
    return p.select("store_no", "pos", "n", "place", F.round("x", 6).alias("t"), FR.frame_at(F.col("x"), F.col("fps")).alias("frame"))


@R.query("frames_linspace", f"""WITH {VS}, k AS (SELECT store_no, n, unnest(CASE WHEN n <= 64 THEN range(n) ELSE range(64) END) AS i FROM vs)
SELECT store_no, i AS place, CASE WHEN n <= 64 THEN i WHEN i = 63 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 63.0)) AS BIGINT) END AS frame FROM k""")
def frames_linspace(spark, sf):
    """64 frames of each timeline, evenly spread, the last pinned."""
    return _stores(spark, sf).select("store_no", F.posexplode(T.linspace_ints(F.col("n"), 64)).alias("place", "frame"))


_SEGS = f"sec AS (SELECT DISTINCT store_no, unnest(range(greatest(gs, 0), ge + 1)) AS sec FROM gt)"


def _segment_seconds(spark, sf):
    gt = truth(spark, sf)
    return gt.select("store_no", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), "gs"), "ge")).alias("sec")).distinct()


@R.query("frames_segment_seconds", f"WITH {EV}, {GT}, {_SEGS}, {VS} SELECT DISTINCT sec.store_no, CAST(floor(sec.sec * vs.fps) AS BIGINT) AS frame FROM sec JOIN vs USING (store_no)")
def frames_segment_seconds(spark, sf):
    """one frame per second inside the segments, ends included, distinct."""
    return _segment_seconds(spark, sf).join(_stores(spark, sf), "store_no").select("store_no", FR.frame_at(F.col("sec"), F.col("fps")).alias("frame")).distinct()


def _spread(rows: str, keys: str, order: str, k: int) -> str:
    """SQL: ``k`` rows of each group, evenly spread, the last pinned."""
    return f"""SELECT {keys}, {order} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS c FROM {rows}) z
WHERE c <= {k} OR r = c - 1 OR EXISTS (SELECT 1 FROM (SELECT unnest(range({k - 1})) AS j) y WHERE CAST(floor(y.j * ((z.c - 1) / {k - 1}.0)) AS BIGINT) = z.r)"""


def _spread_of(df, key, order, k):
    r = numbered(df, [key], order)
    p = r.select(key, "group_size").distinct().select(key, F.explode(T.linspace_ints(F.col("group_size"), k)).alias("rank0")).distinct()
    return r.join(p, [key, "rank0"]).select(key, order)


@R.query("frames_segments_uniform", f"WITH {EV}, {GT}, {_SEGS}, {VS}, fr AS (SELECT DISTINCT sec.store_no, CAST(floor(sec.sec * vs.fps) AS BIGINT) AS frame FROM sec JOIN vs USING (store_no)) {_spread('fr', 'store_no', 'frame', 20)}")
def frames_segments_uniform(spark, sf):
    """20 frames of each store's segments at one per second, evenly spread."""
    return _spread_of(frames_segment_seconds(spark, sf), "store_no", "frame", 20)


_MERGED_GT = """gfl AS (SELECT store_no, gs, ge, max(ge) OVER (PARTITION BY store_no ORDER BY gs, ge, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM gt WHERE ge > gs),
gisl AS (SELECT store_no, gs, ge, sum(CASE WHEN top IS NULL OR gs > top THEN 1 ELSE 0 END) OVER (PARTITION BY store_no ORDER BY gs, ge ROWS UNBOUNDED PRECEDING) AS g FROM gfl),
gm AS (SELECT store_no, min(gs) AS s, max(ge) AS e FROM gisl GROUP BY store_no, g)"""


@R.query("frames_merged_segments", f"WITH {EV}, {GT}, {_MERGED_GT}, {VS}, fr AS (SELECT DISTINCT store_no, unnest({_rate(1.0)}) AS frame FROM gm JOIN vs USING (store_no)) {_spread('fr', 'store_no', 'frame', 30)}")
def frames_merged_segments(spark, sf):
    """F8: one frame per second of every merged segment, 30 of each store, evenly spread."""
    g = truth(spark, sf).select("store_no", F.col("gs").alias("s"), F.col("ge").alias("e"))
    fr = merged(g, "store_no").join(_stores(spark, sf), "store_no").select("store_no", F.explode(FR.at_rate(F.col("s"), F.col("e"), F.col("fps"), 1.0)).alias("frame")).distinct()
    return _spread_of(fr, "store_no", "frame", 30)


@R.query("frames_per_event_9s", f"""WITH {EV}, {VS}, k AS (SELECT store_no, pos, s, e, fps, greatest(1, CAST(ceil((e - s) / 9) AS BIGINT)) AS n FROM ev JOIN vs USING (store_no)), p AS (SELECT *, unnest(range(n)) AS i FROM k)
SELECT store_no, pos, n, i AS place, CAST(floor(CASE WHEN n = 1 THEN (s + e) / 2 ELSE s + i * (e - s) / (n - 1) END * fps) AS BIGINT) AS frame FROM p""")
def frames_per_event_9s(spark, sf):
    """one frame per 9 s of an event, at least one, evenly spread."""
    b = _timed(spark, sf).withColumn("n", FR.per_seconds(F.col("s"), F.col("e"), 9.0))
    p = b.select("store_no", "pos", "n", "fps", F.posexplode(FR.instants(F.col("s"), F.col("e"), F.col("n"))).alias("place", "x"))
    return p.select("store_no", "pos", "n", F.col("place").cast("bigint").alias("place"), FR.frame_at(F.col("x"), F.col("fps")).alias("frame"))


@R.query("frames_stride", f"""WITH {EV}, {VS}, f AS (SELECT store_no, pos, fps, unnest(range(len(fr))) AS i, unnest(fr) AS frame FROM (SELECT store_no, pos, fps, {_rate(2.0)} AS fr FROM ev JOIN vs USING (store_no))),
n AS (SELECT *, row_number() OVER (PARTITION BY store_no ORDER BY pos, i) - 1 AS r, count(*) OVER (PARTITION BY store_no) AS c FROM f)
SELECT store_no, pos, frame, 'most' AS how FROM n WHERE r % greatest(1, CAST(ceil(c / 256.0) AS BIGINT)) = 0 UNION ALL SELECT store_no, pos, frame, 'rate' FROM n WHERE r % greatest(1, CAST(floor(fps / 2.0) AS BIGINT)) = 0""")
def frames_stride(spark, sf):
    """frames of all events of a store end to end (an overlap counts twice), every n-th of them: so that at
    most 256 remain, or by the rate."""
    b = _timed(spark, sf)
    f = b.select("store_no", "pos", "fps", F.posexplode(FR.at_rate(F.col("s"), F.col("e"), F.col("fps"), 2.0)).alias("i", "frame"))
    r = numbered(f, ["store_no"], "pos", block=256, then=("i",))
    most = r.where(F.col("rank0") % F.greatest(F.lit(1), F.ceil(F.col("group_size") / 256.0)) == 0).select("store_no", "pos", "frame", F.lit("most").alias("how"))
    return most.unionByName(r.where(F.col("rank0") % F.greatest(F.lit(1), F.floor(F.col("fps") / 2.0)) == 0).select("store_no", "pos", "frame", F.lit("rate").alias("how")))


# frame scores: similarity of every frame vector of a store to its first event vector; event scores likewise
_FSC = f"""{VEC}, qf AS (SELECT store_no, arg_min(v, vec_id) AS qv FROM vec WHERE vec_kind = 'event' AND store_no IS NOT NULL GROUP BY store_no),
fs AS (SELECT vec.store_no, CAST(owner_id AS DOUBLE) AS sec, max(round(list_cosine_similarity(v, qv), 9)) AS score FROM vec JOIN qf USING (store_no) WHERE vec_kind = 'frame' AND TRY_CAST(owner_id AS DOUBLE) IS NOT NULL GROUP BY ALL),
es AS (SELECT vec.store_no, owner_id AS event_id, max(round(list_cosine_similarity(v, qv), 9)) AS score FROM vec JOIN qf USING (store_no) WHERE vec_kind = 'event' GROUP BY ALL)"""


def _scored(spark, sf):
    """(frame scores: store_no, sec, score; event scores: store_no, event_id, score)."""
    v = vectors(spark, sf).where("store_no is not null")
    q = v.where("vec_kind = 'event'").groupBy("store_no").agg(F.min_by("v", "vec_id").alias("qv"))
    s = v.join(q, "store_no").select("store_no", "vec_kind", "owner_id", F.round(V.cosine(F.col("v"), F.col("qv")), 9).alias("score"))
    sec = F.expr("try_cast(owner_id as double)")
    fs = s.where("vec_kind = 'frame'").select("store_no", sec.alias("sec"), "score").where("sec is not null").groupBy("store_no", "sec").agg(F.max("score").alias("score"))
    return fs, s.where("vec_kind = 'event'").groupBy("store_no", F.col("owner_id").alias("event_id")).agg(F.max("score").alias("score"))


@R.query("frames_score_threshold", f"""WITH {EV}, {_FSC}, t AS (SELECT store_no, CASE WHEN count(*) >= 4 THEN list_sort(list(score), 'DESC')[4] ELSE -2 END AS kth FROM fs GROUP BY store_no),
a AS (SELECT fs.store_no, fs.sec FROM fs JOIN t USING (store_no) WHERE fs.score > t.kth), n AS (SELECT store_no, sec, row_number() OVER (PARTITION BY store_no ORDER BY sec) - 1 AS r FROM fs),
x AS (SELECT n.store_no, n.sec, row_number() OVER (PARTITION BY n.store_no ORDER BY n.sec) AS r FROM n WHERE n.r % 2 = 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.store_no = n.store_no AND a.sec = n.sec)),
c AS (SELECT t.store_no, 4 - count(a.sec) AS left_n FROM t LEFT JOIN a USING (store_no) GROUP BY t.store_no)
SELECT store_no, sec, 'score' AS how FROM a UNION ALL SELECT x.store_no, x.sec, 'stride' FROM x JOIN c USING (store_no) WHERE x.r <= c.left_n""")
def frames_score_threshold(spark, sf):
    """frames that score above the 4th best of their store, filled up to 4 with every second frame."""
    f, _ = _scored(spark, sf)
    top = f.withColumn("r", F.row_number().over(Window.partitionBy("store_no").orderBy(F.desc("score"), "sec"))).where("r <= 4")
    t = top.groupBy("store_no").agg(F.when(F.count("*") >= 4, F.min("score")).otherwise(F.lit(-2.0)).alias("kth"))
    a = f.join(t, "store_no").where("score > kth").select("store_no", "sec")
    left = t.join(a.groupBy("store_no").count(), "store_no", "left").select("store_no", (4 - F.coalesce("count", F.lit(0))).alias("left_n"))
    x = numbered(f.select("store_no", "sec"), ["store_no"], "sec").where("rank0 % 2 = 0").join(a, ["store_no", "sec"], "left_anti")
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("store_no").orderBy("sec"))).where("r <= 4").join(left, "store_no").where("r <= left_n")
    return a.withColumn("how", F.lit("score")).unionByName(x.select("store_no", "sec", F.lit("stride").alias("how")))


@R.query("percentile_event_filter", f"""WITH {EV}, {GT}, {VS}, {_FSC}, x AS (SELECT ev.store_no, ev.pos, ev.s, ev.e, vs.fps, es.score FROM ev JOIN vs ON vs.store_no = ev.store_no JOIN es ON es.store_no = ev.store_no AND es.event_id = ev.event_id),
t AS (SELECT store_no, quantile_cont(score, 0.9) AS high FROM x GROUP BY store_no), m AS (SELECT store_no, median(score) AS mid FROM fs GROUP BY store_no),
j AS (SELECT x.store_no, x.pos, x.s, x.e, x.score, t.high, m.mid, x.fps, max(fs.score) AS best, avg(fs.score) AS mean, count(fs.score) AS n FROM x JOIN t ON t.store_no = x.store_no LEFT JOIN m ON m.store_no = x.store_no
  LEFT JOIN fs ON fs.store_no = x.store_no AND floor(x.s * x.fps) <= floor(fs.sec * x.fps) AND floor(fs.sec * x.fps) <= floor(x.e * x.fps) GROUP BY ALL)
SELECT store_no, pos, round(e - s, 6) AS length_s, n AS frames, round(coalesce(best, 0), 6) AS best, round(coalesce(mean, 0), 6) AS mean,
EXISTS (SELECT 1 FROM gt WHERE gt.store_no = j.store_no AND floor(gt.gs * j.fps) > 0 AND floor(j.s * j.fps) <= floor(gt.ge * j.fps) AND floor(j.e * j.fps) >= floor(gt.gs * j.fps)) AS hits FROM j WHERE coalesce(best > mid, FALSE) OR score >= high""")
def percentile_event_filter(spark, sf):
    """events with a frame score over the median of the store's frames or an event score in the top tenth,
    with their length, frame scores and whether they hit a true segment (one that begins at 0 never does)."""
    f, es = _scored(spark, sf)
    x = _timed(spark, sf).join(es, ["store_no", "event_id"]).select("store_no", "pos", "s", "e", "fps", "score")
    t = x.groupBy("store_no").agg(F.percentile("score", F.lit(0.9)).alias("high"))
    m = f.groupBy("store_no").agg(F.percentile("score", F.lit(0.5)).alias("mid"))
    at = lambda c: F.floor(F.col(c) * F.col("fps"))
    fr = f.join(_stores(spark, sf), "store_no").select("store_no", at("sec").alias("rs"), at("sec").alias("re"), F.col("score").alias("fscore"))
    ev = x.withColumns({"ls": at("s"), "le": at("e")})
    inside = overlap_join(ev.select("store_no", "pos", "ls", "le"), fr, ["store_no"], overlaps_closed, 2048).groupBy("store_no", "pos").agg(F.max("fscore").alias("best"), F.avg("fscore").alias("mean"), F.count("*").alias("frames"))
    g = truth(spark, sf).join(_stores(spark, sf), "store_no").select("store_no", at("gs").alias("rs"), at("ge").alias("re")).where("rs > 0")
    hit = overlap_join(ev.select("store_no", "pos", "ls", "le"), g, ["store_no"], overlaps_closed, 2048).select("store_no", "pos").distinct().withColumn("h", F.lit(True))
    j = ev.join(t, "store_no").join(m, "store_no", "left").join(inside, ["store_no", "pos"], "left").join(hit, ["store_no", "pos"], "left")
    j = j.where(F.coalesce(F.col("best") > F.col("mid"), F.lit(False)) | (F.col("score") >= F.col("high")))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return j.select("store_no", "pos", F.round(F.col("e") - F.col("s"), 6).alias("length_s"), F.coalesce("frames", F.lit(0)).alias("frames"), zero("best"), zero("mean"), F.coalesce("h", F.lit(False)).alias("hits"))


@R.query("frames_owning_events", f"""WITH {EV}, {GT} SELECT DISTINCT ev.store_no, ev.pos FROM ev JOIN gt ON gt.store_no = ev.store_no AND floor(ev.s) <= gt.gs + 5 AND gt.gs + 5 <= floor(ev.e)""")
def frames_owning_events(spark, sf):
    """events whose whole seconds hold a chosen frame."""
    a = events(spark, sf).select("store_no", "pos", F.floor("s").alias("ls"), F.floor("e").alias("le"))
    p = truth(spark, sf).select("store_no", (F.col("gs") + 5).alias("rs"), (F.col("gs") + 5).alias("re"))
    return overlap_join(a, p, ["store_no"], lambda s, e, t, _: holds_closed(s, e, t)).select("store_no", "pos").distinct()


@R.query("frames_evidence_text", f"""WITH {EV}, {GT}, m AS (SELECT ev.store_no, ev.pos, gt.gs + 5 AS t FROM ev LEFT JOIN gt ON gt.store_no = ev.store_no AND ev.s <= gt.gs + 5 AND gt.gs + 5 <= ev.e)
SELECT store_no, pos, coalesce(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t), '') AS frames FROM m GROUP BY store_no, pos""")
def frames_evidence_text(spark, sf):
    """events with the seconds that are visual evidence for them, none included."""
    a = events(spark, sf).select("store_no", "pos", F.col("s").alias("ls"), F.col("e").alias("le"))
    p = truth(spark, sf).select("store_no", (F.col("gs") + 5).alias("t"), (F.col("gs") + 5).cast("double").alias("rs"), (F.col("gs") + 5).cast("double").alias("re"))
    m = overlap_join(a, p, ["store_no"], lambda s, e, t, _: holds_closed(s, e, t)).groupBy("store_no", "pos").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return a.join(m, ["store_no", "pos"], "left").select("store_no", "pos", F.coalesce(F.array_join("ts", ","), F.lit("")).alias("frames"))


_REFD = "(date_part('hour', vs.created_at) * 3600 + date_part('minute', vs.created_at) * 60 + CAST(floor(date_part('second', vs.created_at)) AS BIGINT))"


@R.query("display_to_video_sec", f"""WITH {EV}, {VS}, d AS (SELECT ev.store_no, ev.pos, {_REFD} AS r, ({_REFD} + CAST(floor(ev.s) AS BIGINT)) % 86400 AS d FROM ev JOIN vs ON vs.store_no = ev.store_no AND vs.created_at IS NOT NULL)
SELECT store_no, pos, d AS display_sec, greatest(0, CASE WHEN r > 43200 AND d < 43200 THEN d + 86400 ELSE d END - r) AS video_sec FROM d""")
def display_to_video_sec(spark, sf):
    """the clock that a video shows (it was made at ``created_at``) back to its second, over midnight."""
    at = F.col("created_at")
    d = _timed(spark, sf).where("created_at is not null").withColumn("r", (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("bigint"))
    d = d.withColumn("display_sec", ((F.col("r") + F.floor("s")) % 86400).cast("bigint"))
    return d.select("store_no", "pos", "display_sec", FR.video_second(F.col("display_sec"), F.lit(0), F.col("r"), wraps=F.lit(True)).alias("video_sec"))


@R.query("seconds_to_timestamp", f"WITH {EV}, {VS} SELECT ev.store_no, pos, format('{{:02d}}:{{:02d}}:{{:02d}}', CAST(floor(s) AS BIGINT) // 3600, CAST(floor(s) AS BIGINT) % 3600 // 60, CAST(floor(s) AS BIGINT) % 60) AS stamp, CAST(floor(s * fps) AS BIGINT) AS frame, round(floor(s * fps) / fps, 6) AS frame_sec FROM ev JOIN vs USING (store_no)")
def seconds_to_timestamp(spark, sf):
    """seconds as HH:MM:SS, as a frame, and the frame as seconds again."""
    fr = FR.frame_at(F.col("s"), F.col("fps"))
    return _timed(spark, sf).select("store_no", "pos", T.hms(F.col("s")).alias("stamp"), fr.alias("frame"), F.round(fr / F.col("fps"), 6).alias("frame_sec"))


@R.query("boxes_normalised", f"""WITH {VS}, d AS (SELECT store_no, entity_id, ord, frame FROM (SELECT store_no, id AS entity_id, unnest(range(len(frame_indices))) AS ord, unnest(frame_indices) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY store_no, id ORDER BY loaded_at DESC, len(coalesce(frame_indices, [])) DESC) AS rn FROM vdb_entities WHERE store_no IS NOT NULL AND id IS NOT NULL) WHERE rn = 1 AND frame_indices IS NOT NULL) WHERE frame IS NOT NULL),
b AS (SELECT d.*, vs.width AS w, vs.height AS h, frame % vs.width - 40.0 AS x0, frame % vs.height - 20.0 AS y0 FROM d JOIN vs ON vs.store_no = d.store_no WHERE vs.width > 0 AND vs.height > 0),
c AS (SELECT *, greatest(0, least(w, x0)) AS a0, greatest(0, least(h, y0)) AS b0, greatest(0, least(w, x0 + 120)) AS a1, greatest(0, least(h, y0 + 90)) AS b1, min(frame) OVER (PARTITION BY store_no, entity_id) AS base FROM b)
SELECT store_no, entity_id, ord, frame - base AS frame, CAST(round(a0 * 1000.0 / w) AS BIGINT) AS x0, CAST(round(b0 * 1000.0 / h) AS BIGINT) AS y0, CAST(round(a1 * 1000.0 / w) AS BIGINT) AS x1, CAST(round(b1 * 1000.0 / h) AS BIGINT) AS y1 FROM c WHERE a1 > a0 AND b1 > b0 AND (frame - base) % 2 = 0""")
def boxes_normalised(spark, sf):
    """Boxes of a track cut to the picture and put on a scale of 0 to 1000, frames counted from its
    first, every second one. The tables have no boxes: a window that moves with the frame stands in."""
    d = _detections(spark, sf).join(_stores(spark, sf).where("width > 0 and height > 0"), "store_no")
    x, y = F.col("frame") % F.col("width") - 40.0, F.col("frame") % F.col("height") - 20.0
    base = F.min("frame").over(Window.partitionBy("store_no", "entity_id"))
    c = d.select("store_no", "entity_id", "ord", (F.col("frame") - base).alias("frame"), "width", "height", FR.clamped_box(F.array(x, y, x + 120, y + 90), F.col("width"), F.col("height")).alias("box"))
    c = c.where("box is not null and frame % 2 = 0").withColumn("box", FR.normalised_box(F.col("box"), F.col("width"), F.col("height")))
    return c.select("store_no", "entity_id", "ord", "frame", *(F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


_MODES = f"""WITH {EV}, {GT}, {_SEGS}, {_FSC}, fr AS (SELECT store_no, sec, row_number() OVER (PARTITION BY store_no ORDER BY sec) - 1 AS r, count(*) OVER (PARTITION BY store_no) AS c FROM sec),
ft AS (SELECT fs.store_no, CAST(fs.sec AS BIGINT) AS sec, row_number() OVER (PARTITION BY fs.store_no ORDER BY fs.score DESC, fs.sec) AS r FROM fs),
f AS (SELECT 'all' AS how, store_no, sec FROM fr UNION ALL SELECT 'uniform', store_no, sec FROM fr WHERE c <= 20 OR r = c - 1 OR EXISTS (SELECT 1 FROM (SELECT unnest(range(19)) AS j) y WHERE CAST(floor(y.j * ((fr.c - 1) / 19.0)) AS BIGINT) = fr.r) UNION ALL SELECT DISTINCT 'topk', store_no, sec FROM ft WHERE r <= 20),
e AS (SELECT DISTINCT 'all' AS how, ev.store_no, ev.pos FROM ev JOIN gt ON gt.store_no = ev.store_no AND ev.s <= gt.ge AND ev.e >= gt.gs UNION SELECT how, store_no, pos FROM (SELECT f.how, f.store_no, f.sec, min(ev.pos) AS pos FROM f JOIN ev ON ev.store_no = f.store_no AND ev.s <= f.sec AND f.sec <= ev.e WHERE f.how <> 'all' GROUP BY ALL))
SELECT how, 'frames' AS kind, store_no, sec AS item FROM f UNION ALL SELECT how, 'events', store_no, pos FROM e"""


@R.query("context_modes", _MODES)
def context_modes(spark, sf):
    """what each mode puts before a model: frames chosen uniformly, by score or all of the segments', and the
    events of these frames (all: of the segments). A mode with both has the rows of both kinds."""
    return _context(spark, sf)


def _context(spark, sf, hows=("uniform", "topk", "all"), kinds=("frames", "events")):
    sec = _segment_seconds(spark, sf)
    spans = events(spark, sf).select("store_no", "pos", F.col("s").alias("ls"), F.col("e").alias("le"))
    out = None
    for how in hows:
        if how == "topk":
            fs, _ = _scored(spark, sf)
            fr = fs.withColumn("r", F.row_number().over(Window.partitionBy("store_no").orderBy(F.desc("score"), "sec"))).where("r <= 20").select("store_no", F.col("sec").cast("bigint").alias("sec")).distinct()
        else:
            fr = sec if how == "all" else _spread_of(sec, "store_no", "sec", 20)
        parts = []
        if "frames" in kinds:
            parts.append(fr.select(F.lit(how).alias("how"), F.lit("frames").alias("kind"), "store_no", F.col("sec").alias("item")))
        if "events" in kinds:
            if how == "all":
                g = truth(spark, sf).select("store_no", F.col("gs").cast("double").alias("rs"), F.col("ge").cast("double").alias("re"))
                ev = overlap_join(spans, g, ["store_no"], overlaps_closed).select("store_no", "pos")
            else:
                p = fr.select("store_no", "sec", F.col("sec").cast("double").alias("rs"), F.col("sec").cast("double").alias("re"))
                ev = overlap_join(spans, p, ["store_no"], lambda s, e, t, _: holds_closed(s, e, t)).groupBy("store_no", "sec").agg(F.min("pos").alias("pos")).select("store_no", "pos")
            parts.append(ev.distinct().select(F.lit(how).alias("how"), F.lit("events").alias("kind"), "store_no", F.col("pos").alias("item")))
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


_HULL = f"""hl AS (SELECT store_no, question_id, min(gs) AS hs, max(CASE WHEN point THEN gs ELSE ge END) AS he FROM gt GROUP BY ALL),
ge0 AS (SELECT hl.store_no, hl.question_id, round(ev.s, 6) AS s, round(ev.e, 6) AS e FROM hl JOIN ev ON ev.store_no = hl.store_no AND NOT (ev.e < hl.hs OR ev.s > hl.he))"""


def _merge_sql(name: str, rows: str, keys: str) -> str:
    return f"""{name}_f AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {rows}),
{name}_i AS (SELECT {keys}, s, e, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_f),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY {keys}, g)"""


_K2 = "store_no, question_id"
_SHARES = lambda name, a, b: f"{name} AS (SELECT b.{'store_no'}, b.question_id, bool_or(a.s IS NOT NULL) AS hit, coalesce(sum(CASE WHEN a.s IS NOT NULL AND greatest(a.s, b.s) < least(a.e, b.e) THEN least(a.e, b.e) - greatest(a.s, b.s) END), 0) AS shared FROM {b} b LEFT JOIN {a} a ON a.store_no = b.store_no AND a.question_id = b.question_id AND NOT (a.e < b.s OR a.s > b.e) GROUP BY ALL)"
_TOPEV = "te AS (SELECT t.store_no, t.question_id, round(f.s, 6) AS s, round(f.e, 6) AS e FROM top t JOIN (SELECT store_no, question_id, event_id, arg_min(s, ord) AS s, arg_min(e, ord) AS e FROM sd GROUP BY ALL) f USING (store_no, question_id, event_id))"


@R.query("overlap_variants_frames", f"""WITH {SD}, {TOP}, {GT}, {_HULL}, {_merge_sql('gx', 'ge0', _K2)}, {_TOPEV}, fr AS (SELECT DISTINCT store_no, question_id, CAST(floor(s) AS BIGINT) + 1 AS t FROM te),
fa AS (SELECT fr.store_no, fr.question_id, count(*) AS frames, count(*) FILTER (EXISTS (SELECT 1 FROM gx WHERE gx.store_no = fr.store_no AND gx.question_id = fr.question_id AND gx.s <= fr.t AND fr.t <= gx.e)) AS in_gt FROM fr GROUP BY ALL),
ow AS (SELECT DISTINCT store_no, question_id, s, e FROM (SELECT fr.store_no, fr.question_id, fr.t, arg_min(round(ev.s, 6), ev.pos) AS s, arg_min(round(ev.e, 6), ev.pos) AS e FROM fr JOIN ev ON ev.store_no = fr.store_no AND ev.s <= fr.t AND fr.t <= ev.e GROUP BY ALL)), {_merge_sql('om', 'ow', _K2)},
hb AS (SELECT store_no, question_id, hs AS s, he AS e FROM hl), {_SHARES('sb', 'om', 'hb')}, {_SHARES('sc', 'om', 'gx')}, gl AS (SELECT store_no, question_id, sum(e - s) AS l FROM gx GROUP BY ALL)
SELECT hl.store_no, hl.question_id, fa.frames, fa.in_gt, fa.in_gt > 0 AS a_hit, sb.hit AS b_hit, round(CASE WHEN he > hs THEN sb.shared / (he - hs) ELSE 0 END, 6) AS b_share, sc.hit AS c_hit, round(sc.shared / gl.l, 6) AS c_share
FROM hl JOIN fa USING (store_no, question_id) JOIN sb USING (store_no, question_id) LEFT JOIN sc USING (store_no, question_id) LEFT JOIN gl USING (store_no, question_id)""")
def overlap_variants_frames(spark, sf):
    """Frames of a question (one of each top seed) against the events of its time (A), the events of the frames
    against its time (B) and against the events of its time (C). A list of points counts from its first to its last."""
    key = ["store_no", "question_id"]
    placed = checkpointed(stores.placed_questions(table(spark, sf, "qa_files")).select("file_id", "video_no", "question_no", "video_key", "question_id", "time_reference"))  # read three times
    g = checkpointed(_hulls(spark, sf, placed))
    fr = checkpointed(S.topk_nulls_first(seeds(spark, sf, placed), 5).groupBy(*key).agg(F.collect_set((F.floor(F.round("s", 6)) + 1).cast("bigint")).alias("ts")).join(g, key))  # at most 5 frames each
    spans = events(spark, sf).select("store_no", "pos", F.col("s").alias("ls"), F.col("e").alias("le"))
    at = fr.select(*key, F.explode("ts").alias("t"))
    p = at.select("store_no", "t").distinct().select("*", F.col("t").cast("double").alias("rs"), F.col("t").cast("double").alias("re"))
    real = lambda s, e: F.struct(F.round(s, 6).alias("s"), F.round(e, 6).alias("e"))
    own = overlap_join(spans, p, ["store_no"], lambda s, e, t, _: holds_closed(s, e, t)).groupBy("store_no", "t").agg(F.min_by(real("ls", "le"), "pos").alias("x"))
    own = at.join(own, ["store_no", "t"]).groupBy(*key).agg(_merged_few(F.collect_set("x")).alias("ours"))
    mine = fr.join(own, key, "left").withColumn("ours", F.coalesce("ours", F.array().cast("array<struct<s:double,e:double>>")))
    met = overlap_join(spans.drop("pos"), g.select(*key, F.col("hs").cast("double").alias("rs"), F.col("he").cast("double").alias("re")), ["store_no"], overlaps_closed)
    gx = _merged_by(met.select(*key, F.round("ls", 6).alias("s"), F.round("le", 6).alias("e")), key)
    hit = lambda s, e: F.exists("ours", lambda o: overlaps_closed(o["s"], o["e"], s, e))
    shared = lambda s, e: F.aggregate("ours", F.lit(0.0), lambda n, o: n + F.greatest(F.lit(0.0), F.least(o["e"], e) - F.greatest(o["s"], s)))
    s, e = F.col("s"), F.col("e")
    c = gx.join(mine, key).select(*key, F.size(F.filter("ts", lambda t: holds_closed(s, e, t))).alias("n"), hit(s, e).alias("hit"), shared(s, e).alias("shared"), (e - s).alias("l"))
    share = F.when(F.sum("l") > 0, F.sum("shared") / F.sum("l")).otherwise(F.lit(0.0))
    c = c.groupBy(*key).agg(F.sum("n").alias("n"), F.max("hit").alias("c_hit"), F.round(share, 6).alias("c_share"))
    hs, he = F.col("hs").cast("double"), F.col("he").cast("double")
    b_share = F.round(F.when(he > hs, shared(hs, he) / (he - hs)).otherwise(F.lit(0.0)), 6)
    out = mine.join(c, key, "left").withColumn("in_gt", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.select(*key, F.size("ts").cast("bigint").alias("frames"), "in_gt", (F.col("in_gt") > 0).alias("a_hit"), hit(hs, he).alias("b_hit"), b_share.alias("b_share"), "c_hit", "c_share")


def _merged_few(spans):
    """An array of a few spans merged where they touch, as a column."""
    last = lambda done: F.element_at(done, -1)
    wider = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["s"].alias("s"), F.greatest(last(done)["e"], x["e"]).alias("e"))))
    step = lambda done, x: F.when((F.size(done) == 0) | (x["s"] > F.try_element_at(done, F.lit(-1))["e"]), F.concat(done, F.array(x))).otherwise(wider(done, x))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<s:double,e:double>>"), step)


def _merged_by(df, key):
    """Spans of real ends merged where they touch; a key's spans go through one task in order, none is held."""
    w = Window.partitionBy(*key).orderBy("s", "e")
    top = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = df.withColumn("_new", (top.isNull() | (F.col("s") > top)).cast("bigint"))
    m = m.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(*key, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


@R.query("overlap_variants_events", f"""WITH {SD}, {TOP}, {GT}, {_HULL}, {_merge_sql('gx', 'ge0', _K2)}, {_TOPEV}, {_merge_sql('om', 'te', _K2)}, hb AS (SELECT store_no, question_id, hs AS s, he AS e FROM hl), {_SHARES('sb', 'om', 'hb')}, {_SHARES('sc', 'om', 'gx')},
gl AS (SELECT store_no, question_id, sum(e - s) AS l FROM gx GROUP BY ALL), tq AS (SELECT DISTINCT store_no, question_id FROM te)
SELECT hl.store_no, hl.question_id, sb.hit AS a_hit, round(CASE WHEN he > hs THEN sb.shared / (he - hs) ELSE 0 END, 6) AS a_share, sc.hit AS b_hit, round(sc.shared / gl.l, 6) AS b_share
FROM hl JOIN tq USING (store_no, question_id) JOIN sb USING (store_no, question_id) LEFT JOIN sc USING (store_no, question_id) LEFT JOIN gl USING (store_no, question_id)""")
def overlap_variants_events(spark, sf):
    """Top seeds' events of a question against its time (A) and against the merged events of its time (B)."""
    hull, gt_ev, te, q = _variants(spark, sf)
    out = q.join(te.select("q").distinct(), "q").join(_shares(te, hull, "a"), "q").join(_shares(te, gt_ev, "b"), "q", "left")
    return out.select("store_no", "question_id", "a_hit", "a_share", "b_hit", "b_share")


def _hulls(spark, sf, placed=None):
    """Each question's time from its first to its last second."""
    return truth(spark, sf, placed).groupBy("store_no", "question_id").agg(F.min("gs").alias("hs"), F.max(F.when(F.col("point"), F.col("gs")).otherwise(F.col("ge"))).alias("he"))


def _variants(spark, sf):
    """(hull of each question's time, merged events that it touches, spans of its top seeds, questions), by ``q``."""
    key = F.concat_ws(":", "store_no", "question_id").alias("q")
    g = _hulls(spark, sf)
    q = g.select(key, "store_no", "question_id")
    hull = g.select(key, F.col("hs").cast("double").alias("s"), F.col("he").cast("double").alias("e"))
    spans = events(spark, sf).select("store_no", F.col("s").alias("ls"), F.col("e").alias("le"))
    met = overlap_join(spans, g.select(key, "store_no", F.col("hs").cast("double").alias("rs"), F.col("he").cast("double").alias("re")), ["store_no"], overlaps_closed)
    gt_ev = _merged_real(met.select("q", F.col("ls").alias("s"), F.col("le").alias("e")))
    return hull, gt_ev, _cache_seeds(spark, sf).select(key, "s", "e"), q


def _merged_real(df):
    """Spans of real ends, rounded to microseconds, merged (in shards of 18 minutes)."""
    m = merged(df.select("q", F.round(F.col("s") * 1e6).cast("bigint").alias("s"), F.round(F.col("e") * 1e6).cast("bigint").alias("e")), "q", shard=1 << 30)
    return m.select("q", (F.col("s") / 1e6).alias("s"), (F.col("e") / 1e6).alias("e"))


def _shares(ours, theirs, name):
    """Whether any of our spans touches theirs (ends included), and the share of theirs that ours cover."""
    a = _merged_real(ours).select("q", F.col("s").alias("ls"), F.col("e").alias("le"))
    met = overlap_join(a, theirs.select("q", F.col("s").alias("rs"), F.col("e").alias("re")), ["q"], overlaps_closed)
    got = met.groupBy("q").agg(F.sum(F.greatest(F.lit(0.0), F.least("le", "re") - F.greatest("ls", "rs"))).alias("shared"))
    total = theirs.groupBy("q").agg(F.sum(F.col("e") - F.col("s")).alias("l"))
    share = F.when(F.col("l") > 0, F.coalesce("shared", F.lit(0.0)) / F.col("l")).otherwise(F.lit(0.0))
    return total.join(got, "q", "left").select("q", F.col("shared").isNotNull().alias(f"{name}_hit"), F.round(share, 6).alias(f"{name}_share"))


# --- tracks ----------------------------------------------------------------------------------

_DET = """det AS (SELECT store_no, entity_id, ord, frame FROM (SELECT store_no, id AS entity_id, unnest(range(len(frame_indices))) AS ord, unnest(frame_indices) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY store_no, id ORDER BY loaded_at DESC, len(coalesce(frame_indices, [])) DESC) AS rn FROM vdb_entities WHERE store_no IS NOT NULL AND id IS NOT NULL) WHERE rn = 1 AND frame_indices IS NOT NULL) WHERE frame IS NOT NULL)"""


def _detections(spark, sf):
    raw = table(spark, sf, "vdb_entities").where("store_no is not null and id is not null")
    n = F.size(F.coalesce("frame_indices", F.array().cast("array<bigint>")))
    one = raw.withColumn("r", F.row_number().over(Window.partitionBy("store_no", "id").orderBy(F.desc("loaded_at"), n.desc()))).where("r = 1")
    return one.select("store_no", F.col("id").alias("entity_id"), F.posexplode("frame_indices").alias("ord", "frame")).where("frame is not null").withColumn("event_id", F.lit(None).cast("string"))


_NAME = "nm AS (SELECT store_no, id AS entity_id, min(coalesce(nullif(lower(regexp_extract(d, '([A-Za-z]+)', 1)), ''), 'unknown')) AS class FROM (SELECT store_no, id, unnest(descriptions) AS d FROM vdb_entities WHERE store_no IS NOT NULL AND id IS NOT NULL) WHERE d IS NOT NULL GROUP BY ALL)"


def _classes(spark, sf):
    """Class of an entity: the first word of its descriptions, the smallest of several."""
    d = table(spark, sf, "vdb_entities").where("store_no is not null and id is not null").select("store_no", F.col("id").alias("entity_id"), F.explode("descriptions").alias("d")).where("d is not null")
    word = F.lower(F.regexp_extract("d", "([A-Za-z]+)", 1))
    return d.groupBy("store_no", "entity_id").agg(F.min(F.when(word == "", "unknown").otherwise(word)).alias("class"))


@R.query("track_upsert_histories", f"""WITH {EV}, {VS}, {_DET}, {_NAME}, o AS (SELECT det.store_no, det.entity_id, det.frame, min(ev.pos) AS pos FROM det JOIN vs ON vs.store_no = det.store_no LEFT JOIN ev ON ev.store_no = det.store_no AND ev.s <= det.frame / vs.fps AND det.frame / vs.fps <= ev.e GROUP BY det.store_no, det.entity_id, det.ord, det.frame),
x AS (SELECT store_no, entity_id, pos, min(frame) AS f FROM o WHERE pos IS NOT NULL GROUP BY ALL), y AS (SELECT store_no, entity_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY f, pos) AS event_ids FROM x GROUP BY ALL),
h AS (SELECT store_no, entity_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS total_frames, md5(string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame)) AS frames FROM o GROUP BY ALL)
SELECT h.*, coalesce(nm.class, 'unknown') AS class, coalesce(y.event_ids, '') AS event_ids FROM h LEFT JOIN nm ON nm.store_no = h.store_no AND nm.entity_id = h.entity_id LEFT JOIN y ON y.store_no = h.store_no AND y.entity_id = h.entity_id""")
def track_upsert_histories(spark, sf):
    """History of each track from its detections: frames, class, and the places of the events that hold them,
    each once in order of first frame."""
    d = _detections(spark, sf).drop("event_id").join(_stores(spark, sf).select("store_no", "fps"), "store_no")
    d = d.withColumns({"rs": F.col("frame") / F.col("fps"), "re": F.col("frame") / F.col("fps")})
    spans = events(spark, sf).select("store_no", "pos", F.col("s").alias("ls"), F.col("e").alias("le"))
    own = overlap_join(spans, d.select("store_no", "entity_id", "ord", "rs", "re"), ["store_no"], lambda s, e, t, _: holds_closed(s, e, t)).groupBy("store_no", "entity_id", "ord").agg(F.min("pos").alias("event_id"))
    t = K.upserted(d.select("store_no", "entity_id", "ord", "frame").join(own, ["store_no", "entity_id", "ord"], "left"), ["store_no", "entity_id"])
    t = t.join(_classes(spark, sf), ["store_no", "entity_id"], "left").fillna("unknown", ["class"])
    return t.select("store_no", "entity_id", "first_frame", "last_frame", "total_frames", F.md5(F.array_join("frames", ",")).alias("frames"), "class", F.array_join("event_ids", ",").alias("event_ids"))


@R.query("track_stats", f"WITH {_DET}, {_NAME}, t AS (SELECT store_no, entity_id, count(*) AS n FROM det GROUP BY ALL) SELECT t.store_no, coalesce(nm.class, 'unknown') AS class, count(*) AS tracks, CAST(sum(n) AS BIGINT) AS total_frames, round(avg(n), 6) AS mean_length FROM t LEFT JOIN nm ON nm.store_no = t.store_no AND nm.entity_id = t.entity_id GROUP BY ROLLUP (t.store_no, coalesce(nm.class, 'unknown'))")
def track_stats(spark, sf):
    """Tracks, frames and mean length by store and class, by store, and over all."""
    t = _detections(spark, sf).groupBy("store_no", "entity_id").agg(F.count("*").alias("n")).join(_classes(spark, sf), ["store_no", "entity_id"], "left").fillna("unknown", ["class"])
    return t.rollup("store_no", "class").agg(F.count("*").alias("tracks"), F.sum("n").cast("bigint").alias("total_frames"), F.round(F.avg("n"), 6).alias("mean_length"))


@R.query("track_frame_range", f"WITH {_DET} SELECT store_no, entity_id, count(*) AS n, min(frame) AS first_frame FROM det WHERE frame BETWEEN 500 AND 5000 GROUP BY store_no, entity_id")
def track_frame_range(spark, sf):
    """Histories inside a range of frames, empty ones dropped."""
    t = K.upserted(_detections(spark, sf), ["store_no", "entity_id"], 500, 5000)
    return t.select("store_no", "entity_id", F.col("total_frames").alias("n"), "first_frame")


_WIN = f"w AS (SELECT br.store_no, br.entity_id, min(CAST(floor(ev.s * vs.fps) AS BIGINT)) AS lo, min(CAST(floor(ev.e * vs.fps) AS BIGINT)) AS hi, br.event_id FROM br JOIN ev ON ev.store_no = br.store_no AND ev.event_id = br.event_id JOIN vs ON vs.store_no = br.store_no GROUP BY br.store_no, br.entity_id, br.event_id)"


@R.query("track_clip_to_event", f"""WITH {EV}, {BR}, {VS}, {_DET}, {_WIN}, h AS (SELECT store_no, entity_id, list_sort(list(frame)) AS fr FROM det GROUP BY ALL),
c AS (SELECT h.store_no, h.entity_id, w.event_id, fr, list_filter(fr, lambda x: x BETWEEN w.lo AND w.hi) AS got FROM h JOIN w ON w.store_no = h.store_no AND w.entity_id = h.entity_id)
SELECT store_no, entity_id, event_id, len(got) > 0 AS inside, array_to_string(CASE WHEN len(got) = 0 THEN fr ELSE got END, ',') AS frames FROM c""")
def track_clip_to_event(spark, sf):
    """History of an entity clipped to the frames of each event it occurs in; whole if none is there."""
    h = _detections(spark, sf).groupBy("store_no", "entity_id").agg(F.array_sort(F.collect_list("frame")).alias("fr"))
    ev = _timed(spark, sf).select("store_no", "event_id", FR.frame_at(F.col("s"), F.col("fps")).alias("lo"), FR.frame_at(F.col("e"), F.col("fps")).alias("hi"))
    w = bridge(spark, sf).select("store_no", "entity_id", "event_id").distinct().join(ev, ["store_no", "event_id"]).groupBy("store_no", "entity_id", "event_id").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    c = h.join(w, ["store_no", "entity_id"])
    inside = F.exists("fr", lambda x: x.between(F.col("lo"), F.col("hi")))
    return c.select("store_no", "entity_id", "event_id", inside.alias("inside"), F.array_join(K.clipped(F.col("fr"), F.col("lo"), F.col("hi")), ",").alias("frames"))


@R.query("filter_object_frames", f"WITH {VS}, {_DET} SELECT det.store_no, det.entity_id, count(*) AS n FROM det JOIN vs ON vs.store_no = det.store_no WHERE det.frame >= vs.n // 4 AND det.frame <= vs.n // 2 GROUP BY ALL")
def filter_object_frames(spark, sf):
    """Detections with a frame number in a closed range (the second quarter of their video)."""
    d = _detections(spark, sf).join(_stores(spark, sf).select("store_no", "n"), "store_no")
    return d.where(K.frame_filter(F.col("frame"), F.floor(F.col("n") / 4), F.floor(F.col("n") / 2))).groupBy("store_no", "entity_id").agg(F.count("*").alias("n"))


# --- verification and cache ------------------------------------------------------------------

_W4 = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4))"
_OPT = f"""op AS (SELECT store_no, question_id, unnest(range(len(l))) AS col, unnest(l) AS option FROM (SELECT store_no, question_id, list_filter(list_transform(CASE json_type(o) WHEN 'ARRAY' THEN CAST(o AS VARCHAR[]) ELSE [] END, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS l FROM (SELECT store_no, question_id, coalesce((q -> 'options'), CAST('null' AS JSON)) AS o FROM qn)))"""
_TX = "tx AS (SELECT store_no, event_id, arg_min(description, pos) AS d FROM ev GROUP BY ALL)"
_MAT = f"""{SD}, {TOP}, {_OPT}, {_TX}, mx AS (SELECT t.store_no, t.question_id, t.event_id, op.col, CASE WHEN len(list_intersect({_W4.format('op.option')}, {_W4.format("coalesce(tx.d, '')")})) > 0 THEN 'yes' ELSE 'no' END AS verdict
FROM top t JOIN op ON op.store_no = t.store_no AND op.question_id = t.question_id JOIN tx ON tx.store_no = t.store_no AND tx.event_id = t.event_id)"""


def _options(spark, sf):
    """Options of each question, the expected events of a verification: store_no, question_id, col, option."""
    o = F.filter(F.transform(F.from_json("options", "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return store_questions(spark, sf).select("store_no", "question_id", F.posexplode(o).alias("col", "option"))


def _verdicts(spark, sf, candidates):
    """Yes where a caption shares a word of four letters with an option of the question: a stand-in for a model."""
    tx = events(spark, sf).groupBy("store_no", "event_id").agg(F.min_by("description", "pos").alias("d"))
    w = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda x: F.length(x) >= 4)
    m = candidates.select("store_no", "question_id", "event_id").join(_options(spark, sf), ["store_no", "question_id"]).join(tx, ["store_no", "event_id"])
    return m.select("store_no", "question_id", "event_id", "col", F.when(F.arrays_overlap(w(F.col("option")), w(F.coalesce("d", F.lit("")))), "yes").otherwise("no").alias("verdict"))


def _matrix(spark, sf):
    return _verdicts(spark, sf, top_seeds(spark, sf))


_VK = ["store_no", "question_id", "event_id"]


def _verify_sql(cond):
    return f"WITH {_MAT}, ct AS (SELECT store_no, question_id, event_id, count(*) FILTER (verdict = 'yes') AS yes, count(*) AS asked FROM mx GROUP BY ALL) SELECT * FROM (SELECT t.store_no, t.question_id, t.event_id, coalesce(yes, 0) AS yes, coalesce(asked, 0) AS asked FROM top t LEFT JOIN ct ON ct.store_no = t.store_no AND ct.question_id = t.question_id AND ct.event_id = t.event_id) WHERE {cond}"


@R.query("verify_matrix_any", _verify_sql("yes >= 1 OR asked = 0"))
def verify_matrix_any(spark, sf):
    """C-1: candidates with a yes, or of which nothing was asked."""
    return C.verified(top_seeds(spark, sf), _matrix(spark, sf), _VK, "any")


@R.query("verify_matrix_majority", _verify_sql("yes > asked // 2"))
def verify_matrix_majority(spark, sf):
    """C-1: candidates with more yes than half."""
    return C.verified(top_seeds(spark, sf), _matrix(spark, sf), _VK, "majority")


@R.query("verify_matrix_all", _verify_sql("yes = asked AND asked > 0"))
def verify_matrix_all(spark, sf):
    """C-1: candidates with nothing but yes."""
    return C.verified(top_seeds(spark, sf), _matrix(spark, sf), _VK, "all")


@R.query("postfilter_all_no", f"WITH {_MAT}, {FB}, bad AS (SELECT store_no, question_id, event_id FROM mx GROUP BY ALL HAVING count(*) FILTER (verdict = 'yes') = 0) SELECT store_no, question_id, event_id FROM fb WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.store_no = fb.store_no AND bad.question_id = fb.question_id AND bad.event_id = fb.event_id)")
def postfilter_all_no(spark, sf):
    """C-4: candidates without those that were seen and never confirmed."""
    cand = temporal_neighbours(spark, sf, top_seeds(spark, sf))
    return C.without_all_no(cand, _matrix(spark, sf), _VK).select(*_VK)


@R.query("verdict_parse", f"""WITH {_MAT}, n AS (SELECT store_no, question_id, count(*) AS n FROM op GROUP BY ALL), v AS (SELECT store_no, question_id, event_id, list(verdict ORDER BY col) AS v FROM mx GROUP BY ALL)
SELECT v.store_no, v.question_id, v.event_id, array_to_string(CASE v.question_id % 3 WHEN 0 THEN list_concat(v, ['no']) WHEN 1 THEN list_transform(v, lambda x: 'no') ELSE v[1:n.n - 1] END, ',') AS verdicts FROM v JOIN n ON n.store_no = v.store_no AND n.question_id = v.question_id""")
def verdict_parse(spark, sf):
    """C-2: the verdicts of each candidate written as a model does and read again: fenced and one short, cut off,
    and one too long."""
    k = F.col("question_id") % 3
    v = _matrix(spark, sf).groupBy(*_VK).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "verdict"))), lambda x: F.upper(x["verdict"])).alias("v"))
    j = F.to_json("v")
    text = F.when(k == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(k == 1, F.expr("left(to_json(v), length(to_json(v)) - 2)")).otherwise(j)
    m = F.size("v") + F.when(k == 0, 1).when(k == 1, 0).otherwise(-1)
    return v.select(*_VK, F.array_join(C.verdict_list(text, m), ",").alias("verdicts"))


@R.query("expected_events_parse", """SELECT response_id, array_to_string(CASE WHEN response_id % 4 = 3 THEN [] ELSE list_transform(list_filter(coalesce(options, []), lambda x: x IS NOT NULL AND x <> ''), lambda x: trim(x)) END, '|') AS expected FROM responses""")
def expected_events_parse(spark, sf):
    """C-3: the options of each response written as a model writes expected events (plain, fenced, or cut off) and
    read again; what cannot be read has none."""
    k = F.col("response_id") % 4
    j = F.concat(F.lit('{"query_events": '), F.coalesce(F.to_json("options"), F.lit("null")), F.lit("}"))
    text = F.when(k == 0, j).when(k == 3, F.concat(F.lit('{"query_events": '), F.lit('["cut'))).otherwise(F.concat(F.lit("```json\n"), j, F.lit("\n```")))
    return table(spark, sf, "responses").select("response_id", F.array_join(C.expected_events(text), "|").alias("expected"))


@R.query("event_text", f"WITH {EV} SELECT store_no, pos, '[' || CAST(floor(s) AS BIGINT) || '-' || CAST(floor(e) AS BIGINT) || '] ' || coalesce(description, '') AS line FROM ev")
def event_text(spark, sf):
    """C-12: text of an event for verification."""
    return events(spark, sf).select("store_no", "pos", F.concat(F.lit("["), F.floor("s").cast("string"), F.lit("-"), F.floor("e").cast("string"), F.lit("] "), F.coalesce("description", F.lit(""))).alias("line"))


def _cache_seeds(spark, sf):
    return top_seeds(spark, sf).select("store_no", "question_id", "event_id", "s", "e")


def cache_rows(spark, sf):
    """Rows of :func:`cross_cache`: top seeds of every question and their neighbours, with spans and verdicts."""
    top = checkpointed(top_seeds(spark, sf).select("store_no", "question_id", "event_id", F.col("rnk").cast("bigint").alias("rnk")))  # read twice
    pn = prev_next(events(spark, sf).select("store_no", "pos", "event_id"), "store_no", "pos", "event_id")
    near = top.join(pn, ["store_no", "event_id"]).select("store_no", "question_id", F.col("event_id").alias("seed_id"), F.explode(F.array("prev_event_id", "next_event_id")).alias("event_id")).where("event_id is not null").distinct()
    rows = checkpointed(top.select("store_no", "question_id", F.lit(None).cast("string").alias("seed_id"), "event_id", "rnk").unionByName(near.withColumn("rnk", F.lit(0).cast("bigint"))))
    span = events(spark, sf).groupBy("store_no", "event_id").agg(F.min_by(F.struct("s", "e"), "pos").alias("x"))
    ok = C.verified(rows, _verdicts(spark, sf, rows.select(*_VK).distinct()), _VK, "any").select(*_VK, F.lit(True).alias("ok"))
    return rows.join(span, ["store_no", "event_id"]).join(ok, _VK, "left").select("store_no", "question_id", "seed_id", "event_id", "rnk", "x.s", "x.e", F.coalesce("ok", F.lit(False)).alias("ok"))


@R.query("crosscache_sequential")
def crosscache_sequential(spark, sf):
    """C-5/C-6: queries of each store in order against its growing cache: reused and covered, times, entries."""
    return C.cross_cache(cache_rows(spark, sf)).drop("a", "b")


@R.query("crosscache_method_a")
def crosscache_method_a(spark, sf):
    """C-7: uncovered seeds with their neighbours, cut to the budget and verified, and the reused ids."""
    got = C.cross_cache(cache_rows(spark, sf)).where("a <> ''")
    return got.select("store_no", "question_id", F.explode(F.split("a", ",")).alias("event_id"))


@R.query("crosscache_method_b")
def crosscache_method_b(spark, sf):
    """C-8: seeds, reused ids and the neighbours of all seeds that the cache does not cover, with the length of
    these neighbours."""
    got = C.cross_cache(cache_rows(spark, sf)).where("b <> ''")
    return got.select("store_no", "question_id", "time_b_s", F.explode(F.split("b", ",")).alias("event_id"))


@R.query("explore_batches", f"""WITH {_MAT}, {FB}, b1 AS (SELECT store_no, question_id, event_id, 0 AS extra, rnk AS place FROM top UNION ALL SELECT fb.store_no, fb.question_id, fb.event_id, 1, 0 FROM fb WHERE NOT EXISTS (SELECT 1 FROM top z WHERE z.store_no = fb.store_no AND z.question_id = fb.question_id AND z.event_id = fb.event_id)),
c1 AS (SELECT store_no, question_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY extra, place, event_id) AS slot FROM b1) WHERE slot <= 12),
tm AS (SELECT DISTINCT store_no, question_id, event_id FROM sd WHERE score IS NULL), tf AS (SELECT DISTINCT t.store_no, t.question_id, u.e AS event_id FROM tm t JOIN pn ON pn.store_no = t.store_no AND pn.event_id = t.event_id, LATERAL (SELECT pn.p AS e UNION ALL SELECT pn.n) u WHERE u.e IS NOT NULL),
b2 AS (SELECT * FROM tm UNION SELECT * FROM tf), h2 AS (SELECT * FROM b2 EXCEPT SELECT * FROM c1), r2 AS (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY store_no, question_id) AS n FROM h2),
c2 AS (SELECT store_no, question_id, event_id FROM r2 WHERE n <= 4 OR EXISTS (SELECT 1 FROM (SELECT unnest(range(4)) AS i) k WHERE k.i * r2.n // 4 = r2.r)),
al AS (SELECT 1 AS batch, * FROM c1 UNION ALL SELECT 2, * FROM c2),
vd AS (SELECT a.batch, a.store_no, a.question_id, a.event_id, count(op.col) AS asked, count(*) FILTER (op.col IS NOT NULL AND len(list_intersect({_W4.format('op.option')}, {_W4.format("coalesce(tx.d, '')")})) > 0) AS yes
FROM al a JOIN tx ON tx.store_no = a.store_no AND tx.event_id = a.event_id LEFT JOIN op ON op.store_no = a.store_no AND op.question_id = a.question_id GROUP BY ALL)
SELECT batch, store_no, question_id, event_id, yes >= 1 OR asked = 0 AS kept FROM vd""")
def explore_batches(spark, sf):
    """C-10/C-11: seeds and their neighbours first, cut to a budget of 12; then time matches and their neighbours
    that are not in the history, four evenly chosen by id; all verified."""
    top = top_seeds(spark, sf)
    c1 = S.budget_cap(top, temporal_neighbours(spark, sf, top), 12).select(*_VK)
    tm = S.temporal_only(seeds(spark, sf))
    h2 = tm.unionByName(temporal_neighbours(spark, sf, tm).select(*_VK)).distinct().join(c1, _VK, "left_anti")
    w = Window.partitionBy("store_no", "question_id")
    r2 = h2.withColumns({"r": F.row_number().over(w.orderBy("event_id")) - 1, "n": F.count("*").over(w)})
    c2 = r2.where((F.col("n") <= 4) | F.exists(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.floor(i * F.col("n") / 4)), lambda x: x == F.col("r")))
    al = c1.select(F.lit(1).alias("batch"), *_VK).unionByName(c2.select(F.lit(2).alias("batch"), *_VK))
    ok = C.verified(al, _verdicts(spark, sf, al.select(*_VK).distinct()), _VK, "any").select(*_VK, F.lit(True).alias("ok"))
    return al.join(ok, _VK, "left").select("batch", *_VK, F.coalesce("ok", F.lit(False)).alias("kept"))


@R.query("history_band_anti", f"""WITH {SD}, {TOP}, {_TOPEV}, m AS (SELECT DISTINCT store_no, question_id, (s + e) / 2 AS m FROM te), c AS (SELECT t.store_no, t.question_id, t.event_id, (f.s + f.e) / 2 AS m FROM top t JOIN (SELECT store_no, question_id, event_id, arg_min(s, ord) AS s, arg_min(e, ord) AS e FROM sd GROUP BY ALL) f USING (store_no, question_id, event_id))
SELECT store_no, question_id, event_id FROM c WHERE NOT EXISTS (SELECT 1 FROM m h WHERE h.store_no = c.store_no AND h.question_id = c.question_id - 1 AND abs(h.m - c.m) <= 30)""")
def history_band_anti(spark, sf):
    """Seeds of a question whose middle is farther than 30 s from all that the question before it saw."""
    c = _cache_seeds(spark, sf).withColumn("m", (F.col("s") + F.col("e")) / 2)
    a = c.select(*_VK, F.col("m").alias("ls"), F.col("m").alias("le"))
    h = c.select("store_no", (F.col("question_id") + 1).alias("question_id"), (F.col("m") - 30).alias("rs"), (F.col("m") + 30).alias("re"), F.col("m").alias("hm")).distinct()
    near = overlap_join(a, h, ["store_no", "question_id"], overlaps_closed).where(F.abs(F.col("hm") - F.col("ls")) <= 30).select(*_VK).distinct()
    return c.select(*_VK).join(near, _VK, "left_anti")


# --- event lists -----------------------------------------------------------------------------


def chunk_lists(spark, sf):
    """One list per (store, question) from its first 30 seeds: a chunk per seed."""
    top = S.topk_nulls_first(seeds(spark, sf), 30).withColumn("score", F.coalesce("score", F.lit(1.0)))
    return top.select(
        F.concat_ws(":", "store_no", "question_id").alias("list_id"), F.lit(0).alias("chunk_no"), "s", "e", "score", (F.col("ord") % 3).cast("int").alias("generation"),
        F.array("event_id").alias("event_ids"), F.array("s").alias("data_s"), F.array("e").alias("data_e"),
    )


_CL = f"""{SD}, lst AS (SELECT store_no || ':' || question_id AS list_id, s, e, coalesce(score, 1.0) AS score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY score DESC NULLS FIRST, ord) AS rnk FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, event_id ORDER BY ord) AS r1 FROM sd) WHERE r1 = 1)) WHERE rnk <= 30)"""


_LC = f"""{SD}, lc AS (SELECT store_no, store_no || ':' || question_id AS list_id, s, e, coalesce(score, 1.0) AS score, ord % 3 AS g, event_id FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY score DESC NULLS FIRST, ord) AS rnk FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, event_id ORDER BY ord) AS r1 FROM sd) WHERE r1 = 1)) WHERE rnk <= 30)"""


def _fold_sql(rows: str) -> str:
    """The ordered merge as a recursion over the places of each list. ``rows``: list_id, s, e, score, g, ids, ds."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY s, e, ids) AS rn FROM {rows}),
st(list_id, rn, chunk_no, s, e, score, g, ids, ds) AS (SELECT list_id, rn, 0, s, e, CAST(score AS DOUBLE), g, ids, ds FROM r WHERE rn = 1
UNION ALL SELECT r.list_id, r.rn, CASE WHEN st.e < r.s THEN st.chunk_no + 1 ELSE st.chunk_no END, CASE WHEN st.e < r.s THEN r.s ELSE st.s END, CASE WHEN st.e < r.s THEN r.e WHEN st.e >= r.e THEN st.e ELSE r.e END,
  CASE WHEN st.e < r.s THEN r.score WHEN st.e >= r.e THEN st.score ELSE st.score + r.score END, CASE WHEN st.e < r.s THEN r.g WHEN st.e >= r.e THEN st.g ELSE greatest(st.g, r.g) END, CASE WHEN st.e < r.s THEN r.ids WHEN st.e >= r.e THEN st.ids ELSE list_concat(st.ids, r.ids) END,
  CASE WHEN st.e < r.s THEN r.ds WHEN st.e >= r.e THEN st.ds WHEN st.e > r.s THEN list_concat(st.ds, CASE WHEN coalesce(list_position(list_transform(r.ds, lambda x: x >= st.e), TRUE), 0) > 0 THEN r.ds[list_position(list_transform(r.ds, lambda x: x >= st.e), TRUE):] ELSE [] END) ELSE list_concat(st.ds, r.ds) END
  FROM st JOIN r ON r.list_id = st.list_id AND r.rn = st.rn + 1)
SELECT list_id, chunk_no, s, e, round(score, 6) AS score, CAST(g AS INT) AS generation, array_to_string(ids, ',') AS event_ids, len(ds) AS n_data FROM (SELECT *, row_number() OVER (PARTITION BY list_id, chunk_no ORDER BY rn DESC) AS z FROM st) WHERE z = 1"""


def _act_sql(forward: bool) -> str:
    other, put = ("p", lambda a, x: f"list_concat([{x}], {a})") if forward else ("n", lambda a, x: f"list_concat({a}, [{x}])")
    return f"""WITH RECURSIVE {_LC}, {PN}, kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, s) AS q, count(*) OVER (PARTITION BY list_id) AS c FROM lc) WHERE q <= c - CAST(floor(c * 0.2) AS BIGINT)),
pv AS (SELECT store_no, event_id, arg_min(s, pos) AS s, arg_min(e, pos) AS e FROM ev GROUP BY ALL), nb AS (SELECT store_no, event_id, o AS other FROM (SELECT ev.store_no, ev.event_id, x.{other} AS o, row_number() OVER (PARTITION BY ev.store_no, ev.event_id ORDER BY ev.pos) AS z FROM ev JOIN px2 x ON x.store_no = ev.store_no AND x.pos = ev.pos) WHERE z = 1 AND o IS NOT NULL),
ac AS (SELECT kp.list_id, kp.s AS os, kp.e AS oe, kp.score, kp.g, CASE WHEN pv.s IS NULL THEN [kp.event_id] ELSE {put('[kp.event_id]', 'nb.other')} END AS ids, CASE WHEN pv.s IS NULL THEN [kp.s] ELSE {put('[kp.s]', 'pv.s')} END AS ds, CASE WHEN pv.s IS NULL THEN [kp.e] ELSE {put('[kp.e]', 'pv.e')} END AS de
  FROM kp LEFT JOIN nb ON nb.store_no = kp.store_no AND nb.event_id = kp.event_id LEFT JOIN pv ON pv.store_no = nb.store_no AND pv.event_id = nb.other), a2 AS (SELECT list_id, ds[1] AS s, de[len(de)] AS e, score, g, ids, ds FROM ac), {_fold_sql('a2')}""".replace(f"{PN}, ", "px2 AS (SELECT store_no, pos, lag(event_id) OVER w AS p, lead(event_id) OVER w AS n FROM ev WINDOW w AS (PARTITION BY store_no ORDER BY pos)), ")


@R.query("event_list_merge_fold", f"WITH RECURSIVE {_LC}, l2 AS (SELECT list_id, s, e, score, g, [event_id] AS ids, [s] AS ds FROM lc), {_fold_sql('l2')}")
def event_list_merge_fold(spark, sf):
    """Ordered merge of each list."""
    m = L.merge_adjacent(chunk_lists(spark, sf))
    return m.select("list_id", "chunk_no", "s", "e", F.round("score", 6).alias("score"), "generation", F.array_join("event_ids", ",").alias("event_ids"), F.size("data_s").alias("n_data"))


@R.query("event_list_drop", f"WITH {_CL} SELECT list_id, s FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, s) AS r, count(*) OVER (PARTITION BY list_id) AS n FROM lst) WHERE r <= n - CAST(floor(n * 0.2) AS BIGINT)")
def event_list_drop(spark, sf):
    """Without the fifth of lowest score."""
    return L.drop_lowest(chunk_lists(spark, sf), 0.2).select("list_id", "s")


@R.query("event_list_cap", f"WITH {_CL} SELECT list_id, s FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, s) AS r FROM lst) WHERE r <= 16")
def event_list_cap(spark, sf):
    """The 16 best chunks."""
    return L.drop_lowest(chunk_lists(spark, sf)).select("list_id", "s")


@R.query("event_list_context", f"""WITH {_CL}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, s) AS r, count(*) OVER (PARTITION BY list_id) AS n FROM lst) WHERE r <= CAST(floor(n * 0.75) AS BIGINT))
SELECT list_id, string_agg(event_id, ',' ORDER BY s, event_id) AS ids, count(*) AS n FROM k GROUP BY list_id""")
def event_list_context(spark, sf):
    """T4: context of the best three quarters, in order of start."""
    c = L.context(chunk_lists(spark, sf))
    return c.select("list_id", F.array_join(F.transform(F.split("information", "\n"), lambda x: F.substring_index(x, " ", -1)), ",").alias("ids"), "n")


@R.query("event_list_insert", f"WITH {_CL} SELECT list_id, s FROM lst UNION SELECT list_id, s + 10000 FROM lst")
def event_list_insert(spark, sf):
    """Chunks that are not in the list yet are added, others are not."""
    c = chunk_lists(spark, sf)
    again = c.unionByName(c.withColumn("s", F.col("s") + 10000))
    return L.insert(c, again).select("list_id", "s").distinct()


def _action(spark, sf, forward: bool):
    """F or B: drop the fifth of lowest score, put the event before (F) or after (B) to each chunk, merge."""
    ev = events(spark, sf).groupBy("store_no", "event_id").agg(F.min_by(F.struct("pos", "s", "e"), "pos").alias("x"))
    pn = prev_next(events(spark, sf).select("store_no", "pos", "event_id"), "store_no", "pos", "event_id").groupBy("store_no", "event_id").agg(F.min_by("prev_event_id" if forward else "next_event_id", "pos").alias("other"))
    near = pn.join(ev.select("store_no", F.col("event_id").alias("other"), F.col("x.s").alias("os"), F.col("x.e").alias("oe")), ["store_no", "other"])
    near = near.select(F.col("store_no").cast("string").alias("_store"), F.col("event_id").alias("_end"), F.col("other").alias("near_id"), "os", "oe")
    return L.act(chunk_lists(spark, sf), near, forward)


@R.query("event_list_forward", _act_sql(True))
def event_list_forward(spark, sf):
    """T5 (F): each list without its weakest fifth, the event before each chunk put to it, merged."""
    return _list_rows(_action(spark, sf, True))


@R.query("event_list_backward", _act_sql(False))
def event_list_backward(spark, sf):
    """T5 (B): the same with the event after each chunk."""
    return _list_rows(_action(spark, sf, False))


def _list_rows(m):
    return m.select("list_id", "chunk_no", "s", "e", F.round("score", 6).alias("score"), "generation", F.array_join("event_ids", ",").alias("event_ids"), F.size("data_s").alias("n_data"))


@R.query("event_list_requery", f"""WITH {_CL}, nw AS (SELECT DISTINCT lst.list_id, sd.s, sd.event_id FROM lst JOIN sd ON lst.list_id = sd.store_no || ':' || ((sd.question_id + 1))),
al AS (SELECT list_id, s, 0 AS fresh FROM lst UNION ALL SELECT DISTINCT nw.list_id, nw.s, 1 FROM nw WHERE NOT EXISTS (SELECT 1 FROM lst WHERE lst.list_id = nw.list_id AND lst.s = nw.s))
SELECT list_id, s, fresh FROM al""")
def event_list_requery(spark, sf):
    """A sub-query (here the question before) is answered and its events put into the list, those already
    there left out, in the next generation."""
    base = chunk_lists(spark, sf)
    sub = seeds(spark, sf).groupBy("store_no", "question_id", "s").agg(F.min("event_id").alias("event_id"), F.min("e").alias("e"), F.max("score").alias("score"))
    sub = sub.select(F.concat_ws(":", "store_no", (F.col("question_id") + 1).cast("string")).alias("list_id"), "s", "e", F.coalesce("score", F.lit(1.0)).alias("score"), "event_id").join(base.select("list_id").distinct(), "list_id", "left_semi")
    out = L.requery(base, sub)
    return out.select("list_id", "s", F.col("fresh").cast("int").alias("fresh")).distinct()


@R.query("event_list_merge_lists", f"""WITH {_CL}, k AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, s) AS r, count(*) OVER (PARTITION BY list_id) AS n FROM lst), d AS (SELECT * FROM k WHERE r <= n - CAST(floor(n * 0.5) AS BIGINT)),
u AS (SELECT DISTINCT split_part(list_id, ':', 1) AS store, event_id FROM d), p AS (SELECT CAST(store_no AS VARCHAR) AS store, event_id, arg_min(s, pos) AS s, arg_min(e, pos) AS e FROM ev GROUP BY ALL)
SELECT u.store AS list_id, u.event_id, p.s, p.e, 0.0 AS score FROM u JOIN p ON p.store = u.store AND p.event_id = u.event_id""")
def event_list_merge_lists(spark, sf):
    """The better half of all lists of a store put together: distinct events at score 0, at most 1,000 by start."""
    spans = events(spark, sf).groupBy("store_no", "event_id").agg(F.min_by(F.struct("s", "e"), "pos").alias("x")).select(F.col("store_no").cast("string").alias("group_id"), "event_id", "x.s", "x.e")
    lists = chunk_lists(spark, sf).withColumn("group_id", F.substring_index("list_id", ":", 1))
    m = L.merge_lists(lists, spans, 0.5)
    return m.select(F.col("group_id").alias("list_id"), "event_id", "s", "e", "score")


@R.query("event_list_add_neighbour", f"""WITH {SD}, {TOP}, {FB} SELECT DISTINCT t.store_no, t.question_id, t.event_id, pn.p AS before_id FROM top t JOIN pn ON pn.store_no = t.store_no AND pn.event_id = t.event_id""")
def event_list_add_neighbour(spark, sf):
    """T5 (neighbour alone): the event before each seed, in storage order."""
    pn = prev_next(events(spark, sf).select("store_no", "pos", "event_id"), "store_no", "pos", "event_id")
    return top_seeds(spark, sf).select(*_VK).join(pn, ["store_no", "event_id"]).select(*_VK, F.col("prev_event_id").alias("before_id")).distinct()


@R.query("search_tree_leaves", """WITH a AS (SELECT unnest(['RQ', 'F', 'B']) AS x), l1 AS (SELECT 'SA' AS path, 1 AS depth), l2 AS (SELECT x || '>SA', 2 FROM a), l3 AS (SELECT a.x || '>' || b.x || '>SA', 3 FROM a, a b) SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3""")
def search_tree_leaves(spark, sf):
    """The 13 answer leaves of the depth-3 search."""
    return L.search_paths(spark, 3)
