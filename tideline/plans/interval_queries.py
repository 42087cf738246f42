"""Queries of interval, ordering and seed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.intervals import holds_closed, hull_iou, overlaps_closed, overlaps_strict
from tideline.operators import intervals as I
from tideline.operators import seeds as S
from tideline.operators.ordering import prev_next
from tideline.plans.base import BR, EV, GT, SD, bridge, events, seeds, truth
from tideline.registry import Registry

R = Registry()


def _ev_side(spark, sf):
    return events(spark, sf).select("store_no", "pos", F.col("s").alias("ls"), F.col("e").alias("le"))


def _gt_side(spark, sf):
    return truth(spark, sf).select("store_no", "seg", F.col("gs").cast("double").alias("rs"), F.col("ge").cast("double").alias("re"))


@R.query("interval_overlap_closed", f"""WITH {EV}, {GT}
SELECT ev.store_no, ev.pos, gt.seg FROM ev JOIN gt ON ev.store_no = gt.store_no AND ev.s <= gt.ge AND ev.e >= gt.gs""")
def interval_overlap_closed(spark, sf):
    """Events that overlap a segment, ends included."""
    return I.overlap_join(_ev_side(spark, sf), _gt_side(spark, sf), ["store_no"], overlaps_closed).select("store_no", "pos", "seg")


@R.query("interval_overlap_events", f"""WITH {EV}, {GT}
SELECT DISTINCT ev.store_no, ev.pos FROM ev JOIN gt ON ev.store_no = gt.store_no AND NOT (ev.e < gt.gs OR ev.s > gt.ge)""")
def interval_overlap_events(spark, sf):
    """Distinct events of the segments."""
    return I.overlap_join(_ev_side(spark, sf), _gt_side(spark, sf), ["store_no"], overlaps_closed).select("store_no", "pos").distinct()


@R.query("interval_overlap_strict_semi", f"""WITH {EV}, {GT}
SELECT store_no, pos FROM ev WHERE EXISTS (SELECT 1 FROM gt WHERE gt.store_no = ev.store_no AND greatest(ev.s, gt.gs) < least(ev.e, gt.ge))""")
def interval_overlap_strict_semi(spark, sf):
    """Events that share more than a point with a segment."""
    return I.overlap_join(_ev_side(spark, sf), _gt_side(spark, sf), ["store_no"], overlaps_strict).select("store_no", "pos").distinct()


@R.query("point_in_first_interval", f"""WITH {EV}, {GT}
SELECT gt.store_no, gt.seg, min(ev.pos) AS first_pos FROM gt JOIN ev ON ev.store_no = gt.store_no AND ev.s <= gt.gs + 5 AND gt.gs + 5 <= ev.e GROUP BY gt.store_no, gt.seg""")
def point_in_first_interval(spark, sf):
    """I4: the first event, in storage order, that holds a point (ends included)."""
    points = truth(spark, sf).select("store_no", "seg", (F.col("gs") + 5).cast("double").alias("rs"), (F.col("gs") + 5).cast("double").alias("re"))
    met = I.overlap_join(_ev_side(spark, sf), points, ["store_no"], lambda s, e, t, _: holds_closed(s, e, t))
    return met.groupBy("store_no", "seg").agg(F.min("pos").alias("first_pos"))


def _ms(spark, sf):
    return events(spark, sf).select("store_no", "pos", "event_id", F.col("ms").alias("s"), F.col("me").alias("e"))


def _islands(gap: int, extra: str = "") -> str:
    return f"""WITH {EV}, fl AS (
  SELECT store_no, pos, ms, me, max(me) OVER (PARTITION BY store_no ORDER BY ms, me, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev WHERE me > ms OR {gap} > 0
), isl AS (
  SELECT store_no, pos, ms, me, sum(CASE WHEN top IS NULL OR ms > top + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY store_no ORDER BY ms, me, pos ROWS UNBOUNDED PRECEDING) AS g FROM fl
), m AS (SELECT store_no, g, min(ms) AS s, max(me) AS e FROM isl GROUP BY store_no, g){extra}
"""


@R.query("interval_union", _islands(0) + "SELECT store_no, s, e FROM m")
def interval_union(spark, sf):
    """Overlapping and touching spans merged."""
    return I.merged(_ms(spark, sf), "store_no").select("store_no", "s", "e")


@R.query("interval_merge_gap", _islands(30000) + "SELECT store_no, s, e FROM m")
def interval_merge_gap(spark, sf):
    """Spans at most 30 s apart merged."""
    return I.merged(_ms(spark, sf), "store_no", 30_000).select("store_no", "s", "e")


@R.query("interval_merge_gap_session", _islands(30000) + "SELECT store_no, s, e FROM m")
def interval_merge_gap_session(spark, sf):
    """I6 by session windows with a dynamic gap, the form that also runs on a stream."""
    rows = _ms(spark, sf).select("store_no", F.timestamp_millis("s").alias("ts"), F.concat((F.col("e") - F.col("s") + 30_001).cast("string"), F.lit(" milliseconds")).alias("gap"))
    got = rows.groupBy("store_no", F.session_window("ts", F.col("gap")).alias("w")).count()
    return got.select("store_no", F.unix_millis("w.start").alias("s"), (F.unix_millis("w.end") - 30_001).alias("e"))


@R.query("interval_cluster_members", _islands(30000) + "SELECT isl.store_no, isl.pos, m.s AS cluster_s, m.e AS cluster_e FROM isl JOIN m ON isl.store_no = m.store_no AND isl.g = m.g")
def interval_cluster_members(spark, sf):
    """Each event with the cluster it belongs to."""
    return I.clusters(_ms(spark, sf), "store_no", 30_000, 64_000).select("store_no", "pos", "cluster_s", "cluster_e")


@R.query("interval_cluster_boundary", _islands(30000, """, b AS (SELECT isl.store_no, m.s AS cluster_s, first(isl.pos ORDER BY isl.ms, isl.pos) AS first_pos, first(isl.pos ORDER BY isl.me DESC, isl.pos) AS last_pos FROM isl JOIN m ON isl.store_no = m.store_no AND isl.g = m.g GROUP BY ALL)""") + "SELECT * FROM b")
def interval_cluster_boundary(spark, sf):
    """The events with the earliest start and the latest end of each cluster."""
    rows = I.clusters(_ms(spark, sf), "store_no", 30_000, 64_000)
    return rows.groupBy("store_no", "cluster_s").agg(F.min_by("pos", F.struct("s", "pos")).alias("first_pos"), F.max_by("pos", F.struct("e", -F.col("pos"))).alias("last_pos"))


@R.query("interval_union_length", _islands(0) + "SELECT store_no, CAST(sum(e - s) AS BIGINT) AS length FROM m GROUP BY store_no")
def interval_union_length(spark, sf):
    """Length of the union."""
    return I.union_length(_ms(spark, sf), "store_no")


@R.query("interval_total_length", f"WITH {EV} SELECT store_no, CAST(sum(me - ms) AS BIGINT) AS length, count(*) AS spans FROM ev GROUP BY store_no")
def interval_total_length(spark, sf):
    """I16: plain sum of lengths."""
    return events(spark, sf).groupBy("store_no").agg(F.sum(F.col("me") - F.col("ms")).cast("bigint").alias("length"), F.count("*").alias("spans"))


_GT_UNION = """, gfl AS (
  SELECT store_no, gs * 1000 AS gs, ge * 1000 AS ge, max(ge * 1000) OVER (PARTITION BY store_no ORDER BY gs, ge, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM gt
), gisl AS (SELECT store_no, gs, ge, sum(CASE WHEN top IS NULL OR gs > top THEN 1 ELSE 0 END) OVER (PARTITION BY store_no ORDER BY gs, ge ROWS UNBOUNDED PRECEDING) AS g FROM gfl
), gm AS (SELECT store_no, g, min(gs) AS s, max(ge) AS e FROM gisl GROUP BY store_no, g)"""


def _gt_ms(spark, sf):
    return truth(spark, sf).select("store_no", (F.col("gs") * 1000).alias("s"), (F.col("ge") * 1000).alias("e"))


@R.query("interval_intersection_length", _islands(0, f", {GT}{_GT_UNION}") + """SELECT m.store_no, CAST(sum(least(m.e, gm.e) - greatest(m.s, gm.s)) AS BIGINT) AS shared
FROM m JOIN gm ON m.store_no = gm.store_no AND greatest(m.s, gm.s) < least(m.e, gm.e) GROUP BY m.store_no""")
def interval_intersection_length(spark, sf):
    """Shared length of two unions."""
    both = I.intersection(I.merged(_ms(spark, sf), "store_no"), I.merged(_gt_ms(spark, sf), "store_no"), "store_no", 64_000)
    return both.groupBy("store_no").agg(F.sum(F.col("e") - F.col("s")).cast("bigint").alias("shared"))


@R.query("interval_coverage", _islands(0, f", {GT}") + """SELECT gt.store_no, gt.seg, CASE WHEN gt.point OR gt.ge = gt.gs THEN CAST(bool_or(coalesce(m.s <= gt.gs * 1000 AND gt.gs * 1000 < m.e, FALSE)) AS INT) * 1.0
  ELSE round(least(1.0, coalesce(sum(CASE WHEN m.s IS NOT NULL THEN greatest(0, least(m.e, gt.ge * 1000) - greatest(m.s, gt.gs * 1000)) END), 0) / ((gt.ge - gt.gs) * 1000.0)), 6) END AS coverage
FROM gt LEFT JOIN m ON m.store_no = gt.store_no AND m.s <= gt.ge * 1000 AND m.e >= gt.gs * 1000 GROUP BY gt.store_no, gt.seg, gt.gs, gt.ge, gt.point""")
def interval_coverage(spark, sf):
    """Share of each segment that the events cover; a point is covered (1) or not (0), its end left out (C4)."""
    return I.coverage(I.merged(_ms(spark, sf), "store_no"), _ref_ms(spark, sf), "store_no", 64_000).select("store_no", "seg", F.round("coverage", 6).alias("coverage"))


def _ref_ms(spark, sf):
    """References in milliseconds: a point stays a point, as does a range of equal ends."""
    return truth(spark, sf).select("store_no", "question_id", "seg", (F.col("gs") * 1000).alias("s"), F.when(F.col("point"), F.col("gs") * 1000).otherwise(F.col("ge") * 1000).alias("e"))


@R.query("interval_list_coverage", _islands(0, f", {GT}") + """SELECT store_no, round(coalesce(sum(shared) / sum(length), 0), 6) AS coverage FROM (
  SELECT gt.store_no, gt.seg, (gt.ge - gt.gs) * 1000.0 AS length, coalesce(sum(CASE WHEN m.s IS NOT NULL THEN greatest(0, least(m.e, gt.ge * 1000) - greatest(m.s, gt.gs * 1000)) END), 0) AS shared FROM gt LEFT JOIN m ON m.store_no = gt.store_no AND m.s <= gt.ge * 1000 AND m.e >= gt.gs * 1000
  WHERE NOT gt.point AND gt.ge > gt.gs GROUP BY gt.store_no, gt.seg, gt.gs, gt.ge) GROUP BY store_no""")
def interval_list_coverage(spark, sf):
    """Coverage of the list of a store's segments by its events, weighted by length."""
    ref = _ref_ms(spark, sf).where("e > s").withColumn("len", F.col("e") - F.col("s"))
    c = I.coverage(I.merged(_ms(spark, sf), "store_no"), ref, "store_no", 64_000)
    return c.groupBy("store_no").agg(F.round(F.sum(F.col("coverage") * F.col("len")) / F.sum("len"), 6).alias("coverage"))


_HIT = "(CASE WHEN gt.point OR gt.ge = gt.gs THEN ev.s <= gt.gs AND gt.gs < ev.e ELSE greatest(ev.s, gt.gs) < least(ev.e, gt.ge) END)"


@R.query("interval_hit_gt", f"""WITH {EV}, {GT}
SELECT gt.store_no, gt.question_id, bool_or(ev.pos IS NOT NULL) AS hit FROM gt LEFT JOIN ev ON ev.store_no = gt.store_no AND {_HIT} GROUP BY gt.store_no, gt.question_id""")
def interval_hit_gt(spark, sf):
    """Whether any event hits any segment of the question; a point is hit from the start of an event
    to before its end (C4), a range by more than a point (C3)."""
    gt = truth(spark, sf)
    ref = gt.select("store_no", "seg", F.col("gs").cast("double").alias("rs"), F.when(F.col("point"), F.col("gs")).otherwise(F.col("ge")).cast("double").alias("re"))
    met = I.overlap_join(_ev_side(spark, sf), ref, ["store_no"], I.hits_reference).select("store_no", "seg").distinct().withColumn("h", F.lit(True))
    return gt.join(met, ["store_no", "seg"], "left").groupBy("store_no", "question_id").agg(F.coalesce(F.bool_or("h"), F.lit(False)).alias("hit"))


@R.query("interval_hull_iou", f"""WITH {EV}, {GT}
SELECT ev.store_no, ev.pos, gt.seg, round(greatest(0.0, least(ev.e, gt.ge) - greatest(ev.s, gt.gs)) / greatest(1e-9, greatest(ev.e, gt.ge) - least(ev.s, gt.gs)), 6) AS iou
FROM ev JOIN gt ON ev.store_no = gt.store_no AND greatest(ev.s, gt.gs) < least(ev.e, gt.ge)""")
def interval_hull_iou(spark, sf):
    """Shared length over hull length."""
    met = I.overlap_join(_ev_side(spark, sf), _gt_side(spark, sf), ["store_no"], overlaps_strict)
    return met.select("store_no", "pos", "seg", F.round(hull_iou(F.col("ls"), F.col("le"), F.col("rs"), F.col("re")), 6).alias("iou"))


@R.query("interval_best_cache_match", f"""WITH {EV}, {GT}, c AS (
  SELECT gt.store_no, gt.seg, ev.pos, (least(ev.e, gt.ge) - greatest(ev.s, gt.gs)) / greatest(1e-9, greatest(ev.e, gt.ge) - least(ev.s, gt.gs)) AS iou
  FROM ev JOIN gt ON ev.store_no = gt.store_no AND greatest(ev.s, gt.gs) < least(ev.e, gt.ge))
SELECT store_no, seg, pos AS cache_pos, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY store_no, seg ORDER BY round(iou, 9) DESC, pos) AS rn FROM c) WHERE rn = 1""")
def interval_best_cache_match(spark, sf):
    """The entry of highest hull IoU for each segment, the earlier one on ties, none at 0."""
    met = I.overlap_join(_ev_side(spark, sf), _gt_side(spark, sf), ["store_no"], overlaps_strict)
    met = met.select("store_no", "seg", "pos", hull_iou(F.col("ls"), F.col("le"), F.col("rs"), F.col("re")).alias("iou"))
    best = met.groupBy("store_no", "seg").agg(F.max_by(F.struct("pos", "iou"), F.struct(F.round("iou", 9), -F.col("pos"))).alias("b"))
    return best.select("store_no", "seg", F.col("b.pos").alias("cache_pos"), F.round("b.iou", 6).alias("iou"))


@R.query("chunks_fixed", """WITH v AS (SELECT store_no, duration AS d FROM video_stores WHERE duration > 0)
SELECT store_no, i AS chunk_no, CAST(i * 3 AS DOUBLE) AS s, round(least(i * 3.0 + 3.0, d), 6) AS e FROM (SELECT store_no, d, unnest(range(CAST(ceil(d / 3.0) AS BIGINT))) AS i FROM v)""")
def chunks_fixed(spark, sf):
    """Timelines cut into chunks of 3 s, the last one clipped."""
    from tideline.sources.tables import table

    v = table(spark, sf, "video_stores").where("duration > 0").select("store_no", F.col("duration").alias("d"))
    n = F.ceil(F.col("d") / 3.0)
    c = v.select("store_no", "d", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_no"))
    return c.select("store_no", "chunk_no", (F.col("chunk_no") * 3).cast("double").alias("s"), F.round(F.least(F.col("chunk_no") * 3.0 + 3.0, F.col("d")), 6).alias("e"))


@R.query("chunks_overlap", """WITH v AS (SELECT store_no, duration AS d FROM video_stores WHERE duration > 0)
SELECT store_no, i AS chunk_no, CAST(i * 20 AS DOUBLE) AS s, round(least(i * 20.0 + 30.0, d), 6) AS e FROM (SELECT store_no, d, unnest(range(greatest(1, CAST(ceil((d - 30.0) / 20.0) AS BIGINT) + 1))) AS i FROM v)""")
def chunks_overlap(spark, sf):
    """Chunks of 30 s that share 10 s; the first clipped chunk is the last."""
    from tideline.sources.tables import table

    v = table(spark, sf, "video_stores").where("duration > 0").select("store_no", F.col("duration").alias("d"))
    n = F.greatest(F.lit(1), F.ceil((F.col("d") - 30.0) / 20.0) + 1)
    c = v.select("store_no", "d", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_no"))
    return c.select("store_no", "chunk_no", (F.col("chunk_no") * 20).cast("double").alias("s"), F.round(F.least(F.col("chunk_no") * 20.0 + 30.0, F.col("d")), 6).alias("e"))


# --- order and seeds -------------------------------------------------------------------------


@R.query("order_prev_next", f"""WITH {EV} SELECT store_no, pos, lag(pos) OVER w AS prev_pos, lead(pos) OVER w AS next_pos FROM ev WINDOW w AS (PARTITION BY store_no ORDER BY pos)""")
def order_prev_next(spark, sf):
    """V7: previous and next event in storage order."""
    rows = events(spark, sf).select("store_no", "pos", F.col("pos").alias("p"))
    return prev_next(rows, "store_no", "pos", "p").select("store_no", "pos", F.col("prev_p").alias("prev_pos"), F.col("next_p").alias("next_pos"))


_FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, event_id ORDER BY ord) AS r1 FROM sd) WHERE r1 = 1)"
_FIRST_SCORED = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, event_id ORDER BY ord) AS r1 FROM sd WHERE score IS NOT NULL) WHERE r1 = 1)"


def _ranked(order: str, k: int) -> str:
    return f"SELECT store_no, question_id, event_id, rnk FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY {order}) AS rnk FROM f) WHERE rnk <= {k}"


def _out(df):
    return df.select("store_no", "question_id", "event_id", F.col("rnk").cast("bigint").alias("rnk"))


@R.query("seeds_topk_nulls_first", f"WITH {SD}, {_FIRST} " + _ranked("score DESC NULLS FIRST, ord", 30))
def seeds_topk_nulls_first(spark, sf):
    """K1: top 30 of each query, time matches first."""
    return _out(S.topk_nulls_first(seeds(spark, sf), 30))


@R.query("seeds_topk_scored", f"WITH {SD}, {_FIRST_SCORED} " + _ranked("score DESC, ord", 20))
def seeds_topk_scored(spark, sf):
    """K2/K5: top 20 scored seeds."""
    return _out(S.topk_scored(seeds(spark, sf), 20))


@R.query("seeds_topk_fill", f"""WITH {SD}, {_FIRST}, b AS (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY coalesce(score, 1000000.0) DESC, s, ord) AS rnk FROM f)
SELECT store_no, question_id, event_id, row_number() OVER (PARTITION BY store_no, question_id ORDER BY s, ord) AS place FROM b WHERE rnk <= 10""")
def seeds_topk_fill(spark, sf):
    """K3/K4: top 10 with null as a million, in order of start."""
    return S.topk_fill(seeds(spark, sf), 10).select("store_no", "question_id", "event_id", F.col("place").cast("bigint").alias("place"))


@R.query("seeds_temporal_only", f"WITH {SD} SELECT DISTINCT store_no, question_id, event_id FROM sd WHERE score IS NULL")
def seeds_temporal_only(spark, sf):
    """K6: seeds of time matches."""
    return S.temporal_only(seeds(spark, sf))


@R.query("seeds_temporal_log", f"WITH {EV}, {GT} SELECT DISTINCT gt.store_no, gt.question_id, ev.event_id FROM gt JOIN ev ON ev.store_no = gt.store_no AND floor(ev.s) <= gt.ge AND floor(ev.e) >= gt.gs")
def seeds_temporal_log(spark, sf):
    """The log of time matches (per question its segments, per segment the events that overlap it in
    whole seconds, ends included) read back as the set of event ids of each question."""
    g = truth(spark, sf).select("store_no", "question_id", "seg", F.col("gs").alias("rs"), F.col("ge").alias("re"))
    e = events(spark, sf).select("store_no", "event_id", F.floor("s").alias("ls"), F.floor("e").alias("le"))
    log = I.overlap_join(e, g, ["store_no"], overlaps_closed).groupBy("store_no", "question_id", "seg").agg(F.collect_list("event_id").alias("events_retrieved"))
    return log.select("store_no", "question_id", F.explode("events_retrieved").alias("event_id")).distinct()


@R.query("seeds_emb_only", f"""WITH {SD}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, event_id ORDER BY ord) AS r1 FROM sd WHERE score IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM sd t WHERE t.score IS NULL AND t.store_no = sd.store_no AND t.question_id = sd.question_id AND t.event_id = sd.event_id)) WHERE r1 = 1) """ + _ranked("score DESC, ord", 10))
def seeds_emb_only(spark, sf):
    """K7: scored seeds that no time match names."""
    return _out(S.embedding_only(seeds(spark, sf), 10))


@R.query("seeds_base_temporal", f"WITH {SD}, {_FIRST_SCORED}, b AS (" + _ranked("score DESC, ord", 10) + ") SELECT store_no, question_id, event_id FROM b UNION SELECT store_no, question_id, event_id FROM sd WHERE score IS NULL")
def seeds_base_temporal(spark, sf):
    """K8/C-9: top scored seeds and time matches."""
    return S.base_and_temporal(seeds(spark, sf), 10)


_CAP = f"""WITH {SD}, {_FIRST}, top AS ({_ranked("score DESC NULLS FIRST, ord", 12)}),
pn AS (SELECT store_no, event_id, lag(event_id) OVER w AS p, lead(event_id) OVER w AS n FROM ev WINDOW w AS (PARTITION BY store_no ORDER BY pos)),
x AS (SELECT DISTINCT t.store_no, t.question_id, u.e AS event_id FROM top t JOIN pn ON pn.store_no = t.store_no AND pn.event_id = t.event_id, LATERAL (SELECT pn.p AS e UNION ALL SELECT pn.n) u WHERE u.e IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM top z WHERE z.store_no = t.store_no AND z.question_id = t.question_id AND z.event_id = u.e)),
a AS (SELECT store_no, question_id, event_id, 0 AS extra, rnk AS place FROM top UNION ALL SELECT store_no, question_id, event_id, 1, 0 FROM x)
SELECT store_no, question_id, event_id, extra, slot FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY extra, place, event_id) AS slot FROM a) WHERE slot <= 16"""


def temporal_neighbours(spark, sf, top):
    """Previous and next events of seeds, one row per (query, neighbour)."""
    around = prev_next(events(spark, sf).select("store_no", "pos", "event_id"), "store_no", "pos", "event_id")
    pairs = top.select("store_no", "question_id", "event_id").join(around, ["store_no", "event_id"])
    near = pairs.select("store_no", "question_id", F.explode(F.array("prev_event_id", "next_event_id")).alias("event_id"))
    return near.where("event_id is not null").distinct()


@R.query("seeds_budget_cap", _CAP)
def seeds_budget_cap(spark, sf):
    """Seeds, then their temporal neighbours by id, 16 in all."""
    top = S.topk_nulls_first(seeds(spark, sf), 12)
    got = S.budget_cap(top, temporal_neighbours(spark, sf, top), 16)
    return got.select("store_no", "question_id", "event_id", "extra", F.col("slot").cast("bigint").alias("slot"))


@R.query("seeds_uniform_sample", f"""WITH {EV}, n AS (SELECT store_no, pos, row_number() OVER (PARTITION BY store_no ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY store_no) AS n FROM ev),
k AS (SELECT unnest(range(12)) AS i)
SELECT DISTINCT store_no, pos FROM n WHERE n.n <= 12 OR EXISTS (SELECT 1 FROM k WHERE (k.i * n.n) // 12 = n.r)""")
def seeds_uniform_sample(spark, sf):
    """12 evenly spread events of each store."""
    return S.uniform_sample(events(spark, sf).select("store_no", "pos"), "store_no", "pos", 12).select("store_no", "pos")


@R.query("seeds_null_count_top10", f"WITH {SD} SELECT store_no, question_id, count(*) FILTER (score IS NULL) AS nulls FROM sd GROUP BY ALL ORDER BY nulls DESC, store_no, question_id LIMIT 10")
def seeds_null_count_top10(spark, sf):
    """The ten queries with the most time matches."""
    n = seeds(spark, sf).groupBy("store_no", "question_id").agg(F.count_if(F.col("score").isNull()).alias("nulls"))
    return n.orderBy(F.desc("nulls"), "store_no", "question_id").limit(10)


@R.query("seeds_filter_allowed", f"""WITH {SD}, {BR}, a AS (SELECT DISTINCT event_id FROM br), {_FIRST.replace("FROM sd)", "FROM sd WHERE event_id IN (SELECT event_id FROM a))")}
SELECT store_no, question_id, event_id, ord FROM f""")
def seeds_filter_allowed(spark, sf):
    """K9: seed rows of an allowed id set (events with an entity), the first of each id."""
    allowed = bridge(spark, sf).select("event_id").distinct()
    return S.first_per_event(seeds(spark, sf).join(allowed, "event_id", "left_semi")).select("store_no", "question_id", "event_id", "ord")
