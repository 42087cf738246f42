"""Queries of vector search and rank fusion. Search queries are the vectors whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.intervals import holds_closed
from tideline.operators import fusion as B
from tideline.operators import vector as V
from tideline.operators.intervals import overlap_join
from tideline.plans.base import BR, EV, GT, SD, VEC, bridge, events, seeds, truth, vectors
from tideline.registry import Registry
from tideline.session import checkpointed
from tideline.sources.tables import table

R = Registry()

QS = "qs AS (SELECT vec_id AS qid, v AS qv FROM vec WHERE vec_id % 50 = 0)"


def _hits(name: str, k: int, where: str = "TRUE", least: str = "TRUE", sim: str = "list_cosine_similarity(qv, v)") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT qid, vec_id, store_no, vec_kind, owner_id, sim, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, vec_id) AS rnk
  FROM (SELECT qid, vec_id, store_no, vec_kind, owner_id, {sim} AS sim FROM qs, vec WHERE {where}) WHERE {least}) WHERE rnk <= {k})"""


def _queries(vec):
    return vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "v")


def _found(spark, sf, k, where=None, **kw):
    vec = vectors(spark, sf)
    hits = V.search(vec.where(where) if where else vec, _queries(vec), k, **kw)
    return hits.join(vec.drop("v"), "vec_id")


def _scores(df):
    return df.select("qid", "vec_id", F.round("sim", 6).alias("sim"), F.col("rnk").cast("bigint").alias("rnk"))


_OUT = "SELECT qid, vec_id, round(sim, 6) AS sim, rnk FROM h"


@R.query("vector_normalize", f"WITH {VEC} SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS x0, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM vec")
def vector_normalize(spark, sf):
    """V1: length and direction of every usable vector."""
    return vectors(spark, sf).select("vec_id", F.round(F.get(V.normalised(F.col("v")), F.lit(0)), 6).alias("x0"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@R.query("vector_topk_threshold", f"WITH {VEC}, {QS}, {_hits('h', 20, least='sim >= 0.1')} {_OUT}")
def vector_topk_threshold(spark, sf):
    """V2: cosine top 20 with a threshold of 0.1."""
    return _scores(_found(spark, sf, 20, least=0.1))


@R.query("vector_batch_topk", f"WITH {VEC}, {QS}, {_hits('h', 10)} {_OUT}")
def vector_batch_topk(spark, sf):
    """V3: top 10 of every query."""
    return _scores(_found(spark, sf, 10))


def _kind_hits(kind: str, k: int) -> str:
    return _hits("h", k, f"vec_kind = '{kind}'")


@R.query("vector_topk_filtered", f"WITH {VEC}, {QS}, {_hits('h', 5, "vec_kind IN ('event', 'frame')")} {_OUT}")
def vector_topk_filtered(spark, sf):
    """V9: top 5 among the rows of a predicate, which is applied before the search."""
    return _scores(_found(spark, sf, 5, "vec_kind in ('event', 'frame')"))


@R.query("vector_events_top80", f"WITH {VEC}, {QS}, {_kind_hits('event', 80)} {_OUT}")
def vector_events_top80(spark, sf):
    """Event baseline, top 80."""
    return _scores(_found(spark, sf, 80, "vec_kind = 'event'"))


@R.query("vector_ip_live_after_cut", f"WITH {VEC}, {QS}, {_hits('h', 10, sim='list_inner_product(qv, v)')} {_OUT} WHERE vec_id IN (SELECT vec_id FROM vec WHERE vec_kind <> 'entity')")
def vector_ip_live_after_cut(spark, sf):
    """V8: inner-product top 10; rows whose metadata was deleted drop out after the cut."""
    hits = _found(spark, sf, 10, metric="ip")
    live = vectors(spark, sf).where("vec_kind <> 'entity'").select("vec_id")
    return _scores(hits.join(live, "vec_id", "left_semi"))


_EPS = "list_inner_product(qv, v) / ((sqrt(list_inner_product(qv, qv)) + 1e-8) * (sqrt(list_inner_product(v, v)) + 1e-8))"


@R.query("vector_pairwise_cosine_eps", f"WITH {VEC}, {QS}, {_hits('h', 3, sim=_EPS)} {_OUT}")
def vector_pairwise_cosine_eps(spark, sf):
    """Cosine with a small constant on the norms, top 3 of each query."""
    return _scores(_found(spark, sf, 3, eps=1e-8))


@R.query("vector_pair_similarity", f"WITH {VEC} SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1")
def vector_pair_similarity(spark, sf):
    """Similarity of given pairs (a vector and the next id)."""
    v = vectors(spark, sf)
    return v.select("vec_id", "v").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("sim"))


@R.query("vector_mean_content", f"""WITH {VEC}, u AS (SELECT store_no, vec_kind, vec_id, unnest(range(len(v))) AS p, unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS x FROM vec WHERE store_no IS NOT NULL),
m AS (SELECT store_no, vec_kind, p, avg(x) AS x, count(*) AS n FROM u GROUP BY ALL)
SELECT store_no, vec_kind, max(n) AS n, round(max(x) FILTER (p = 0) / sqrt(sum(x * x)), 6) AS x0, round(max(x) FILTER (p = 7) / sqrt(sum(x * x)), 6) AS x7 FROM m GROUP BY ALL""")
def vector_mean_content(spark, sf):
    """V5: mean vector of each store and kind, scaled to length 1."""
    m = V.mean_content(vectors(spark, sf).where("store_no is not null"), ["store_no", "vec_kind"])
    return m.select("store_no", "vec_kind", "n", F.round(F.get("v", F.lit(0)), 6).alias("x0"), F.round(F.get("v", F.lit(7)), 6).alias("x7"))


@R.query("vector_upsert", f"""WITH {VEC}, b AS (SELECT vec_id, owner_id, vec_kind FROM vec WHERE vec_kind IS NULL OR vec_kind <> 'frame'), c AS (SELECT vec_id, 'new-' || vec_id AS owner_id, vec_kind FROM vec WHERE vec_kind <> 'event')
SELECT coalesce(c.vec_id, b.vec_id) AS vec_id, CASE WHEN c.vec_id IS NULL THEN b.owner_id ELSE c.owner_id END AS owner_id, CASE WHEN c.vec_id IS NULL THEN b.vec_kind ELSE c.vec_kind END AS vec_kind,
CASE WHEN c.vec_id IS NULL THEN 'kept' WHEN b.vec_id IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM b FULL JOIN c ON b.vec_id = c.vec_id""")
def vector_upsert(spark, sf):
    """V4: update by id, insert what is new: event vectors are kept, frames are new, the other kinds are updated."""
    return _upserted(spark, sf, "vec_kind is null or vec_kind <> 'frame'", "vec_kind <> 'event'")


def _upserted(spark, sf, base, changes):
    v = vectors(spark, sf)
    return V.upsert(v.where(base), v.where(changes).withColumn("owner_id", F.concat(F.lit("new-"), F.col("vec_id").cast("string"))), "vec_id", ["owner_id", "vec_kind"])


@R.query("vector_get_delete_count", f"""WITH {VEC}, k AS (SELECT DISTINCT id AS owner_id FROM vdb_entities WHERE id IS NOT NULL)
SELECT vec_kind, count(*) AS n, count(*) FILTER (k.owner_id IS NOT NULL) AS got, count(*) FILTER (k.owner_id IS NULL) AS left_after_delete FROM vec LEFT JOIN k ON k.owner_id = vec.owner_id GROUP BY vec_kind""")
def vector_get_delete_count(spark, sf):
    """Get by ids, delete by ids, count."""
    v = vectors(spark, sf).drop("v")
    keys = table(spark, sf, "vdb_entities").where("id is not null").select(F.col("id").alias("owner_id")).distinct().withColumn("hit", F.lit(True))
    return v.join(keys, "owner_id", "left").groupBy("vec_kind").agg(F.count("*").alias("n"), F.count("hit").alias("got"), F.count_if(F.col("hit").isNull()).alias("left_after_delete"))


@R.query("vector_join_tracks", f"""WITH {VEC}, {QS}, {_hits('h', 5, "vec_kind IN ('entity', 'event')")}, {BR}, n AS (SELECT store_no, entity_id, count(*) AS n_events FROM br GROUP BY ALL)
SELECT h.qid, h.vec_id, round(h.sim, 6) AS sim, n.n_events FROM h LEFT JOIN n ON n.store_no = h.store_no AND n.entity_id = h.owner_id""")
def vector_join_tracks(spark, sf):
    """Search hits left joined to the relational store of tracked objects."""
    hits = _found(spark, sf, 5, "vec_kind in ('entity', 'event')")
    n = bridge(spark, sf).groupBy("store_no", F.col("entity_id").alias("owner_id")).agg(F.count("*").alias("n_events"))
    return hits.join(n, ["store_no", "owner_id"], "left").select("qid", "vec_id", F.round("sim", 6).alias("sim"), "n_events")


_FRAMES = f"""{_hits('h', 64, "vec_kind = 'frame'")}, fe AS (
  SELECT h.qid, h.store_no, h.vec_id, h.sim, h.rnk, CAST(h.owner_id AS DOUBLE) AS sec, min(ev.pos) AS pos FROM h JOIN ev ON ev.store_no = h.store_no AND ev.s <= CAST(h.owner_id AS DOUBLE) AND CAST(h.owner_id AS DOUBLE) <= ev.e
  GROUP BY ALL)"""


def frame_events(spark, sf, k):
    """Frame hits with the first event, in storage order, that holds their second (ends included)."""
    return _held_by(spark, sf, _found(spark, sf, k, "vec_kind = 'frame'"))


def _held_by(spark, sf, hits):
    points = hits.withColumn("sec", F.expr("try_cast(owner_id as double)")).where("sec is not null and store_no is not null").withColumns({"rs": F.col("sec"), "re": F.col("sec")})
    spans = events(spark, sf).select("store_no", "pos", F.col("s").alias("ls"), F.col("e").alias("le"))
    met = overlap_join(spans, points, ["store_no"], lambda s, e, t, _: holds_closed(s, e, t))
    return met.groupBy("qid", "store_no", "vec_id", "sim", "rnk", "sec").agg(F.min("pos").alias("pos"))


@R.query("frames_topk_to_events", f"WITH {EV}, {VEC}, {QS}, {_FRAMES} SELECT qid, store_no, pos, min(rnk) AS best_rnk FROM fe GROUP BY ALL")
def frames_topk_to_events(spark, sf):
    """Frame top 64 to distinct events with their best rank."""
    return frame_events(spark, sf, 64).groupBy("qid", "store_no", "pos").agg(F.min("rnk").cast("bigint").alias("best_rnk"))


@R.query("frames_topk_temporal", f"""WITH {VEC}, {QS}, {_hits('h', 16, "vec_kind = 'frame'")} SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY store_no, CAST(owner_id AS DOUBLE), vec_id) AS place FROM h""")
def frames_topk_temporal(spark, sf):
    """Frame top 16 in order of time."""
    hits = _found(spark, sf, 16, "vec_kind = 'frame'")
    w = Window.partitionBy("qid").orderBy(F.col("store_no").asc_nulls_last(), F.expr("cast(owner_id as double)"), "vec_id")
    return hits.select("qid", "vec_id", F.row_number().over(w).cast("bigint").alias("place"))


@R.query("frames_topk_segments", f"""WITH {EV}, {VEC}, {QS}, {GT}, sec AS (SELECT DISTINCT store_no, unnest(range(greatest(gs, 0), ge + 1)) AS sec FROM gt), fv AS (SELECT vec.* FROM vec JOIN sec ON sec.store_no = vec.store_no AND sec.sec = TRY_CAST(vec.owner_id AS DOUBLE) WHERE vec_kind = 'frame'),
h AS (SELECT * FROM (SELECT qid, vec_id, store_no, owner_id, sim, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, vec_id) AS rnk FROM (SELECT qid, vec_id, store_no, owner_id, {_EPS} AS sim FROM qs, fv)) WHERE rnk <= 8)
SELECT qid, vec_id, store_no, round(sim, 6) AS sim, row_number() OVER (PARTITION BY qid ORDER BY store_no, CAST(owner_id AS DOUBLE), vec_id) AS place FROM h""")
def frames_topk_segments(spark, sf):
    """The 8 best of the frames at whole seconds inside the true segments (a small constant on the norms), in order
    of time."""
    vec = vectors(spark, sf)
    sec = truth(spark, sf).select("store_no", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), "gs"), "ge")).alias("sec")).select("store_no", F.col("sec").cast("double").alias("sec")).distinct()
    fv = vec.where("vec_kind = 'frame'").withColumn("sec", F.expr("try_cast(owner_id as double)")).join(sec, ["store_no", "sec"], "left_semi")
    hits = V.search(fv, _queries(vec), 8, eps=1e-8).join(vec.select("vec_id", "store_no", "owner_id"), "vec_id")
    w = Window.partitionBy("qid").orderBy("store_no", F.expr("cast(owner_id as double)"), "vec_id")
    return hits.select("qid", "vec_id", "store_no", F.round("sim", 6).alias("sim"), F.row_number().over(w).cast("bigint").alias("place"))


# --- fusion ----------------------------------------------------------------------------------


def _views(ke: int, kn: int, kf: int) -> str:
    return f"""{_hits('he', ke, "vec_kind = 'event'")}, {_hits('hn', kn, "vec_kind = 'entity'")}, {_hits('h', kf, "vec_kind = 'frame'")},
ve AS (SELECT qid, store_no, owner_id AS event_id, sim FROM he WHERE store_no IS NOT NULL),
vn AS (SELECT hn.qid, br.store_no, br.event_id, hn.sim FROM hn JOIN br ON br.store_no = hn.store_no AND br.entity_id = hn.owner_id),
fe AS (SELECT h.qid, h.store_no, h.vec_id, h.sim, min(ev.pos) AS pos FROM h JOIN ev ON ev.store_no = h.store_no AND ev.s <= CAST(h.owner_id AS DOUBLE) AND CAST(h.owner_id AS DOUBLE) <= ev.e GROUP BY ALL),
vf AS (SELECT fe.qid, fe.store_no, ev.event_id, fe.sim FROM fe JOIN ev ON ev.store_no = fe.store_no AND ev.pos = fe.pos)"""


def _share(view: str, how: str = "sum") -> str:
    return f"SELECT qid, store_no, event_id, sc / CASE WHEN sum(sc) OVER (PARTITION BY qid) = 0 THEN 1 ELSE sum(sc) OVER (PARTITION BY qid) END AS sc FROM (SELECT qid, store_no, event_id, {how}(sim) AS sc FROM {view} GROUP BY ALL)"


_STARTS = "st AS (SELECT store_no, event_id, min(s) AS start_s FROM ev GROUP BY ALL)"


def views(spark, sf, ke, kn, kf):
    """Event, entity and frame view: (qid, store_no, event_id, sim). One scan of the vectors finds the hits of all three."""
    vec = vectors(spark, sf)
    hits = checkpointed(V.search_parts(vec.withColumn("part", F.col("vec_kind")), _queries(vec), {"event": ke, "entity": kn, "frame": kf}).join(vec.drop("v"), "vec_id").where("store_no is not null"))
    e = hits.where("part = 'event'").select("qid", "store_no", F.col("owner_id").alias("event_id"), "sim")
    n = hits.where("part = 'entity'").join(bridge(spark, sf).withColumnRenamed("entity_id", "owner_id"), ["store_no", "owner_id"]).select("qid", "store_no", "event_id", "sim")
    f = _held_by(spark, sf, hits.where("part = 'frame'")).join(events(spark, sf).select("store_no", "pos", "event_id"), ["store_no", "pos"]).select("qid", "store_no", "event_id", "sim")
    return e, n, f


def _with_start(df, spark, sf):
    return df.join(events(spark, sf).groupBy("store_no", "event_id").agg(F.min("s").alias("start_s")), ["store_no", "event_id"])


@R.query("fusion_triview_sum", f"""WITH {EV}, {BR}, {VEC}, {QS}, {_views(5, 5, 32)}, {_STARTS}, a AS ({_share('ve')} UNION ALL {_share('vn')} UNION ALL {_share('vf')})
SELECT a.qid, a.store_no, a.event_id, round(sum(a.sc), 6) AS score, st.start_s FROM a JOIN st ON st.store_no = a.store_no AND st.event_id = a.event_id GROUP BY ALL""")
def fusion_triview_sum(spark, sf):
    """B1: three views, each divided by its sum, added per event."""
    fused = B.fuse([B.view_share(v, zero_as_one=True) for v in views(spark, sf, 5, 5, 32)])
    return _with_start(fused, spark, sf).select("qid", "store_no", "event_id", F.round("score", 6).alias("score"), "start_s")


@R.query("fusion_triview_top80", f"""WITH {EV}, {BR}, {VEC}, {QS}, {_views(50, 50, 50)}, {_STARTS}, a AS ({_share('ve')} UNION ALL {_share('vn')} UNION ALL {_share('vf')}),
b AS (SELECT a.qid, a.store_no, a.event_id, sum(a.sc) AS score FROM a JOIN st ON st.store_no = a.store_no AND st.event_id = a.event_id GROUP BY ALL)
SELECT qid, store_no, event_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, store_no, event_id) AS rn FROM b) WHERE rn <= 80""")
def fusion_triview_top80(spark, sf):
    """B2: 50 per view, the best 80 events; an empty view's sum counts as 1."""
    fused = _with_start(B.fuse([B.view_share(v, zero_as_one=True) for v in views(spark, sf, 50, 50, 50)]), spark, sf)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "store_no", "event_id")
    return fused.withColumn("rn", F.row_number().over(w)).where("rn <= 80").select("qid", "store_no", "event_id", F.round("score", 6).alias("score"))


@R.query("fusion_twoview_max", f"""WITH {EV}, {BR}, {VEC}, {QS}, {_views(50, 5, 1)}, a AS (SELECT qid, store_no, event_id, sc * 0.5 AS sc FROM ({_share('ve', 'max')}) UNION ALL SELECT qid, store_no, event_id, sc * 0.5 FROM ({_share('vn', 'max')})),
b AS (SELECT qid, store_no, event_id, sum(sc) AS score FROM a GROUP BY ALL)
SELECT qid, store_no, event_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, store_no, event_id) AS rn FROM b) WHERE rn <= 50""")
def fusion_twoview_max(spark, sf):
    """Two views with the best score per event and half the weight each, the best 50."""
    e, n, _ = views(spark, sf, 50, 5, 1)
    fused = B.fuse([B.view_share(v, "max", True) for v in (e, n)], [0.5, 0.5])
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "store_no", "event_id")
    return fused.withColumn("rn", F.row_number().over(w)).where("rn <= 50").select("qid", "store_no", "event_id", F.round("score", 6).alias("score"))


@R.query("fusion_single_view", f"""WITH {EV}, {BR}, {VEC}, {QS}, {_views(5, 5, 32)}, a AS (SELECT 'event' AS view, * FROM ({_share('ve')}) UNION ALL SELECT 'entity', * FROM ({_share('vn')}) UNION ALL SELECT 'frame', * FROM ({_share('vf')}))
SELECT view, qid, store_no, event_id, round(sc, 6) AS score FROM a""")
def fusion_single_view(spark, sf):
    """Each view alone."""
    out = None
    for name, v in zip(("event", "entity", "frame"), views(spark, sf, 5, 5, 32)):
        part = B.view_share(v, zero_as_one=True).select(F.lit(name).alias("view"), "qid", "store_no", "event_id", F.round("score", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@R.query("fusion_seed_list", f"WITH {SD}, sl AS (SELECT DISTINCT store_no, question_id, event_id FROM sd WHERE score IS NULL) SELECT sl.store_no, sl.question_id, sl.event_id, 1.0 AS score, e.s, e.e FROM sl JOIN (SELECT store_no, event_id, arg_min(s, pos) AS s, arg_min(e, pos) AS e FROM ev GROUP BY ALL) e ON e.store_no = sl.store_no AND e.event_id = sl.event_id")
def fusion_seed_list(spark, sf):
    """Given seed lists (the time matches of every question) at score 1, with their events."""
    chosen = seeds(spark, sf).where("score is null").select("store_no", "question_id", "event_id").distinct()
    ev = events(spark, sf).groupBy("store_no", "event_id").agg(F.min_by(F.struct("s", "e"), "pos").alias("x"))
    return chosen.join(ev, ["store_no", "event_id"]).select("store_no", "question_id", "event_id", F.lit(1.0).alias("score"), "x.s", "x.e")


def filter_expression(equal: dict | None = None, within: dict | None = None, lo=None, hi=None, start: str = "s", end: str = "e"):
    """Conjunction of equalities, memberships (an empty list is skipped) and a closed time range."""
    out = F.lit(True)
    for k, v in (equal or {}).items():
        out = out & (F.col(k) == v)
    for k, v in (within or {}).items():
        out = out & F.col(k).isin(list(v)) if v else out
    return out if lo is None else out & (F.col(start) <= hi) & (F.col(end) >= lo)


@R.query("filter_expressions", "SELECT response_id, store_no, method FROM responses WHERE correct = TRUE AND method IN ('tree', 'multimode') AND latency_seconds <= 20 AND latency_seconds >= 1")
def filter_expressions(spark, sf):
    """A composed filter of an equality, a membership, an empty list and a closed range, which reaches the scan."""
    f = filter_expression({"correct": True}, {"method": ["tree", "multimode"], "store_no": []}, 1, 20, "latency_seconds", "latency_seconds")
    return table(spark, sf, "responses").where(f).select("response_id", "store_no", "method")
