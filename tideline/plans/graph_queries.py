"""Queries of expansion, graph and entity statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import graph as G
from tideline.functions.intervals import holds_closed
from tideline.operators import seeds as S
from tideline.operators import vector as V
from tideline.operators.intervals import merged, overlap_join, total_length
from tideline.operators.ordering import prev_next
from tideline.plans.base import BR, EV, GT, SD, VEC, bridge, events, seeds, truth, vectors
from tideline.plans.interval_queries import temporal_neighbours
from tideline.registry import Registry
from tideline.session import checkpointed

R = Registry()

TOP = """top AS (SELECT store_no, question_id, event_id, rnk FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id ORDER BY score DESC NULLS FIRST, ord) AS rnk
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_no, question_id, event_id ORDER BY ord) AS r1 FROM sd) WHERE r1 = 1)) WHERE rnk <= 5)"""
PN = "pn AS (SELECT store_no, event_id, lag(event_id) OVER w AS p, lead(event_id) OVER w AS n FROM ev WINDOW w AS (PARTITION BY store_no ORDER BY pos))"
FB = f"""{PN}, fb AS (SELECT DISTINCT t.store_no, t.question_id, u.e AS event_id FROM top t JOIN pn ON pn.store_no = t.store_no AND pn.event_id = t.event_id, LATERAL (SELECT pn.p AS e UNION ALL SELECT pn.n) u WHERE u.e IS NOT NULL)"""
BD = f"{BR}, bd AS (SELECT DISTINCT store_no, entity_id, event_id FROM br)"


def top_seeds(spark, sf):
    return S.topk_nulls_first(seeds(spark, sf), 5)


@R.query("expand_prev_next", f"WITH {SD}, {TOP}, {FB} SELECT * FROM fb")
def expand_prev_next(spark, sf):
    """G1: previous and next events of the seeds; a seed can be among them."""
    return temporal_neighbours(spark, sf, top_seeds(spark, sf))


@R.query("entity_inverted", f"WITH {BD} SELECT store_no, event_id, count(*) AS n_entities, min(entity_id) AS first_entity FROM bd GROUP BY ALL")
def entity_inverted(spark, sf):
    """Entities of each event."""
    return bridge(spark, sf).select("store_no", "entity_id", "event_id").distinct().groupBy("store_no", "event_id").agg(F.count("*").alias("n_entities"), F.min("entity_id").alias("first_entity"))


@R.query("expand_evt_obj_evt", f"""WITH {SD}, {TOP}, {BD}
SELECT DISTINCT t.store_no, t.question_id, b2.event_id FROM top t JOIN bd b1 ON b1.store_no = t.store_no AND b1.event_id = t.event_id
JOIN bd b2 ON b2.store_no = b1.store_no AND b2.entity_id = b1.entity_id AND b2.event_id <> b1.event_id""")
def expand_evt_obj_evt(spark, sf):
    """Events that share an entity with a seed."""
    got = G.entity_mediated(top_seeds(spark, sf).select("store_no", "question_id", "event_id"), bridge(spark, sf))
    return got.select("store_no", "question_id", F.col("other_id").alias("event_id")).distinct()


_STEP = f"{PN}, stp AS (SELECT DISTINCT store_no, event_id AS a, n AS b FROM pn WHERE n IS NOT NULL AND n <> event_id UNION SELECT DISTINCT store_no, event_id, p FROM pn WHERE p IS NOT NULL AND p <> event_id)"


def _steps(spark, sf):
    pn = prev_next(events(spark, sf).select("store_no", "pos", "event_id"), "store_no", "pos", "event_id")
    return pn.select("store_no", F.col("event_id").alias("a"), F.explode(F.array("prev_event_id", "next_event_id")).alias("b")).where("b is not null and a <> b").distinct()


_HOPS = """h1 AS (SELECT s0.store_no, seed_id, b AS child, max(a) AS parent FROM s0 JOIN stp ON stp.store_no = s0.store_no AND a = seed_id WHERE b <> seed_id GROUP BY ALL),
h2 AS (SELECT h1.store_no, h1.seed_id, stp.b AS child, max(stp.a) AS parent FROM h1 JOIN stp ON stp.store_no = h1.store_no AND stp.a = h1.child WHERE stp.b <> h1.seed_id
  AND NOT EXISTS (SELECT 1 FROM h1 z WHERE z.store_no = h1.store_no AND z.seed_id = h1.seed_id AND z.child = stp.b) GROUP BY ALL)"""


@R.query("expand_two_hop", f"""WITH {EV}, {_STEP}, s0 AS (SELECT DISTINCT store_no, event_id AS seed_id FROM ev), {_HOPS}
SELECT store_no, seed_id, 1 AS hop, parent, child FROM h1 UNION ALL SELECT store_no, seed_id, 2, parent, child FROM h2""")
def expand_two_hop(spark, sf):
    """Two hops along the timeline from every event, with their trace."""
    return G.multi_hop(events(spark, sf).select("store_no", F.col("event_id").alias("seed_id")).distinct(), _steps(spark, sf), 2)


_MIXED = f"{_STEP.replace('stp AS', 'st0 AS')}, eo AS (SELECT DISTINCT x.store_no, x.event_id AS a, y.event_id AS b FROM bd x JOIN bd y ON y.store_no = x.store_no AND y.entity_id = x.entity_id AND y.event_id <> x.event_id), stp AS (SELECT * FROM st0 UNION SELECT * FROM eo)"
_TOP2 = "s0 AS (SELECT DISTINCT store_no, event_id AS seed_id FROM top WHERE rnk <= 1)"


@R.query("expand_hops_mixed", f"""WITH {SD}, {TOP}, {BD}, {_MIXED}, {_TOP2}, {_HOPS}
SELECT store_no, seed_id, 1 AS hop, parent, child FROM h1 UNION ALL SELECT store_no, seed_id, 2, parent, child FROM h2""")
def expand_hops_mixed(spark, sf):
    """Two hops from the best seed of every question, along the timeline and over shared entities."""
    return _mixed(spark, sf)


def _mixed(spark, sf):
    start = top_seeds(spark, sf).where("rnk <= 1").select("store_no", F.col("event_id").alias("seed_id")).distinct()
    steps, br = checkpointed(_steps(spark, sf)), checkpointed(bridge(spark, sf).select("store_no", "entity_id", "event_id").distinct())

    def step(last):
        time = last.join(steps.withColumnsRenamed({"a": "node", "b": "child"}), ["store_no", "node"])
        over = G.entity_mediated(last.withColumnRenamed("node", "event_id"), br).select("store_no", "seed_id", F.col("event_id").alias("node"), F.col("other_id").alias("child"))
        return time.select("store_no", "seed_id", "node", "child").unionByName(over)

    return G.expand_hops(start, step, 2)


@R.query("expand_reachable", f"""WITH {SD}, {TOP}, {BD}, {_MIXED}, {_TOP2}, {_HOPS}
SELECT store_no, seed_id, count(*) AS n FROM (SELECT store_no, seed_id, seed_id AS node FROM s0 WHERE EXISTS (SELECT 1 FROM h1 WHERE h1.store_no = s0.store_no AND h1.seed_id = s0.seed_id) UNION SELECT store_no, seed_id, child FROM h1 UNION SELECT store_no, seed_id, child FROM h2) GROUP BY ALL""")
def expand_reachable(spark, sf):
    """Size of what a trace reaches from its seed, the seed included."""
    return G.reachable(_mixed(spark, sf)).groupBy("store_no", "seed_id").agg(F.count("*").alias("n"))


@R.query("expand_payloads", f"""WITH {SD}, {TOP}, {FB}, pay AS (SELECT store_no, event_id, min(pos) AS pos, arg_min(s, pos) AS s, arg_min(e, pos) AS e FROM ev GROUP BY ALL)
SELECT fb.store_no, fb.question_id, fb.event_id, pay.pos, pay.s, pay.e FROM fb JOIN pay ON pay.store_no = fb.store_no AND pay.event_id = fb.event_id""")
def expand_payloads(spark, sf):
    """Payloads of the expanded events, the first row of an id."""
    pay = events(spark, sf).groupBy("store_no", "event_id").agg(F.min("pos").alias("pos"), F.min_by("s", "pos").alias("s"), F.min_by("e", "pos").alias("e"))
    return temporal_neighbours(spark, sf, top_seeds(spark, sf)).join(pay, ["store_no", "event_id"]).select("store_no", "question_id", "event_id", "pos", "s", "e")


_FR = f"""{VEC}, qf AS (SELECT store_no, arg_min(v, vec_id) AS qv FROM vec WHERE vec_kind = 'event' AND store_no IS NOT NULL GROUP BY store_no),
fs AS (SELECT vec.store_no, CAST(owner_id AS DOUBLE) AS sec, max(round(list_cosine_similarity(v, qv), 9)) AS score FROM vec JOIN qf USING (store_no) WHERE vec_kind = 'frame' AND TRY_CAST(owner_id AS DOUBLE) IS NOT NULL GROUP BY ALL)"""


@R.query("expand_selective", f"""WITH {SD}, {TOP}, {FB}, {_FR}, det AS (SELECT ev.store_no, ev.event_id, max(fs.score) AS best FROM fs JOIN ev ON ev.store_no = fs.store_no AND ev.s <= fs.sec AND fs.sec <= ev.e GROUP BY ALL), hs AS (SELECT DISTINCT store_no FROM fs)
SELECT store_no, question_id, event_id FROM top UNION SELECT fb.store_no, fb.question_id, fb.event_id FROM fb LEFT JOIN hs ON hs.store_no = fb.store_no LEFT JOIN det ON det.store_no = fb.store_no AND det.event_id = fb.event_id WHERE hs.store_no IS NULL OR det.best >= 0""")
def expand_selective(spark, sf):
    """Neighbours in which a frame scores at least the threshold (0, against the store's first event vector); all
    neighbours in stores without frame scores; seeds always stay."""
    top = top_seeds(spark, sf)
    v = vectors(spark, sf).where("store_no is not null")
    q = v.where("vec_kind = 'event'").groupBy("store_no").agg(F.min_by("v", "vec_id").alias("qv"))
    sec = F.expr("try_cast(owner_id as double)")
    fs = v.where("vec_kind = 'frame'").join(q, "store_no").select("store_no", sec.alias("rs"), sec.alias("re"), F.round(V.cosine(F.col("v"), F.col("qv")), 9).alias("score")).where("rs is not null")
    spans = events(spark, sf).select("store_no", "event_id", F.col("s").alias("ls"), F.col("e").alias("le"))
    det = overlap_join(spans, fs, ["store_no"], lambda s, e, t, _: holds_closed(s, e, t)).groupBy("store_no", "event_id").agg(F.max("score").alias("best"))
    near = G.selective(temporal_neighbours(spark, sf, top), det, fs.select("store_no").distinct(), 0.0)
    return top.select("store_no", "question_id", "event_id").unionByName(near.select("store_no", "question_id", "event_id")).distinct()


@R.query("set_ops", f"""WITH {SD}, {TOP}, {FB}, t AS (SELECT store_no, question_id, event_id FROM top)
SELECT 'union' AS op, store_no, question_id, event_id FROM (SELECT * FROM t UNION SELECT * FROM fb) UNION ALL SELECT 'intersect', * FROM (SELECT * FROM t INTERSECT SELECT * FROM fb) UNION ALL SELECT 'except', * FROM (SELECT * FROM fb EXCEPT SELECT * FROM t)""")
def set_ops(spark, sf):
    """C-9/A31: union, intersection and difference of id sets."""
    top = top_seeds(spark, sf)
    t = top.select("store_no", "question_id", "event_id")
    fb = temporal_neighbours(spark, sf, top).select("store_no", "question_id", "event_id")
    parts = {"union": t.unionByName(fb).distinct(), "intersect": t.intersect(fb), "except": fb.exceptAll(t).distinct().join(t, t.columns, "left_anti")}
    out = None
    for name, df in parts.items():
        p = df.select(F.lit(name).alias("op"), "store_no", "question_id", "event_id")
        out = p if out is None else out.unionByName(p)
    return out


# relations: entities that stand next to each other, by id, in one event
RL = """rl AS (SELECT * FROM (SELECT store_no, event_id, lag(entity_id) OVER (PARTITION BY store_no, event_id ORDER BY entity_id) AS entity1, entity_id AS entity2 FROM bd) WHERE entity1 IS NOT NULL)"""


def relations(spark, sf):
    b = bridge(spark, sf).select("store_no", "event_id", "entity_id").distinct()
    w = Window.partitionBy("store_no", "event_id").orderBy("entity_id")
    return b.select("store_no", "event_id", F.lag("entity_id").over(w).alias("entity1"), F.col("entity_id").alias("entity2")).where("entity1 is not null")


EDGES = f"""{EV}, {BD}, {RL}, {PN}, e0 AS (SELECT store_no, event_id AS a, entity_id AS b, 'belong_to' AS kind, 0 AS prio FROM bd UNION ALL SELECT store_no, entity1, entity2, 'relation', 1 FROM rl
UNION ALL SELECT store_no, event_id, n, 'event_time_relation', 2 FROM pn WHERE n IS NOT NULL AND n <> event_id),
ed AS (SELECT store_no, a, b, kind FROM (SELECT store_no, least(a, b) AS a, greatest(a, b) AS b, kind, row_number() OVER (PARTITION BY store_no, least(a, b), greatest(a, b) ORDER BY prio, kind) AS rn FROM e0) WHERE rn = 1)"""


def edges(spark, sf):
    b = bridge(spark, sf).select("store_no", F.col("event_id").alias("a"), F.col("entity_id").alias("b")).distinct()
    r = relations(spark, sf).select("store_no", F.col("entity1").alias("a"), F.col("entity2").alias("b"))
    pn = prev_next(events(spark, sf).select("store_no", "pos", "event_id"), "store_no", "pos", "event_id")
    t = pn.where("next_event_id is not null and next_event_id <> event_id").select("store_no", F.col("event_id").alias("a"), F.col("next_event_id").alias("b"))
    out = None
    for p, (kind, df) in enumerate((("belong_to", b), ("relation", r), ("event_time_relation", t))):
        part = df.withColumns({"kind": F.lit(kind), "prio": F.lit(p)})
        out = part if out is None else out.unionByName(part)
    return G.dedup_edges(out, ["store_no"])


@R.query("graph_edges_dedup", f"WITH {EDGES} SELECT store_no, a, b, kind FROM ed")
def graph_edges_dedup(spark, sf):
    """One edge per pair, the first kind wins."""
    return edges(spark, sf).select("store_no", "a", "b", "kind")


_DEG = "dg AS (SELECT store_no, node, count(*) AS degree FROM (SELECT store_no, a AS node FROM ed UNION ALL SELECT store_no, b FROM ed) GROUP BY ALL)"


def degrees(e):
    return e.select("store_no", F.col("a").alias("node")).unionByName(e.select("store_no", F.col("b").alias("node"))).groupBy("store_no", "node").agg(F.count("*").alias("degree"))


@R.query("graph_degree", f"WITH {EDGES}, {_DEG} SELECT store_no, node, degree FROM dg")
def graph_degree(spark, sf):
    """Degree of each node; a self loop counts twice."""
    return degrees(edges(spark, sf))


@R.query("graph_edge_degree", f"WITH {EDGES}, {_DEG} SELECT ed.store_no, ed.a, ed.b, x.degree + y.degree AS edge_degree FROM ed JOIN dg x ON x.store_no = ed.store_no AND x.node = ed.a JOIN dg y ON y.store_no = ed.store_no AND y.node = ed.b")
def graph_edge_degree(spark, sf):
    """Sum of the ends' degrees."""
    e = edges(spark, sf)
    d = degrees(e)
    out = e.join(d.select("store_no", F.col("node").alias("a"), F.col("degree").alias("da")), ["store_no", "a"]).join(d.select("store_no", F.col("node").alias("b"), F.col("degree").alias("db")), ["store_no", "b"])
    return out.select("store_no", "a", "b", (F.col("da") + F.col("db")).alias("edge_degree"))


@R.query("graph_delete_nodes", f"WITH {EDGES} SELECT store_no, kind, count(*) AS n FROM ed WHERE a NOT LIKE 'Entity-a%' AND b NOT LIKE 'Entity-a%' GROUP BY ALL")
def graph_delete_nodes(spark, sf):
    """Deleting nodes drops their edges."""
    e = edges(spark, sf)
    gone = degrees(e).where("node like 'Entity-a%'").select("store_no", "node")
    left = e.join(gone.withColumnRenamed("node", "a"), ["store_no", "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), ["store_no", "b"], "left_anti")
    return left.groupBy("store_no", "kind").agg(F.count("*").alias("n"))




_CC = f"""WITH RECURSIVE {BD}, n AS (SELECT DISTINCT store_no || ':' || event_id AS u, store_no || ':' || entity_id AS v FROM bd), g AS (SELECT u, v FROM n UNION SELECT v, u FROM n),
w(node, comp) USING KEY (node) AS (SELECT u, u FROM g GROUP BY u UNION SELECT g.v, min(w.comp) FROM w JOIN g ON g.u = w.node JOIN recurring.w AS r ON r.node = g.v WHERE w.comp < r.comp GROUP BY g.v)"""


@R.query("graph_connected_components", f"{_CC} SELECT node, comp AS component FROM w")
def graph_connected_components(spark, sf):
    """Components of the event-entity graph of every store."""
    return _components(bridge(spark, sf))


def _components(b):
    return G.components(b.select(F.concat_ws(":", "store_no", "event_id").alias("a"), F.concat_ws(":", "store_no", "entity_id").alias("b")).distinct())


@R.query("graph_largest_component", f"{_CC}, t AS (SELECT comp FROM w GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1) SELECT node, comp AS component FROM w WHERE comp IN (SELECT comp FROM t)")
def graph_largest_component(spark, sf):
    """Nodes of the largest component over all stores (ties: the smaller name)."""
    c = _components(bridge(spark, sf))
    top = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return c.join(F.broadcast(top.select("component")), "component", "left_semi").select("node", "component")


# --- statistics ------------------------------------------------------------------------------


@R.query("entity_objects_per_event_stats", f"""WITH {EV}, {BD}, p AS (SELECT e.store_no, e.event_id, count(bd.entity_id) AS n FROM (SELECT DISTINCT store_no, event_id FROM ev) e LEFT JOIN bd ON bd.store_no = e.store_no AND bd.event_id = e.event_id GROUP BY ALL)
SELECT store_no, count(*) AS n, round(avg(n), 6) AS mean, median(n) AS median, round(stddev_pop(n), 6) AS std, min(n) AS lo, max(n) AS hi, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.75) AS q75 FROM p GROUP BY store_no""")
def entity_objects_per_event_stats(spark, sf):
    """Objects per event, events without objects included."""
    b = bridge(spark, sf).select("store_no", "event_id", "entity_id").distinct()
    p = events(spark, sf).select("store_no", "event_id").distinct().join(b, ["store_no", "event_id"], "left").groupBy("store_no", "event_id").agg(F.count("entity_id").alias("n"))
    q = lambda x: F.percentile("n", F.lit(x))
    return p.groupBy("store_no").agg(
        F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean"), q(0.5).alias("median"), F.round(F.stddev_pop("n"), 6).alias("std"), F.min("n").alias("lo"), F.max("n").alias("hi"), q(0.25).alias("q25"), q(0.75).alias("q75")
    )


@R.query("entity_relations_stats", f"""WITH {BD}, {RL}, x AS (SELECT store_no, entity1 AS entity_id, entity2 AS o FROM rl UNION ALL SELECT store_no, entity2, entity1 FROM rl),
p AS (SELECT z.store_no, z.entity_id, count(x.o) AS n, count(DISTINCT CASE WHEN x.o <> x.entity_id THEN x.o END) AS nb FROM (SELECT DISTINCT store_no, entity_id FROM bd) z LEFT JOIN x ON x.store_no = z.store_no AND x.entity_id = z.entity_id GROUP BY ALL)
SELECT store_no, count(*) AS n, round(avg(n), 6) AS mean_relations, max(n) AS max_relations, round(avg(nb), 6) AS mean_neighbours, max(nb) AS max_neighbours FROM p GROUP BY store_no""")
def entity_relations_stats(spark, sf):
    """Relations and distinct neighbours per object, objects without relations included."""
    r = relations(spark, sf)
    x = r.select("store_no", F.col("entity1").alias("entity_id"), F.col("entity2").alias("o")).unionByName(r.select("store_no", F.col("entity2").alias("entity_id"), F.col("entity1").alias("o")))
    z = bridge(spark, sf).select("store_no", "entity_id").distinct()
    p = z.join(x, ["store_no", "entity_id"], "left").groupBy("store_no", "entity_id").agg(F.count("o").alias("n"), F.count_distinct(F.when(F.col("o") != F.col("entity_id"), F.col("o"))).alias("nb"))
    return p.groupBy("store_no").agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean_relations"), F.max("n").alias("max_relations"), F.round(F.avg("nb"), 6).alias("mean_neighbours"), F.max("nb").alias("max_neighbours"))


@R.query("event_continuity", f"""WITH {EV}, {BD}, l AS (SELECT ev.store_no, ev.pos, list(DISTINCT bd.entity_id) FILTER (bd.entity_id IS NOT NULL) AS es FROM ev LEFT JOIN bd ON bd.store_no = ev.store_no AND bd.event_id = ev.event_id GROUP BY ALL),
m AS (SELECT store_no, pos, coalesce(es, []) AS a, lead(coalesce(es, [])) OVER (PARTITION BY store_no ORDER BY pos) AS b FROM l),
j AS (SELECT store_no, pos, len(list_intersect(a, b)) AS shared, len(a) AS na, len(b) AS nb FROM m WHERE b IS NOT NULL)
SELECT store_no, count(*) AS pairs, count(*) FILTER (shared > 0) AS any_shared, round(avg(CASE WHEN na + nb - shared = 0 THEN 0 ELSE shared / (na + nb - shared) END), 6) AS jaccard, round(avg(CASE WHEN na = 0 THEN 0 ELSE shared / na END), 6) AS forward, round(avg(CASE WHEN nb = 0 THEN 0 ELSE shared / nb END), 6) AS backward,
count(*) FILTER (shared = 0) AS b0, count(*) FILTER (shared = 1) AS b1, count(*) FILTER (shared BETWEEN 2 AND 5) AS b2, count(*) FILTER (shared > 5) AS b6 FROM j GROUP BY store_no""")
def event_continuity(spark, sf):
    """Objects shared by consecutive events."""
    b = bridge(spark, sf).select("store_no", "event_id", "entity_id").groupBy("store_no", "event_id").agg(F.collect_set("entity_id").alias("es"))
    rows = events(spark, sf).select("store_no", "pos", "event_id").join(b, ["store_no", "event_id"], "left")
    rows = rows.select("store_no", "pos", F.coalesce("es", F.array().cast("array<string>")).alias("es"))
    j = prev_next(rows, "store_no", "pos", "es").where("next_es is not null")
    shared, na, nb = F.size(F.array_intersect("es", "next_es")), F.size("es"), F.size("next_es")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    j = j.select("store_no", shared.alias("sh"), ratio(shared, na + nb - shared).alias("ja"), ratio(shared, na).alias("fw"), ratio(shared, nb).alias("bw"))
    return j.groupBy("store_no").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("sh") > 0).alias("any_shared"), F.round(F.avg("ja"), 6).alias("jaccard"), F.round(F.avg("fw"), 6).alias("forward"), F.round(F.avg("bw"), 6).alias("backward"),
        F.count_if(F.col("sh") == 0).alias("b0"), F.count_if(F.col("sh") == 1).alias("b1"), F.count_if(F.col("sh").between(2, 5)).alias("b2"), F.count_if(F.col("sh") > 5).alias("b6"),
    )


@R.query("event_continuity_control", f"""WITH {EV}, {BD}, l AS (SELECT ev.store_no, ev.pos, list(DISTINCT bd.entity_id) FILTER (bd.entity_id IS NOT NULL) AS es FROM ev LEFT JOIN bd ON bd.store_no = ev.store_no AND bd.event_id = ev.event_id GROUP BY ALL),
j AS (SELECT a.store_no, coalesce(a.es, []) AS a, coalesce(b.es, []) AS b FROM l a JOIN l b ON b.store_no = a.store_no AND b.pos = a.pos + 10 + a.pos % 7), c AS (SELECT store_no, len(list_intersect(a, b)) AS shared, len(a) AS na, len(b) AS nb FROM j)
SELECT store_no, count(*) AS pairs, count(*) FILTER (shared > 0) AS any_shared, round(avg(CASE WHEN na + nb - shared = 0 THEN 0 ELSE shared / (na + nb - shared) END), 6) AS jaccard FROM c GROUP BY store_no""")
def event_continuity_control(spark, sf):
    """A8 (control): objects shared by events that stand at least 10 places apart, one partner for every event."""
    b = bridge(spark, sf).select("store_no", "event_id", "entity_id").groupBy("store_no", "event_id").agg(F.collect_set("entity_id").alias("es"))
    rows = events(spark, sf).select("store_no", "pos", "event_id").join(b, ["store_no", "event_id"], "left").select("store_no", "pos", F.coalesce("es", F.array().cast("array<string>")).alias("es"))
    far = rows.select("store_no", (F.col("pos") + 10 + F.col("pos") % 7).alias("other"), F.col("es").alias("a")).join(rows.select("store_no", F.col("pos").alias("other"), F.col("es").alias("b")), ["store_no", "other"])
    shared, na, nb = F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b")
    j = far.select("store_no", shared.alias("sh"), F.coalesce(F.try_divide(shared.cast("double"), na + nb - shared), F.lit(0.0)).alias("ja"))
    return j.groupBy("store_no").agg(F.count("*").alias("pairs"), F.count_if(F.col("sh") > 0).alias("any_shared"), F.round(F.avg("ja"), 6).alias("jaccard"))


@R.query("store_alignment", f"""WITH {EV}, {BD}, x AS (SELECT DISTINCT store_no, event_id FROM ev), y AS (SELECT DISTINCT store_no, event_id FROM bd), j AS (SELECT coalesce(x.store_no, y.store_no) AS store_no, x.event_id AS xe, y.event_id AS ye FROM x FULL JOIN y ON x.store_no = y.store_no AND x.event_id = y.event_id)
SELECT store_no, count(*) FILTER (xe IS NOT NULL AND ye IS NOT NULL) AS in_both, count(*) FILTER (ye IS NULL) AS only_events, count(*) FILTER (xe IS NULL) AS only_bridge,
coalesce(array_to_string(list_sort(list(xe) FILTER (ye IS NULL))[1:20], ','), '') AS events_sample, coalesce(array_to_string(list_sort(list(ye) FILTER (xe IS NULL))[1:20], ','), '') AS bridge_sample FROM j GROUP BY store_no""")
def store_alignment(spark, sf):
    """How many ids of one store the other lacks, and the first 20 of them; ranked, so that no list is gathered whole."""
    x = events(spark, sf).select("store_no", "event_id").distinct().withColumn("x", F.lit(1))
    y = bridge(spark, sf).select("store_no", "event_id").distinct().withColumn("y", F.lit(1))
    j = x.join(y, ["store_no", "event_id"], "full_outer").select("store_no", "event_id", F.when(F.col("x").isNull(), "bridge").when(F.col("y").isNull(), "events").otherwise("both").alias("side"))
    n = j.groupBy("store_no").agg(F.count_if(F.col("side") == "both").alias("in_both"), F.count_if(F.col("side") == "events").alias("only_events"), F.count_if(F.col("side") == "bridge").alias("only_bridge"))
    some = j.where("side <> 'both'").withColumn("r", F.row_number().over(Window.partitionBy("store_no", "side").orderBy("event_id"))).where("r <= 20")
    some = some.groupBy("store_no").agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("event_id")))), ",").alias(f"{s}_sample") for s in ("events", "bridge")))
    return n.join(some, "store_no", "left").fillna("", ["events_sample", "bridge_sample"])


@R.query("vdb_vs_kg_links", f"""WITH {EDGES}, kg AS (SELECT store_no, CASE WHEN a LIKE 'Event-%' THEN a ELSE b END AS event_id, CASE WHEN a LIKE 'Event-%' THEN b ELSE a END AS entity_id FROM ed WHERE kind = 'belong_to')
SELECT v.store_no, v.links AS vdb_links, k.links AS kg_links, round(v.links / v.evs, 2) AS vdb_avg, round(k.links / k.evs, 2) AS kg_avg FROM
(SELECT store_no, count(*) AS links, count(DISTINCT event_id) AS evs FROM bd GROUP BY store_no) v JOIN (SELECT store_no, count(*) AS links, count(DISTINCT event_id) AS evs FROM kg GROUP BY store_no) k ON k.store_no = v.store_no""")
def vdb_vs_kg_links(spark, sf):
    """Links of the vector store and of the graph."""
    v = bridge(spark, sf).select("store_no", "event_id", "entity_id").distinct()
    first = F.col("a").startswith("Event-")
    k = edges(spark, sf).where("kind = 'belong_to'").select("store_no", F.when(first, F.col("a")).otherwise(F.col("b")).alias("event_id"))
    agg = lambda d, p: d.groupBy("store_no").agg(F.count("*").alias(f"{p}_links"), F.round(F.count("*") / F.count_distinct("event_id"), 2).alias(f"{p}_avg"))
    return agg(v, "vdb").join(agg(k, "kg"), "store_no").select("store_no", "vdb_links", "kg_links", "vdb_avg", "kg_avg")


@R.query("vdb_vs_kg_one_hop", f"""WITH {SD}, {TOP}, {EDGES.removeprefix(EV + ', ')}, kb AS (SELECT store_no, CASE WHEN a LIKE 'Event-%' THEN a ELSE b END AS event_id, CASE WHEN a LIKE 'Event-%' THEN b ELSE a END AS entity_id FROM ed WHERE kind = 'belong_to'),
s AS (SELECT DISTINCT store_no, event_id FROM top), v AS (SELECT s.store_no, count(DISTINCT y.event_id) AS n FROM s JOIN bd x ON x.store_no = s.store_no AND x.event_id = s.event_id JOIN bd y ON y.store_no = x.store_no AND y.entity_id = x.entity_id AND y.event_id <> x.event_id WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.store_no = y.store_no AND z.event_id = y.event_id) GROUP BY s.store_no),
k AS (SELECT s.store_no, count(DISTINCT y.event_id) AS n FROM s JOIN kb x ON x.store_no = s.store_no AND x.event_id = s.event_id JOIN kb y ON y.store_no = x.store_no AND y.entity_id = x.entity_id AND y.event_id <> x.event_id WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.store_no = y.store_no AND z.event_id = y.event_id) GROUP BY s.store_no)
SELECT c.store_no, c.n AS seeds, coalesce(v.n, 0) AS vdb_new, coalesce(k.n, 0) AS kg_new, round(coalesce(v.n, 0) / c.n, 2) AS vdb_avg, round(coalesce(k.n, 0) / c.n, 2) AS kg_avg FROM (SELECT store_no, count(*) AS n FROM s GROUP BY store_no) c LEFT JOIN v USING (store_no) LEFT JOIN k USING (store_no)""")
def vdb_vs_kg_one_hop(spark, sf):
    """New events one hop over shared entities from the top seeds, by the vector store's links and by the
    graph's, in all and per seed."""
    s = checkpointed(top_seeds(spark, sf).select("store_no", "event_id").distinct())
    first = F.col("a").startswith("Event-")
    kb = edges(spark, sf).where("kind = 'belong_to'").select("store_no", F.when(first, F.col("a")).otherwise(F.col("b")).alias("event_id"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("entity_id"))
    out = s.groupBy("store_no").agg(F.count("*").alias("seeds"))
    for name, links in (("vdb", bridge(spark, sf)), ("kg", kb)):
        new = G.entity_mediated(s, links).select("store_no", F.col("other_id").alias("event_id")).distinct().join(s, ["store_no", "event_id"], "left_anti")
        out = out.join(new.groupBy("store_no").agg(F.count("*").alias(f"{name}_new")), "store_no", "left").fillna(0, [f"{name}_new"])
    return out.select("store_no", "seeds", "vdb_new", "kg_new", *(F.round(F.col(f"{n}_new") / F.col("seeds"), 2).alias(f"{n}_avg") for n in ("vdb", "kg")))


@R.query("expand_and_measure", f"""WITH {SD}, {TOP}, {FB}, {GT}, x AS (SELECT DISTINCT fb.store_no, fb.question_id, ev.pos, ev.s, ev.e, ev.ms, ev.me FROM fb JOIN ev ON ev.store_no = fb.store_no AND ev.event_id = fb.event_id),
h AS (SELECT DISTINCT x.store_no, x.question_id FROM x JOIN gt ON gt.store_no = x.store_no AND gt.question_id = x.question_id AND greatest(x.s, gt.gs) < least(x.e, gt.ge)),
al AS (SELECT store_no, question_id, ms, me FROM x UNION SELECT t.store_no, t.question_id, ev.ms, ev.me FROM top t JOIN ev ON ev.store_no = t.store_no AND ev.event_id = t.event_id),
fl AS (SELECT *, max(me) OVER (PARTITION BY store_no, question_id ORDER BY ms, me ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tp FROM al), isl AS (SELECT *, sum(CASE WHEN tp IS NULL OR ms > tp + 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY store_no, question_id ORDER BY ms, me ROWS UNBOUNDED PRECEDING) AS g FROM fl),
m AS (SELECT store_no, question_id, CAST(sum(l) AS BIGINT) AS merged_ms FROM (SELECT store_no, question_id, max(me) - min(ms) AS l FROM isl GROUP BY store_no, question_id, g) GROUP BY ALL)
SELECT x.store_no, x.question_id, CAST(sum(x.me - x.ms) AS BIGINT) AS total_ms, bool_or(h.store_no IS NOT NULL) AS hit, any_value(m.merged_ms) AS merged_ms FROM x LEFT JOIN h ON h.store_no = x.store_no AND h.question_id = x.question_id LEFT JOIN m ON m.store_no = x.store_no AND m.question_id = x.question_id GROUP BY ALL""")
def expand_and_measure(spark, sf):
    """Length of the expanded events, whether they hit a true segment of the question, and their length merged at
    a gap of 1 s with the seeds that were there before."""
    top = top_seeds(spark, sf)
    ev = events(spark, sf)
    x = temporal_neighbours(spark, sf, top).join(ev, ["store_no", "event_id"]).select("store_no", "question_id", "pos", "s", "e", "ms", "me").distinct()
    gt = truth(spark, sf).select("store_no", "question_id", "gs", "ge")
    h = x.join(gt, ["store_no", "question_id"]).where(F.greatest("s", "gs") < F.least("e", "ge")).select("store_no", "question_id").distinct().withColumn("h", F.lit(True))
    q = F.concat_ws(":", "store_no", "question_id").alias("q")
    before = top.select("store_no", "question_id", "event_id").join(ev, ["store_no", "event_id"])
    al = x.select(q, F.col("ms").alias("s"), F.col("me").alias("e")).unionByName(before.select(q, F.col("ms").alias("s"), F.col("me").alias("e")))
    m = total_length(merged(al, "q", 1000), "q").withColumnRenamed("length", "merged_ms")
    out = x.join(h, ["store_no", "question_id"], "left").groupBy("store_no", "question_id").agg(F.sum(F.col("me") - F.col("ms")).cast("bigint").alias("total_ms"), F.coalesce(F.bool_or("h"), F.lit(False)).alias("hit"))
    return out.withColumn("q", q).join(m, "q", "left").drop("q")
