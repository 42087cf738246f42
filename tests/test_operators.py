"""Interval, order, seed, graph, list, cache, vector, time and source operators on small tables."""

import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import answers as A
from tideline.functions import intervals as FI
from tideline.functions import timetext as T
from tideline.operators import cache as C
from tideline.operators import eventlist as L
from tideline.operators import graph as G
from tideline.operators import ingest as N
from tideline.operators import intervals as I
from tideline.operators import metrics as ME
from tideline.operators import seeds as S
from tideline.operators import vector as V
from tideline.operators.ordering import numbered, prev_next
from tideline.sources import stores

C1 = [(0, 5, 5, 9, True, False), (0, 5, 6, 9, False, False), (0, 6, 5, 9, True, True), (3, 3, 0, 9, True, False)]


@pytest.mark.parametrize("s1, e1, s2, e2, closed, strict", C1)
def test_conventions(spark, s1, e1, s2, e2, closed, strict):
    a = [F.lit(x) for x in (s1, e1, s2, e2)]
    r = spark.range(1).select(FI.overlaps_closed(*a), FI.overlaps_strict(*a)).first()
    assert tuple(r) == (closed, strict)


def test_points_truncation_and_hull(spark):
    lit = F.lit
    r = spark.range(1).select(
        FI.holds_half_open(lit(1), lit(4), lit(4)), FI.holds_closed(lit(1), lit(4), lit(4)), *FI.truncated_ends(lit(2.7), lit(2.9)), FI.hull_iou(lit(0.0), lit(10.0), lit(5.0), lit(20.0)), FI.hull_iou(lit(0.0), lit(1.0), lit(5.0), lit(6.0)), FI.f1(lit(0.0), lit(0.0))
    ).first()
    assert tuple(r) == (False, True, 2, 3, 0.25, 0.0, 0.0)


def spans(n, seed):
    r = random.Random(seed)
    return [(r.choice([1, 1, 2]), i, s := r.randint(-100, 900), s + r.choice([0, 1, 10, 200])) for i in range(n)]


@pytest.mark.parametrize("width", [3, 64, 10_000])
def test_overlap_join(spark, width):
    a, b = spans(80, 1), spans(60, 2)
    left = spark.createDataFrame(a, "k int, i int, ls int, le int")
    right = spark.createDataFrame(b, "k int, j int, rs int, re int")
    for rule, ok in ((FI.overlaps_closed, lambda p, q: p[2] <= q[3] and p[3] >= q[2]), (FI.overlaps_strict, lambda p, q: max(p[2], q[2]) < min(p[3], q[3]))):
        got = sorted((r.i, r.j) for r in I.overlap_join(left, right, ["k"], rule, width).collect())
        assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and ok(p, q))


def test_overlap_join_of_very_long_intervals(spark):
    """Lengths from nothing to 10**9: no interval is written into many buckets, and no pair is lost or doubled."""
    r = random.Random(3)
    make = lambda n: [(r.choice([1, 2]), i, s := r.randint(-(10**6), 10**6), s + r.choice([0, 5, 100, 10**4, 10**6, 10**8, 10**9])) for i in range(n)]
    a, b = make(120), make(120)
    left = spark.createDataFrame(a, "k int, i int, ls bigint, le bigint")
    assert I._cells(left, "ls", "le", 64).count() < 40 * len(a)
    got = sorted((x.i, x.j) for x in I.overlap_join(left, spark.createDataFrame(b, "k int, j int, rs bigint, re bigint"), ["k"], FI.overlaps_closed).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[3] and p[3] >= q[2])


def test_coverage_and_hits(spark):
    runs = spark.createDataFrame([(1, 0, 10), (1, 20, 30)], "k int, s bigint, e bigint")
    refs = spark.createDataFrame([(1, 1, 5, 25), (1, 2, 10, 10), (1, 3, 9, 9), (1, 4, 40, 50), (1, 5, 30, 20), (2, 6, 0, 5)], "k int, i int, s bigint, e bigint")
    assert {x.i: x.coverage for x in I.coverage(runs, refs, "k").collect()} == {1: 0.5, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 0.0}


@pytest.mark.parametrize("gap", [0, 5])
def test_merged_and_clusters(spark, gap):
    rows = [(k, i, s, e) for k, i, s, e in spans(100, 3) if gap or e > s]
    df = spark.createDataFrame(rows, "k int, i int, s bigint, e bigint")
    want, member = [], {}
    for k in {r[0] for r in rows}:
        runs = []
        for _, i, s, e in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3])):
            if runs and s <= runs[-1][1] + gap:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
            member[i] = runs[-1]
        want += [(k, s, e) for s, e in runs]
    assert sorted(tuple(r) for r in I.merged(df, "k", gap).collect()) == sorted(want)
    got = {r.i: [r.cluster_s, r.cluster_e] for r in I.clusters(df, "k", gap).collect()}
    assert got == member


def test_blocks_agree_with_windows(spark):
    rows = [(k, p, f"v{p}") for k in (1, 2) for p in random.Random(k).sample(range(300), 120)] + [(None, 1, "x"), (3, None, "y"), (4, 7, None)]
    df = spark.createDataFrame(rows, "k int, p bigint, v string")
    w = Window.partitionBy("k").orderBy("p")
    ok = df.where("k is not null and p is not null")
    want = {(r.k, r.p): (r.a, r.b) for r in ok.select("k", "p", F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b")).collect()}
    got = {(r.k, r.p): (r.prev_v, r.next_v) for r in prev_next(df, "k", "p", "v", block=7).collect()}
    assert got == want
    want = {(r.k, r.p): (r.a - 1, r.n) for r in ok.select("k", "p", F.row_number().over(w).alias("a"), F.count("*").over(Window.partitionBy("k")).alias("n")).collect()}
    assert {(r.k, r.p): (r.rank0, r.group_size) for r in numbered(ok, ["k"], "p", block=7).collect()} == want


def test_uniform_sample(spark):
    for n in (1, 5, 12, 13, 50):
        df = spark.createDataFrame([(1, p * 3) for p in range(n)], "k int, p bigint")
        got = sorted(r.p for r in S.uniform_sample(df, "k", "p", 12).collect())
        assert got == ([p * 3 for p in range(n)] if n <= 12 else sorted({(i * n // 12) * 3 for i in range(12)}))


def test_null_scores(spark):
    rows = [(1, 1, "a", 0, 5.0, 6.0, None), (1, 1, "b", 1, 1.0, 2.0, 0.9), (1, 1, "c", 2, 3.0, 4.0, 0.9), (1, 1, "a", 3, 5.0, 6.0, 0.1)]
    df = spark.createDataFrame(rows, "store_no int, question_id int, event_id string, ord int, s double, e double, score double")
    ids = lambda d: [r.event_id for r in d.orderBy("rnk").collect()]
    assert ids(S.topk_nulls_first(df, 2)) == ["a", "b"] and ids(S.topk_scored(df, 3)) == ["b", "c", "a"] and ids(S.embedding_only(df, 5)) == ["b", "c"]
    assert [r.event_id for r in S.topk_fill(df, 2).orderBy("place").collect()] == ["b", "a"]
    assert S.topk_nulls_first(df.limit(0), 3).count() == 0


def test_components(spark):
    r = random.Random(5)
    pairs = [(f"n{r.randint(0, 150)}", f"n{r.randint(0, 150)}") for _ in range(90)] + [("hub", f"h{i}") for i in range(200)] + [("x", "x"), (None, "y")] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a and b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {t.node: t.component for t in G.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}


def test_hops_closure(spark):
    step = spark.createDataFrame([(1, a, b) for a, b in [("s", "t"), ("t", "u"), ("u", "s"), ("u", "v"), ("v", "w")]], "store_no int, a string, b string")
    t = G.multi_hop(spark.createDataFrame([(1, "s")], "store_no int, seed_id string"), step, 3)
    assert {(r.hop, r.parent, r.child) for r in t.collect()} == {(1, "s", "t"), (2, "t", "u"), (3, "u", "v")}


def test_edges_first_kind_wins(spark):
    e = spark.createDataFrame([(1, "a", "b", "relation", 1), (1, "b", "a", "belong_to", 0), (1, "c", "c", "relation", 1)], "store_no int, a string, b string, kind string, prio int")
    assert {tuple(r) for r in G.dedup_edges(e, ["store_no"]).collect()} == {(1, "a", "b", "belong_to"), (1, "c", "c", "relation")}


def chunk(i, s, e, score, ids, data):
    return {"list_id": i, "chunk_no": 0, "s": s, "e": e, "score": score, "generation": len(ids), "event_ids": ids, "data_s": [d[0] for d in data], "data_e": [d[1] for d in data]}


def test_list_merge_rules(spark):
    rows = [chunk("l", 0.0, 10.0, 1.0, ["a"], [(0.0, 10.0)]), chunk("l", 2.0, 9.0, 5.0, ["in"], [(2.0, 9.0)]), chunk("l", 8.0, 20.0, 2.0, ["b", "c"], [(8.0, 12.0), (12.0, 20.0)]), chunk("l", 30.0, 31.0, 4.0, ["d"], [(30.0, 31.0)]), chunk("m", 5.0, 6.0, 1.0, ["z"], [(5.0, 6.0)])]
    want = {("l", 0.0, 20.0, 3.0, ("a", "b", "c"), (0.0, 12.0)), ("l", 30.0, 31.0, 4.0, ("d",), (30.0,)), ("m", 5.0, 6.0, 1.0, ("z",), (5.0,))}
    shape = lambda c: (c["list_id"], c["s"], c["e"], c["score"], tuple(c["event_ids"]), tuple(c["data_s"]))
    assert {shape(c) for c in L.fold([r for r in rows if r["list_id"] == "l"])} == {w for w in want if w[0] == "l"}
    df = spark.createDataFrame(rows, L.CHUNK)
    assert {shape(r.asDict()) for r in L.merge_adjacent(df).collect()} == want
    assert L.merge_adjacent(df.limit(0)).count() == 0
    assert {r.path for r in L.search_paths(spark).where("depth = 2").collect()} == {"RQ>SA", "F>SA", "B>SA"} and L.search_paths(spark).count() == 13


def ask(seeds, near=(), ok=()):
    q = C.Query()
    q.seeds, q.ok = list(seeds), set(ok)
    for seed, span in near:
        q.near.setdefault(seed, []).append(span)
    return q


def test_cache_rules():
    assert C.hull_iou((0, 10), (5, 20)) == 0.25
    cache = C.Cache()
    cache.add(0.0, 10.0, [(0.0, 10.0, "x")], 5.0)
    cache.add(0.0, 10.0, [(0.0, 10.0, "y")], 7.0)
    got = ask([(0.0, 9.0, "a"), (100.0, 110.0, "b")], [("a", (9.0, 12.0, "na")), ("b", (110.0, 130.0, "nb")), ("b", (90.0, 100.0, "mb"))], {"b", "nb", "na"}).answer(cache, 30.0, 0.5, 8, 30.0)
    # the earlier entry on ties; its seed is covered, so only the other is expanded; A is verified, B is not
    assert (got["reused"], got["covered"], got["mean_reused_s"]) == ("x", "a", 5.0)
    assert (got["a"], got["b"], got["time_b_s"]) == ("b,nb,x", "a,b,mb,nb,x", 30.0)
    # the clusters of A and B together are new entries
    assert [(e[0], e[1], sorted(m[2] for m in e[2]), e[3]) for e in cache.entries[2:]] == [(0.0, 10.0, ["a", "x"], 30.0), (90.0, 130.0, ["b", "mb", "nb"], 30.0)]
    assert ask([(500.0, 510.0, "c")], [("c", (510.0, 520.0, str(i))) for i in range(9)], map(str, range(9))).answer(cache, 30.0, 0.5, 3, 30.0)["a"] == "0,1"
    assert ask([]).answer(cache, 30.0, 0.5, 3, 30.0)["b"] == ""


def test_cache_finds_what_a_scan_finds():
    r = random.Random(2)
    cache, entries = C.Cache(), []
    for _ in range(300):
        s = r.uniform(-500, 5000)
        e = s + r.choice([1, 20, 300, 90_000])
        cache.add(s, e, [], 0.0)
        entries.append((s, e))
        lo = r.uniform(-500, 5000)
        hi = lo + r.choice([1, 30, 400, 200_000])
        want = max(range(len(entries)), key=lambda k: (C.hull_iou((lo, hi), entries[k]), -k))
        at, v = cache.best(lo, hi)
        assert v == C.hull_iou((lo, hi), entries[want]) and (v == 0 and at is None or at == want)


def test_cross_cache_streams(spark):
    r = random.Random(7)
    rows = []
    for store in (1, 2, 3):
        for q in range(25):
            for k in range(r.randint(1, 4)):
                s = r.uniform(0, 400)
                rows.append((store, q, None, f"e{store}-{q}-{k}", k, s, s + 20, r.random() < 0.7))
                rows.append((store, q, f"e{store}-{q}-{k}", f"n{r.randint(0, 9)}", 0, s + 20, s + 30, r.random() < 0.5))
    df = spark.createDataFrame(rows, "store_no bigint, question_id bigint, seed_id string, event_id string, rnk bigint, s double, e double, ok boolean").repartition(5)
    got = {(x.store_no, x.question_id): x.asDict() for x in C.cross_cache(df).collect()}
    for store in (1, 2, 3):
        cache = C.Cache()
        for q in range(25):
            mine = [x for x in rows if x[:2] == (store, q)]
            seeds = sorted((x for x in mine if x[2] is None), key=lambda x: x[4])
            near = sorted((x for x in mine if x[2] is not None), key=lambda x: (x[2], x[3]))
            want = ask([(x[5], x[6], x[3]) for x in seeds], [(x[2], (x[5], x[6], x[3])) for x in near], [x[3] for x in mine if x[7]]).answer(cache, 30.0, 0.5, 8, 30.0)
            assert got[store, q] == {"store_no": store, "question_id": q} | want
    assert C.cross_cache(df.limit(0)).count() == 0


def test_verified_without_questions(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "store_no int, question_id int, event_id string")
    m = spark.createDataFrame([(1, 1, "a", "no"), (1, 1, "a", "yes")], "store_no int, question_id int, event_id string, verdict string")
    ids = lambda rule: sorted(x.event_id for x in C.verified(c, m, ["store_no", "question_id", "event_id"], rule).collect())
    assert (ids("any"), ids("majority"), ids("all")) == (["a", "b"], [], [])


def test_verdicts(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(C.verdict_list(F.col("t"), F.lit(3))).first()[0]
    assert one('["Yes"]') == ["yes", "no", "no"] and one("bad [") == ["no"] * 3 and one(None) == ["no"] * 3 and one('```json\n["no","yes","yes","yes"]\n```') == ["no", "yes", "yes"]


def test_search_against_numpy(spark):
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(size=(60, 8)), np.ones((5, 8))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, v array<double>").repartition(3)
    q = spark.createDataFrame([(0, x[0].tolist()), (61, x[61].tolist())], "qid bigint, v array<double>")
    got = {}
    for t in V.search(rows, q, 4).collect():
        got.setdefault(t.qid, []).append((t.rnk, t.vec_id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in (0, 61):
        s = (u @ u[i]).round(9)
        assert [v for _, v in sorted(got[i])] == sorted(range(len(x)), key=lambda j: (-s[j], j))[:4]
    assert V.search(rows, q.limit(0), 4).count() == 0 and V.search(rows.limit(0), q, 4).count() == 0
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(V.normalised(F.col("v"))).first()[0] == [None, None]


def test_search_in_parts(spark, monkeypatch):
    """Several kinds by one scan, few and many queries: as one search for each kind."""
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist(), "abc"[i % 3] if i % 7 else None) for i, v in enumerate(r.normal(size=(90, 6)))], "vec_id bigint, v array<double>, part string").repartition(4)
    q = rows.where("vec_id % 4 = 0").selectExpr("vec_id as qid", "v")
    want = {(p, *x[:2], x.rnk) for p, k in (("a", 2), ("b", 5)) for x in V.search(rows.where(F.col("part") == p), q, k).collect()}
    for few in (2048, 5):
        monkeypatch.setattr(V, "BLOCK", few)
        monkeypatch.setattr(V, "QUERY_BLOCK", 9)
        monkeypatch.setattr(V, "ROW_BLOCK", 40)
        assert {(x.part, x.qid, x.vec_id, x.rnk) for x in V.search_parts(rows, q, {"a": 2, "b": 5}).collect()} == want
    assert V.search_parts(rows, q.limit(0), {"a": 2}).count() == 0 and V.search_parts(rows.limit(0), q, {"a": 2}).count() == 0


def test_numbers_in_order_of_several_columns(spark):
    rows = [(1, r.randrange(40), r.randrange(3), i) for r in [random.Random(4)] for i in range(150)]
    got = {x.i: x.rank0 for x in numbered(spark.createDataFrame(rows, "k int, a bigint, b int, i int"), ["k"], "a", block=5, then=("b", "i")).collect()}
    assert got == {x[3]: n for n, x in enumerate(sorted(rows, key=lambda x: x[1:]))}


REFS = [("48:40-48:48", [(2920, 2928)]), ("00:1:20", [(80, 81)]), ("1:27:35", [(5255, 5256)]), ("01:00,02:30", [(60, 61), (150, 151)]), ("29:32.120", [(106440, 106441)]), ("-02:00", [(120, 120)]), ("02:00-01:00", None), ("N/A", None), ("", None), ("None", None), ("None-None", None), ("abc", None), (None, None)]


@pytest.mark.parametrize("text, want", REFS)
def test_time_references(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.segments_of(F.col("t"))).first()[0]
    assert (got and [(x.gs, x.ge) for x in got]) == want


def test_linspace(spark):
    for n, k in [(0, 4), (1, 4), (4, 4), (394, 384), (1000, 7), (5, 1)]:
        got = spark.range(1).select(T.linspace_ints(F.lit(n).cast("bigint"), k)).first()[0]
        assert got == (list(range(n)) if n <= k else np.linspace(0, n - 1, k).astype(int).tolist()), (n, k)


def test_answer_letters(spark):
    cases = [('{"Answer": "b"}', "B"), ("```json\n{\"Answer\": \"C\"}\n```", "C"), ("So the answer is D.", "D"), ("(A)", "A"), ("b.", "B"), ("An owl", None), (None, None), ("", None)]
    for t, want in cases:
        assert spark.createDataFrame([(t,)], "t string").select(A.answer_letter(F.col("t"))).first()[0] == want, t


def test_accuracy_edges(spark):
    found = spark.createDataFrame([(1, 1, "a", 0, 10.0, 20.0), (1, 1, "a", 1, 90.0, 99.0), (1, 1, "b", 2, 5.0, 5.0), (1, 2, "c", 0, 0.0, 4.0)], "store_no bigint, question_id bigint, event_id string, ord bigint, s double, e double")
    gt = spark.createDataFrame([(1, 1, 0, 10, 20), (1, 2, 0, 50, 60), (1, 3, 0, 1, 2)], "store_no bigint, question_id bigint, seg bigint, gs bigint, ge bigint")
    r = {x.question_id: x for x in ME.retrieval_accuracy(found, gt).collect()}
    assert (r[1].hit, r[1].precision_sec, r[1].snr_evt, r[1].n_events) == (True, 1.0, float("inf"), 1)
    assert (r[2].hit, r[2].iou_sec, r[2].snr_sec) == (False, 0.0, 0.0) and (r[3].n_events, r[3].precision_evt) == (0, 0.0)
    a = ME.averaged(ME.retrieval_accuracy(found, gt), []).first()
    assert (a.n_queries, a.inf_evt) == (3, 1)


def test_semantic_chunks(spark):
    w = [frozenset(x.split()) for x in ["a b c", "a b c", "a b c d", "x y", "x y"] + ["r"] * 10]
    assert N.greedy_chunks(w) == [(0, 3), (3, 5), (5, 13), (13, 15)]
    rows = [(1, i, t) for i, t in enumerate(["a b c", "a b c", "a b c d", "x y", "x y"] + ["r"] * 10)] + [(2, 0, None), (2, 5, None)]
    got = sorted(tuple(r) for r in N.semantic_chunks(spark.createDataFrame(rows, "store_no bigint, pos bigint, description string")).collect())
    assert got == [(1, 0, 2, 3), (1, 3, 4, 2), (1, 5, 12, 8), (1, 13, 14, 2), (2, 0, 0, 1), (2, 5, 5, 1)]


def test_file_stores(spark, tmp_path):
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    doc = {"embedding_dim": 3, "data": [{"id": "e1", "name": "n"}, {"__id__": "e2"}], "matrix": base64.b64encode(m.tobytes()).decode()}
    (tmp_path / "v.json").write_text(json.dumps(doc))
    got = {r.id: r.v for r in stores.read_vector_collection(spark, str(tmp_path / "v.json")).collect()}
    assert got == {"e1": [0.0, 1.0, 2.0], "e2": [3.0, 4.0, 5.0]}
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="Event-1"/><node id="Entity-1"/><edge source="Event-1" target="Entity-1"><data key="w">0.5</data></edge><edge source="Event-1" target="other"></edge></graph></graphml>')
    nodes, edges = stores.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {tuple(r) for r in nodes.collect()} == {("Event-1", "event"), ("Entity-1", "entity"), ("other", "other")}
    assert {tuple(r) for r in edges.collect()} == {("Event-1", "Entity-1", 0.5), ("Event-1", "other", 0.0)}
    c = spark.createDataFrame([(1, 1.0, 2.0, ["a"], 7)], "question_id bigint, s double, e double, event_ids array<string>, store_no bigint")
    stores.save_cache(c, str(tmp_path / "cache"))
    assert stores.load_cache(spark, str(tmp_path / "cache")).first().event_ids == ["a"] and stores.load_cache(spark, str(tmp_path / "none")).count() == 0
    stores.report(c.drop("event_ids"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 1


def test_questions(spark):
    p = json.dumps([{"qa": [{"uid": "u", "question": "Who?\n(A) x\n(B) y", "answer": "A", "question_type": ["a", "b"]}, {"question_id": 3, "query": "q", "options": ["x"]}]}])
    r = stores.questions(spark.createDataFrame([(1, p), (2, "{"), (3, None)], "file_id bigint, payload string")).orderBy("question_no").collect()
    assert [(x.question_id, x.stem, x.inline_options, x.options, x.question_type) for x in r] == [("u", "Who?", "(A) x\n(B) y", None, '["a", "b"]'), ("3", "q", "", '["x"]', None)]
