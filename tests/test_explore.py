"""Graph exploration, frames and parsers against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import parsing as P
from tideline.operators import eventlist as L
from tideline.operators import explore as X
from tideline.operators import frames as FR
from tideline.operators import graph as G
from tideline.operators import ingest as N
from tideline.sources import stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def parts(near, gone=None):
    seen, n = set(), 0
    for a in near:
        if a != gone and a not in seen:
            n += 1
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in seen and x != gone:
                    seen.add(x)
                    todo += near[x]
    return n


def test_articulation_points():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(2, 14)
        near = {str(i): set() for i in range(n)}
        for _ in range(r.randint(1, 18)):
            a, b = str(r.randrange(n)), str(r.randrange(n))
            if a != b:
                near[a].add(b)
                near[b].add(a)
        want = {x for x in near if near[x] and parts(near, x) > parts(near)}
        assert X.articulation_points(near) == want


def test_short_paths_and_pruning():
    near = {"a": {"b", "c"}, "b": {"a", "d"}, "c": {"a", "d"}, "d": {"b", "c", "e"}, "e": {"d"}}
    assert X.on_short_paths(near, {"a", "e"}) == {"b", "c", "d"} and X.on_short_paths(near, {"a", "e"}, 2) == set()
    nodes = {"a": (True, 0.9, False), "b": (False, 0.1, False), "z": (True, 0.1, False), "e": (True, 0.1, True), "y": (False, 0.55, False)}
    roles, t = X.prune_graph(nodes, [("a", "b"), ("b", "e"), ("a", "z")])
    assert roles == {"a": "terminal", "b": "bridge", "e": "terminal", "y": "strong"} and t == 4  # one removal, then three strikes
    assert X.prune_graph({}, []) == ({}, 3)


def test_traces(spark):
    chain = [(1, f"n{i}", f"n{i + 1}") for i in range(6)]
    step = spark.createDataFrame(chain + [(s, b, a) for s, a, b in chain], "store_no int, a string, b string")
    seeds = spark.createDataFrame([(1, "n2"), (1, "alone")], "store_no int, seed_id string")
    go = lambda last: last.join(step.withColumnsRenamed({"a": "node", "b": "child"}), ["store_no", "node"]).select("store_no", "seed_id", "node", "child")
    trace = G.expand_hops(seeds, go, 2)
    assert sorted(tuple(r) for r in trace.collect()) == sorted(tuple(r) for r in G.multi_hop(seeds, step, 2).collect())
    assert {(r.node, r.hop) for r in G.reachable(trace).collect()} == {("n2", 0), ("n1", 1), ("n3", 1), ("n0", 2), ("n4", 2)}
    assert G.expand_hops(seeds.where("seed_id = 'alone'"), go, 3).count() == 0  # nothing found: it stops early


def test_selective_falls_back(spark):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "store_no int, event_id string")
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1)], "store_no int, event_id string, best double")
    assert {r.event_id for r in G.selective(c, scores, scores.select("store_no").distinct(), 0.5).collect()} == {"a", "c"}


def test_frames(spark):
    v = lambda *x: [F.lit(y) for y in x]
    assert one(spark, FR.at_rate(*v(1.0, 2.0, 29.97), 10.0)) == list(range(29, 59, 2)) and one(spark, FR.at_rate(*v(1.5, 1.5, 29.97), 1.0)) == [44]
    assert one(spark, FR.at_rate(*v(0.0, 2.0, 0.5), 1.0)) == [0]
    assert one(spark, FR.instants(*v(2.0, 4.0, 1))) == [3.0] and one(spark, FR.instants(*v(2.0, 4.0, 2))) == [2.0, 4.0] and one(spark, FR.instants(*v(2.0, 2.0, 3))) == [2.0, 2.5, 3.0]
    jump = dict(jump_after=F.lit(50_000), jump_video=F.lit(30_000), jump_display=F.lit(51_000))
    assert one(spark, FR.video_second(*v(40_000, 0, 36_000), **jump)) == 4000 and one(spark, FR.video_second(*v(51_100, 0, 36_000), **jump)) == 30_100
    assert one(spark, FR.video_second(*v(100, 0, 80_000), wraps=F.lit(True))) == 6500 and one(spark, FR.video_second(*v(100, 0, 80_000), wraps=F.lit(False))) == 0
    box = FR.clamped_box(F.array(*v(-10.0, 5.0, 50.0, 900.0)), F.lit(100), F.lit(200))
    assert one(spark, box) == [0.0, 5.0, 50.0, 200.0] and one(spark, FR.normalised_box(box, F.lit(100), F.lit(200))) == [0, 25, 500, 1000]
    assert one(spark, FR.clamped_box(F.array(*v(120.0, 5.0, 150.0, 9.0)), F.lit(100), F.lit(200))) is None


T = '{"localization_time": %s, "content_time": {"exists": true, "values": ["2:03", "1:00 PM", null]}}'
SEGMENTS = [
    ('{"exists": true, "type": "exact", "value": "1:00"}', [(60, 60, 0)]), ('{"exists": true, "type": "range", "value": {"start": "2:00", "end": "1:00"}}', [(60, 120, 0)]),
    ('{"exists": true, "type": "multiple", "values": ["0:05", {"start": "1:00", "end": "1:10"}, " "]}', [(5, 5, 0), (60, 70, 1)]), ('{"exists": true, "type": "position", "value": "end"}', []), ('{"exists": false, "type": "exact", "value": "1:00"}', []), ("null", []),
]


@pytest.mark.parametrize("loc, want", SEGMENTS)
def test_localization(spark, loc, want):
    for text in (T % loc, f"```json\n{T % loc}\n```"):
        assert [tuple(x) for x in one(spark, P.localization_segments(F.lit(text)))] == want
    assert one(spark, P.localization_segments(F.lit((T % loc)[:-9]))) == []


def test_parsers(spark):
    p = one(spark, P.temporal_analysis(F.lit(T % SEGMENTS[1][0])))
    assert (p.has_localization, p.has_content, p.localization, p.content) == (True, True, [120, 60], [60, 123])
    assert tuple(one(spark, P.query_type(F.lit("[1")))) == (False, "none", False, False) and one(spark, P.keyword_strategy(F.lit('{"strategy": " Neither "}'))) == "neither" and one(spark, P.keyword_strategy(F.lit(""))) == "both"
    got = one(spark, P.display_segments(F.lit('{"start": "around 1:30 PM", "end": "12:05 AM"}'), F.array(F.lit("at 7:15:02"), F.lit("no time"), F.lit(None).cast("string"))))
    assert [tuple(x) for x in got] == [(300, 48_600, "value"), (26_102, 26_102, "content")]
    assert tuple(one(spark, P.object_query(F.lit('so: {"object_description": "cap", "frame_range": {"start": 2, "end": 9}} ok')))) == ("cap", 2, 9) and tuple(one(spark, P.object_query(F.lit("a {cap")))) == ("a {cap", None, None)
    assert [one(spark, P.question_key(F.lit(x))) for x in ("7", " 8 ", "u9", None)] == [7, 8, -1, -1]
    assert one(spark, P.sentences(F.lit(" A b. . C."))) == ["A b", "C"]
    rows = spark.createDataFrame([([1.005, 2.0],), ([20_000.0, 30_500.0],), ([1.0],), (None,), ([None, 2.0],)], "d array<double>")
    assert [r[0] for r in rows.select(P.duration_text(F.col("d"))).collect()] == ["1.00s - 2.00s", "20.00s - 30.50s", "", "", ""]
    assert one(spark, P.nested_list(F.lit('{"t": "[1, 2]"}'), "t")) == ["1", "2"] == one(spark, P.nested_list(F.lit('```json\n{"t": [1, 2]}\n```'), "t"))
    assert one(spark, P.prompt("caption", s=F.lit(1), e=F.lit(None))) == "Describe what happens between 1 and  seconds in one sentence."


VERDICTS = [
    ('{"Entities": [{"Entity_name": "a", "Entity_description": "b", "Index": [0]}], "Relations": []}', "ok"), ('{"Entities": []}', "empty"), ('{"Entities": [{"Entity_name": "a", "Index": [0]}]}', "entity"), ('{"Entities": [{"Entity_name": "a", "Entity_description": "b"}]}', "entity"),
    ('{"Entities": [{"Entity_name": "a", "Entity_description": "b", "Index": [0]}], "Relations": [{"Entity1": "a"}]}', "relation"), ("{", "unreadable"), ("", "unreadable"),
]


@pytest.mark.parametrize("text, want", VERDICTS)
def test_extraction(spark, text, want):
    assert one(spark, N.extraction_verdict(F.lit(text))) == want


def test_list_actions(spark):
    row = lambda s, e, score, i: ("7:1", 0, s, e, score, 0, [i], [s], [e])
    c = spark.createDataFrame([row(10.0, 20.0, 0.9, "b"), row(40.0, 50.0, 0.8, "d"), row(70.0, 80.0, 0.7, "f"), row(90.0, 95.0, 0.6, "g"), row(100.0, 110.0, 0.1, "h")], L.CHUNK)
    near = spark.createDataFrame([("7", "b", "a", 0.0, 10.0), ("7", "d", "b2", 20.0, 40.0), ("7", "f", "e", 50.0, 70.0)], "_store string, _end string, near_id string, os double, oe double")
    got = [(r.s, r.e, r.event_ids, round(r.score, 3)) for r in L.act(c, near, True).orderBy("s").collect()]
    # the weakest is dropped, each chunk gets the event before it, and what touches is merged
    assert got == [(0.0, 80.0, ["a", "b", "b2", "d", "e", "f"], 2.4), (90.0, 95.0, ["g"], 0.6)]
    sub = spark.createDataFrame([("7:1", 10.0, 20.0, 0.5, "b"), ("7:1", 300.0, 310.0, 0.5, "z"), ("8:1", 1.0, 2.0, 0.5, "q")], "list_id string, s double, e double, score double, event_id string")
    new = L.requery(c, sub).where("fresh").collect()
    assert [(r.s, r.event_ids, r.generation) for r in new] == [(300.0, ["z"], 1)]
    spans = spark.createDataFrame([("7", x, float(i), i + 1.0) for i, x in enumerate("bdfgh")], "group_id string, event_id string, s double, e double")
    m = L.merge_lists(c.withColumn("group_id", F.lit("7")), spans, 0.6, cap=2)
    assert sorted((r.event_id, r.score) for r in m.collect()) == [("b", 0.0), ("d", 0.0)]


def test_writers(spark, tmp_path):
    d = str(tmp_path)
    v = spark.createDataFrame([(1, "event", 1, [1.0, 2.0]), (2, "event", 2, [3.0, 4.0])], "store_no bigint, vec_kind string, id bigint, v array<float>")
    stores.write_vectors(v, f"{d}/v")
    stores.write_vectors(v.where("store_no = 2").withColumn("id", F.lit(9).cast("bigint")), f"{d}/v")
    assert sorted(r.id for r in stores.read_vectors(spark, f"{d}/v").collect()) == [1, 9]
    e = spark.createDataFrame([("Event-1", 'Entity-"x"&', 0.5)], "a string, b string, weight double")
    stores.write_graphml(spark.createDataFrame([("Event-1",), ("lone",)], "id string"), e, f"{d}/g.graphml.xml")
    nodes, edges = stores.read_graphml(spark, stores.find_graphml(spark, f"{d}/g"))
    assert {r.id for r in nodes.collect()} == {"Event-1", 'Entity-"x"&', "lone"} and [tuple(r) for r in edges.collect()] == [("Event-1", 'Entity-"x"&', 0.5)]
    with pytest.raises(FileNotFoundError):
        stores.find_graphml(spark, f"{d}/none")
    c = spark.createDataFrame([(1, 1.0, 2.0, ["a"], 7), (2, 1.0, 2.0, ["b"], 8)], "question_id bigint, s double, e double, event_ids array<string>, store_no bigint")
    stores.save_cache(c, f"{d}/cache")
    broken = next((tmp_path / "cache" / "store_no=8").glob("*.parquet"))
    broken.write_bytes(b"no parquet")
    next((tmp_path / "cache" / "store_no=8").glob(".*.crc")).unlink()
    assert [r.event_ids for r in stores.load_cache(spark, f"{d}/cache").collect()] == [["a"]]
    assert [stores.flush(c.select("question_id"), f"{d}/f", ["question_id"]) for _ in range(2)] == [2, 0]


def test_retry(spark):
    from tideline.functions.models import generate_with_retry

    df = spark.createDataFrame([(i, "x" * i, i) for i in range(6)], "k bigint, p string, response_no int")
    calls = lambda ps, k: [p.upper() if len(p) <= 2 * k else None for p in ps]
    got = {r.k: (r.response, r.fails) for r in generate_with_retry(df, ["k"], "p", calls, 3).collect()}
    assert got == {0: ("", 0), 1: ("X", 1), 2: ("XX", 1), 3: ("XXX", 2), 4: ("XXXX", 2), 5: (None, 3)}
    assert generate_with_retry(df.limit(0), ["k"], "p", calls, 3).count() == 0


def test_no_temporary_folder_on_a_cluster(monkeypatch):
    from tideline import session

    class Fake:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(RuntimeError):
        session._shared_dir(Fake)
