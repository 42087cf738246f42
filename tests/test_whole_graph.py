import datetime

from tideline.plans import graph_queries as Q

SCHEMA = "store_no bigint, id string, events array<string>, loaded_at timestamp"


def union_find(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def test_components_of_every_store(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(s, f"Entity-{i:02}", [f"Event-{j:02}" for j in range(40) if (i * 7 + j * 11 + s) % 13 == 0], at) for s in (1, 2, 5) for i in range(30)]
    rows += [(1, "Entity-x", ["Event-x", "Event-y", None], at), (1, "Entity-z", ["Event-y"], at), (2, "Entity-n", None, at)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/vdb_entities.parquet")
    got = {r.node: r.component for r in Q.graph_connected_components(spark, str(tmp_path)).collect()}
    assert got == union_find([(f"{s}:{v}", f"{s}:{i}") for s, i, events, _ in rows for v in events or [] if v])
    assert {n.split(":")[0] for n in got} == {"1", "2", "5"} and got["1:Entity-z"] == got["1:Event-x"]
