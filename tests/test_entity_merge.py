import datetime

from tideline.operators import ingest as G
from tideline.plans import flow_queries as Q


def test_large_groups_are_clustered_as_a_whole(spark):
    colours = ["red", "silver", "green", "black", "yellow", "white"]
    rows = [(1, f"Entity-{i:03}", "lamp", f"Lamp {colours[i % 6]} {colours[i // 6 % 6]} mark {i % 5}") for i in range(300)] + [(2, f"Entity-{i}", "jar", f"Jar {colours[i % 3]}") for i in range(9)]
    df = spark.createDataFrame(rows, "store_no bigint, entity_id string, name string, description string").repartition(3)
    plain = sorted(tuple(r) for r in G.merge_entities(df).collect())
    assert plain == sorted(tuple(r) for r in G.merge_entities(df, one_task=50).collect()) and len(plain) == 309
    assert len({m for s, _, m in plain if s == 1}) <= 120


def test_all_descriptions_of_all_rows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [("E1", 1, ["Lamp, red", "Lamp, tall"], at), ("E1", 1, ["Lamp, red", None, "Lamp, old"], at), ("E2", 1, [None], at), ("E3", 1, [], at), ("E4", 1, [None, "Jar, new"], at)]
    spark.createDataFrame(rows, "id string, store_no bigint, descriptions array<string>, loaded_at timestamp").write.parquet(f"{tmp_path}/vdb_entities.parquet")
    got = sorted(tuple(r) for r in Q._described(spark, str(tmp_path)).collect())
    assert got == [(1, "E1", "Lamp, old Lamp, red Lamp, tall", "lamp"), (1, "E4", "Jar, new", "jar")]
