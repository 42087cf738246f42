import datetime

from tideline.plans import flow_queries as Q


def test_prompt_is_the_whole_caption(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    texts = ["A heron stands in the shallow water", "A heron stands in the tall reeds"]
    rows = [(1, i, f"Event-{i}", t, [float(i), i + 1.0], at) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "store_no bigint, pos bigint, id string, description string, duration array<double>, loaded_at timestamp").write.parquet(f"{tmp_path}/vdb_events.parquet")
    got = {r.pos: (r.prompt, r.response) for r in Q.generate_responses(spark, str(tmp_path)).collect()}
    assert got == {i: (t, t.upper()) for i, t in enumerate(texts)}
