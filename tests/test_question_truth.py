import datetime
import json

from tideline.plans import eval_queries as Q


def test_segments_come_from_the_questions(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    ask = lambda *refs: [{"question_id": i, "query": "Where?", "time_reference": r} for i, r in enumerate(refs)]
    files = [
        (1, json.dumps([{"video_key": "a", "qa": ask("0:10-0:20", "5,1:30", None, "N/A", "0:20-0:10")}])),
        (2, json.dumps({"videos": [{"key": "b", "qa": json.dumps(ask("1:00-2:00"))}, {"video_key": "unknown", "qa": ask("0:01")}]})),
        (3, None),
    ]
    spark.createDataFrame(files, "file_id bigint, payload string").write.parquet(f"{tmp_path}/qa_files.parquet")
    spark.createDataFrame([(1, "a"), (2, "b")], "store_no bigint, video_key string").write.parquet(f"{tmp_path}/video_stores.parquet")
    events = [(1, 0, "Event-a", "x", [12.0, 13.0], at), (2, 0, "Event-b", "y", [130.0, 140.0], at)]
    spark.createDataFrame(events, "store_no bigint, pos bigint, id string, description string, duration array<double>, loaded_at timestamp").write.parquet(f"{tmp_path}/vdb_events.parquet")
    rows = lambda q: sorted(tuple(r) for r in q(spark, str(tmp_path)).collect())
    assert rows(Q.question_segments) == [(1, 1, 0, 0, 0, 10, 20), (1, 1, 0, 1, 0, 5, 6), (1, 1, 0, 1, 1, 90, 91), (2, 2, 0, 0, 0, 60, 120)]
    assert rows(Q.question_segments_hit) == [(1, 1, 0, 0, True), (1, 1, 0, 1, False), (2, 2, 0, 0, False)]
    refs = Q.time_ref_questions(spark, str(tmp_path)).collect()
    assert len(refs) == 8 and sum(r.seg is None for r in refs) == 3
