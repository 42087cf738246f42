import os

import pytest

import __spark_entry__ as entry
from tideline.plans.base import events, seeds, store_questions, truth, vectors

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
NAMES = ["expand_two_hop", "leaf_overlap_two_level", "overlap_variants_frames", "overlap_variants_events", "frames_evidence_text", "interval_hit_gt", "vector_upsert", "filter_expressions", "graph_connected_components", "results_missing"]


@pytest.mark.parametrize("name", NAMES)
def test_a_query_takes_all_rows(spark, name):
    """A query gets every row of its input."""
    got = entry.queries()[name](spark, DATA)
    ev = events(spark, DATA)
    keys = lambda df, *c: {tuple(r) for r in df.select(*c).distinct().collect()}
    if name in ("overlap_variants_frames", "overlap_variants_events"):
        both = keys(truth(spark, DATA), "store_no", "question_id") & keys(seeds(spark, DATA), "store_no", "question_id")
        assert keys(got, "store_no", "question_id") == both
    elif name == "frames_evidence_text":
        assert keys(got, "store_no", "pos") == keys(ev, "store_no", "pos")
    elif name == "vector_upsert":
        assert keys(got, "vec_id") == keys(vectors(spark, DATA), "vec_id") and len(keys(got, "change")) == 3
    elif name == "leaf_overlap_two_level":
        assert keys(got, "store_no") == keys(seeds(spark, DATA), "store_no")
    elif name == "interval_hit_gt":
        assert keys(got, "store_no", "question_id") == keys(truth(spark, DATA), "store_no", "question_id")
    elif name == "filter_expressions":
        r = spark.read.parquet(f"{DATA}/responses.parquet")
        assert keys(got, "response_id") == keys(r.where("correct and method in ('tree', 'multimode') and latency_seconds between 1 and 20"), "response_id")
    elif name == "graph_connected_components":
        assert {n.split(":")[0] for (n,) in keys(got, "node")} == {str(s) for (s,) in keys(spark.read.parquet(f"{DATA}/vdb_entities.parquet").where("exists(events, x -> x is not null)"), "store_no") if s is not None}
    elif name == "results_missing":
        assert keys(got, "store_no") == keys(store_questions(spark, DATA), "store_no")
    else:
        assert keys(got, "store_no", "seed_id") == keys(ev, "store_no", "event_id")


def test_no_twin_takes_a_part_of_a_table():
    """No twin thins a table out by arithmetic on places or ids (a search set of every 50th id is a stated one)."""
    import re

    thin = re.compile(r"WHERE[^()]*\b(?:pos|ord|vec_id|store_no|doc_id|file_id)\s*%\s*(?!50\b)\d+\s*(?:=|<)", re.I)
    assert not [n for n, s in entry.oracle_sql().items() if thin.search(s)]
