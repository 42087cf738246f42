import json

import numpy as np

from tideline.sources import stores


def _collections(spark, n):
    rng = np.random.default_rng(3)
    rows = [(1, "event", i, [float(x) for x in rng.random(4, "f4")]) for i in range(n)] + [(2, "frame", n, [1.0, 2.0, 3.0, 4.0]), (2, "frame", n + 1, [5.0, 6.0])]
    return rows, spark.createDataFrame(rows, "store_no bigint, vec_kind string, id bigint, v array<float>")


def test_a_large_collection_is_written_in_parts(spark, tmp_path):
    """No line holds much more than the size of a part; a small collection is one line; nothing is lost."""
    rows, df = _collections(spark, 3000)
    stores.export_vector_collections(df, str(tmp_path / "c"), part_values=1024)
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert max(len(d["data"]) for d in docs) < 2 * 1024 // 4 and len({d["part"] for d in docs if d["store_no"] == 1}) == 12
    assert sorted((d["embedding_dim"], [x["id"] for x in d["data"]]) for d in docs if d["store_no"] == 2) == [(2, ["3001"]), (4, ["3000"])]
    assert all([int(x["id"]) for x in d["data"]] == sorted(int(x["id"]) for x in d["data"]) for d in docs)
    got = {int(r.id): list(r.v) for r in stores.read_vector_collection(spark, str(tmp_path / "c"), lines=True).collect()}
    assert got == {i: v for _, _, i, v in rows}


def test_vectors_do_not_carry_their_matrix(spark, tmp_path):
    """Rows of a collection are cut from its matrix before they are exploded: no exploded row holds the matrix."""
    _, df = _collections(spark, 50)
    stores.export_vector_collections(df, str(tmp_path / "c"))
    plan = stores.read_vector_collection(spark, str(tmp_path / "c"), lines=True)._jdf.queryExecution().optimizedPlan().toString()
    above, _, generate = plan.partition("Generate ")
    assert generate.count("unbase64") == 1 and "matrix" in generate and "unbase64" not in above and "matrix" not in above and " m#" not in above + generate
    dropped = generate.splitlines()[0].rsplit("), ", 1)[1]
    assert dropped.startswith("[0, 1, 2]")  # no column of the line goes on beside the vector
