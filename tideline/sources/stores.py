"""Readers and sinks of the file forms of a timeline store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.structural_json import OPEN_OBJ, _clean, _questions, _scalar, _slices, _videos
from tideline.session import checkpointed


def read_vector_collection(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Vector collection files (embedding_dim, data, matrix as base64 float32): one row per vector with
    its file, place, id, metadata as JSON and components. Several files are read side by side; with
    ``lines`` a file has a collection per line."""
    raw = spark.read.option("multiLine", not lines).schema("embedding_dim int, data array<map<string,string>>, matrix string").json(path)
    width = F.col("embedding_dim") * 4
    # the matrix is decoded once and cut inside its row: exploded rows that carried it whole would grow with the square of a collection
    cut = lambda m: F.transform("data", lambda meta, i: F.struct(i.cast("bigint").alias("pos"), meta.alias("meta"), F.substring(m, i * width + 1, width).alias("v")))
    one = raw.select(F.input_file_name().alias("file"), F.explode(F.get(F.transform(F.array(F.unbase64("matrix")), cut), F.lit(0))).alias("x")).select("file", "x.*")

    @F.pandas_udf("array<float>")
    def floats(v):
        return v.map(lambda b: np.frombuffer(b, "<f4"))

    return one.select("file", "pos", F.coalesce(F.element_at("meta", "id"), F.element_at("meta", "__id__")).alias("id"), F.to_json("meta").alias("meta"), floats("v").alias("v"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file. End points of edges count as nodes; a node's kind follows from
    its prefix; an edge without a readable weight has 0."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data array<struct<_key:string,_VALUE:string>>").load(path)
    e = edges.select(F.col("_source").alias("a"), F.col("_target").alias("b"), F.coalesce(F.get("data", F.lit(0))["_VALUE"].try_cast("double"), F.lit(0.0)).alias("weight"))
    ids = nodes.select(F.col("_id").alias("id")).unionByName(e.select(F.col("a").alias("id"))).unionByName(e.select(F.col("b").alias("id"))).distinct()
    kind = F.when(F.startswith("id", F.lit("Event-")), "event").when(F.startswith("id", F.lit("Entity-")), "entity").otherwise("other")
    return ids.select("id", kind.alias("kind")), e


def write_vectors(df: DataFrame, path: str) -> None:
    """Vector collections (store_no, vec_kind, id, v) in their native form: parquet by store and kind, written whole or
    not at all; a store that is written again replaces itself alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store_no", "vec_kind").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Components in a document of an exchange file (2 MB, 4,096 vectors of 128); what is larger is written in parts.
PART_VALUES = 1 << 19


def export_vector_collections(df: DataFrame, path: str, part_values: int = PART_VALUES) -> None:
    """Vector collections (store_no, vec_kind, id, v) as exchange files: one JSON line per store, kind and width with
    embedding_dim, data and a base64 float32 matrix. A collection of more than ``part_values`` components is written in
    parts of about that size, each a line and a whole collection document, told apart by ``part`` (a hash of the id), so
    no task holds a collection. Vectors stand in order of id in a line."""
    keys = ["store_no", "vec_kind", "dim", "part"]
    rows = df.select("store_no", "vec_kind", "id", F.col("v").cast("array<float>").alias("v"), F.size("v").alias("dim"))
    large = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in keys[:3])).agg(F.count("*").alias("_n"))
    large = large.select("*", F.ceil(F.col("_n") * F.col("_dim") / part_values).alias("_parts")).where("_parts > 1")  # at most one row per part_values components
    part = F.coalesce(F.pmod(F.xxhash64("id"), "_parts"), F.lit(0).cast("bigint")).alias("part")
    rows = rows.join(F.broadcast(large), F.expr(" and ".join(f"{c} <=> _{c}" for c in keys[:3])), "left").select(*keys[:3], part, "id", "v")
    rows.repartition(*keys).sortWithinPartitions(*keys, "id").select(*keys, F.col("id").cast("string").alias("id"), "v").mapInArrow(_documents, "value string").write.mode("overwrite").text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON documents of rows (store_no, vec_kind, dim, part, id, v) that are sorted by the first four."""
    import base64
    import json

    def document(key: tuple, ids: list, pieces: list) -> str:
        head = {"store_no": key[0], "vec_kind": key[1], "part": key[3], "embedding_dim": key[2], "data": [{"__id__": str(i), "id": str(i)} for i in ids]}
        return json.dumps(head | {"matrix": base64.b64encode(b"".join(pieces)).decode()})

    now, ids, pieces = None, [], []
    for rb in batches:
        keys = list(zip(*(rb.column(i).to_pylist() for i in range(4))))
        names, v = rb.column(4).to_pylist(), rb.column(5)
        flat, at = np.asarray(v.flatten(), "<f4"), np.concatenate(([0], np.cumsum([k[2] for k in keys])))
        done, a = [], 0
        for b in range(1, len(keys) + 1):
            if b < len(keys) and keys[b] == keys[a]:
                continue
            if keys[a] != now:
                if now is not None:
                    done.append(document(now, ids, pieces))
                now, ids, pieces = keys[a], [], []
            ids += names[a:b]
            pieces.append(flat[at[a] : at[b]].tobytes())
            a = b
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["value"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([document(now, ids, pieces)], pa.string())], ["value"])


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph (nodes: id; edges: a, b, weight) as a folder of GraphML files, each a whole document of some of its nodes
    and edges, so that writing is spread over tasks."""
    from xml.sax.saxutils import quoteattr

    lines = nodes.select(F.lit("n").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w")).unionByName(
        edges.select(F.lit("e").alias("kind"), "a", "b", F.col("weight").cast("double").alias("w"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
        some = False
        for rb in batches:
            rows = [] if some else ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml><key id="d0" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">']
            for kind, a, b, w in zip(*(c.to_pylist() for c in rb.columns)):
                rows.append(f"<node id={quoteattr(a)}/>" if kind == "n" else f'<edge source={quoteattr(a)} target={quoteattr(b)}><data key="d0">{w}</data></edge>')
            some = True
            yield out(rows)
        if some:
            yield out(["</graph></graphml>"])

    lines.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def find_graphml(spark: SparkSession, path: str) -> str:
    """The GraphML file of a store: ``path`` with .graphml or, if that is missing, .graphml.xml."""
    for end in ("", ".graphml", ".graphml.xml"):
        p = spark._jvm.org.apache.hadoop.fs.Path(path + end)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path + end
    raise FileNotFoundError(path)


def save_cache(entries: DataFrame, path: str) -> None:
    """Cross-query cache as a parquet table, one folder per store; written whole or not at all, and a store that is saved
    again replaces itself alone."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store_no").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """A saved cache; a missing one is empty, and so is every file of it that cannot be read."""
    schema = "question_id bigint, s double, e double, event_ids array<string>, store_no bigint"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)


def write_results(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Results with one row per key, the last by ``order``, written whole or not at all."""
    rest = [c for c in df.columns if c not in keys]
    df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, *(F.col(f"x.{c}") for c in rest)).write.mode("overwrite").parquet(path)


def flush(df: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key is not in the table yet, and tell how many: a run that was cut off goes on where it was."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    new = checkpointed(df.join(spark.read.parquet(path).select(*key), key, "left_anti") if there else df)
    new.write.mode("append").parquet(path)
    return new.count()


def report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A report as CSV with a header, as JSON lines or as text lines, by all tasks; a small report is one file by its plan."""
    w = df.write.mode("overwrite")
    {"csv": lambda: w.option("header", True).csv(path), "json": lambda: w.json(path), "text": lambda: w.text(path)}[form]()


_QUESTION = ["video_key", "question_id", "text", "answer", "time_reference", "question_type", "options"]
_QSCHEMA = "file_id bigint, video_no bigint, question_no bigint, " + ", ".join(f"{c} string" for c in _QUESTION)


def _question_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), [_clean(x) for x in b.column(1).to_pylist()]
        for i, j in _slices([len(t) for t in texts]):
            rows = []
            keys = {(t, v): k for t, v, k in _video_keys(texts[i:j])}
            for f in _questions(texts[i:j]):
                if not len(f.nodes):
                    continue
                get = {k: f.idx.member(f.nodes, k) for k in ("question_id", "uid", "query", "question", "answer", "time_reference", "question_type", "options")}
                text = lambda k, r: _scalar(f.idx, get[k][r]) if get[k][r] >= 0 else None  # noqa: B023, E731
                raw = lambda k, r: f.idx.raw_text(get[k][r]).decode("utf-8", "replace") if get[k][r] >= 0 and not f.idx.is_null(get[k][r : r + 1])[0] else None  # noqa: B023, E731
                for r, (t, v, q) in enumerate(f.tags.tolist()):
                    kind = text("question_type", r) if get["question_type"][r] < 0 or f.idx.kind[get["question_type"][r]] <= 2 else raw("question_type", r)
                    rows.append((ids[i + t], v, q, keys.get((t, v)), text("question_id", r) or text("uid", r), text("query", r) or text("question", r), text("answer", r), text("time_reference", r), kind, raw("options", r)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]], ["file_id", "video_no", "question_no", *_QUESTION])


def _video_keys(texts: list[bytes]) -> Iterator[tuple[int, int, str | None]]:
    """(text, video place, key) of the videos of some texts."""
    for f in _videos(texts):
        f = f.take(f.idx.kind[f.nodes] == OPEN_OBJ)
        if len(f.nodes):
            names = [f.idx.member(f.nodes, k) for k in ("video_key", "key")]
            for r, (t, v) in enumerate(f.tags.tolist()):
                yield t, v, next((s for m in names if m[r] >= 0 and (s := _scalar(f.idx, m[r])) is not None), None)


def _video_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), [_clean(x) for x in b.column(1).to_pylist()]
        for i, j in _slices([len(t) for t in texts]):
            rows = [(ids[i + t], v, k) for t, v, k in _video_keys(texts[i:j])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["file_id", "video_no", "video_key"])


def video_keys(files: DataFrame) -> DataFrame:
    """Key of each video of question files of any layout: file_id, video_no, video_key."""
    return _spread(files).mapInArrow(_video_batches, "file_id bigint, video_no bigint, video_key string").where("video_key is not null")


def placed_questions(files: DataFrame) -> DataFrame:
    """Questions of question files of any layout, one row each, with the key of their video (null if it has
    none); options and lists of types as JSON text."""
    return _spread(files).mapInArrow(_question_batches, _QSCHEMA)


def _spread(files: DataFrame) -> DataFrame:
    """Payloads; of a table with fewer splits than there are cores (so at most a few GB) dealt to all cores, as reading
    them is work."""
    f = files.where("file_id is not null and payload is not null").select("file_id", "payload")
    cores = files.sparkSession.sparkContext.defaultParallelism
    return f.repartition(cores) if f.rdd.getNumPartitions() < cores // 2 else f


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [_clean(x) for x in b.column(1).to_pylist()]
        for i, j in _slices([len(t) for t in texts]):
            keys = {(t, v): k for t, v, k in _video_keys(texts[i:j])}
            n: dict[str, int] = {}
            for f in _questions(texts[i:j]):
                for t, v, _ in f.tags.tolist():
                    if (k := keys.get((t, v))) is not None:
                        n[k] = n.get(k, 0) + 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["video_key", "n"])


def question_counts(files: DataFrame) -> DataFrame:
    """Number of questions of each video: video_key, n."""
    return _spread(files).mapInArrow(_count_batches, "video_key string, n bigint").groupBy("video_key").agg(F.sum("n").alias("n"))


def questions(files: DataFrame) -> DataFrame:
    """Questions of question files of any layout, one row each; options and lists of types as JSON text.
    Question text with options inside is split at the ``(A)`` line into ``stem`` and ``inline_options``."""
    q = placed_questions(files).drop("video_key")
    stem = F.regexp_extract("text", "(?s)^(.*?)(?:\\n\\(A\\).*)?$", 1)
    return q.withColumns({"stem": F.trim(stem), "inline_options": F.regexp_extract("text", "(?s)\\n(\\(A\\).*)$", 1)})
