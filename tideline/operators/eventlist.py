"""Algebra of scored event lists: insert, ordered merge, drop, context text, search paths.

The merge is an ordered fold and runs per list; lists are capped by the search (at most a few dozen
chunks), so a list is one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIST = ["list_id"]
CHUNK = "list_id string, chunk_no int, s double, e double, score double, generation int, event_ids array<string>, data_s array<double>, data_e array<double>"


def insert(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of ``new`` whose start is not in the list yet are added."""
    return chunks.unionByName(new.join(chunks.select("list_id", "s"), ["list_id", "s"], "left_anti"))


def fold(chunks: list[dict]) -> list[dict]:
    """Ordered merge of one list (by start, then end): a chunk that is contained in the last kept one is
    discarded with its score; one that touches or overlaps it is appended, scores add up, the
    generation is the larger, all its ids are appended although its leading data that start before the
    last end are not; if nothing starts later, no data are appended."""
    out: list[dict] = []
    for c in sorted(chunks, key=lambda x: (x["s"], x["e"])):
        if not out or out[-1]["e"] < c["s"]:
            out.append({k: (list(v) if isinstance(v, list) else v) for k, v in c.items()})
            continue
        last = out[-1]
        if last["e"] >= c["e"]:
            continue
        data = list(zip(c["data_s"], c["data_e"]))
        if last["e"] > c["s"]:
            at = next((i for i, (s, _) in enumerate(data) if s >= last["e"]), len(data))
            data = data[at:]
        last["data_s"] += [s for s, _ in data]
        last["data_e"] += [e for _, e in data]
        last["event_ids"] += list(c["event_ids"])
        last["score"] += c["score"]
        last["generation"] = max(last["generation"], c["generation"])
        last["e"] = c["e"]
    return out


def merge_adjacent(chunks: DataFrame) -> DataFrame:
    """:func:`fold` of every list, equal spans in order of their ids. Lists stream by in order, so a task holds one list at a time."""
    cols = [c.split()[0] for c in CHUNK.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for pdf in frames:
            out: list[dict] = []
            for r in zip(*(pdf[c] for c in cols)):
                row = {k: (list(v) if k in ("event_ids", "data_s", "data_e") else v) for k, v in zip(cols, r)}
                if held and held[0]["list_id"] != row["list_id"]:
                    out += [{**c, "chunk_no": i} for i, c in enumerate(fold(held))]
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=cols)
        yield pd.DataFrame([{**c, "chunk_no": i} for i, c in enumerate(fold(held))], columns=cols)

    return chunks.select(*cols).repartition("list_id").sortWithinPartitions("list_id", "s", "e", "event_ids").mapInPandas(run, CHUNK)


def act(chunks: DataFrame, near: DataFrame, forward: bool, ratio: float = 0.2) -> DataFrame:
    """The list actions: without the ``ratio`` of lowest score, with the neighbour of each chunk's first
    (``forward``: the event before it) or last event put to it, merged. ``near``: _store, _end (event), near_id, os, oe."""
    d = drop_lowest(chunks, ratio).withColumn("_store", F.substring_index("list_id", ":", 1)).withColumn("_end", F.element_at("event_ids", 1 if forward else -1))
    d = d.join(near, ["_store", "_end"], "left")
    put = lambda c, x: F.when(F.col("near_id").isNull(), F.col(c)).otherwise(F.concat(F.array(x), c) if forward else F.concat(c, F.array(x)))
    d = d.withColumns({"event_ids": put("event_ids", F.col("near_id")), "data_s": put("data_s", F.col("os")), "data_e": put("data_e", F.col("oe"))})
    d = d.withColumns({"s": F.element_at("data_s", 1), "e": F.element_at("data_e", -1)})
    return merge_adjacent(d)


def requery(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Answers of a sub-query (list_id, s, e, score, event_id) put into the lists as chunks of the next generation,
    those whose start is there already left out; ``fresh`` tells the new ones."""
    top = chunks.groupBy("list_id").agg((F.max("generation") + 1).alias("generation"))
    new = found.join(top, "list_id").select("list_id", F.lit(0).alias("chunk_no"), "s", "e", "score", "generation", F.array("event_id").alias("event_ids"), F.array("s").alias("data_s"), F.array("e").alias("data_e"))
    added = new.join(chunks.select("list_id", "s"), ["list_id", "s"], "left_anti").withColumn("fresh", F.lit(True))
    return chunks.withColumn("fresh", F.lit(False)).unionByName(added)


def merge_lists(chunks: DataFrame, spans: DataFrame, keep: float | None = None, cap: int = 1000) -> DataFrame:
    """Several lists of a group as one: the distinct events of the ``keep`` best of each list, at score 0, in order of
    start, at most ``cap``. ``chunks`` has group_id besides; ``spans``: group_id, event_id, s, e (unique)."""
    d = chunks if keep is None else drop_lowest(chunks, 1 - keep)
    ids = d.select("group_id", F.explode("event_ids").alias("event_id")).distinct()
    m = ids.join(spans, ["group_id", "event_id"]).withColumn("score", F.lit(0.0))
    return m.withColumn("_r", F.row_number().over(Window.partitionBy("group_id").orderBy("s", "event_id"))).where(F.col("_r") <= cap).drop("_r")


def drop_lowest(chunks: DataFrame, ratio: float | None = None, cap: int = 16) -> DataFrame:
    """Without the ``int(n * ratio)`` chunks of lowest score, or with the ``cap`` best ones."""
    w = Window.partitionBy("list_id")
    r = chunks.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("score"), "s")), "_n": F.count("*").over(w)})
    keep = F.col("_r") <= (F.lit(cap) if ratio is None else F.col("_n") - F.floor(F.col("_n") * ratio))
    return r.where(keep).drop("_r", "_n")


def context(chunks: DataFrame, limited: float = 0.75) -> DataFrame:
    """Text of the ``int(n * limited)`` best chunks of each list, in order of start."""
    w = Window.partitionBy("list_id")
    r = chunks.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("score"), "s")), "_n": F.count("*").over(w)}).where(F.col("_r") <= F.floor(F.col("_n") * limited))
    line = F.format_string("[%.1f-%.1f] %s", "s", "e", F.array_join("event_ids", ","))
    return r.groupBy("list_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", line.alias("t")))), lambda x: x["t"]), "\n").alias("information"), F.count("*").alias("n"))


def search_paths(spark, depth: int = 3) -> DataFrame:
    """Paths of the depth-limited search over answer (SA) and expansion actions: an answer is a leaf."""
    frontier = spark.range(1).select(F.lit("").alias("path"))
    leaves = None
    for d in range(1, depth + 1):  # a plan of fixed depth; each path grows by every action
        nxt = frontier.select("path", F.explode(F.array(*(F.lit(a) for a in ("SA", "RQ", "F", "B")))).alias("action"))
        nxt = nxt.select(F.when(F.col("path") == "", F.col("action")).otherwise(F.concat_ws(">", "path", "action")).alias("path"), "action")
        part = nxt.where("action = 'SA'").select("path", F.lit(d).alias("depth"))
        leaves = part if leaves is None else leaves.unionByName(part)
        frontier = nxt.where("action <> 'SA'").select("path")
    return leaves
