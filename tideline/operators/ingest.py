"""Ingestion: semantic chunking, entity merging, formatting of extractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.models import hash_embedder, word_overlap
from tideline.operators.ordering import BLOCK, prev_next
from tideline.session import checkpointed

LIMIT, LONGEST = 0.65, 8


def _recall(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(b) if b else 0.0


def greedy_chunks(words: list[frozenset], limit: float = LIMIT, longest: int = LONGEST) -> list[tuple[int, int]]:
    """Left-to-right partition: from ``a`` the chunk grows while it is shorter than ``longest``, the mean
    of all its pair scores and the score of its last pair exceed ``limit``."""
    out, a = [], 0
    while a < len(words):
        b, total, pairs = a + 1, 0.0, 0
        while b < len(words) and b - a < longest:
            add = [_recall(words[i], words[b]) for i in range(a, b)]
            if not ((total + sum(add)) / (pairs + len(add)) > limit and add[-1] > limit):
                break
            total, pairs, b = total + sum(add), pairs + len(add), b + 1
        out.append((a, b))
        a = b
    return out


def semantic_chunks(events: DataFrame) -> DataFrame:
    """Greedy chunks of each store: store_no, first_pos, last_pos, n.

    ``events``: store_no, pos, description. A pair whose own score is at most the limit always ends a
    chunk, so a store falls into independent stretches at such pairs. Stretches are found by windows in
    blocks and worked on as sorted streams; memory is one stretch's open chunk. Null captions share no
    words and stand alone."""
    rows = prev_next(events.select("store_no", "pos", F.coalesce("description", F.lit("")).alias("d")), "store_no", "pos", "d")
    bar = F.col("prev_d").isNull() | (word_overlap(F.col("prev_d"), F.col("d")) <= LIMIT)
    rows = rows.select("store_no", "pos", "d", F.when(bar, F.col("pos")).alias("at"), F.floor(F.col("pos") / BLOCK).alias("b"))
    w = Window.partitionBy("store_no", "b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy("store_no").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("store_no", "b").agg(F.max("at").alias("m")).select("store_no", "b", F.max("m").over(wb).alias("before"))
    rows = rows.withColumn("inner", F.max("at").over(w)).join(carried, ["store_no", "b"]).select("store_no", F.coalesce("inner", "before").alias("stretch"), "pos", "d")
    rows = rows.repartition("store_no", "stretch").sortWithinPartitions("store_no", "stretch", "pos")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        held: list[tuple] = []
        for pdf in frames:
            out = []
            for store, stretch, pos, d in pdf.itertuples(index=False):
                if held and held[0][:2] != (store, stretch):
                    out += close(held)
                    held = []
                held.append((store, stretch, pos, frozenset(x for x in re.split(r"[\W_]+", d.lower()) if x)))
                if len(held) > 64 * LONGEST:  # chunks that cannot change any more
                    cut = greedy_chunks([h[3] for h in held])[-2][1]
                    out += close(held[:cut])
                    held = held[cut:]
            yield frame(out)
        yield frame(close(held))

    def close(held: list[tuple]) -> list[tuple]:
        return [(held[a][0], held[a][2], held[b - 1][2], b - a) for a, b in greedy_chunks([h[3] for h in held])]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["store_no", "first_pos", "last_pos", "n"]).astype("int64")

    return rows.mapInPandas(run, "store_no bigint, first_pos bigint, last_pos bigint, n bigint")


#: Entities of one name from which on a group is clustered by all tasks together; rounds of the clustering.
ONE_TASK, ROUNDS, DIM = 2000, 8, 32


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centre of each row (squared Euclidean distance; ties to the first), in bounded blocks."""
    step, norm = max(1, (2 << 20) // len(c)), (c**2).sum(axis=1)
    return np.concatenate([np.argmin((norm - 2 * (x[i : i + step] @ c.T)).round(9), axis=1) for i in range(0, len(x), step)])


def _merged_together(e: DataFrame, k: int) -> DataFrame:
    """One large group, by Lloyd rounds over all tasks: only the centres meet on the driver."""
    sc = e.sparkSession.sparkContext
    c = np.array([r["v"] for r in e.orderBy("h", "entity_id").limit(k).select("v").collect()], float)
    cols = [f"s{i}" for i in range(DIM)]

    def sums(centres):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    x = np.array(pdf["v"].tolist(), float)
                    yield pd.DataFrame(x, columns=cols).assign(label=_nearest(x, centres.value), n=1).groupby("label", as_index=False).sum()[["label", "n", *cols]]

        return run

    def labels(centres):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    yield pdf[["store_no", "entity_id"]].assign(label=_nearest(np.array(pdf["v"].tolist(), float), centres.value))

        return run

    for _ in range(ROUNDS - 1):
        part = e.select("v").mapInPandas(sums(sc.broadcast(c)), "label bigint, n bigint, " + ", ".join(f"{x} double" for x in cols))
        got = part.groupBy("label").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in cols)).toPandas()
        c[got["label"].to_numpy()] = (got[cols].to_numpy() / got[["n"]].to_numpy()).round(9)
    out = e.select("store_no", "entity_id", "v").mapInPandas(labels(sc.broadcast(c)), "store_no bigint, entity_id string, label bigint")
    return out.join(out.groupBy("label").agg(F.min("entity_id").alias("merged_id")), "label").select("store_no", "entity_id", "merged_id")


def merge_entities(entities: DataFrame, share: float = 0.4, seed: int = 3, one_task: int = ONE_TASK) -> DataFrame:
    """Entities of like description in one store put together: store_no, entity_id, merged_id.

    ``entities``: store_no, entity_id, name, description. Only entities of one name are compared; of each
    such group ``max(1, int(share * n))`` clusters are formed by k-means on hashed embeddings. A group of
    more than ``one_task`` entities is clustered as a whole too, by all tasks, with the same result.
    ``merged_id`` is the smallest id of a cluster."""
    v = F.coalesce(hash_embedder(DIM)(F.col("description")), F.array_repeat(F.lit(0.0).cast("float"), DIM))
    e = entities.select("store_no", "entity_id", "name", v.alias("v"), F.xxhash64("entity_id", F.lit(seed)).alias("h"))
    large = entities.groupBy("store_no", "name").agg(F.count("*").alias("n")).where(F.col("n") > one_task).collect()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "entity_id"])
        x = np.array(pdf["v"].tolist(), float)
        k = max(1, int(share * len(x)))
        c = x[:k].copy()
        for left in range(ROUNDS - 1, -1, -1):
            label = _nearest(x, c)
            if left:
                n = np.bincount(label, minlength=k)
                total = np.zeros_like(c)
                np.add.at(total, label, x)
                c = np.where(n[:, None] > 0, (total / np.maximum(n, 1)[:, None]).round(9), c)
        ids = pdf["entity_id"].to_numpy()
        first = pd.Series(ids).groupby(label).transform("min")
        return pd.DataFrame({"store_no": pdf["store_no"].to_numpy(), "entity_id": ids, "merged_id": first.to_numpy()})

    if not large:
        return e.groupBy("store_no", "name").applyInPandas(one, "store_no bigint, entity_id string, merged_id string")
    e = checkpointed(e)
    keys = F.broadcast(e.sparkSession.createDataFrame([(r["store_no"], r["name"]) for r in large], "store_no bigint, name string"))
    out = e.join(keys, ["store_no", "name"], "left_anti").groupBy("store_no", "name").applyInPandas(one, "store_no bigint, entity_id string, merged_id string")
    for r in large:
        out = out.unionByName(_merged_together(e.where((F.col("store_no") == r["store_no"]) & (F.col("name") == r["name"])), max(1, int(share * r["n"]))))
    return out


def merged_payload(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Entities of each group as one: keys, new_id, members, descriptions (the first of each, in order of id),
    timestamps and frame_indices (distinct, sorted), durations (by start) and events (repetitions kept).
    ``entities``: keys, entity_id, descriptions, timestamps, frame_indices, durations, events. Nulls are left out."""
    first = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("entity_id", F.get("descriptions", F.lit(0)).alias("d")))), lambda x: x["d"].isNotNull()), lambda x: x["d"])
    flat = lambda c: F.filter(F.flatten(F.collect_list(c)), lambda x: x.isNotNull())
    g = entities.groupBy(*keys).agg(
        F.count("*").alias("members"), first.alias("descriptions"), F.array_sort(F.array_distinct(flat("timestamps"))).alias("timestamps"), F.array_sort(F.array_distinct(flat("frame_indices"))).alias("frame_indices"),
        F.array_sort(flat("durations")).alias("durations"), flat("events").alias("events"),
    )
    return g.withColumn("new_id", F.concat(F.lit("Entity-"), F.md5(F.array_join("descriptions", ""))))


def rewritten(relations: DataFrame, merged: DataFrame) -> DataFrame:
    """Relations (store_no, entity1, entity2, ...) with both ends put to the merged entities (``merged``: store_no,
    entity_id, merged_id); ends that were not merged stay."""
    out = relations
    for end in ("entity1", "entity2"):
        to = merged.select("store_no", F.col("entity_id").alias(end), F.col("merged_id").alias("_to"))
        out = out.join(to, ["store_no", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out


def formatted_entities(extracted: DataFrame) -> DataFrame:
    """Entities of an extraction (store_no, event_id, place, name, description, index, timestamps), formatted: entity_id
    from name and description, stamps at the indices that exist; without a stamp dropped; the first of each name."""
    n = F.size("timestamps")
    stamps = F.transform(F.filter("index", lambda i: (i >= 0) & (i < n)), lambda i: F.get("timestamps", i))
    e = extracted.withColumn("stamps", stamps).where("size(stamps) > 0 and name is not null and description is not null")
    first = F.row_number().over(Window.partitionBy("store_no", "event_id", "name").orderBy("place"))
    e = e.withColumn("_r", first).where("_r = 1").drop("_r")
    return e.withColumn("entity_id", F.concat(F.lit("Entity-"), F.md5(F.concat("name", "description"))))


def formatted_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations by name (store_no, event_id, name1, name2, description) between formatted entities of the event; those with
    an end that is none of them, or with both ends the same, are dropped."""
    one = lambda k: entities.select("store_no", "event_id", F.col("name").alias(f"name{k}"), F.col("entity_id").alias(f"entity{k}"))
    r = relations.where("name1 <> name2").join(one(1), ["store_no", "event_id", "name1"]).join(one(2), ["store_no", "event_id", "name2"])
    return r.withColumn("relation_id", F.concat(F.lit("Relation-"), F.md5(F.concat("name1", "name2", "description"))))


def extraction_verdict(text):
    """``ok``, or what is wrong first with an extraction's JSON: ``unreadable``, ``empty`` (no entities), ``entity`` (one
    without a name, description or list of whole numbers), ``relation`` (one without both ends or a description)."""
    p = F.from_json(text, "Entities array<struct<Entity_name:string,Entity_description:string,Index:array<int>>>, Relations array<struct<Entity1:string,Entity2:string,Relation_description:string>>", {"allowSingleQuotes": "false"})
    e, r = p["Entities"], p["Relations"]
    bad_e = F.exists(e, lambda x: x["Entity_name"].isNull() | x["Entity_description"].isNull() | x["Index"].isNull() | F.exists(x["Index"], lambda i: i.isNull()))
    bad_r = F.exists(r, lambda x: x["Entity1"].isNull() | x["Entity2"].isNull() | x["Relation_description"].isNull())
    return F.when(e.isNull(), "unreadable").when(F.size(e) == 0, "empty").when(F.coalesce(bad_e, F.lit(True)), "entity").when(F.coalesce(bad_r, F.lit(False)), "relation").otherwise("ok")
