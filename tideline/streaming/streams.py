"""Structured Streaming forms of the order-dependent operators.

Each runs to the end of what is there (``availableNow``) and leaves a table in the shared folder; with
another trigger the same plans run on. Windowed forms run in append mode: a window is written once, when
the watermark has passed it, and its state is dropped; rows that come later than the watermark allows
are left out. ``windows_of`` ends with a row far in the future, after all others, which closes the last
windows of a table that is read as a stream. Running aggregates run in update mode: the last row of a key counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.cache import IN, Cache, queries_of
from tideline.session import scratch_dir

#: How late a row may come.
LATE = "1 hour"
#: Owner and time (ms) of the row that closes an input.
END_OWNER, END_MS = -(1 << 62), 32_503_680_000_000


def source(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A parquet table as a stream of its files, in order of their age."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


_EVENT = "store_no bigint, pos bigint, ms bigint, me bigint"


def windows_of(events: DataFrame, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """All windows that ``build`` makes of a stream of events (store_no, pos, ms, me), the last ones included: the stream
    is drained first; then the row that closes the input comes in by a second source, and the query goes on
    from its checkpoint."""
    spark = events.sparkSession
    end, out, check = (scratch_dir(spark, f"{name}{x}") for x in ("-end", "", "-checkpoint"))
    spark.createDataFrame([], _EVENT).write.parquet(end)
    stream = build(events.select("store_no", "pos", "ms", "me").unionByName(source(spark, end)))
    for last in (False, True):
        if last:
            spark.createDataFrame([(END_OWNER, 0, END_MS, END_MS + 1)], _EVENT).coalesce(1).write.mode("append").parquet(end)
        stream.writeStream.outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    # the closing row is taken out here: within the stream a filter would go below the watermark that it is to move
    return spark.read.schema(stream.schema).parquet(out).where(F.col("store_no") != END_OWNER)


def drained(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream to the end of its input; in append mode the table has all rows, in update mode the last row of
    each of ``keys``."""
    spark = stream.sparkSession
    out, check = scratch_dir(spark, name), scratch_dir(spark, f"{name}-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True)
    if mode == "update":

        def keep(df: DataFrame, batch: int) -> None:
            df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

        writer.foreachBatch(keep).start().awaitTermination()
        schema = spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0)).schema
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out) if _exists(spark, out) else spark.createDataFrame([], schema)
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, *(F.col(f"x.{c}") for c in rest))
    writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def gap_clusters(events: DataFrame, gap_ms: int, late: str = LATE) -> DataFrame:
    """Clusters of spans at most ``gap_ms`` apart as session windows with a dynamic gap.
    ``events``: store_no, ms, me."""
    rows = events.select("store_no", F.timestamp_millis("ms").alias("ts"), F.concat((F.col("me") - F.col("ms") + gap_ms + 1).cast("string"), F.lit(" milliseconds")).alias("gap"))
    w = rows.withWatermark("ts", late).groupBy("store_no", F.session_window("ts", F.col("gap")).alias("w")).count()
    return w.select("store_no", F.unix_millis("w.start").alias("s"), (F.unix_millis("w.end") - (gap_ms + 1)).alias("e"), F.col("count").alias("n"))


def sliding_counts(events: DataFrame, length: str, slide: str, late: str = LATE) -> DataFrame:
    """Events per sliding chunk."""
    rows = events.select("store_no", F.timestamp_millis("ms").alias("ts"))
    w = rows.withWatermark("ts", late).groupBy("store_no", F.window("ts", length, slide).alias("w")).count()
    return w.select("store_no", F.unix_millis("w.start").alias("s"), F.col("count").alias("n"))


def running_tracks(detections: DataFrame) -> DataFrame:
    """First, last and number of frames of each track so far."""
    return detections.groupBy("store_no", "entity_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("frame").alias("total_frames"))


_OUT = "store_no bigint, question_id bigint, n_seeds bigint, n_reused bigint, n_covered bigint, cache_size bigint, a string, b string"
_ENTRY = "s double, e double, time double, ids array<string>, starts array<double>, ends array<double>"
#: State store with list state: new entries are appended, old ones are not written again.
LIST_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _CacheProcessor(StatefulProcessor):
    """Cache entries of a store as a list."""

    def __init__(self, gap: float, least: float, budget: int, final_gap: float):
        self.rules = (gap, least, budget, final_gap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", _ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cache = Cache()
        if self.entries.exists():
            for s, e, time, ids, starts, ends in self.entries.get():
                cache.add(s, e, list(zip(starts, ends, ids)), time)
        known = len(cache.entries)
        pdf = pd.concat(list(rows))
        pdf = pdf.astype({"seed_id": object}).where(pdf.notna(), None)
        pdf["neighbour"] = pdf["seed_id"].map(lambda x: x is not None)
        pdf["by"] = pdf["seed_id"].map(lambda x: x or "")
        pdf = pdf.sort_values(["question_id", "neighbour", "rnk", "by", "event_id"])
        out = [{"store_no": s, "question_id": q} | query.answer(cache, *self.rules) for s, q, query in queries_of(pdf[IN])]
        new = [(float(s), float(e), float(t), [m[2] for m in ms], [float(m[0]) for m in ms], [float(m[1]) for m in ms]) for s, e, ms, t in cache.entries[known:]]
        if new:
            self.entries.appendList(new)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def keyed_cache(rows: DataFrame, gap: float = 30.0, least: float = 0.5, budget: int = 8, final_gap: float = 30.0) -> DataFrame:
    """The cross-query cache as keyed list state: queries of a store that arrive together are answered in order of
    question_id against the state, to which the new entries are appended. ``rows``: as for the batch form.
    The session's state store must be LIST_STATE."""
    return rows.select(*IN).groupBy("store_no").transformWithStateInPandas(statefulProcessor=_CacheProcessor(gap, least, budget, final_gap), outputStructType=_OUT, outputMode="Append", timeMode="None")


def drained_cache(rows: DataFrame, name: str = "cache") -> DataFrame:
    """:func:`keyed_cache` run to the end of its input, with its state store."""
    spark, setting = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, LIST_STATE)
    try:
        return drained(keyed_cache(rows), "append", name)
    finally:
        spark.conf.set(setting, before)
