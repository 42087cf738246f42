"""Vector search and vector-collection operators.

Searches answer a stated set of query vectors against all rows. Up to ``BLOCK`` queries are broadcast
and the rows scanned once; more queries are cut into blocks that are shuffled against blocks of rows, so
that a task holds one block of each, whatever the number of either. Every task keeps its best ``k`` per
query with matrix products, and these few candidates are ranked in a window. No pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast: with 1,000 dimensions 16 MB. Beyond, queries and rows of a block (with 128
#: dimensions 16 and 64 MB).
BLOCK = 2048
QUERY_BLOCK, ROW_BLOCK = 16_384, 65_536


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit vector; components of a zero vector become null (there is no direction). The length is worked
    out once: it is bound to a one-element array whose only element the outer lambda runs over."""
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.try_divide(x, n))), F.lit(0))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    return F.try_divide(dot(a, b), (norm(a) + eps) * (norm(b) + eps))


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix (they have one length)."""
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class _Best:
    """The ``k`` best rows of each query so far."""

    def __init__(self, qids: np.ndarray, qv: np.ndarray, k: int, least: float | None, metric: str, eps: float, decimals: int):
        self.qids, self.qv, self.k, self.least, self.metric, self.eps, self.decimals = qids, qv, k, least, metric, eps, decimals
        self.qn = np.linalg.norm(qv, axis=1) + eps
        self.s, self.i = np.zeros((len(qids), 0)), np.zeros((len(qids), 0), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(64, (2 << 20) // max(1, len(self.qids)))  # a block of similarities is about 16 MB
        for at in range(0, len(ids), step):
            sim = self.qv @ x[at : at + step].T
            if self.metric == "cosine":
                sim /= self.qn[:, None] * (np.linalg.norm(x[at : at + step], axis=1) + self.eps)
            s = np.concatenate([self.s, sim], axis=1)
            i = np.concatenate([self.i, np.broadcast_to(ids[at : at + step], sim.shape)], axis=1)
            if s.shape[1] > self.k:
                # all that tie with the k-th are kept by rounding down to it, then ranked exactly
                r = s.round(self.decimals)
                last = np.partition(r, r.shape[1] - self.k, axis=1)[:, -self.k]
                width = int((r >= last[:, None]).sum(axis=1).max())
                pick = np.argpartition(-r, width - 1, axis=1)[:, :width] if width < r.shape[1] else np.broadcast_to(np.arange(r.shape[1]), r.shape)
                r, s, i = (np.take_along_axis(a, pick, 1) for a in (r, s, i))
                order = np.lexsort((i, -r), axis=1)[:, : self.k]
                s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            self.s, self.i = s, i

    def rows(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        s, i = self.s.reshape(-1), self.i.reshape(-1)
        keep = np.ones(len(s), bool) if self.least is None else s >= self.least
        return pa.array(np.repeat(self.qids, self.s.shape[1])[keep]), pa.array(i[keep]), pa.array(s[keep])


_FOUND = "qid bigint, part string, vec_id bigint, sim double"


class _Parts:
    """:class:`_Best` of each part of the rows that is asked for."""

    def __init__(self, qids: np.ndarray, qv: np.ndarray, ks: dict[str, int], *how):
        self.best = {p: _Best(qids, qv, k, *how) for p, k in ks.items()}

    def add(self, parts: pa.Array, ids: np.ndarray, x: np.ndarray) -> None:
        names = np.array(parts.to_pylist(), object)
        for p, best in self.best.items():
            mine = names == p
            if mine.all():
                best.add(ids, x)
            elif mine.any():
                best.add(ids[mine], x[mine])

    def table(self) -> pa.Table:
        out = []
        for p, best in self.best.items():
            q, i, s = best.rows()
            out.append(pa.table([q, pa.array([p] * len(q), pa.string()), i, s], ["qid", "part", "vec_id", "sim"]))
        return pa.concat_tables(out)


def _scanned(block, *how):
    """mapInArrow over rows: the best of a partition for a broadcast block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Parts(*block.value, *how)
        for b in batches:
            if b.num_rows:
                best.add(b.column(2), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(b.column(1)))
        yield from best.table().to_batches()

    return run


def _met(*how):
    """Cogrouped (rows, queries) of a pair of blocks: the best rows of each query."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        qids, qv = np.zeros(0, np.int64), np.zeros((0, 1))
        if rows.num_rows and queries.num_rows:
            rows, queries = rows.combine_chunks(), queries.combine_chunks()
            qids, qv = queries.column("qid").to_numpy().astype(np.int64), _matrix(queries.column("qv").chunk(0))
        best = _Parts(qids, qv, *how)
        if len(qids):
            best.add(rows.column("part"), rows.column("vec_id").to_numpy().astype(np.int64), _matrix(rows.column("rv").chunk(0)))
        return best.table()

    return run


def search_parts(rows: DataFrame, queries: DataFrame, ks: dict[str, int], least: float | None = None, metric: str = "cosine", eps: float = 0.0, decimals: int = 9) -> DataFrame:
    """:func:`search` in several parts of the rows at once: the ``ks[part]`` most similar rows of each query in every part,
    by one scan. ``rows`` has a string ``part`` besides. Returns qid, part, vec_id, sim, rnk."""
    spark, how = rows.sparkSession, (ks, least, metric, eps, decimals)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "v", "part").where(F.col("part").isin(list(ks)))
    queries = queries.select(F.col("qid").cast("bigint").alias("qid"), "v")
    few = queries.limit(BLOCK + 1).toArrow().sort_by("qid")
    if few.num_rows <= BLOCK:
        if not few.num_rows:
            return spark.createDataFrame([], _FOUND + ", rnk int")
        block = (few.column("qid").to_numpy().astype(np.int64), _matrix(few.column("v").combine_chunks()))
        out = rows.mapInArrow(_scanned(spark.sparkContext.broadcast(block), *how), _FOUND)
    else:
        n_q, n_r = queries.count(), rows.count()
        qs, rs = -(-n_q // QUERY_BLOCK), max(1, -(-n_r // ROW_BLOCK))
        cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        a = rows.select(cell("vec_id", rs).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qs - 1))).alias("qb"), "vec_id", F.col("v").alias("rv"), "part")
        b = queries.select(F.explode(F.sequence(F.lit(0), F.lit(rs - 1))).alias("rb"), cell("qid", qs).alias("qb"), "qid", F.col("v").alias("qv"))
        out = a.groupBy("rb", "qb").cogroup(b.groupBy("rb", "qb")).applyInArrow(_met(*how), _FOUND)
    w = Window.partitionBy("qid", "part").orderBy(F.desc(F.round("sim", decimals)), "vec_id")
    most = F.lit(0)
    for part, k in ks.items():
        most = F.when(F.col("part") == part, F.lit(k)).otherwise(most)
    top = out.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= max(ks.values()))
    return top if len(set(ks.values())) == 1 else top.where(F.col("rnk") <= most)


def search(rows: DataFrame, queries: DataFrame, k: int, least: float | None = None, metric: str = "cosine", eps: float = 0.0, decimals: int = 9) -> DataFrame:
    """The ``k`` most similar rows of each query: qid, vec_id, sim, rnk.

    ``rows`` (vec_id, v) and ``queries`` (qid, v) hold usable vectors of one dimension. Order is
    similarity (to ``decimals``) descending, then vec_id; with ``least`` rows below it are left out.
    A query finds itself if it is among the rows. No queries or no rows give an empty result."""
    return search_parts(rows.select("vec_id", "v", F.lit("all").alias("part")), queries, {"all": k}, least, metric, eps, decimals).drop("part")


def _summed(n_keys: int):
    """mapInArrow over (keys, v): sums of the unit vectors of each key within a batch, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(n_keys))
            norm_ = np.linalg.norm(x, axis=1)
            codes = pa.table([pa.StructArray.from_arrays(b.columns[:n_keys], b.schema.names[:n_keys])], ["k"]).column("k").combine_chunks()
            seen: dict = {}
            g = np.array([seen.setdefault(tuple(r.values()), len(seen)) for r in codes.to_pylist()])
            first = np.unique(g, return_index=True)[1]
            good = norm_ > 0
            total = np.zeros((len(first), x.shape[1]))
            np.add.at(total, g[good], x[good] / norm_[good, None])
            n = np.bincount(g[good], minlength=len(first))
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * x.shape[1]), pa.array(total.reshape(-1)))
            yield pa.RecordBatch.from_arrays([c.take(pa.array(first)) for c in b.columns[:n_keys]] + [pa.array(n), v], [*b.schema.names[:n_keys], "n", "v"])

    return run


def mean_content(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the unit vectors of each key, scaled to length 1: keys, n, v. Zero vectors have no direction
    and do not count. Sums are formed per batch before they are shuffled, one row per key and batch."""
    kinds = dict(rows.dtypes)
    parts = rows.select(*keys, F.col("v").cast("array<double>").alias("v")).mapInArrow(_summed(len(keys)), ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", n bigint, v array<double>")
    add = lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.zip_with(a, x, lambda p, q: p + q))
    one = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.aggregate(F.collect_list("v"), F.array().cast("array<double>"), add).alias("v"))
    return one.withColumn("_norm", norm(F.col("v"))).withColumn("v", F.transform("v", lambda x: F.try_divide(x, F.col("_norm")))).drop("_norm")


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``base`` with the values of ``changes`` where it has the key (null included), and its
    new rows. Keys are unique in either."""
    b = base.select(key, *columns, F.lit(True).alias("_b"))
    c = changes.select(key, *(F.col(x).alias(f"_n_{x}") for x in columns), F.lit(True).alias("_c"))
    out = b.join(c, key, "full_outer")
    return out.select(key, *(F.when(F.col("_c"), F.col(f"_n_{x}")).otherwise(F.col(x)).alias(x) for x in columns), F.when(F.col("_b") & F.col("_c"), "updated").when(F.col("_c"), "inserted").otherwise("kept").alias("change"))
