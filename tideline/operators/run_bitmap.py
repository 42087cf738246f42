"""Compressed run bitmaps: periods and gaps of interval sets.

Time is discretised into exact units (milliseconds) and cut into *time shards* of ``width``
units. The bits an owner sets in a shard are held as a run container: the sorted, disjoint,
non-touching ``[start, end)`` pairs of its set bits, as int64 bytes. Containers of the same
(owner, shard) are united; set runs are the periods, clear runs between them the gaps. Only the
first and last run of a shard can continue in another shard, so only those are compared along
the owner's shards. No task ever holds an owner whole.

Stages: map-side containers -> shuffle on (owner, shard) -> union -> shuffle of at most two edge
runs per (owner, shard) -> stitched periods and gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units in a time shard (2**20 ms, about 17 minutes), and the most shards a span is written into bit
#: by bit. Of a longer span only the first and last shard get bits; the shards between are one
#: *bridge*, a single run that covers them whole. Other spans and owners are not touched by it.
SHARD_WIDTH = 1 << 20
MAX_PIECES = 64
#: A bridge is a few blocks of FANOUT**level shards, by which the shards it covers are found with an equi-join.
FANOUT, LEVELS = 64, 8


# --- the container -------------------------------------------------------------------------


def merge_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite runs per group: overlapping, nested and touching runs become one. Returns
    (group, start, end) sorted. Groups are small ints."""
    if not len(group):
        return group, start, end
    order = np.lexsort((end, start, group))
    g, s, e = group[order], start[order], end[order]
    # running maximum of the ends within a group: groups are kept apart by an offset
    lo, span = int(s.min()), int(e.max()) - int(s.min()) + 2
    if span < (1 << 62) // (int(g.max()) + 2):
        top = np.maximum.accumulate(e - lo + g * span) - g * span + lo
    else:  # offsets would overflow: one group at a time
        top = np.concatenate([np.maximum.accumulate(x) for x in np.split(e, np.flatnonzero(np.diff(g)) + 1)])
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (s[1:] > top[:-1])
    at = np.flatnonzero(fresh)
    return g[at], s[at], top[np.append(at[1:] - 1, len(g) - 1)]


def pack_runs(start: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([start, end], axis=1).astype("<i8").tobytes()


def unpack_runs(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(buf, "<i8").reshape(-1, 2)
    return a[:, 0], a[:, 1]


def clear_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gaps between consecutive set runs."""
    return end[:-1], start[1:]


# --- stages ----------------------------------------------------------------------------------

_OUT = "owner_kind string, owner_key string, shard bigint, piece string, start_ms bigint, end_ms bigint"


def _owner_codes(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Small int per distinct (kind, key, shard) of a batch, with a first row index of each."""
    kind, key = batch.column("owner_kind"), batch.column("owner_key")
    k = kind.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    o = key.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return k * (int(o.max(initial=0)) + 1) + o, kind, key


def _containers(width: int):
    """mapInArrow: spans -> partial run containers per (owner, shard) of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            owner, kind, key = _owner_codes(b)
            s = b.column("s").to_numpy(zero_copy_only=False)
            e = b.column("e").to_numpy(zero_copy_only=False)
            first, last = s // width, (e - 1) // width
            far = last - first >= MAX_PIECES
            pieces = np.where(far, 2, last - first + 1)
            row = np.repeat(np.arange(len(s)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            shard = np.where(far[row] & (nth == 1), last[row], first[row] + nth)
            ps, pe = np.maximum(s[row], shard * width), np.minimum(e[row], (shard + 1) * width)
            both = np.stack([owner[row], shard], axis=1)
            uniq, code = np.unique(both, axis=0, return_inverse=True)
            code = code.reshape(-1)
            g, rs, re_ = merge_runs(code, ps, pe)
            cut = np.flatnonzero(np.diff(g)) + 1
            sample = np.empty(len(uniq), np.int64)
            sample[code] = row
            idx = pa.array(sample)
            runs = np.stack([rs, re_], axis=1).astype("<i8")
            bounds = np.concatenate([[0], cut, [len(g)]])
            yield pa.RecordBatch.from_arrays(
                [kind.take(idx), key.take(idx), pa.array(uniq[:, 1]), pa.array([runs[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())],
                ["owner_kind", "owner_key", "shard", "runs"],
            )

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over a partition sorted by (owner, shard): unite containers, emit final set and
    clear runs, and the first and last set run of each shard as ``edge``. The group at a batch's
    end is carried over, so memory stays at one batch plus one (owner, shard)."""

    def emit(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        kind, key, shard = (t.column(c).chunk(0) if t.column(c).num_chunks else pa.array([]) for c in ("owner_kind", "owner_key", "shard"))
        k = kind.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        o = key.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sh = shard.to_numpy(zero_copy_only=False)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | (sh[1:] != sh[:-1])
        code, at = np.cumsum(new) - 1, np.flatnonzero(new)
        bufs = t.column("runs").to_pylist()
        a = np.frombuffer(b"".join(bufs), "<i8").reshape(-1, 2)
        g, s, e = merge_runs(np.repeat(code, [len(x) // 16 for x in bufs]), a[:, 0], a[:, 1])
        head = np.ones(len(g), bool)
        head[1:] = g[1:] != g[:-1]
        tail = np.append(head[1:], True)
        inner = ~head & ~tail
        edge = ~inner
        gap = np.flatnonzero(~head)  # gap before each run but the first of its group
        piece = np.concatenate([np.full(inner.sum(), "period"), np.full(len(gap), "gap"), np.full(edge.sum(), "edge")])
        row = at[np.concatenate([g[inner], g[gap], g[edge]])]
        idx = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [kind.take(idx), key.take(idx), shard.take(idx), pa.array(piece.astype(object), pa.string()), pa.array(np.concatenate([s[inner], e[gap - 1], s[edge]])), pa.array(np.concatenate([e[inner], s[gap], e[edge]]))],
            ["owner_kind", "owner_key", "shard", "piece", "start_ms", "end_ms"],
        )

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        n = b.num_rows
        last = tuple(b.column(c)[n - 1].as_py() for c in ("owner_kind", "owner_key", "shard"))
        start = n
        while start and tuple(b.column(c)[start - 1].as_py() for c in ("owner_kind", "owner_key", "shard")) == last:
            start -= 1
        if start:
            yield emit(pa.Table.from_batches([*held, b.slice(0, start)]))
            held = [b.slice(start)]
        elif held and tuple(held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("owner_kind", "owner_key", "shard")) != last:
            yield emit(pa.Table.from_batches(held))
            held = [b]
        else:
            held.append(b)
    if held:
        yield emit(pa.Table.from_batches(held))


def to_units(seconds: Column, per_second: int = 1000) -> Column:
    """Seconds rounded to whole units; null for values that are not finite or do not fit."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(4.0e15 / per_second))
    return F.when(ok, F.round(seconds * per_second).cast("bigint"))


def spans_of(owner_kind: str, owner_key: Column, span: Column) -> list[Column]:
    """Projection to the span form of :func:`periods_and_gaps` from an ``array<double>`` pair."""
    two = F.size(span) == 2
    return [
        F.lit(owner_kind).alias("owner_kind"),
        owner_key.cast("string").alias("owner_key"),
        F.when(two, to_units(F.get(span, 0))).alias("s"),
        F.when(two, to_units(F.get(span, 1))).alias("e"),
    ]


def periods_and_gaps(spans: DataFrame, width: int = SHARD_WIDTH) -> DataFrame:
    """Continuous periods and the gaps between them, per owner.

    ``spans``: owner_kind string, owner_key string, s bigint, e bigint (units). A span counts if
    its owner and both ends are there and ``e > s``. Overlapping, nested and touching spans make
    one period. Repeated spans change nothing; an owner without a counting span has no row; an
    empty table gives an empty result; further columns are ignored.

    Returns owner_kind, owner_key, piece (``period`` or ``gap``), start_ms, end_ms.
    """
    spans = spans.select("owner_kind", "owner_key", "s", "e").where("owner_kind is not null and owner_key is not null and e > s")
    parts = spans.mapInArrow(_containers(width), "owner_kind string, owner_key string, shard bigint, runs binary")
    runs = (
        parts.repartition("owner_kind", "owner_key", "shard")
        .sortWithinPartitions("owner_kind", "owner_key", "shard")
        .mapInArrow(_united, _OUT)
    )
    first, last = F.floor(F.col("s") / F.lit(width)), F.floor((F.col("e") - 1) / F.lit(width))
    bridges = spans.where(last - first >= MAX_PIECES).select("owner_kind", "owner_key", (first + 1).cast("bigint").alias("a"), last.cast("bigint").alias("b")).distinct()
    some = bool(bridges.take(1))
    if some:
        runs = runs.join(_covered(runs, bridges), ["owner_kind", "owner_key", "shard"], "left_anti")
    edges = runs.where("piece = 'edge'").select("owner_kind", "owner_key", "shard", "start_ms", "end_ms")
    if some:
        edges = edges.unionByName(bridges.select("owner_kind", "owner_key", F.lit(None).cast("bigint").alias("shard"), (F.col("a") * width).alias("start_ms"), (F.col("b") * width).alias("end_ms")))
    w = Window.partitionBy("owner_kind", "owner_key").orderBy("start_ms", "end_ms")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = edges.select("*", before.alias("before"), F.lag("shard").over(w).alias("shard_before"))
    marked = marked.select(
        "*",
        (F.col("before").isNull() | (F.col("start_ms") > F.col("before"))).alias("fresh"),
    ).select("*", F.sum(F.col("fresh").cast("bigint")).over(upto).alias("island"))
    periods = (
        marked.groupBy("owner_kind", "owner_key", "island")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
        .select("owner_kind", "owner_key", F.lit("period").alias("piece"), "start_ms", "end_ms")
    )
    # between the two edges of one shard stand its own inner runs and gaps
    gaps = marked.where("fresh and before is not null and coalesce(shard <> shard_before, true)").select(
        "owner_kind", "owner_key", F.lit("gap").alias("piece"), F.col("before").alias("start_ms"), F.col("start_ms").alias("end_ms")
    )
    done = runs.where("piece <> 'edge'").select("owner_kind", "owner_key", "piece", "start_ms", "end_ms")
    return done.unionByName(periods).unionByName(gaps)


def blocks_of(a: int, b: int) -> list[tuple[int, int]]:
    """(level, block) of aligned blocks of FANOUT**level shards that make up the shards a .. b - 1."""
    out, level = [], 0
    while a < b:
        if level == LEVELS - 1:
            return out + [(level, x) for x in range(a, b)]
        while a < b and a % FANOUT:
            out.append((level, a))
            a += 1
        while a < b and b % FANOUT:
            b -= 1
            out.append((level, b))
        a, b, level = a // FANOUT, b // FANOUT, level + 1
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        kind, key, a, b = (c.to_pylist() for c in rb.columns)
        rows = [(k, o, lv, x) for k, o, i, j in zip(kind, key, a, b) for lv, x in blocks_of(i, j)]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["owner_kind", "owner_key", "level", "block"])


def _covered(runs: DataFrame, bridges: DataFrame) -> DataFrame:
    """Shards with runs that lie in a bridge: owner_kind, owner_key, shard."""
    full = bridges.mapInArrow(_blocks, "owner_kind string, owner_key string, level int, block bigint").distinct()
    powers = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(FANOUT**k).cast("bigint").alias("size")) for k in range(LEVELS)))
    asked = runs.select("owner_kind", "owner_key", "shard").distinct().select("*", F.explode(powers).alias("p"))
    asked = asked.select("owner_kind", "owner_key", "shard", F.col("p.level").alias("level"), F.expr("(shard - pmod(shard, p.size)) div p.size").alias("block"))
    return asked.join(full, ["owner_kind", "owner_key", "level", "block"], "left_semi").select("owner_kind", "owner_key", "shard").distinct()
