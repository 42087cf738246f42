"""Items packed into containers of fixed capacity by the sum-of-squares rule.

Online packing: ``N[h]`` counts the open containers that are filled to level ``h``. Each item goes to
the level (or into a new container) for which the sum of the squared counts afterwards is smallest;
ties go to the fullest result. The squares keep all levels supplied, so that containers close full.
An item above the capacity fills containers of its own; only its rest is placed like other items.

Items are dealt by a hash of their key into shards of bounded size that are packed side by side, so
a container never depends on more than its shard. The few containers left open by the shards of a
group are then packed once more as items, which can only reduce their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import checkpointed

#: Items of a shard, on average. Shards grow in number with the input, not in size.
SHARD_ITEMS = 20_000
#: Shards whose open containers are packed together.
GROUP_SHARDS = 64


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(container of each item, fill of each container). Sizes are 1..capacity."""
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    where: list[int] = []
    big = np.int64(1) << 40
    cost_from = np.zeros(capacity + 1, np.int64)  # change by taking a container from level h
    cost_from[1:] = big
    cost_to = np.ones(capacity + 1, np.int64)  # change by adding one to level h
    cost_to[capacity] = 0
    for s in sizes:
        total = cost_to[s:] + cost_from[: capacity - s + 1]
        h = capacity - s - int(np.argmin(total[::-1]))
        if h:
            c = open_at[h].pop()
            count[h] -= 1
            cost_from[h] = 1 - 2 * count[h] if count[h] else big
            cost_to[h] = 2 * count[h] + 1
        else:
            c = len(fills)
            fills.append(0)
        to = h + s
        fills[c] = to
        where.append(c)
        if to < capacity:
            open_at[to].append(c)
            count[to] += 1
            cost_from[to] = 1 - 2 * count[to]
            cost_to[to] = 2 * count[to] + 1
    return where, fills


_PARTS = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("part", pa.int32()), ("size", pa.int64()), ("box", pa.int64()), ("fill", pa.int64())])


def _pack_shard(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        rows = sorted(zip(t.column("doc").to_pylist(), t.column("size").to_pylist()), key=lambda r: (r[0] is None, r[0], r[1]))
        doc, part, size = [], [], []
        for d, n in rows:
            k = 0
            while n > capacity:
                doc.append(d)
                part.append(k)
                size.append(capacity)
                n, k = n - capacity, k + 1
            doc.append(d)
            part.append(k)
            size.append(n)
        some = [i for i, s in enumerate(size) if s]
        where, fills = sum_of_squares([size[i] for i in some], capacity)
        box = [0] * len(size)  # items without tokens take no room: they go with the first container
        for i, c in zip(some, where):
            box[i] = c
        fill = [fills[c] if fills else 0 for c in box]
        return pa.Table.from_arrays([pa.array([shard] * len(doc), pa.int64()), *(pa.array(x, f.type) for x, f in zip((doc, part, size, box, fill), list(_PARTS)[1:]))], schema=_PARTS)

    return run


def _pack_open(capacity: int):
    """Containers left open by the shards of a group, packed together: (shard, box) -> (shard, box)."""
    schema = pa.schema([("shard", pa.int64()), ("box", pa.int64()), ("to_shard", pa.int64()), ("to_box", pa.int64()), ("to_fill", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("shard", "box", "fill"))), key=lambda r: (-r[2], r[0], r[1]))
        where, fills = sum_of_squares([r[2] for r in rows], capacity)
        first: dict[int, tuple[int, int]] = {}
        out = []
        for (s, b, _), c in zip(rows, where):
            to = first.setdefault(c, (s, b))
            out.append((s, b, *to, fills[c]))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int, n_items: int | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign items to containers of ``capacity``.

    ``items``: an integer key and a size. Returns doc_id, part, n_tokens, container_id, fill: one row
    per item, or per part of an item larger than the capacity (parts from 0, all but the last full).
    ``fill`` is what the row's container holds. Null and negative sizes count as 0; items of size 0
    take no room and go with the first container of their shard. Repeated keys are items of their
    own. An empty table gives an empty result. ``n_items`` saves counting.
    """
    n = items.count() if n_items is None else n_items
    shards = max(1, -(-n // shard_items))
    dealt = items.select(
        F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("bigint").alias("shard"), F.col(key).cast("bigint").alias("doc"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size")
    )
    # one small row per item, read twice: written once, so that no shard is packed again
    packed = checkpointed(dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), "shard bigint, doc bigint, part int, size bigint, box bigint, fill bigint"))
    opened = packed.where(f"fill between 1 and {capacity - 1}").groupBy("shard", "box").agg(F.max("fill").alias("fill"))
    moved = (
        opened.withColumn("grp", F.floor(F.col("shard") / GROUP_SHARDS))
        .groupBy("grp")
        .applyInArrow(lambda t: _pack_open(capacity)(t.select(["shard", "box", "fill"])), "shard bigint, box bigint, to_shard bigint, to_box bigint, to_fill bigint")
    )
    joined = packed.join(moved, ["shard", "box"], "left")
    box_id = F.coalesce("to_shard", "shard") * F.lit(1 << 24) + F.coalesce("to_box", "box")
    return joined.select(
        F.col("doc").alias("doc_id"), "part", F.col("size").alias("n_tokens"), box_id.alias("container_id"), F.coalesce("to_fill", "fill").alias("fill")
    )


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row that shows what a packing keeps and how tight it is: items (rows), tokens, containers, least_containers
    (tokens over capacity, rounded up: no packing needs fewer), fill_share, overfull (containers above
    the capacity), wrong_fill (containers whose rows do not add up to their fill), split_items (items in
    several parts) and wrongly_split (those that would fit one container)."""
    box = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.max("fill").alias("fill"), F.count("*").alias("rows"))
    a = box.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("items"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count_if(F.col("t") > 0).alias("containers"),
        F.count_if(F.col("t") > capacity).alias("overfull"), F.count_if(F.col("t") != F.col("fill")).alias("wrong_fill"),
    )
    cut = packed.where("part > 0").select("doc_id").distinct()
    whole = packed.join(cut, "doc_id", "left_semi").groupBy("doc_id").agg(F.sum("n_tokens").alias("t"))
    b = whole.agg(F.count("*").alias("split_items"), F.count_if(F.col("t") <= capacity).alias("wrongly_split"))
    least = F.ceil(F.col("tokens") / capacity).cast("bigint")
    return a.join(b, F.lit(True)).select("items", "tokens", "containers", least.alias("least_containers"), F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("fill_share"), "overfull", "wrong_fill", "split_items", "wrongly_split")
