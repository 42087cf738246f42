"""Bipartite event-entity expansion, hops with a trace, graph building and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import checkpointed


def entity_mediated(seeds: DataFrame, bridge: DataFrame) -> DataFrame:
    """Events that share an entity with a seed, each seed without itself: seed columns, entity_id, other_id.
    Only the seeds' entities are followed, so no group is paired with itself as a whole."""
    b = bridge.select("store_no", "entity_id", "event_id").distinct()
    first = seeds.join(b, ["store_no", "event_id"])
    return first.join(b.withColumnRenamed("event_id", "other_id"), ["store_no", "entity_id"]).where("other_id <> event_id")


def multi_hop(seeds: DataFrame, step: DataFrame, hops: int) -> DataFrame:
    """Trace of an expansion: store_no, seed_id, hop, parent, child.

    ``seeds``: store_no, seed_id. ``step``: store_no, a, b (distinct directed edges). Each hop follows the
    nodes found last; nodes already in the seed's pool are not found again. A node that several parents
    reach in one hop belongs to the largest of them. Lineage is cut after each hop with a reliable checkpoint."""
    pool = seeds.select("store_no", "seed_id", F.col("seed_id").alias("node")).distinct()
    last, trace = pool, None
    for h in range(1, hops + 1):
        reach = last.join(step, (step["store_no"] == last["store_no"]) & (step["a"] == last["node"])).select(last["store_no"], "seed_id", F.col("node").alias("parent"), F.col("b").alias("child"))
        new = reach.join(pool.withColumnRenamed("node", "child"), ["store_no", "seed_id", "child"], "left_anti")
        new = checkpointed(new.groupBy("store_no", "seed_id", "child").agg(F.max("parent").alias("parent")))
        part = new.select("store_no", "seed_id", F.lit(h).alias("hop"), "parent", "child")
        trace = part if trace is None else trace.unionByName(part)
        last = new.select("store_no", "seed_id", F.col("child").alias("node"))
        pool = pool.unionByName(last)
        if h < hops and not new.take(1):
            break
    return trace


def selective(candidates: DataFrame, scores: DataFrame, scored: DataFrame, least: float) -> DataFrame:
    """Candidates (store_no, event_id, ...) whose event scores ``least`` or more (``scores``: store_no, event_id, best);
    all of a store that is not in ``scored`` (store_no), as there is nothing to choose by."""
    good = candidates.join(scores.where(F.col("best") >= least).select("store_no", "event_id"), ["store_no", "event_id"], "left_semi")
    return good.unionByName(candidates.join(scored, "store_no", "left_anti").select(*good.columns))


def reachable(trace: DataFrame) -> DataFrame:
    """All nodes of a trace (store_no, seed_id, hop, parent, child) that hang together with its seed, the seed
    included: store_no, seed_id, node, hop. Rows whose parent is not reached are left out."""
    depth = trace.agg(F.max("hop")).first()[0] or 0
    got = trace.select("store_no", "seed_id").distinct().select("store_no", "seed_id", F.col("seed_id").alias("node"), F.lit(0).alias("hop"))
    last = got
    for h in range(1, depth + 1):
        step = trace.where(F.col("hop") == h).select("store_no", "seed_id", F.col("parent").alias("node"), "child")
        last = last.join(step, ["store_no", "seed_id", "node"]).select("store_no", "seed_id", F.col("child").alias("node"), F.lit(h).alias("hop"))
        got = got.unionByName(last)
    return got.groupBy("store_no", "seed_id", "node").agg(F.min("hop").alias("hop"))


def expand_hops(seeds: DataFrame, step, hops: int) -> DataFrame:
    """:func:`multi_hop` where ``step`` is a function: from (store_no, seed_id, node) to (store_no, seed_id, node, child),
    so that only what the last hop found is followed."""
    pool = seeds.select("store_no", "seed_id", F.col("seed_id").alias("node")).distinct()
    last, trace = pool, None
    for h in range(1, hops + 1):
        reach = step(last).withColumnRenamed("node", "parent")
        new = reach.join(pool.withColumnRenamed("node", "child"), ["store_no", "seed_id", "child"], "left_anti")
        new = checkpointed(new.groupBy("store_no", "seed_id", "child").agg(F.max("parent").alias("parent")))
        part = new.select("store_no", "seed_id", F.lit(h).alias("hop"), "parent", "child")
        trace = part if trace is None else trace.unionByName(part)
        last = new.select("store_no", "seed_id", F.col("child").alias("node"))
        pool = pool.unionByName(last)
        if h < hops and not new.take(1):
            break
    return trace


def dedup_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One edge per unordered pair, the one of lowest priority number, self loops included.
    ``edges``: keys, a, b, kind, prio."""
    canon = edges.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", "prio")
    return canon.groupBy(*keys, "a", "b").agg(F.min_by("kind", F.struct("prio", "kind")).alias("kind"))


SALTS = 16


def _meet(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the row of ``low`` (u, m), the pairs of one node spread over SALTS parts."""
    a = pairs.withColumn("_z", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    b = low.withColumn("_z", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return a.join(b, ["u", "_z"]).drop("_z")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: node, component (its smallest node), by alternating large-star and
    small-star rounds, whose number grows with the logarithm of the graph, until nothing changes. Pairs
    are kept in a table that is checkpointed each round; the driver only sees a count and a hash of it.

    Nodes with very many neighbours are pre-aggregated map-side (a minimum), never gathered; where the pairs
    of such a node meet its minimum, they are dealt to SALTS parts of it."""
    e = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null").distinct())
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    before = None
    while True:
        both = e.where("u <> v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours point to the smallest
        big = _meet(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and its smaller neighbours point to the smallest of them
        down = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m2 = down.groupBy("u").agg(F.min("v").alias("m"))
        e = checkpointed(_meet(down, m2).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m2.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
