"""Exploration of a store's graph by shape: energies, strategies, triggers, and pruning that keeps what connects.

Edges: store_no, a, b, kind. Energies are of a bounded scale, so thresholds hold for stores of any size.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trust in an edge by how it was found. Fixed values.
TRUST = {"event_to_object": 0.9, "object_to_event": 0.9, "vector_event": 0.5, "vector_object": 0.6, "context_event_to_event": 0.7, "context_relation": 0.8, "mutual_object_link": 0.85}
#: Which of these the edge kinds of the graph are.
KINDS = {"belong_to": "event_to_object", "event_time_relation": "context_event_to_event", "relation": "context_relation"}
#: Least energies of terminals and of nodes that stay (event, object); sizes from which on a graph is pruned, and the most
#: nodes of a subgraph; longest path between terminals and the most nodes of a graph in which paths are looked for.
TERMINAL, STAYS = (0.7, 0.6), (0.3, 0.25)
MOST_EVENTS, MOST_OBJECTS, MOST_EDGES, MOST_NODES = 50, 100, 300, 200
LONGEST_PATH, PATH_NODES = 4, 300
ITERATIONS, STRIKES = 10, 3


def is_event(node: Column) -> Column:
    return node.startswith("Event-")


def energies(edges: DataFrame) -> DataFrame:
    """Energy of every node: the trust of its edges over that of the most trusted node of its sort in the store."""
    trust = F.coalesce(F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(k), F.lit(TRUST[v]))))[F.col("kind")], F.lit(0.5))
    ends = edges.select("store_no", F.explode(F.array("a", "b")).alias("node"), trust.alias("t"))
    per = ends.groupBy("store_no", "node").agg(F.round(F.sum("t"), 6).alias("t"))
    top = per.groupBy("store_no", is_event(F.col("node")).alias("ev")).agg(F.max("t").alias("top"))
    return per.withColumn("ev", is_event(F.col("node"))).join(top, ["store_no", "ev"]).select("store_no", "node", "ev", (F.col("t") / F.col("top")).alias("energy"))


def damped(energy: Column, iteration: int) -> Column:
    return energy / math.log(iteration + 2)


def by_sort(ev: Column, pair: tuple[float, float]) -> Column:
    return F.when(ev, F.lit(pair[0])).otherwise(F.lit(pair[1]))


def triggers(edges: DataFrame, energy: DataFrame) -> DataFrame:
    """Sizes of every store's graph and whether it is to be pruned."""
    n = energy.groupBy("store_no").agg(F.count_if("ev").alias("events"), F.count_if(~F.col("ev")).alias("objects"))
    m = edges.groupBy("store_no").agg(F.count("*").alias("edges"))
    big = (F.col("events") > MOST_EVENTS) | (F.col("objects") > MOST_OBJECTS) | (F.col("edges") > MOST_EDGES)
    return n.join(m, "store_no").select("store_no", "events", "objects", "edges", big.alias("prune"))


def strategy(r: Column, d: Column, v: Column) -> Column:
    """What a graph's shape calls for, in this order of precedence."""
    return F.when(r > 1.2, "GROUNDING").when(r < 0.6, "BRIDGING").when((d > 0.3) & (v < 0.05), "LEAPING").when(d < 0.1, "TRIANGULATION").otherwise("BALANCED")


def articulation_points(near: dict[str, set[str]]) -> set[str]:
    """Nodes whose removal takes a part of the graph apart, by one depth-first walk with a stack."""
    found, order, low = set(), {}, {}
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, children = [(root, None, iter(sorted(near[root])))], 0
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other not in order:
                    order[other] = low[other] = len(order)
                    stack.append((other, node, iter(sorted(near[other]))))
                    children += node == root
                    break
                if other != parent:
                    low[node] = min(low[node], order[other])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if parent != root and low[node] >= order[parent]:
                        found.add(parent)
        if children > 1:
            found.add(root)
    return found


def on_short_paths(near: dict[str, set[str]], terminals: set[str], longest: int = LONGEST_PATH) -> set[str]:
    """Nodes on shortest paths of at most ``longest`` steps between terminals."""

    def distances(start: str) -> dict[str, int]:
        seen, ring = {start: 0}, [start]
        for d in range(1, longest + 1):
            ring = sorted({o for x in ring for o in near[x]} - seen.keys())
            seen.update((x, d) for x in ring)
        return seen

    reach = {t: distances(t) for t in sorted(terminals)}
    out = set()
    for t, far in reach.items():
        for u in terminals:
            if t < u and (whole := far.get(u, longest + 1)) <= longest:
                out |= {x for x, d in far.items() if d + reach[u].get(x, longest + 1) == whole}
    return out - terminals


def prune_graph(nodes: dict[str, tuple[bool, float, bool]], pairs: list[tuple[str, str]]) -> tuple[dict[str, str], int]:
    """(what each kept node is, iterations) of one subgraph. ``nodes``: whether an event, energy, whether a seed.

    Each iteration damps the energies and removes weak nodes that are neither terminals nor on a critical path
    (articulation points and short paths between terminals); it ends early when the size stays the same for
    STRIKES iterations."""
    kept, same, t = dict(nodes), 0, 0
    roles: dict[str, str] = {}
    for t in range(1, ITERATIONS + 1):
        near: dict[str, set[str]] = {n: set() for n in kept}
        for a, b in pairs:
            if a in kept and b in kept and a != b:
                near[a].add(b)
                near[b].add(a)
        terminals = {n for n, (ev, energy, seed) in kept.items() if seed or energy >= TERMINAL[0 if ev else 1]}
        bridges = articulation_points(near) - terminals
        if len(kept) <= PATH_NODES:
            bridges |= on_short_paths(near, terminals)
        left = {n: x for n, x in kept.items() if n in terminals or n in bridges or round(x[1] / math.log(t + 2), 9) >= STAYS[0 if x[0] else 1]}
        same = same + 1 if len(left) == len(kept) else 0
        kept = left
        roles = {n: "terminal" if n in terminals else "bridge" if n in bridges else "strong" for n in kept}
        if same == STRIKES:
            break
    return roles, t


def pruned(edges: DataFrame, energy: DataFrame, seeds: DataFrame) -> DataFrame:
    """Kept nodes of every store's subgraph of its MOST_NODES best nodes: store_no, node, role, iterations. A task holds
    one subgraph, which is bounded."""
    e = energy.join(seeds.select("store_no", "node").distinct().withColumn("seed", F.lit(True)), ["store_no", "node"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    w = Window.partitionBy("store_no").orderBy(F.desc("seed"), F.desc(F.round("energy", 9)), "node")
    best = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= MOST_NODES).select("store_no", "node", "ev", "energy", "seed")
    some = edges.select("store_no", "a", "b").join(best.select("store_no", F.col("node").alias("a")), ["store_no", "a"], "left_semi").join(best.select("store_no", F.col("node").alias("b")), ["store_no", "b"], "left_semi")
    rows = best.select("store_no", "node", "ev", "energy", "seed", F.lit(None).cast("string").alias("b")).unionByName(some.select("store_no", F.col("a").alias("node"), F.lit(None).cast("boolean").alias("ev"), F.lit(None).cast("double").alias("energy"), F.lit(None).cast("boolean").alias("seed"), "b"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        edge = pdf["b"].notna()
        nodes = {n: (bool(v), float(x), bool(s)) for n, v, x, s in zip(*(pdf.loc[~edge, c] for c in ("node", "ev", "energy", "seed")))}
        roles, t = prune_graph(nodes, list(zip(pdf.loc[edge, "node"], pdf.loc[edge, "b"])))
        return pd.DataFrame({"store_no": pdf["store_no"].iloc[0], "node": list(roles), "role": list(roles.values()), "iterations": t})

    return rows.groupBy("store_no").applyInPandas(one, "store_no bigint, node string, role string, iterations int")
