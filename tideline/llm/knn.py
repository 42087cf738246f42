"""Most similar vectors for every vector, by balanced posting lists.

Index (on the driver, from a bounded sample): a hierarchical, balanced clustering gives the heads of
posting lists; a neighbour graph over the heads is searched from a few entry points down to the nearest
heads of any vector. Both are broadcast. Every vector of the table is then posted to the list of its
nearest head and, if it lies near a boundary, to further lists (replication); as a query it probes the
lists whose head is not much farther than its nearest (distance-ratio pruning).

Lists grow in number with the table, up to ``HEADS``; from there on they grow in length up to
``CELL_MAX`` vectors, and then in number again. A list longer than ``LIST_LIMIT`` is split where it is
searched, by an index of its own, so that the work per vector does not grow with the length of lists.

Lists are packed into shards of neighbouring lists, so that a vector travels to the one or two shards
that hold its lists, once each, whatever the number of its lists. A task holds one shard. Within it each
list is one matrix product of its probing vectors with its posted ones; similarities that matter are
computed again in double precision. A vector's answers from its shards are merged by key.

Vectors of equal direction (rounded in double precision) always travel together and are searched once.
Large groups of copies, float noise included, are found beforehand by a hash of the rounded direction;
their ``k + 1`` smallest ids travel, and the others have the answer of the last of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.vector import search
from tideline.session import checkpointed

#: Vectors of a list on average, and the length from which on a list is split where it is searched.
LIST_SIZE, LIST_LIMIT = 128, 1024
#: Heads of the broadcast index before lists grow longer, and the most vectors of a list: beyond
#: HEADS * CELL_MAX vectors there are more heads again (one for CELL_MAX vectors).
HEADS, CELL_MAX = 16_384, 1 << 19
#: Sample the index is fitted on, chosen by a hash of the id: vectors per list, and in all while there
#: are no more than HEADS lists (then 8 per list).
SAMPLE_PER_LIST, SAMPLE_MAX = 12, 131_072
#: Vectors of a shard, on average.
SHARD_SIZE = 8192
#: Neighbours of a head in the graph, width of the search, heads that must have been expanded at its end,
#: heads expanded per step, entry groups, most steps.
DEGREE, BEAM, LOOK, EXPAND, ENTRIES, STEPS = 12, 24, 6, 3, 16, 12
#: A vector is posted to lists within POST_RATIO of its nearest head's distance, PROBE_RATIO for probing.
POST_RATIO, MAX_POSTS = 1.06, 3
PROBE_RATIO, MAX_PROBES = 1.2, 4
#: A group of more copies than this is answered as one; with more than HOT_GROUPS * COPY_LIMIT vectors the
#: limit is n / HOT_GROUPS, so there are never more than HOT_GROUPS such groups.
COPY_LIMIT, HOT_GROUPS = 256, 65_536
#: Copies of a group agree to 1 / NEAR in every component of the direction: their similarities to each
#: other are 1.000000, and to any other vector equal but for about half a millionth.
NEAR = float(1 << 20)
#: Directions that agree to 1 / SAME are copies.
SAME = 1e12
#: Millionth of rounding and twice the error of a float32 product: nothing farther behind can tie.
TIE = 5e-6


# --- index -----------------------------------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Labels of a spherical k-means whose assignment is held in balance: each cluster's size so far
    makes it a little less attractive."""
    heads = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    weight = np.zeros(k, np.float32)
    for _ in range(rounds):
        sim = x @ heads.T
        label = np.argmax(sim - weight, axis=1)
        size = np.bincount(label, minlength=k)
        spread = max(1e-7, float(1 - sim.max(axis=1).mean()))  # the balance is as strong as the data are wide
        weight = (0.1 * spread * (size / (len(x) / k) - 1).clip(-1, 4)).astype(np.float32)
        total = np.zeros_like(heads)
        for j in range(k):
            if size[j]:
                total[j] = x[label == j].sum(axis=0)
            else:
                total[j] = x[rng.integers(len(x))]
        heads = _unit(total).astype(np.float32)
    return label


def _tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Leaves (row numbers) of at most ``leaf`` sample vectors, neighbours next to each other."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        k = int(min(16, max(2, -(-len(rows) // leaf))))
        label = _kmeans(x[rows], k, rng)
        parts = [rows[label == j] for j in range(k)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # vectors that cannot be told apart
            out.append(rows)
            continue
        todo += parts[::-1]
    return out


@dataclass
class Index:
    heads: np.ndarray  # lists x dim
    graph: np.ndarray  # lists x DEGREE
    entry: np.ndarray  # about sqrt(lists) directions, each of a run of neighbouring heads
    bounds: np.ndarray  # entries + 1: where the runs begin
    shard: np.ndarray  # shard of each list


def n_lists(n: int) -> int:
    return int(np.clip(n // LIST_SIZE, 1, max(HEADS, n // CELL_MAX)))


def n_sample(n: int) -> int:
    lists = n_lists(n)
    return max(8192, min(lists * SAMPLE_PER_LIST, max(SAMPLE_MAX, lists * 8)))


def fit(sample: np.ndarray, n: int, seed: int = 7) -> Index:
    """Index for ``n`` vectors from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    lists = n_lists(n)
    leaves = _tree(sample, max(2, int(1.7 * len(sample) / lists)), rng)  # leaves are filled to 0.6 on average
    heads = _unit(np.array([sample[r].sum(axis=0) for r in leaves])).astype(np.float32)
    k = len(heads)
    degree = min(DEGREE, k)
    graph = np.empty((k, degree), np.int32)
    for i in range(0, k, 1024):
        sim = heads[i : i + 1024] @ heads.T
        graph[i : i + 1024] = np.argpartition(-sim, degree - 1, axis=1)[:, :degree]
    bounds = np.linspace(0, k, int(np.ceil(np.sqrt(k))) + 1).astype(np.int64)  # heads come in tree order
    entry = _unit(np.add.reduceat(heads, bounds[:-1], axis=0)).astype(np.float32)
    # runs of neighbouring lists of about equal weight make a shard
    weight = np.array([len(r) for r in leaves], float)
    shards = min(k, max(1, -(-n // SHARD_SIZE)))
    shard = np.minimum((np.cumsum(weight) - weight / 2) / weight.sum() * shards, shards - 1).astype(np.int32)
    return Index(heads, graph, entry, bounds, shard)


def _entered(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, similarities) of the runs whose direction is nearest, best first."""
    q, widest = len(x), int(np.diff(index.bounds).max())
    runs = x @ index.entry.T
    e = min(ENTRIES, runs.shape[1])
    top = np.argpartition(-runs, e - 1, axis=1)[:, :e]
    ids, sims = np.full((q, e * widest), -1, np.int32), np.full((q, e * widest), -2, np.float32)
    order = np.argsort(top, axis=None, kind="stable")
    cut = np.searchsorted(top.reshape(-1)[order], np.arange(len(index.entry) + 1))
    for g in np.flatnonzero(np.diff(cut)):
        row, slot = np.divmod(order[cut[g] : cut[g + 1]], e)
        lo, hi = index.bounds[g], index.bounds[g + 1]
        at = slot[:, None] * widest + np.arange(hi - lo)
        ids[row[:, None], at] = np.arange(lo, hi)
        sims[row[:, None], at] = x[row] @ index.heads[lo:hi].T
    return ids, sims


def _best(ids: np.ndarray, sims: np.ndarray, done: np.ndarray, width: int):
    """The ``width`` best of each row, nearest first."""
    rows = np.arange(len(ids))[:, None]
    if ids.shape[1] > width:
        some = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims, done = ids[rows, some], sims[rows, some], done[rows, some]
    order = np.argsort(-sims, axis=1, kind="stable")
    return ids[rows, order], sims[rows, order], done[rows, order]


def nearest_heads(index: Index, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists, similarities) of about the ``m`` nearest heads of each vector, nearest first, by a beam
    search that goes down the graph for all vectors of the block at once: the best heads not expanded
    yet are expanded until the ``LOOK`` best of a vector all are."""
    heads, graph = index.heads, index.graph
    ids, sims = _entered(index, x)
    ids, sims, done = _best(ids, sims, ids < 0, BEAM)
    look = min(LOOK, ids.shape[1])
    for _ in range(STEPS):
        live = np.flatnonzero(~done[:, :look].all(axis=1))
        if not len(live):
            break
        a, s, d = ids[live], sims[live], done[live]
        rows = np.arange(len(live))[:, None]
        pick = np.argsort(d[:, :look], axis=1, kind="stable")[:, :EXPAND]  # the best that are not expanded
        fresh = ~d[rows, pick]
        d[rows, pick] = True
        nxt = np.where(fresh[:, :, None], graph[np.maximum(a[rows, pick], 0)], -1).reshape(len(live), -1)
        nxt = np.sort(nxt, axis=1)
        nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = -1  # the same head from several sides
        nxt[(nxt[:, :, None] == a[:, None, :]).any(axis=2)] = -1
        t = np.einsum("qd,qnd->qn", x[live], heads[np.maximum(nxt, 0)], optimize=False)
        t[nxt < 0] = -2
        ids[live], sims[live], done[live] = _best(np.concatenate([a, nxt], axis=1), np.concatenate([s, t], axis=1), np.concatenate([d, nxt < 0], axis=1), ids.shape[1])
    return ids[:, :m], sims[:, :m]


def choose(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lists, posted, probed) of each vector: the nearest lists and two masks over them."""
    ids, sims = nearest_heads(index, x, MAX_PROBES)
    dist = np.sqrt(np.maximum(2 - 2 * sims, 1e-9))
    ratio = dist / dist[:, :1]
    there = ids >= 0
    posted = there & (ratio <= POST_RATIO)
    posted[:, MAX_POSTS:] = False
    posted[:, 0] = True
    probed = there & ((ratio <= PROBE_RATIO) | (dist <= 0.3))
    probed[:, 0] = True
    return ids, posted, probed


# --- search within a shard -------------------------------------------------------------------


def _best_of(sim: np.ndarray, t: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries of each row that reach ``least`` and, within ``TIE``, its ``t``-th largest."""
    if sim.shape[1] > t:
        last = np.partition(sim, sim.shape[1] - t, axis=1)[:, -t]
        return np.nonzero(sim >= np.maximum(last - np.float32(TIE), least)[:, None])
    return np.nonzero(sim >= least)


def _micro(q: np.ndarray, o: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """Similarities of pairs of rows in double precision, in millionths."""
    sim = np.empty(len(q))
    for i in range(0, len(q), 16384):
        sim[i : i + 16384] = np.einsum("ij,ij->i", _directions(exact[q[i : i + 16384]]), _directions(exact[o[i : i + 16384]]))
    return np.rint(sim * 1e6).astype(np.int64)


def _searches(vec: np.ndarray, posts: tuple[np.ndarray, np.ndarray], probes: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(others, queries) of every list, as row numbers. A list longer than ``LIST_LIMIT`` is split by an
    index of its own, unless its vectors cannot be told apart."""
    by_list = lambda lst, row: (lambda o: (lst[o], row[o]))(np.argsort(lst, kind="stable"))
    todo = [(*by_list(*posts), *by_list(*probes))]
    while todo:
        pl, pr, ql, qr = todo.pop()
        for name in np.unique(ql):
            other = pr[np.searchsorted(pl, name, "left") : np.searchsorted(pl, name, "right")]
            query = qr[np.searchsorted(ql, name, "left") : np.searchsorted(ql, name, "right")]
            if len(other) > LIST_LIMIT:
                some = other[np.random.default_rng(11).permutation(len(other))[: n_sample(len(other))]]
                index = fit(vec[some], len(other))
                if len(index.heads) > 1:
                    po, pq = _chosen(index, vec, other, 1), _chosen(index, vec, query, 2)
                    if np.bincount(po[0]).max() < 0.7 * len(other):
                        todo.append((*by_list(*po), *by_list(*pq)))
                        continue
            if len(other):
                yield other, query


def _chosen(index: Index, vec: np.ndarray, rows: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """(list, row) for the lists that rows are posted to (1) or probe (2)."""
    names, at = [], []
    for i in range(0, len(rows), 1024):
        got = choose(index, vec[rows[i : i + 1024]])
        r, c = np.nonzero(got[which])
        names.append(got[0][r, c])
        at.append(rows[i + r])
    return np.concatenate(names) if names else np.zeros(0, np.int32), np.concatenate(at) if at else np.zeros(0, np.int64)


def search_shard(vec: np.ndarray, posts: tuple[np.ndarray, np.ndarray], probes: tuple[np.ndarray, np.ndarray], k: int, least: float, exact: np.ndarray, low: np.ndarray):
    """Per vector of a shard its most similar others (by row number): (query, other, similarity in
    millionths), at least all that can be among the first ``k`` by similarity, then id. ``posts`` and
    ``probes`` are (list, row); ``exact``: the vectors as they came; ``low``: smallest id of each."""
    t = k + 1
    found_q, found_o, found_s = [], [], []
    for other, query in _searches(vec, posts, probes):
        step = max(1, (4 << 20) // len(other))  # a block of the product is at most 16 MB
        target = vec[other].T
        for i in range(0, len(query), step):
            sim = vec[query[i : i + step]] @ target
            r, c = _best_of(sim, t, least - 2e-6)
            q, o, s = query[i + r], other[c], sim[r, c]
            many = np.bincount(r, minlength=len(sim))[r] > 4 * t
            if many.any():  # very many near ties: settled here, so that they do not pile up
                a, b = q[many], o[many]
                a, b = a[a != b], b[a != b]
                order = np.lexsort((low[b], -_micro(a, b, exact), a))
                a, b = a[order], b[order]
                first = np.arange(len(a)) - np.searchsorted(a, a, "left") < t
                a, b = a[first], b[first]
                q, o, s = np.append(q[~many], a), np.append(o[~many], b), np.append(s[~many], np.einsum("ij,ij->i", vec[a], vec[b]))
            found_q.append(q)
            found_o.append(o)
            found_s.append(s)
    if not found_q:
        none = np.zeros(0, np.int64)
        return none, none, none
    q, o, s = (np.concatenate(x) for x in (found_q, found_o, found_s))
    keep = q != o
    q, o, s = q[keep], o[keep], s[keep]
    _, first = np.unique(q * len(vec) + o, return_index=True)  # a replicated vector is met in several lists
    q, o, s = q[first], o[first], s[first]
    order = np.lexsort((-s, q))
    q, o, s = q[order], o[order], s[order]
    start = np.searchsorted(q, q, "left")
    last = s[np.minimum(start + t, np.searchsorted(q, q, "right")) - 1]
    keep = (np.arange(len(q)) - start < t) | (s >= last - np.float32(TIE))
    q, o = q[keep], o[keep]
    return q, o, _micro(q, o, exact)


# --- stages ----------------------------------------------------------------------------------

_TRAVEL = pa.schema([("shard", pa.int32()), ("vec_id", pa.int64()), ("vec", pa.binary()), ("posts", pa.binary()), ("probes", pa.binary())])
_FOUND = pa.schema([("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.int32()))])


def _usable(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, ids, vectors float32) of the usable rows of a batch with the given dimension."""
    m = b.column("matrix")
    offsets = m.offsets.to_numpy()
    size = np.diff(offsets)
    want = b.column("embedding_dim").fill_null(-1).to_numpy(zero_copy_only=False)
    there = m.is_valid().to_numpy(zero_copy_only=False) & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(there & (size == dim) & (want == dim))
    flat = m.values.to_numpy(zero_copy_only=False).astype(np.float32)  # null components become NaN
    x = flat[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim), np.float32)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    ids = b.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows[good], ids[rows[good]], x[good]


def _directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, as the squares of extreme components would over- or underflow."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return _unit(y)


def _same(x: np.ndarray) -> np.ndarray:
    """Directions in whole numbers: equal for copies, whatever their length."""
    return np.rint(_directions(x) * SAME).astype(np.int64)


def _hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the direction of each vector, rounded to 1 / NEAR."""
    odd = np.random.default_rng(13).integers(0, 1 << 63, (2, x.shape[1]), np.uint64) * np.uint64(2) + np.uint64(1)
    same = np.rint(_directions(x) * NEAR).astype(np.int64).view(np.uint64)
    return tuple((same * o).sum(axis=1, dtype=np.uint64).view(np.int64) for o in odd)


class _Hot:
    """Large groups of copies: their hashes, and for each the id of the last vector that travels."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, last: np.ndarray):
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.last = h1[order], h2[order], last[order]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Group of each vector, or -1."""
        h1, h2 = _hashes(x)
        out = np.full(len(x), -1)
        at = np.searchsorted(self.h1, h1, "left")
        for _ in range(len(self.h1)):  # groups of equal first hash are next to each other: practically one step
            live = np.flatnonzero((at < len(self.h1)) & (out < 0))
            live = live[self.h1[at[live]] == h1[live]]
            if not len(live):
                break
            hit = self.h2[at[live]] == h2[live]
            out[live[hit]] = at[live[hit]]
            at[live] += 1
        return out

    def travels(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(self.h1) or not len(ids):
            return np.ones(len(ids), bool)
        g = self.find(x)
        return (g < 0) | (ids <= self.last[np.maximum(g, 0)])


def _counted(dim: int):
    """mapInArrow: number of usable vectors of each direction of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            _, ids, x = _usable(rb, dim)
            if len(ids):
                h = np.stack([np.concatenate(c) for c in zip(*(_hashes(x[i : i + 1024]) for i in range(0, len(x), 1024)))], axis=1)
                h, n = np.unique(h, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(n)], ["h1", "h2", "n"])

    return run


def _members(dim: int, hot, most: int | None):
    """mapInArrow: (group, id) of the vectors of large groups; with ``most`` only the smallest ids of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            _, ids, x = _usable(rb, dim)
            g = np.concatenate([hot.value.find(x[i : i + 1024]) for i in range(0, len(x), 1024)]) if len(ids) else np.zeros(0, int)
            g, ids = g[g >= 0], ids[g >= 0]
            if most is not None:
                order = np.lexsort((ids, g))
                g, ids = g[order], ids[order]
                keep = np.arange(len(g)) - np.searchsorted(g, g, "left") < most
                g, ids = g[keep], ids[keep]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(ids)], ["g", "vec_id"])

    return run


def _travelling(index, dim: int, hot):
    """mapInArrow: usable vectors to the shards of their lists, but for most of the large groups of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for rb in batches:
            for i in range(0, rb.num_rows, 1024):
                _, ids, x = _usable(rb.slice(i, 1024), dim)
                keep = hot.value.travels(ids, x)
                ids, x = ids[keep], x[keep]
                if not len(ids):
                    continue
                unit = _directions(x).astype(np.float32)
                lists, posted, probed = choose(ix, unit)
                home = np.where(lists >= 0, ix.shard[np.maximum(lists, 0)], -1)
                row, slot = np.nonzero(posted | probed)
                both = np.unique(np.column_stack([row, home[row, slot]]), axis=0)
                mine = home[both[:, 0]] == both[:, 1:2]
                p, q = posted[both[:, 0]] & mine, probed[both[:, 0]] & mine
                names = lists[both[:, 0]].astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(both[:, 1].astype(np.int32)),
                        pa.array(ids[both[:, 0]]),
                        pa.array([x[r].tobytes() for r in both[:, 0]], pa.binary()),
                        pa.array([n[k].tobytes() for n, k in zip(names, p)], pa.binary()),
                        pa.array([n[k].tobytes() for n, k in zip(names, q)], pa.binary()),
                    ],
                    schema=_TRAVEL,
                )

    return run


def _pairs_of(bufs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(list, row) pairs of the packed lists of each row."""
    return np.frombuffer(b"".join(bufs), "<i4"), np.repeat(np.arange(len(bufs)), [len(b) // 4 for b in bufs])


def _counter(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _top(group: np.ndarray, micro: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ``k`` of each group by similarity, then id."""
    order = np.lexsort((other, -micro, group))
    group, micro, other = group[order], micro[order], other[order]
    keep = np.arange(len(group)) - np.searchsorted(group, group, "left") < k
    return group[keep], micro[keep], other[keep]


def _searched(dim: int, k: int, least: float):
    """mapInArrow over partitions of one shard: the best others of every vector that probes lists of the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from one(pa.Table.from_batches(held)).to_batches()

    def one(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        raw = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        # equal directions: one is searched, and answers stand for all ids of the group
        same = np.concatenate([_same(raw[i : i + 4096]) for i in range(0, len(raw), 4096)])
        as_key = np.ascontiguousarray(same).view(np.dtype((np.void, dim * 8))).reshape(-1)
        _, first, group = np.unique(as_key, return_index=True, return_inverse=True)
        group = group.reshape(-1)
        order = np.lexsort((ids, group))
        bounds = np.searchsorted(group[order], np.arange(len(first) + 1))
        posts, probes = (_pairs_of(t.column(c).take(pa.array(first)).to_pylist()) for c in ("posts", "probes"))
        mine = raw[first]
        unit = np.concatenate([_directions(mine[i : i + 4096]).astype(np.float32) for i in range(0, len(mine), 4096)])
        q, o, micro = search_shard(unit, posts, probes, k, least, mine, ids[order][bounds[:-1]])
        keep = micro >= round(least * 1e6)
        q, o, micro = q[keep], o[keep], micro[keep]
        # best of each group: members of the groups found, and its own other members
        size = bounds[1:] - bounds[:-1]
        sorted_ids = ids[order]
        asks = np.zeros(len(first), bool)
        asks[probes[1]] = True
        own = np.flatnonzero(asks & (size > 1))
        g, o, m = np.concatenate([q, own]), np.concatenate([o, own]), np.concatenate([micro, np.full(len(own), 1_000_000)])
        take = np.minimum(size[o], k + 1)
        g, m, other = np.repeat(g, take), np.repeat(m, take), sorted_ids[np.repeat(bounds[o], take) + _counter(take)]
        g, m, other = _top(g, m, other, k + 1)
        # every member of a group has the group's answer without itself
        near = np.bincount(g, minlength=len(first))
        at = np.cumsum(near) - near
        asking = np.repeat(np.arange(len(first)), size)[(near > 0)[np.repeat(np.arange(len(first)), size)]]
        who = sorted_ids[(near > 0)[np.repeat(np.arange(len(first)), size)]]
        take = near[asking]
        pick = np.repeat(at[asking], take) + _counter(take)
        me, m, other = np.repeat(np.arange(len(who)), take), m[pick], other[pick]
        keep = other != who[me]
        me, m, other = _top(me[keep], m[keep], other[keep], k)
        some, start = np.unique(me, return_index=True)
        offsets = pa.array(np.append(start, len(me)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (other, m.astype(np.int32)))
        return pa.Table.from_arrays([pa.array(who[some]), *lists], schema=_FOUND)

    return run


def _sampled(df: DataFrame, dim: int, n: int, want: int, hot) -> np.ndarray:
    """About ``want`` of ``n`` usable vectors that travel, chosen by a hash of the id alone, as unit vectors."""
    picked = df if want >= n else df.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < int(want / n * (1 << 30)))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                _, ids, x = _usable(b.slice(i, 1024), dim)
                keep = hot.value.travels(ids, x)
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array([r.tobytes() for r in x[keep]], pa.binary())], ["vec_id", "vec"])

    got = picked.mapInArrow(only, "vec_id bigint, vec binary").toArrow().sort_by("vec_id")
    raw = np.frombuffer(b"".join(got.column("vec").to_pylist()), np.float32).reshape(-1, dim)
    return _directions(raw).astype(np.float32) if len(raw) else raw


def _hot_groups(df: DataFrame, dim: int, k: int) -> tuple[int, int, object]:
    """(usable vectors, vectors that travel, broadcast of the large groups of copies). Counts are summed
    within batches before they are shuffled; of a large group only its ``k + 1`` smallest ids of a batch are."""
    spark = df.sparkSession
    none = np.zeros(0, np.int64)
    counts = df.mapInArrow(_counted(dim), "h1 bigint, h2 bigint, n bigint").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    sizes = counts.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    n = sizes["n"] or 0
    limit = max(COPY_LIMIT, n // HOT_GROUPS)
    if (sizes["most"] or 0) <= limit:
        return n, n, spark.sparkContext.broadcast(_Hot(none, none, none))
    big = counts.where(F.col("n") > limit).toPandas()  # fewer than n / limit <= HOT_GROUPS + 1 rows
    groups = _Hot(big["h1"].to_numpy(), big["h2"].to_numpy(), np.full(len(big), np.iinfo(np.int64).max))
    low = df.mapInArrow(_members(dim, spark.sparkContext.broadcast(groups), k + 1), "g int, vec_id bigint").groupBy("g").agg(F.slice(F.array_sort(F.collect_list("vec_id")), k + 1, 1)[0].alias("last")).toPandas()
    groups.last[low["g"].to_numpy()] = low["last"].to_numpy()
    return n, n - int((big["n"] - k - 1).sum()), spark.sparkContext.broadcast(groups)


def _of_dimension(df: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    spark = df.sparkSession
    df = df.where((F.col("embedding_dim") == dim) & (F.size("matrix") == dim))
    _, n, hot = _hot_groups(df, dim, k)
    sample = _sampled(df, dim, n, n_sample(n), hot)
    if not len(sample):
        return spark.createDataFrame([], "vec_id bigint, ids array<bigint>, sims array<int>")
    fitted = fit(sample, n)
    index = spark.sparkContext.broadcast(fitted)
    travel = df.mapInArrow(_travelling(index, dim, hot), "shard int, vec_id bigint, vec binary, posts binary, probes binary")
    found = travel.repartitionById(int(fitted.shard.max()) + 1, "shard").mapInArrow(_searched(dim, k, least), "vec_id bigint, ids array<bigint>, sims array<int>")
    best = _merged(found, k)
    if not len(hot.value.h1):
        return best
    best = checkpointed(best)  # read twice below; rewritten searches would cost more than its few bytes a vector
    # the members that did not travel have the answer of the last one of their group that did
    reps = spark.createDataFrame(list(enumerate(hot.value.last.tolist())), "g int, vec_id bigint")
    answers = best.join(F.broadcast(reps), "vec_id").select("g", F.col("vec_id").alias("last"), "ids", "sims")  # one per group, so at most HOT_GROUPS
    rest = df.mapInArrow(_members(dim, hot, None), "g int, vec_id bigint").join(F.broadcast(answers), "g").where(F.col("vec_id") > F.col("last")).select("vec_id", "ids", "sims")
    return best.unionByName(rest)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of the answers from several shards."""
    pairs = F.transform(F.arrays_zip("sims", "ids"), lambda z: F.struct((-z["sims"]).alias("s"), z["ids"].alias("i")))
    one = found.select("vec_id", pairs.alias("c")).groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))), 1, k).alias("c"))
    return one.select("vec_id", F.transform("c", lambda z: z["i"]).alias("ids"), F.transform("c", lambda z: -z["s"]).alias("sims"))


def neighbours(df: DataFrame, k: int = 10, least: float = 0.8, exact: bool = False) -> DataFrame:
    """Up to ``k`` most similar other vectors of every usable vector: vec_id, ids, sims (millionths).

    ``df``: vec_id, embedding_dim, matrix (array<float>). A vector is usable if its id is there and its
    matrix has exactly embedding_dim components, all finite and not all zero; others have no row, as do
    vectors without a neighbour of similarity ``least``. Ties go to the smaller id; copies are neighbours
    like others. Vectors of different dimension are not compared. An empty table gives an empty result;
    further columns are ignored. ``exact`` compares all with all, in blocks, instead of using the index: its
    cost is quadratic.
    """
    df = df.select("vec_id", "embedding_dim", "matrix")
    if exact:
        return exact_neighbours(df, df.select("vec_id"), k, least)
    dims = [r[0] for r in df.where("embedding_dim > 0").groupBy("embedding_dim").count().orderBy("embedding_dim").collect()]
    out = None
    for dim in dims:
        part = _of_dimension(df, int(dim), k, least)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "vec_id bigint, ids array<bigint>, sims array<int>")


def _usable_rows(df: DataFrame, dim: int) -> DataFrame:
    """vec_id, v (direction in double precision) of the usable vectors of a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, ids, x = _usable(b, dim)
            flat = _directions(x).reshape(-1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(flat))], ["vec_id", "v"])

    return df.where((F.col("embedding_dim") == dim) & (F.size("matrix") == dim)).select("vec_id", "embedding_dim", "matrix").mapInArrow(run, "vec_id bigint, v array<double>")


def exact_neighbours(df: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.8) -> DataFrame:
    """:func:`neighbours` of the vectors whose ids are in ``queries`` (vec_id, unique), by comparison with all
    vectors in blocks. The way for those who need every pair, and the yardstick of the index."""
    out = None
    for (dim,) in df.where("embedding_dim > 0").select("embedding_dim").distinct().orderBy("embedding_dim").collect():
        rows = _usable_rows(df, int(dim))
        asked = rows.join(queries.select("vec_id"), "vec_id", "left_semi").withColumnRenamed("vec_id", "qid")
        part = search(rows, asked, k + 1, least - 5e-7, decimals=6).where("qid <> vec_id")
        got = part.groupBy(F.col("qid").alias("vec_id")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("sim", 6)).alias("s"), F.col("vec_id").alias("i")))), 1, k).alias("c"))
        got = got.select("vec_id", F.transform("c", lambda z: z["i"]).alias("ids"), F.transform("c", lambda z: F.round(-z["s"] * 1_000_000).cast("int")).alias("sims"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else df.sparkSession.createDataFrame([], "vec_id bigint, ids array<bigint>, sims array<int>")


def recall(df: DataFrame, found: DataFrame, every: int = 50, k: int = 10, least: float = 0.8) -> DataFrame:
    """One row: queries (usable vectors whose id ``every`` divides and that have neighbours), true neighbours of
    these by :func:`exact_neighbours`, how many of them ``found`` (vec_id, ids) has, and the share."""
    asked = df.where(F.col("vec_id") % every == 0).select("vec_id").distinct()
    true = exact_neighbours(df, asked, k, least).select("vec_id", F.col("ids").alias("true_ids"))
    both = true.join(found.select("vec_id", "ids"), "vec_id", "left")
    hit = F.size(F.array_intersect("true_ids", F.coalesce("ids", F.array().cast("array<bigint>"))))
    return both.agg(F.count("*").alias("queries"), F.coalesce(F.sum(F.size("true_ids")), F.lit(0)).alias("true_neighbours"), F.coalesce(F.sum(hit), F.lit(0)).alias("found")).withColumn("recall", F.round(F.try_divide("found", "true_neighbours"), 6))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Each pair of which at least one is a neighbour of the other, once, the smaller id first."""
    one = found.select("vec_id", F.explode("ids").alias("other"))
    return one.select(F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()
