"""Verification matrices and the cross-query cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verified(candidates: DataFrame, matrix: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Candidates that a yes/no matrix lets pass: ``any`` yes, more than half (``majority``), or ``all``.
    ``candidates``: keys. ``matrix``: keys, verdict. Where nothing was asked (no expected events, so no
    verdicts), ``any`` lets all pass and the other rules none."""
    n, yes = F.coalesce("asked", F.lit(0)), F.coalesce("yes", F.lit(0))
    counts = matrix.groupBy(*keys).agg(F.count_if(F.col("verdict") == "yes").alias("yes"), F.count("verdict").alias("asked"))
    ok = {"any": (yes >= 1) | (n == 0), "majority": yes > F.floor(n / 2), "all": (yes == n) & (n > 0)}[rule]
    return candidates.select(*keys).distinct().join(counts, keys, "left").where(ok).select(*keys, yes.alias("yes"), n.alias("asked"))


def verdict_list(text: Column, m: Column) -> Column:
    """Verdicts of a response: a JSON list, code fence taken off; unreadable means all no; cut or filled
    with no to ``m``."""
    t = F.trim(F.regexp_replace(text, "(?i)^\\s*```[a-z]*\\s*|\\s*```\\s*$", ""))
    got = F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))
    got = F.transform(got, lambda x: F.when(F.lower(F.trim(x)) == "yes", "yes").otherwise("no"))
    return F.slice(F.concat(got, F.array_repeat(F.lit("no"), m)), 1, m)


def expected_events(text: Column) -> Column:
    """Expected events of a response (``{"query_events": [...]}``, code fence taken off), trimmed, empty and null
    ones left out; none if it cannot be read."""
    t = F.trim(F.regexp_replace(text, "^\\s*```\\w*\\n?|\\n?```\\s*$", ""))
    got = F.from_json(t, "query_events array<string>")["query_events"]
    return F.coalesce(F.transform(F.filter(got, lambda x: x.isNotNull() & (x != "")), lambda x: F.trim(x)), F.array().cast("array<string>"))


def without_all_no(candidates: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Removes only candidates that some matrix saw and none said yes to."""
    seen = matrix.groupBy(*keys).agg(F.bool_or(F.col("verdict") == "yes").alias("yes"))
    return candidates.join(seen.where("not yes"), keys, "left_anti")


# --- cross-query cache: state that depends on the order of a video's queries -------------------

Span = tuple[float, float, str]


def hull_iou(a: tuple[float, float], b: tuple[float, float]) -> float:
    shared = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    return shared / max(1e-9, max(a[1], b[1]) - min(a[0], b[0]))


def clusters(rows: list[Span], gap: float) -> list[tuple[float, float, list[str]]]:
    """Clusters of (start, end, id) by gap, in order of start."""
    out: list[tuple[float, float, list[str]]] = []
    for s, e, i in sorted(rows):
        if out and s <= out[-1][1] + gap:
            lo, hi, ids = out[-1]
            out[-1] = (lo, max(hi, e), [*ids, i])
        else:
            out.append((s, e, [i]))
    return out


class Cache:
    """Entries of one video: clusters with the spans of their events and a time. Entries are only added. They are
    found by time buckets, as an entry without a shared stretch has no overlap: a look-up costs what is
    near, not what there is."""

    def __init__(self, width: float = 64.0):
        self.entries: list[tuple[float, float, list[Span], float]] = []
        self.width = width
        self.at: dict[int, list[int]] = {}
        self.wide: list[int] = []

    def add(self, start: float, end: float, members: list[Span], time: float) -> None:
        n = len(self.entries)
        self.entries.append((start, end, members, time))
        lo, hi = int(start // self.width), int(end // self.width)
        if hi - lo > 1000:
            self.wide.append(n)
        else:
            for k in range(lo, hi + 1):
                self.at.setdefault(k, []).append(n)

    def best(self, start: float, end: float) -> tuple[int | None, float]:
        """The entry of highest hull overlap, the earlier one on ties; none at 0."""
        lo, hi = int(start // self.width), int(end // self.width)
        near = range(len(self.entries)) if hi - lo > 1000 else sorted({n for k in range(lo, hi + 1) for n in self.at.get(k, ())} | set(self.wide))
        best, at = 0.0, None
        for n in near:
            v = hull_iou((start, end), self.entries[n][:2])
            if v > best:
                best, at = v, n
        return at, best


class Query:
    """Rows of one query: its seeds in rank order, and the neighbours of each."""

    def __init__(self) -> None:
        self.seeds: list[Span] = []
        self.near: dict[str, list[Span]] = {}
        self.ok: set[str] = set()

    def answer(self, cache: Cache, gap: float, least: float, budget: int, final_gap: float) -> dict:
        """Answer against the cache, which then grows by the clusters of the answer.

        Each seed cluster takes the best entry if it reaches ``least``: the entry's events are reused and the
        cluster's seeds covered. A: the uncovered seeds and their neighbours by id, cut to ``budget``, those that
        were verified, and the reused events. B: all seeds, the reused events and the neighbours of all uncovered
        seeds. The clusters of A and B together become entries, with the length of B's expansion as time."""
        reused: dict[str, Span] = {}
        covered: set[str] = set()
        times = []
        for s, e, ids in clusters(self.seeds, gap):
            at, v = cache.best(s, e)
            if at is not None and v >= least:
                reused.update((x[2], x) for x in cache.entries[at][2])
                times.append(cache.entries[at][3])
                covered.update(ids)
        left = [x for x in self.seeds if x[2] not in covered]
        names = {x[2] for x in left}
        near = {x[2]: x for s in left for x in self.near.get(s[2], ())}
        sent = (left + [near[i] for i in sorted(near) if i not in names])[:budget]
        a = {x[2]: x for x in sent if x[2] in self.ok} | reused
        b = {x[2]: x for x in self.seeds} | reused | near
        time_b = sum(x[1] - x[0] for x in near.values())
        final = a | b
        for s, e, ids in clusters(list(final.values()), final_gap):
            cache.add(s, e, [final[i] for i in ids], time_b)
        return {
            "n_seeds": len(self.seeds), "n_reused": len(reused), "n_covered": len(covered), "cache_size": len(cache.entries), "mean_reused_s": round(sum(times) / len(times), 6) if times else 0.0,
            "time_b_s": round(time_b, 6), "reused": ",".join(sorted(reused)), "covered": ",".join(sorted(covered)), "a": ",".join(sorted(a)), "b": ",".join(sorted(b)),
        }


IN = ["store_no", "question_id", "seed_id", "event_id", "rnk", "s", "e", "ok"]
OUT = "store_no bigint, question_id bigint, n_seeds bigint, n_reused bigint, n_covered bigint, cache_size bigint, mean_reused_s double, time_b_s double, reused string, covered string, a string, b string"
_OUT_COLS = [c.split()[0] for c in OUT.split(", ")]


def queries_of(pdf: pd.DataFrame) -> Iterator[tuple[int, int, Query]]:
    """(store, question, query) of rows that are sorted by store, question and rank."""
    key, q = None, Query()
    for store, question, seed, event, _, s, e, ok in zip(*(pdf[c] for c in IN)):
        if (store, question) != key:
            if key is not None:
                yield (*key, q)
            key, q = (store, question), Query()
        span = (float(s), float(e), event)
        if seed is None:
            q.seeds.append(span)
        else:
            q.near.setdefault(seed, []).append(span)
        if ok:
            q.ok.add(event)
    if key is not None:
        yield (*key, q)


def cross_cache(rows: DataFrame, gap: float = 30.0, least: float = 0.5, budget: int = 8, final_gap: float = 30.0) -> DataFrame:
    """Runs the queries of every video in order of question_id against the video's growing cache.

    ``rows``: store_no, question_id, seed_id (null for a seed, else the seed that the event is next to), event_id,
    rnk (of a seed), s, e, ok (verified); only events that exist, so reused ids are valid. A video's queries depend
    on each other and run one after another; they stream by, so that a task holds a video's cache and one query.
    Returns one row per query: counts, times and the ids reused, covered, of A and of B."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, cache, held = None, Cache(), None
        for pdf in frames:
            out = []
            pdf = pdf.astype({"seed_id": object}).where(pdf.notna(), None) if len(pdf) else pdf
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["store_no"] == pdf["store_no"].iloc[-1]) & (pdf["question_id"] == pdf["question_id"].iloc[-1])
            held, pdf = pdf[last], pdf[~last]  # the last query may go on in the next batch
            for s, q, query in queries_of(pdf):
                if s != store:
                    store, cache = s, Cache()
                out.append({"store_no": s, "question_id": q} | query.answer(cache, gap, least, budget, final_gap))
            yield pd.DataFrame(out, columns=_OUT_COLS)
        if held is not None:
            out = []
            for s, q, query in queries_of(held):
                if s != store:
                    store, cache = s, Cache()
                out.append({"store_no": s, "question_id": q} | query.answer(cache, gap, least, budget, final_gap))
            yield pd.DataFrame(out, columns=_OUT_COLS)

    ordered = rows.select(*IN).repartition("store_no").sortWithinPartitions("store_no", "question_id", F.col("seed_id").isNotNull(), "rnk", "seed_id", "event_id")
    return ordered.mapInPandas(run, OUT)
