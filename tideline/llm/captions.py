"""Runs of consecutive events that repeat the same caption, collapsed into one event each.

Adjacent agglomeration: the events of a store stand in order of ``pos`` in a linked list; a
priority queue holds the similarity of every two neighbouring runs; the most similar neighbours
are merged, the queue is updated, until no neighbours meet the similarity and gap limits.

Captions say the same thing if they differ only on the surface: case, punctuation, time stamps and
counters in front, remarks such as "as before" behind, articles, digits or number words, the simple
or progressive form of a verb, and typing errors. What is a typing error is learned from the captions
themselves: a letter dropped, doubled, added or swapped makes a word that is rare beside the word
meant. Two words that are both in use are different words, however alike ("cat" and "cart", "dog" and
"dogs"), and so are a different count, colour, place or direction.

A store is worked on in blocks of ``BLOCK`` positions. Events between which a run cannot go on cut a
block into stretches. A stretch that does not reach the block's ends is agglomerated there; the others
are put together along the store, equal neighbours collapsed, and then agglomerated whole, so that
the runs do not depend on ``BLOCK``. No task holds a store whole.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import checkpointed

BLOCK = 2048
#: Two runs merge at this similarity or more; 1 is equal but for the harmless surface forms.
MIN_SIMILARITY = 0.8

_LEAD = re.compile(
    r"^(?:\s|[*•>#|\-–—]|\[\s*\d+(?::\d+)+(?:[.,]\d+)?(?:\s*[-–]\s*\d+(?::\d+)+)?\s*\]|\d+(?::\d+)+(?:\s*[-–]\s*\d+(?::\d+)+)?\s*[-–:]?"
    r"|(?:chunk|event|caption|frame|scene|segment|clip)\s*(?:no\.?\s*)?\d*\s*:|\((?:cont\.?|continued)\))+"
)
_TAIL = re.compile(r"(?:\s|[.,;:!?…\-–—]|\bas before\b|\(?\bcontinued\b\)?|\(?\bcont\b\.?\)?|\bsame scene\b|\bstill\b|\(copy\)|\(again\)|\bagain\b)+$")
_WORD = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)?")
_NUMBERS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
_ARTICLES = frozenset("a an the der die das den dem des ein eine einen einem einer le la les l un une el los las una".split())
_BE = frozenset(("is", "are"))
_SPELLINGS = {"gray": "grey", "colour": "color"}
#: A word is a slip of another if it has at most this share of the other's occurrences, or, where words
#: have few occurrences, at most FEW and FEW_SHARE.
SHARE, FEW, FEW_SHARE, SURE = 0.01, 3, 0.1, 7
#: Of the words in use, those with less than 1 / 2**20 of all words are left out of the counts (so there
#: are at most 2**20): as rare as that, a word is no better known than one that is not counted.
LEAST_SHARE = 1 / (1 << 20)


@lru_cache(1 << 16)
def words(caption: str) -> tuple[str, ...]:
    """The words of a caption that carry its meaning, in a common form."""
    t = unicodedata.normalize("NFKC", caption).casefold().replace("&", " and ")
    t = _TAIL.sub("", _LEAD.sub("", t))
    out = []
    for w in _WORD.findall(t):
        w = w.replace("’", "'")
        if w in _ARTICLES or w in _BE or not out and w in ("one", "1"):
            continue
        if w[:2] in ("l'", "d'"):
            w = w[2:]
        out.append(_SPELLINGS.get(w) or _NUMBERS.get(w) or w)
    return tuple(out)


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """Common form of the simple and progressive forms of an English verb."""
    for end in ("ing", "ies", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    w = w.rstrip("eyi") if len(w) > 3 else w
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _one_verb(a: str, b: str) -> bool:
    """The progressive and the simple form of one verb."""
    return a.endswith("ing") != b.endswith("ing") and stem(a) == stem(b)


def slips(a: str, b: str, most: int) -> int | None:
    """Letters dropped, added or swapped between two words, or None if over ``most`` or if a
    letter was replaced by another."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return None
    ca, cb = Counter(a), Counter(b)
    lost, won = sum((ca - cb).values()), sum((cb - ca).values())
    if lost and won:
        return None
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            c = min(row[j] + 1, cur[-1] + 1, row[j - 1] + (0 if x == y else 2))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            cur.append(c)
        if min(cur) > most:
            return None
        before, row = row, cur
    return row[-1] if row[-1] <= most else None


_REPEAT = re.compile(r"(.)\1")
_WORDS_OF = {v: k for k, v in _NUMBERS.items()}
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëìíîïñòóôöùúûüœ"


def _edits(w: str, inserts: bool = True) -> set[str]:
    """What a word may have been before a letter was added, doubled or swapped, or dropped (``inserts``)."""
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1}
    return out | {a + c + b for a, b in cut for c in _LETTERS} if inserts else out


class Spelling:
    """Words in use and how often: tells slips of a word from other words. Without counts only words of
    ``SURE`` letters are taken for slips of each other, and not if they differ by a last s."""

    def __init__(self, counts: dict[str, int] | None = None):
        self.counts = counts or {}
        self.top = max(self.counts.values(), default=0)
        self.meant: dict[str, tuple[str, int]] = {}
        self.pairs: dict[tuple[str, str], int | None] = {}

    def __getstate__(self):
        return self.counts

    def __setstate__(self, counts):
        self.__init__(counts)

    def rare_beside(self, a: str, b: str) -> bool:
        x, y = self.counts.get(a, 0), self.counts.get(b, 0)
        return y > 0 and (x <= SHARE * y or x <= FEW and x <= FEW_SHARE * y)

    def may_be_slip(self, w: str) -> bool:
        """Rare beside the most frequent word."""
        n = self.counts.get(w, 0)
        return n <= SHARE * self.top or n <= FEW and n <= FEW_SHARE * self.top

    def _meant(self, w: str) -> tuple[str, int]:
        """The most frequent word that ``w`` is a slip of, and the number of slips; itself if there is none."""
        got = self.meant.get(w)
        if got is None:
            got = w, 0
            if len(w) > 3 and w.isalpha() and self.may_be_slip(w):
                near = _edits(w)
                better = [x for x in near if x in self.counts and self.rare_beside(w, x)]
                n = 1
                if not better and len(w) > 6:  # a second slip, in one more letter or two swapped
                    n, better = 2, [x for y in near for x in _edits(y, False) if x in self.counts and self.rare_beside(w, x)]
                if better:
                    got = max(better, key=lambda x: (self.counts[x], x)), n
            if len(self.meant) > 1 << 17:
                self.meant.clear()
            self.meant[w] = got
        return got

    def between(self, a: str, b: str) -> int | None:
        """Slips between two words that mean the same; None if they are different words."""
        if a == b:
            return 0
        key = (a, b) if a < b else (b, a)
        if key not in self.pairs:
            if len(self.pairs) > 1 << 17:
                self.pairs.clear()
            self.pairs[key] = self._between(*key)
        return self.pairs[key]

    def _between(self, a: str, b: str) -> int | None:
        if _one_verb(a, b):
            return 0
        if a.isdigit() and b.isdigit():
            return None
        x, y = (_WORDS_OF.get(w, w) for w in (a, b))
        if min(len(x), len(y)) < 3 or x[0].isdigit() or y[0].isdigit():
            return None
        if self.rare_beside(a, b) or self.rare_beside(b, a) or not self.counts and min(len(a), len(b)) >= SURE and a.rstrip("s") != b.rstrip("s"):
            most = 1 if max(len(x), len(y)) < 6 else 2
            single = [_REPEAT.sub(r"\1", w) for w in (x, y)]  # a doubled letter may hide a dropped one
            got = [n for n in (slips(x, y, most), slips(*single, most)) if n is not None]
            if got:
                return min(got)
        if abs(len(a) - len(b)) > 4 or len(set(a) ^ set(b)) > 4 or not (self.may_be_slip(a) or self.may_be_slip(b)):
            return None
        (x, n), (y, m) = self._meant(a), self._meant(b)
        return n + m if n + m and (x == y or _one_verb(x, y)) else None


NO_COUNTS = Spelling()


def similarity(a: tuple[str, ...], b: tuple[str, ...], spelling: Spelling = NO_COUNTS) -> float:
    """1 for captions that say the same, a little less for typing errors, 0 for any difference."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or len(a) != len(b):
        return 0.0
    total = 0
    for x, y in zip(a, b):
        if x != y:
            s = spelling.between(x, y)
            if s is None:
                return 0.0
            total += s
    return max(0.01, 1.0 - total / max(20, sum(map(len, a))))


class _Run:
    __slots__ = ("first", "last", "count", "start", "end", "votes", "head", "tail", "left", "right", "alive")

    def __init__(self, first: int, last: int, count: int, cap: tuple[str, ...], start: float | None, end: float | None):
        self.first, self.last, self.count, self.start, self.end = first, last, count, start, end
        self.votes = Counter({cap: count})
        self.head = self.tail = cap
        self.left = self.right = None
        self.alive = True

    def best(self) -> tuple[str, ...]:
        return min(self.votes, key=lambda c: (-self.votes[c], c)) if len(self.votes) > 1 else self.head

    def absorb(self, o: _Run) -> None:
        self.last, self.tail, self.count = o.last, o.tail, self.count + o.count
        self.votes.update(o.votes)
        self.start = o.start if self.start is None else self.start if o.start is None else min(self.start, o.start)
        self.end = o.end if self.end is None else self.end if o.end is None else max(self.end, o.end)


def _far(a: _Run, b: _Run, gap: float | None) -> bool:
    """Neighbours farther apart than the gap limit, or not known to be nearer."""
    return gap is not None and (a.end is None or b.start is None or b.start - a.end > gap)


def _alike(a: _Run, b: _Run, gap: float | None, spelling: Spelling) -> float:
    if _far(a, b, gap):
        return 0.0
    return max(similarity(a.tail, b.head, spelling), similarity(a.best(), b.best(), spelling))


def agglomerate(runs: list[_Run], gap: float | None = None, limit: float = MIN_SIMILARITY, spelling: Spelling = NO_COUNTS) -> list[_Run]:
    """Merge the most similar neighbours of a stretch until none is similar enough."""
    if len(runs) < 2:
        return runs
    heap: list[tuple[float, int, int, _Run, _Run]] = []
    for a, b in zip(runs, runs[1:]):
        a.right, b.left = b, a

    def push(a: _Run, b: _Run) -> None:
        s = _alike(a, b, gap, spelling)
        if s >= limit:
            heapq.heappush(heap, (-s, a.first, b.last, a, b))

    for a, b in zip(runs, runs[1:]):
        push(a, b)
    while heap:
        _, _, last, a, b = heapq.heappop(heap)
        if not (a.alive and b.alive) or a.right is not b or b.last != last:
            continue
        b.alive = False
        a.absorb(b)
        a.right = b.right
        if b.right:
            b.right.left = a
            push(a, b.right)
        if a.left:
            push(a.left, a)
    return [r for r in runs if r.alive]


def _joins(stretch: list[_Run], e: _Run, gap: float | None, spelling: Spelling) -> bool:
    """Put the next event (or run of equal ones) into a stretch, if neighbours can be alike there."""
    last = stretch[-1]
    if _far(last, e, gap):
        return False
    if last.tail == e.head:
        last.absorb(e)
    elif similarity(last.tail, e.head, spelling) > 0:
        stretch.append(e)
    else:
        return False
    return True


_COLS = ["owner", "block", "part", "first_pos", "last_pos", "event_count", "start_s", "end_s", "caption", "at_lo", "at_hi"]
_SCHEMA = "owner bigint, block bigint, part int, first_pos bigint, last_pos bigint, event_count bigint, start_s double, end_s double, caption string, at_lo boolean, at_hi boolean"
_ARROW = pa.schema(
    [("owner", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("first_pos", pa.int64()), ("last_pos", pa.int64()), ("event_count", pa.int64())]
    + [("start_s", pa.float64()), ("end_s", pa.float64()), ("caption", pa.string()), ("at_lo", pa.bool_()), ("at_hi", pa.bool_())]
)
#: Parts of a block: whole runs, the stretch at its begin, the one at its end, an end where nothing goes on.
RUN, LOW, HIGH, BAR = 0, 1, 2, 3


def _block_runs(block_of, gap: float | None, limit: float, spelling):
    """mapInArrow over partitions sorted by (owner, block, pos, loaded_at)."""

    def close(owner: int, block: int, rows: list[tuple]) -> Iterator[tuple]:
        events: list[tuple] = []
        for pos, text, s, e in rows:  # rows of one pos are one event; the last caption and span that are there
            if events and events[-1][0] == pos:
                p = events[-1]
                events[-1] = (pos, text if text is not None else p[1], *((s, e) if s is not None else p[2:]))
            else:
                events.append((pos, text, s, e))
        lo, hi = events[0][0], events[-1][0]
        stretches: list[list[_Run]] = []
        open_ = False
        for pos, text, s, e in events:
            w = tuple(text.split(" ")) if text else ()
            if not w:
                open_ = False
                if pos in (lo, hi):
                    yield (owner, block, BAR, pos, pos, 0, None, None, None, pos == lo, pos == hi)
                continue
            r = _Run(pos, pos, 1, w, s, e)
            if not (open_ and _joins(stretches[-1], r, gap, spelling.value)):
                stretches.append([r])
            open_ = True
        for st in stretches:
            low, high = st[0].first == lo, st[-1].last == hi
            if low or high:
                for r in st:
                    yield (owner, block, LOW if low else HIGH, r.first, r.last, r.count, r.start, r.end, " ".join(r.head), r.first == lo, r.last == hi)
            elif len(st) > 1 or st[0].count > 1:
                yield from ((owner, block, RUN, r.first, r.last, r.count, r.start, r.end, " ".join(r.best()), False, False) for r in agglomerate(st, gap, limit, spelling.value) if r.count > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for owner, pos, text, s, e in zip(*cols):
                k = (owner, block_of(pos))
                if k != key:
                    if rows:
                        out += close(*key, rows)
                    key, rows = k, []
                rows.append((pos, text, s, e))
            if len(out) > 4096:
                yield _batch(out)
                out = []
        if rows:
            out += close(*key, rows)
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _stitched(gap: float | None, limit: float, spelling):
    """mapInArrow over the runs at block ends sorted by (owner, first_pos): stretches put together across
    blocks, then agglomerated whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch: list[_Run] = []
        before = None

        def close(owner: int) -> list[tuple]:
            done = agglomerate(stretch, gap, limit, spelling.value)
            return [(owner, 0, RUN, r.first, r.last, r.count, r.start, r.end, " ".join(r.best()), False, False) for r in done if r.count > 1]

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(i).to_pylist() for i in range(len(_COLS)))):
                owner, block, part, first, last, n, s, e, caption, at_lo, at_hi = row
                new = _Run(first, last, n, tuple(caption.split(" ")), s, e) if part != BAR else None
                goes_on = False
                if new and stretch and before[0] == owner and before[2] != BAR:
                    if (block, part) == before[1:3]:
                        stretch.append(new)
                        goes_on = True
                    elif block != before[1] and at_lo and before[10]:
                        goes_on = _joins(stretch, new, gap, spelling.value)
                if not goes_on:
                    if stretch:
                        out += close(before[0])
                    stretch = [new] if new else []
                before = row
            if out:
                yield _batch(out)
        if stretch and (out := close(before[0])):
            yield _batch(out)

    return run


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: captions (last column) to the words that carry their meaning; null stays null."""
    for b in batches:
        said = [None if t is None else " ".join(words(t)) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(said, pa.string())], [*b.schema.names[:-1], "said"])


def spelling_of(said: DataFrame) -> Spelling:
    """Words in use in all captions (said: words with blanks between). The table has at most 1 / LEAST_SHARE rows,
    by the share of all words that a row must have; a word met once tells nothing and is left out."""
    counts = checkpointed(said.select(F.explode(F.split("said", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return Spelling({r["word"]: r["n"] for r in counts.where(F.col("n") >= max(2, int(total * LEAST_SHARE))).collect()})


def caption_runs(events: DataFrame, gap: float | None = None, limit: float = MIN_SIMILARITY, block: int = BLOCK, spelling: Spelling | None = None) -> DataFrame:
    """Runs of at least two consecutive events of a store that repeat the same caption.

    ``events``: store_no, pos, description, duration (array of two seconds), loaded_at. Rows with a
    null store or pos have no place and are left out; rows with the same store and pos are one event
    (the latest caption and span that are not null). A null, empty or wordless caption belongs to no
    run and ends one. ``gap``: the most seconds between neighbours (None: any); with one, neighbours
    without usable spans stay apart. ``spelling``: words in use, by default those of all rows with a place.
    An empty table gives an empty result; further columns are ignored.

    Returns store_no, first_pos, last_pos, event_count, start_s, end_s (hull of the usable spans,
    null if there is none), duration_s and caption (common form of the most frequent wording).
    """
    ok = F.when((F.size("duration") == 2) & (F.get("duration", F.lit(1)) > F.get("duration", F.lit(0))), F.col("duration"))
    rows = events.where("store_no is not null and pos is not null").select("store_no", "pos", F.get(ok, F.lit(0)).alias("s"), F.get(ok, F.lit(1)).alias("e"), "loaded_at", "description")
    kinds = dict(rows.dtypes)
    # captions are brought to their words once: for the counts and for the runs
    rows = checkpointed(rows.mapInArrow(_said, ", ".join(f"{c} {kinds[c]}" for c in rows.columns[:-1]) + ", said string"))
    sorted_rows = (
        rows.withColumn("block", F.floor(F.col("pos") / block)).repartition("store_no", "block")
        .sortWithinPartitions("store_no", "block", "pos", F.col("loaded_at").asc_nulls_first()).select("store_no", "pos", "said", "s", "e")
    )
    shared = events.sparkSession.sparkContext.broadcast(spelling_of(rows) if spelling is None else spelling)
    # far fewer rows than events, and read twice: written once to the shared checkpoint folder
    parts = checkpointed(sorted_rows.mapInArrow(_block_runs(lambda p: p // block, gap, limit, shared), _SCHEMA))
    edges = parts.where(f"part <> {RUN}").repartition("owner").sortWithinPartitions("owner", "first_pos", "part").mapInArrow(_stitched(gap, limit, shared), _SCHEMA)
    return parts.where(f"part = {RUN}").unionByName(edges).select(
        F.col("owner").alias("store_no"), "first_pos", "last_pos", "event_count", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "caption"
    )
