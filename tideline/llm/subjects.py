"""Subject areas of documents by weak supervision.

Labelling functions give a coarse code for each document and area:

* lexicon: share of statements that hold words of a small hand-made lexicon of one area only;
* learned: share of statements whose words are typical of the area, by word statistics over all
  documents (words of lexicon statements, and words that stand in documents next to them);
* section: whether the area leads a section with more than one statement, stands in one, or in none;
* address: share of the area in the other documents of the same store;
* source: share of the area in the other documents of the same source.

A latent model, fitted by EM on the counts of code patterns of *all* documents, learns how often each
function gives each code when the area is meant and when it is not, and the areas' base rates. An
area is assigned where the posterior probability is at least one half.

Areas are those of a table (area, about); words that only one area's ``about`` text has are its seeds
beside the lexicon, as soon as the learned words bear them out (at once for an area without a lexicon).

Texts are cut into statements once; statements are kept as word numbers (64-bit hashes) in the shared
folder, from which the two counting passes and the scoring pass work. Every word of the corpus counts.
The word table is broadcast up to ``BROADCAST_WORDS`` rows; beyond, it is joined to the words of each
group of ``GROUP_DOCS`` documents, so that a task holds only the rows it needs. What is shuffled are word
statistics, one small row per document and pattern counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import checkpointed

#: Lexicon of each area, our own choice of words, in the languages of the documents.
LEXICON = {
    "traffic": "traffic vehicles cyclist motorist lorry junction tram motorway kreuzung ampel stau semáforo rotonda atasco carrefour embouteillage",
    "wildlife": "wildlife otter heron badger lynx migration herd plumage fährte wildschwein fischotter madriguera nutria jabalí terrier sanglier",
    "citytour": "tourist guide sightseer museum cathedral visitors palace stadtführerin domturm stadttor catedral turística mirador touristes cathédrale remparts",
    "cooking": "recipe kitchen chef dough sauce custard koch bäckerin gasherd cocinera masa caldo sofrito cuisinière bouillon poêle",
    "sport": "match athletes referee goalkeeper winger league tennis torwart staffel elfmeter portero balón árbitro gardien ballon arbitre",
    "workshop": "carpenter welder timber workbench blacksmith plumber mechanic hobelbank tischler lehrling taladro carpintero bisagra menuisier perceuse charnière",
    "medicine": "patients surgeon nurse hospital paramedic ward chirurg wunde krankenschwester notarzt cirujano enfermera herida chirurgien infirmière plaie",
    "software": "developer debugging deployment tester maintainer latency entwicklerin datenbank quelltext programadora compilación servidor développeuse serveur mainteneur memoria",
    "science": "experiment laboratory chemist physicist geologist botanist photon chemikerin labor mikroskop microscopio geólogo laboratorio chimiste géologue laboratoire",
    "law": "court judge lawyer juror contract plaintiff prosecutor gerichtssaal notar klageschrift abogado jueza testigo notaire avocat juge",
    "music": "concert cellist violin pianist trumpeter melody dirigentin schlagzeuger partitur baterista violonchelista orquesta orchestre violoncelliste batteur partition",
    "farming": "farmer crops livestock tractor harvest vintner landwirt imker kuhstall acker agricultor apicultor huerto agriculteur apiculteur verger",
}
#: Rows of the word table that are broadcast (at 12 areas 104 MB at most), and documents that share a
#: part of the table beyond.
BROADCAST_WORDS, GROUP_DOCS = 1 << 20, 20_000
#: Places (stores, sources) of which the sums are broadcast; beyond, they are joined by a shuffle.
BROADCAST_PLACES = 50_000
#: Evidence (log lift) that a statement needs, and the least share of its best area against the next.
MIN_EVIDENCE, MIN_SHARE = 1.2, 0.6
SMOOTH = 5.0
#: Share of an area's largest possible lift that does not count: the words of a language or a way of
#: writing lean a little to the areas that are usual there.
WEAK = 0.3
#: Upper ends of the codes of the shares. Code 0 is a passing mention or less.
LEXICON_BINS = (0.12,)
LEARNED_BINS = (0.15, 0.2)
PLACE_BINS = (0.02, 0.25)
SUBSTANTIAL = 1  # learned code that starts the model as "meant"; code 0 is never meant
CODES = (len(LEXICON_BINS) + 1, len(LEARNED_BINS) + 1, 3, len(PLACE_BINS) + 2, len(PLACE_BINS) + 2)  # the last of each place: abstains

_SECTION = re.compile(r"\n+| \| ")
_LEAD = re.compile(r"^\s*(?:[-*•]\s+|\[[^\]]*\]\s*|[QA]\d+:\s*|#\d+\s+score=[\d.]+\s*)+")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_WORD = re.compile(r"[^\W\d_]{3,}")
_DIGITS = re.compile(r"\d+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def statements(text: str) -> list[tuple[int, str]]:
    """(section, statement) of a text: sections are paragraphs, or the halves of a text that has
    one only; line marks, time stamps and scores in front of a statement are no part of it."""
    out = []
    blocks = [b for b in _PARAGRAPH.split(text) if b.strip()]
    for k, block in enumerate(blocks):
        for line in _SECTION.split(block):
            for s in _SENTENCE.split(_LEAD.sub("", line)):
                if s.strip():
                    out.append((k, s))
    if len(blocks) == 1 and len(out) > 3:
        out = [(2 * i // len(out), s) for i, (_, s) in enumerate(out)]
    return out


def number(word: str) -> int:
    """Positive 63-bit number of a word."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


class _Known:
    """Numbers of the words of statements, kept per worker."""

    def __init__(self) -> None:
        self.statements: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, int] = {}

    def __call__(self, key: str) -> tuple[int, ...]:
        got = self.statements.get(key)
        if got is None:
            if len(self.statements) > 300_000 or len(self.words) > 1_000_000:
                self.statements.clear()
                self.words.clear()
            out = []
            for w in set(_WORD.findall(key)):
                k = self.words.get(w)
                if k is None:
                    k = self.words[w] = number(w)
                out.append(k)
            got = self.statements[key] = tuple(sorted(set(out)))
        return got


_known = _Known()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (doc_id, store_no, source, text): section and word numbers of each statement."""
    for rb in batches:
        for i in range(0, rb.num_rows, 2000):
            part = rb.slice(i, 2000)
            per, secs, lens, flat = [0], [], [], []
            for text in part.column(3).to_pylist():
                if text:
                    for k, s in statements(text):
                        ws = _known(_DIGITS.sub("", s.casefold()))
                        secs.append(k)
                        lens.append(len(ws))
                        flat.extend(ws)
                per.append(len(secs))
            ends = np.concatenate([[0], np.cumsum(lens)])[per] if lens else np.zeros(len(per), np.int64)
            lists = lambda offsets, x, kind: pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(np.asarray(x, kind)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists(per, secs, np.int32), lists(per, lens, np.int32), lists(ends, flat, np.int64)], ["doc_id", "store_no", "source", "secs", "lens", "words"])


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group; groups lie end to end, ``starts`` has one more than there are groups."""
    out = np.zeros((len(starts) - 1, x.shape[1]))
    some = np.diff(starts) > 0
    if some.any():
        out[some] = np.add.reduceat(x, starts[:-1][some], axis=0)
    return out


class _Batch:
    """Statements of some documents as flat arrays, in order of document, statement and word."""

    def __init__(self, secs: pa.Array, lens: pa.Array, words: pa.Array):
        ints = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.n_docs = len(secs)
        self.sec, size = ints(secs), ints(lens)
        self.n = len(self.sec)
        self.of_doc = secs.offsets.to_numpy().astype(np.int64)
        self.of_doc = self.of_doc - self.of_doc[0]
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.of_doc))
        self.of_statement = np.concatenate([[0], np.cumsum(size)])
        self.row = np.repeat(np.arange(self.n), size)
        self.vocabulary, self.col = np.unique(ints(words), return_inverse=True)
        self.col = self.col.reshape(-1)

    def per_statement(self, by_word: np.ndarray) -> np.ndarray:
        return _sums(by_word[self.col], self.of_statement)

    def per_doc(self, by_statement: np.ndarray) -> np.ndarray:
        return _sums(by_statement, self.of_doc)

    def per_word(self, by_statement: np.ndarray) -> np.ndarray:
        order = np.argsort(self.col, kind="stable")
        return _sums(by_statement[self.row[order]], np.searchsorted(self.col[order], np.arange(len(self.vocabulary) + 1)))


def _parts(rb: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most 1000 documents and about half a million words (a longer document is alone)."""
    at = rb.column("words").offsets.to_numpy().astype(np.int64)
    i = 0
    while i < rb.num_rows:
        j = int(min(i + 1000, max(i + 1, np.searchsorted(at, at[i] + 500_000, "right") - 1)))
        yield rb.slice(i, j - i)
        i = j


class Lifts:
    """A row of values per word number; words without one have zeros."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def of(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(numbers), self.rows.shape[1]))
        at = np.minimum(np.searchsorted(self.keys, numbers), len(self.keys) - 1)
        return np.where((self.keys[at] == numbers)[:, None], self.rows[at], 0.0)

    def __contains__(self, word: str) -> bool:
        at = np.searchsorted(self.keys, number(word))
        return bool(at < len(self.keys) and self.keys[at] == number(word))


def seeds_of(words: dict[str, int], n_areas: int) -> Lifts:
    """Lexicon (word to area) as a table: the plural in -s of a word counts as the word."""
    rows: dict[int, set[int]] = {}
    for w, k in words.items():
        for x in {w, w if w.endswith("s") else w + "s"}:
            if words.get(x, k) == k:
                rows.setdefault(number(x), set()).add(k)
    one = {b: next(iter(ks)) for b, ks in rows.items() if len(ks) == 1}
    return Lifts(np.array(list(one), np.int64), np.eye(n_areas)[list(one.values())] if one else np.zeros((0, n_areas)))


def about_words(areas: dict[str, str]) -> dict[str, int]:
    """Words that the name or ``about`` text of one area alone has."""
    found: dict[str, set[int]] = {}
    for k, (name, about) in enumerate(areas.items()):
        for w in _WORD.findall(f"{name} {about}".casefold()):
            found.setdefault(w, set()).add(k)
    return {w: next(iter(ks)) for w, ks in found.items() if len(ks) == 1 and len(w) > 3}


def _lexicon_votes(b: _Batch, seeds: Lifts) -> np.ndarray:
    """1 for the area of a statement whose lexicon words are all of one area."""
    hits = b.per_statement(seeds.of(b.vocabulary))
    total = hits.sum(axis=1, keepdims=True)
    return np.where((total > 0) & (hits == total), 1.0, 0.0)


def _model_votes(b: _Batch, model: Lifts) -> np.ndarray:
    score = b.per_statement(model.of(b.vocabulary))
    order = np.sort(score, axis=1)
    top = order[:, -1:]
    second = np.maximum(order[:, -2:-1], 0) if order.shape[1] > 1 else np.zeros_like(top)
    sure = (top > MIN_EVIDENCE) & (1 / (1 + np.exp(second - top)) > MIN_SHARE)
    return np.where(sure & (score == top), 1.0, 0.0)


def _counting(seeds, k_areas: int):
    """Word statistics by area, summed per batch; ``cut`` rows with a model (None: the lexicon's votes)."""

    def run(batches: Iterator[pa.RecordBatch], model: Lifts | None) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part in _parts(rb):
                b = _Batch(*(part.column(c) for c in ("secs", "lens", "words")))
                if not b.n or not len(b.col):
                    continue
                lexicon = _lexicon_votes(b, seeds.value)
                votes = _model_votes(b, model) if model is not None else lexicon
                others = b.per_doc(votes)[b.doc] - votes  # of the rest of its document
                total = others.sum(axis=1, keepdims=True)
                around = np.where(total > 0.5, others / np.maximum(total, 1e-9), 0.0)
                mass = np.where(lexicon.sum(axis=1, keepdims=True) > 0, lexicon, around)
                counts = b.per_word(mass)
                keys = np.append(b.vocabulary, -1)  # -1 carries the mass of all statements
                counts = np.vstack([counts, mass.sum(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(counts[:, k]) for k in range(k_areas))], ["word", *(f"a{k}" for k in range(k_areas))])

    return run


def _applied(cut: DataFrame, run, model, schema: str) -> DataFrame:
    """``run(batches, model)`` over the rows of ``cut``. ``model``: None, a broadcast of Lifts, or a table
    (word, lift) that is too large for one; then each group of rows meets the part of it that it needs."""
    if not isinstance(model, DataFrame):
        return cut.mapInArrow(lambda batches: run(batches, model.value if model is not None else None), schema)
    group = F.concat_ws(":", F.spark_partition_id(), F.floor(F.monotonically_increasing_id() % (1 << 33) / GROUP_DOCS))
    rows = cut.withColumn("g", group)
    need = rows.select("g", F.explode("words").alias("word")).distinct().join(model, "word").select(F.col("g").alias("mg"), "word", "lift")
    width = len(model.first()["lift"])

    def met(docs: pa.Table, lifts: pa.Table) -> pa.Table:
        lifts = lifts.combine_chunks()
        flat = lifts.column("lift").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if lifts.num_rows else np.zeros((0, width))
        out = list(run(iter(docs.drop_columns(["g"]).combine_chunks().to_batches()), Lifts(lifts.column("word").to_numpy(), flat)))
        return pa.Table.from_batches(out) if out else None

    def safe(docs: pa.Table, lifts: pa.Table) -> pa.Table:
        got = met(docs, lifts) if docs.num_rows else None
        return got if got is not None else empty

    empty = cut.sparkSession.createDataFrame([], schema).toArrow()
    return rows.groupBy("g").cogroup(need.groupBy("mg")).applyInArrow(safe, schema)


def _learn(cut: DataFrame, seeds, model, k_areas: int):
    """Log lift of each word for each area, over all documents: a broadcast, or a table if it is large."""
    cols = [f"a{k}" for k in range(k_areas)]
    counts = _applied(cut, _counting(seeds, k_areas), model, "word bigint, " + ", ".join(f"{c} double" for c in cols))
    counts = checkpointed(counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in cols)))
    whole = counts.where("word < 0").select(*cols).toPandas().to_numpy(float).sum(axis=0)
    p = (whole + 1e-3) / (whole + 1e-3).sum()

    def lifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.column_stack([b.column(i).to_numpy() for i in range(1, k_areas + 1)])
            lift = np.clip(np.log((c + SMOOTH * p) / ((c.sum(axis=1, keepdims=True) + SMOOTH) * p)), -3, 5)
            lift = (np.sign(lift) * np.maximum(np.abs(lift) + WEAK * np.log(p), 0)).round(9)
            some = lift.any(axis=1)  # all zero is like no row
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k_areas), pa.array(lift[some].reshape(-1)))], ["word", "lift"])

    table = counts.where("word >= 0").mapInArrow(lifted, "word bigint, lift array<double>")
    if table.limit(BROADCAST_WORDS + 1).count() > BROADCAST_WORDS:
        return checkpointed(table)
    rows = table.toArrow().combine_chunks()
    flat = rows.column("lift").combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0)
    return cut.sparkSession.sparkContext.broadcast(Lifts(rows.column("word").to_numpy(), flat.reshape(-1, k_areas)))


def _lifts_of(model, words: list[str], k_areas: int) -> np.ndarray:
    """Lifts of a few words."""
    keys = np.array([number(w) for w in words], np.int64)
    if isinstance(model, DataFrame):
        rows = model.where(F.col("word").isin(keys.tolist())).collect()
        model = Lifts(np.array([r["word"] for r in rows], np.int64), np.array([r["lift"] for r in rows]).reshape(-1, k_areas))
    else:
        model = model.value
    return model.of(keys)


def _code(share: np.ndarray, bins: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.asarray(bins), share, side="left").astype(np.int64)


def _scoring(seeds, k_areas: int):
    """Codes and statement counts per document, from rows of ``cut`` with a model."""

    def run(batches: Iterator[pa.RecordBatch], model: Lifts) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part in _parts(rb):
                b = _Batch(*(part.column(i) for i in range(3, 6)))
                n = b.n_docs
                if b.n:
                    total = np.maximum(np.bincount(b.doc, minlength=n), 1)[:, None]
                    best = _model_votes(b, model)
                    lex, got = b.per_doc(_lexicon_votes(b, seeds.value)) / total, b.per_doc(best)
                    width = int(b.sec.max()) + 1
                    secs, at = np.unique(b.doc * width + b.sec, return_inverse=True)
                    at = at.reshape(-1)
                    per = _sums(best, np.searchsorted(at, np.arange(len(secs) + 1)))  # sections come in order
                    leads = (per > np.minimum(1, np.bincount(at)[:, None] - 1)) & (per == per.max(axis=1, keepdims=True))
                    section = np.zeros((n, k_areas), np.int64)
                    np.maximum.at(section, secs // width, leads.astype(np.int64) + (per > 0))
                    lex_code, learned = _code(lex, LEXICON_BINS), _code((got / total).round(9), LEARNED_BINS)
                else:
                    got, section, lex_code, learned = np.zeros((n, k_areas)), *(np.zeros((n, k_areas), np.int64) for _ in range(3))
                codes = (lex_code * CODES[1] + learned) * CODES[2] + section
                flat = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k_areas, pa.int32()), pa.array(x.reshape(-1), t))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), flat(codes.astype(np.int32), pa.int32()), flat(got.astype(np.int64), pa.int64())], ["doc_id", "store_no", "source", "codes", "counts"])

    return run


def _others_share(df: DataFrame, place: str, into: str, k_areas: int) -> DataFrame:
    """Add the code of the area's share in the other documents of the same place."""
    sums = df.where(F.col(place).isNotNull()).groupBy(place).agg(*(F.sum(F.get("counts", F.lit(k))).alias(f"s{k}") for k in range(k_areas)))
    sums = sums.select(place, F.array(*(F.col(f"s{k}") for k in range(k_areas))).alias("sums"))
    few = sums.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    joined = df.join(F.broadcast(sums) if few else sums, place, "left")
    rest = F.aggregate(F.zip_with("sums", "counts", lambda s, c: s - c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    abstains = F.array(*(F.lit(len(PLACE_BINS) + 1) for _ in range(k_areas)))

    def code(s, c):
        share = (s - c) / F.col("rest")
        out = F.lit(len(PLACE_BINS))
        for j in range(len(PLACE_BINS) - 1, -1, -1):
            out = F.when(share <= PLACE_BINS[j], j).otherwise(out)
        return out

    return joined.withColumn("rest", rest).withColumn(into, F.when(F.col("rest") > 0, F.zip_with("sums", "counts", code)).otherwise(abstains)).drop("sums", "rest")


def fit_latent(area: np.ndarray, codes: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior that an area is meant for each pattern: a two-class latent model with one base rate
    per area and, per function, the probabilities of its codes in either class, by EM.

    ``codes``: patterns x functions; ``n``: how many (document, area) have the pattern."""
    post = np.where(start, 0.95, 0.02)
    k_areas = int(area.max()) + 1
    for _ in range(rounds):
        w1, w0 = post * n, (1 - post) * n
        rate = (np.bincount(area, weights=w1, minlength=k_areas) + 1) / (np.bincount(area, weights=n, minlength=k_areas) + 20)
        logit = np.log(rate[area]) - np.log1p(-rate[area])
        for j in range(codes.shape[1]):
            size = CODES[j]
            e1 = np.bincount(codes[:, j], weights=w1, minlength=size) + 0.5
            e0 = np.bincount(codes[:, j], weights=w0, minlength=size) + 0.5
            logit += np.log(e1 / e1.sum())[codes[:, j]] - np.log(e0 / e0.sum())[codes[:, j]]
        post = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return post


def subject_areas(docs: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Areas that each document is about: doc_id, area, probability.

    ``docs``: doc_id, text, store_no, source. ``areas``: area, about (by default those of the lexicon). A
    null, empty or blank text, and one that names no subject, has no row. Repeated rows are judged alike
    and each counts in the statistics; a null store or source abstains; an empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    given = {r["area"]: r["about"] or "" for r in areas.where("area is not null").select("area", "about").orderBy("area").collect()} if areas is not None else dict.fromkeys(LEXICON, "")
    names = list(given)
    k_areas = len(names)
    key = dict(docs.dtypes)["doc_id"]
    if not names:
        return spark.createDataFrame([], f"doc_id {key}, area string, probability double")
    docs = docs.select("doc_id", F.col("store_no").cast("bigint").alias("store_no"), F.col("source").cast("string").alias("source"), "text")
    cut = checkpointed(docs.mapInArrow(_cut, f"doc_id {key}, store_no bigint, source string, secs array<int>, lens array<int>, words array<bigint>"))
    lexicon = {w: names.index(a) for a, ws in LEXICON.items() if a in given for w in ws.split()}
    about = {w: k for w, k in about_words(given).items() if w not in lexicon}
    share = spark.sparkContext.broadcast
    seeds = share(seeds_of(lexicon | {w: k for w, k in about.items() if names[k] not in LEXICON}, k_areas))
    model = _learn(cut, seeds, None, k_areas)
    # words of the about texts that the learned words bear out
    lift = _lifts_of(model, list(about), k_areas)
    borne = {w: k for (w, k), x in zip(about.items(), lift) if x[k] > MIN_EVIDENCE and x[k] == x.max()}
    seeds = share(seeds_of(lexicon | borne | {w: k for w, k in about.items() if names[k] not in LEXICON}, k_areas))
    model = _learn(cut, seeds, model, k_areas)
    scored = checkpointed(_applied(cut, _scoring(seeds, k_areas), model, f"doc_id {key}, store_no bigint, source string, codes array<int>, counts array<bigint>"))
    placed = _others_share(_others_share(scored, "store_no", "address", k_areas), "source", "origin", k_areas)
    pairs = placed.select("doc_id", F.posexplode(F.arrays_zip("codes", "address", "origin")).alias("area_no", "z")).select(
        "doc_id", "area_no", ((F.col("z.codes") * CODES[3] + F.col("z.address")) * CODES[4] + F.col("z.origin")).alias("pattern")
    )
    # one row per (area, pattern): of fixed size, however many documents there are
    seen = pairs.groupBy("area_no", "pattern").count().toPandas().sort_values(["area_no", "pattern"], kind="stable")
    rows = []
    if len(seen):
        pattern = seen["pattern"].to_numpy(np.int64)
        codes = np.column_stack(np.unravel_index(pattern, CODES))
        area = seen["area_no"].to_numpy(np.int64)
        post = fit_latent(area, codes, seen["count"].to_numpy(float), codes[:, 1] >= SUBSTANTIAL)
        rows = [(int(a), int(p), names[a], round(float(x), 6)) for a, p, x in zip(area, pattern, post) if x >= 0.5]
    meant = spark.createDataFrame(rows, "area_no int, pattern int, area string, probability double")
    return pairs.join(F.broadcast(meant), ["area_no", "pattern"]).select("doc_id", "area", "probability")


def agreement(found: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: raters' labels (doc_id, area; spelling and repetitions evened out) against ``found`` of the
    same documents: labels, assigned, both, precision, recall. The labels are never fitted on."""
    said = labels.select("doc_id", F.lower(F.trim("area")).alias("area")).where("doc_id is not null and area <> ''").distinct()
    mine = found.select("doc_id", "area").distinct().join(said.select("doc_id").distinct(), "doc_id", "left_semi")
    one = said.withColumn("s", F.lit(1)).join(mine.withColumn("m", F.lit(1)), ["doc_id", "area"], "full_outer")
    out = one.agg(F.count("s").alias("labels"), F.count("m").alias("assigned"), F.count(F.when(F.col("s").isNotNull() & F.col("m").isNotNull(), 1)).alias("both"))
    return out.select("*", F.round(F.try_divide("both", "assigned"), 4).alias("precision"), F.round(F.try_divide("both", "labels"), 4).alias("recall"))
