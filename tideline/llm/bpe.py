"""Encoding of a corpus with a public byte-level BPE vocabulary by merge replay.

The texts of a batch are cut into words by the vocabulary's pattern; the distinct words that are not
known yet are laid end to end as byte symbols in one doubly linked list. An inverted index maps each
pair of neighbouring symbols to the positions where it stands, and a queue yields the pairs in order
of their merge rank. Each merge is applied at all its positions at once, and only the two pairs on
either side of a merged position are touched. Every text is then the concatenation of its words' ids.

Words repeat across a corpus, so each is merged once per worker, whatever the number of texts; the
operator needs no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabulary files are; a parameter, the files are never copied here.
TOKENIZER_DIR = "/opt/tokenizers"
#: Words whose ids a worker keeps; beyond it the memory starts anew (results do not depend on it).
CACHE_WORDS = 300_000


def pattern() -> str:
    """The word pattern that belongs to the vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class MergeReplay:
    def __init__(self, vocabulary: bytes, pat: str):
        """``vocabulary``: lines of base64 token and rank."""
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.text = {i: t for t, i in self.rank.items()}
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        self.words = regex.compile(pat).findall
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _merge_of(self, pair: tuple[int, int]) -> int:
        """Rank of the token that a pair merges into (its id), or -1."""
        got = self.merged.get(pair)
        if got is None:
            got = self.merged[pair] = self.rank.get(self.text[pair[0]] + self.text[pair[1]], -1)
        return got

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of distinct words, by replaying the merges over all of them together."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        sym: list[int] = []
        start: list[tuple[int, int, int]] = []
        for k, w in enumerate(words):
            whole = self.rank.get(w)
            if whole is not None and len(w) == 1:
                out[k] = (whole,)
            else:
                start.append((k, len(sym), len(sym) + len(w)))
                sym.extend(map(self.byte.__getitem__, w))
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        for _, i, j in start:
            left[i], right[j - 1] = -1, -1
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in range(n):
            if right[i] >= 0:
                places[(sym[i], sym[i + 1])].append(i)
        queue = [(r, p) for p in places if (r := self._merge_of(p)) >= 0]
        heapq.heapify(queue)
        while queue:
            rank, pair = heapq.heappop(queue)
            at = places.pop(pair, None)
            if at is None:
                continue
            at.sort()
            a, b = pair
            fresh: set[tuple[int, int]] = set()
            for k, i in enumerate(at):
                j = right[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue  # merged with another neighbour meanwhile
                sym[i], sym[j] = rank, -1
                after = right[j]
                right[i] = after
                sooner = False
                if after >= 0:
                    left[after] = i
                    p = (rank, sym[after])
                    places[p].append(i)
                    fresh.add(p)
                    sooner = 0 <= self._merge_of(p) < rank
                before = left[i]
                if before >= 0:
                    p = (sym[before], rank)
                    places[p].append(before)
                    fresh.add(p)
                    sooner |= 0 <= self._merge_of(p) < rank
                if sooner and k + 1 < len(at):  # a pair of lower rank came up: it goes first
                    places[pair] = at[k + 1 :] + places.get(pair, [])
                    fresh.add(pair)
                    break
            for p in fresh:
                r = self._merge_of(p)
                if r >= 0:
                    heapq.heappush(queue, (r, p))
        for k, i, j in start:
            out[k] = tuple(s for s in sym[i:j] if s >= 0)
        return out

    def learn(self, words: set[str]) -> None:
        new = sorted(words.difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = sorted(words)
        if new:
            self.known.update(zip(new, self.replay([w.encode("utf-8", "surrogatepass") for w in new])))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of texts; an empty or null text has no ids."""
        cut = [self.words(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        ids = [list(chain.from_iterable(map(self.known.__getitem__, ws))) for ws in cut]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])), offsets


_LOADED: dict[bytes, MergeReplay] = {}


def _replay(vocabulary: bytes, pat: str) -> MergeReplay:
    key = hashlib.md5(vocabulary + pat.encode()).digest()
    if key not in _LOADED:
        _LOADED[key] = MergeReplay(vocabulary, pat)
    return _LOADED[key]


def _slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text (a longer text is alone)."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    i = total = 0
    for j, s in enumerate(size.tolist()):
        if total and total + s > most:
            yield i, j
            i, total = j, 0
        total += s
    if i < len(size):
        yield i, len(size)


def encoded_batches(vocabulary, pat: str, lengths_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow over (key, text): key and ids, or key and number of ids. ``vocabulary``: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        bpe = _replay(vocabulary.value, pat)
        for b in batches:
            for i, j in _slices(b.column(1)):
                flat, offsets = bpe.encode(b.column(1).slice(i, j - i).to_pylist())
                out = pa.array(np.diff(offsets)) if lengths_only else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), out], [b.schema.names[0], "n_tokens" if lengths_only else "ids"])

    return run


def _shared(df: DataFrame, tokenizer: str, folder: str):
    """The vocabulary file as a broadcast: of fixed size, under 1 MB."""
    return df.sparkSession.sparkContext.broadcast(Path(folder, f"{tokenizer}.tiktoken").read_bytes())


def encode_texts(df: DataFrame, key: str, text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Token ids of every row's text: key, ids (array<int>). Empty and null texts have an empty list;
    strings of special tokens are ordinary text; repeated rows come out repeated; an empty table
    gives an empty result; further columns are left out."""
    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(encoded_batches(_shared(df, tokenizer, folder), pattern(), False), f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Number of tokens of every row's text: key, n_tokens (0 for empty and null texts)."""
    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(encoded_batches(_shared(df, tokenizer, folder), pattern(), True), f"`{key}` {kind}, n_tokens bigint")
