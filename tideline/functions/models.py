"""Surfaces for models, with deterministic stand-ins that need no weights."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import checkpointed


def hash_embedder(dim: int = 64):
    """Arrow UDF text -> unit vector: signed counts of hashed words. Null and wordless texts give null."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).astype(np.float32) if n else None)
        return pd.Series(out)

    return embed


def generate(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """Adds ``response``: ``model`` over batches of prompts; a failed batch becomes ``[ERROR] ...`` text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[str] = []
            for i in range(0, len(pdf), batch):
                part = pdf[prompt].iloc[i : i + batch].tolist()
                try:
                    out += model(part)
                except Exception as e:  # noqa: BLE001
                    out += [f"[ERROR] {e}"] * len(part)
            yield pdf.assign(response=out)

    return df.mapInPandas(run, df.selectExpr("*", "'' as response").schema)


def generate_with_retry(df: DataFrame, key: list[str], prompt: str, model: Callable[[list[str], int], list[str | None]], most: int = 3, batch: int = 64) -> DataFrame:
    """Adds ``response`` and ``fails``: rows that the model leaves unanswered (None, or a failed batch) are asked again, up
    to ``most`` times; only these rows are asked again. ``model``: prompts and number of the attempt to answers.
    ``key`` is unique. What stays unanswered has a null response."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, prompt]) + ", response string"

    def asking(attempt: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out: list[str | None] = []
                for i in range(0, len(pdf), batch):
                    part = pdf[prompt].iloc[i : i + batch].tolist()
                    try:
                        out += model(part, attempt)
                    except Exception:  # noqa: BLE001
                        out += [None] * len(part)
                yield pdf[[*key, prompt]].assign(response=out)

        return run

    left, done = df.select(*key, prompt), None
    for attempt in range(most):
        got = checkpointed(left.mapInPandas(asking(attempt), schema))
        last = attempt == most - 1
        part = got.where(F.lit(True) if last else F.col("response").isNotNull()).withColumn("fails", F.lit(attempt) + F.col("response").isNull().cast("int"))
        done = part if done is None else done.unionByName(part)
        left = got.where("response is null").select(*key, prompt)
        if last or not left.take(1):
            break
    return df.join(done.select(*key, "response", "fails"), key)


def words_of(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``b`` that ``a`` has: a stand-in for a pair scorer's recall."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words_of(a), words_of(b))).cast("double"), F.size(words_of(b))), F.lit(0.0))


def capitalised_objects(text: Column, stop: list[str]) -> Column:
    """Capitalised words of a text without stop words, the first spelling of each, in lower-case order."""
    found = F.filter(F.split(text, "[^\\p{L}]+"), lambda w: w.rlike("^[A-Z][a-z]{2,}$"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: ~w.isin(stop))))


class Detector:
    """UDTF: one row per detected object of a caption: label (cut to 77 words), score (three decimals), start of the
    label, and a box (two decimals) whose place across a picture of width 1 is the label's place in the text."""

    def eval(self, caption: str, labels: str):
        text = (caption or "").lower()
        for label in (labels or "").lower().split(","):
            label = " ".join(label.split()[:77])
            at = text.find(label)
            if label and at >= 0:
                shown = lambda x, by: math.floor(x * by + 0.5) / by
                n = len(text)
                yield label, shown(0.5 + len(label) / (2.0 * n), 1000), at, shown(at / n, 100), 0.25, shown((at + len(label)) / n, 100), 0.75
