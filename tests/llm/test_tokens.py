import base64
import os
import random
from collections import Counter
from pathlib import Path

import pytest

from tideline.llm.bpe import TOKENIZER_DIR, MergeReplay, encode_texts, pattern, token_counts
from tideline.llm.packing import pack, sum_of_squares

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no public tokenizers")
TEXTS = ["", " ", "Hello world, hello World!", "it's they're we'll I'd", "a" * 5000, "abababababcabc" * 300, "日本語テキスト" * 200, "!" * 999, " " * 700 + "x", "<|endoftext|> plain", "café  vs\tcafé\n\nnaïve", "👨‍👩‍👧 ✨", "\x00\x01", "x y z​q", "‮abc"]


def reference(name):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(Path(TOKENIZER_DIR, f"{name}.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_against_reference(name):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("abc de'ſs.,!012日é\n ") for _ in range(r.randint(0, 60))) for _ in range(300)]
    m = MergeReplay(Path(TOKENIZER_DIR, f"{name}.tiktoken").read_bytes(), pattern())
    flat, off = m.encode(texts)
    enc = reference(name)
    for i, t in enumerate(texts):
        assert flat[off[i] : off[i + 1]].tolist() == enc(t), t[:50]


def test_table(spark):
    enc = reference("byte_bpe_50k")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (0, TEXTS[2]), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as n_tokens").repartition(3)
    got = Counter((r.doc_id, tuple(r.ids)) for r in encode_texts(df, "doc_id").collect())
    assert got == Counter((i, tuple(enc(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts(df, "doc_id").collect()) == Counter((i, len(enc(t or ""))) for i, t in rows)
    assert encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id").count() == 0


def test_sum_of_squares():
    r = random.Random(2)
    sizes = [r.randint(1, 60) for _ in range(3000)]
    where, fills = sum_of_squares(sizes, 100)
    load = Counter()
    for s, c in zip(sizes, where):
        load[c] += s
    assert [load[c] for c in range(len(fills))] == fills and max(fills) <= 100
    assert sum(sizes) / (100 * len(fills)) > 0.97
    assert sum_of_squares([], 10) == ([], []) and sum_of_squares([10, 10], 10) == ([0, 1], [10, 10])


def test_pack(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 5, 30, 47, 64, 130, 250])) for i in range(500)] + [(7, 30), (None, 12), (900, None), (901, -4)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint").selectExpr("*", "1 as shard", "2 as box", "3 as fill")
    for shard_items in (40, 20_000):
        got = pack(df, "doc_id", "n", 64, shard_items=shard_items).collect()
        load, fill = Counter(), {}
        for t in got:
            load[t.container_id] += t.n_tokens
            fill[t.container_id] = t.fill
        assert max(load.values()) <= 64 and all(load[c] == f for c, f in fill.items())
        assert Counter({k: sum(t.n_tokens for t in got if t.doc_id == k) for k in range(500)}) == Counter({k: sum(max(n or 0, 0) for i, n in rows if i == k) for k in range(500)})
        parts = Counter(t.doc_id for t in got)
        assert all(parts[i] == max(1, -(-n // 64)) for i, n in rows[:500] if i != 7)
    assert pack(df.limit(0), "doc_id", "n", 64).count() == 0


def test_fill_report(spark):
    """No container is overfull, no token is lost, nothing that fits is split, and the number of containers
    is within a few of the least possible."""
    from tideline.llm.packing import fill_report

    r = random.Random(9)
    rows = [(i, int(r.lognormvariate(3, 1))) for i in range(4000)] + [(9000, 5000), (9001, None), (9002, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint")
    got = fill_report(pack(df, "doc_id", "n", 512, shard_items=900), 512).first()
    assert got.tokens == sum(n or 0 for _, n in rows) and got.overfull == got.wrong_fill == got.wrongly_split == 0
    assert got.split_items == sum((n or 0) > 512 for _, n in rows) and got.least_containers <= got.containers <= 1.02 * got.least_containers + 3
    none = fill_report(pack(df.limit(0), "doc_id", "n", 512), 512).first()
    assert (none["items"], none.tokens, none.containers) == (0, 0, 0)
