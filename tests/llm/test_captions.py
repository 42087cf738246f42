import random

import pytest

from tideline.llm.captions import Spelling, caption_runs, similarity, slips, words

BASE = "Four bailiffs cross-examine on the dark-green lease contract in the hearing chamber."
SAME = [
    "4 bailiffs cross-examine on the dark-green lease contract in the hearing chamber;", "[03:45] four bailiffs cross-examine on the dark-green lease contract in the hearing chamber", "12:43 - " + BASE, "* " + BASE, "caption: " + BASE, "chunk 33: " + BASE,
    "(cont.) " + BASE, BASE[:-1] + " - same scene", BASE[:-1] + " as before (continued)", BASE[:-1] + ", still", BASE.upper(), BASE.replace("-", "‑"), BASE.replace("bailiffs", "baillifs"), BASE.replace("contract", "contrct"), BASE.replace("cross-examine", "are cross-examining"), BASE.replace("the dark", "a dark"),
]
OTHER = [BASE.replace("Four", "Three"), BASE.replace("green", "grey"), BASE.replace("bailiffs", "judges"), BASE.replace("hearing chamber", "court room"), BASE.replace("lease contract", "verdict"), BASE.replace("cross-examine on", "object to"), "", BASE + " Two leave."]


@pytest.mark.parametrize("text", SAME)
def test_same(text):
    assert similarity(words(BASE), words(text)) >= 0.8


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    assert similarity(words(BASE), words(text)) == 0


def test_slips():
    assert [slips("carrot", "parrot", 2), slips("camera", "camra", 1), slips("north", "south", 2), slips("mteronome", "metronome", 1)] == [None, 1, None, 1]


SCHEMA = "store_no bigint, pos bigint, description string, duration array<double>, loaded_at int"


def found(df, **kw):
    return sorted((r.store_no, r.first_pos, r.last_pos, r.event_count) for r in caption_runs(df, **kw).collect())


def test_runs(spark):
    texts = ["a cat sits", "A cat sits.", None, "a cat sits", "a cat sits", "a dog sits", "a dog sits", "", "a dog sits"]
    rows = [(1, i, t, [float(i), i + 1.0], 0) for i, t in enumerate(texts)] + [(1, 4, "a cat sits", [4.0, 5.0], 1), (None, 1, "x", None, 0), (2, None, "x", None, 0), (3, 5, "one event", None, 0), (3, 5, "one event", None, 1), (4, 0, "z z z", None, 0), (4, 9, "z z z", [3.0, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as caption", "1 as block", "2 as owner")
    want = [(1, 0, 1, 2), (1, 3, 4, 2), (1, 5, 6, 2), (4, 0, 9, 2)]
    for block in (2, 3, 4, 2048):
        assert found(df, block=block) == want, block
    one = {r.first_pos: r for r in caption_runs(df).where("store_no = 1").collect()}
    assert (one[0].start_s, one[0].end_s, one[0].duration_s) == (0.0, 2.0, 2.0)
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_long_runs_cross_blocks(spark):
    r = random.Random(4)
    rows, want, pos = [], [], 0
    for k in range(40):
        n = r.choice([1, 1, 2, 3, 40])
        if n > 1:
            want.append((1, pos, pos + n - 1, n))
        for _ in range(n):
            rows.append((1, pos, f"{r.choice(['', '* ', '[0:1] '])}the thing number {'abcdefghijklmnopqrstuvwxyz'[k % 26] * 5} moves{r.choice(['', '.', ' as before'])}", None, 0))
            pos += 1
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for block in (5, 16, 2048):
        assert found(df, block=block) == want


def test_gap_limit(spark):
    rows = [(1, i, "a cat sits", [s, s + 1], 0) for i, s in enumerate([0.0, 2.0, 60.0, 61.5])]
    assert found(spark.createDataFrame(rows, SCHEMA), gap=10.0) == [(1, 0, 1, 2), (1, 2, 3, 2)]


PAIRS = [
    ("The dog runs", "The dogs run"), ("A car is parked", "Cars are parked"), ("A cat stands", "A cart stands"), ("a black car", "a back car"), ("A boy", "A buoy"), ("a horse", "a hose"),
    ("Two nurses wait", "Two nurse wait"), ("A lawyer speaks", "A layer speaks"), ("a tin roof", "a thin roof"), ("he goes through it", "he goes trough it"),
]
USED = Spelling({w: 40 for p in PAIRS for c in p for w in words(c)} | {"gardener": 900, "waters": 700, "roses": 800, "watering": 300})


@pytest.mark.parametrize("a, b", PAIRS)
def test_words_in_use_differ(a, b):
    """Number and identity: two words that are both in use are never slips of each other."""
    assert similarity(words(a), words(b), USED) == 0
    assert similarity(words(a), words(b)) == 0


@pytest.mark.parametrize("text", ["The gardner waters roses", "The gardener watres roses", "The gaardener waters rosses", "The gardener is watering roses", "The gradener is wateering roses"])
def test_slips_are_rare(text):
    assert similarity(words("The gardener waters roses"), words(text), USED) >= 0.8


def test_one_is_an_article():
    assert similarity(words("One man waits"), words("A man waits")) == 1 == similarity(words("1 man waits"), words("a man waits"))
    assert similarity(words("One man waits"), words("Two man waits")) == 0


def test_spelling_is_learned(spark):
    """The same two captions are one run where one word is a rare slip, and two events where both are used."""
    many = [(9, 10 * i, t, None, 0) for i in range(200) for t in ["a cat stands"]]
    pair = [(1, 0, "a cat stands", None, 0), (1, 1, "a cart stands", None, 0)]
    carts = [(8, 10 * i, "a cart stands", None, 0) for i in range(100)]
    at = lambda rows: [r for r in found(spark.createDataFrame(rows, SCHEMA)) if r[0] == 1]
    assert at(many + pair) == [(1, 0, 1, 2)]
    assert at(many + carts + pair) == []


def test_block_does_not_matter(spark):
    r = random.Random(6)
    say = ["a man is carrying boxes", "a man carries boxes", "a man carires boxes", "a man carriies boxes", "two men wait", None, "a dog sleeps"]
    rows, prev = [], 0
    for pos in range(600):
        prev = prev if r.random() < 0.7 else r.randrange(len(say))
        k = r.randrange(4) if prev < 4 else prev
        rows.append((pos % 2 + 1, pos, say[k], [float(pos), pos + r.choice([1.0, 5.0])], 0))
    df = spark.createDataFrame(rows, SCHEMA)
    for gap in (None, 2.0):
        got = [found(df, block=b, gap=gap) for b in (3, 7, 64, 2048)]
        assert got[0] and all(g == got[0] for g in got)
