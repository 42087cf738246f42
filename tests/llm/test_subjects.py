import os

import numpy as np
import pytest

from tideline.llm.subjects import CODES, LEXICON, fit_latent, statements, subject_areas

SCHEMA = "doc_id bigint, text string, store_no bigint, source string"


def test_statements():
    assert [s for _, s in statements("[1:02-1:05] One cat.\n* Two dogs! Three.\nQ1: Four?\n#3 score=0.5 Five. | #4 score=0.1 Six.")] == ["One cat.", "Two dogs!", "Three.", "Four?", "Five.", "Six."]
    assert [k for k, _ in statements("A b. C d.\n\nE f.")] == [0, 0, 1] and statements("  ") == []


def test_latent_model_separates():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    codes = np.column_stack([np.where(y, r.random(4000) < 0.8, r.random(4000) < 0.05), np.where(y, 2, 0), np.where(y, r.choice([1, 2], 4000), 0), r.integers(0, 4, 4000), r.integers(0, 4, 4000)]).astype(int)
    keys, at, n = np.unique(codes, axis=0, return_inverse=True, return_counts=True)
    post = fit_latent(np.zeros(len(keys), int), keys, n.astype(float), keys[:, 1] >= 1)
    assert ((post[at.reshape(-1)] >= 0.5) == y).mean() > 0.99 and keys.max(axis=0).tolist() <= [c - 1 for c in CODES]


def corpus(n=240):
    talk = {"traffic": "The cyclist waits at the junction.", "music": "The cellist tunes the violin.", "law": "The judge reads the contract.", "cooking": "The chef stirs the sauce."}
    fact = {"traffic": "Headway shrinks sharply.", "music": "Reverb hides the breath.", "law": "Bail gets denied today.", "cooking": "Garlic goes in late."}
    names = list(talk)
    rows = []
    for i in range(n):
        a, b = names[i % 4], names[(i // 4) % 4]
        rows.append((i, " ".join([talk[a], fact[a], "The picture is blurred.", talk[a], fact[a], talk[b], fact[b]]), i % 5, "s"))
    return rows, names


def test_areas(spark):
    rows, names = corpus()
    extra = [(1000, None, 1, None), (1001, "", 1, "s"), (1002, "   ", None, "s"), (1003, "The picture is blurred.", 2, "s"), (1004, "Garlic goes in late. Garlic goes in late.", None, None), (0, rows[0][1], 0, "s"), (1005, "The judge reads the contract. " * 20 + "The chef stirs the sauce.", 3, "s"), (1006, "x" * 200_000, 1, "s")]
    df = spark.createDataFrame(rows + extra, SCHEMA).selectExpr("*", "'q' as area", "1 as codes", "2 as counts").repartition(4)
    got = {}
    for r in subject_areas(df).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    good = sum(got.get(i, set()) == {names[i % 4], names[(i // 4) % 4]} for i in range(len(rows)))
    assert good / len(rows) > 0.95
    assert not {1000, 1001, 1002, 1003, 1006} & got.keys() and got[1004] == {"cooking"} and got[1005] == {"law"}
    assert subject_areas(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_agreement_with_raters(spark):
    d = "/root/testdata/sf0.01"
    got = {tuple(r) for r in subject_areas(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "area").collect()}
    said = {(r.doc_id, r.area.strip().lower()) for r in spark.read.parquet(f"{d}/doc_area_labels.parquet").where("area is not null").collect()}
    assert {a for _, a in said} <= set(LEXICON)
    ids = {i for i, _ in said}
    mine = {x for x in got if x[0] in ids}
    assert len(mine & said) / len(mine) > 0.8 and len(mine & said) / len(said) > 0.8
