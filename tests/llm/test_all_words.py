from tideline.llm import subjects


def test_no_word_is_left_out_by_the_size_of_the_vocabulary(spark):
    a, b = ([w for w in ws.split() if w.isalpha() and len(w) > 4][0] for ws in list(subjects.LEXICON.values())[:2])
    name = lambda i: "q" + "".join(chr(97 + i // 26**j % 26) for j in range(4)) + "x"
    words = [name(i) for i in range(50_400)]
    lines = [f"The {a if i % 100 < 50 else b} {' '.join(words[i : i + 5])}." for i in range(0, len(words), 5)]
    docs = [(" ".join(lines[i : i + 200]),) for i in range(0, len(lines), 200)]
    docs = spark.createDataFrame(docs * 3, "text string").selectExpr("1L as doc_id", "1L as store_no", "'s' as source", "text")
    cut = docs.mapInArrow(subjects._cut, "doc_id bigint, store_no bigint, source string, secs array<int>, lens array<int>, words array<bigint>")
    names = list(subjects.LEXICON)
    seeds = subjects.seeds_of({w: names.index(k) for k, ws in subjects.LEXICON.items() for w in ws.split()}, len(names))
    got = subjects._learn(cut, spark.sparkContext.broadcast(seeds), None, len(names)).value
    assert all(w in got for w in words)


def test_large_word_table(spark, monkeypatch):
    """A word table that is not broadcast gives the same areas."""
    from test_subjects import SCHEMA, corpus

    df = spark.createDataFrame(corpus()[0], SCHEMA).repartition(3)
    rows = lambda: sorted((r.doc_id, r.area, r.probability) for r in subjects.subject_areas(df).collect())
    want = rows()
    monkeypatch.setattr(subjects, "BROADCAST_WORDS", 3)
    monkeypatch.setattr(subjects, "GROUP_DOCS", 50)
    assert want and rows() == want


def test_areas_come_from_the_table(spark):
    """An area that the lexicon does not know is seeded by its about text; one that is left out is not assigned."""
    from test_subjects import SCHEMA, corpus

    rows = [(i, text.replace("chef", "potter").replace("sauce", "glaze"), n, s) for i, text, n, s in corpus()[0]]
    areas = spark.createDataFrame([(1, "traffic", "vehicles"), (2, "pottery", "clay, glaze and the potter's wheel"), (3, "music", None), (4, None, "x")], "area_no int, area string, about string")
    got = {}
    for r in subjects.subject_areas(spark.createDataFrame(rows, SCHEMA), areas).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    assert {a for v in got.values() for a in v} == {"traffic", "pottery", "music"}
    assert sum("pottery" in got.get(i, ()) for i in range(240) if 3 in (i % 4, i // 4 % 4)) > 100
    assert subjects.subject_areas(spark.createDataFrame(rows, SCHEMA), areas.limit(0)).count() == 0
