import json


import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.operators.structural_json import StructuralIndex, array_links, json_nodes, question_links

BASIC = ['{"a":1}', "[1,2", "[1,]", '{"a" 1}', '{"a":}', "[] []", '"x"', '{"a":[1,{"b":"c\\"d"}],"e":null}', "", "[}", '{"a":1,}', "tru", "[1 2]", ":", "{1:2}", "[:]", '"a" "b"', '{"a":"b" "c"}', '"\\"', '"\\\\"', "[01]", "[1.]", "-", "[-1e5]", "]", "{,}", "[,]", '{"a":1 "b":2}']


def valid(s):
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


@pytest.mark.parametrize("s", BASIC)
def test_complete(s):
    x = StructuralIndex([b"[3]", s.encode(), b'{"k":[null]}'])
    assert x.complete.tolist() == [True, valid(s), True]


JSON = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=15)


def rebuilt(x, i):
    kids = x.children(np.array([i]))[0]
    k = chr(x.kind[i])
    if k == "{":
        return {x.key(c): rebuilt(x, c) for c in kids}
    if k == "[":
        assert x.ordinal[kids].tolist() == list(range(len(kids)))
        return [rebuilt(x, c) for c in kids]
    return json.loads(x.raw_text(i))


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=4), st.booleans(), st.data())
def test_round_trip_and_cuts(values, ascii_only, data):
    texts = [json.dumps(v, ensure_ascii=ascii_only, indent=data.draw(st.sampled_from([None, 1]))) for v in values]
    x = StructuralIndex([t.encode("utf-8", "surrogatepass") for t in texts])
    assert x.complete.all() and [rebuilt(x, r) for r in x.roots()] == values
    t = texts[0]
    cut = t[: data.draw(st.integers(0, len(t)))]
    y = StructuralIndex([cut.encode("utf-8", "surrogatepass"), b"[1]"])
    assert y.complete.tolist() == [valid(cut), True]


Q = {"question_id": 7, "query": "a?", "options": ["x", None, "y"]}


@pytest.mark.parametrize(
    "payload, want",
    [
        (json.dumps([{"video_key": "v", "qa": [Q, None, {"uid": "u", "options": {"B": "two", "A": "one"}}, {"question": "q"}]}]),
         {("1:0", "question", 0, "7"), ("1:0:0", "option", 0, "x"), ("1:0:0", "option", 2, "y"), ("1:0", "question", 2, "u"), ("1:0:2", "option", 0, "one"), ("1:0:2", "option", 1, "two"), ("1:0", "question", 3, "")}),
        (json.dumps({"version": 1, "videos": [None, {"key": "k", "qa": json.dumps([Q])}]}), {("1:1", "question", 0, "7"), ("1:1:0", "option", 0, "x"), ("1:1:0", "option", 2, "y")}),
        (json.dumps(json.dumps([{"qa": Q}])), {("1:0", "question", 0, "7"), ("1:0:0", "option", 0, "x"), ("1:0:0", "option", 2, "y")}),
        (json.dumps({"key": "k", "qa": {"uid": None, "question_id": "08", "options": None}}), {("1:0", "question", 0, "08")}),
        ("﻿" + json.dumps([{"qa": [{"uid": 5}]}]), {("1:0", "question", 0, "5")}),
        (json.dumps([{"qa": [Q]}])[:-3], set()), (None, set()), ("", set()), ("null", set()), ("[]", set()), ('"[1"', set()), (json.dumps([{"qa": None}, {}]), set()),
    ],
)
def test_question_links(spark, payload, want):
    df = spark.createDataFrame([(1, payload, "z")], "file_id bigint, payload string, src string")
    assert {tuple(r)[1:] for r in question_links(df).collect()} == want


def test_array_links(spark):
    rows = [("e", ["a", None, "b", "a"], [1, None]), ("f", None, []), (None, ["x"], [3]), ("e", ["a"], None)]
    df = spark.createDataFrame(rows, "id string, events array<string>, frames array<bigint>").selectExpr("*", "1 as child_no", "'q' as parent_key")
    got = sorted(tuple(r) for r in array_links(df, "id", {"events": "event", "frames": "frame"}, "entity").collect())
    assert got == sorted([("entity", "e", "event", 0, "a"), ("entity", "e", "event", 2, "b"), ("entity", "e", "event", 3, "a"), ("entity", "e", "frame", 0, "1"), ("entity", "e", "event", 0, "a")])


def test_nodes(spark):
    df = spark.createDataFrame([("d", '{"a":[1,{"b":"x"}]}'), ("e", "{"), (None, "[]"), ("f", None)], "k string, t string")
    got = {(r.doc_key, r.node_no, r.parent_no, r.ordinal, r.member, r.kind, r.text) for r in json_nodes(df, "k", "t").collect()}
    assert got == {("d", 0, -1, 0, None, "object", None), ("d", 1, 0, 0, "a", "array", None), ("d", 2, 1, 0, None, "atom", "1"), ("d", 3, 1, 1, None, "object", None), ("d", 4, 3, 0, "b", "string", "x")}
    assert question_links(spark.createDataFrame([], "file_id bigint, payload string")).count() == 0


def test_very_long_text(spark):
    text = json.dumps([{"qa": [{"uid": str(i), "options": ["o" * 50] * 4} for i in range(20_000)]}])
    df = spark.createDataFrame([(1, text)], "file_id bigint, payload string")
    assert question_links(df).count() == 100_000
