"""Reading what models and people write: JSON answers about questions, times and objects; small text forms.

Everything that cannot be read has a stated default, so a column never fails on a bad row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.timetext import clock_seconds, seconds_of

_STRICT = {"allowSingleQuotes": "false"}


def unfenced(text: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), "^```\\w*\\n?|\\n?```$", ""))


def parsed(text: Column, schema: str) -> Column:
    return F.from_json(unfenced(text), schema, _STRICT)


def query_type(text: Column) -> Column:
    """struct of needs_counting, needs_temporal_direction (lower case, ``none`` if missing), needs_spatial_positions and
    has_content_text; all false and ``none`` if unreadable."""
    p = parsed(text, "needs_counting boolean, needs_temporal_direction string, needs_spatial_positions boolean, has_content_text boolean")
    no = lambda c: F.coalesce(p[c], F.lit(False)).alias(c)
    way = F.lower(F.trim(p["needs_temporal_direction"]))
    return F.struct(no("needs_counting"), F.coalesce(F.nullif(way, F.lit("")), F.lit("none")).alias("needs_temporal_direction"), no("needs_spatial_positions"), no("has_content_text"))


def keyword_strategy(text: Column) -> Column:
    """One of question_only, options_only, both, neither; ``both`` for anything else."""
    s = F.lower(F.trim(parsed(text, "strategy string")["strategy"]))
    return F.when(s.isin("question_only", "options_only", "both", "neither"), s).otherwise(F.lit("both"))


def _zero(text: Column) -> Column:
    return F.coalesce(seconds_of(text), F.lit(0))


_LOC = "localization_time struct<exists:boolean,type:string,value:string,values:array<string>>, content_time struct<exists:boolean,values:array<string>>"


def _ends(value: Column) -> Column:
    """start and end of a value that is an object with both, else null."""
    r = F.from_json(value, "start string, end string", _STRICT)
    return F.when(F.startswith(F.ltrim(value), F.lit("{")) & r["start"].isNotNull() & r["end"].isNotNull(), r)


def temporal_analysis(text: Column) -> Column:
    """struct of has_localization, has_content, localization and content seconds as ``[start, end]`` (a point twice;
    of several contents the least and the greatest), null where there is none."""
    p = parsed(text, _LOC)
    loc, content = p["localization_time"], p["content_time"]
    r = _ends(loc["value"])
    where = F.when(r.isNotNull(), F.array(_zero(r["start"]), _zero(r["end"]))).otherwise(F.array(_zero(loc["value"]), _zero(loc["value"])))
    secs = F.transform(F.filter(content["values"], lambda x: x.isNotNull()), lambda x: _zero(F.regexp_replace(x, "\\s*(AM|PM|am|pm)\\s*", "")))
    has = F.coalesce(loc["exists"], F.lit(False))
    return F.struct(
        has.alias("has_localization"), F.coalesce(content["exists"], F.lit(False)).alias("has_content"),
        F.when(has & loc["value"].isNotNull(), where).alias("localization"), F.when(F.size(secs) > 0, F.array(F.array_min(secs), F.array_max(secs))).alias("content"),
    )


def localization_segments(text: Column) -> Column:
    """array<struct<gs, ge, place>> of a localization time: a point, a range, or several of either (``place`` counts
    them); empty for a position, for none and for what cannot be read."""
    loc = parsed(text, _LOC)["localization_time"]
    kind = F.lower(F.coalesce(loc["type"], F.lit("")))
    values = F.when(kind == "multiple", loc["values"]).when(kind.isin("exact", "range"), F.array(loc["value"]))

    def one(v: Column, i: Column) -> Column:
        r = _ends(v)
        a, b = _zero(F.when(r.isNotNull(), r["start"]).otherwise(v)), _zero(F.when(r.isNotNull(), r["end"]).otherwise(v))
        there = F.when(r.isNotNull(), (F.trim(r["start"]) != "") & (F.trim(r["end"]) != "")).otherwise(F.trim(v) != "")
        return F.when(there, F.struct(F.least(a, b).alias("gs"), F.greatest(a, b).alias("ge"), i.alias("place")))

    got = F.filter(F.transform(F.when(F.coalesce(loc["exists"], F.lit(False)), values), one), lambda x: x.isNotNull())
    return F.coalesce(got, F.array().cast("array<struct<gs:bigint,ge:bigint,place:int>>"))


def display_segments(value: Column, contents: Column) -> Column:
    """array<struct<gs, ge, source>> in seconds of the day: a localization value (a clock time, or an object with start
    and end) and the clock times among the contents; what shows no time is left out."""
    r = _ends(value)
    a, b = clock_seconds(r["start"]), clock_seconds(r["end"])
    t = clock_seconds(value)
    main = F.when(r.isNotNull(), F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("gs"), F.greatest(a, b).alias("ge"), F.lit("value").alias("source")))).otherwise(
        F.when(t.isNotNull(), F.struct(t.alias("gs"), t.alias("ge"), F.lit("value").alias("source")))
    )
    rest = F.transform(F.coalesce(contents, F.array().cast("array<string>")), lambda x: F.when(clock_seconds(x).isNotNull(), F.struct(clock_seconds(x).alias("gs"), clock_seconds(x).alias("ge"), F.lit("content").alias("source"))))
    return F.filter(F.concat(F.array(main), rest), lambda x: x.isNotNull())


def duration_text(span: Column) -> Column:
    """``a - b`` in seconds with two decimals; ends over 10000 are milliseconds; empty without two ends."""

    @F.pandas_udf("string")
    def shown(a: pd.Series, b: pd.Series) -> pd.Series:  # decimals as binary fractions round, which the built-in format does not
        return pd.Series([None if pd.isna(x) or pd.isna(y) else f"{x:.2f}s - {y:.2f}s" for x, y in zip(a, b)])

    a, b = F.get(span, F.lit(0)), F.get(span, F.lit(1))
    by = F.when((a > 10000) | (b > 10000), F.lit(1000.0)).otherwise(F.lit(1.0))
    return F.coalesce(shown(F.when(F.size(span) >= 2, a / by), F.when(F.size(span) >= 2, b / by)), F.lit(""))


def question_key(question_id: Column) -> Column:
    """Number of a question, -1 for an id that is none."""
    return F.coalesce(F.trim(question_id).try_cast("bigint"), F.lit(-1))


def sentences(text: Column) -> Column:
    """Parts between points, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(text, "\\."), lambda x: F.trim(x)), lambda x: x != "")


def object_query(text: Column) -> Column:
    """struct of object_description, lo and hi (frames) of a query that a model has put into JSON somewhere in its text;
    the text itself as description, without frames, if there is none."""
    p = F.from_json(F.regexp_extract(text, "(?s)\\{.*\\}", 0), "object_description string, frame_range struct<start:bigint,end:bigint>", _STRICT)
    good = p["object_description"].isNotNull()
    return F.struct(F.when(good, p["object_description"]).otherwise(text).alias("object_description"), F.when(good, p["frame_range"]["start"]).alias("lo"), F.when(good, p["frame_range"]["end"]).alias("hi"))


def nested_list(text: Column, member: str) -> Column:
    """A member of a JSON object that is a list, or a list in a JSON string; null if neither."""
    m = F.from_json(unfenced(text), "map<string,string>", _STRICT)
    raw = F.try_element_at(m, F.lit(member))
    once = F.from_json(raw, "array<string>", _STRICT)
    return once


def json_safe(columns: list[Column], sets: list[str]) -> Column:
    """JSON text of some values and of array columns that stand for sets: distinct and sorted."""
    return F.to_json(F.struct(*columns, *(F.array_sort(F.array_distinct(s)).alias(s) for s in sets)))


def vector_hash():
    """Arrow UDF: md5 of a vector's float32 bytes; null for a null vector."""

    @F.pandas_udf("string")
    def digest(vs: pd.Series) -> pd.Series:
        return vs.map(lambda v: None if v is None else hashlib.md5(np.asarray(v, "<f4").tobytes()).hexdigest())

    return digest


#: Prompt templates, as configuration: names in braces are columns. Our own wording.
PROMPTS = {
    "caption": "Describe what happens between {s} and {e} seconds in one sentence.",
    "choose": "Question: {question}\nOptions:\n{options}\nAnswer with JSON: analysis and a letter.",
    "verify": "Does this event show any of the expected ones? Event: {line}. Expected: {expected}. Answer yes or no for each.",
    "sub_query": "Known so far:\n{information}\nWhat else should be looked for to answer: {question}",
}


def prompt(name: str, **values: Column) -> Column:
    """A template with its names replaced; nulls are empty."""
    out = F.lit(PROMPTS[name])
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out
