"""Reading answers out of model responses."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that tell of a failed request rather than an answer. Fixed values.
ERROR_TEXT = "(?i)(internal error|error happened|status code|ResponseType\\.|INPUT_LENGTH_ERROR|TOKEN_LIMIT|TIMEOUT|FAILED|exception|traceback)"

_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def unfenced(text: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(text, "(?i)^\\s*```[a-z]*\\s*|\\s*```\\s*$", ""))


def json_members(text: Column) -> Column:
    """Members of a JSON object as a map of texts; null if the text is not one."""
    return F.from_json(text, "map<string,string>", _STRICT)


def _first(m: Column, *names: str) -> Column:
    """The first of some members that is there and not empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names))


def answer_letter(text: Column) -> Column:
    """Letter A-D of a response: the answer member of a JSON object, else one that a text quotes, else a
    letter with a point or bracket at the end, else a text that is nothing but a letter; null if none."""
    t = unfenced(text)
    whole = F.upper(_first(json_members(t), "Answer", "answer"))
    quoted = F.nullif(F.upper(F.regexp_extract(t, '(?i)"answer"\\s*:\\s*"([A-D])"', 1)), F.lit(""))
    last = F.nullif(F.regexp_extract(t, "\\b([ABCD])\\s*[.)]\\s*$", 1), F.lit(""))
    bare = F.nullif(F.upper(F.regexp_extract(t, "^\\s*\\(?([A-Da-d])[).]?\\s*$", 1)), F.lit(""))
    return F.coalesce(F.when(whole.isin("A", "B", "C", "D"), whole), quoted, last, bare)


def valid_answer(text: Column, of_format: bool = False) -> Column:
    """A response without an error text that holds a JSON object with an answer member that is not blank
    (with ``of_format``: one of A-D)."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    plain = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    answer = F.trim(_first(json_members(F.when(fenced != "", fenced).otherwise(plain)), "Answer", "answer"))
    good = F.upper(answer).isin("A", "B", "C", "D") if of_format else answer != ""
    return F.coalesce(~text.rlike(ERROR_TEXT) & good, F.lit(False))


def normalised_letter(text: Column) -> Column:
    """Upper-case A-D of an untidy letter; null for anything else."""
    t = F.upper(F.regexp_replace(F.trim(text), "[().\\s]", ""))
    return F.when(t.isin("A", "B", "C", "D"), t)


def looks_like_error(text: Column) -> Column:
    return F.coalesce(text.rlike(ERROR_TEXT), F.lit(True))


def cleaned(text: Column) -> Column:
    """HTML entities resolved (all of them), control characters out, slashes to blanks."""

    @F.pandas_udf("string")
    def resolved(ts: pd.Series) -> pd.Series:
        return ts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))

    return F.replace(F.regexp_replace(resolved(text), "[\\x00-\\x1f\\x7f-\\x9f]", ""), F.lit("/"), F.lit(" "))
