"""Arrays of strings and JSON texts as columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def any_contains(values: Column, part: Column) -> Column:
    return F.exists(values, lambda x: F.contains(F.lower(x), F.lower(part)))


def contains_either_way(values: Column, wanted: Column) -> Column:
    """Whether some value contains a wanted one or is contained in it; case ignored, empty strings excluded."""
    pair = lambda x, y: (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    return F.exists(values, lambda x: F.exists(wanted, lambda y: pair(F.lower(x), F.lower(y))))


def found_either_way(values: Column, wanted: Column) -> Column:
    return F.filter(values, lambda x: contains_either_way(F.array(x), wanted))


def json_in_text(c: Column) -> Column:
    """The JSON object in a noisy text: the text itself, a fenced block, or the outer braces."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    good = lambda t: F.when(F.try_parse_json(t).isNotNull() & F.startswith(F.trim(t), F.lit("{")), F.trim(t))
    return F.coalesce(good(c), good(fenced), good(braces))


def repaired(c: Column) -> Column:
    """Without control characters and commas before a closing bracket."""
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f]", " "), r",\s*([}\]])", "$1")


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first complete JSON object in each text, whatever follows it; null without one.

    For texts in which no simpler rule finds an object: braces in strings do not count,
    which no pattern can tell.
    """
    reader = json.JSONDecoder()

    def first(text: str | None) -> str | None:
        at = -1 if text is None else text.find("{")
        while at >= 0:
            try:
                return text[at : reader.raw_decode(text, at)[1]]
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(first)
