"""Text measured and ordered as the languages of bundles do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def utf16_order(text: Column | str) -> Column:
    """A key that sorts texts by UTF-16 code units (Spark sorts by code points)."""
    return F.encode(text, "UTF-16BE")


def numbered(number: Column) -> Column:
    """A number with four digits at least; longer ones are kept whole."""
    return F.format_string("%04d", number.cast("long"))


def inserted():
    """Column function ``(text, places, notes)``: the text with each note before its place; places ascend.

    One pass over the text, however many notes there are.
    """

    @F.pandas_udf("string")
    def run(text: pd.Series, places: pd.Series, notes: pd.Series) -> pd.Series:
        out = []
        for t, at, note in zip(text, places, notes, strict=True):
            parts, last = [], 0
            for a, n in zip(at, note, strict=True) if at is not None else ():
                parts += [t[last:a], n]
                last = a
            out.append(None if t is None else "".join([*parts, t[last:]]))
        return pd.Series(out, dtype=object)

    return run


def slices():
    """Column function ``(text, starts, ends)``: the pieces of a text."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([[t[a:b] for a, b in zip(s, e, strict=True)] for t, s, e in zip(text, starts, ends, strict=True)], dtype=object)

    return run


def replaced():
    """Column function ``(text, starts, ends, words)``: the text with each piece replaced; pieces ascend and do not overlap."""

    @F.pandas_udf("string")
    def run(text: pd.Series, starts: pd.Series, ends: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for t, s, e, w in zip(text, starts, ends, words, strict=True):
            parts, last = [], 0
            for a, b, x in zip(s, e, w, strict=True) if s is not None else ():
                parts += [t[last:a], x]
                last = b
            out.append(None if t is None else "".join([*parts, t[last:]]))
        return pd.Series(out, dtype=object)

    return run
