"""Canary phrases out of text and of nested values, however they are spelled."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrase's words, what stands for it, and the characters of no width that are taken out first.
PHRASE = ("ALL", "NOTES", "ARCHIVED", "SUCCESSFULLY")
REDACTED = "[redacted-canary]"
ZERO_WIDTH = "​‌‍﻿"
_PATTERN = re.compile(r"\s*".join(PHRASE), re.IGNORECASE)
_GONE = dict.fromkeys(map(ord, ZERO_WIDTH))


def plain(text: str) -> str:
    """Text composed by compatibility (NFKC), without characters of no width and without the phrase."""
    return _PATTERN.sub(REDACTED, unicodedata.normalize("NFKC", text).translate(_GONE))


def walked(value):
    """``value`` with every string in it :func:`plain`; keys of maps and names of fields stay."""
    if isinstance(value, str):
        return plain(value)
    if isinstance(value, dict):
        return {k: walked(v) for k, v in value.items()}
    if isinstance(value, tuple):  # rows of structs
        made = [walked(v) for v in value]
        return type(value)(*made) if hasattr(value, "__fields__") else tuple(made)
    return [walked(v) for v in value] if isinstance(value, list) else value


def _touched(shown: Column) -> Column:
    """Whether a value, shown as text, needs a look: it isn't ASCII, or holds the phrase (in JSON, with escaped white space)."""
    return ~shown.rlike(r"^[\x00-\x7f]*$") | shown.rlike(r"(?i)" + r"(?:\s|\\[nrtf]|\\u00[01][0-9a-f])*+".join(PHRASE))


def redact(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the phrase redacted in ``columns`` of any type, at any depth.

    Strings, and strings in arrays, maps and structs; other values stay. Only rows
    that are not plain ASCII or hold the phrase go through Python.
    """
    made = {}
    for name in columns:
        kind = df.schema[name].dataType
        shown = F.col(name) if kind.simpleString() == "string" else F.to_json(F.struct(F.col(name).alias("v")))
        other = F.udf(walked, kind, useArrow=True)(F.when(_touched(shown), F.col(name)))
        made[name] = F.when(F.coalesce(_touched(shown), F.lit(False)), other).otherwise(F.col(name))
    return df.withColumns(made)


def redact_json(text: Column) -> Column:
    """A JSON text with every string value in it redacted; text that is no JSON is redacted as it stands."""

    def run(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            return json.dumps(walked(json.loads(value)), ensure_ascii=False)
        except ValueError:
            return plain(value)

    # An escape may hide a letter of the phrase, so texts with escapes of characters are looked at, too.
    look = _touched(text) | F.contains(text, F.lit("\\u"))
    return F.when(look, F.udf(run, "string", useArrow=True)(F.when(look, text))).otherwise(text)
