"""Replies of models and services that arrive as text: JSON cut short, verdicts, flags."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def salvage(text: str | None) -> str | None:
    """The longest prefix of a JSON text that can be closed to valid JSON; null where there is none.

    The open brackets are tracked in order, so nested arrays and objects are closed as they opened.
    """
    if not text:
        return None
    stack: list[str] = []
    string = escape = False
    cuts: list[tuple[int, str]] = []
    for i, c in enumerate(text):
        if string:
            if escape:
                escape = False
            elif c == "\\":
                escape = True
            elif c == '"':
                string = False
            continue
        if c == '"':
            string = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}":
            if not stack or stack[-1] != c:
                return None
            stack.pop()
            cuts.append((i + 1, "".join(reversed(stack))))
        elif c == ",":
            cuts.append((i, "".join(reversed(stack))))
    for end, close in [(len(text), "".join(reversed(stack))), *reversed(cuts)]:
        try:
            json.loads(whole := text[:end] + close)
        except ValueError:
            continue
        return whole
    return None


@F.pandas_udf(StringType())
def salvage_json(texts: pd.Series) -> pd.Series:
    """`salvage` for a column; no built-in function closes a truncated JSON text."""
    return texts.map(salvage)


def truthy(c: Column) -> Column:
    """Whether an untrusted flag means yes."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "yes", "1", "t", "y"), F.lit(False))


def html_title(c: Column) -> Column:
    """The first title of a page's head: citation_title, og:title, then the title element; null where all are empty."""
    meta = lambda name: F.regexp_extract(c, rf"(?is)<meta\s+(?:name|property)=\"{name}\"\s+content=\"([^\"]*)\"", 1)
    found = F.array(meta("citation_title"), meta("og:title"), F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))
    tidy = F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.try_element_at(tidy, F.lit(1))
