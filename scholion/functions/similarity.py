"""Set similarity of titles and texts: distinct tokens, coverage and thresholds, without UDFs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that say nothing about a title.
STOPWORDS = (
    "a an the and or of in on at to for with from by as is are was were be been being this that these those it its their his her our your my we us you they "
    "them he she i which who whom whose what when where why how all any both each few more most other some such no nor not only own same so than too very can "
    "will just should now"
).split()


def significant_tokens(c: Column) -> Column:
    """Distinct lower-case words of two or more letters (hyphens and apostrophes inside count), without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z'-]+)"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOPWORDS]))


def check_tokens(c: Column) -> Column:
    """Distinct lower-case runs of three or more letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))


def coverage(query: Column, match: Column) -> Column:
    """Share of the query's significant tokens that the match has; 1 where the query has none."""
    q = significant_tokens(query)
    return F.when(F.size(q) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(q, significant_tokens(match))) / F.size(q))


def coverage_threshold(query: Column) -> Column:
    """The coverage that a match needs: all of one or two tokens, all but one of up to four, then all but two and 0.6 at least."""
    n = F.size(significant_tokens(query))
    return F.when(n <= 2, F.lit(1.0)).when(n <= 4, (n - 1) / n).otherwise(F.greatest(F.lit(0.6), (n - 2) / n))


def contained(part: Column, whole: Column) -> Column:
    """Share of the first array's elements that the second has; 0 for an empty array."""
    return F.when(F.size(part) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def page_title_matches(cited: Column, page: Column) -> Column:
    """Whether a page's title covers half of the cited title's tokens; true where the cited title has none."""
    tokens = check_tokens(cited)
    return F.when(F.size(tokens) == 0, F.lit(True)).otherwise(contained(tokens, check_tokens(page)) >= 0.5)


def surnames(author: Column) -> Column:
    """Lower-case surnames of an author string: parts at ; & and the word and; before a comma, else the last word."""
    parts = F.split(author, r"\s*;\s*|\s*,?\s*&\s*|,?\s+and\s+")
    one = lambda p: F.lower(F.when(F.instr(p, ",") > 0, F.substring_index(p, ",", 1)).otherwise(F.regexp_extract(F.trim(p), r"(\S+)$", 1)))
    names = F.transform(parts, lambda p: F.regexp_replace(one(p), r"[^\p{L}'-]", ""))
    return F.array_distinct(F.filter(names, lambda n: F.length(n) > 1))


def identity_confidence(doi: tuple[Column, Column], title: tuple[Column, Column], author: tuple[Column, Column], year: tuple[Column, Column]) -> Column:
    """high, medium or low that a found work is the expected one, from (expected, found) of each field; an equal DOI settles it.

    A field that both sides have counts: three points for a DOI that the expected side has, two for
    the title, one each for the author (expected surname inside any found name) and the year.
    """
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    same_doi = given(doi[0]) & F.coalesce(F.lower(doi[0]) == F.lower(doi[1]), F.lit(False))
    with_title, with_year = given(title[0]) & given(title[1]), given(year[0]) & given(year[1])
    with_author = given(author[0]) & (F.coalesce(F.size(author[1]), F.lit(0)) > 0)
    overlap = contained(check_tokens(title[0]), check_tokens(title[1]))
    surname = F.lower(F.trim(F.substring_index(author[0], ",", 1)))
    named = (surname != "") & F.exists(author[1], lambda a: F.instr(F.lower(a), surname) > 0)
    agree = (F.instr(year[1], year[0]) > 0) | (F.instr(year[0], year[1]) > 0)
    points = F.when(with_title & (overlap >= 0.6), 2).when(with_title & (overlap >= 0.3), 1).otherwise(0) + (with_author & F.coalesce(named, F.lit(False))).cast("int") + (with_year & F.coalesce(agree, F.lit(False))).cast("int")
    most = given(doi[0]).cast("int") * 3 + with_title.cast("int") * 2 + with_author.cast("int") + with_year.cast("int")
    ratio = points / F.nullif(most, F.lit(0))
    return F.when(same_doi, "high").when(ratio >= 0.7, "high").when(ratio >= 0.4, "medium").otherwise("low")


@F.pandas_udf(DoubleType())
def best_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Greatest similarity ratio between any two strings of two arrays; 1 where either is empty or null."""

    def one(x, y) -> float:
        if x is None or y is None or not len(x) or not len(y):
            return 1.0
        return max(difflib.SequenceMatcher(None, p, q).ratio() for p in x for q in y)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


#: The least ratio of two surnames that count as the same.
SAME_NAME = 0.7


def relevant(cited_title: Column, found_title: Column, cited_names: Column, found_names: Column) -> Column:
    """Whether a found work is the cited one: its title covers the cited title's words, and a surname is alike where both have any."""
    q = coverage(cited_title, found_title)
    return (q >= coverage_threshold(cited_title) - 1e-9) & (best_ratio(cited_names, found_names) >= SAME_NAME)
