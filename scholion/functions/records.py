"""Answers of bibliographic services (JSON text) to one record form, and texts as libraries serve them to plain ones.

Every parser gives a struct (doi, title, year, authors, abstract, full_text_url); null or malformed
JSON gives a record of empty fields, a missing year n.d. The fields are taken by a schema, so one
pass over the text serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PERSON = "struct<given:string,family:string>"


def _record(doi: Column, title: Column, year: Column, authors: Column, abstract: Column, url: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(doi, F.lit("")).alias("doi"),
        F.coalesce(title, F.lit("")).alias("title"),
        F.when(F.coalesce(year, F.lit("")).isin("", "0"), "n.d.").otherwise(year).alias("year"),
        F.coalesce(F.filter(authors, lambda a: F.coalesce(a, F.lit("")) != ""), none).alias("authors"),
        abstract.alias("abstract"),
        url.alias("full_text_url"),
    )


def without_tags(c: Column) -> Column:
    """Tags as blanks, blanks collapsed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def _names(people: Column) -> Column:
    return F.transform(people, lambda p: F.trim(F.concat_ws(" ", p["given"], p["family"])))


def crossref_record(answer: Column) -> Column:
    m = F.from_json(answer, f"DOI string, title array<string>, issued struct<`date-parts`:array<array<int>>>, author array<{_PERSON}>, abstract string")
    year = F.try_element_at(F.try_element_at(m["issued"]["date-parts"], F.lit(1)), F.lit(1)).cast("string")
    return _record(m["DOI"], F.try_element_at(m["title"], F.lit(1)), year, _names(m["author"]), without_tags(m["abstract"]), F.lit(None).cast("string"))


def rebuilt_abstract(index: Column) -> Column:
    """The text of an inverted index (word -> positions); null for none."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("at"), e["key"].alias("word")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " "), F.lit(""))


def openalex_record(answer: Column) -> Column:
    place = "struct<pdf_url:string>"
    m = F.from_json(
        answer,
        f"doi string, title string, display_name string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, best_oa_location {place}, primary_location {place}, locations array<{place}>, abstract_inverted_index map<string,array<int>>",
    )
    urls = F.filter(F.concat(F.array(m["best_oa_location"]["pdf_url"], m["primary_location"]["pdf_url"]), F.coalesce(m["locations"]["pdf_url"], F.array().cast("array<string>"))), lambda u: F.coalesce(u, F.lit("")) != "")
    return _record(
        F.trim(F.regexp_replace(m["doi"], "^https://doi\\.org/", "")), F.coalesce(F.nullif(m["title"], F.lit("")), m["display_name"]), m["publication_year"].cast("string"),
        m["authorships"]["author"]["display_name"], rebuilt_abstract(m["abstract_inverted_index"]), F.try_element_at(urls, F.lit(1)),
    )


def semantic_record(answer: Column) -> Column:
    m = F.from_json(answer, "externalIds struct<DOI:string>, title string, year int, authors array<struct<name:string>>, abstract string, openAccessPdf struct<url:string>")
    return _record(m["externalIds"]["DOI"], m["title"], m["year"].cast("string"), m["authors"]["name"], F.nullif(m["abstract"], F.lit("")), m["openAccessPdf"]["url"])


def core_record(answer: Column) -> Column:
    """Authors may be objects with a name or plain strings."""
    m = F.from_json(answer, "doi string, title string, yearPublished int, authors array<string>, downloadUrl string, sourceFulltextUrls array<string>")
    people = F.transform(m["authors"], lambda a: F.when(a.startswith("{"), F.get_json_object(a, "$.name")).otherwise(a))
    return _record(m["doi"], m["title"], m["yearPublished"].cast("string"), people, F.lit(None).cast("string"), F.coalesce(F.nullif(m["downloadUrl"], F.lit("")), F.try_element_at(m["sourceFulltextUrls"], F.lit(1))))


def gutenberg_record(answer: Column) -> Column:
    m = F.from_json(answer, "title string, copyright_year int, authors array<struct<name:string>>, formats map<string,string>")
    url = F.coalesce(F.try_element_at(m["formats"], F.lit("text/plain; charset=utf-8")), F.try_element_at(m["formats"], F.lit("text/plain")))
    return _record(F.lit(None).cast("string"), m["title"], m["copyright_year"].cast("string"), m["authors"]["name"], F.lit(None).cast("string"), url)


def book_body(c: Column) -> Column:
    """A book's text between the lines of stars that open and close it; all of it where there are none."""
    opened = F.regexp_replace(c, r"(?s)^.*?\*\*\* ?START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^*]*\*\*\*", "")
    return F.regexp_replace(F.regexp_replace(opened, r"(?s)\*\*\* ?END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*$", ""), r"^\s+|\s+$", "")


def wiki_body(c: Column) -> Column:
    """Wiki markup to plain text: templates out, links to their words, marks of headings and weight out."""
    for pattern, new in ((r"\{\{[^}]*\}\}", ""), (r"\[\[[^\]]*\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]]+)\]\]", "$1"), (r"'{2,}", ""), (r"(?m)^=+([^=\n]+)=+$", "$1"), (r"<[^>]+>", ""), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r"^\s+|\s+$", "")):
        c = F.regexp_replace(c, pattern, new)
    return c


def wiki_author(c: Column) -> Column:
    """The author in the header template of a wiki page, links to their words; '' if there is none."""
    raw = F.trim(F.coalesce(F.regexp_extract(c, r"\|\s*(?:override_)?author\s*=\s*(.+?)(?:\n\s*\||\n\}\})", 1), F.lit("")))
    linked = F.regexp_extract(raw, r"\[\[(?:[^\]]*\|)?([^\]]+)\]\]", 1)
    return F.when(linked != "", F.trim(linked)).otherwise(raw)
