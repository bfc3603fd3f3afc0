"""Row-local text functions: columns in, columns out, all inside code generation (no Python UDFs).

A null argument gives null unless a function says otherwise; empty text gives empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose full stop ends no sentence, matched without regard to case.
ABBREVIATIONS = (
    "Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|Rev|Hon|Capt|Lt|Sgt|Col|Gen|i\\.e|e\\.g|etc|vs|cf|ca|a\\.m|p\\.m|sec|min|hr|"
    "B\\.A|M\\.A|Ph\\.D|B\\.S|M\\.S|M\\.D|Ed\\.D|J\\.D|U\\.S|U\\.K|E\\.U|U\\.N|D\\.C|N\\.Y|L\\.A|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|No|Vol|pp|ed|eds|trans|repr|p"
)
_DOT, _POINT, _END = "\u0001", "\u0002", "\u0003"


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, single blanks: the form in which texts are searched."""
    return F.lower(squeeze(c))


def clean_text(c: Column) -> Column:
    """Extracted text tidied: invisible characters out, hyphenation and line ends inside sentences undone, blanks and blank lines collapsed.

    A line end goes where small letters stand on both sides, whatever blanks lie between; others stay.
    """
    c = F.translate(c, "\u200b\u200c\u200d\ufeff\u00ad\u2060", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"-\n(?=\s*[a-z])", "")
    c = F.regexp_replace(c, r"(?<=[a-z])\s*\n\s*(?=[a-z])", " ")
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def normalize_doi(c: Column) -> Column:
    """A DOI in lower case without resolver or label; '' where it is none."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[.,;)\]>]+$", ""), r"\s+", "")
    return F.when(bare.startswith("10."), bare).otherwise(F.lit(""))


def normalize_title(c: Column) -> Column:
    """A title for keys: lower case, quotes and dashes out, single blanks."""
    return squeeze(F.translate(F.lower(c), "\"'“”‘’-–—", ""))


def title_hash(c: Column) -> Column:
    return F.sha2(normalize_title(c), 256)


def cache_keys(doi: Column, title: Column) -> Column:
    """The ordered storage keys of a work: by DOI, then by title hash."""
    d = normalize_doi(doi)
    return F.array_compact(F.array(F.when(F.coalesce(d, F.lit("")) != "", F.concat(F.lit("by-doi/"), d)), F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("by-title-hash/"), F.substring(title_hash(title), 1, 12)))))


def first_doi(c: Column) -> Column:
    """The first DOI inside a text, without closing punctuation; '' if none."""
    return F.regexp_replace(F.coalesce(F.regexp_extract(c, r"(10\.\d{4,9}/[^\s\"<>]+)", 1), F.lit("")), r"[.,;)\]>]+$", "")


def first_url(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.regexp_extract(c, r"(https?://[^\s\"<>]+)", 1), F.lit("")), r"[.,;)\]>]+$", "")


def clean_year(c: Column) -> Column:
    """Four digits, else the first 19xx or 20xx inside, else n.d."""
    found = F.regexp_extract(c, r"((?:19|20)\d{2})", 1)
    return F.when(c.rlike(r"^\d{4}$"), c).when(found != "", found).otherwise(F.lit("n.d."))


def citation_key(author: Column, year: Column) -> Column:
    """Letters of the author's first word and the year; '' if either is missing."""
    name = F.regexp_replace(F.regexp_extract(F.trim(author), r"^([^,\s]+)", 1), r"[^\p{L}]", "")
    when = F.coalesce(F.nullif(F.regexp_extract(year, r"(\d{4})", 1), F.lit("")), F.trim(year))
    return F.when((F.coalesce(name, F.lit("")) != "") & (F.coalesce(when, F.lit("")) != ""), F.concat(name, when)).otherwise(F.lit(""))


def claim_type(c: Column) -> Column:
    """quotation where three or more characters stand in double quotes, else paraphrase."""
    return F.when(c.rlike(r"[\"\x{201C}][^\"\x{201D}]{3,}[\"\x{201D}]"), F.lit("quotation")).otherwise(F.lit("paraphrase"))


def strip_markup(c: Column) -> Column:
    """Tags out, common entities resolved, single blanks."""
    c = F.regexp_replace(c, r"<[^<>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def sentences(c: Column) -> Column:
    """The sentences of a text: abbreviations, decimals and ellipses end none."""
    c = F.regexp_replace(c, rf"(?i)\b({ABBREVIATIONS})\.(\s)", f"$1{_DOT}$2")
    c = F.regexp_replace(c, r"(\d)\.(\d)", f"$1{_DOT}$2")
    c = F.replace(c, F.lit("..."), F.lit(_POINT))
    c = F.regexp_replace(c, r"(?i)(et al)\.(\s*\()", f"$1{_DOT}$2")
    c = F.regexp_replace(c, r"([.!?]+[\"'\x{201D}\x{2019})]*)\s+", f"$1{_END}")
    restored = lambda x: F.regexp_replace(F.replace(F.translate(x, _DOT, "."), F.lit(_POINT), F.lit("...")), r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(c, _END), restored), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """The non-blank paragraphs of a text, trimmed."""
    parts = F.split(F.regexp_replace(c, r"\r\n?", "\n"), r"\n\s*\n")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))


def blocked_host(host: Column) -> Column:
    """Whether a host is local or private and must not be fetched."""
    return host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.)") | host.rlike(r"(\.local|\.internal|^)$")
