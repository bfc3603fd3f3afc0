"""What kind of source a reference names, where it may be fetched, and what an attempt to fetch it means."""

from __future__ import annotations

import html
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from scholion.functions import text as T

# What marks a film, record, performance or picture, in brackets or as a credit, and a holding of an archive.
MEDIA_KINDS = (
    "film|motion picture|tv series|television series|album|recording|painting|sculpture|play|performance|photograph|dvd|blu-?ray|cd|lp|ep|"
    "videorecording|video recording|video game|game|opera|ballet|musical|concert|television episode|tv episode|podcast episode"
)
MEDIA_CREDITS = r"director|dir\.|performer|perf\.|artist|creator|choreographer|conductor|host|narrator"
ARCHIVE_MARKS = r"archive|archives|collection|manuscript|ms\.|mss\.|special collections|box\s+\d|folder\s+\d|repository|unpublished manuscript"
# A publisher's marks and the address of its PDFs, the first that applies.
PDF_ADDRESSES = (
    ("springer|nature", "https://link.springer.com/content/pdf/", ".pdf"),
    ("taylor|routledge|t & f", "https://www.tandfonline.com/doi/pdf/", "?download=true"),
    ("wiley", "https://onlinelibrary.wiley.com/doi/pdfdirect/", "?download=true"),
    ("sage", "https://journals.sagepub.com/doi/pdf/", ""),
    ("oxford|oup", "https://academic.oup.com/doi/pdf/", ""),
    ("cambridge", "https://www.cambridge.org/core/services/aop-cambridge-core/content/view/", ".pdf"),
)
# Hosts of open copies, and open states of a work.
OPEN_HOSTS = ("doi.org", "ncbi.nlm.nih.gov", "arxiv.org", "biorxiv.org", "plos.org", "frontiersin.org", "mdpi.com", "doaj.org")
OPEN_STATES = ("gold", "green", "hybrid", "bronze")
# Names of the machine itself.
OWN_NAMES = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback")
#: The last year of publication that counts as public domain, and the sources that hold nothing younger.
PUBLIC_DOMAIN, OLD_SOURCES = 1928, ("wikisource", "gutenberg")


def is_media(raw: Column) -> Column:
    return raw.rlike(rf"(?i)\[({MEDIA_KINDS})\]") | raw.rlike(rf"(?i)\b({MEDIA_CREDITS})\b")


def is_archive(raw: Column) -> Column:
    """Whether a reference names a holding of an archive; such sources are in no index."""
    return raw.rlike(rf"(?i)\b({ARCHIVE_MARKS})\b")


def route(raw: Column) -> Column:
    """archive, media or scholarly: archives come first, since nothing is tried for them."""
    raw = F.coalesce(raw, F.lit(""))
    return F.when(is_archive(raw), "archive").when(is_media(raw), "media").otherwise("scholarly")


def pdf_address(doi: Column, publisher: Column) -> Column:
    """Where a publisher most likely keeps the PDF of a DOI; null where no rule is known."""
    named, out = F.lower(F.coalesce(publisher, F.lit(""))), None
    for marks, before, after in PDF_ADDRESSES:
        case = (named.rlike(marks), F.concat(F.lit(before), F.trim(doi), F.lit(after)))
        out = F.when(*case) if out is None else out.when(*case)
    return out


def is_open(metadata: Column, url: Column) -> Column:
    """Whether a work's metadata (JSON) or the host of its copy says that it is open; false where nothing does."""
    at = lambda path: F.get_json_object(metadata, path)
    flags = (at("$.best_oa_location.is_oa") == "true") | (at("$.open_access.is_oa") == "true") | at("$.open_access.oa_status").isin(*OPEN_STATES) | ~F.coalesce(at("$.openAccessPdf"), F.lit("")).isin("", "{}", "null")
    host = url.rlike("|".join(h.replace(".", "\\.") for h in OPEN_HOSTS))
    return metadata.isNotNull() & (F.coalesce(flags, F.lit(False)) | F.coalesce(host, F.lit(False)))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """The host of an address in lower case; brackets of an IPv6 literal are dropped."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?\[?((?<=\[)[^\]]*|[^/:?#\[\]]+)", 1))


@F.pandas_udf(BooleanType())
def private_address(addresses: pd.Series) -> pd.Series:
    """Whether a literal IP address (4 or 6) is not public; null where the text is no address."""

    def one(x: str | None) -> bool | None:
        try:
            ip = ipaddress.ip_address(x or "")
        except ValueError:
            return None
        return ip.is_loopback or ip.is_private or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified

    return addresses.map(one).astype(object)


@F.pandas_udf(BooleanType())
def any_private(answers: pd.Series) -> pd.Series:
    """Whether any of the addresses in an array is not public."""
    return answers.map(lambda xs: any(not ipaddress.ip_address(x).is_global or ipaddress.ip_address(x).is_multicast for x in xs) if xs is not None else False).astype(bool)


def fetch_verdict(url: Column, answers: Column) -> Column:
    """ok, or why an address must not be fetched, given the addresses that its host resolves to.

    One answer that is not public blocks the host, whatever the others are; so does having none.
    """
    name = host(url)
    literal = private_address(name)
    return (
        F.when(~scheme(url).isin("http", "https"), "scheme")
        .when(F.coalesce(name, F.lit("")) == "", "no_host")
        .when(name.isin(*OWN_NAMES), "own_name")
        .when(literal, "private_literal")
        .when(literal.isNotNull(), "ok")
        .when(F.coalesce(F.size(answers), F.lit(0)) <= 0, "unresolved")
        .when(any_private(answers), "private_answer")
        .otherwise("ok")
    )


def link_detail(category: Column) -> Column:
    """What the outcome of a link check means, in words of this engine."""
    words = {
        "ok": "the page loads", "content_match": "the page loads under the cited title", "content_mismatch": "the page loads under another title", "dead": "there is no such page", "redirect": "the page has moved",
        "paywall": "the page asks for a login", "server_error": "the server failed", "timeout": "no answer in time", "dns_error": "there is no such host", "wrong_type": "no page but a file",
    }
    return F.coalesce(F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.lower(F.trim(category))], F.lit("unknown outcome"))


def title_words_match(cited: Column, page: Column) -> Column:
    """Whether half of the cited title's words of three letters and more are in the page's; false where it has none."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), F.lit(1)))
    n = F.size(words(cited))
    return F.coalesce((n > 0) & (F.size(F.array_intersect(words(cited), words(page))) >= 0.5 * n), F.lit(False))


def title_inside(raw: Column) -> Column:
    """A title guessed from `(year). Title.`, at most one full stop inside; '' if there is none."""
    return F.trim(F.coalesce(F.regexp_extract(raw, r"\(\d{4}\)\.\s*([^.]+(?:\.[^.]+)?)", 1), F.lit("")))


def doi_inside(raw: Column) -> Column:
    """The first DOI inside a text, normalised; '' if there is none."""
    return T.normalize_doi(F.coalesce(F.regexp_extract(raw, r"(?i)(10\.\d{4,}/\S+)", 1), F.lit("")))


def paragraph_role(reply: Column) -> Column:
    """introduction, conclusion or body, from how a reply names it."""
    s = F.lower(F.trim(F.coalesce(reply, F.lit(""))))
    return F.when(s.startswith("intro"), "introduction").when(s.startswith("conclu"), "conclusion").otherwise("body")


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Text with every entity resolved."""
    return texts.map(lambda x: html.unescape(x) if x is not None else None)


def html_titles(page: Column) -> Column:
    """The titles that a page gives itself: its citation title, its title for previews and its own, in this order, entities resolved, empty ones left out."""
    meta = lambda attribute, name: F.regexp_extract(page, rf"(?i)<meta[^>]+{attribute}=[\"']{name}[\"'][^>]+content=[\"']([^\"']+)[\"']", 1)
    found = F.array(meta("name", "citation_title"), meta("property", "og:title"), F.regexp_extract(page, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    joined = F.array_join(F.transform(found, lambda t: F.coalesce(t, F.lit(""))), "\u0001")
    resolved = F.when(F.instr(page, "&") > 0, unescaped(joined)).otherwise(joined)
    return F.filter(F.transform(F.split(resolved, "\u0001"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
