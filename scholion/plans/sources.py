"""Registered queries of retrieval, reference lists and citations in running text; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.functions import records as R
from scholion.functions import sources as P
from scholion.operators import choose, link, markers, reflist, resolve
from scholion.plans import sources_sql
from scholion.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_refs").select("ref_id", "doc_id", "ref_idx", "author", "year", "title", "doi", "raw_ref", "citation_key").dropDuplicates(["ref_id"])


def _cits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citations").select("cit_id", "doc_id", "text", "citation_key").dropDuplicates(["cit_id"]).where("text <> ''")


def _works(spark: SparkSession, d: str) -> DataFrame:
    return choose.latest(table(spark, d, "catalog_works"), "work_id", "retrieved_at", ["source_name", "title", "year", "doi", "publisher", "full_text_url", "authors"])


@_query
def found_citations(spark, d):
    return markers.citations(table(spark, d, "documents"), _refs(spark, d))


@_query
def cited_passage(spark, d):
    return markers.passages(_cits(spark, d), table(spark, d, "documents").where("text <> ''"))


@_query
def reattributed_keys(spark, d):
    return markers.reattributed(_cits(spark, d), _refs(spark, d))


def papers_with_lists(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, style, text): each paper with its references under the heading of its style, long lines wrapped as on a page."""
    order = Window.partitionBy("doc_id").orderBy("ref_idx", "ref_id")
    wrapped = F.regexp_replace(F.regexp_replace("raw_ref", r"\s+", " "), r"^(.{60}\S*) ", "$1\n")
    lists = _refs(spark, d).where("raw_ref <> '' AND doc_id IS NOT NULL").select("doc_id", F.row_number().over(order).alias("at"), wrapped.alias("line"))
    listed = lists.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("list"))
    style = F.when(F.lower(F.trim("citation_style")) == "mla", "mla").otherwise("apa")
    docs = table(spark, d, "documents").select("doc_id", style.alias("style"), F.coalesce("text", F.lit("")).alias("body"))
    heading = F.when(F.col("style") == "mla", "Works Cited").otherwise("References")
    return docs.join(listed, "doc_id").select("doc_id", "style", F.concat("body", F.lit("\n\n"), heading, F.lit("\n"), "list").alias("text"))


@_query
def reference_entries(spark, d):
    papers, out = papers_with_lists(spark, d), None
    for style in ("apa", "mla"):
        part = reflist.entries(reflist.section_lines(papers.where(F.col("style") == style), style), style).select(F.lit(style).alias("style"), "doc_id", "entry", "body")
        out = part if out is None else out.unionByName(part)
    return out


@_query
def publisher_pdf(spark, d):
    return _works(spark, d).where("doi <> ''").select("work_id", P.pdf_address(F.col("doi"), F.col("publisher")).alias("address"))


@_query
def guessed_identifiers(spark, d):
    return _refs(spark, d).select("ref_id", P.doi_inside(F.col("raw_ref")).alias("guessed_doi"), P.title_inside(F.col("raw_ref")).alias("guessed_title"))


@_query
def link_details(spark, d):
    return table(spark, d, "link_checks").dropDuplicates(["check_id"]).groupBy(P.link_detail(F.col("category")).alias("detail")).agg(F.count("*").alias("n"))


@_query
def fetch_verdicts(spark, d):
    """Whether the addresses of link checks may be fetched; a check that found no host has no answers."""
    checks = table(spark, d, "link_checks").dropDuplicates(["check_id"]).where("url <> ''")
    answers = F.when(F.lower(F.trim("category")) == "dns_error", F.array().cast("array<string>")).otherwise(F.array(F.lit("8.8.8.8"), F.when(F.col("status_code") == 403, F.lit("10.0.0.7")).otherwise(F.lit("8.8.4.4"))))
    return checks.groupBy(P.fetch_verdict(F.col("url"), answers).alias("verdict")).agg(F.count("*").alias("n"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue records as the services answer for them: (work_id, title, year, doi, first author, ...) and a JSON text a service."""
    w = _works(spark, d).withColumn("y", F.regexp_extract(F.coalesce("year", F.lit("")), r"(\d{4})", 1).try_cast("int"))
    people = F.coalesce(F.filter("authors", lambda a: F.coalesce(a, F.lit("")) != ""), F.array().cast("array<string>"))
    named = lambda key: F.transform(people, lambda a: F.struct(a.alias(key)))
    crossref = F.struct(F.col("doi").alias("DOI"), F.array("title").alias("title"), F.struct(F.array(F.array("y")).alias("date-parts")).alias("issued"), named("family").alias("author"), F.concat(F.lit("<jats:p>On "), F.coalesce("publisher", F.lit("")), F.lit("</jats:p>")).alias("abstract"))
    openalex = F.struct(
        F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), "title", F.col("y").alias("publication_year"), F.transform(people, lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"),
        F.struct(F.col("full_text_url").alias("pdf_url")).alias("best_oa_location"),
    )
    semantic = F.struct(F.struct(F.col("doi").alias("DOI")).alias("externalIds"), "title", F.col("y").alias("year"), named("name").alias("authors"), F.struct(F.col("full_text_url").alias("url")).alias("openAccessPdf"))
    core = F.struct("doi", "title", F.col("y").alias("yearPublished"), named("name").alias("authors"), F.array("full_text_url").alias("sourceFulltextUrls"))
    gutenberg = F.struct("title", F.col("y").alias("copyright_year"), named("name").alias("authors"), F.create_map(F.lit("text/plain"), F.col("full_text_url")).alias("formats"))
    return w.select("work_id", "full_text_url", *[F.to_json(s).alias(n) for n, s in (("crossref", crossref), ("openalex", openalex), ("semantic", semantic), ("core", core), ("gutenberg", gutenberg))])


def _records(name: str, parse: Callable) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        r = _answers(spark, d).select("work_id", parse(F.col(name)).alias("r"))
        return r.select("work_id", "r.doi", "r.title", "r.year", F.array_join("r.authors", "|").alias("people"), "r.abstract", "r.full_text_url")

    query.__name__ = f"{name}_records"
    _query(query)


for _name, _parse in (("crossref", R.crossref_record), ("openalex", R.openalex_record), ("semantic", R.semantic_record), ("core", R.core_record), ("gutenberg", R.gutenberg_record)):
    _records(_name, _parse)


@_query
def open_access(spark, d):
    """Whether each record is open, by what an answer says of it or the host of its copy."""
    return _answers(spark, d).select("work_id", P.is_open(F.col("semantic"), F.col("full_text_url")).alias("open"))


@_query
def resolved_sources(spark, d):
    """Which attempt gives each reference its source: live checks of its own address, then records under its DOI or title."""
    refs = _refs(spark, d)
    live = F.lower(F.trim("category")).isin("ok", "content_match", "redirect")
    urls = table(spark, d, "link_checks").where(live).select("ref_id", F.lit("url").alias("stage"), F.lit("own address").alias("source"), F.lit(0).alias("rank"), F.lit(True).alias("has_text"), F.lit(False).alias("has_abstract")).distinct()
    works = _works(spark, d)
    rank = F.array_position(F.array(*[F.lit(s) for s in ("openstacks", "meridian", "quillnet")]), F.col("source_name")).cast("int")
    found = link.cached_works(refs, works).where("work_id IS NOT NULL").join(works, "work_id")
    searched = found.select("ref_id", F.lit("search").alias("stage"), F.col("source_name").alias("source"), rank.alias("rank"), (F.coalesce("full_text_url", F.lit("")) != "").alias("has_text"), F.lit(True).alias("has_abstract"))
    return resolve.resolved(refs, urls.unionByName(searched))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return sources_sql.oracle_sql()
