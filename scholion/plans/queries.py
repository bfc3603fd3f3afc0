"""The registered queries of the core operators; every one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.functions import responses as R
from scholion.functions import similarity as S
from scholion.functions import sources as P
from scholion.functions import text as T
from scholion.operators import choose, link, parse
from scholion.plans import sql
from scholion.runtime import table
from scholion.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """References without redeliveries: one row per id, so columns that a query leaves alone are pruned below the aggregate."""
    return table(spark, d, "parsed_refs").select("ref_id", "doc_id", "ref_idx", "author", "year", "title", "doi", "url", "raw_ref", "citation_key").dropDuplicates(["ref_id"])


def _cits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citations").select("cit_id", "doc_id", "paragraph_index", "seq", "text", "claim_type", "citation_key", "citation_marker", "marker_type", "confidence", "drop_reason").dropDuplicates(["cit_id"])


def _works(spark: SparkSession, d: str) -> DataFrame:
    return choose.latest(table(spark, d, "catalog_works"), "work_id", "retrieved_at", ["source_name", "title", "year", "doi", "publisher"])


def _checks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "link_checks").select("check_id", "ref_id", "url", "category", "status_code", "page_title", "redirect_url", "cited_title", "checked_at").distinct()
    return c.withColumn("category", F.coalesce(F.lower(F.trim("category")), F.lit("unknown")))


# Text functions


@_query
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("body"))


@_query
def doi_normalize(spark, d):
    return _refs(spark, d).select("ref_id", F.coalesce(T.normalize_doi(F.col("doi")), F.lit("")).alias("doi"))


@_query
def title_hash_key(spark, d):
    return _refs(spark, d).select("ref_id", T.title_hash(F.col("title")).alias("title_hash"))


@_query
def cache_keys(spark, d):
    return _refs(spark, d).select("ref_id", F.array_join(T.cache_keys(F.col("doi"), F.col("title")), "|").alias("keys"))


@_query
def citation_key(spark, d):
    return _refs(spark, d).select("ref_id", T.citation_key(F.col("author"), F.col("year")).alias("made_key"))


@_query
def clean_year(spark, d):
    return _works(spark, d).select("work_id", T.clean_year(F.coalesce("year", F.lit(""))).alias("clean_year"))


@_query
def claim_type_detect(spark, d):
    return _cits(spark, d).where("text IS NOT NULL").select("cit_id", T.claim_type(F.col("text")).alias("detected"))


@_query
def markup_strip(spark, d):
    return _works(spark, d).select("work_id", T.strip_markup(F.col("title")).alias("plain_title"))


@_query
def identifiers(spark, d):
    doi, url = parse.identifiers(F.col("raw_ref"))
    return _refs(spark, d).select("ref_id", doi.alias("found_doi"), url.alias("found_url"))


@_query
def url_hosts(spark, d):
    host = T.url_host(F.col("url"))
    return _checks(spark, d).where("url <> ''").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.bool_or(T.blocked_host(host)).alias("blocked"))


# Splitters and parsers


@_query
def sentence_split(spark, d):
    return parse.sentence_rows(table(spark, d, "documents"))


@_query
def paragraph_grid_counts(spark, d):
    rows = parse.sentence_rows(table(spark, d, "documents"))
    return rows.groupBy("doc_id", "para_idx").agg(F.count("*").alias("n_sentences"), F.sum(F.char_length("sentence")).alias("n_chars"))


@_query
def line_blocks_merge(spark, d):
    return parse.line_blocks(table(spark, d, "documents"), F.col("line").rlike(r"^(In|The|After|Between) "))


@_query
def section_scan(spark, d):
    return parse.dense_starts(table(spark, d, "documents"), F.col("line").rlike(r"^(In|The|After|Between|By|On) "), 30, 2)


@_query
def reference_format_detect(spark, d):
    return _refs(spark, d).groupBy(parse.reference_format(F.coalesce("raw_ref", F.lit(""))).alias("format")).agg(F.count("*").alias("n"))


@_query
def apa_fields(spark, d):
    refs = _refs(spark, d).where(parse.reference_format(F.coalesce("raw_ref", F.lit(""))) == "apa")
    return refs.select("ref_id", *[c.alias(k) for k, c in parse.apa_fields(F.col("raw_ref")).items()])


@_query
def mla_fields(spark, d):
    refs = _refs(spark, d).where(parse.reference_format(F.coalesce("raw_ref", F.lit(""))) == "mla")
    return refs.select("ref_id", *[c.alias(k) for k, c in parse.mla_fields(F.col("raw_ref")).items()])


@_query
def labelled_fields(spark, d):
    reply = F.concat(F.lit("Author: "), F.coalesce("author", F.lit("none")), F.lit("\nYear: "), F.coalesce("year", F.lit("N/A")), F.lit("\nTitle: "), F.coalesce("title", F.lit("null")))
    return _refs(spark, d).select("ref_id", *[c.alias(k) for k, c in parse.labelled_fields(reply, ("author", "year", "title")).items()])


@_query
def cite_tag_parse(spark, d):
    tagged = F.concat(F.lit('Before <cite type="x" key="'), F.col("citation_key"), F.lit('">'), F.col("text"), F.lit("</cite> after"))
    rows = _cits(spark, d).where("text IS NOT NULL AND citation_key IS NOT NULL").select("cit_id", F.inline(parse.cite_tags(tagged)))
    return rows.select("cit_id", "key", F.char_length("body").alias("body_chars"))


@_query
def chapter_ranges(spark, d):
    return parse.chapter_ranges(table(spark, d, "toc_entries"))


@_query
def inverted_index_rebuild(spark, d):
    """The words of each paper as an inverted index, and the text rebuilt from it."""
    words = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split(T.squeeze(F.col("text")), " ")).alias("pos", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at"))
    back = index.select("doc_id", "word", F.explode("at").alias("pos"))
    return back.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("rebuilt"), F.countDistinct("word").alias("n_words"))


# Joins


@_query
def surname_index(spark, d):
    return link.surname_index(_refs(spark, d)).groupBy("doc_id", "surname").agg(F.count("*").alias("n_refs"), F.min("ref_idx").alias("first_idx"))


@_query
def citation_links(spark, d):
    return link.marker_links(_cits(spark, d), _refs(spark, d))


@_query
def orphan_citations(spark, d):
    return _cits(spark, d).where("citation_key IS NOT NULL").join(_refs(spark, d).select("doc_id", "citation_key"), ["doc_id", "citation_key"], "left_anti").select("cit_id", "doc_id", "citation_key")


@_query
def phantom_references(spark, d):
    return _refs(spark, d).join(_cits(spark, d).select("doc_id", "citation_key"), ["doc_id", "citation_key"], "left_anti").select("ref_id", "doc_id", "citation_key")


@_query
def scope_references(spark, d):
    return _refs(spark, d).join(_cits(spark, d).where("claim_type = 'quotation'").select("doc_id", "citation_key"), ["doc_id", "citation_key"], "left_semi").select("ref_id", "doc_id")


@_query
def cache_lookup(spark, d):
    return link.cached_works(_refs(spark, d), _works(spark, d))


@_query
def paragraph_densify(spark, d):
    """Every paragraph 0..last of a paper with its number of citations, none included."""
    cits = _cits(spark, d).where("paragraph_index >= 0")
    grid = cits.groupBy("doc_id").agg(F.max("paragraph_index").alias("last")).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("paragraph_index"))
    n = cits.groupBy("doc_id", "paragraph_index").agg(F.count("*").alias("n"))
    return grid.join(n, ["doc_id", "paragraph_index"], "left").select("doc_id", "paragraph_index", F.coalesce("n", F.lit(0)).alias("n_citations"))


@_query
def span_lookup(spark, d):
    """Whether a citation's text stands in the paragraph that it names."""
    paras = table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph_index", "para"))
    cits = _cits(spark, d).where("text <> ''")
    there = F.coalesce(F.instr(T.normalize_text(F.col("para")), T.normalize_text(F.col("text"))) > 0, F.lit(False))
    joined = cits.join(paras, ["doc_id", "paragraph_index"], "left")
    return joined.select("cit_id", F.when(F.col("para").isNull(), "no_paragraph").when(there, "exact").otherwise("differs").alias("outcome"))


@_query
def locate_passage(spark, d):
    return link.best_paragraph(_cits(spark, d).where("text <> ''"), table(spark, d, "documents").where("text <> ''"))


@_query
def repeated_citations(spark, d):
    return link.repeated_citations(_cits(spark, d).where("text <> ''"))


# Similarity


@_query
def page_title_match(spark, d):
    rows = _checks(spark, d).where("page_title IS NOT NULL AND cited_title IS NOT NULL")
    return rows.select("check_id", S.page_title_matches(F.col("cited_title"), T.strip_markup(F.col("page_title"))).alias("matches"))


def _doi_pairs(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d).withColumn("k", T.normalize_doi(F.col("doi"))).where("k <> ''")
    works = _works(spark, d).select("work_id", F.col("title").alias("work_title"), F.col("year").alias("work_year"), T.normalize_doi(F.col("doi")).alias("k")).where("k <> ''")
    return refs.join(works, "k")


@_query
def title_coverage(spark, d):
    q, m = F.col("title"), F.col("work_title")
    return _doi_pairs(spark, d).select("ref_id", "work_id", F.round(S.coverage(q, m), 6).alias("coverage"), (S.coverage(q, m) >= S.coverage_threshold(q) - 1e-9).alias("relevant"))


def _title_pairs(spark: SparkSession, d: str) -> DataFrame:
    """References and records under one title key, with both sides' fields."""
    refs = _refs(spark, d).withColumn("h", T.normalize_title(F.col("title"))).where("h <> ''")
    works = choose.latest(table(spark, d, "catalog_works"), "work_id", "retrieved_at", ["title", "year", "doi", "authors"])
    works = works.select("work_id", F.col("title").alias("work_title"), F.col("year").alias("work_year"), F.col("doi").alias("work_doi"), "authors", T.normalize_title(F.col("title")).alias("h"))
    return refs.join(works, "h")


@_query
def identity_score(spark, d):
    confidence = S.identity_confidence(*[(F.col(a), F.col(b)) for a, b in (("doi", "work_doi"), ("title", "work_title"), ("author", "authors"), ("year", "work_year"))])
    return _title_pairs(spark, d).select("ref_id", "work_id", confidence.alias("confidence"))


@_query
def author_relevance(spark, d):
    """Whether records under a reference's title or DOI are the cited work: title and author both (sequence matching has no SQL form)."""
    pairs = _title_pairs(spark, d).select("ref_id", "work_id", "title", "work_title", "author", "authors")
    names = F.array_distinct(F.flatten(F.transform(F.coalesce("authors", F.array()), lambda a: S.surnames(F.coalesce(a, F.lit(""))))))
    return pairs.select("ref_id", "work_id", S.relevant(F.col("title"), F.col("work_title"), S.surnames(F.coalesce("author", F.lit(""))), names).alias("relevant"))


@_query
def author_similarity(spark, d):
    """Best surname ratio of references and records that share a DOI (sequence matching has no SQL form)."""
    authors = table(spark, d, "catalog_works").select("work_id", F.transform("authors", lambda a: F.lower(F.when(F.instr(a, ",") > 0, F.substring_index(a, ",", 1)).otherwise(F.regexp_extract(a, r"(\S+)$", 1)))).alias("own")).dropDuplicates(["work_id"])
    return _doi_pairs(spark, d).join(authors, "work_id").select("ref_id", "work_id", F.round(S.best_ratio(S.surnames(F.coalesce("author", F.lit(""))), F.col("own")), 6).alias("ratio"))


@_query
def dedup_exact(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("kept_doc"), F.count("*").alias("copies")).select("kept_doc", "copies")


@_query
def page_number_pairs(spark, d):
    """Tables of contents with two start pages that follow each other."""
    pages = table(spark, d, "toc_entries").where("start_page > 0").groupBy("book_id").agg(F.collect_set("start_page").alias("p"))
    return pages.select("book_id", F.exists("p", lambda x: F.array_contains("p", x + 1)).alias("has_pair"))


# Choice and classification


@_query
def first_live_check(spark, d):
    """Each reference's best check: by kind of outcome, then the earliest."""
    rank = F.when(F.col("category").isin("content_match", "ok"), 1).when(F.col("category") == "redirect", 2).when(F.col("category") == "paywall", 3).otherwise(9)
    return choose.first_by(_checks(spark, d).withColumn("priority", rank), ["ref_id"], "priority", "checked_at", "check_id").select("ref_id", "check_id", "priority")


@_query
def link_category_counts(spark, d):
    return _checks(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("ref_id").alias("n_refs"))


@_query
def link_classify(spark, d):
    """The outcome of a check from its status code and titles alone."""
    code, cited, page = F.col("status_code"), F.col("cited_title"), T.strip_markup(F.col("page_title"))
    match = P.title_words_match(cited, page)
    return _checks(spark, d).select(
        "check_id",
        F.when(F.coalesce(F.col("url"), F.lit("")) == "", "dead").when(code.isin(401, 403, 451), "paywall").when(code.isin(404, 410), "dead").when(code >= 500, "server_error").when(code.between(300, 399), "redirect")
        .when((code == 200) & cited.isNotNull() & (F.coalesce(page, F.lit("")) != ""), F.when(match, "content_match").otherwise("content_mismatch")).when(code.between(200, 299), "ok").otherwise("unknown").alias("outcome"),
    )


@_query
def source_type_route(spark, d):
    return _refs(spark, d).select("ref_id", P.route(F.col("raw_ref")).alias("route"))


@_query
def publisher_route(spark, d):
    p = F.lower(F.coalesce("publisher", F.lit("")))
    kind = F.when(p.contains("university press"), "press").when(p.contains("proceedings"), "proceedings").when(p.rlike("journal|annals|quarterly|review"), "journal").when(p == "", "none").otherwise("other")
    return _works(spark, d).groupBy(kind.alias("kind"), "source_name").agg(F.count("*").alias("n"))


@_query
def text_quality_rule(spark, d):
    latest = choose.latest(table(spark, d, "text_quality"), "doc_id", "classified_at", ["verdict", "image_coverage", "text_fraction"])
    made = F.when(F.col("text_fraction") < 0.5, "pure_scan").when(F.col("image_coverage") >= 0.9, "scan_ocr").otherwise("digital")
    return latest.where("image_coverage IS NOT NULL AND text_fraction IS NOT NULL").select("doc_id", made.alias("computed"), F.coalesce(F.lower(F.trim("verdict")), F.lit("none")).alias("given"))


@_query
def catalog_search(spark, d):
    return _works(spark, d).where(F.lower("title").contains("chess") & (F.col("source_name") == "meridian")).select("work_id", "title", "year")


@_query
def catalog_upsert(spark, d):
    """The catalogue after its redeliveries and the reading list have been merged in."""
    works = _works(spark, d).select("work_id", "title", "year", "doi")
    readings = table(spark, d, "course_readings").select("work_id", F.col("shelf_title").alias("title"), F.col("pub_year").alias("year"), "doi")
    return works.unionByName(readings)


@_query
def catalog_delete(spark, d):
    gone = _works(spark, d).where("year IS NULL OR year = 'n.d.'").select("work_id")
    return _works(spark, d).join(gone, "work_id", "left_anti").groupBy("source_name").agg(F.count("*").alias("n"))


# Summaries


@_query
def missing_identifiers(spark, d):
    """Per paper: references with a DOI, with a URL, and those with neither by what kind of source they name."""
    raw = F.coalesce("raw_ref", F.lit(""))
    url = (F.trim(F.coalesce("url", F.lit(""))) != "") | raw.rlike("(?i)https?://|www\\.")
    bucket = F.when(F.trim(F.coalesce("doi", F.lit(""))) != "", "with_doi").when(url, "with_url").when(P.is_media(raw), "missing_media").when(P.is_archive(raw), "missing_archive").otherwise("should_have")
    return _refs(spark, d).groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(bucket == b).alias(b) for b in ("with_doi", "with_url", "missing_media", "missing_archive", "should_have")])


@_query
def ref_completeness(spark, d):
    """Flagship: per paper its references, how many are cited, and how many have a live link or a DOI."""
    cited = _cits(spark, d).select("doc_id", "citation_key").distinct().withColumn("cited", F.lit(1))
    live = _checks(spark, d).where(F.col("category").isin("ok", "content_match", "redirect")).select("ref_id").distinct().withColumn("live", F.lit(1))
    refs = _refs(spark, d).join(cited, ["doc_id", "citation_key"], "left").join(live, "ref_id", "left")
    has_doi = (T.normalize_doi(F.coalesce("doi", F.lit(""))) != "").cast("int")
    return refs.groupBy("doc_id").agg(F.count("*").alias("n_refs"), F.count("cited").alias("n_cited"), F.count("live").alias("n_live"), F.sum(has_doi).alias("n_doi"))


@_query
def toc_cross_reference(spark, d):
    toc = table(spark, d, "toc_entries").groupBy("book_id").agg(F.max("start_page").alias("last_start"), F.max("logical_pages").alias("pages"))
    return toc.select("book_id", F.when(F.col("last_start").isNull(), "none").when(F.col("last_start") > F.col("pages"), "incomplete").otherwise("complete").alias("vote"))


@_query
def completeness_verdict(spark, d):
    """Votes of three signals per book, combined to a verdict."""
    toc = table(spark, d, "toc_entries")
    a = toc_cross_reference(spark, d).where("vote <> 'none'")
    b = toc.groupBy("book_id").agg(F.bool_or(F.lower("title").rlike("index|bibliography|references|works cited")).alias("back")).select("book_id", F.when(F.col("back"), "complete").otherwise("incomplete").alias("vote"))
    c = table(spark, d, "chapters").groupBy("book_id").agg(F.max("page_end").alias("e"), F.max("logical_pages").alias("p")).where("e IS NOT NULL AND p IS NOT NULL").select("book_id", F.when(F.col("e") > F.col("p"), "incomplete").otherwise("complete").alias("vote"))
    votes = a.unionByName(b).unionByName(c).groupBy("book_id").agg(F.count_if(F.col("vote") == "incomplete").alias("bad"), F.count_if(F.col("vote") == "complete").alias("good"))
    verdict = F.when((F.col("bad") > 0) & (F.col("good") > 0), "uncertain").when(F.col("bad") > 0, "incomplete").otherwise("complete")
    confidence = F.when((F.col("bad") > 0) & (F.col("good") > 0), "medium").when(F.greatest("bad", "good") >= 2, "high").otherwise("medium")
    return votes.select("book_id", verdict.alias("verdict"), confidence.alias("confidence"))


@_query
def paper_report_rollup(spark, d):
    c = _cits(spark, d).select(F.coalesce("claim_type", F.lit("none")).alias("claim_type"), F.coalesce("marker_type", F.lit("none")).alias("marker_type"), "drop_reason")
    return c.rollup("claim_type", "marker_type").agg(F.count("*").alias("n"), F.count("drop_reason").alias("n_dropped")).select(F.coalesce("claim_type", F.lit("all")).alias("claim_type"), F.coalesce("marker_type", F.lit("all")).alias("marker_type"), "n", "n_dropped")


@_query
def cache_stats(spark, d):
    hits = link.cached_works(_refs(spark, d), _works(spark, d))
    return hits.agg(F.count("*").alias("lookups"), F.count_if(F.col("via") != "miss").alias("hits"), F.count_if(F.col("via") == "doi").alias("by_doi"))


@_query
def paragraph_batches(spark, d):
    """Paragraphs of a paper in batches of about 1,500 estimated tokens (four characters each), in order."""
    paras = table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "para"))
    sized = paras.select("doc_id", "para_idx", F.floor(F.char_length("para") / 4).cast("long").alias("tokens"))
    order = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("batch", F.floor(F.coalesce(F.sum("tokens").over(order), F.lit(0)) / 1500).cast("long")).groupBy("doc_id", "batch").agg(F.count("*").alias("n_paragraphs"), F.sum("tokens").alias("n_tokens"))


@_query
def vector_topk(spark, d):
    return choose.nearest(table(spark, d, "embeddings"), 10, 50)


# Markers, quotations and replies


@_query
def apa_markers(spark, d):
    """Author-year markers in brackets and in the running text, counted by name and year."""
    text = F.col("text")
    paren = F.transform(F.regexp_extract_all(text, F.lit(r"(\(\p{Lu}[\p{L}'-]+(?: (?:&|and) \p{Lu}[\p{L}'-]+| et al\.)?, \d{4}[a-z]?)"), F.lit(1)), lambda x: F.struct(F.lit("parenthetical").alias("kind"), F.regexp_extract(x, r"\((\p{Lu}[\p{L}'-]+)", 1).alias("name"), F.regexp_extract(x, r"(\d{4})", 1).alias("year")))
    told = F.transform(F.regexp_extract_all(text, F.lit(r"(\p{Lu}[\p{L}'-]+(?: (?:&|and) \p{Lu}[\p{L}'-]+| et al\.)? \(\d{4}[a-z]?\))"), F.lit(1)), lambda x: F.struct(F.lit("narrative").alias("kind"), F.regexp_extract(x, r"^(\p{Lu}[\p{L}'-]+)", 1).alias("name"), F.regexp_extract(x, r"(\d{4})", 1).alias("year")))
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.inline(F.concat(paren, told))).groupBy("kind", "name", "year").agg(F.count("*").alias("n"))


@_query
def mla_markers(spark, d):
    """Author-page markers in brackets, by paper."""
    marks = F.regexp_extract_all("text", F.lit(r"\((\p{Lu}[\p{L}'-]+)(?: et al\.)? \d{1,4}(?:-\d{1,4})?\)"), F.lit(1))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(marks).alias("n_marks"), F.size(F.array_distinct(marks)).alias("n_names")).where("n_marks > 0")


@_query
def secondary_markers(spark, d):
    """Citations at second hand: the work named and the one it was read in."""
    pattern = r"\((\p{Lu}[\p{L}'-]+)[^()]*?,? as cited in (\p{Lu}[\p{L}'-]+)"
    c = _cits(spark, d).where("text IS NOT NULL").select("cit_id", F.regexp_extract("text", pattern, 1).alias("original"), F.regexp_extract("text", pattern, 2).alias("read_in"))
    return c.where("original <> ''")


@_query
def quote_verify(spark, d):
    """Whether the quoted words of a citation stand in its paper: exactly, by their first fifty characters, or not."""
    quote = F.regexp_extract("text", r"[\x{201C}\"]([^\x{201C}\x{201D}\"]{3,})[\x{201D}\"]", 1)
    quotes = _cits(spark, d).where("claim_type = 'quotation' AND text IS NOT NULL").select("cit_id", "doc_id", T.normalize_text(quote).alias("q")).where("q <> ''")
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.normalize_text(F.col("text")).alias("body"))
    probe = F.substring("q", 1, 50)
    outcome = F.when(F.instr(F.col("body"), F.col("q")) > 0, "exact").when((F.char_length("q") > 20) & (F.instr(F.col("body"), probe) > 0), "near").otherwise("missing")
    return quotes.join(docs, "doc_id").select("cit_id", outcome.alias("outcome"))


@_query
def uncited_sentences(spark, d):
    """Sentences of cited paragraphs whose first 30 characters stand in no citation's text, and that hold no citation's first 30, counted by paragraph."""
    sents = parse.sentence_rows(table(spark, d, "documents")).select("doc_id", F.col("para_idx").alias("paragraph_index"), "sent_idx", F.lower("sentence").alias("s"), F.lower(F.substring("sentence", 1, 30)).alias("s_start"))
    cits = _cits(spark, d).where("text <> ''").select("doc_id", "paragraph_index", F.lower("text").alias("c"), F.lower(F.substring("text", 1, 30)).alias("c_start")).distinct()
    covers = F.expr("instr(c, s_start) > 0 OR instr(s, c_start) > 0")
    at = sents.join(cits, ["doc_id", "paragraph_index"]).groupBy("doc_id", "paragraph_index", "sent_idx").agg(F.bool_or(covers).alias("cited"))
    return at.where("NOT cited").groupBy("doc_id", "paragraph_index").agg(F.count("*").alias("n"))


@_query
def paper_hints(spark, d):
    """Per paper the sorted distinct surnames and the number of its references."""
    return link.surname_index(_refs(spark, d)).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("surname")), " ").alias("surnames"), F.countDistinct("ref_id").alias("n_refs"))


@_query
def paper_keywords(spark, d):
    """The ten most frequent significant words of each paper, ties in order of the alphabet."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{5,})"), F.lit(1))
    counts = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(best)).where("rank <= 10")


@_query
def reference_batches(spark, d):
    """References of a paper in batches of ten, in order."""
    order = Window.partitionBy("doc_id").orderBy("ref_idx", "ref_id")
    at = _refs(spark, d).withColumn("batch", F.floor((F.row_number().over(order) - 1) / 10).cast("long"))
    return at.groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.min("ref_id").alias("first_ref"))


@_query
def search_text(spark, d):
    """The text that a title search sends: significant tokens and the first surname."""
    tokens = F.array_join(F.slice(S.significant_tokens(F.col("title")), 1, 8), " ")
    return _refs(spark, d).where("title IS NOT NULL").select("ref_id", F.trim(F.concat_ws(" ", tokens, F.try_element_at(S.surnames(F.coalesce("author", F.lit(""))), F.lit(1)))).alias("query"))


@_query
def html_title_extract(spark, d):
    page = F.concat(F.lit('<html><head><meta property="og:title" content=" "><TITLE lang="x">\n'), F.col("page_title"), F.lit(" </TITLE></head>"))
    return _checks(spark, d).where("page_title IS NOT NULL").select("check_id", R.html_title(page).alias("title"))


@_query
def flag_coercion(spark, d):
    return _checks(spark, d).select("check_id", R.truthy(F.when(F.col("category") == "ok", F.lit(" Yes ")).when(F.col("category") == "dead", F.lit("no")).otherwise(F.col("category"))).alias("flag"))


@_query
def json_salvage(spark, d):
    """Event properties cut short and salvaged (closing truncated JSON has no SQL form)."""
    cut = F.concat(F.lit('{"items": [{"a": 1}, '), F.col("props"), F.lit(', {"b": "cut'))
    return table(spark, d, "events").select("event_id", R.salvage_json(cut).alias("whole")).select("event_id", F.size(F.from_json("whole", "items array<map<string,string>>")["items"]).alias("n_items"))


@_query
def event_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query
def call_spacing(spark, d):
    """Events that follow the same user's last one within a minute, by type."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    close = F.col("ts") < F.lag("ts").over(order) + F.expr("INTERVAL 60 SECONDS")
    return table(spark, d, "events").withColumn("close", F.coalesce(close, F.lit(False))).groupBy("event_type").agg(F.count_if("close").alias("n_close"), F.count("*").alias("n"))


# Events


@_query
def job_latest_state(spark, d):
    return jobs.latest_state(table(spark, d, "events"))


@_query
def dead_letters(spark, d):
    return jobs.dead_letters(table(spark, d, "events"))


@_query
def retry_backoff(spark, d):
    return jobs.retries(table(spark, d, "events"))


@_query
def events_tumbling(spark, d):
    return jobs.tumbling(table(spark, d, "events"), "1 hour")


@_query
def events_sliding(spark, d):
    return jobs.sliding(table(spark, d, "events"), "2 hours", "1 hour")


@_query
def events_sessions(spark, d):
    return jobs.sessions(table(spark, d, "events"), 1800)


@_query
def events_stream_counts(spark, d):
    return jobs.streamed_counts(spark, d)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
