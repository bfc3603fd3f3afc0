"""The registered queries of the problems; every one runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import linkage, lookalikes, packing, personal, residue, scanned, spans, splitting, tokens
from scholion.runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "parsed_refs")
    refs = parsed.select(F.col("ref_id").alias("id"), "title", F.col("author").alias("people"), "year", "doi")
    catalog = table(spark, sf_dir, "catalog_works")
    # Redelivered records count once, the latest.
    fields = ["title", "authors", "year", "doi"]
    latest = catalog.groupBy("work_id").agg(F.max_by(F.struct(*fields), F.struct("retrieved_at", *fields)).alias("r"))
    readings = table(spark, sf_dir, "course_readings")
    split = F.split(F.regexp_replace("author_line", r"\s*(?:;|&|\band\b|,\s*&)\s*", ";"), r"\s*;\s*")
    # Lines such as `Doe, A., Roe, B.` and `Ann Doe, Bob Roe` are cut at the commas between people.
    people = F.flatten(F.transform(split, lambda x: F.split(F.regexp_replace(F.regexp_replace(x, r"(\p{Lu}\.),\s*", "$1;"), r"(\p{L}{2,} \p{L}{2,}),\s*", "$1;"), r";\s*")))
    records = latest.select(F.col("work_id").alias("id"), "r.title", F.col("r.authors").alias("people"), "r.year", "r.doi").unionByName(
        readings.select(F.col("work_id").alias("id"), F.col("shelf_title").alias("title"), people.alias("people"), F.col("pub_year").alias("year"), "doi")
    )
    counts = lookalikes.code_points([(parsed, "title"), (parsed, "author"), (catalog, "title")])
    return linkage.link(refs, records, counts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("ref_id", "work_id").distinct()


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)


def _readable(spark: SparkSession, sf_dir: str, cases_only: bool) -> DataFrame:
    citations = table(spark, sf_dir, "citations")
    counts = lookalikes.code_points([(citations, "text")])
    words = scanned.lexicon(table(spark, sf_dir, "documents"), "text", citations, "text")
    vectors = scanned.skip_grams(citations, "text", words)
    return scanned.repair(citations, "cit_id", "text", words, vectors, counts, cases_only)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readable(spark, sf_dir, True).select("cit_id").distinct()


def p2_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readable(spark, sf_dir, False).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find(table(spark, sf_dir, "link_checks"))


def _personal(spark: SparkSession, sf_dir: str, what: Callable) -> DataFrame:
    citations = table(spark, sf_dir, "citations")
    people = table(spark, sf_dir, "parsed_refs").select(F.col("author").alias("name")).unionByName(table(spark, sf_dir, "catalog_works").select(F.explode("authors").alias("name")))
    return what(citations, "cit_id", "text", personal.given_names(people), lookalikes.code_points([(citations, "text")]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir, personal.find).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir, personal.redact).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = splitting.chapter_bounds(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "size_limits"))
    pieces = splitting.split(splitting.oversized(bounds), _sections(spark, sf_dir), "book_id", ["book_id", "chapter_no"])
    return pieces.where("piece > 0").select("book_id", "chapter_no").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chapters(*(table(spark, sf_dir, t) for t in ("chapters", "toc_entries", "size_limits")))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "toc_entries").where("toc_level >= 2 AND start_page > 0").select("book_id", F.col("start_page").alias("at"))


def _in_one_form(spark: SparkSession, sf_dir: str, changed_only: bool) -> DataFrame:
    fields = [("parsed_refs", "ref_id", "title"), ("citations", "cit_id", "text")]
    tables = {t: table(spark, sf_dir, t) for t, _, _ in fields}
    counts = lookalikes.code_points([(tables[t], c) for t, _, c in fields])
    parts = [
        lookalikes.rewrite(tables[t].select(F.col(i).alias("row_id"), c), c, counts, ["row_id"], changed_only=changed_only).select(F.lit(t).alias("table_name"), "row_id", "form")
        for t, i, c in fields
    ]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_one_form(spark, sf_dir, True).select("table_name", "row_id").distinct()


def p6_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_one_form(spark, sf_dir, False).distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(tokens.count_tokens(table(spark, sf_dir, "documents")))
    # Five rows of configuration.
    limits = [(r["limit_name"], r["max_size"]) for r in table(spark, sf_dir, "size_limits").where("size_unit = 'tokens'").collect()]
    parts = [packing.pack(sizes, n).select(F.lit(name).alias("limit_name"), F.col("container").alias("batch_id"), "doc_id", "piece", F.col("start").alias("token_start"), F.col("end").alias("token_end"), F.col("size").alias("n_tokens")) for name, n in sorted(limits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
