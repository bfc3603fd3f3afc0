"""Joins between citations, references, paragraphs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions import similarity as S
from scholion.functions import text as T


def surname_index(refs: DataFrame) -> DataFrame:
    """(doc_id, surname, ref_id, ref_idx, year): a row for every surname of every reference."""
    return refs.select("doc_id", "ref_id", "ref_idx", "year", F.explode(S.surnames(F.col("author"))).alias("surname"))


def marker_links(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """(cit_id, ref_id, exact_year): each citation's first reference of the marker's surname, those of its year first."""
    marker = F.col("citation_marker")
    marks = citations.select(
        "cit_id", "doc_id", F.lower(F.regexp_extract(marker, r"([\p{Lu}][\p{L}'-]+)", 1)).alias("surname"), F.regexp_extract(marker, r"(\d{4})", 1).alias("marked_year")
    ).where("surname <> ''")
    joined = marks.join(surname_index(refs), ["doc_id", "surname"])
    exact = (F.col("marked_year") != "") & F.coalesce(F.col("year").contains(F.col("marked_year")), F.lit(False))
    best = Window.partitionBy("cit_id").orderBy(F.desc("exact_year"), "ref_idx", "ref_id")
    return joined.withColumn("exact_year", exact).withColumn("rank", F.row_number().over(best)).where("rank = 1").select("cit_id", "ref_id", "exact_year")


def best_paragraph(citations: DataFrame, docs: DataFrame, least: float = 0.4) -> DataFrame:
    """(cit_id, para_idx, score): the paragraph of its paper that contains most of a citation's tokens, the first on ties.

    Joined on the paper, then reduced at once by a maximum, so no paragraph text is shuffled twice.
    """
    paras = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "para")).select("doc_id", "para_idx", S.check_tokens(F.col("para")).alias("have"))
    wanted = citations.select("cit_id", "doc_id", S.check_tokens(F.col("text")).alias("want"))
    scored = wanted.join(paras, "doc_id").select("cit_id", "para_idx", F.round(S.contained(F.col("want"), F.col("have")), 6).alias("score"))
    best = scored.groupBy("cit_id").agg(F.max(F.struct("score", (-F.col("para_idx")).alias("back"))).alias("b"))
    return best.select("cit_id", (-F.col("b.back")).alias("para_idx"), F.col("b.score").alias("score")).where(F.col("score") >= least)


def repeated_citations(citations: DataFrame, above: float = 0.9) -> DataFrame:
    """(doc_id, a, b): citations of one paper whose token sets are more alike than `above`.

    Candidates share the paper and one of the first tokens in a common order that a pair so alike must share.
    """
    tokens = citations.select("cit_id", "doc_id", F.array_sort(S.check_tokens(F.col("text"))).alias("t")).where("size(t) > 0")
    prefix = tokens.select("doc_id", F.col("cit_id").alias("a"), "t", F.explode(F.expr("slice(t, 1, size(t) - cast(ceil(size(t) * 0.9) AS int) + 1)")).alias("token"))
    other = prefix.select("doc_id", F.col("a").alias("b"), F.col("t").alias("u"), "token")
    pairs = prefix.join(other, ["doc_id", "token"]).where("a < b AND size(t) * 0.9 <= size(u) AND size(u) * 0.9 <= size(t)")
    return pairs.where(S.jaccard(F.col("t"), F.col("u")) > above).select("doc_id", "a", "b").distinct()


def cached_works(refs: DataFrame, cache: DataFrame) -> DataFrame:
    """(ref_id, work_id, via): the cached work under a reference's DOI, else under its title hash.

    Missing DOIs and blank titles are no keys: they are null, so the rows without one meet in no task.
    """
    doi, title = F.nullif(T.normalize_doi(F.col("doi")), F.lit("")).alias("k"), F.when(T.normalize_title(F.col("title")) != "", T.title_hash(F.col("title"))).alias("h")
    d = cache.select(doi, "work_id").where("k IS NOT NULL").groupBy("k").agg(F.min("work_id").alias("by_doi"))
    t = cache.select(title, "work_id").where("h IS NOT NULL").groupBy("h").agg(F.min("work_id").alias("by_title"))
    keyed = refs.select("ref_id", doi, title)
    found = _left(_left(keyed, d, "k"), t, "h")
    return found.select("ref_id", F.coalesce("by_doi", "by_title").alias("work_id"), F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_title").isNotNull(), "title").otherwise("miss").alias("via"))


def _left(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """A left join whose rows without a key are not shuffled to one place."""
    added = [F.lit(None).cast(kind).alias(c) for c, kind in other.dtypes if c != key]
    return rows.where(F.col(key).isNotNull()).join(other, key, "left").unionByName(rows.where(F.col(key).isNull()).select("*", *added))
