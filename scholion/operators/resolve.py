"""Which attempt gives a reference its source: the order of stages over a table of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.functions import sources as P

#: Stages in order; within `search`, sources by their rank.
STAGES = ("cache", "url", "search")


def resolved(refs: DataFrame, attempts: DataFrame) -> DataFrame:
    """(ref_id, outcome, source): outcome is archive, full_text, abstract or none.

    refs: ref_id, raw_ref, doi, year. attempts: ref_id, stage (STAGES), source, rank, has_text,
    has_abstract. A holding of an archive is never tried; film, records and the like skip `search`;
    sources of old works skip references younger than the public domain, and come first in `search`
    for older ones without a DOI. The first full text wins, else the first abstract.
    """
    year = F.regexp_extract("year", r"(\d{4})", 1).try_cast("int")
    about = refs.select("ref_id", P.route(F.col("raw_ref")).alias("route"), (F.coalesce("doi", F.lit("")) == "").alias("no_doi"), year.alias("y"))
    old = F.col("source").isin(*P.OLD_SOURCES)
    usable = ~((F.col("stage") == "search") & ((F.col("route") == "media") | old & F.coalesce(F.col("y") > P.PUBLIC_DOMAIN, F.lit(False))))
    stage = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    early = F.when(old & F.col("no_doi") & F.coalesce(F.col("y") <= P.PUBLIC_DOMAIN, F.lit(False)), 0).otherwise(1)
    order = F.struct(F.when(F.col("has_text"), 0).otherwise(1), stage, early, "rank", "source")
    best = (
        attempts.where("has_text OR has_abstract").join(about.where("route <> 'archive'"), "ref_id").where(usable)
        .groupBy("ref_id").agg(F.min_by(F.struct("source", "has_text"), order).alias("b"))
    )
    outcome = F.when(F.col("route") == "archive", "archive").when(F.col("b").isNull(), "none").when(F.col("b.has_text"), "full_text").otherwise("abstract")
    return about.join(best, "ref_id", "left").select("ref_id", outcome.alias("outcome"), F.coalesce("b.source", F.lit("")).alias("source"))
