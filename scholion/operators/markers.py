"""In-text citations found in running text and tied to the paper's references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions import similarity as S
from scholion.functions import text as T
from scholion.operators import link, parse

_NAME = r"[A-Z][A-Za-z'-]+"
# The forms of a marker and, for each, its whole, first and second group; verbs that tell of an author.
PAREN = rf"\(({_NAME}(?:\s+(?:&|and)\s+{_NAME}|\s+et\s+al\.?)?),\s*(\d{{4}}[a-z]?)(?:,\s*(?:p|pp)\.\s*\d+(?:-\d+)?)?(?:;\s*{_NAME},[^)]+)?\)"
NARRATIVE = rf"({_NAME}(?:\s+(?:&|and)\s+{_NAME}|\s+et\s+al\.?)?)\s*\((\d{{4}}[a-z]?)\)"
PAGE = rf"\(({_NAME})(?:\s+(\d{{1,4}}(?:-\d+)?))?\)"
VERBS = "argues|notes|writes|states|claims|suggests|observes|asserts|contends|maintains|believes|points out|points to|explains|describes|discusses|finds|concludes|reports|shows|demonstrates"
TELLING = rf"({_NAME})(?:\s+{_NAME})?\s+({VERBS})\b"
SECOND_HAND = rf"\(({_NAME}),\s*\d{{4}},\s*as\s+cited\s+in\s+({_NAME}),\s*\d{{4}}\)"


def _found(text: Column, pattern: str, kind: str, name_group: int = 1) -> Column:
    """Array of (marker, kind, surname, detail, original) of a pattern's matches."""
    group = lambda m, n: F.regexp_extract(m, pattern, n)
    second = kind == "secondary"
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.struct(
            m.alias("marker"), F.lit(kind).alias("kind"), F.lower(F.regexp_extract(group(m, name_group), rf"^({_NAME})", 1)).alias("surname"),
            (F.lit("") if second or pattern == TELLING else F.coalesce(group(m, 2), F.lit(""))).alias("detail"), (group(m, 1) if second else F.lit("")).alias("original"),
        ),
    )


def marked_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", style_col: str = "citation_style") -> DataFrame:
    """(id, para_idx, sent_idx, sentence, marker, kind, surname, detail, original): every marker with the sentence that it stands in.

    detail is the year (apa) or the page (mla); a style that is neither counts as apa. Each marker of
    a sentence counts once.
    """
    mla = F.lower(F.trim(F.col(style_col))).eqNullSafe(F.lit("mla"))
    sentences = parse.sentence_rows(docs.where(F.col(text_col).isNotNull()).select(id_col, text_col), id_col, text_col)
    s = F.col("sentence")
    both = _found(s, SECOND_HAND, "secondary", 2)
    apa = F.concat(both, _found(s, PAREN, "parenthetical"), _found(s, NARRATIVE, "narrative"))
    page = F.concat(both, _found(s, PAGE, "parenthetical"), _found(s, TELLING, "narrative"))
    styled = docs.select(id_col, mla.alias("mla"))
    with_marks = sentences.where(s.rlike(r"[A-Z]")).join(styled, id_col).withColumn("marks", F.array_distinct(F.when(F.col("mla"), page).otherwise(apa)))
    return with_marks.select(id_col, "para_idx", "sent_idx", "sentence", F.inline("marks"))


def citations(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, sent_idx, marker, kind, original, ref_id, citation_key, claim_type): the markers whose surname is in the paper's list.

    Of several references with that surname, those whose year has the marker's come first, then the first of the list.
    """
    found = marked_sentences(docs)
    index = link.surname_index(refs).join(refs.select("ref_id", "citation_key"), "ref_id")
    joined = found.join(index, ["doc_id", "surname"])
    exact = (F.col("detail") != "") & F.coalesce(F.instr(F.col("year"), F.col("detail")) > 0, F.lit(False))
    best = Window.partitionBy("doc_id", "para_idx", "sent_idx", "kind", "marker").orderBy(F.desc("exact"), "ref_idx", "ref_id")
    first = joined.withColumn("exact", exact).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return first.select("doc_id", "para_idx", "sent_idx", "marker", "kind", "original", "ref_id", "citation_key", T.claim_type(F.col("sentence")).alias("claim_type"))


def passages(cits: DataFrame, docs: DataFrame, least: float = 0.4) -> DataFrame:
    """(cit_id, para_idx, first_sentence, n_sentences, score): the run of sentences that has most of a citation's tokens.

    The best paragraph comes first (`link.best_paragraph`); in it, runs of at most one sentence more
    than the citation has are compared, and shorter and earlier ones win ties. Where no run reaches
    `least` the whole paragraph stands (first_sentence 0).
    """
    best = link.best_paragraph(cits, docs, least).select("cit_id", "para_idx", F.col("score").alias("para_score"))
    paras = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "para"))
    want = cits.select("cit_id", "doc_id", S.check_tokens(F.col("text")).alias("want"), F.size(T.sentences(F.col("text"))).alias("own"))
    rows = best.join(want, "cit_id").join(paras, ["doc_id", "para_idx"]).withColumn("have", F.transform(T.sentences(F.col("para")), S.check_tokens)).where("size(have) > 0")
    runs = """flatten(transform(sequence(1, least(size(have), greatest(own, 1) + 1)), n -> transform(sequence(1, size(have) - n + 1),
      i -> struct(round(size(array_intersect(want, flatten(slice(have, i, n)))) / size(want), 6) AS score, -n AS n, -i AS i))))"""
    found = rows.select("cit_id", "para_idx", "para_score", F.array_max(F.expr(runs)).alias("r"))
    good = F.col("r.score") >= least
    return found.select(
        "cit_id", "para_idx", F.when(good, -F.col("r.i")).otherwise(0).alias("first_sentence"), F.when(good, -F.col("r.n")).otherwise(0).alias("n_sentences"),
        F.when(good, F.col("r.score")).otherwise(F.col("para_score")).alias("score"),
    )


def reattributed(cits: DataFrame, refs: DataFrame) -> DataFrame:
    """(cit_id, new_key): for citations whose key no reference of the paper has, the key of the one reference whose surname stands in the text.

    No key where several surnames or several references fit.
    """
    lost = cits.where("text IS NOT NULL").join(refs.select("doc_id", "citation_key"), ["doc_id", "citation_key"], "left_anti").select("cit_id", "doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}'-]+"))).alias("surname"))
    index = link.surname_index(refs).join(refs.select("ref_id", "citation_key"), "ref_id").select("doc_id", "surname", "citation_key").distinct()
    return lost.join(index, ["doc_id", "surname"]).groupBy("cit_id").agg(F.count("*").alias("n"), F.min("citation_key").alias("new_key")).where("n = 1 AND new_key <> ''").select("cit_id", "new_key")
