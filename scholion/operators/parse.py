"""One text to many rows, and reference strings to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions import text as T


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, para_idx, sent_idx, sentence); paragraphs without a sentence are not counted."""
    paras = docs.select(id_col, F.posexplode(T.paragraphs(F.col(text_col))).alias("para_idx", "para"))
    return paras.select(id_col, "para_idx", F.posexplode(T.sentences(F.col("para"))).alias("sent_idx", "sentence"))


def line_blocks(docs: DataFrame, starts: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, body): lines merged to blocks; one begins where `starts` (over column line) holds or after a blank line."""
    lines = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\n")).alias("line_no", "line"))
    order = Window.partitionBy(id_col).orderBy("line_no")
    new = starts | (F.lag(F.trim("line")).over(order) == "") | F.lag("line").over(order).isNull()
    marked = lines.withColumn("block", F.sum(F.when(new, 1).otherwise(0)).over(order)).where(F.trim("line") != "")
    return marked.groupBy(id_col, "block").agg(T.squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")).alias("body"))


def dense_starts(docs: DataFrame, starts: Column, within: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_line): the first starting line from 30 % of the lines on with `least` starts in the next `within` lines."""
    lines = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\n")).alias("line_no", "line")).withColumn("starts", F.when(starts, 1).otherwise(0))
    ahead = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(0, within - 1)
    total = F.count("*").over(Window.partitionBy(id_col))
    seen = lines.withColumns({"near": F.sum("starts").over(ahead), "n": total})
    return seen.where((F.col("starts") == 1) & (F.col("near") >= least) & (F.col("line_no") >= F.floor(F.col("n") * 0.3))).groupBy(id_col).agg(F.min("line_no").alias("first_line"))


def reference_format(raw: Column) -> Column:
    """mla where a quoted title is followed by volume or page marks, else apa, which is the default."""
    return F.when(raw.rlike(r"\x{201C}.+\x{201D}.*(vol\.|pp?\.)"), "mla").otherwise("apa")


def identifiers(raw: Column) -> tuple[Column, Column]:
    """(doi, url): the DOI where there is one, and only else the URL."""
    doi = T.first_doi(raw)
    return doi, F.when(doi != "", F.lit("")).otherwise(T.first_url(raw))


def apa_fields(raw: Column) -> dict[str, Column]:
    """author, year, title, doi, url, method and needs_review of `Author (year). Title. Source`.

    Without a year in brackets the first year anywhere counts, but tells no title. The title ends at
    a full stop before a capital, or at an address, and before `, 12(`. Without an author or a title
    the fields are '' and the record needs review; a missing year is n.d.
    """
    raw = F.trim(F.coalesce(raw, F.lit("")))
    head = r"^(.*?)(\((?:(?:19|20)\d{2}[a-z]?|n\.d\.)\))(.*)$"
    marked = raw.rlike(rf"(?is){head}")
    bare = F.regexp_extract(raw, r"(?s)^(.*?)\b((?:19|20)\d{2})\b", 2)
    year = F.when(marked, F.coalesce(F.nullif(F.regexp_extract(F.regexp_extract(raw, rf"(?is){head}", 2), r"(\d{4})", 1), F.lit("")), F.lit("n.d."))).otherwise(bare)
    before = F.when(marked, F.regexp_extract(raw, rf"(?is){head}", 1)).otherwise(F.regexp_extract(raw, r"(?s)^(.*?)\b((?:19|20)\d{2})\b", 1))
    author = F.regexp_replace(F.regexp_replace(F.trim(before), r"[,.;:]+$", ""), r"^\d+[.)]\s*", "")
    after = F.regexp_replace(F.regexp_extract(raw, rf"(?is){head}", 3), r"^[\s.)]+", "")
    ends = F.regexp_extract(after, r"(?s)^(.+?)\.\s+[A-Z]", 1)
    rest = F.regexp_replace(F.trim(F.regexp_replace(after, r"(?s)\s+(?:https?://|doi:).*$", "")), r"\.+$", "")
    title = F.trim(F.regexp_replace(F.when(ends != "", ends).otherwise(rest), r"(?s)\s*,\s*\d+\(.*$", ""))
    return _checked(raw, author, year, F.when(marked, title).otherwise(F.lit("")))


def mla_fields(raw: Column) -> dict[str, Column]:
    """The same fields of `Author. “Title.” Source, year`: the last year, the quoted title, else the text up to the next full stop."""
    raw = F.trim(F.coalesce(raw, F.lit("")))
    bare = F.regexp_replace(raw, r"^\d+[.)]\s*", "")
    years = F.regexp_extract_all(raw, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    ends = F.regexp_extract(bare, r"^(.{2,200}?)\.\s+[A-Z\x{201C}\"]", 1)
    author = F.trim(F.when(ends != "", ends).otherwise(F.regexp_extract(bare, r"(?s)^(.+?)\. ", 1)))
    quoted = F.trim(F.regexp_extract(bare, r"(?s)(?:\x{201C}([^\"]+?)\x{201D}|\"[^\"]+?\")", 1))
    straight = F.trim(F.regexp_extract(bare, r"(?s)\"([^\"]+?)\"", 1))
    after = F.regexp_replace(F.substr(bare, F.char_length(author) + 1), r"^[. ]+", "")
    next_stop = F.regexp_extract(after, r"(?s)^(.+?)\.\s+(?:[A-Z\d]|https?://)", 1)
    plain = F.trim(F.when(next_stop != "", next_stop).otherwise(F.substring_index(after, ".", 1)))
    title = F.when(quoted != "", quoted).when(straight != "", straight).when(author != "", plain).otherwise(F.lit(""))
    return _checked(raw, author, F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit("")), title)


def _checked(raw: Column, author: Column, year: Column, title: Column) -> dict[str, Column]:
    ok = (author != "") & (title != "")
    doi, url = identifiers(raw)
    kept = lambda c: F.when(ok, c).otherwise(F.lit(""))
    return {"author": kept(author), "year": F.when(ok, F.coalesce(F.nullif(year, F.lit("")), F.lit("n.d."))).otherwise(F.lit("")), "title": kept(title), "doi": doi, "url": url, "method": F.when(ok, "regex").otherwise("fallback"), "needs_review": ~ok}


def labelled_fields(response: Column, labels: tuple[str, ...]) -> dict[str, Column]:
    """The values of `label: value` lines; none, n/a and null count as ''."""
    value = lambda x: F.trim(F.regexp_extract(response, rf"(?im)^{x}:[ \t]*(.*)$", 1))
    return {x: F.when(F.lower(value(x)).isin("none", "n/a", "null"), F.lit("")).otherwise(value(x)) for x in labels}


def cite_tags(text: Column) -> Column:
    """Array of (key, body) of all <cite key="...">...</cite> tags."""
    pattern = r"(?is)<cite\b[^>]*key=\"([^\"]*)\"[^>]*>(.*?)</cite\s*>"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("body"))


def chapter_ranges(toc: DataFrame) -> DataFrame:
    """(book_id, pos, title, page_start, page_end) of the numbered top entries; each ends before the next, the last at the book's end."""
    rows = toc.where("toc_level = 1 AND start_page > 0").where(F.col("title").rlike(r"^\d{1,3}[.)]?\s")).select("book_id", "pos", "title", "start_page", "logical_pages").distinct()
    order = Window.partitionBy("book_id").orderBy("pos", "start_page", "title")
    end = F.coalesce(F.lead("start_page").over(order) - 1, F.col("logical_pages"))
    return rows.select("book_id", "pos", "title", F.col("start_page").alias("page_start"), F.greatest(F.col("start_page"), end).alias("page_end"))
