"""The reference section of a paper, and its entries, as windows over lines.

A text becomes a row per line; where an entry starts is a flag, the number of starts so far is the
entry, and what goes on from the entry before is decided over rows of entries in the same way. Lines
of one paper meet in one window, which is sorted by the shuffle and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions import text as T

# Headings of a reference section, by style.
HEADINGS = {"apa": r"references?|reference list|reference section", "mla": r"works cited|work cited|works consulted|sources|bibliography"}
# How an entry starts, by style; an entry without an author may start with its quoted title in mla.
STARTS = {
    "apa": r"^(?:\d+[.)]?\s+)?[\p{Lu}\[\x{3400}-\x{9FFF}].{0,80}?[.,]?\s*\(?(?:(?:19|20)\d{2}|n\.d\.)\)?[.,\s]",
    "mla": r"^(?:\d+[.)]\s+)?[A-Z][a-z]+(?:['-][A-Z][a-z]+)?\s*,\s*[A-Z][a-z]+(?:\s+[A-Z]\.)?[.,]\s+(?!\(\d{4}[a-z]?\)|\(n\.d\.\))",
}
QUOTED = r"^(?:\d+[.)]\s+)?[\x{201C}\"]"
# Lines that never start an entry.
GOES_ON = r"(?i)^(?:\[online\]|retrieved\s|journal,\s*\d+\s*\(\d+\))"
ADDRESS = r"^<?https?://"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    split = F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\n")
    return docs.select(id_col, F.posexplode(F.transform(split, lambda x: F.trim(x))).alias("line_no", "line"))


def section_lines(docs: DataFrame, style: str, id_col: str = "doc_id", text_col: str = "text", from_share: float = 0.3, within: int = 30, least: int = 2) -> DataFrame:
    """(id, line_no, line): the lines of the reference section of each text.

    After the first heading of the style; without one, from the first line in the last
    1 - `from_share` of the lines that starts an entry and has `least` starts in the `within` lines from it.
    Texts with neither give no rows.
    """
    lines = _lines(docs, id_col, text_col)
    every = Window.partitionBy(id_col)
    ahead = every.orderBy("line_no").rowsBetween(0, within - 1)
    heading = F.col("line").rlike(rf"(?i)^(?:<[^>]+>)*\s*(?:\d+(?:\.\d+)*\s*[.)]?\s*)?(?:{HEADINGS[style]})\s*(?:<[^>]+>)*\s*:?$")
    start = F.col("line").rlike(STARTS[style])
    marked = lines.withColumns({"heading": heading, "start": start, "n": F.count("*").over(every), "near": F.sum(start.cast("int")).over(ahead)})
    dense = F.col("start") & (F.col("near") >= least) & (F.col("line_no") >= F.floor(F.col("n") * from_share))
    first = F.coalesce(F.min(F.when(F.col("heading"), F.col("line_no") + 1)).over(every), F.min(F.when(dense, F.col("line_no"))).over(every))
    return marked.withColumn("first", first).where("line_no >= first").select(id_col, "line_no", "line")


def entries(lines: DataFrame, style: str, id_col: str = "doc_id") -> DataFrame:
    """(id, entry, body): the entries of reference sections given by their lines.

    A line that starts an entry, or follows a blank line, opens a block. Blocks that are addresses,
    that never start an entry, or (apa) go on in lower case after an open end, (mla) start neither
    with a name nor with a quoted title after an open end, belong to the entry before.
    """
    order = Window.partitionBy(id_col).orderBy("line_no")
    line = F.col("line")
    starts = line.rlike(STARTS[style]) & ~line.rlike(GOES_ON)
    if style == "mla":
        starts = starts | line.rlike(QUOTED)
    new = starts | (F.coalesce(F.lag("line").over(order), F.lit("")) == "")
    blocks = _joined(lines.withColumn("block", F.sum(F.when(new, 1).otherwise(0)).over(order)).where("line <> ''"), id_col, "block", "line_no", "line")
    blocks = blocks.withColumn("body", F.regexp_replace("body", r"^\d+[.)]\s*", "")).where("body <> ''")
    at = Window.partitionBy(id_col).orderBy("block")
    body, before = F.col("body"), F.coalesce(F.lag("body").over(at), F.lit(""))
    goes_on = body.rlike(GOES_ON) | body.rlike(ADDRESS) | body.rlike(r"^[\w/-]+/>\.?$")
    if style == "apa":
        goes_on = goes_on | body.rlike(r"^\p{Ll}") & ~before.rlike(r"[.?!)'\"]$")
    else:
        goes_on = goes_on | ~body.rlike(STARTS["mla"]) & ~body.rlike(QUOTED) & ~before.rlike(r"(?:\.|>|https?://\S+|pp?\.\s*\d+)$")
    own = F.sum(F.when(goes_on & (before != ""), 0).otherwise(1)).over(at)
    return _joined(blocks.withColumn("entry", own.cast("int")), id_col, "entry", "block", "body")


def _joined(rows: DataFrame, id_col: str, key: str, at: str, value: str) -> DataFrame:
    """(id, key, body): the values of each key in order, with single blanks."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]), " ")
    return rows.groupBy(id_col, key).agg(T.squeeze(whole).alias("body"))


def numbered(raw: Column) -> Column:
    """The entries of a list that is one run of text with numbers before each: array of strings, without the numbers."""
    return F.filter(F.transform(F.split(raw, r"(?:^|\s)\d{1,3}[.)]\s+(?=\p{Lu})"), lambda x: F.trim(x)), lambda x: x != "")
