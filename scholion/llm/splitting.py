"""Problem 5: splitting oversized items at natural boundaries, by ranges with halos.

An item is an interval of positions (pages of a chapter, bytes of a file) that is never loaded as a
whole. The axis is cut into ranges of a fixed width. Each range, with the boundaries of a halo behind
it, computes where every possible piece start in it leads. A later start never leads to an earlier
place, so starts that lead to one place are neighbours and the table is kept as runs of them; these
small tables are stitched along the item (start of each range, prefix sum of pieces), and each range
then emits its own pieces. Boundaries of files are found by workers that read byte ranges with halos.

A piece that starts at `a` ends before the last boundary `c` with a + overlap < c <= a + max_size,
or before a + max_size where there is none, and the next piece starts at c - overlap.

Defined results: an item that fits its limit gives one piece; null or reversed bounds give none;
boundaries outside the item, null or repeated are ignored; an overlap of max_size or more counts as
max_size - 1; empty tables give no rows; columns beside those named are ignored.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.runtime import cut

#: Positions in one range; it must be at least the largest max_size in use, and is raised to it where it is not.
RANGE = 1024


def chapter_bounds(chapters: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per chapter: book_id, chapter_no, lo, hi (inclusive), max_size, overlap_size.

    Redelivered chapters count once (the latest). A null page_end becomes the page before the
    book's next chapter, or logical_pages for the last.
    """
    latest = chapters.groupBy("chapter_id").agg(
        F.max_by(F.struct("book_id", "chapter_no", "page_start", "page_end", "logical_pages", "limit_name"), F.struct("parsed_at", "page_start", "page_end")).alias("c")
    )
    rows = latest.select("c.*").where("book_id IS NOT NULL AND chapter_no IS NOT NULL")
    follow = rows.groupBy("book_id", (F.col("chapter_no") - 1).alias("chapter_no")).agg(F.min("page_start").alias("next_start"), F.lit(True).alias("has_next"))
    end = F.coalesce("page_end", F.when(F.col("has_next"), F.col("next_start") - 1).otherwise(F.col("logical_pages")))
    pages = limits.where("size_unit = 'pages' AND max_size > 0").select("limit_name", "max_size", F.least(F.greatest("overlap_size", F.lit(0)), F.col("max_size") - 1).alias("overlap_size"))
    return (
        rows.join(follow, ["book_id", "chapter_no"], "left")
        .join(pages, F.lower(F.trim(rows["limit_name"])) == pages["limit_name"])
        .select("book_id", "chapter_no", F.col("page_start").alias("lo"), end.alias("hi"), "max_size", "overlap_size")
        .where("lo IS NOT NULL AND hi >= lo")
    )


def oversized(bounds: DataFrame) -> DataFrame:
    """The bounds of the items that are longer than their limit."""
    return bounds.where("hi - lo + 1 > max_size")


def next_start(a: int, hi: int, size: int, overlap: int, marks: list[int]) -> tuple[int, bool]:
    """(cut after the piece that starts at a, whether a boundary lies there) by rising marks; the cut is hi + 1 at the end."""
    if a + size > hi:
        return hi + 1, False
    k = bisect_right(marks, a + size) - 1
    return (marks[k], True) if k >= 0 and marks[k] > a + overlap else (a + size, False)


def split(items: DataFrame, marks: DataFrame, axis: str, keys: list[str], width: int = RANGE) -> DataFrame:
    """(*keys, piece, lo, hi, at_boundary): the pieces of `items` (keys, lo, hi, max_size, overlap_size).

    `marks` has the columns `axis` (a key shared with items) and `at`, the position where a boundary starts.
    """
    widest = items.agg(F.max("max_size")).first()[0] or 0
    width = max(width, widest)
    block = lambda c: F.expr(f"({c}) div {width}")
    spread = items.select(*keys, "lo", "hi", "max_size", "overlap_size", F.explode(F.sequence(block("lo"), block("hi"))).alias("block"))
    near = marks.where("at IS NOT NULL").select(F.col(axis), "at", F.explode(F.sequence(block("at") - 1, block("at"))).alias("block")).distinct()
    ranges = cut(
        spread.join(near, [axis, "block"], "left")
        .groupBy(*keys, "lo", "hi", "max_size", "overlap_size", "block")
        .agg(F.collect_set(F.when(F.expr("at > lo AND at <= hi AND at <= (block + 1) * %d + max_size" % width), F.col("at"))).alias("marks"))
    )
    fields = ", ".join(f"`{k}` {kind}" for k, kind in ranges.dtypes if k in keys)

    def lead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tables = []
            for lo, hi, size, overlap, b, at in zip(f.lo, f.hi, f.max_size, f.overlap_size, f.block, f.marks):
                first, end, known, seen = max(lo, b * width), (b + 1) * width, sorted(at), {}
                for entry in range(first, min(hi, end - 1, first + size) + 1):
                    path, a = [], entry
                    while a not in seen:  # paths of different entries soon meet at a boundary
                        c, _ = next_start(a, hi, size, overlap, known)
                        to = c - overlap if c <= hi else hi + 1
                        path.append(a)
                        if to >= end or to > hi:
                            seen[a] = (to, 1)
                            path.pop()
                            break
                        a = to
                    for a, after in zip(reversed(path), [a, *reversed(path)]):
                        seen[a] = (seen[after][0], seen[after][1] + 1)
                # Runs of entries with one exit and one number of pieces.
                runs = []
                for a in range(first, min(hi, end - 1, first + size) + 1):
                    if not runs or runs[-1][1:] != seen[a]:
                        runs.append((a, *seen[a]))
                tables.append(tuple([int(r[k]) for r in runs] for k in range(3)))
            yield f[keys].assign(block=f.block, lo=f.lo, starts=[t[0] for t in tables], exits=[t[1] for t in tables], pieces=[t[2] for t in tables])

    tables = ranges.mapInPandas(lead, f"{fields}, block bigint, lo bigint, starts array<bigint>, exits array<bigint>, pieces array<bigint>")
    # The stitch sees the runs of each range, never the item.
    stitched = tables.groupBy(*keys).agg(F.min("lo").alias("lo"), F.array_sort(F.collect_list(F.struct("block", "starts", "exits", "pieces"))).alias("t"))

    def stitch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, (at, rows) in enumerate(zip(f.lo, f.t)):
                n = 0
                for r in rows:
                    starts = r["starts"]
                    if len(starts) and starts[0] <= at < (r["block"] + 1) * width:
                        k = bisect_right(starts, at) - 1
                        out.append((i, r["block"], at, n))
                        at, n = r["exits"][k], n + r["pieces"][k]
            which, block, entry, before = zip(*out) if out else ([],) * 4
            yield f[keys].iloc[list(which)].reset_index(drop=True).assign(block=list(block), entry=list(entry), before=list(before))

    entries = stitched.mapInPandas(stitch, f"{fields}, block bigint, entry bigint, before bigint")

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, (hi, size, overlap, b, at, a, n) in enumerate(zip(f.hi, f.max_size, f.overlap_size, f.block, f.marks, f.entry, f.before)):
                known = sorted(at)
                while a <= hi and a < (b + 1) * width:
                    c, kept = next_start(a, hi, size, overlap, known)
                    out.append((i, n, a, min(c - 1, hi), kept))
                    n, a = n + 1, (c - overlap if c <= hi else hi + 1)
            which, piece, lo, hi, kept = zip(*out) if out else ([],) * 5
            yield f[keys].iloc[list(which)].reset_index(drop=True).assign(piece=list(piece), lo=list(lo), hi=list(hi), at_boundary=list(kept))

    return ranges.join(entries, [*keys, "block"]).mapInPandas(emit, f"{fields}, piece bigint, lo bigint, hi bigint, at_boundary boolean")


def file_boundaries(files: DataFrame, pattern: bytes = rb"\n\s*\n", width: int = 1 << 26, halo: int = 1 << 12) -> DataFrame:
    """(path, at): the byte offsets after each match of `pattern` in the files of `files` (path, length).

    Every worker reads its byte ranges with a halo behind, so a match that crosses a range's end is
    found once, by the range in which it starts; no match may be longer than the halo. Paths are of a
    file system that all workers mount.
    """
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(width).cast("bigint"))).alias("start"))
    ranges = ranges.repartition("path", "start")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = re.compile(pattern)
        for f in frames:
            for path, start in zip(f.path, f.start):
                with open(re.sub("^file:/*", "/", path), "rb") as g:
                    g.seek(max(start - halo, 0))
                    ahead = start - g.tell()  # what a match before this range uses up is not matched again
                    raw = g.read(ahead + width + halo)
                at = [m.end() - ahead + start for m in found.finditer(raw) if 0 <= m.start() - ahead < width]
                yield pd.DataFrame({"path": path, "at": at})

    return ranges.mapInPandas(run, "path string, at bigint")


def split_files(files: DataFrame, max_size: int, overlap: int = 0, pattern: bytes = rb"\n\s*\n", width: int = 1 << 26) -> DataFrame:
    """(path, piece, lo, hi, at_boundary): byte ranges (inclusive) of the pieces of files given as (path, length).

    A piece without a boundary in it is cut at `max_size` bytes, wherever that is. Empty files give none.
    """
    items = files.where("length > 0").select("path", F.lit(0).cast("bigint").alias("lo"), (F.col("length") - 1).alias("hi"), F.lit(max_size).alias("max_size"), F.lit(max(0, min(overlap, max_size - 1))).alias("overlap_size"))
    return split(items, file_boundaries(files, pattern, width), "path", ["path"], width)


def read_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces with their bytes, each read by its offset."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            body = []
            for path, lo, hi in zip(f.path, f.lo, f.hi):
                with open(re.sub("^file:/*", "/", path), "rb") as g:
                    g.seek(lo)
                    body.append(g.read(hi - lo + 1))
            yield f.assign(body=body)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes)
    return pieces.mapInPandas(run, schema + ", body binary")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files of a folder, read from the listing alone."""
    return spark.read.format("binaryFile").load(os.path.join(folder, "*")).select("path", "length")


def split_chapters(chapters: DataFrame, toc: DataFrame, limits: DataFrame) -> DataFrame:
    """(book_id, chapter_no, piece, page_start, page_end, at_section) for every chapter with usable bounds."""
    bounds = chapter_bounds(chapters, limits)
    sections = toc.where("toc_level >= 2 AND start_page > 0").select("book_id", F.col("start_page").alias("at"))
    pieces = split(bounds, sections, "book_id", ["book_id", "chapter_no"])
    pages = [F.col(c).cast("int").alias(n) for c, n in (("piece", "piece"), ("lo", "page_start"), ("hi", "page_end"))]
    return pieces.select("book_id", "chapter_no", *pages, F.col("at_boundary").alias("at_section"))
