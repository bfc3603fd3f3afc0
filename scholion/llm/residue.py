"""Problem 3: template residue, filler and error-page text, by SimHash tables and label propagation.

Every distinct title is levelled (entities, blanks, case, numbers) and split at the separators that
sites put between a page's name and their own. A part whose removal leaves the cited title is a
site's name, and what is left beside one is the title's core; where neither of two short parts is
known, each of them may be. Distinct cores are the nodes of a graph: a 64-bit SimHash of the
character trigrams is cut into blocks, tables keyed by combinations of blocks give every pair within
HAMMING bits, and as short titles move by more bits than that at the least similarity, pairs of a
core's rarest trigrams are keys as well (an exact prefix filter). Pairs are verified by Hamming
distance and trigram similarity.

Trusted labels: residue are a few known phrases (SEEDS), and cores and frames (first and last words)
that stand on so many hosts without once agreeing with the cited title that chance is ruled out;
content are titles that agree with the cited one. Residue labels spread through links, from
labelled cores to unlabelled ones, round by round, so only what they reach is compared with all
cores; content stops them. In each connected component the more frequent label wins. A title with
an unfilled slot anywhere is residue by itself.

Defined results: null, empty and blank titles are no cases; repeated rows and equal titles count
once in every step before the last join, so a common title is no hot group; ties in a component go
to content; a title that agrees with its cited title is no case unless it has a slot; a site's own
name is no case; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.graph import components
from scholion.runtime import cut

HAMMING = 6
SIMILARITY = 0.8
#: Words that a part may have at most to count as a site's name where no title shows that it is one.
SITE_WORDS = 4
#: Blocks of the SimHash and blocks in a key, by the number of distinct cores they suit; all find HAMMING bits.
TABLES = ((1 << 18, 8, 2), (1 << 24, 9, 3), (1 << 62, 11, 5))
#: The probability that what never agrees with a cited title does so by chance; least titles of a frame.
CHANCE, FRAME_TITLES = 1e-6, 3
#: Slots of the table of trigram counts that orders trigrams, and bits of the filter of a round's keys.
GRAMS, KEY_BITS = 1 << 16, 1 << 22

_SLOT = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|\$\{.*?\}|\{\$.*?\}|<%.*?%>|\[\[.*?\]\]|%%\s*\w[\w .-]*%%|%[A-Za-z][A-Za-z0-9_.-]{2,}%|@@\w[\w .-]*@@|@\{.*?\}|#\{.*?\}|#[A-Za-z_]{3,}#|__[A-Za-z][A-Za-z0-9_]*__"
    r"|\{\d+\}|\{[A-Za-z_][\w.]*\}|<\?php.*|<\?=.*"
    r"|<(?:[\w .-]*\b(?:title|titel|name|heading|headline|article|journal|titre|título)\b[\w .-]*)>|\[(?:insert|your|add|enter)\b[^\]]*\]|\[[\w ]*\b(?:title|name|headline|heading|journal|here)\b[\w ]*\]|\bXXX+\b",
    re.I,
)
# A colon parts a site from a page only where the page comes last.
_SPLIT = re.compile(r"(\s+[|–—·»-]+\s+|:\s+|\s*::\s*|\s*\|\s*)")

# Trusted residue, numbers as 0; an ellipsis stands for any other words.
SEEDS = (
    "page not found", "not found", "0 not found", "error 0", "http status 0", "0 forbidden", "access denied", "0 internal server error", "0 bad gateway", "bad request", "service unavailable",
    "0 service unavailable", "0 gone", "error", "an error has occurred", "fehler 0", "erreur 0", "seite nicht gefunden", "page introuvable", "página no encontrada", "страница не найдена", "找不到页面",
    "… is down for maintenance", "under construction", "item unavailable", "too many requests", "database connection failed",
    "just a moment", "please wait", "loading", "redirecting", "object moved", "checking your browser …", "please enable javascript", "javascript is disabled", "javascript is required", "veuillez activer javascript",
    "bitte aktivieren sie javascript", "noscript",
    "untitled", "untitled-0", "untitled document", "sans titre", "new page", "neue seite", "sample page", "just another … site", "lorem ipsum", "lorem ipsum dolor", "null", "undefined", "[object object]", "test", "title",
)
_TRUSTED = re.compile("|".join(re.escape(x).replace("…", ".+") for x in SEEDS))


def level(title: str) -> str:
    """A title for comparison: entities resolved, blanks collapsed, lower case, numbers as 0."""
    t = html.unescape(html.unescape(title)) if "&" in title else title
    return re.sub(r"\d+", "0", " ".join(t.split()).lower().replace("’", "'"))


def parts(levelled: str) -> list[str]:
    """What separators part; a colon counts like the others."""
    return [p for p in _SPLIT.split(levelled)[::2] if p and p.strip(" .,-|")]


def has_slot(title: str) -> bool:
    """Whether a template slot was left unfilled anywhere in the title."""
    return bool(_SLOT.search(html.unescape(title)))


def trusted(levelled: str) -> bool:
    """Whether a levelled text is a known phrase."""
    return bool(_TRUSTED.fullmatch(levelled.strip(" .!…")))


def agrees(levelled: str, cited: str | None) -> bool:
    """Whether a title contains the cited one, letters and digits only."""
    return bool(cited) and len(cited) > 12 and re.sub(r"\W", "", level(cited)) in re.sub(r"\W", "", levelled)


def frames(levelled: str) -> list[str]:
    """The first and last words of a title that others may fill."""
    w = levelled.split()
    return [" ".join(w[:3]) + " …", "… " + " ".join(w[-3:]), f"{w[0]} {w[1]} … {w[-1]}"] if len(w) > 4 and len(parts(levelled)) == 1 else []


def trigrams(text: str) -> set[str]:
    t = f"  {text} "
    return {t[i : i + 3] for i in range(len(t) - 2)}


def gram_hashes(text: str) -> np.ndarray:
    """The distinct character trigrams of a text as 64-bit hashes."""
    x = np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (x[:-2] << np.uint64(42)) ^ (x[1:-1] << np.uint64(21)) ^ x[2:]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9))


_BITS = np.arange(64, dtype=np.uint64)


def simhash(grams: np.ndarray) -> int:
    """64-bit SimHash of hashed trigrams."""
    ones = ((grams ^ grams >> np.uint64(31))[:, None] >> _BITS & np.uint64(1)).sum(axis=0)
    return int(np.packbits(ones * 2 > len(grams), bitorder="little").view(np.uint64)[0])


def block_keys(value: int, blocks: int, choose: int) -> list[int]:
    """A key for each combination of blocks: two values within blocks - choose bits share at least one."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    piece = [value >> lo & (1 << hi - lo) - 1 for lo, hi in zip(edges, edges[1:])]
    return [hash((n, *(piece[i] for i in which))) for n, which in enumerate(combinations(range(blocks), choose))]


def prefix_keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys of which two texts of trigram similarity SIMILARITY share at least one, whatever the counts.

    In one order of all trigrams (rare ones first) such texts share two of their first
    n - ceil(SIMILARITY * n) + 2; pairs of those are the keys.
    """
    n = len(grams)
    first = grams[np.lexsort((grams, counts[grams % np.uint64(GRAMS)]))][: n - math.ceil(SIMILARITY * n - 1e-9) + 2]
    i, j = np.triu_indices(len(first), 1)
    return ((first[i] * np.uint64(3) ^ first[j]) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def keyed(cores: DataFrame) -> DataFrame:
    """(core, id, size, hash, tables, prefixes): the keys of distinct cores; one pass orders the trigrams, one makes keys."""
    n = cores.count()
    blocks, choose = next((b, c) for limit, b, c in TABLES if n <= limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                total[(gram_hashes(c) % np.uint64(GRAMS)).astype(np.int64)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    counts = np.zeros(GRAMS, np.int64)  # a table of fixed size
    for r in cores.select("core").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [gram_hashes(c) for c in batch.column(0).to_pylist()]
            hashes = [simhash(g) for g in grams]
            lists = [[block_keys(h, blocks, choose) for h in hashes], [prefix_keys(g, counts) for g in grams]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) for g in grams], pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
                names=["core", "size", "hash", "tables", "prefixes"],
            )

    return cut(cores.select("core").mapInArrow(run, "core string, size int, hash bigint, tables array<bigint>, prefixes array<bigint>").withColumn("id", F.xxhash64("core")))


def links(some: DataFrame, every: DataFrame) -> DataFrame:
    """(a, b): the pairs of a core of `some` and another of `every` (both as `keyed` gives them) with trigram similarity of at least SIMILARITY."""
    found = None
    for keys, near in (("tables", f"bit_count(hash ^ other_hash) <= {HAMMING}"), ("prefixes", "true")):
        one = some.select("id", "size", "hash", F.explode(keys).alias("key"))
        two = every.select(F.col("id").alias("other"), F.col("size").alias("other_size"), F.col("hash").alias("other_hash"), F.explode(keys).alias("key"))
        # Most keys are nobody's in `some`: a bitmap of fixed size, which never lies about absence, goes before the shuffle.
        bit = F.pmod(F.col("key"), F.lit(KEY_BITS))
        bits = one.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits"))
        two = two.withColumn("bit", bit).withColumn("word", F.expr("bit div 64")).join(F.broadcast(bits), "word").where("shiftrightunsigned(bits, cast(bit % 64 AS int)) & 1 = 1").drop("bit", "word", "bits")
        pairs = one.join(two, "key").where(f"id <> other AND size >= {SIMILARITY}D * other_size - 1e-9D AND other_size >= {SIMILARITY}D * size - 1e-9D AND {near}").select("id", "other")
        found = pairs if found is None else found.union(pairs)
    text = lambda df, i, c: df.select(F.col("id").alias(i), F.col("core").alias(c))
    wide = found.distinct().join(text(some, "id", "a"), "id").join(text(every, "other", "b"), "other").select("a", "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = trigrams(a), trigrams(b)
                keep.append(len(x & y) >= SIMILARITY * len(x | y))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return wide.mapInArrow(verified, "a string, b string")


def near_links(cores: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct cores (one column, core) with trigram similarity of at least SIMILARITY."""
    every = keyed(cores)
    return links(every, every).where("a < b")


def _judged(pairs: DataFrame) -> DataFrame:
    """(title, flat, parts, colon, slot, cited, good, site, rest, frames) of distinct (title, cited)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, c in zip(*(batch.column(k).to_pylist() for k in range(2))):
                flat = level(t)
                cut_up = parts(flat)
                good, site, rest = agrees(flat, c), None, None
                if good and len(cut_up) > 1:
                    for side in (0, -1):
                        others = cut_up[1:] if side == 0 else cut_up[:-1]
                        if agrees(" ".join(others), c):
                            site, rest = cut_up[side], " ".join(others)
                out.append((t, flat, cut_up, bool(re.search(r"\w: ", flat)), has_slot(t), bool(c) and len(c) > 12, good, site, rest, frames(flat)))
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
            names = ["title", "flat", "parts", "colon", "slot", "cited", "good", "site", "rest", "frames"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 10, kinds)], names=names)

    return pairs.mapInArrow(run, "title string, flat string, parts array<string>, colon boolean, slot boolean, cited boolean, good boolean, site string, rest string, frames array<string>")


def labelled(checks: DataFrame, id_col: str = "check_id", title_col: str = "page_title", cited_col: str = "cited_title", url_col: str = "url") -> DataFrame:
    """(id_col, title, how): the checks whose title is residue, each once; how: slot, or seed or evidence for labelled texts, or link."""
    host = F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^\w+://([^/?#]+)", 1)
    rows = checks.select(F.col(id_col).alias("_id"), F.col(title_col).alias("title"), F.col(cited_col).alias("cited"), host.alias("host")).where("trim(title) <> ''")
    judged = cut(_judged(rows.select("title", "cited").distinct()))
    sites = judged.where("site IS NOT NULL").select("site", "rest").distinct().groupBy("site").count().where("count > 1").select("site", F.lit(True).alias("known"))
    titles = judged.groupBy("title").agg(*[F.first(c).alias(c) for c in ("flat", "parts", "colon", "slot", "frames")], F.bool_or("good").alias("good"))
    share = judged.where("cited AND NOT slot").groupBy("title").agg(F.bool_or("good").cast("double").alias("good")).agg(F.avg("good")).first()[0] or 0.5
    least = math.ceil(math.log(CHANCE) / math.log(1 - min(max(share, 0.05), 0.95)))

    at = lambda c, n: titles_at.join(sites.withColumnsRenamed({"site": c, "known": n}), c, "left")
    titles_at = titles.withColumns({"opens": F.expr("parts[0]"), "ends": F.expr("parts[size(parts) - 1]")})
    titles_at = at("opens", "site_opens")
    titles_at = at("ends", "site_ends").withColumns({"o": F.coalesce("site_opens", F.lit(False)), "e": F.coalesce("site_ends", F.lit(False))})
    short = "size(split({0}, ' ')) <= %d" % SITE_WORDS
    options = f"""CASE WHEN size(parts) <> 2 THEN array(flat) WHEN o AND e THEN array() WHEN e THEN array(opens) WHEN o THEN array(ends)
     ELSE array_compact(array(flat, CASE WHEN {short.format('opens')} THEN ends END, CASE WHEN NOT colon AND {short.format('ends')} THEN opens END)) END"""
    # A title of sites' names only is a site's own.
    placed = cut(titles_at.withColumn("own", F.expr("o AND e")).withColumn("cores", F.expr(f"CASE WHEN own THEN array() ELSE {options} END")).select("title", "flat", "slot", "good", "cores", "frames"))

    # Only where a title could have agreed does it count that it did not.
    hosts = rows.where("length(cited) > 12").select("title", "host").distinct()
    whole = placed.where("NOT slot")

    def never(groups: DataFrame, key: str) -> DataFrame:
        """The keys that stand on `least` hosts and in no title that agrees with its cited one."""
        sure = groups.groupBy(key).agg(F.bool_or("good").alias("good"), F.countDistinct("host").alias("n"), F.countDistinct("title").alias("titles"))
        return sure.where(f"NOT good AND n >= {least}")

    spread = whole.join(hosts, "title")
    # What may or may not be a core is no evidence.
    evident = never(spread.where("size(cores) > 0").select("title", "good", "host", F.expr("cores[0]").alias("core")), "core").select("core")
    framed = never(spread.select("title", "good", "host", F.explode("frames").alias("frame")), "frame").where(f"titles >= {FRAME_TITLES}").select("frame")
    in_frame = whole.select("cores", F.explode("frames").alias("frame")).join(framed, "frame", "left_semi").select(F.explode("cores").alias("core"))
    evidence = evident.union(in_frame).distinct().withColumn("evidence", F.lit(True))
    cores = whole.select("title", "good", F.explode("cores").alias("core")).groupBy("core").agg(F.count_if("good").alias("for"), F.count_if(~F.col("good")).alias("against"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([trusted(c) for c in batch.column(0).to_pylist()], pa.bool_())], names=[*batch.schema.names, "seed"])

    nodes = cut(cores.mapInArrow(known, "core string, `for` bigint, against bigint, seed boolean").join(evidence, "core", "left").withColumn("evidence", F.coalesce("evidence", F.lit(False))))
    every = keyed(nodes)
    content = nodes.where("`for` > 0 AND NOT seed AND NOT evidence").select("core")
    reached = cut(nodes.where("seed OR evidence").select("core"))
    front, edges = reached, None
    while not front.isEmpty():
        new = cut(links(every.join(front, "core", "left_semi"), every))
        edges = new if edges is None else edges.union(new)
        front = cut(new.select(F.col("b").alias("core")).distinct().join(reached, "core", "left_anti").join(content, "core", "left_anti"))
        reached = reached.union(front)
    if edges is None:
        edges = every.sparkSession.createDataFrame([], "a string, b string")
    in_reach = nodes.join(reached.union(edges.select("b")).distinct(), "core", "left_semi")
    grouped = in_reach.join(components(edges), F.col("core") == F.col("id"), "left").withColumn("component", F.coalesce("component", "core"))
    verdict = grouped.groupBy("component").agg(F.sum(F.when(F.col("seed") | F.col("evidence"), F.col("against")).otherwise(0)).alias("bad"), F.sum("for").alias("good")).where("bad > good").select("component")
    residue = grouped.join(verdict, "component", "left_semi").select("core", F.when(F.col("seed"), "seed").when(F.col("evidence"), "evidence").otherwise("link").alias("how"))
    # What is no labelled text by itself has its label from the graph.
    of_title = F.when(F.col("flat") == F.col("core"), F.col("how")).otherwise(F.lit("link"))
    by_core = whole.where("NOT good").select("title", "flat", F.explode("cores").alias("core")).join(residue, "core").groupBy("title").agg(F.min(of_title).alias("how"))
    found = placed.where("slot").select("title", F.lit("slot").alias("how")).union(by_core)
    return rows.join(found, "title").select(F.col("_id").alias(id_col), "title", "how").distinct()


def find(checks: DataFrame, id_col: str = "check_id", title_col: str = "page_title", cited_col: str = "cited_title", url_col: str = "url") -> DataFrame:
    """(id_col): the checks whose title is residue, each once."""
    return labelled(checks, id_col, title_col, cited_col, url_col).select(id_col).distinct()
