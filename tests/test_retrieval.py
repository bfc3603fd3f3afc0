"""Sources, records, reference lists and citations in running text: small cases, retyped from how such inputs look."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from scholion.functions import records as R
from scholion.functions import similarity as S
from scholion.functions import sources as P
from scholion.functions import text as T
from scholion.operators import choose, link, markers, parse, reflist, resolve
from scholion.plans import sources, sources_sql
from tests.compare import canonical, oracle_rows

DATA = "/root/testdata/sf0.001"


def values(spark, texts, make, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[1] for r in df.select("i", make(F.col("t"))).orderBy("i").collect()]


def test_kinds_of_sources(spark):
    raw = ["Levinson, B. (Director). (1988). Rain Man [Film].", "Beatles. (1969). Abbey Road [Album].", "A talk [podcast episode].", "Letters, box 4, folder 12, Town Archives.", "An unpublished manuscript.", "Roe, A. (2001). Clay. Press.", None]
    assert values(spark, raw, P.route) == ["media", "media", "media", "archive", "archive", "scholarly", "scholarly"]


def test_private_addresses(spark):
    urls = ["http://127.0.0.1/x", "http://10.0.0.5", "http://169.254.169.254/latest", "http://[::1]/", "http://[::ffff:127.0.0.1]/", "file:///etc/passwd", "ftp://host.example", "http://localhost:8080", "http://", "https://93.184.216.34/", "http://[2606:4700::1111]/"]
    none = F.array().cast("array<string>")
    assert values(spark, urls, lambda c: P.fetch_verdict(c, none)) == ["private_literal"] * 5 + ["scheme", "scheme", "own_name", "no_host", "ok", "ok"]
    rows = spark.createDataFrame([(0, ["8.8.8.8"]), (1, ["8.8.8.8", "10.1.2.3"]), (2, ["fd00::1"]), (3, []), (4, None)], "i int, a array<string>")
    got = [r[0] for r in rows.orderBy("i").select(P.fetch_verdict(F.lit("https://host.example/a"), F.col("a"))).collect()]
    assert got == ["ok", "private_answer", "private_answer", "unresolved", "unresolved"]


def test_html_titles(spark):
    page = """<html><head><title lang="en"> Clay &amp; Fire | Site </title><meta property="og:title" content="Clay &#38; Fire"><meta name="citation_title" content="Clay &amp; Fire: a History"></head>"""
    assert values(spark, [page, "<title> </title>", ""], P.html_titles) == [["Clay & Fire: a History", "Clay & Fire", "Clay & Fire | Site"], [], []]
    assert values(spark, ["Clay and fire of Ulvhain", "12", None], lambda c: P.title_words_match(c, F.lit("Fire and clay"))) == [True, False, False]


def test_relevance_needs_title_and_author(spark):
    rows = [("Rain Man", "Homeostasis model: insulin in man", "Roe, A.", ["Roe, A."]), ("Great Expectations", "Great Expectations", "Dickens, C.", ["Charles Dickens"]), ("Great Expectations", "Great Expectations", "Dickens, C.", ["Jane Austen"]), ("Great Expectations", "Great Expectations", "Smith, J.", ["Smyth, J."]), ("Great Expectations", "Great Expectations", None, ["X Y"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string, d array<string>")
    names = F.flatten(F.transform("d", S.surnames))
    got = df.select("i", S.relevant(F.col("a"), F.col("b"), S.surnames(F.coalesce("c", F.lit(""))), names)).orderBy("i").collect()
    assert [r[1] for r in got] == [False, True, False, True, True]


def test_reference_fields(spark):
    apa = ["1. Roe, A., & Doe, B. (2020). Clay and fire. Journal of Clay, 12(3), 4-5. https://doi.org/10.5555/ab.1.", "Ministry. (n.d.). Rules", "Roe, A. 2019. Clay", "(2020). Nobody", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(apa)], "i int, t string")
    got = [tuple(r)[1:] for r in df.select("i", *[c.alias(k) for k, c in parse.apa_fields(F.col("t")).items()]).orderBy("i").collect()]
    assert got[0] == ("Roe, A., & Doe, B", "2020", "Clay and fire", "10.5555/ab.1", "", "regex", False)
    assert got[1] == ("Ministry", "n.d.", "Rules", "", "", "regex", False)
    assert [g[5:] for g in got[2:]] == [("fallback", True)] * 3
    mla = ["Roe, Ann. “Clay and Fire.” Journal of Clay, vol. 2, 1999, reprinted 2004, pp. 1-9.", "Doe, Bob. The Kiln Book. Clay Press, 1987.", "No full stop"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(mla)], "i int, t string")
    got = [tuple(r)[1:] for r in df.select("i", *[c.alias(k) for k, c in parse.mla_fields(F.col("t")).items()]).orderBy("i").collect()]
    assert got[0][:3] == ("Roe, Ann", "2004", "Clay and Fire.") and got[1][:3] == ("Doe, Bob", "1987", "The Kiln Book") and got[2][6]


def test_clean_text_joins_lines_inside_sentences(spark):
    got = values(spark, ["a\nb\nc", "one,\ntwo", "repre-\n sentation of\r\n  clay", "Clay.\nFire\n\n\n\nWater", "zero​width", None], T.clean_text)
    assert got == ["a b c", "one,\ntwo", "repre sentation of clay", "Clay.\nFire\n\nWater", "zerowidth", None]


APA = """Body text of a paper.

References
Doe, B. (2019). Fire and
water. Clay Press.
Roe, A. (2020). Clay. Journal of Clay,
12(3), 1-2.
Retrieved from https://a.example/clay
https://b.example/clay

3. Poe, E. (n.d.). Kilns
and what they hold"""
MLA = "Text.\nWorks Cited:\nRoe, Ann. Clay.\nPress, 1999.\n\n“Fire.” Clay Weekly,\n2004.\nDoe, Bob. Kilns. Press, 2001."


def test_reference_lists(spark):
    docs = spark.createDataFrame([(1, APA), (2, "No list here."), (3, None)], "doc_id long, text string")
    got = [r["body"] for r in reflist.entries(reflist.section_lines(docs, "apa"), "apa").orderBy("doc_id", "entry").collect()]
    assert got == ["Doe, B. (2019). Fire and water. Clay Press.", "Roe, A. (2020). Clay. Journal of Clay, 12(3), 1-2. Retrieved from https://a.example/clay https://b.example/clay", "Poe, E. (n.d.). Kilns and what they hold"]
    docs = spark.createDataFrame([(1, MLA)], "doc_id long, text string")
    got = [r["body"] for r in reflist.entries(reflist.section_lines(docs, "mla"), "mla").orderBy("entry").collect()]
    assert got == ["Roe, Ann. Clay. Press, 1999.", "“Fire.” Clay Weekly, 2004.", "Doe, Bob. Kilns. Press, 2001."]
    bare = "\n".join(["Some prose of the paper in a line."] * 6 + ["Doe, B. (2019). Fire. Press.", "Roe, A. (2020). Clay. Press."])
    lines = reflist.section_lines(spark.createDataFrame([(1, bare)], "doc_id long, text string"), "apa").collect()
    assert min(r["line_no"] for r in lines) == 6
    assert values(spark, ["1. Roe one. 2. Doe two. 3) Poe three."], reflist.numbered) == [["Roe one.", "Doe two.", "Poe three."]]


def test_citations_in_running_text(spark):
    docs = spark.createDataFrame([(1, "Clay lasts (Roe, 2020, p. 4). Doe et al. (2019) say “it burns well”. Water (Poe, 1999, as cited in Roe, 2020) runs. Nobody (Zed, 2001) knows.", "apa"), (2, "Roe argues that clay lasts. Fire burns (Doe 12).", "MLA"), (3, None, None)], "doc_id long, text string, citation_style string")
    refs = spark.createDataFrame([(i, d, i, a, y, a.split(",")[0] + y) for i, (d, a, y) in enumerate([(1, "Roe, A.", "2018"), (1, "Roe, B.", "2020"), (1, "Doe, C.", "2019"), (2, "Roe, A.", "2018"), (2, "Doe, C.", "2019")])], "ref_id long, doc_id long, ref_idx int, author string, year string, citation_key string")
    got = {(r["doc_id"], r["kind"], r["citation_key"], r["original"], r["claim_type"]) for r in markers.citations(docs, refs).collect()}
    assert got == {(1, "parenthetical", "Roe2020", "", "paraphrase"), (1, "narrative", "Doe2019", "", "quotation"), (1, "secondary", "Roe2018", "Poe", "paraphrase"), (2, "narrative", "Roe2018", "", "paraphrase"), (2, "parenthetical", "Doe2019", "", "paraphrase")}


def test_passages_are_runs_of_sentences(spark):
    docs = spark.createDataFrame([(1, "Rain fell on the town. Clay was fired in kilns. Kilns were hot and wide. People slept.\n\nOther things.")], "doc_id long, text string")
    cits = spark.createDataFrame([(1, 1, "clay fired in kilns; kilns hot"), (2, 1, "nothing of this kind"), (3, 1, "people slept")], "cit_id long, doc_id long, text string")
    got = {r["cit_id"]: (r["para_idx"], r["first_sentence"], r["n_sentences"]) for r in markers.passages(cits, docs).collect()}
    assert got[1] == (0, 2, 2) and got[3] == (0, 4, 1) and 2 not in got


def test_resolver_order(spark):
    refs = spark.createDataFrame([(1, "Roe (2001). Clay.", "10.5/a", "2001"), (2, "Letters, box 3, archive", "", "1900"), (3, "Rain Man [Film]", "", "1988"), (4, "Old poem", "", "1850"), (5, "New poem", "", "1990"), (6, "Lost", "", None)], "ref_id long, raw_ref string, doi string, year string")
    a = [(1, "search", "core", 1, False, True), (1, "search", "openalex", 2, True, True), (1, "url", "own", 0, False, False), (2, "url", "own", 0, True, True), (3, "search", "core", 1, True, True), (3, "url", "own", 0, False, True), (4, "search", "core", 1, True, True), (4, "search", "gutenberg", 9, True, True), (5, "search", "gutenberg", 9, True, True)]
    attempts = spark.createDataFrame(a, "ref_id long, stage string, source string, rank int, has_text boolean, has_abstract boolean")
    got = {r["ref_id"]: (r["outcome"], r["source"]) for r in resolve.resolved(refs, attempts).collect()}
    assert got == {1: ("full_text", "openalex"), 2: ("archive", ""), 3: ("abstract", "own"), 4: ("full_text", "gutenberg"), 5: ("none", ""), 6: ("none", "")}


def test_records(spark):
    cross = '{"DOI": "10.5/a", "title": ["Clay", "x"], "issued": {"date-parts": [[2001, 4]]}, "author": [{"given": "Ann", "family": "Roe"}, {}], "abstract": "<jats:title>Abstract</jats:title><jats:p>On clay.</jats:p>"}'
    alex = '{"doi": "https://doi.org/10.5/a", "display_name": "Clay", "publication_year": 2001, "authorships": [{"author": {"display_name": "Ann Roe"}}], "best_oa_location": null, "locations": [{"pdf_url": null}, {"pdf_url": "http://a.example/p"}], "abstract_inverted_index": {"clay": [1, 3], "On": [0], "and": [2]}}'
    assert tuple(values(spark, [cross], R.crossref_record)[0]) == ("10.5/a", "Clay", "2001", ["Ann Roe"], "Abstract On clay.", None)
    assert tuple(values(spark, [alex], R.openalex_record)[0]) == ("10.5/a", "Clay", "2001", ["Ann Roe"], "On clay and clay", "http://a.example/p")
    assert tuple(values(spark, ['{"authors": ["Ann", {"name": "Bob"}], "downloadUrl": "u"}'], R.core_record)[0])[2:] == ("n.d.", ["Ann", "Bob"], None, "u")
    assert tuple(values(spark, ["{", None], R.semantic_record)[0])[:4] == ("", "", "n.d.", [])
    assert values(spark, ["x *** START OF THE PROJECT GUTENBERG EBOOK CLAY *** body *** END OF THE PROJECT GUTENBERG EBOOK CLAY *** y", " plain "], R.book_body) == ["body", "plain"]
    wiki = "{{header\n | title = Clay\n | author = [[Author:Ann Roe|Ann Roe]]\n}}\n== One ==\n'''Clay''' in [[Kiln|kilns]] and [[Fire]]"
    assert values(spark, [wiki], R.wiki_author) == ["Ann Roe"] and values(spark, [wiki], R.wiki_body) == ["One \nClay in kilns and Fire"]


def test_cached_works_without_keys(spark):
    refs = spark.createDataFrame([(1, None, ""), (2, "10.5/a", None), (3, "", "Clay"), (4, None, None)], "ref_id long, doi string, title string")
    cache = spark.createDataFrame([(7, "10.5/A", "Other"), (8, None, "clay"), (9, "", ""), (10, None, None)], "work_id long, doi string, title string")
    got = {r["ref_id"]: (r["work_id"], r["via"]) for r in link.cached_works(refs, cache).collect()}
    assert got == {1: (None, "miss"), 2: (7, "doi"), 3: (8, "title"), 4: (None, "miss")}


def test_nearest_in_blocks(spark):
    import numpy as np

    m = np.random.default_rng(0).normal(size=(90, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(90, None)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in choose.nearest(df, 3, 10, block=16).collect()}
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 90, 10):
        s = n @ n[q]
        s[q] = -2
        assert [got[q, r] for r in (1, 2, 3)] == np.argsort(-s)[:3].tolist()
    assert choose.nearest(df.where("false"), 3, 10).count() == 0


@pytest.mark.parametrize("name", sorted(sources_sql.SQL))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    df = sources.queries()[name](spark, DATA)
    names, rows = oracle_rows(DATA, sources_sql.SQL[name])
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, rows)
