"""Small cases of the core operators, and every core query against its SQL on the smallest data."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from scholion.functions import responses
from scholion.functions import similarity as S
from scholion.functions import text as T
from scholion.operators import choose, link, parse
from scholion.plans import queries, sql
from tests.compare import canonical, oracle_rows

DATA = "/root/testdata/sf0.001"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "given, doi",
    [("https://doi.org/10.1/AbC.", "10.1/abc"), ("doi: 10.1/x", "10.1/x"), ("10.5555 / y", "10.5555/y"), ("none", ""), ("", ""), (None, "")],
)
def test_doi(spark, given, doi):
    assert (one(spark, T.normalize_doi, given) or "") == doi


@pytest.mark.parametrize("given, year", [("2020", "2020"), ("c2016", "2016"), ("n.d.", "n.d."), ("about 17", "n.d."), ("", "n.d.")])
def test_year(spark, given, year):
    assert one(spark, T.clean_year, given) == year


def test_sentences(spark):
    got = one(spark, T.sentences, "Dr. Ash came. It cost 3.5 pounds... (Roe et al. (2020) agree.) “Yes!” he said. See p. 4.")
    assert got == ["Dr. Ash came.", "It cost 3.5 pounds... (Roe et al. (2020) agree.)", "“Yes!”", "he said.", "See p. 4."]
    assert one(spark, T.sentences, "") == [] and one(spark, T.sentences, None) is None


def test_paragraphs_with_all_line_ends(spark):
    assert one(spark, T.paragraphs, " a\r\n\r\nb\n \nc\n") == ["a", "b", "c"]


def test_clean_text(spark):
    assert one(spark, T.clean_text, " a  b\nc­da-\nta\n\n\n\nX ") == " a b cdata\n\nX "


def test_coverage(spark):
    df = spark.createDataFrame([("Rain Man", "Man and model"), ("The of", "x"), ("Long words here stand", "words here stand tall")], "a string, b string")
    rows = df.select(S.coverage(F.col("a"), F.col("b")), S.coverage_threshold(F.col("a"))).collect()
    assert [tuple(map(float, r)) for r in rows] == [(0.5, 1.0), (1.0, 1.0), (0.75, 0.75)]


def test_surnames_keep_names_with_and(spark):
    assert one(spark, S.surnames, "Sandler, A. & Roe, B.; Cy Doe and Eve Fay") == ["sandler", "roe", "doe", "fay"]


def test_reference_fields(spark):
    raw = "Roe, A. & Doe, B. (2020). On things: a study. Journal of Things, 4, 1–2. https://doi.example/10.5555/ab."
    got = spark.createDataFrame([(raw,)], "r string").select(*[c.alias(k) for k, c in parse.apa_fields(F.col("r")).items()]).first()
    assert tuple(got) == ("Roe, A. & Doe, B", "2020", "On things: a study", "10.5555/ab", "", "regex", False)
    raw = "Roe, Ann. “On things.” Journal, vol. 2, 1999, pp. 1-2, 2001."
    got = spark.createDataFrame([(raw,)], "r string").select(*[c.alias(k) for k, c in parse.mla_fields(F.col("r")).items()]).first()
    assert tuple(got) == ("Roe, Ann", "2001", "On things.", "", "", "regex", False)


def test_cite_tags(spark):
    text = '<CITE type="q" key="A1">one\ntwo</cite> and <cite key="B2">x</cite >'
    assert [tuple(r) for r in one(spark, parse.cite_tags, text)] == [("A1", "one\ntwo"), ("B2", "x")]


def test_blocks(spark):
    docs = spark.createDataFrame([(1, "1. a\nb\n\nc\n2. d"), (2, None)], "doc_id long, text string")
    got = parse.line_blocks(docs, F.col("line").rlike(r"^\d\."))
    assert sorted(r["body"] for r in got.collect()) == ["1. a b", "2. d", "c"]


def test_links_take_the_first_reference_of_the_year(spark):
    refs = spark.createDataFrame([(1, 1, 0, "Roe, A.", "2001"), (2, 1, 1, "Roe, B.", "2005"), (3, 2, 0, "Roe, C.", "2005")], "ref_id long, doc_id long, ref_idx int, author string, year string")
    cits = spark.createDataFrame([(10, 1, "(Roe, 2005)"), (11, 1, "(Roe)"), (12, 1, "(Nobody, 1)"), (13, 1, None)], "cit_id long, doc_id long, citation_marker string")
    assert sorted(map(tuple, link.marker_links(cits, refs).collect())) == [(10, 2, True), (11, 1, False)]


def test_nearest_is_exact(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>")
    got = choose.nearest(df, 3, 50).collect()
    assert {r["query_id"] for r in got} == {0, 50} and len(got) == 6 and all(r["id"] != r["query_id"] for r in got)
    assert choose.nearest(df.where("false"), 3, 50).count() == 0


def test_uncited_sentences_by_containment(spark, tmp_path):
    para = "The first sentence opens the long citation. The second one goes on with its argument. As was said, it holds a citation inside of it. Brief it is. Nobody cites this last sentence."
    spark.createDataFrame([(1, para + "\n\nNo citation is here at all.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = ["The first sentence opens the long citation. The second one goes on with its argument.", "it holds a citation inside of it", "And brief it is. So there."]
    rows = [(i, 1, 0, i, t) for i, t in enumerate(texts)] + [(9, 1, 0, 9, "")]
    cits = spark.createDataFrame(rows, "cit_id long, doc_id long, paragraph_index int, seq int, text string")
    for c in ("claim_type", "citation_key", "citation_marker", "marker_type", "confidence", "drop_reason"):
        cits = cits.withColumn(c, F.lit(None).cast("string"))
    cits.write.parquet(f"{tmp_path}/citations.parquet")
    assert [tuple(r) for r in queries.queries()["uncited_sentences"](spark, str(tmp_path)).collect()] == [(1, 0, 1)]


def test_latest_version_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "id long, v string, at int")
    assert sorted(map(tuple, choose.latest(df, "id", "at", ["v"]).collect())) == [(1, "b"), (2, None)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, DATA)
    names, rows = oracle_rows(DATA, sql.oracle_sql()[name])
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, rows)


@pytest.mark.parametrize(
    "text, whole",
    [('{"a": [1, 2', '{"a": [1, 2]}'), ('{"a": [{"b": "x, y"}, {"c": "cu', '{"a": [{"b": "x, y"}]}'), ('{"a": 1}', '{"a": 1}'), ("]", None), ("", None), (None, None), ('{"a', None)],
)
def test_salvage(text, whole):
    assert responses.salvage(text) == whole


def test_every_query_has_sql_or_a_reason():
    assert set(queries.queries()) - set(sql.oracle_sql()) == {"author_relevance", "author_similarity", "json_salvage", "search_text"}
