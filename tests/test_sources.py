from pyspark.sql import functions as F

from scholion.sources import io


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, t string")
    for form in ("parquet", "orc", "json", "csv"):
        io.write(df, str(tmp_path / form), form)
        assert sorted(map(tuple, io.read(spark, str(tmp_path / form), form, "id long, t string").collect())) == [(1, "a,b"), (2, None)]
    io.write(df, str(tmp_path / "by"), by=["id"])
    assert io.read(spark, str(tmp_path / "by")).where("id = 1").count() == 1


def test_files_and_kinds(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.7 x"), ("b.html", b" <!DOCTYPE html><p>"), ("c.docx", b"PK\x03\x04"), ("d.txt", b"plain")):
        (tmp_path / name).write_bytes(content)
    rows = io.read_files(spark, str(tmp_path)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("n"), io.file_kind(F.col("content")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in rows} == {"a.pdf": "pdf", "b.html": "html", "c.docx": "zip", "d.txt": "text"}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, t string")
    assert sorted(map(tuple, io.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
