from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from loam.sources import tables as s


def test_scan_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, data in {"a.pdf": b"one", "deep/b.txt": b"two", "deep/c.txt": b"one", "d.exe": b"three", "e.md": b"", "f.csv": b"x" * 50, "g.txt": b"known"}.items():
        (tmp_path / name).write_bytes(data)
    known = spark.createDataFrame([(hashlib.sha256(b"known").hexdigest(),)], "source_hash string")
    found = s.scan_folder(spark, str(tmp_path), known, max_bytes=40).collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in found) == ["a.pdf", "b.txt"]
    assert {r.source_hash for r in found} == {hashlib.sha256(x).hexdigest() for x in (b"one", b"two")}


def test_pages_and_csv(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("page one\fpage two\nline")
    assert [(r.page_number, r.text) for r in s.text_pages(spark, str(tmp_path / "t")).orderBy("page_number").collect()] == [(1, "page one"), (2, "page two\nline")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_text("Name,Value\nx,\n")
    assert [r.cells for r in s.csv_rows(spark, str(tmp_path / "c")).orderBy("row").collect()] == [["Name", "Value"], ["x", ""]]


def test_json_columns(spark):
    rows = spark.createDataFrame([('["a","b"]',), ("{broken",), (None,), ('{"a":1}',)], "j string")
    assert [tuple(r) for r in rows.select(s.json_ids(F.col("j")), s.json_array_size(F.col("j"))).collect()] == [(["a", "b"], 2), (None, 0), (None, 0), (None, 0)]


def test_replacement_touches_only_changed_buckets(spark, tmp_path):
    path = str(tmp_path / "chunks")
    old = spark.createDataFrame([(i, f"old {i}") for i in range(40)], "article_id long, text string")
    old.withColumn("bucket", s.bucket_of(F.col("article_id"), 8)).write.partitionBy("bucket").parquet(path)
    new = spark.createDataFrame([(3, "new 3a"), (3, "new 3b"), (99, "new 99")], "article_id long, text string")
    touched = s.replace_documents(spark, path, new, buckets=8)
    found = sorted((r.article_id, r.text) for r in spark.read.parquet(path).collect())
    assert touched <= 2
    assert found == sorted([(i, f"old {i}") for i in range(40) if i != 3] + [(3, "new 3a"), (3, "new 3b"), (99, "new 99")])


def test_a_failed_rebuild_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.createDataFrame([(1, "old")], "article_id long, text string").withColumn("bucket", s.bucket_of(F.col("article_id"), 4)).write.partitionBy("bucket").parquet(path)
    broken = spark.createDataFrame([(1, "x")], "article_id long, text string").withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        s.replace_documents(spark, path, broken, buckets=4)
    assert [r.text for r in spark.read.parquet(path).collect()] == ["old"]


def test_tenant_partitions(spark, tmp_path):
    s.write_by_tenant(spark.createDataFrame([("a", 1), ("b", 2)], "company_domain string, x int"), str(tmp_path / "t"))
    assert sorted(x.name for x in (tmp_path / "t").iterdir() if x.is_dir()) == ["company_domain=a", "company_domain=b"]


def test_jdbc_ranges(spark):
    url = "jdbc:derby:memory:loam;create=true"
    rows = spark.range(1, 101).selectExpr("id", "concat('row ', id) name")
    rows.write.format("jdbc").option("url", url).option("dbtable", "things").mode("overwrite").save()
    found = s.jdbc_table(spark, url, "things", "id", 1, 101, 4)
    assert found.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1]) for r in found.collect()) == [(i, f"row {i}") for i in range(1, 101)]
