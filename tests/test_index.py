"""Incremental index refresh: reuse unchanged, re-encode changed, drop deleted."""
from pyspark.sql import functions as F

from docshelf.operators import index


def files(spark, rows):
    df = spark.createDataFrame(rows, "path string, category string, text string, mtime_us bigint")
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "category", "text",
                     F.length("text").cast("bigint").alias("size"), "mtime_us",
                     F.md5(F.col("text").cast("binary")).alias("content_hash"))


def test_refresh_cycle(spark):
    calls = []

    def counting(df, text_col, out):
        calls.append(1)
        return index.hashed_vectoriser(16)(df, text_col, out)

    v1 = files(spark, [("t/Finance/a.txt", "Finance", "invoice total due", 1)])
    idx1 = index.refresh(v1, None, counting)
    assert idx1.count() == 1
    again = index.refresh(v1, idx1, counting)
    assert {r["action"] for r in again.collect()} == {"reused"}
    v2 = files(spark, [("t/Finance/a.txt", "Finance", "invoice total due now", 2)])
    changed = index.refresh(v2, idx1, counting).collect()
    assert [r["action"] for r in changed] == ["encoded"]
    assert index.deleted(files(spark, [("t/AI/z.txt", "AI", "model", 1)]), idx1).count() == 1
    blank = files(spark, [("t/AI/blank.txt", "AI", "   ", 1)])
    assert index.encode(blank).count() == 0


def test_save_load_clear(spark, tmp_path):
    idx = index.encode(files(spark, [("t/Finance/a.txt", "Finance", "invoice total due", 1)]))
    p = str(tmp_path / "idx")
    index.save(idx, p)
    assert index.load(spark, p).count() == 1
    index.clear(spark, p)
    assert index.load(spark, p).count() == 0
    assert index.load(spark, str(tmp_path / "missing")).count() == 0
