"""Joins whose hot keys are broadcast, against a plain join."""
import pytest
from pyspark.sql import functions as F

from docshelf.operators import skew
from docshelf.operators.skew import narrow_join, split_lookup


@pytest.mark.parametrize("hot_keys", [1, 3, 40, 10_000])
def test_split_lookup_equals_a_plain_join(spark, hot_keys):
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 40)
    big = spark.range(3000).select("id", key.alias("k"), (F.col("id") % 2).alias("half"))
    lookup = (big.where("k is not null and k <> 7").groupBy("k", "half").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("value", F.concat_ws("-", "k", "half")))
    got = split_lookup(big, lookup, ["k", "half"], "n", hot_keys)
    want = big.join(lookup, ["k", "half"])
    assert got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() > 2000


def test_hot_rows_are_not_shuffled(spark):
    big = spark.range(1000).select("id", F.lit(1).alias("k"))
    lookup = spark.createDataFrame([(1, 1000, "x")], "k int, n bigint, value string")
    assert split_lookup(big, lookup, ["k"], "n").where("value = 'x'").count() == 1000
    assert split_lookup(big.limit(0), lookup, ["k"], "n").count() == 0
    assert split_lookup(big, lookup.limit(0), ["k"], "n").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_narrow_join_equals_a_plain_join(spark, tmp_path, monkeypatch, how):
    wide = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("k"), F.concat(F.lit("text "), "id").alias("text"))
    spark.createDataFrame([(3, "a"), (3, "b"), (4, "c"), (None, "d"), (99, "e")], "k bigint, v string").write.parquet(f"{tmp_path}/n")
    narrow = spark.read.parquet(f"{tmp_path}/n")
    want = sorted(wide.join(narrow, ["k"], how).collect(), key=str)
    assert sorted(narrow_join(wide, narrow, ["k"], how).collect(), key=str) == want and len(want) > 5
    monkeypatch.setattr(skew, "NARROW_ROWS", 4)          # more rows than that are shuffled
    joined = narrow_join(wide, narrow.hint("merge"), ["k"], how)
    assert sorted(joined.collect(), key=str) == want and "BroadcastHashJoin" not in plan_of(joined)


def test_labelled_texts_are_not_shuffled(spark):
    from docshelf.plans.q_classify import labelled_docs

    from .conftest import SF_SMALL

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as if the ids were more than Spark broadcasts by itself
    try:
        plan = plan_of(labelled_docs(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
