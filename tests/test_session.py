"""Written tables: what is left on disk beside them."""
import os

from pyspark.sql import functions as F

from docshelf.session import CLEAN_SHUFFLES, drop_written, materialize


def shuffle_files(spark):
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_written_table_leaves_no_shuffle_files(spark):
    before, kept = shuffle_files(spark), spark.conf.get(CLEAN_SHUFFLES, None)
    rows = spark.range(1000).withColumn("k", F.col("id") % 7).repartition("id").groupBy("k").agg(F.sum("id").alias("s"))
    out = materialize(rows.join(rows.withColumnRenamed("s", "t").hint("merge"), ["k"]), "test-shuffles")
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEAN_SHUFFLES, None) == kept
    assert out.count() == 7 and out.where("s <> t").count() == 0
    drop_written(out)
