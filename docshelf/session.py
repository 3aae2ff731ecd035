"""Session helpers.

The library never creates its own cluster settings on a real cluster: it
reads what the session already has and only fills in local defaults (shuffle
partitions, checkpoint folder) when they are unset, as in tests and bench runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this library relies on. AQE re-plans joins and
# coalesces partitions at runtime; the skew-join rule splits hot partitions
# that the explicit salting (operators.skew) does not already spread.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what the planner has measured to be small. The explicit
    # broadcasts in this library are on tables with a proven bound.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}

# Deletes a statement's shuffle files when the statement ends; set for the writes of materialize only.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "docshelf") -> SparkSession:
    """A local session for tests and the bench; not used on a cluster."""
    parts = shuffle_partitions or (os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator to a shared filesystem and is
    used as is. Only when it is unset on a local master (tests, bench) do we
    pick a folder; executors of a cluster would not share it, so there it is
    an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="docshelf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, name: str, compression: str | None = None):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor does not recompute the upstream job) and
    gives the planner the exact size of the result, which the broadcast
    decisions in :mod:`docshelf.operators.skew` rely on. The write's own shuffle files
    are deleted when it ends; else they stay until the driver's garbage collector finds them.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.parquet(path)


def drop_written(df) -> None:
    """Delete the tables that :func:`materialize` wrote for ``df``, once nothing reads them any more.

    Only files below the shared checkpoint folder are touched; other inputs of ``df`` stay.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(conf)
    root = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(base)).toString().rstrip("/") + "/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(folder))
        if path.toString().startswith(root):
            fs.delete(path, True)


def estimated_bytes(df) -> int:
    """Optimizer size estimate of ``df`` (exact for a Parquet scan, an upper bound otherwise)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:
        return 1 << 62
