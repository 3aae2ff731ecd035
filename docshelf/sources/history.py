"""Operation history as JSON lines (A4, A7) and the legacy move log (A5).

History lines are JSON objects. Malformed lines, JSON that is not an object,
other schema versions, unknown keys and records missing a required field are
skipped; blank lines produce no row. ``seq`` is the append order, written into
each record so that order survives a distributed read; lines written without
it get one from their file and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordinal import with_row_number
from ..options import HISTORY_SCHEMA_VERSION, MOVE_PATTERN
from ..session import materialize

RECORD_FIELDS = ["action", "destination_hash", "destination_path", "final_name", "original_name", "run_id",
                 "schema_version", "seq", "source_hash", "source_path", "timestamp"]
HISTORY_SCHEMA = (
    "action string, destination_hash string, destination_path string, final_name string, original_name string, "
    "run_id string, schema_version int, seq bigint, source_hash string, source_path string, timestamp string"
)
REQUIRED = ["run_id", "timestamp", "action", "source_path", "destination_path", "original_name", "final_name"]


def append_history(records: DataFrame, path: str) -> None:
    """Append records as JSON lines, keys in sorted order.

    One write per plan; the writer is idempotent per batch when callers use
    a batch-specific sub-folder (streaming does).
    """
    records.select(*sorted(RECORD_FIELDS)).write.mode("append").json(path)


def write_history(records: DataFrame, folder: str) -> None:
    """The records of one streaming batch as JSON lines in a folder of its own; a replayed batch replaces it."""
    records.select(*sorted(RECORD_FIELDS)).write.mode("overwrite").json(folder)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Valid records of the history at ``path`` (A4).

    Lines with other keys than the record's own are skipped, whatever the action. Lines without
    ``seq`` are ordered by file and line, after all that have one.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))
    parsed = lines.select("_file", "_block", "_line", F.from_json("value", HISTORY_SCHEMA).alias("r"),
                          F.json_object_keys("value").alias("keys"))
    known = F.size(F.array_except("keys", F.array(*[F.lit(c) for c in RECORD_FIELDS]))) == 0
    ok = F.coalesce(known, F.lit(False)) & (F.col("r.schema_version") == HISTORY_SCHEMA_VERSION)
    for c in REQUIRED:
        ok = ok & F.col(f"r.{c}").isNotNull()
    valid = materialize(parsed.where(ok).select("_file", "_block", "_line", "r.*"), "history")
    place = ["_file", "_block", "_line"]
    bare = valid.where("seq is null")
    if not bare.take(1):
        return valid.drop(*place)
    last = valid.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))
    numbered = with_row_number(bare, place, "_n").crossJoin(F.broadcast(last))       # one row
    return valid.where("seq is not null").drop(*place).unionByName(
        numbered.withColumn("seq", F.col("_last") + F.col("_n")).drop(*place, "_n", "_last"))


def read_legacy_log(spark: SparkSession, path: str) -> DataFrame:
    """Move lines of a legacy text log: ``(logged_at, filename, dest, place)`` (A5).

    The log line starts with its timestamp, which orders the moves (newest first = ``logged_at`` descending);
    lines of one timestamp are ordered by ``place`` (file, block start, line in the block), which does not depend on
    how the file was split. Undecodable bytes are dropped like the reference reader does.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "�", "").alias("line"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("line")).alias("place"))
    moved = lines.where(F.col("line").rlike(MOVE_PATTERN))
    return moved.select(
        F.regexp_extract("line", r"^(\S+ \S+)", 1).alias("logged_at"),
        F.regexp_extract("line", MOVE_PATTERN, 1).alias("filename"),
        F.regexp_extract("line", MOVE_PATTERN, 2).alias("dest"), "place",
    )
