"""Undo planning from the operation history (H1-H8).

Nothing is moved: the output is a restore plan and its statistics. Record
order is the history ``seq``. One run may hold a large share of all records,
so nothing below groups a whole run into one task: run-level facts are
partial aggregates, orderings are distributed (:mod:`..functions.ordinal`)
and chains are resolved by doubling joins on ``(run_id, seq)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import with_row_number
from ..functions.text import base_name
from ..session import materialize
from .naming import restore_plan


def latest_run(records: DataFrame) -> DataFrame:
    """H1: one row, the run id of the last record."""
    return records.agg(F.max_by("run_id", "seq").alias("run_id"))


def records_to_undo(records: DataFrame, run_id: str | None = None) -> DataFrame:
    """H2: records of ``run_id`` (else the latest run), with ``undo_order`` newest first."""
    if run_id is None:
        chosen = records.join(F.broadcast(latest_run(records)), ["run_id"], "left_semi")
    else:
        chosen = records.where(F.col("run_id") == F.lit(run_id))
    return with_row_number(chosen, [F.col("seq").desc()], "undo_order")


def run_ids_in_order(records: DataFrame) -> DataFrame:
    """H3: ``(run_id, first_seq, position)`` in order of first appearance."""
    firsts = records.groupBy("run_id").agg(F.min("seq").alias("first_seq"))
    return with_row_number(firsts, ["first_seq"], "position")


def undo_decision(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """H4: ``decision`` per record against the files present now.

    ``inventory(path, md5)``. Destination missing -> ``skipped_missing``; both
    hashes known and different -> ``skipped_changed``; else ``restore``.
    A null hash on either side never blocks.
    """
    inv = inventory.select(F.col("path").alias("destination_path"), F.col("md5").alias("current_hash"),
                           F.lit(True).alias("_present"))
    j = records.join(inv, ["destination_path"], "left")
    decision = (
        F.when(F.col("_present").isNull(), F.lit("skipped_missing"))
        .when(F.col("destination_hash").isNotNull() & F.col("current_hash").isNotNull()
              & (F.col("destination_hash") != F.col("current_hash")), F.lit("skipped_changed"))
        .otherwise(F.lit("restore"))
    )
    return j.withColumn("decision", decision).drop("_present")


def chain_links(records: DataFrame) -> DataFrame:
    """``run_id, seq, next_seq``: the record that goes on from each record, or null.

    A record goes on from the latest earlier record of its run that ended at its source path; when
    several claim the same one, the first does. Every record has at most one record before it and
    one after it, so a path filled twice gives two chains and no file is restored twice.
    """
    ends = records.select("run_id", F.col("destination_path").alias("path"), "seq", F.lit(1).alias("arrives"))
    starts = records.select("run_id", F.col("source_path").alias("path"), "seq", F.lit(0).alias("arrives"))
    earlier = Window.partitionBy("run_id", "path").orderBy("seq", "arrives").rowsBetween(Window.unboundedPreceding, -1)
    claims = (
        ends.unionByName(starts)
        .withColumn("before", F.last(F.when(F.col("arrives") == 1, F.col("seq")), ignorenulls=True).over(earlier))
        .where("arrives = 0 and before is not null")
        .groupBy("run_id", F.col("before").alias("seq")).agg(F.min("seq").alias("next_seq"))
    )
    return records.select("run_id", "seq").join(claims, ["run_id", "seq"], "left")


def resolve_chains(records: DataFrame) -> DataFrame:
    """H5: net moves of chained records within a run, whatever their length.

    Returns one row per chain: ``run_id, head_seq, tail_seq, original_path, final_path, final_hash,
    steps``. Chains are followed by pointer doubling: each round doubles the distance every record
    looks ahead, so the rounds grow with the logarithm of the longest chain; each is one join on
    ``(run_id, seq)``, which is unique, and its result is written.
    """
    r = materialize(records.select("run_id", "seq", "source_path", "destination_path", "destination_hash"), "undo-records")
    links = materialize(chain_links(r), "undo-links")
    after = links.where("next_seq is not null").select("run_id", F.col("next_seq").alias("seq"))
    heads = links.join(after, ["run_id", "seq"], "left_anti").select("run_id", F.col("seq").alias("head_seq"))
    ahead = materialize(
        links.select("run_id", "seq", F.coalesce("next_seq", "seq").alias("tail_seq"),
                     F.when(F.col("next_seq").isNull(), 0).otherwise(1).cast("bigint").alias("jumps")), "undo-ahead")
    reach = -1
    while (total := ahead.agg(F.sum("jumps")).first()[0] or 0) != reach:
        reach = total
        further = ahead.select("run_id", F.col("seq").alias("tail_seq"), F.col("tail_seq").alias("_tail"),
                               F.col("jumps").alias("_jumps"))
        ahead = materialize(
            ahead.join(further, ["run_id", "tail_seq"])
            .select("run_id", "seq", F.col("_tail").alias("tail_seq"), (F.col("jumps") + F.col("_jumps")).alias("jumps")),
            "undo-ahead")
    head = r.select("run_id", F.col("seq").alias("head_seq"), F.col("source_path").alias("original_path"))
    tail = r.select("run_id", F.col("seq").alias("tail_seq"), F.col("destination_path").alias("final_path"),
                    F.col("destination_hash").alias("final_hash"))
    chains = heads.join(ahead.withColumnRenamed("seq", "head_seq"), ["run_id", "head_seq"])
    return chains.join(head, ["run_id", "head_seq"]).join(tail, ["run_id", "tail_seq"]).select(
        "run_id", "head_seq", "tail_seq", "original_path", "final_path", "final_hash",
        (F.col("jumps") + 1).alias("steps"))


def undo_plan(records: DataFrame, inventory: DataFrame, occupied: DataFrame) -> DataFrame:
    """H4-H6 on net chains: decision and restore path per chain.

    ``occupied(path)``: paths that exist now (a restore must not overwrite).
    Restores are allocated newest chain first, as the undo walks newest first.
    """
    chains = resolve_chains(records)
    decided = undo_decision(
        chains.select("run_id", "head_seq", "tail_seq", "original_path", "steps",
                      F.col("final_path").alias("destination_path"), F.col("final_hash").alias("destination_hash")),
        inventory)
    restoring = decided.where(F.col("decision") == "restore").withColumn("source_path", F.col("original_path")) \
        .withColumn("_neg_seq", -F.col("tail_seq"))
    planned = restore_plan(restoring, occupied, ["_neg_seq"]).drop("source_path", "_neg_seq")
    skipped = decided.where(F.col("decision") != "restore").withColumn("restore_path", F.lit(None).cast("string"))
    return planned.unionByName(skipped)


def undo_stats(plan: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """H7: found / restored / skipped / errors per run (records counted through their chains).

    ``failures(run_id, head_seq)`` are the restores that the mover could not carry out: errors, not restored.
    """
    if failures is None:
        plan = plan.withColumn("_failed", F.lit(False))
    else:
        failed = failures.select("run_id", "head_seq").distinct().withColumn("_failed", F.lit(True))
        plan = plan.join(failed, ["run_id", "head_seq"], "left").withColumn("_failed", F.coalesce("_failed", F.lit(False)))
    restore = F.col("decision") == "restore"
    total = lambda cond: F.sum(F.when(cond, F.col("steps")).otherwise(0)).cast("bigint")
    return plan.groupBy("run_id").agg(
        F.sum("steps").cast("bigint").alias("found"),
        total(restore & ~F.col("_failed")).alias("restored"),
        total(~restore).alias("skipped"),
        total(restore & F.col("_failed")).alias("errors"),
    )


def legacy_plan(moves: DataFrame, root: str, inventory: DataFrame, occupied: DataFrame | None = None) -> DataFrame:
    """H8: restore each logged move to ``<root>/<name>``, newest first; no hash check.

    A name that ``occupied(path)`` or a newer move holds takes ``stem_restored_N``. Moves of one timestamp are
    ordered by ``place`` where the log reader gives it, and then by name and destination.
    """
    ties = [c for c in ("place", "filename", "dest") if c in moves.columns]
    inv = inventory.select(F.col("path").alias("dest"), F.lit(True).alias("_present"))
    j = moves.join(inv, ["dest"], "left").withColumn(
        "source_path", F.concat(F.lit(root.rstrip("/") + "/"), base_name("dest")))
    columns = ["logged_at", "filename", "dest", "restore_path", "decision"]
    found = with_row_number(j.where("_present").withColumn("decision", F.lit("restore")),
                            [F.col("logged_at").desc(), *[F.col(c).desc() for c in ties]], "_order")
    if occupied is None:
        occupied = moves.select(F.col("dest").alias("path")).limit(0)
    planned = restore_plan(found, occupied, ["_order"])
    missing = j.where("_present is null").select(
        "logged_at", "filename", "dest", F.lit(None).cast("string").alias("restore_path"),
        F.lit("skipped_missing").alias("decision"))
    return planned.select(*columns).unionByName(missing)


def undo_run(records: DataFrame, run_id: str | None, moves: DataFrame, root: str, inventory: DataFrame,
             occupied: DataFrame) -> DataFrame:
    """Undo one run from the history, or from the legacy log when no record matches (H8).

    Returns ``original_name, destination_path, restore_path, decision``: net moves of ``run_id`` (else of the latest run),
    or, when the history has none, the moves of the log.
    """
    chosen = materialize(records_to_undo(records, run_id).drop("undo_order"), "undo-run")
    if chosen.isEmpty():
        plan = legacy_plan(moves, root, inventory, occupied)
        return plan.select(F.col("filename").alias("original_name"), F.col("dest").alias("destination_path"), "restore_path", "decision")
    plan = undo_plan(chosen, inventory, occupied)
    return plan.select(base_name("original_path").alias("original_name"), "destination_path", "restore_path", "decision")
