"""Queries: history (A4, A5, A7) and undo (H1-H8) over records derived from ``events``.

Each event is one organised file of run ``run-<user_id>``: a signup is a
rename followed by a move (a two-step chain), other events a single move;
``seq`` is ``2 * event_id`` (+1 for the move). Error events are damaged
history lines: corrupt JSON when ``value >= 100``, else a record of another
schema version. The files present now: every final destination, except
destinations of events with ``value < 10`` (deleted since) and with
``value > 990`` (edited since: other hash). Original inbox paths of purchases
with ``value > 900`` are occupied now, so their restore needs a new name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import options as O
from ..operators import undo
from ..session import materialize, scratch_path
from ..sources.history import append_history, read_history, read_legacy_log
from ..sources.tables import read_table
from .catalog import query

ROOT = "inbox"


def _event_cols(ev):
    e = F.col("event_id").cast("string")
    inbox = F.concat(F.lit("inbox/u"), F.col("user_id").cast("string"), F.lit("/"))
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        F.concat(F.lit("run-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("run_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.md5(F.col("props").cast("binary")).alias("h"),
        F.concat(inbox, F.lit("f"), e, F.lit(".txt")).alias("orig"),
        F.concat(inbox, F.lit("r"), e, F.lit(".txt")).alias("renamed"),
        F.concat(F.lit("f"), e, F.lit(".txt")).alias("fname"),
        F.concat(F.lit("r"), e, F.lit(".txt")).alias("rname"),
    )


def history_records(spark, sf_dir):
    """All history records the events stand for (before writing), including damaged ones."""
    ev = _event_cols(read_table(spark, sf_dir, "events"))
    ok = ev.where(F.col("event_type") != "error")
    signup = ok.where(F.col("event_type") == "signup")
    common = ["run_id", "timestamp"]
    rename = signup.select(
        (F.col("event_id") * 2).alias("seq"), *common, F.lit("rename").alias("action"),
        F.col("orig").alias("source_path"), F.col("renamed").alias("destination_path"),
        F.col("fname").alias("original_name"), F.col("rname").alias("final_name"), "h")
    move = ok.select(
        (F.col("event_id") * 2 + 1).alias("seq"), *common, F.lit("move").alias("action"),
        F.when(F.col("event_type") == "signup", F.col("renamed")).otherwise(F.col("orig")).alias("source_path"),
        F.concat(F.lit("organised/"), F.col("event_type"), F.lit("/"),
                 F.when(F.col("event_type") == "signup", F.col("rname")).otherwise(F.col("fname"))).alias("destination_path"),
        F.when(F.col("event_type") == "signup", F.col("rname")).otherwise(F.col("fname")).alias("original_name"),
        F.when(F.col("event_type") == "signup", F.col("rname")).otherwise(F.col("fname")).alias("final_name"), "h")
    recs = rename.unionByName(move).withColumn("schema_version", F.lit(O.HISTORY_SCHEMA_VERSION)) \
        .withColumnRenamed("h", "source_hash").withColumn("destination_hash", F.col("source_hash"))
    damaged = ev.where(F.col("event_type") == "error")
    return recs, damaged


def written_history(spark, sf_dir):
    """Write the history as JSON lines (A7) with damaged lines, read it back (A4)."""
    recs, damaged = history_records(spark, sf_dir)
    path = scratch_path(spark, f"history-{uuid.uuid4().hex}")
    append_history(recs, path)
    wrong_version = damaged.where(F.col("value") < 100).select(
        F.to_json(F.struct(F.lit(2).alias("schema_version"), "run_id", "timestamp",
                           F.lit("move").alias("action"), F.col("orig").alias("source_path"),
                           F.col("orig").alias("destination_path"), (F.col("event_id") * 2 + 1).alias("seq"))).alias("value"))
    corrupt = damaged.where(F.col("value") >= 100).select(
        F.concat(F.lit("{bad json "), F.col("event_id").cast("string")).alias("value"))
    wrong_version.unionByName(corrupt).write.mode("append").text(path)
    return read_history(spark, path)


def inventory(spark, sf_dir):
    """Files present now: ``(path, md5)``."""
    ev = _event_cols(read_table(spark, sf_dir, "events")).where(F.col("event_type") != "error")
    dest = F.concat(F.lit("organised/"), F.col("event_type"), F.lit("/"),
                    F.when(F.col("event_type") == "signup", F.col("rname")).otherwise(F.col("fname")))
    present = ev.where(F.col("value") >= 10)
    return present.select(dest.alias("path"), F.when(F.col("value") > 990, F.md5(F.concat("h", F.lit("edited"))))
                          .otherwise(F.col("h")).alias("md5"))


def occupied(spark, sf_dir):
    ev = _event_cols(read_table(spark, sf_dir, "events"))
    return ev.where((F.col("event_type") == "purchase") & (F.col("value") > 900)).select(F.col("orig").alias("path"))


# --------------------------------------------------------------------------
# SQL side of the same fixture
# --------------------------------------------------------------------------

_EV_SQL = """ev AS (
  SELECT event_id, user_id, event_type, value, 'run-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS run_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, md5(props) AS h,
         'inbox/u' || CAST(user_id AS VARCHAR) || '/f' || CAST(event_id AS VARCHAR) || '.txt' AS orig,
         'inbox/u' || CAST(user_id AS VARCHAR) || '/r' || CAST(event_id AS VARCHAR) || '.txt' AS renamed,
         'f' || CAST(event_id AS VARCHAR) || '.txt' AS fname, 'r' || CAST(event_id AS VARCHAR) || '.txt' AS rname
  FROM events)"""

_HIST_SQL = f"""{_EV_SQL},
hist AS (
  SELECT event_id * 2 AS seq, run_id, timestamp, 'rename' AS action, orig AS source_path, renamed AS destination_path,
         fname AS original_name, rname AS final_name, h AS source_hash, h AS destination_hash, 1 AS schema_version
  FROM ev WHERE event_type = 'signup'
  UNION ALL
  SELECT event_id * 2 + 1, run_id, timestamp, 'move',
         CASE WHEN event_type = 'signup' THEN renamed ELSE orig END,
         'organised/' || event_type || '/' || CASE WHEN event_type = 'signup' THEN rname ELSE fname END,
         CASE WHEN event_type = 'signup' THEN rname ELSE fname END,
         CASE WHEN event_type = 'signup' THEN rname ELSE fname END, h, h, 1
  FROM ev WHERE event_type <> 'error'),
inv AS (
  SELECT 'organised/' || event_type || '/' || CASE WHEN event_type = 'signup' THEN rname ELSE fname END AS path,
         CASE WHEN value > 990 THEN md5(h || 'edited') ELSE h END AS md5
  FROM ev WHERE event_type <> 'error' AND value >= 10),
occ AS (SELECT orig AS path FROM ev WHERE event_type = 'purchase' AND value > 900)"""

_CHAIN_SQL = f"""WITH RECURSIVE {_HIST_SQL},
pred AS (
  SELECT b.run_id, b.seq AS next_seq, max(a.seq) AS seq
  FROM hist b JOIN hist a ON a.run_id = b.run_id AND a.destination_path = b.source_path AND a.seq < b.seq
  GROUP BY b.run_id, b.seq),
claim AS (SELECT run_id, seq, min(next_seq) AS next_seq FROM pred GROUP BY run_id, seq),
succ AS (SELECT h.run_id, h.seq, c.next_seq FROM hist h LEFT JOIN claim c ON c.run_id = h.run_id AND c.seq = h.seq),
heads AS (SELECT run_id, seq FROM succ s
          WHERE NOT EXISTS (SELECT 1 FROM succ p WHERE p.run_id = s.run_id AND p.next_seq = s.seq)),
chain(run_id, head_seq, tail_seq, steps) AS (
  SELECT run_id, seq, seq, 1 FROM heads
  UNION ALL
  SELECT c.run_id, c.head_seq, s.next_seq, c.steps + 1
  FROM chain c JOIN succ s ON s.run_id = c.run_id AND s.seq = c.tail_seq WHERE s.next_seq IS NOT NULL),
net AS (SELECT run_id, head_seq, arg_max(tail_seq, steps) AS tail_seq, max(steps) AS steps FROM chain GROUP BY ALL),
chains AS (
  SELECT n.run_id, n.head_seq, n.tail_seq, h.source_path AS original_path, t.destination_path AS final_path,
         t.destination_hash AS final_hash, CAST(n.steps AS BIGINT) AS steps
  FROM net n JOIN hist h ON h.run_id = n.run_id AND h.seq = n.head_seq
  JOIN hist t ON t.run_id = n.run_id AND t.seq = n.tail_seq),
decided AS (
  SELECT c.*, CASE WHEN inv.path IS NULL THEN 'skipped_missing'
                   WHEN c.final_hash IS NOT NULL AND inv.md5 IS NOT NULL AND c.final_hash <> inv.md5 THEN 'skipped_changed'
                   ELSE 'restore' END AS decision
  FROM chains c LEFT JOIN inv ON inv.path = c.final_path),
plan AS (
  SELECT d.*, CASE WHEN d.decision <> 'restore' THEN NULL
                   WHEN occ.path IS NOT NULL THEN regexp_replace(d.original_path, '\\.txt$', '') || '{O.RESTORED_SUFFIX}1.txt'
                   ELSE d.original_path END AS restore_path
  FROM decided d LEFT JOIN occ ON occ.path = d.original_path)"""


# --- A4 / A7 -----------------------------------------------------------------

@query("history_valid", f"""WITH {_HIST_SQL}
SELECT seq, run_id, timestamp, action, source_path, destination_path, source_hash, destination_hash,
       original_name, final_name, schema_version FROM hist""")
def history_valid(spark, sf_dir):
    return written_history(spark, sf_dir).select(
        "seq", "run_id", "timestamp", "action", "source_path", "destination_path", "source_hash",
        "destination_hash", "original_name", "final_name", "schema_version")


# --- H1 / H2 / H3 ---------------------------------------------------------------

@query("latest_run", f"WITH {_HIST_SQL} SELECT arg_max(run_id, seq) AS run_id FROM hist")
def latest_run(spark, sf_dir):
    return undo.latest_run(written_history(spark, sf_dir))


@query("undo_records", f"""WITH {_HIST_SQL},
latest AS (SELECT arg_max(run_id, seq) AS run_id FROM hist)
SELECT seq, run_id, action, source_path, destination_path,
       CAST(row_number() OVER (ORDER BY seq DESC) AS BIGINT) AS undo_order
FROM hist WHERE run_id = (SELECT run_id FROM latest)""")
def undo_records(spark, sf_dir):
    return undo.records_to_undo(written_history(spark, sf_dir)).select(
        "seq", "run_id", "action", "source_path", "destination_path", "undo_order")


@query("run_ids_in_order", f"""WITH {_HIST_SQL}
SELECT run_id, first_seq, CAST(row_number() OVER (ORDER BY first_seq) AS BIGINT) AS position
FROM (SELECT run_id, min(seq) AS first_seq FROM hist GROUP BY run_id)""")
def run_ids_in_order(spark, sf_dir):
    return undo.run_ids_in_order(written_history(spark, sf_dir))


# --- H4 -------------------------------------------------------------------------

@query("undo_decision", f"""WITH {_HIST_SQL}
SELECT h.seq, h.run_id, h.destination_path,
       CASE WHEN inv.path IS NULL THEN 'skipped_missing'
            WHEN h.destination_hash IS NOT NULL AND inv.md5 IS NOT NULL AND h.destination_hash <> inv.md5
            THEN 'skipped_changed' ELSE 'restore' END AS decision
FROM hist h LEFT JOIN inv ON inv.path = h.destination_path""")
def undo_decision(spark, sf_dir):
    return undo.undo_decision(written_history(spark, sf_dir), inventory(spark, sf_dir)).select(
        "seq", "run_id", "destination_path", "decision")


# --- H5 / H6 / H7 -------------------------------------------------------------------

@query("undo_chain", _CHAIN_SQL + """
SELECT run_id, head_seq, tail_seq, original_path, final_path, final_hash, steps FROM chains""")
def undo_chain(spark, sf_dir):
    return undo.resolve_chains(written_history(spark, sf_dir))


@query("undo_plan", _CHAIN_SQL + """
SELECT run_id, head_seq, tail_seq, original_path, destination_path, decision, restore_path, steps FROM
  (SELECT *, final_path AS destination_path FROM plan)""")
def undo_plan(spark, sf_dir):
    plan = undo.undo_plan(written_history(spark, sf_dir), inventory(spark, sf_dir), occupied(spark, sf_dir))
    return plan.select("run_id", "head_seq", "tail_seq", "original_path", "destination_path", "decision",
                       "restore_path", "steps")


@query("undo_stats", _CHAIN_SQL + """
SELECT run_id, CAST(sum(steps) AS BIGINT) AS found,
       CAST(sum(CASE WHEN decision = 'restore' THEN steps ELSE 0 END) AS BIGINT) AS restored,
       CAST(sum(CASE WHEN decision <> 'restore' THEN steps ELSE 0 END) AS BIGINT) AS skipped,
       CAST(0 AS BIGINT) AS errors
FROM plan GROUP BY run_id""")
def undo_stats(spark, sf_dir):
    plan = undo.undo_plan(written_history(spark, sf_dir), inventory(spark, sf_dir), occupied(spark, sf_dir))
    return undo.undo_stats(plan)


@query("undo_stats_errors", _CHAIN_SQL + """
SELECT run_id, CAST(sum(steps) AS BIGINT) AS found,
       CAST(sum(CASE WHEN decision = 'restore' AND restore_path = original_path THEN steps ELSE 0 END) AS BIGINT) AS restored,
       CAST(sum(CASE WHEN decision <> 'restore' THEN steps ELSE 0 END) AS BIGINT) AS skipped,
       CAST(sum(CASE WHEN decision = 'restore' AND restore_path <> original_path THEN steps ELSE 0 END) AS BIGINT) AS errors
FROM plan GROUP BY run_id""")
def undo_stats_errors(spark, sf_dir):
    """A mover that fails wherever the old path is occupied: those restores are errors."""
    plan = materialize(undo.undo_plan(written_history(spark, sf_dir), inventory(spark, sf_dir), occupied(spark, sf_dir)), "undo-plan")
    return undo.undo_stats(plan, plan.where("decision = 'restore' AND restore_path <> original_path"))


# --- A5 / H8 --------------------------------------------------------------------------
# Legacy text log: one line per event, moves for organised files and other
# lines for errors.

def legacy_log(spark, sf_dir):
    ev = _event_cols(read_table(spark, sf_dir, "events"))
    # "<date> <time>,<line number>" like a logging asctime, sortable
    stamp = F.concat(F.regexp_replace(F.substring("timestamp", 1, 19), "T", " "), F.lit(","),
                 F.lpad(F.col("event_id").cast("string"), 8, "0"))
    dest = F.concat(F.lit("organised/"), F.col("event_type"), F.lit("/"), F.col("fname"))
    line = F.when(F.col("event_type") == "error",
                  F.concat(stamp, F.lit(" | ERROR | organizer | Extraction error for '"), F.col("fname"), F.lit("'")))\
        .otherwise(F.concat(stamp, F.lit(" | INFO | utils | Moved '"), F.col("fname"), F.lit("' -> '"), dest, F.lit("'")))
    path = scratch_path(spark, f"legacy-log-{uuid.uuid4().hex}")
    ev.select(line.alias("value")).write.text(path)
    return read_legacy_log(spark, path)


_LOG_SQL = f"""{_EV_SQL},
lines AS (SELECT replace(substr(timestamp, 1, 19), 'T', ' ') || ',' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS logged_at,
                 fname AS filename, 'organised/' || event_type || '/' || fname AS dest, value, event_type
          FROM ev WHERE event_type <> 'error')"""


@query("legacy_log_parse", f"WITH {_LOG_SQL} SELECT logged_at, filename, dest FROM lines")
def legacy_log_parse(spark, sf_dir):
    return legacy_log(spark, sf_dir).drop("place")


@query("legacy_plan", f"""WITH {_LOG_SQL},
inv AS (SELECT 'organised/' || event_type || '/' || fname AS path FROM ev
        WHERE event_type NOT IN ('error', 'signup') AND value >= 10)
SELECT l.logged_at, l.filename, l.dest,
       CASE WHEN inv.path IS NULL THEN NULL
            WHEN event_type = 'purchase' AND value > 900
            THEN '{ROOT}/' || regexp_replace(l.filename, '\\.txt$', '') || '{O.RESTORED_SUFFIX}1.txt'
            ELSE '{ROOT}/' || l.filename END AS restore_path,
       CASE WHEN inv.path IS NULL THEN 'skipped_missing' ELSE 'restore' END AS decision
FROM lines l LEFT JOIN inv ON inv.path = l.dest""")
def legacy_plan(spark, sf_dir):
    names = _event_cols(read_table(spark, sf_dir, "events")).where("event_type = 'purchase' and value > 900")
    taken = names.select(F.concat(F.lit(f"{ROOT}/"), "fname").alias("path"))
    return undo.legacy_plan(legacy_log(spark, sf_dir), ROOT, inventory(spark, sf_dir), taken)



def crowded_log(spark, sf_dir):
    """A log whose stamps are whole days, so many moves tie, of files that share a few names."""
    ev = _event_cols(read_table(spark, sf_dir, "events")).where("event_type <> 'error'")
    line = F.concat(F.substring("timestamp", 1, 10), F.lit(" 00:00:00,000 | INFO | utils | Moved '"), F.col("event_type"), F.lit(".txt' -> '"),
                    F.lit("organised/"), F.col("event_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".txt'"))
    path = scratch_path(spark, f"crowded-log-{uuid.uuid4().hex}")
    ev.select("event_id", line.alias("value")).repartitionByRange("event_id").sortWithinPartitions("event_id") \
        .select("value").write.text(path)
    return read_legacy_log(spark, path)


@query("undo_fallback", f"""WITH {_EV_SQL},
lines AS (SELECT event_id, event_type || '.txt' AS name, substr(timestamp, 1, 10) AS logged_on,
                 'organised/' || CAST(event_id AS VARCHAR) || '/' || event_type || '.txt' AS dest, value >= 10 AS present
          FROM ev WHERE event_type <> 'error'),
k AS (SELECT *, row_number() OVER (PARTITION BY name, present ORDER BY logged_on DESC, event_id DESC) - 1 AS k FROM lines)
SELECT name AS original_name, dest AS destination_path,
       CASE WHEN NOT present THEN NULL WHEN k = 0 THEN '{ROOT}/' || name
            ELSE '{ROOT}/' || regexp_replace(name, '\\.txt$', '') || '{O.RESTORED_SUFFIX}' || CAST(k AS VARCHAR) || '.txt' END AS restore_path,
       CASE WHEN present THEN 'restore' ELSE 'skipped_missing' END AS decision
FROM k""")
def undo_fallback(spark, sf_dir):
    """No record of the run id: the legacy log is undone, its ties newest line first."""
    ev = _event_cols(read_table(spark, sf_dir, "events"))
    present = ev.where("event_type <> 'error' AND value >= 10").select(
        F.concat(F.lit("organised/"), F.col("event_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".txt")).alias("path"),
        F.lit(None).cast("string").alias("md5"))
    return undo.undo_run(written_history(spark, sf_dir), "no-such-run", crowded_log(spark, sf_dir), ROOT, present,
                         present.select("path").limit(0))
