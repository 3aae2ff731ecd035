"""Queries: watch mode over ``events`` read as a stream.

Each event is a file event in ``watch/``: click, purchase and signup events
rewrite the user's top-level file ``watch/u<user>.txt``; view events create a
nested file (rejected: not top level); error events drop a ``.bmp`` (rejected:
unsupported). The file's content is the event's ``props`` text, hashed for
dedup and classified by the language model. Events are minutes to days
apart, so the fixture's settle delay is 10 minutes (the default is 2 s).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import options as O
from ..operators import naive_bayes as nb
from ..session import drop_written, materialize, scratch_path
from ..sources.history import read_history, write_history
from ..sources.tables import read_table
from ..streaming import watch
from .catalog import ORACLE, query
from .q_classify import lang_model, nb_result_sql

ROOT = "watch"
DEST_ROOT = "organised"
FIXTURE_SETTLE_SECONDS = 600.0
WATCH_TS = "2026-01-01T00:00:00+00:00"


def _watch_events(events):
    u = F.col("user_id").cast("string")
    e = F.col("event_id").cast("string")
    path = (
        F.when(F.col("event_type") == "view", F.concat(F.lit(ROOT + "/u"), u, F.lit("/v"), e, F.lit(".txt")))
        .when(F.col("event_type") == "error", F.concat(F.lit(ROOT + "/u"), u, F.lit("-"), e, F.lit(".bmp")))
        .otherwise(F.concat(F.lit(ROOT + "/u"), u, F.lit(".txt")))
    )
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", path.alias("path"),
        F.lit(False).alias("is_directory"), F.col("props").alias("text"))


ARRIVALS = 3      # the events arrive in so many parts; the stream is stopped and started between them


def _run(spark, rows, name, transform, per_batch=None, order="ts_us", out=None):
    """Stream ``rows`` through ``transform`` in time order, one restart per part; the written result.

    Each part is appended to the watched folder, and the query goes on from its checkpoint, so keyed
    state and planned names cross batches and restarts.
    """
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    out = out or f"{base}/out"
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.least(F.lit(ARRIVALS - 1), F.floor((F.col(order) - F.lit(low)) * ARRIVALS / F.lit(max(1, (high or 0) - (low or 0)))))
    for k in range(ARRIVALS if low is not None else 1):
        rows.where(part == k).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        watch.run_to_table(transform(stream), out, f"{base}/ckpt",
                           per_batch and (lambda df, batch_id: per_batch(df, batch_id, out)))
    return spark.read.parquet(out)


def watch_events(spark, sf_dir):
    events = _watch_events(read_table(spark, sf_dir, "events", spread=False))
    return events.withColumn("ts_us", F.unix_micros("ts"))


def filtered(spark, sf_dir):
    return _run(spark, watch_events(spark, sf_dir), "watch-filter", lambda s: watch.filter_events(s, ROOT))


def settled(spark, sf_dir):
    """J2 and J3 in one stream: the accepted events that open a window."""
    events = watch_events(spark, sf_dir).select("event_id", "ts", "ts_us", "path", "is_directory", "text")
    out = _run(spark, events, "watch-settle",
               lambda s: watch.settle(watch.filter_events(s, ROOT).where("accepted"), FIXTURE_SETTLE_SECONDS))
    return out.join(events.select("event_id", "text"), ["event_id"])


def deduped(spark, sf_dir):
    s = settled(spark, sf_dir).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    keys = s.select("event_id", "ts_us", "path", "text", "content_hash")
    return _run(spark, keys, "watch-dedup", watch.dedup, lambda df, batch_id, out_path: watch.attach_firsts(df))


# --------------------------------------------------------------------------
# SQL side
# --------------------------------------------------------------------------

_EV_SQL = f"""wev AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, props AS text,
         CASE WHEN event_type = 'view' THEN '{ROOT}/u' || CAST(user_id AS VARCHAR) || '/v' || CAST(event_id AS VARCHAR) || '.txt'
              WHEN event_type = 'error' THEN '{ROOT}/u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) || '.bmp'
              ELSE '{ROOT}/u' || CAST(user_id AS VARCHAR) || '.txt' END AS path
  FROM events),
acc AS (
  SELECT *, lower(regexp_extract(path, '(?s)^.+(\\.[^./]+)$', 1)) IN ({", ".join("'" + e + "'" for e in O.SUPPORTED_EXTENSIONS)}) AS ok_ext,
         NOT contains(substr(path, {len(ROOT) + 2}), '/') AS top
  FROM wev)"""

_SETTLE_SQL = f"""WITH RECURSIVE {_EV_SQL},
a AS (SELECT path, event_id, ts, ts + INTERVAL {int(FIXTURE_SETTLE_SECONDS)} SECOND AS ts_end, text FROM acc WHERE ok_ext AND top),
nx AS (SELECT e.path, e.event_id, arg_min(n.event_id, n.ts) AS next_id
       FROM a e LEFT JOIN a n ON e.path = n.path AND n.ts > e.ts_end GROUP BY e.path, e.event_id),
firsts AS (SELECT path, arg_min(event_id, ts) AS event_id FROM a GROUP BY path),
openers(path, event_id) AS (
  SELECT path, event_id FROM firsts
  UNION ALL
  SELECT nx.path, nx.next_id FROM openers o JOIN nx ON nx.event_id = o.event_id WHERE nx.next_id IS NOT NULL),
settled AS (SELECT o.path, o.event_id, a.ts, a.text, md5(a.text) AS content_hash FROM openers o JOIN a USING (event_id)),
dd AS (
  SELECT s.*, first_value(path) OVER (PARTITION BY content_hash ORDER BY ts, event_id) AS first_path,
         row_number() OVER (PARTITION BY content_hash ORDER BY ts, event_id) > 1 AS is_duplicate
  FROM settled s)"""


@query("watch_filter", f"""WITH {_EV_SQL}
SELECT event_id, path, ok_ext AND top AS accepted,
       CASE WHEN NOT ok_ext THEN 'unsupported type' WHEN NOT top THEN 'not a top-level file' END AS reason
FROM acc""")
def watch_filter(spark, sf_dir):
    return filtered(spark, sf_dir).select("event_id", "path", "accepted", "reason")


@query("watch_settle", _SETTLE_SQL + "\nSELECT path, event_id FROM settled")
def watch_settle(spark, sf_dir):
    return settled(spark, sf_dir).select("path", "event_id")


@query("watch_dedup", _SETTLE_SQL + """
SELECT path, event_id, is_duplicate, CASE WHEN is_duplicate THEN first_path END AS original_path FROM dd""")
def watch_dedup(spark, sf_dir):
    return deduped(spark, sf_dir).select("path", "event_id", "is_duplicate", "original_path")


def _classified_batch(model):
    """Originals get their category, copies pass: what the naming stream reads (J5, first half)."""
    def per_batch(df, batch_id, out_path):
        files = df.select("event_id", "path", "text", "is_duplicate", "original_path", "ts_us")
        classified = nb.classify(model, files.where(~F.col("is_duplicate")).select("event_id", "text"), id_col="event_id")
        return files.drop("text").join(classified.select("event_id", "category"), ["event_id"], "left")
    return per_batch


def _named_stream(classified):
    """Copies as they are, and originals with the name that keyed state gives them."""
    originals = classified.where(~F.col("is_duplicate"))
    wanted = originals.select("event_id", "ts_us", F.concat(F.lit(DEST_ROOT + "/"), "category").alias("dest_dir"),
                              F.element_at(F.split("path", "/"), -1).alias("name"))
    names = watch.allocate_names(wanted)
    return classified.withColumn("final_name", F.lit(None).cast("string")).unionByName(names, allowMissingColumns=True)


def _record_batch(base):
    """Status and history rows of a batch, each into its own folder of the batch."""
    def sink(df, batch_id):
        names = df.where("final_name IS NOT NULL").select("event_id", "final_name")
        files = materialize(df.where("path IS NOT NULL").drop("final_name").join(names, ["event_id"], "left"), "watch-batch")
        none = F.lit(None).cast("string")
        moved = files.where(~F.col("is_duplicate")).select(
            "event_id", "path", F.lit("moved").alias("status"), none.alias("reason"), "category",
            F.concat(F.lit(DEST_ROOT + "/"), "category", F.lit("/"), "final_name").alias("destination_path"),
            F.md5(F.concat_ws(":", F.lit("watch"), F.col("event_id").cast("string"))).alias("run_id"))
        dups = files.where("is_duplicate").select(
            "event_id", "path", F.lit("duplicate").alias("status"), F.concat(F.lit("copy of "), "original_path").alias("reason"),
            none.alias("category"), none.alias("destination_path"), none.alias("run_id"))
        watch.write_batch(moved.unionByName(dups), f"{base}/status", batch_id)
        last = lambda c: F.element_at(F.split(c, "/"), -1)
        write_history(moved.select(
            F.lit(O.HISTORY_SCHEMA_VERSION).alias("schema_version"), "run_id", F.lit(WATCH_TS).alias("timestamp"),
            F.lit("move").alias("action"), F.col("path").alias("source_path"), F.col("destination_path"),
            none.alias("source_hash"), none.alias("destination_hash"), last("path").alias("original_name"),
            last("destination_path").alias("final_name"), F.col("event_id").alias("seq")), f"{base}/history/batch={batch_id}")
        drop_written(files)
    return sink


def _watched(spark, sf_dir):
    """Status and history folders of the stream over all arrivals: classify, then name and record."""
    classified = f"{scratch_path(spark, 'watch-classified')}-{uuid.uuid4().hex}"
    _run(spark, deduped(spark, sf_dir), "watch-classify", lambda s: s, _classified_batch(lang_model(spark, sf_dir)), out=classified)
    base = scratch_path(spark, f"watch-records-{uuid.uuid4().hex}")
    schema = spark.read.parquet(classified).drop("batch").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{classified}/batch=*")
    watch.run_batches(_named_stream(stream), _record_batch(base), f"{base}/ckpt")
    return base


@query("watch_status", lambda: nb_result_sql(docs_sql="SELECT event_id AS doc_id, props AS text FROM events").replace(
    "WITH train", "WITH RECURSIVE train", 1) + ",\n" + _SETTLE_SQL.replace("WITH RECURSIVE ", "", 1) + f""",
moved AS (
  SELECT d.event_id, d.path, r.category, regexp_extract(d.path, '([^/]*)$', 1) AS name, d.ts
  FROM dd d JOIN nb_result r ON r.doc_id = d.event_id WHERE NOT d.is_duplicate),
k AS (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY ts, event_id) - 1 AS k FROM moved)
SELECT event_id, path, 'moved' AS status, CAST(NULL AS VARCHAR) AS reason, category,
       '{DEST_ROOT}/' || category || '/' || CASE WHEN k = 0 THEN name
            ELSE regexp_replace(name, '\\.txt$', '') || '_' || CAST(k AS VARCHAR) || '.txt' END AS destination_path,
       md5('watch:' || CAST(event_id AS VARCHAR)) AS run_id
FROM k
UNION ALL
SELECT event_id, path, 'duplicate', 'copy of ' || first_path, NULL, NULL, NULL FROM dd WHERE is_duplicate
UNION ALL
SELECT event_id, path, 'skipped', CASE WHEN NOT ok_ext THEN 'unsupported type' ELSE 'not a top-level file' END, NULL, NULL, NULL
FROM acc WHERE NOT (ok_ext AND top)""")
def watch_status(spark, sf_dir):
    """A status row per event: moved (each file a run of its own), duplicate, or skipped with its reason."""
    out = spark.read.parquet(f"{_watched(spark, sf_dir)}/status")
    none = F.lit(None).cast("string")
    skipped = filtered(spark, sf_dir).where("not accepted").select(
        "event_id", "path", F.lit("skipped").alias("status"), "reason", none.alias("category"),
        none.alias("destination_path"), none.alias("run_id"))
    return out.select(*skipped.columns).unionByName(skipped)


@query("watch_history", lambda: f"""SELECT event_id AS seq, run_id, 'move' AS action, path AS source_path, destination_path,
       regexp_extract(destination_path, '([^/]*)$', 1) AS final_name
FROM ({ORACLE["watch_status"]}) WHERE status = 'moved'""")
def watch_history(spark, sf_dir):
    """The move records that watch mode writes batch by batch, one run id per file (J5, A7), as they are read back."""
    return read_history(spark, f"{_watched(spark, sf_dir)}/history/batch=*").select(
        "seq", "run_id", "action", "source_path", "destination_path", "final_name")
