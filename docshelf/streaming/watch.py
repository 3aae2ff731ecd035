"""Watch mode as Structured Streaming.

* J1 arrival source: any streaming DataFrame of ``(ts, event_type, path,
  is_directory)``; for folders, ``readStream.format('binaryFile')`` with a
  ``modificationTime >= start`` filter (Spark also lists files present at
  start, the watcher does not).
* J2 event filter: supported suffix and exactly one path part below the root.
* J3 settle: the first event of a path opens a delay window; later events of
  that path inside the window are ignored. This is a window fixed at the
  first event (a session window would be extended by each event), so it is
  keyed state: ``transformWithState`` per path holds the window end, and an event-time
  timer drops it once the watermark has passed it.
* J4 dedup: a streaming aggregation keeps the first file of a content hash. It is partial in each task
  before the shuffle, so a hash with a third of all events is one small row per task; duplicates are
  attached to the rows of the batch by a salted join. State never expires unless a TTL is given (the watcher's memory
  never forgets either); with one, ``transformWithState`` holds it and an event-time timer drops it.
* J5/J6: ``foreachBatch`` classifies the originals; names are given by a second keyed
  stream whose state holds the taken numbers of each name as runs, so a batch reads and
  writes only the state of its own names, however old the stream is. Status rows and history rows
  of a batch are written together, one folder per ``batch_id`` each (overwritten on replay).

Keyed state lives in Spark's RocksDB state store: state beyond memory stays on disk, and each batch
writes its changes to the checkpoint folder.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.text import extension
from ..operators.skew import salted_lookup
from ..options import SUPPORTED_EXTENSIONS, WATCH_SETTLE_SECONDS

WATCH_EVENT_SCHEMA = "ts timestamp, event_type string, path string, is_directory boolean"


def folder_events(spark, root: str, start=None, recursive: bool = True) -> DataFrame:
    """J1 for a real folder: a ``binaryFile`` stream of arrivals as watch events.

    Spark lists files already present when the query starts; the watcher
    does not process those, so rows older than ``start`` are dropped. The
    default is the instant of this call, fixed for all batches; a restarted
    query passes the instant it kept with its checkpoint. Content is not
    selected here.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("recursiveFileLookup", str(recursive).lower()).load(root)
    )
    if start is None:
        now = datetime.now(timezone.utc)
        start = now.replace(microsecond=now.microsecond // 1000 * 1000)     # file times are milliseconds
    start_col = F.lit(start).cast("timestamp")
    return stream.where(F.col("modificationTime") >= start_col).select(
        F.col("modificationTime").alias("ts"), F.lit("created").alias("event_type"),
        F.regexp_replace("path", "^file:", "").alias("path"), F.lit(False).alias("is_directory"))


def accept(path: str, root: str, extensions: list[str] = SUPPORTED_EXTENSIONS):
    """``(accepted, reason)`` columns for watch events."""
    p = F.col(path)
    prefix = root.rstrip("/") + "/"
    rel = F.when(p.startswith(prefix), F.expr(f"substring({path}, {len(prefix) + 1})"))
    top = rel.isNotNull() & ~rel.contains("/") & (F.length(rel) > 0)
    ok_ext = extension(p).isin(*[e.lower() for e in extensions])
    reason = (F.when(~ok_ext, F.lit("unsupported type"))
              .when(~top, F.lit("not a top-level file")).otherwise(F.lit(None).cast("string")))
    return (ok_ext & top).alias("accepted"), reason.alias("reason")


def filter_events(events: DataFrame, root: str) -> DataFrame:
    """J1 + J2: file events (no directories) with an ``accepted`` flag and a reason."""
    acc, reason = accept("path", root)
    return events.where(~F.coalesce(F.col("is_directory"), F.lit(False))).select("*", acc, reason)


STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a batch uploads its changes, not whole files of the store
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # passed windows are dropped with the next arrivals; no batch of its own for that
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _keyed(grouped, processor: StatefulProcessor, schema: str, mode: str = "update", time: str = "EventTime") -> DataFrame:
    """``transformWithState``; it needs the RocksDB state store."""
    return grouped.transformWithState(processor, schema, mode, time)


class _Settle(StatefulProcessor):
    """One long per path: the end of its window. The state goes once the watermark is past it."""

    def __init__(self, delay_us: int):
        self.delay_us = delay_us

    def init(self, handle) -> None:
        self.handle, self.window = handle, handle.getValueState("window", "window_end long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.window.get()
        end = before = known[0] if known else None
        for ts_us, event_id in sorted((r.ts_us, r.event_id) for r in rows):
            if end is None or ts_us > end:
                end = ts_us + self.delay_us
                yield Row(path=key[0], event_id=event_id, ts_us=ts_us)
        if end != before:
            self.window.update((end,))
            self.handle.registerTimer(-(-end // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.window.get()
        if known and -(-known[0] // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def settle(events: DataFrame, delay_seconds: float = WATCH_SETTLE_SECONDS) -> DataFrame:
    """First event per path per delay window: ``(path, event_id, ts_us)``.

    ``events(path, event_id, ts)``. A path's state is one long and is dropped when its window has passed:
    the watermark is the newest event time less the delay, and events older than that are ignored like any that
    fall into a passed window. Per path, two longs per event of a batch are held at once.
    """
    delay_us = int(round(delay_seconds * 1_000_000))
    keyed = (events.select("path", "event_id", "ts", F.unix_micros(F.col("ts")).alias("ts_us"))
             .withWatermark("ts", f"{max(1, -(-delay_us // 1000))} milliseconds"))
    return _keyed(keyed.groupBy("path"), _Settle(delay_us), "path string, event_id long, ts_us long")


class _Firsts(StatefulProcessor):
    """The first file of a hash. Emits the files that rows of the batch may be copies of, in order."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "ts_us long, event_id long, path string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.first.get()
        last = tuple(known) if known else None
        found = [last] if last else []
        for r in sorted((r.ts_us, r.event_id, r.path) for r in rows):
            if not found or r[0] - found[-1][0] > self.ttl_us:
                found.append(r)
        if found[-1] != last:
            self.first.update(found[-1])
            self.handle.registerTimer(-(-(found[-1][0] + self.ttl_us) // 1000))
        for ts_us, event_id, path in found:
            yield Row(content_hash=key[0], ts_us=ts_us, event_id=event_id, path=path)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.first.get()
        if known and -(-(known[0] + self.ttl_us) // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def dedup(files: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """J4 as a stream: the rows of ``files`` and, flagged ``_first``, the first files of their hashes.

    ``files(content_hash, path, event_id, ts_us, ...)``; run it in update mode (:func:`run_batches` does), where
    :func:`attach_firsts` turns a batch into marked rows. The first file of a hash is the earliest of the first batch
    that held one (a batch's timestamp is kept with its offsets, so a replay decides alike). The default, like the
    watcher, never forgets: that is a streaming aggregation, partial in each task before the shuffle. With
    ``ttl_seconds`` a hash is forgotten once an event arrives that much (event time) after its first file; its state is
    dropped when the watermark (newest event time less the TTL) has passed that, and an event that is later still is an original.
    """
    keys = files.select("content_hash", "path", "event_id", "ts_us")
    if ttl_seconds is None:
        seen = keys.withColumn("seen", F.struct(F.current_timestamp().alias("arrived"), "ts_us", "event_id", "path"))
        firsts = seen.groupBy("content_hash").agg(F.min("seen").alias("f")).select("content_hash", "f.ts_us", "f.event_id", "f.path")
    else:
        ttl_us = int(ttl_seconds * 1_000_000)
        keys = keys.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", f"{max(1, -(-ttl_us // 1000))} milliseconds")
        firsts = _keyed(keys.groupBy("content_hash"), _Firsts(ttl_us),
                        "content_hash string, ts_us long, event_id long, path string")
    return files.withColumn("_first", F.lit(False)).unionByName(firsts.withColumn("_first", F.lit(True)), allowMissingColumns=True)


def attach_firsts(batch: DataFrame, buckets: int = 16) -> DataFrame:
    """The rows of a batch of :func:`dedup` with ``is_duplicate`` and ``original_path`` (salted join by hash)."""
    rows = batch.where("NOT _first").drop("_first")
    firsts = batch.where("_first").groupBy("content_hash").agg(
        F.sort_array(F.collect_list(F.struct("ts_us", "event_id", "path"))).alias("_firsts"))
    marked = salted_lookup(rows, firsts, ["content_hash"], ["event_id"], buckets, "left")
    own = F.struct("ts_us", "event_id", "path")
    before = F.filter("_firsts", lambda f: f <= own)
    mine = F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at("_firsts", F.lit(1)))
    marked = marked.withColumn("_mine", mine)
    copy = F.coalesce(F.col("_mine.event_id") != F.col("event_id"), F.lit(False))
    return marked.withColumn("is_duplicate", copy).withColumn("original_path", F.when(copy, F.col("_mine.path"))).drop("_firsts", "_mine")


class Runs:
    """Taken numbers of a name as sorted disjoint runs ``[start, end]``; 0 stands for the name itself."""

    def __init__(self, starts: list[int], ends: list[int]):
        self.starts, self.ends = starts, ends

    def __contains__(self, n: int) -> bool:
        i = bisect_right(self.starts, n) - 1
        return i >= 0 and n <= self.ends[i]

    def free_from(self, n: int) -> int:
        i = bisect_right(self.starts, n) - 1
        return self.ends[i] + 1 if i >= 0 and n <= self.ends[i] else n

    def add(self, n: int) -> None:
        i = bisect_right(self.starts, n) - 1
        if i >= 0 and n <= self.ends[i]:
            return
        after = i + 1 < len(self.starts) and self.starts[i + 1] == n + 1
        if i >= 0 and self.ends[i] == n - 1:
            self.ends[i] = self.ends[i + 1] if after else n
            if after:
                del self.starts[i + 1], self.ends[i + 1]
        elif after:
            self.starts[i + 1] = n
        else:
            self.starts.insert(i + 1, n)
            self.ends.insert(i + 1, n)


def name_form(name: str, sep: str = "_") -> tuple[str, str, str | None, int]:
    """``stem, suffix, parent, number``: a numbered form (canonical number) has a parent name, others None and 0."""
    m = re.search(r"(?s)^.+(\.[^.]+)\Z", name)
    sfx = m.group(1) if m else ""
    stem = name[:len(name) - len(sfx)]
    tail = re.search(rf"(?s)^(.*){re.escape(sep)}([1-9][0-9]{{0,17}})\Z", stem)
    if tail is None or (sfx and not tail.group(1)):
        return stem, sfx, None, 0
    return stem, sfx, tail.group(1) + sfx, int(tail.group(2))


class _Names(StatefulProcessor):
    """Names taken in one family of a folder: per name, the runs of numbers taken below it."""

    def __init__(self, sep: str):
        self.sep = sep

    def init(self, handle) -> None:
        self.runs = handle.getMapState("runs", "name string", "runs string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held: dict[str, Runs] = {}

        def runs(name: str) -> Runs:
            if name not in held:
                known = self.runs.getValue((name,))
                held[name] = Runs(*(json.loads(known[0]) if known else ([], [])))
            return held[name]

        touched = set()
        for _, event_id, name in sorted((r.ts_us, r.event_id, r.name) for r in rows):
            stem, sfx, parent, number = name_form(name, self.sep)
            if 0 not in runs(name) and (parent is None or number not in runs(parent)):
                final = name
                runs(name).add(0)
                if parent is not None:
                    runs(parent).add(number)
                    touched.add(parent)
            else:
                k = runs(name).free_from(1)
                runs(name).add(k)
                final = f"{stem}{self.sep}{k}{sfx}"
            touched.add(name)
            yield Row(event_id=event_id, final_name=final)
        for name in touched:
            self.runs.updateValue((name,), (json.dumps([held[name].starts, held[name].ends]),))

    def close(self) -> None:
        pass


def allocate_names(files: DataFrame, dir_col: str = "dest_dir", name_col: str = "name", sep: str = "_") -> DataFrame:
    """``(event_id, final_name)`` of a stream ``files(event_id, ts_us, dir, name)`` in time order, batch after batch.

    The sequential rule of :mod:`docshelf.operators.naming`, keyed by folder and family (name without numbered tails);
    the state of a name is the runs of numbers taken, so a long row of copies is one run.
    """
    name = F.col(name_col)
    sfx = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)
    root = F.regexp_replace(name.substr(F.lit(1), F.length(name) - F.length(sfx)), f"(?:{re.escape(sep)}[1-9][0-9]{{0,17}})+\\z", "")
    keyed = files.select("event_id", "ts_us", name.alias("name"), F.col(dir_col).alias("dir"), F.concat(root, F.lit("/"), sfx).alias("family"))
    return _keyed(keyed.groupBy("dir", "family"), _Names(sep), "event_id long, final_name string", time="None")


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """One folder per batch: a replayed batch replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> list[dict]:
    """Run what has arrived (``availableNow``) through ``sink(batch, batch_id)``; the progress of each batch."""
    conf = stream.sparkSession.conf
    before = {key: conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        conf.set(key, value)
    try:
        q = (stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)
    if q.exception() is not None:
        raise q.exception()
    return [json.loads(p.json) for p in q.recentProgress]


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str,
                 per_batch: Callable[[DataFrame, int], DataFrame] | None = None) -> list[dict]:
    """Run a stream with ``availableNow`` into ``out_path/batch=<id>`` (idempotent per batch).

    ``per_batch(df, batch_id)`` may transform each micro-batch (J5).
    """
    return run_batches(stream, lambda df, batch_id: write_batch(per_batch(df, batch_id) if per_batch else df, out_path, batch_id),
                       checkpoint)
