"""Watch mode: settle window from the first event, first-seen dedup, path filter."""
import datetime as dt
import uuid

from pyspark.sql import functions as F

from docshelf.session import scratch_path
from docshelf.streaming import watch


def run(spark, df, fn, per_batch=None):
    src = scratch_path(spark, f"t-src-{uuid.uuid4().hex}")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    base = scratch_path(spark, f"t-out-{uuid.uuid4().hex}")
    watch.run_to_table(fn(stream), f"{base}/out", f"{base}/ckpt", per_batch)
    return spark.read.parquet(f"{base}/out")


def marks(spark, df, ttl=None):
    return run(spark, df, lambda s: watch.dedup(s, ttl_seconds=ttl), lambda b, _: watch.attach_firsts(b))


def arrivals(spark, parts, fn, per_batch=None):
    """Run ``fn`` over parts that arrive one after the other, stopping the query in between; rows and progress."""
    base, seen = scratch_path(spark, f"t-parts-{uuid.uuid4().hex}"), []
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
        seen.append(watch.run_to_table(fn(stream), f"{base}/out", f"{base}/ckpt", per_batch))
    return spark.read.parquet(f"{base}/out").collect(), seen


def state_rows(progress):
    return progress[-1]["stateOperators"][0]["numRowsTotal"]


def test_settle_window_is_fixed_at_first_event(spark):
    t0 = dt.datetime(2026, 1, 1)
    secs = [0.0, 1.0, 1.9, 2.5, 4.0, 4.4, 10.0]       # windows open at 0, 2.5, 10 (4.0 < 2.5 + 2)
    rows = [("w/a.txt", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "path string, event_id long, ts timestamp")
    out = run(spark, df, lambda s: watch.settle(s, 2.0))
    assert sorted(r["event_id"] for r in out.collect()) == [0, 3, 6]


def test_dedup_first_seen(spark):
    rows = [("h1", "w/a.txt", 1, 10), ("h1", "w/b.txt", 2, 20), ("h2", "w/c.txt", 3, 5), ("h1", "w/d.txt", 4, 30)]
    df = spark.createDataFrame(rows, "content_hash string, path string, event_id long, ts_us long")
    out = {r["event_id"]: r for r in marks(spark, df).collect()}
    assert not out[1]["is_duplicate"] and out[2]["original_path"] == "w/a.txt" and out[4]["is_duplicate"]
    assert not out[3]["is_duplicate"]


def test_filter(spark):
    rows = [("watch/a.txt", False), ("watch/sub/b.txt", False), ("watch/c.bmp", False), ("watch/D.PDF", False),
            ("watch/dir", True)]
    df = spark.createDataFrame(rows, "path string, is_directory boolean").withColumn("ts", F.current_timestamp())
    got = {r["path"]: r["accepted"] for r in watch.filter_events(df, "watch").collect()}
    assert got == {"watch/a.txt": True, "watch/sub/b.txt": False, "watch/c.bmp": False, "watch/D.PDF": True}


def test_folder_source_skips_files_present_before_start(spark, tmp_path):
    import os
    import time

    root = tmp_path / "inbox"
    root.mkdir()
    (root / "old.txt").write_text("old")
    os.utime(root / "old.txt", (time.time() - 3600, time.time() - 3600))
    (root / "new.txt").write_text("new")
    start = dt.datetime.fromtimestamp(time.time() - 600, tz=dt.timezone.utc).replace(tzinfo=None)
    events = watch.folder_events(spark, str(root), start=start)
    base = scratch_path(spark, f"t-folder-{uuid.uuid4().hex}")
    watch.run_to_table(watch.filter_events(events, str(root)), f"{base}/out", f"{base}/ckpt")
    got = {os.path.basename(r["path"]): r["accepted"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {"new.txt": True}


def test_dedup_with_ttl_runs(spark):
    hour = 3_600_000_000
    rows = [("h1", "w/a.txt", 1, 10), ("h1", "w/b.txt", 2, 20), ("h1", "w/c.txt", 3, 2 * hour)]
    df = spark.createDataFrame(rows, "content_hash string, path string, event_id long, ts_us long")
    out = marks(spark, df, 3600)
    assert sorted((r["event_id"], r["is_duplicate"]) for r in out.collect()) == [(1, False), (2, True), (3, False)]


def test_default_start_takes_files_written_after_it(spark, tmp_path):
    import os

    root = tmp_path / "inbox"
    root.mkdir()
    (root / "old.txt").write_text("old")
    os.utime(root / "old.txt", (1_000_000_000, 1_000_000_000))
    events = watch.folder_events(spark, str(root))
    (root / "new.txt").write_text("new")
    base = scratch_path(spark, f"t-start-{uuid.uuid4().hex}")
    watch.run_to_table(events, f"{base}/out", f"{base}/ckpt")
    assert [os.path.basename(r["path"]) for r in spark.read.parquet(f"{base}/out").collect()] == ["new.txt"]


def test_settle_state_falls_once_the_window_has_passed(spark):
    t0 = dt.datetime(2026, 1, 1)
    part = lambda lo, hi: spark.createDataFrame(
        [(f"w/{i}.txt", i, t0 + dt.timedelta(seconds=60 * i)) for i in range(lo, hi)], "path string, event_id long, ts timestamp")
    rows, seen = arrivals(spark, [part(0, 40), part(40, 80), part(80, 82)], lambda s: watch.settle(s, 2.0))
    assert sorted(r["event_id"] for r in rows) == list(range(82))
    assert [state_rows(p) for p in seen][-1] <= 4          # windows of 80 paths have passed


def test_dedup_over_restarts_with_a_hot_hash_and_expiry(spark):
    hour = 3_600_000_000
    ddl = "content_hash string, path string, event_id long, ts_us long"
    parts = [[("hot", f"w/{i}", i, i) for i in range(300)] + [(f"h{i}", f"w/{i}", 1000 + i, i) for i in range(50)],
             [("hot", f"w/{i}", i, hour + i) for i in range(300, 500)] + [("h1", "w/x", 2000, 2 * hour)],
             [("h1", "w/y", 2001, 5 * hour), ("hot", "w/z", 2002, 5 * hour + 1)], [("h9", "w/v", 2003, 9 * hour)]]
    frames = [spark.createDataFrame([(*x[:3], x[3] + 1000 * hour) for x in p], ddl) for p in parts]
    got, _ = arrivals(spark, frames, watch.dedup, lambda b, _: watch.attach_firsts(b))
    by = {r["event_id"]: (r["is_duplicate"], r["original_path"]) for r in got}
    assert len(by) == 554 and by[0] == (False, None) and all(by[i] == (True, "w/0") for i in [*range(1, 500), 2002])
    assert by[2000] == by[2001] == (True, "w/1") and by[1049] == (False, None) and by[2003] == (True, "w/9")
    got, seen = arrivals(spark, frames, lambda s: watch.dedup(s, 1.5 * 3600), lambda b, _: watch.attach_firsts(b))
    by = {r["event_id"]: (r["is_duplicate"], r["original_path"]) for r in got}
    assert by[499] == (True, "w/0") and by[2000] == (False, None) and by[2001] == (False, None) and by[2002] == (False, None)
    assert state_rows(seen[0]) >= 51 and state_rows(seen[-1]) <= 6


def test_runs():
    import random

    r = random.Random(2)
    for _ in range(200):
        runs, taken = watch.Runs([], []), set()
        for n in r.choices(range(12), k=r.randrange(0, 25)):
            runs.add(n)
            taken.add(n)
        assert [n in runs for n in range(14)] == [n in taken for n in range(14)]
        assert all(runs.free_from(n) == min(x for x in range(n, 40) if x not in taken) for n in range(14))
        assert all(e + 1 < s for e, s in zip(runs.ends, runs.starts[1:]))


def test_names_over_batches_follow_the_sequential_rule(spark):
    import random

    from .test_naming import sequential

    r = random.Random(6)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "b", "b_1", "a_10.txt", ".env"]
    reqs = [(i, r.choice(["X", "Y"]), r.choice(names)) for i in range(400)]
    parts = [spark.createDataFrame([(i, i, d, n) for i, d, n in reqs[a:a + 150]], "event_id long, ts_us long, dest_dir string, name string")
             for a in range(0, 400, 150)]
    got, seen = arrivals(spark, parts, watch.allocate_names)
    assert {x["event_id"]: x["final_name"] for x in got} == sequential(reqs, [])
    assert state_rows(seen[-1]) <= 2 * len(names)          # runs, not one row per name given


def test_replayed_batch_gives_the_same_records(spark):
    from docshelf.plans.q_stream import _record_batch
    from docshelf.sources.history import read_history

    ddl = "event_id long, path string, is_duplicate boolean, original_path string, ts_us long, category string, final_name string"
    rows = [(1, "w/a.txt", False, None, 1, "en", None), (2, "w/b.txt", True, "w/a.txt", 2, None, None), (1, None, None, None, None, None, "a_1.txt")]
    later = [(3, "w/c.txt", False, None, 3, "de", None), (3, None, None, None, None, None, "c.txt")]
    base = scratch_path(spark, f"t-records-{uuid.uuid4().hex}")
    sink = _record_batch(base)

    def seen():
        status = spark.read.parquet(f"{base}/status").drop("batch").collect()
        return sorted(map(repr, status)), sorted(map(repr, read_history(spark, f"{base}/history/batch=*").collect()))

    sink(spark.createDataFrame(rows, ddl), 0)
    first = seen()
    sink(spark.createDataFrame(rows, ddl), 0)
    assert seen() == first and len(first[0]) == 2 and len(first[1]) == 1
    sink(spark.createDataFrame(later, ddl), 1)
    both = seen()
    sink(spark.createDataFrame(later, ddl), 1)
    assert seen() == both and [len(x) for x in both] == [3, 2]
