"""History reading and undo planning."""
import json
import os
import tempfile

from docshelf.operators import undo
from docshelf.sources.history import read_history, read_legacy_log

REC = dict(schema_version=1, timestamp="2026-01-01T00:00:00+00:00", source_hash="h", destination_hash="h")


def write_lines(lines):
    d = tempfile.mkdtemp(prefix="docshelf-hist-")
    with open(os.path.join(d, "history.jsonl"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def rec(seq, run, action, src, dst, **kw):
    r = dict(REC, seq=seq, run_id=run, action=action, source_path=src, destination_path=dst,
             original_name=src.rsplit("/", 1)[-1], final_name=dst.rsplit("/", 1)[-1])
    r.update(kw)
    return json.dumps(r, sort_keys=True)


def test_broken_lines_and_versions_skipped(spark):
    path = write_lines([rec(1, "run-1", "move", "a/x.txt", "b/x.txt"), "{bad json}", "", "[1, 2]",
                        rec(2, "run-1", "move", "a/y.txt", "b/y.txt", schema_version=2)])
    got = read_history(spark, path).collect()
    assert [r["seq"] for r in got] == [1]


def test_latest_run_and_order(spark):
    path = write_lines([rec(1, "run-1", "move", "a/1.txt", "b/1.txt"), rec(2, "run-2", "move", "a/2.txt", "b/2.txt"),
                        rec(3, "run-1", "move", "a/3.txt", "b/3.txt")])
    h = read_history(spark, path)
    assert undo.latest_run(h).first()["run_id"] == "run-1"
    recs = undo.records_to_undo(h).orderBy("undo_order").collect()
    assert [r["seq"] for r in recs] == [3, 1]
    order = undo.run_ids_in_order(h).orderBy("position").collect()
    assert [r["run_id"] for r in order] == ["run-1", "run-2"]


def test_chain_changed_and_collision(spark):
    path = write_lines([
        rec(1, "r", "rename", "in/invoice.txt", "in/Invoice_2026.txt"),
        rec(2, "r", "move", "in/Invoice_2026.txt", "out/Finance/Invoice_2026.txt"),
        rec(3, "r", "move", "in/notes.txt", "out/Other/notes.txt", destination_hash="old"),
        rec(4, "r", "move", "in/gone.txt", "out/Other/gone.txt"),
    ])
    h = read_history(spark, path)
    inv = spark.createDataFrame([("out/Finance/Invoice_2026.txt", "h"), ("out/Other/notes.txt", "new")],
                                "path string, md5 string")
    occ = spark.createDataFrame([("in/invoice.txt",)], "path string")
    plan = {r["head_seq"]: r for r in undo.undo_plan(h, inv, occ).collect()}
    assert plan[1]["steps"] == 2 and plan[1]["decision"] == "restore"
    assert plan[1]["restore_path"] == "in/invoice_restored_1.txt"
    assert plan[3]["decision"] == "skipped_changed"
    assert plan[4]["decision"] == "skipped_missing"
    stats = undo.undo_stats(undo.undo_plan(h, inv, occ)).first()
    assert (stats["found"], stats["restored"], stats["skipped"], stats["errors"]) == (4, 2, 2, 0)


def test_legacy_log_line(spark):
    d = tempfile.mkdtemp(prefix="docshelf-log-")
    with open(os.path.join(d, "organizer.log"), "w") as f:
        f.write("2026-01-01 10:00:00,001 | INFO | utils | Moved 'invoice.txt' -> '/t/Finance/invoice.txt'\n")
        f.write("2026-01-01 10:00:01,000 | INFO | organizer | something else\n")
    moves = read_legacy_log(spark, d).collect()
    assert [(m["filename"], m["dest"]) for m in moves] == [("invoice.txt", "/t/Finance/invoice.txt")]
    inv = spark.createDataFrame([("/t/Finance/invoice.txt", None)], "path string, md5 string")
    plan = undo.legacy_plan(read_legacy_log(spark, d), "/t", inv).first()
    assert plan["restore_path"] == "/t/invoice.txt" and plan["decision"] == "restore"


def history(spark, moves):
    return read_history(spark, write_lines([rec(k, "r", "move", a, b) for k, (a, b) in enumerate(moves)]))


def test_long_chain_is_followed_to_its_end(spark):
    got = undo.resolve_chains(history(spark, [(f"p{k}", f"p{k + 1}") for k in range(100)] + [("q0", "q1")])).collect()
    assert {(r["original_path"], r["final_path"], r["steps"]) for r in got} == {("p0", "p100", 100), ("q0", "q1", 1)}


def test_path_filled_twice_gives_two_chains(spark):
    got = undo.resolve_chains(history(spark, [("A", "B"), ("X", "B"), ("B", "C")])).collect()
    assert {(r["original_path"], r["final_path"], r["steps"]) for r in got} == {("X", "C", 2), ("A", "B", 1)}


def test_path_left_twice_goes_on_once(spark):
    got = undo.resolve_chains(history(spark, [("A", "B"), ("B", "C"), ("B", "D")])).collect()
    assert {(r["original_path"], r["final_path"], r["steps"]) for r in got} == {("A", "C", 2), ("B", "D", 1)}


def test_legacy_names_do_not_collide(spark):
    moves = spark.createDataFrame([("2026-01-01 10:00:00,001", "a.txt", "/t/X/a.txt"), ("2026-01-01 10:00:00,002", "a.txt", "/t/Y/a.txt"),
                                   ("2026-01-01 10:00:00,003", "b.txt", "/t/X/b.txt")], "logged_at string, filename string, dest string")
    inv = spark.createDataFrame([("/t/X/a.txt", None), ("/t/Y/a.txt", None)], "path string, md5 string")
    occ = spark.createDataFrame([("/t/a.txt",)], "path string")
    got = {r["dest"]: r["restore_path"] for r in undo.legacy_plan(moves, "/t", inv, occ).collect()}
    assert got == {"/t/Y/a.txt": "/t/a_restored_1.txt", "/t/X/a.txt": "/t/a_restored_2.txt", "/t/X/b.txt": None}


def test_lines_without_order_and_with_other_keys(spark):
    bare = [json.loads(rec(0, "r", a, f"in/{k}", f"out/{k}")) for k, a in enumerate(["move", "copy", "move"])]
    for b in bare:
        del b["seq"]
    strange = dict(json.loads(rec(9, "r", "move", "in/z", "out/z")), colour="red")
    path = write_lines([rec(5, "r", "move", "in/first", "out/first"), *map(json.dumps, bare), json.dumps(strange)])
    got = [(r["seq"], r["source_path"]) for r in read_history(spark, path).orderBy("seq").collect()]
    assert got == [(5, "in/first"), (6, "in/0"), (7, "in/1"), (8, "in/2")]
