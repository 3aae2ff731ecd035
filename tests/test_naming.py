"""Destination names: distributed plan equals the sequential rule."""
import random

from docshelf.functions.ordinal import with_group_row_number, with_row_number
from docshelf.operators import naming


def sequential(requests, existing, sep="_"):
    """The rule itself: each file takes its name if free, else stem_1, stem_2, ..."""
    from pathlib import PurePosixPath

    taken = set(existing)
    out = {}
    for rid, d, name in requests:
        p = PurePosixPath(name)
        cand, k = (d, name), 1
        while cand in taken:
            cand = (d, f"{p.stem}{sep}{k}{p.suffix}")
            k += 1
        taken.add(cand)
        out[rid] = cand[1]
    return out


def test_plan_matches_sequential(spark):
    rng = random.Random(7)
    names = ["a.txt", "a.txt", "a_1.txt", "b.pdf", "b.PDF", "c", "c", "a_1_1.txt", "d.tar.gz", "d.tar.gz", ".env"]
    reqs = [(i, rng.choice(["X", "Y"]), rng.choice(names)) for i in range(120)]
    existing = [("X", "a.txt"), ("Y", "b_2.pdf"), ("X", "c")]
    df = spark.createDataFrame(reqs, "rid bigint, dest_dir string, name string")
    ex = spark.createDataFrame(existing, "dest_dir string, name string")
    got = {r["rid"]: r["final_name"] for r in naming.plan_names(df, ex, order_cols=["rid"]).collect()}
    assert got == sequential(reqs, existing)


def test_hot_name_fast_path(spark):
    reqs = [(i, "D", "the.txt") for i in range(500)]
    df = spark.createDataFrame(reqs, "rid bigint, dest_dir string, name string").repartition(7)
    got = {r["rid"]: r["final_name"] for r in naming.plan_names(df, None, order_cols=["rid"]).collect()}
    assert got[0] == "the.txt" and got[1] == "the_1.txt" and got[499] == "the_499.txt"


def test_restore_collision(spark):
    moves = spark.createDataFrame([("root/invoice.txt", 2), ("root/notes.txt", 1)], "source_path string, seq bigint")
    occ = spark.createDataFrame([("root/invoice.txt",)], "path string")
    got = {r["source_path"]: r["restore_path"] for r in naming.restore_plan(moves, occ, ["seq"]).collect()}
    assert got == {"root/invoice.txt": "root/invoice_restored_1.txt", "root/notes.txt": "root/notes.txt"}


def test_ordinals_match_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = [(i, f"g{i % 3 if i < 300 else 9}", (i * 37) % 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, g string, o bigint").repartition(5)
    ref = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    got = with_group_row_number(df, ["g"], ["o", "id"], "rn").join(ref, ["id", "g", "o"])
    assert got.where("rn <> want").count() == 0
    glob = with_row_number(df, ["o", "id"], "rn").join(
        df.withColumn("want", F.row_number().over(Window.orderBy("o", "id"))), ["id", "g", "o"])
    assert glob.where("rn <> want").count() == 0


def test_override_moves_only_its_file(spark):
    from docshelf.operators.organise import apply_overrides, override_records

    rows = [(k, f"in/{k}", "a.txt", f"root/X/{n}", "X", 50.0, True, "h") for k, n in enumerate(["a.txt", "a_1.txt", "a_2.txt"], 1)]
    rows.append((4, "in/4", "b.txt", "root/Y/a_1.txt", "Y", 50.0, False, "h"))
    before = spark.createDataFrame(rows, "doc_id bigint, path string, new_name string, dest_path string, category string, "
                                         "confidence_pct double, is_low boolean, content_hash string")
    overrides = spark.createDataFrame([("in/2", "Y"), ("in/4", "Y")], "path string, override_category string")
    after = apply_overrides(before, overrides, "root")
    got = {r["doc_id"]: (r["category"], r["dest_path"], r["is_low"], r["overridden"]) for r in after.collect()}
    assert got == {1: ("X", "root/X/a.txt", True, False), 2: ("Y", "root/Y/a_1_1.txt", False, True),
                   3: ("X", "root/X/a_2.txt", True, False), 4: ("Y", "root/Y/a_1.txt", False, True)}
    moved = override_records(before, after, "r", "t").collect()
    assert [(m["source_path"], m["destination_path"]) for m in moved] == [("root/X/a_1.txt", "root/Y/a_1_1.txt")]


def test_numbered_families_match_sequential(spark):
    """Explicit numbers in any order, nested tails, existing names: the rule itself, over many folders."""
    rng = random.Random(11)
    stems = ["a", "a_1", "a_2", "a_3", "a_1_1", "a_1_2", "a_2_1", "a_01", "a_0", "b_10", "b", "_1", "a_1_1_1"]
    reqs, existing = [], []
    for f in range(60):
        weights = [rng.random() ** 2 for _ in stems]
        for _ in range(rng.randrange(1, 40)):
            reqs.append((f"F{f}", rng.choices(stems, weights)[0] + rng.choice(["", ".txt", ".txt"])))
        existing += [(f"F{f}", rng.choice(stems) + ".txt") for _ in range(rng.randrange(0, 4))]
    rng.shuffle(reqs)
    reqs = [(i, d, n) for i, (d, n) in enumerate(reqs)]
    df = spark.createDataFrame(reqs, "rid bigint, dest_dir string, name string").repartition(5)
    for ex in (None, spark.createDataFrame(existing, "dest_dir string, name string")):
        got = {r["rid"]: r["final_name"] for r in naming.plan_names(df, ex, order_cols=["rid"]).collect()}
        want = sequential(reqs, existing if ex is not None else [])
        assert {k: v for k, v in got.items() if v != want[k]} == {}
        assert len(got) == len(reqs)


def test_hot_family_with_explicit_numbers_spans_tasks(spark):
    """A third of all rows in one family, plain and numbered requests mixed, beside existing numbers."""
    rng = random.Random(5)
    names = ["the.txt"] * 700 + [f"the_{k}.txt" for k in rng.sample(range(1, 900), 500)] + ["the_7.txt"] * 20
    names += [f"w{k}.txt" for k in range(2400)]
    rng.shuffle(names)
    reqs = [(i, "D", n) for i, n in enumerate(names)]
    existing = [("D", f"the_{k}.txt") for k in rng.sample(range(1, 1500), 200)] + [("D", "w5.txt")]
    df = spark.createDataFrame(reqs, "rid bigint, dest_dir string, name string").repartition(8)
    ex = spark.createDataFrame(existing, "dest_dir string, name string")
    got = {r["rid"]: r["final_name"] for r in naming.plan_names(df, ex, order_cols=["rid"]).collect()}
    assert got == sequential(reqs, existing)


def test_names_with_other_separators_dots_and_nulls(spark):
    names = ["a.", "a.", "a._1", "a.", ".env", ".env", ".env_1", "x_restored_1", "x", "x", "x", "", "", "_1", "日本.txt", "日本.txt", "日本_1.txt"]
    reqs = [(i, "D", n) for i, n in enumerate(names)]
    df = spark.createDataFrame([*reqs, (98, None, "x"), (99, "D", None)], "rid bigint, dest_dir string, name string")
    for sep in ("_", "_restored_"):
        got = {r["rid"]: r["final_name"] for r in naming.plan_names(df, None, order_cols=["rid"], sep=sep).collect()}
        assert got.pop(98) is None and got.pop(99) is None
        want = sequential_parts(reqs, sep)
        assert got == want
    assert naming.plan_names(df.limit(0), df.limit(0), order_cols=["rid"]).count() == 0


def sequential_parts(reqs, sep):
    """As ``sequential``, with the suffix rule of the library (a name that ends in a dot has none)."""
    import re

    taken, out = set(), {}
    for rid, d, name in reqs:
        m = re.search(r"(?s)^.+(\.[^.]+)\Z", name)
        sfx = m.group(1) if m else ""
        stem_, cand, k = name[:len(name) - len(sfx)], name, 1
        while cand in taken:
            cand, k = f"{stem_}{sep}{k}{sfx}", k + 1
        taken.add(cand)
        out[rid] = cand
    return out
