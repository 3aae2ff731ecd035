"""Duplicate detection semantics (first seen is the original; null never duplicates)."""
from docshelf.operators import dedup


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, path string, text string")


def test_pair_and_null(spark):
    df = dedup.with_content_hash(files(spark, [(1, "a.txt", "same"), (2, "b.txt", "same"), (3, "c.txt", "other"),
                                               (4, "d.txt", None)]))
    out = {r["doc_id"]: r for r in dedup.mark_duplicates(df).collect()}
    assert len(out[1]["content_hash"]) == 32
    assert not out[1]["is_duplicate"] and out[1]["original_path"] is None
    assert out[2]["is_duplicate"] and out[2]["original_path"] == "a.txt"
    assert not out[3]["is_duplicate"]
    assert not out[4]["is_duplicate"] and out[4]["content_hash"] is None
    kept = sorted(r["doc_id"] for r in dedup.keep_originals(df).collect())
    assert kept == [1, 3, 4]


def test_groups_in_seen_order(spark):
    rows = [(i, f"f{i}.txt", "x" if i % 2 else "y") for i in range(1, 7)] + [(7, "f7.txt", "z")]
    df = dedup.with_content_hash(files(spark, rows))
    g = dedup.duplicate_groups(df).orderBy("content_hash", "doc_id").collect()
    assert len(g) == 6
    firsts = {r["original_path"] for r in g}
    assert firsts == {"f1.txt", "f2.txt"}
    assert all(r["n_copies"] == 3 for r in g)


def test_hot_hash_is_salted(spark):
    # one hash shared by most rows: result still exact
    rows = [(i, f"p{i}", "hot") for i in range(200)] + [(1000, "q", "cold")]
    out = dedup.mark_duplicates(dedup.with_content_hash(files(spark, rows)), salt_buckets=8)
    dups = out.where("is_duplicate").collect()
    assert len(dups) == 199 and {r["original_path"] for r in dups} == {"p0"}


def test_registry_and_reset(spark):
    prev = dedup.with_content_hash(files(spark, [(1, "old.txt", "same")]))
    batch = dedup.with_content_hash(files(spark, [(5, "new.txt", "same"), (6, "n2.txt", "fresh")]))
    reg = dedup.update_registry(dedup.empty_registry(spark), prev)
    out = {r["doc_id"]: r for r in dedup.check_against_registry(batch, reg).collect()}
    assert out[5]["is_duplicate"] and out[5]["original_path"] == "old.txt"
    assert not out[6]["is_duplicate"]
    reset = {r["doc_id"]: r for r in dedup.check_against_registry(batch, dedup.empty_registry(spark)).collect()}
    assert not reset[5]["is_duplicate"]


def test_unique_hashes_are_not_replicated(spark, monkeypatch):
    sizes = []

    def counting(big, lookup, keys, salt_cols, buckets, how="inner"):
        sizes.append(lookup.count())
        return salted_lookup(big, lookup, keys, salt_cols, buckets, how)

    from docshelf.operators import dedup
    from docshelf.operators.skew import salted_lookup

    monkeypatch.setattr(dedup, "salted_lookup", counting)
    df = spark.createDataFrame([(k, f"p{k}", f"h{k % 90}") for k in range(100)], "doc_id bigint, path string, content_hash string")
    got = dedup.mark_duplicates(df).where("is_duplicate").collect()
    assert len(got) == 10 and sizes == [10]
    registry = spark.createDataFrame([(f"h{k}", "old") for k in range(80, 500)], "content_hash string, first_path string")
    assert dedup.check_against_registry(df, registry).where("is_duplicate").count() == 20 and sizes[-1] == 10
