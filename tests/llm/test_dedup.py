import collections
import hashlib

import numpy as np
import pytest
import regex

from docshelf.llm import minhash_bayes as mb
from docshelf.llm import substring_dedup
from docshelf.llm.components import connected_components
from docshelf.llm.exact_dedup import drop_copies, exact_groups
from docshelf.llm.substring_dedup import SpanOptions, remove_repeats

from ..conftest import SF_SMALL
from .cases import documents, frame, odd_rows, words


def test_exact_groups_take_odd_rows(spark):
    rows = odd_rows()
    got = exact_groups(frame(spark, rows), fan_in=2).collect()
    by_text = collections.defaultdict(list)
    for i, t, _ in rows:
        by_text[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    kept = collections.Counter()
    for r in got:
        ids = by_text[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert all(kept[t] == 1 for t in by_text)


def test_exact_groups_keep_smallest(spark):
    got = exact_groups(frame(spark, [(3, "a", None), (1, "a", None), (None, "a", None), (2, "b", None)]), keep="min")
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {
        (3, 1, False), (1, 1, True), (None, 1, False), (2, 2, True)}


def test_hot_text_over_many_splits(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text").repartition(23)
    got = exact_groups(docs).where("group_size > 1").collect()
    assert len(got) == 1000 and {(r.keep_id, r.group_size) for r in got} == {(2997, 1000)}


def test_drop_copies_keeps_columns_and_one_row(spark):
    docs = frame(spark, odd_rows())
    out = drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t, _ in odd_rows()})


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact_groups(empty).count() == drop_copies(empty).count() == 0
    assert mb.near_duplicates(empty).count() == remove_repeats(empty).count() == 0


def shingles(text):
    w = [x.decode("utf-8", "replace") for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sets, [find(i) for i in range(len(rows))]


def near_matches_brute(spark, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, roots = brute_near(rows)
    want = collections.Counter((i, len(s), rows[root][0]) for (i, _), s, root in zip(rows, sets, roots))
    got = mb.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(set(roots))


def test_near_duplicates_match_brute_force(spark):
    near_matches_brute(spark, documents(spark, SF_SMALL))


def test_near_duplicates_take_odd_rows_and_large_groups(spark):
    base = words(200, 9).split()
    copies = [(100 + k, " ".join(base[:k] + ["new"] + base[k:]), "en") for k in range(0, 60)]
    chain = [(200 + k, " ".join(base[8 * k:8 * k + 100]), "en") for k in range(12)]
    near_matches_brute(spark, frame(spark, odd_rows() + copies + chain))


def test_drop_near_copies_keeps_columns(spark):
    docs = frame(spark, odd_rows())
    out = mb.drop_near_copies(docs)
    # base with its copies and its near copy are one group; "one two" another; empty sets stay
    assert out.columns == docs.columns and out.count() == len(odd_rows()) - 5


def test_sequential_test_keeps_what_reaches_the_threshold():
    opts, r = mb.MinHashOptions(), np.random.default_rng(1)
    n = opts.bands * opts.rows
    a = r.integers(0, 1 << 32, (4000, n), dtype=np.uint32)
    for similarity, low, high in ((0.75, 0.999, 1.0), (0.9, 1.0, 1.0), (0.3, 0.0, 0.01)):
        b = np.where(r.random(a.shape) < similarity, a, a + np.uint32(1))
        assert low <= mb.plausible(a, b, opts).mean() <= high


def test_word_hashes_of_blocks_and_long_words(monkeypatch):
    text = words(5000, 4) + " " + "Z" * 70_000 + "é end"
    whole = mb.word_hashes(text)
    monkeypatch.setattr(mb, "BLOCK", 1000)
    assert (mb.word_hashes(text) == whole).all() and len(whole) == len(text.split())
    assert (mb.word_hashes(text.replace("w", "W")) == whole).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_spans(rows, opts):
    seen, cut = collections.defaultdict(list), []
    for row, (i, t) in enumerate(rows):
        s = regex.findall(r"(?s).+?(?:\.[ \t\n\x0b\f\r]+|[!?][ \t\n\x0b\f\r]+(?=\P{Ll})|\n[ \t\n\x0b\f\r]*|\Z)", t or "")
        w = [tuple(x.lower().split()) for x in s]
        cut.append(s)
        for a in range(len(s)):
            for n in range(1, opts.run + 1):
                total, before = sum(map(len, w[a:a + n])), sum(map(len, w[a:a + n - 1]))
                if a + n <= len(s) and (total >= opts.least_words if n == opts.run
                                        else total >= opts.long_words and before < opts.long_words):
                    seen[tuple(w[a:a + n])].append((i is None, i or 0, row, a))
    gone = collections.defaultdict(set)
    for span, places in seen.items():
        for _, _, row, a in sorted(places)[1:]:
            gone[row] |= set(range(a, a + len(span)))
    return collections.Counter((i, "".join(x for k, x in enumerate(s) if k not in gone[row]), len(gone[row]))
                               for row, ((i, _), s) in enumerate(zip(rows, cut)))


@pytest.mark.parametrize("odd", [False, True])
def test_repeated_spans_match_brute_force(spark, odd):
    docs = frame(spark, odd_rows()) if odd else documents(spark, SF_SMALL)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = remove_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.text, r.n_removed) for r in got) == brute_spans(rows, SpanOptions())


def test_passage_in_another_text_goes_and_clean_text_stays(spark):
    passage = " ".join(f"p{k}{'.' if k % 9 == 8 else ''}" for k in range(60)) + ". "
    got = {r.doc_id: r for r in remove_repeats(frame(spark, [
        (1, words(40, 5) + ". " + passage + words(30, 6), None), (2, words(50, 7) + ". " + passage + "End.", None),
        (3, words(90, 8), None)])).collect()}
    assert got[1].n_removed == got[3].n_removed == 0
    assert "p30" not in got[2].text and got[2].text.endswith("End.") and got[2].first_ids == [1]


@pytest.mark.parametrize("module", [mb, substring_dedup])
def test_rows_keep_their_keys_when_the_splits_change(spark, tmp_path, monkeypatch, module):
    base = words(200, 9).split()
    rows = [(k, " ".join(base[:k] + ["new"] + base[k:]) if k % 4 == 0 else words(80, 1000 + k), "en") for k in range(40)]
    frame(spark, rows).repartition(12, "doc_id").write.parquet(str(tmp_path / "docs"))
    size = "spark.sql.files.maxPartitionBytes"
    before, plain = spark.conf.get(size), module.written

    def then_other_splits(df, *args):     # as when an executor is lost or added between two scans
        out = plain(df, *args)
        spark.conf.set(size, "64k")
        return out

    monkeypatch.setattr(module, "written", then_other_splits)
    docs = spark.read.parquet(str(tmp_path / "docs"))
    try:
        spark.conf.set(size, "64m")
        if module is mb:
            ids = sorted(r.doc_id for r in mb.drop_near_copies(docs).select("doc_id").collect())
            assert ids == [0] + [k for k in range(40) if k % 4]
        else:
            got = remove_repeats(docs).collect()
            texts = [(i, t) for i, t, _ in rows]
            assert collections.Counter((r.doc_id, r.text, r.n_removed) for r in got) == brute_spans(texts, SpanOptions())
    finally:
        spark.conf.set(size, before)


def brute_lengthened(rows, opts):
    """As brute_spans, of lines of plain words: from each line the shortest run of 3 or more with words enough."""
    seen, cut = collections.defaultdict(list), []
    for row, (_, t) in enumerate(rows):
        s = t.splitlines(keepends=True)
        w = [tuple(x.lower().split()) for x in s]
        cut.append(s)
        for a in range(len(s)):
            def first(lengths, least):
                return next((n for n in lengths if a + n <= len(s) and sum(map(len, w[a:a + n])) >= least), None)

            for n in (first(range(opts.run, len(s) + 1), opts.least_words), first(range(1, opts.run), opts.long_words)):
                if n is not None:
                    seen[tuple(w[a:a + n])].append((row, a))
    gone = collections.defaultdict(set)
    for span, places in seen.items():
        for row, a in sorted(places)[1:]:
            gone[row] |= set(range(a, a + len(span)))
    return [(i, "".join(x for k, x in enumerate(s) if k not in gone[row]), len(gone[row]))
            for row, ((i, _), s) in enumerate(zip(rows, cut))]


def test_repeats_of_short_lines_match_brute_force(spark):
    def lines(seed, sizes):
        return "".join(" ".join(f"s{seed}n{k}w{j}" for j in range(n)) + "\n" for k, n in enumerate(sizes))

    verse, items, mixed = lines(1, [3] * 20), lines(2, [1] * 30), lines(3, [1, 5, 2, 30, 1, 1, 13, 4] * 2)
    texts = [verse + mixed, lines(4, [9]) + verse + lines(5, [2]), items, lines(6, [4, 4]) + items + mixed, lines(7, [1] * 13) * 2]
    rows = list(enumerate(texts))
    got = remove_repeats(frame(spark, [(i, t, None) for i, t in rows]), opts=SpanOptions(lengthen=True)).collect()
    want = brute_lengthened(rows, SpanOptions())
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == want
    assert [n for _, _, n in want] == [0, 20, 0, 46, 13]


def test_repeats_of_texts_without_spaces_go(spark):
    han = "".join("".join(chr(0x4E00 + 40 * k + j) for j in range(18)) + "。\n" for k in range(3))
    thai = "".join("".join(chr(0x0E01 + (7 * k + j) % 46) for j in range(24)) + "\n" for k in range(3))
    got = {r.doc_id: r for r in remove_repeats(frame(spark, [
        (1, han, None), (2, "开头\n" + han + "结尾", None), (3, thai, None), (4, "ก\n" + thai, None), (5, "好\n是\n不\n", None),
        (6, "好\n是\n不\n", None)]), opts=SpanOptions(lengthen=True)).collect()}
    assert {i: (r.n_removed, r.text) for i, r in got.items() if i % 2 == 0} == {
        2: (3, "开头\n结尾"), 4: (3, "ก\n"), 6: (0, "好\n是\n不\n")}


def test_stages_keep_columns_named_like_their_helpers(spark):
    from docshelf.llm.language_svm import fit, identify

    rows = [(i, t, "en", f"k{i}", f"r{i}", f"l{i}", i, f"K{i}") for i, t in enumerate(
        ["one two three four five six", "one two three four five six", "seven eight nine ten eleven", "...", "twelve thirteen"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `__key` string, `__row_key` string, `__lang` string, "
                                       "`__n` int, `__key_` string")
    kept = {1: 1, 2: 2, 3: 3, 4: 4}
    for out, ids in ((drop_copies(docs), kept), (mb.drop_near_copies(docs), {0: 0, 2: 2, 3: 3, 4: 4}),
                     (identify(docs, fit(docs)), {0: 0, 1: 1, 2: 2, 4: 4})):
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect())) == [rows[i] for i in sorted(ids)]
