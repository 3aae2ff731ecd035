"""Packed term blocks: every occurrence once, whatever the blocks; the model fitted and applied on them."""
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docshelf.operators import naive_bayes as nb
from docshelf.operators import skew
from docshelf.operators import term_blocks as tb

DOCS = [["a1", "b1", "a1", "b1"], None, [], ["b1"], ["c1", "é2", "a1", "b1", "zz"], ["b1", "c1"] * 6, ["a1"]]


@pytest.mark.parametrize("ngram_range", [(1, 1), (1, 2), (2, 3)])
def test_blocks_hold_every_occurrence(monkeypatch, ngram_range):
    monkeypatch.setattr(tb, "BLOCK_ROWS", 3)
    monkeypatch.setattr(tb, "BLOCK_TOKENS", 5)       # the sixth document is longer
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 17)), pa.array(DOCS, pa.list_(pa.string()))], names=["id", "_tok"])
    got, blocks = Counter(), []
    for out in tb._packer(1, ngram_range, 3, ["part", "n_terms", "n_occ", *tb.BLOBS, "id"])([batch]):
        blocks += [tb.Block(out, i) for i in range(out.num_rows)]
    part_of = {}
    for b in blocks:
        terms, ids = b.terms().to_pylist(), b.kept("id").to_pylist()
        for t in terms:
            assert part_of.setdefault(t, b.value("part")) == b.value("part")     # a term has one part
        for term, doc, tf in zip(*b.occurrences()):
            got[ids[doc], terms[term]] += round(float(np.exp(tf - 1)))
    want = Counter()
    for i, d in zip(range(10, 17), DOCS):
        for n in range(ngram_range[0], ngram_range[1] + 1):
            for k in range(len(d or []) - n + 1):
                want[i, " ".join(d[k:k + n])] += 1
    assert got == want


@pytest.mark.parametrize("terms", [[], [""], ["", "a", "a b", "a bc", "ab"], ["é", "ê", "éa"], ["x" * 100, "x" * 100 + "y", "x" * 40], ["b", "a", "b", "b"]])
def test_terms_round_trip(terms):
    array = pa.array(["skipped", *terms], pa.string()).slice(1)
    assert tb.unpack_terms(*tb.pack_terms(array), len(terms)).to_pylist() == terms


@pytest.mark.parametrize("values", [np.array([1, 70000, 0], np.uint32), np.array([], np.uint16), np.array([[0.5, -1e300], [0.0, 3.0]])])
def test_numbers_round_trip(values):
    assert tb.unpack(tb.pack(values), values.dtype, values.size).tolist() == values.ravel().tolist()


def test_terms_leave_out_what_they_share():
    """Sorted terms are shuffled without the bytes they begin with like the one before."""
    words = np.random.default_rng(0).integers(97, 123, (4000, 3)).astype(np.uint8)
    terms = pa.array(sorted({f"{bytes(a).decode()} {bytes(b).decode()}" for a, b in zip(words[:400].repeat(10, axis=0), words)}))
    plain = pa.compress("".join(terms.to_pylist()).encode(), codec="zstd", asbytes=True)
    assert sum(map(len, tb.pack_terms(terms))) < 0.8 * len(plain)


def test_scoring_shuffles_blocks(spark, monkeypatch):
    """Occurrences of terms are not rows of a join by term, and the results are those of the join."""
    samples = spark.createDataFrame([(1, "invoice payment bank", "A", 1), (1, "bank holiday", "B", 3), (None, "garden roses bank", "B", 1),
                                     (4, None, "A", 1)], "sample_id bigint, text string, label string, weight int")
    docs = spark.createDataFrame([(7, "bank invoice invoice"), (7, "roses"), (None, "holiday payment"), (9, "nothing known"), (10, " "),
                                  (11, None)], "doc_id bigint, text string")
    model = nb.fit(samples)
    joined = sorted(map(str, nb.score(model, docs).collect()))
    monkeypatch.setattr(skew, "BROADCAST_LIMIT", -1)
    packed = nb.score(model, docs)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan and "Join Inner, (term" not in plan
    rows = packed.collect()
    assert [r["doc_id"] for r in rows].count(7) == 1
    got = sorted(str(r).replace(str(r["confidence"]), f"{r['confidence']:.9f}") for r in rows)
    want = sorted(str(r).replace(str(r["confidence"]), f"{r['confidence']:.9f}") for r in nb.score(
        nb.NBModel(model.classes, model.terms, model.options), docs).collect())
    assert got == want and len(joined) == len(got)
