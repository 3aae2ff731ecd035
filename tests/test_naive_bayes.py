"""TF-IDF + multinomial NB against a direct Python implementation of the same formulas."""
import math
import re
from collections import Counter

from docshelf.functions.stopwords import token_stop_words
from docshelf.operators import naive_bayes as nb
from docshelf.options import NBOptions

TRAIN = [
    (1, "invoice payment bank account balance tax revenue", "Finance"),
    (2, "tax return income deduction refund payroll salary", "Finance"),
    (3, "resume curriculum vitae work experience education skills", "Resume"),
    (4, "machine learning neural network model training dataset", "AI"),
    (5, "deep learning transformer model computer vision", "AI"),
    (6, "abstract methodology results conclusion hypothesis experiment", "Research"),
    (7, "diary journal family friend birthday vacation", "Personal"),
    (8, "manual guide instructions meeting agenda recipe", "Other"),
]
TESTS = [
    (101, "my bank sent the invoice and the tax refund"),
    (102, "skills and education on my resume"),
    (103, "a neural network trained on a dataset"),
    (104, "zzz qqq"),
    (105, "   "),
    (106, "results of the experiment and the conclusion"),
]


def brute(train, tests, alpha=0.4, weights=None):
    stop = set(token_stop_words())

    def grams(t):
        toks = [w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop]
        return toks + [a + " " + b for a, b in zip(toks, toks[1:])]

    weights = weights or {i: 1 for i, _, _ in train}
    n = sum(weights[i] for i, _, _ in train)
    tf = {i: Counter(grams(t)) for i, t, _ in train}
    df = Counter()
    for i, _, _ in train:
        for term in tf[i]:
            df[term] += weights[i]
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}

    def vec(counts):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in counts.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm > 0 else v

    labels = sorted({l for _, _, l in train})
    nct = {l: Counter() for l in labels}
    for i, _, l in train:
        for t, x in vec(tf[i]).items():
            nct[l][t] += weights[i] * x
    V = len(idf)
    prior = {l: math.log(sum(weights[i] for i, _, ll in train if ll == l) / n) for l in labels}
    out = {}
    for d, text in tests:
        if not text.strip():
            out[d] = ("Other", 0.0, True)
            continue
        v = vec(Counter(grams(text)))
        jll = {l: prior[l] + sum(x * math.log((nct[l][t] + alpha) / (sum(nct[l].values()) + alpha * V))
                                 for t, x in v.items()) for l in labels}
        m = max(jll.values())
        p = 1.0 / sum(math.exp(j - m) for j in jll.values())
        best = min(l for l in labels if jll[l] == m)
        low = p < 0.18
        out[d] = ("Other" if low else best, round(p * 100 + 1e-12, 1), low)
    return out


def test_matches_direct_formulas(spark):
    samples = spark.createDataFrame([(i, t, l, 1) for i, t, l in TRAIN], "sample_id bigint, text string, label string, weight int")
    docs = spark.createDataFrame(TESTS, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["category"], r["confidence_pct"], r["is_low"])
           for r in nb.classify(nb.fit(samples), docs).collect()}
    want = brute(TRAIN, TESTS)
    assert set(got) == set(want)
    for d in want:
        assert got[d][0] == want[d][0], (d, got[d], want[d])
        assert abs(got[d][1] - want[d][1]) <= 0.1, (d, got[d], want[d])
        assert got[d][2] == want[d][2]
    assert got[105] == ("Other", 0.0, True)          # blank text
    assert got[101][0] == "Finance" and got[102][0] == "Resume" and got[103][0] == "AI"


def test_corrections_weight_three(spark):
    samples = spark.createDataFrame([(i, t, l, 1) for i, t, l in TRAIN], "sample_id bigint, text string, label string, weight int")
    corr = spark.createDataFrame([(900, "quarterly board minutes", "Finance"), (901, "x y z", "Nope")],
                                 "sample_id bigint, text string, label string")
    cats = spark.createDataFrame([(l,) for l in {l for _, _, l in TRAIN}], "category string")
    model = nb.fit(nb.with_corrections(samples, corr, cats))
    labels = {r["label"]: r["n_c"] for r in model.classes.collect()}
    assert "Nope" not in labels                      # unknown category ignored
    assert labels["Finance"] == 2 + 3                # correction counted three times
    weights = {i: 1 for i, _, _ in TRAIN}
    weights[900] = 3
    want = brute(TRAIN + [(900, "quarterly board minutes", "Finance")], [(1, "board minutes")], weights=weights)
    got = nb.classify(model, spark.createDataFrame([(1, "board minutes")], "doc_id bigint, text string")).first()
    assert got["category"] == want[1][0] and abs(got["confidence_pct"] - want[1][1]) <= 0.1


def test_salted_scoring_equals_broadcast(spark):
    import dataclasses

    from docshelf.operators import skew

    samples = spark.createDataFrame([(i, t, l, 1) for i, t, l in TRAIN], "sample_id bigint, text string, label string, weight int")
    docs = spark.createDataFrame(TESTS, "doc_id bigint, text string")
    model = nb.fit(samples)
    a = sorted(nb.classify(model, docs).collect())
    old = skew.BROADCAST_LIMIT
    try:
        skew.BROADCAST_LIMIT = -1                     # force the salted shuffle join
        m2 = nb.NBModel(model.classes, model.terms, dataclasses.replace(model.options, term_salt=4))
        b = sorted(nb.classify(m2, docs).collect())
    finally:
        skew.BROADCAST_LIMIT = old
    assert a == b


def test_salted_fit_matches_direct_formulas(spark):
    """Both joins on term (fit and score) on the salted shuffle path, as beyond the broadcast limit."""
    from docshelf.operators import skew

    samples = spark.createDataFrame([(i, t, l, 1) for i, t, l in TRAIN], "sample_id bigint, text string, label string, weight int")
    docs = spark.createDataFrame(TESTS, "doc_id bigint, text string")
    old = skew.BROADCAST_LIMIT
    try:
        skew.BROADCAST_LIMIT = -1
        model = nb.fit(samples, NBOptions(term_salt=3))
        got = {r["doc_id"]: (r["category"], r["confidence_pct"], r["is_low"]) for r in nb.classify(model, docs).collect()}
    finally:
        skew.BROADCAST_LIMIT = old
    want = brute(TRAIN, TESTS)
    for d in want:
        assert got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) <= 0.1 and got[d][2] == want[d][2]


def test_vocabulary_is_not_replicated(spark):
    """Beyond the broadcast limit the scoring join reads each term once: no salt, no explode of the vocabulary."""
    from docshelf.operators import skew

    samples = spark.createDataFrame([(i, t, l, 1) for i, t, l in TRAIN], "sample_id bigint, text string, label string, weight int")
    docs = spark.createDataFrame(TESTS, "doc_id bigint, text string")
    model = nb.fit(samples)
    old = skew.BROADCAST_LIMIT
    try:
        skew.BROADCAST_LIMIT = -1
        plan = nb.classify(model, docs)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        skew.BROADCAST_LIMIT = old
    assert "_salt" not in plan and "explode" not in plan


def test_many_classes_equal_few(spark, monkeypatch):
    samples = spark.createDataFrame([(i, t, l, 1) for i, t, l in TRAIN] + [(7000, None, "AI", 1)],
                                    "sample_id bigint, text string, label string, weight int")
    docs = spark.createDataFrame(TESTS, "doc_id bigint, text string")
    few = nb.fit(samples)
    a = sorted(nb.classify(few, docs).collect())
    monkeypatch.setattr(nb, "DENSE_CLASSES", 1)
    many = nb.fit(samples)
    assert few.mass_labels is not None and many.mass_labels is None
    assert a == sorted(nb.classify(many, docs).collect())


def test_repeated_and_null_sample_ids_share_a_norm(spark):
    """A correction has the id of its document: both count into one norm, as without ids."""
    import math

    rows = [(1, "red fox", "a", 1), (1, "red hen", "b", 3), (None, "blue hen", "a", 1)]
    samples = spark.createDataFrame(rows, "sample_id bigint, text string, label string, weight int")
    got = {(r["term"], e["label"]): e["n_ct"] for r in nb.fit(samples).terms.collect() for e in r["deltas"]}
    grams = lambda t: t.split() + [t]      # noqa: E731
    df = {}
    for _, t, _, w in rows:
        for g in grams(t):
            df[g] = df.get(g, 0) + w
    idf = {g: math.log((1 + 5) / (1 + n)) + 1 for g, n in df.items()}
    norm = {k: math.sqrt(sum(idf[g] ** 2 for i, t, _, _ in rows if i == k for g in grams(t))) for k in (1, None)}
    want = {}
    for i, t, l, w in rows:
        for g in grams(t):
            want[g, l] = want.get((g, l), 0) + w * idf[g] / norm[i]
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
