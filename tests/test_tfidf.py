"""TF-IDF against its formulas: rows whose ids repeat or are null, and what is shuffled."""
import math
from collections import Counter, defaultdict

from docshelf.operators import skew
from docshelf.operators.tfidf import tfidf

ROWS = [(1, "alpha beta alpha"), (1, "beta gamma"), (None, "alpha delta"), (None, "épsilon alpha delta"), (4, None), (5, "  "), (6, "alpha")]


def brute(rows):
    tf = []
    for i, text in rows:
        words = (text or "").split()
        tf.append((i, Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])))
    df = Counter(t for _, c in tf for t in c)
    idf = {t: math.log((1 + len(rows)) / (1 + d)) + 1 for t, d in df.items()}
    squares = defaultdict(float)
    for i, c in tf:
        squares[i] += sum(((1 + math.log(k)) * idf[t]) ** 2 for t, k in c.items())
    return sorted((str(i), t, k, round(idf[t], 9), round((1 + math.log(k)) * idf[t] / math.sqrt(squares[i]), 9))
                  for i, c in tf for t, k in c.items())


def got(df):
    return sorted((str(r["doc_id"]), r["term"], r["tf"], round(r["idf"], 9), round(r["weight"], 9)) for r in df.collect())


def test_repeated_and_null_ids(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    assert got(tfidf(df)) == brute(ROWS)
    monkeypatch.setattr(skew, "NARROW_ROWS", -1)        # norms too many to broadcast
    assert got(tfidf(df)) == brute(ROWS)


def test_other_id_types_and_no_rows(spark):
    df = spark.createDataFrame([("a", "alpha beta"), ("b", "beta")], "doc_id string, text string")
    out = tfidf(df)
    assert out.columns == ["doc_id", "term", "tf", "idf", "weight"] and got(out) == brute([("a", "alpha beta"), ("b", "beta")])
    assert tfidf(df.limit(0)).count() == 0


def test_shuffles_blocks_not_terms(spark):
    """A row per term of each document is neither sorted nor shuffled: no exchange carries terms or comes after them."""
    plan = tfidf(spark.createDataFrame(ROWS, "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert exchanges and all("direct_shuffle_partition_id(part#" in line for line in exchanges)
    assert "Window" not in plan
