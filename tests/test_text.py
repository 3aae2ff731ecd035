"""Column text functions against Python semantics."""
from pyspark.sql import functions as F

from docshelf.functions import text as T


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_sanitise_reference_cases(spark):
    assert one(spark, T.sanitise_name("s"), "Invoice Amazon 2026!!.pdf") == "Invoice_Amazon_2026"
    assert one(spark, T.sanitise_name("s"), "A" * 100 + "\nextra") == "A" * 80
    assert one(spark, T.sanitise_name("s"), "  __Tax Return__  ") == "Tax_Return"
    # the stem is taken before the first line: the last dot is at the very end, so no suffix
    assert one(spark, T.sanitise_name("s"), "Invoice.pdf\nDone.") == "Invoicepdf"
    assert one(spark, T.sanitise_name("s"), "???") == ""


def test_suffix_and_stem_follow_pathlib(spark):
    from pathlib import PurePosixPath

    names = ["a.tar.gz", ".bashrc", "a.", "noext", "x.TXT", "..b", "report.final.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    rows = df.select("s", T.suffix("s").alias("sfx"), T.stem("s").alias("stem")).collect()
    for r in rows:
        p = PurePosixPath(r["s"])
        assert r["sfx"] == p.suffix, r
        assert r["stem"] == p.stem, r


def test_words_match_python_split(spark):
    texts = ["  hello   world\n\tfoo ", "", "one", "a b  c", "x y"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", T.word_count("s").alias("n"), T.word_prefix("s", 2).alias("p"),
                     T.is_blank("s").alias("blank"), T.trimmed_length("s").alias("tl"),
                     T.stripped_length_at_least("s", 3).alias("ge3"), T.first_word("s").alias("fw")).collect()
    for r in rows:
        w = r["s"].split()
        assert r["n"] == len(w)
        assert r["p"] == " ".join(w[:2])
        assert r["blank"] == (not r["s"].strip())
        assert r["tl"] == len(r["s"].strip())
        assert r["ge3"] == (len(r["s"].strip()) >= 3)
        assert r["fw"] == (w[0] if w else None)


def test_previews(spark):
    long = " ".join(["word"] * 80)
    assert one(spark, T.char_preview_web("s"), long).endswith("...")
    assert one(spark, T.char_preview_web("s"), "short text") == "short text"
    assert one(spark, T.char_preview_desktop("s"), "x" * 301) == "x" * 300 + "…"
    assert one(spark, T.char_preview_desktop("s"), "  abc  ") == "abc"


def test_in_row_term_counts_equal_explode_group_by(spark):
    from docshelf.operators.tokens import doc_terms, doc_terms_shuffled

    rows = [(1, "The cat sat on the mat, the cat!"), (2, ""), (3, "a"), (4, "Über über ÜBER naïve café café")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    a = sorted(doc_terms(df).collect())
    b = sorted(doc_terms_shuffled(df).collect())
    assert a == b
    assert ("cat sat" in {r["term"] for r in a}) and all(r["tf"] >= 1 for r in a)


def test_stripped_length_reads_only_the_start(spark):
    """Same answers as the trimmed length, and a long text is not read to its end."""
    import time

    from pyspark.sql import functions as F

    from docshelf.functions.text import stripped_length_at_least

    texts = ["", None, " a" + "b" * 18 + " ", "a" + " " * 18 + "b", "a" + " " * 17 + "b", "\n\n" + "x" * 19, "x" * 20, " " * 40,
             "a" + "\n" * 40 + "b" + " " * 30, "\U0001F600" * 20, "　" * 30 + "x" * 20]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(stripped_length_at_least("text", 20)).collect()]
    assert got == [None if t is None else len(t.strip()) >= 20 for t in texts]

    long = spark.range(4).select(F.repeat(F.concat(F.lit("ab c "), F.col("id").cast("string")), 1_000_000).alias("text"))
    seconds = []
    for whole in (long.where(F.col("text").rlike(r"[^\s\p{Z}][\s\S]{18,}[^\s\p{Z}]")), long.where(stripped_length_at_least("text", 20))):
        whole.count()
        at = time.time()
        assert whole.count() == 4
        seconds.append(time.time() - at)
    assert seconds[1] < seconds[0] / 2
