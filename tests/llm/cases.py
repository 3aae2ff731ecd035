"""Small inputs that every corpus operator must take."""
import random

DDL = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
       "row_key string, run string, node string, size string, tail string, sentences string, kept string")


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    full = [(i, t, lang, "src", None if t is None else len(t), "x", None, "x", "x", "x", "x", "x") for i, t, lang in rows]
    return spark.createDataFrame(full, DDL).repartition(3, "doc_id")


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    base = words(120, 1)
    return [
        (1, base, "en"), (2, base, "en"), (3, base + " tail", "en"), (3, base + " tail", "en"), (None, base, None),
        (4, None, None), (5, "", "en"), (6, "   \n\t ", "fr"), (7, "one two", "fr"), (8, "one two", None), (9, "x", "de"),
        (10, words(30_000, 2), "en"), (11, "a" * 50_000, "de"), (12, words(60, 3) + "\n" + base, "fr"),
        (13, "ÄÖ é ▁ 日本 😀 <|endoftext|> 'll", "de"), (None, None, None), (14, "...!!!", None),
    ]


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
