"""Raw files (binaryFile), composed parts, CSV export, model choice."""
import os

from pyspark.sql import functions as F

from docshelf.operators import compose as C
from docshelf.operators import reports
from docshelf.operators.classify import classify
from docshelf.sources import files as FS


def make_tree(root):
    os.makedirs(os.path.join(root, "Finance"), exist_ok=True)
    os.makedirs(os.path.join(root, "inbox"), exist_ok=True)
    with open(os.path.join(root, "a.txt"), "wb") as f:
        f.write(b"hello \xff world\r\nline two")
    with open(os.path.join(root, "B.TXT"), "wb") as f:
        f.write(b"upper suffix")
    with open(os.path.join(root, "c.bmp"), "wb") as f:
        f.write(b"BM")
    with open(os.path.join(root, "Finance", "done.txt"), "wb") as f:
        f.write(b"already organised")
    with open(os.path.join(root, "inbox", "nested.txt"), "wb") as f:
        f.write(b"nested text")


def test_read_texts_top_and_recursive(spark, tmp_path):
    root = str(tmp_path / "tree")
    make_tree(root)
    top = {r["filename"]: r for r in FS.read_texts(spark, root, ["Finance"], recursive=False).collect()}
    assert set(top) == {"a.txt", "B.TXT"}
    assert top["a.txt"]["text"] == "hello  world\nline two"        # bad byte dropped, CRLF -> LF
    rec = {r["filename"] for r in FS.read_texts(spark, root, ["Finance"], recursive=True).collect()}
    assert rec == {"a.txt", "B.TXT", "nested.txt"}                   # category folder skipped
    listing = FS.list_files(spark, root, recursive=True)
    cats = spark.createDataFrame([("Finance",)], "category string")
    tree = FS.scan_tree(listing, root, cats).collect()
    assert [(r["category"], os.path.basename(r["path"])) for r in tree] == [("Finance", "done.txt")]


def test_kinds_without_a_reader_are_not_blank_documents(spark, tmp_path):
    root = str(tmp_path / "kinds")
    make_tree(root)
    with open(os.path.join(root, "scan.pdf"), "wb") as f:
        f.write(b"%PDF")
    got = {r["filename"]: (r["text"], r["status"]) for r in FS.read_texts(spark, root, ["Finance"]).collect()}
    assert got["scan.pdf"] == (None, "unread") and got["B.TXT"] == ("upper suffix", "read")


def test_compose_caps_are_explicit_and_counted(spark):
    parts = spark.createDataFrame([("a", "x", k, "y" * 30) for k in range(12)], "path string, kind string, seq int, text string")
    whole = C.compose(parts, C.ARCHIVE).first()
    assert whole["text"].count("\n") == 11 and (whole["parts_left_out"], whole["chars_left_out"]) == (0, 0)
    cut = C.compose(parts, C.capped(C.ARCHIVE, 10, 20)).first()
    assert cut["text"] == "\n".join(["y" * 20] * 10) and (cut["parts_left_out"], cut["chars_left_out"]) == (2, 100)


def test_mail_without_subject(spark):
    parts = spark.createDataFrame([("m", "subject", 0, ""), ("m", "from", 1, "x@y"), ("m", "body", 2, "hi")],
                                  "path string, kind string, seq int, text string")
    assert C.compose(parts, C.MAIL).first()["text"] == "x@y\nhi"


def test_export_csv_and_totals(spark, tmp_path):
    res = spark.createDataFrame(
        [(1, "a.txt", "Invoice.txt", "Finance", 91.25, False, "English", False),
         (2, "b.txt", None, "Other", 12.0, True, "French", True)],
        "doc_id bigint, filename string, new_name string, category string, confidence_pct double, is_low boolean, "
        "language string, overridden boolean")
    rows = reports.export_rows(res, ["doc_id"])
    out = str(tmp_path / "export")
    reports.write_export_csv(rows.drop("row_no"), out)
    back = spark.read.option("header", True).csv(out).orderBy("File").collect()
    assert list(back[0].asDict()) == ["File", "New Name", "Category", "Confidence (%)", "Language", "Status"]
    assert back[0]["Confidence (%)"] == "91.3" and back[1]["Status"] == "Manually overridden"
    t = reports.export_totals(res).first()
    assert t["n_files"] == 2 and abs(t["avg_confidence"] - 51.63) < 0.01


def test_model_choice(spark):
    import pytest

    protos = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0])], "category string, proto array<double>")
    docs = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.2, 0.2])], "doc_id bigint, embedding array<float>")
    got = {r["doc_id"]: r for r in classify(docs, "embedding", prototypes=protos).collect()}
    assert got[1]["category"] == "A" and not got[1]["is_low"]
    assert got[2]["category"] == "A" and got[2]["confidence_pct"] == 70.7    # tie -> first category, kept
    with pytest.raises(ValueError):
        classify(docs, "svm")


def test_decode_drops_only_malformed_bytes(spark):
    import random

    from docshelf.sources.files import decode_text

    r = random.Random(1)
    parts = [b"\xef\xbf\xbd", "é".encode(), "日".encode(), "\U0001f600".encode(), b"\r\n", b"\r", b"a", b"\x00", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x98",
             b"\x80", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5", b"\xff", b"\xf4\x90\x80\x80", b"\xe0\x80\x80"]
    raws = [b"".join(r.choices(parts, k=r.randrange(0, 12))) for _ in range(600)] + [r.randbytes(40) for _ in range(600)]
    raws += [b"x" * 300_000 + b"\xff" + "ß".encode() * 100_000, b""]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raws)] + [(-1, None)], "i int, content binary").repartition(3)
    got = {x.i: x.t for x in df.select("i", decode_text("content").alias("t")).collect()}
    assert got.pop(-1) is None
    for i, raw in enumerate(raws):
        assert got[i] == raw.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n"), raw[:80]
