import pytest

from docshelf.operators import naive_bayes as nb
from docshelf.operators import organise


@pytest.fixture(scope="module")
def plan(spark):
    samples = spark.createDataFrame([(1, "invoice payment bank", "Finance", 1), (2, "neural network model", "AI", 1)],
                                    "sample_id bigint, text string, label string, weight int")
    files = spark.createDataFrame(
        [(1, "in/1.txt", "1.txt", "invoice of the bank for a payment"), (2, "in/2.txt", "2.txt", "invoice of the bank for a payment"),
         (3, "in/3.txt", "3.txt", "short"), (4, "in/4.txt", "4.txt", "a neural network is a model too")],
        "doc_id bigint, path string, filename string, text string")
    proposals = files.selectExpr("doc_id", "'report' AS raw_name")
    return organise.organise(files, nb.fit(samples), "out", proposals)


def test_names_and_copies(plan):
    rows = {r["doc_id"]: (r["new_name"], r["dest_path"]) for r in plan["results"].collect()}
    assert rows[1] == ("report.txt", "out/Finance/report.txt") and rows[4] == ("report.txt", "out/AI/report.txt")
    assert rows[3][0] == "3.txt"                     # too short to rename
    assert [r["doc_id"] for r in plan["duplicates"].collect()] == [2]


def test_reading_the_results_does_not_classify_again(plan):
    assert not [f for f in plan["results"].inputFiles() if "nb-terms" in f]
