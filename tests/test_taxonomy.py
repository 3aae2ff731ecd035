"""Taxonomy edits and validation."""
import json

import pytest

from docshelf.operators import taxonomy as tx


def config(tmp_path, doc):
    p = tmp_path / "config.json"
    p.write_text(json.dumps(doc, indent=2))
    return str(p)


BASE = {"categories": ["Finance", "Other"], "training_data": {"Finance": ["invoice"], "Other": ["misc"]},
        "organizer": {"supported_extensions": [".txt"]}}


def test_edits(spark, tmp_path):
    t = tx.load_config(spark, config(tmp_path, BASE))
    assert tx.violations(t).count() == 0
    with pytest.raises(tx.TaxonomyError):
        tx.add_category(t, "Finance")
    with pytest.raises(tx.TaxonomyError):
        tx.delete_category(t, "Other")
    t2 = tx.update_keywords(t, "Finance", "invoice tax\n\nbank statement")
    kw = sorted(r["text"] for r in t2.training.where("category = 'Finance'").collect())
    assert kw == ["bank statement", "invoice tax"]
    t3 = tx.add_category(t2, " Medical ")
    assert [r["category"] for r in tx.list_categories(t3).collect()] == ["Finance", "Other", "Medical"]
    assert t3.training.where("category = 'Medical'").first()["text"] == "add your keywords for Medical here"
    with pytest.raises(tx.TaxonomyError):
        tx.update_keywords(t, "Finance", "  \n ")


def test_validation_names_category(spark, tmp_path):
    bad = dict(BASE, categories=["Finance", "Other", "Legal"])
    v = {(r["rule"], r["item"]) for r in tx.violations(tx.load_config(spark, config(tmp_path, bad))).collect()}
    assert ("missing_training", "Legal") in v
    p = tmp_path / "broken.json"
    p.write_text("{bad json")
    v2 = {r["rule"] for r in tx.violations(tx.load_config(spark, str(p))).collect()}
    assert "invalid_json" in v2
