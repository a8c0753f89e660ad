"""Registered queries on the given tables: equal to their SQL, or to their contract."""

import zlib

import pytest

from oracle import TESTDATA, compare, connect
from paperlantern.llm.common import table
from paperlantern.llm.queries import ORACLES, QUERIES

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    mine, theirs, my_columns, their_columns = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert my_columns == their_columns
    assert mine == theirs and mine


@pytest.mark.parametrize("name", ["op2_language_id", "op3_toxicity", "op4_quality"])
def test_folds_and_scores(spark, name):
    found = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in table(spark, SF, "documents").collect())
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1


def _held_out(spark, sf, name, column):
    found = {r.doc_id: r for r in QUERIES[name](spark, sf).collect() if r.held_out}
    truth = table(spark, sf, "labels" if column != "lang" else "documents").collect()
    return [(found[r.doc_id], r[column]) for r in truth if r.doc_id in found]


def test_language_of_held_out_documents(spark):
    pairs = _held_out(spark, f"{TESTDATA}/sf0.01", "op2_language_id", "lang")
    assert sum(p.lang_pred == lang for p, lang in pairs) >= 0.98 * len(pairs)


@pytest.mark.parametrize("name,column", [("op3_toxicity", "toxic"), ("op4_quality", "quality")])
def test_labels_of_held_out_documents(spark, name, column):
    pairs = _held_out(spark, f"{TESTDATA}/sf0.1", name, column)
    assert sum(p.predicted == label for p, label in pairs) >= 0.97 * len(pairs)


def test_every_page_has_its_text(spark):
    pages = {r.page_id: r for r in QUERIES["op10_html_extraction"](spark, SF).collect()}
    assert len(pages) == table(spark, SF, "pages").count()
    assert all("<" not in r.text for r in pages.values())
