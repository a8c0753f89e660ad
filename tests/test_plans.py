"""What the physical plans must and must not contain."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from paperlantern.operators import clauses
from paperlantern.operators.analyze import build_postings, tokenize
from paperlantern.operators.clauses import query_specs
from paperlantern.plans.index import _write_bucketed, open_index
from paperlantern.plans.search import score_documents
from paperlantern.workload import fixtures as fx
from paperlantern.workload import queries as wq

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_need_no_shuffle_and_one_analysis(spark):
    text = plan(build_postings(fx.documents(spark, SF), 8))
    assert "Exchange" not in text
    assert text.count("split(lower(") == 1
    assert plan(tokenize(fx.documents(spark, SF))).count("split(lower(") == 1


@pytest.mark.parametrize("name", ["q04_boolean", "q07_regexp", "q13_phrase"])
def test_search_plan(spark, name):
    text = plan(wq.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Python" not in text and "Pandas" not in text and "ArrowEval" not in text
    assert "WindowGroupLimit" in text
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text)
    assert re.search(r"PushedFilters: \[[^\]]*term", text)
    assert "positions" not in text.split("ReadSchema")[1] or name == "q13_phrase"


def test_no_registered_query_runs_python(spark):
    for name in ("p4_match_locations", "c2_debounce", "g3_folder_tree", "j1_group_folders", "c6_expand_dir_events"):
        text = plan(wq.QUERIES[name](spark, SF))
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_hot_bucket_is_split_over_files(spark, tmp_path):
    """A term in every document makes one bucket large; AQE splits it."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    rows = spark.range(0, 200_000, 1, 8).select(
        F.lit("the").alias("term"), F.lit("i").alias("index_id"), F.sha2(F.col("id").cast("string"), 256).alias("path"), F.lit(3).alias("bucket")
    )
    spark.conf.set(key, "1m")
    try:
        _write_bucketed(rows, str(tmp_path / "hot"))
    finally:
        spark.conf.set(key, before)
    files = list((tmp_path / "hot" / "bucket=3").glob("*.parquet"))
    assert len(files) > 2
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 200_000


def test_index_files_are_sorted_by_term(spark):
    index = fx.stored_index(spark, SF)
    terms = index.postings.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"), "term")
    first = terms.orderBy("f", "n").limit(5000).collect()
    for a, b in zip(first, first[1:]):
        assert a.f != b.f or a.term.encode() <= b.term.encode()
    assert open_index(spark, "/nonexistent/index") is None


def _many_clauses(n: int) -> list[dict]:
    """Clauses of every kind that name documents or terms by value, pattern, range or not at all."""
    kinds = [
        {"kind": "prefix", "text": "th"}, {"kind": "fuzzy", "text": "thet", "fuzziness": 1}, {"kind": "regexp", "text": "th[a-c]+"},
        {"kind": "wildcard", "text": "?nd"}, {"kind": "match_all"}, {"kind": "numeric_range", "lo": 100.0, "hi": 3000.0},
        {"kind": "numeric_range", "lo": 1024.0}, {"kind": "date_range", "lo_ts": dt.datetime(2024, 1, 1, 1), "hi_ts": dt.datetime(2024, 1, 1, 2)},
        {"kind": "term", "field": "extension", "text": ".md"}, {"kind": "prefix", "field": "dir", "text": "src1"},
        {"kind": "regexp", "field": "extension", "text": r"\.(go|py)"}, {"kind": "fuzzy", "field": "dir", "text": "src1/ex"},
    ]
    return [{"query_id": f"q{i}", **kinds[i % len(kinds)]} for i in range(n)]


def test_joined_clauses_find_what_literal_ones_find(spark, monkeypatch):
    index = fx.stored_index(spark, SF)
    specs = query_specs(spark, _many_clauses(24))
    literal = sorted(map(tuple, score_documents(index, specs).collect()))
    monkeypatch.setattr(clauses, "LITERAL_ROWS", 0)
    joined = score_documents(index, specs)
    assert sorted(map(tuple, joined.collect())) == literal


def test_a_thousand_clauses_need_no_nested_loop(spark):
    index = fx.stored_index(spark, SF)
    specs = clauses.valid_queries(query_specs(spark, _many_clauses(1_000)))
    carry = ["query_id", "clause_id"]
    on_documents = clauses.document_hits(index.documents, specs.where("field <> 'content' OR kind = 'match_all'"), carry)
    on_terms = clauses.expand_terms(index.dictionary, specs.where("field = 'content' AND kind IN ('prefix', 'fuzzy', 'regexp', 'wildcard')"), carry)
    for df in (on_documents, on_terms):
        text = plan(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text
        assert df.groupBy("query_id").count().count() > 200


def test_bad_patterns_are_named_at_any_number(spark):
    bad = spark.range(12_000).select(
        F.col("id").cast("string").alias("query_id"), F.lit(0).alias("clause_id"), F.lit("should").alias("occur"), F.lit("regexp").alias("kind"),
        F.lit("content").alias("field"), F.when(F.col("id") == 11_999, "(").otherwise(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("text"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("lo", "double"), ("hi", "double"), ("lo_ts", "timestamp"), ("hi_ts", "timestamp"), ("fuzziness", "int"))],
        F.lit(1.0).alias("boost"),
    )
    assert [tuple(r) for r in clauses.rejected_queries(bad).collect()] == [("11999", 0, "bad pattern")]


def test_kind_has_to_fit_field(spark):
    specs = query_specs(spark, [
        {"query_id": "a", "kind": "term", "field": "size", "text": "100"}, {"query_id": "b", "kind": "numeric_range", "field": "mod_time", "lo": 1.0},
        {"query_id": "c", "kind": "date_range", "field": "size", "lo_ts": dt.datetime(2024, 1, 1)}, {"query_id": "d", "kind": "prefix", "field": "dir", "text": "x"},
    ])
    assert {r.query_id: r.reason for r in clauses.rejected_queries(specs).collect()} == dict.fromkeys("abc", "kind does not fit field")
