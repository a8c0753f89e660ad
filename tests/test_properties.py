"""Properties on small generated inputs, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperlantern.operators import changes as ch
from paperlantern.operators import preview as pv
from paperlantern.operators.analyze import build_postings
from paperlantern.operators.clauses import like_pattern, query_specs, validate_queries
from paperlantern.operators.folders import group_folders
from paperlantern.operators.rank import top_k
from paperlantern.plans.index import index_in_memory
from paperlantern.plans.search import score_documents, search
from paperlantern.functions.paths import path_dir, path_rel
from paperlantern.functions.text import is_regex_input, regex_quote


def documents(spark, texts, index_id="i"):
    rows = [(index_id, f"{index_id}/d/{n}.txt", f"{index_id}/d", ".txt", len(t), n, t) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "index_id string, path string, dir string, ext string, size long, n int, content string")
    return df.withColumn("mod_time", F.timestamp_seconds("n")).drop("n")


def test_postings_against_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "bb", "été", "x_1", "Über", "9"]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += ["", "!!!", "x " * 50_000]
    want = {}
    for n, t in enumerate(texts):
        for p, term in enumerate(re.findall(r"\w+", t.lower())):
            want.setdefault((f"i/d/{n}.txt", term), []).append(p)
    docs = documents(spark, texts)
    with_positions = {(r.path, r.term): r.positions for r in build_postings(docs, 4).collect()}
    assert with_positions == want
    counts = {(r.path, r.term): r.tf for r in build_postings(docs, 4, positions=False).collect()}
    assert counts == {k: len(v) for k, v in want.items()}


LINES = ["the cat", "xthe THE the", "ünder der Ärger", "", "aa", "the\u0001the\u0002 the", "a|b", "é the é"]


@pytest.mark.parametrize("terms", [["the"], ["der", "ärger"], ["/a*/"], ["/th[a-e]+/", "cat"], ["a|b"], []])
def test_pieces_join_to_the_line(spark, terms):
    lines = spark.createDataFrame([("q", "i", "p", n, l) for n, l in enumerate(LINES)], "query_id string, index_id string, path string, row_id int, line string")
    pattern = pv.highlight_pattern(F.array(*[F.lit(t) for t in terms]).cast("array<string>"))
    rows = pv.highlight_segments(lines.withColumn("pattern", pattern)).orderBy("row_id").collect()
    bounded = "|".join(rf"{t[1:-1]}\b" if t.startswith("/") else rf"\b{re.escape(t)}\b" for t in terms)
    for r in rows:
        assert "".join(s.text for s in r.segments) == r.line
        found = [m.group() for m in re.finditer(bounded, r.line, re.I) if m.group()] if terms else []
        if all(ord(c) < 128 for c in r.line):
            assert [s.text for s in r.segments if s.is_match] == found
        assert all(s.text for s in r.segments[:-1])
        assert not terms or not r.segments[-1].is_match


def test_nth_match_is_clamped(spark):
    m = spark.createDataFrame([("q", "i", "p", n, n) for n in range(3)], "query_id string, index_id string, path string, row_id int, match_no int")
    for asked, label in ((-5, 1), (1, 2), (99, 3)):
        wanted = spark.createDataFrame([("q", "i", "p", asked)], "query_id string, index_id string, path string, n int")
        assert pv.nth_match(m, wanted).first().label == label


def test_conjunction_is_within_each_clause(spark):
    docs = documents(spark, ["a b", "a", "b c", "a b c", "c"])
    index = index_in_memory(docs, positions=False)
    both = query_specs(spark, [{"query_id": "q", "occur": "must", "kind": "term", "text": t} for t in "ab"])
    one = lambda t: query_specs(spark, [{"query_id": "q", "kind": "term", "text": t}])
    paths = lambda s: {r.path for r in search(index, s).collect()}
    assert paths(both) == paths(one("a")) & paths(one("b")) == {"i/d/0.txt", "i/d/3.txt"}


def test_scores_do_not_depend_on_partitions_and_many_clauses_join(spark):
    rng = random.Random(3)
    docs = documents(spark, [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(30)) for _ in range(50)])
    clauses = [{"query_id": f"q{n}", "kind": "prefix", "text": "abcdefgh"[n % 8]} for n in range(300)]
    specs = query_specs(spark, clauses)  # above the literal limit: joined instead
    got = []
    for parts in (1, 7):
        index = index_in_memory(docs.repartition(parts), positions=False)
        got.append(sorted((r.query_id, r.path, r.score) for r in score_documents(index, specs).collect()))
    assert got[0] == got[1]
    few = query_specs(spark, clauses[:8])
    assert sorted((r.query_id, r.path, r.score) for r in score_documents(index, few).collect()) == [r for r in got[0] if r[0] in {f"q{n}" for n in range(8)}]


def test_top_k_with_a_hot_collection(spark):
    rows = spark.range(20_000).select(
        F.lit("q").alias("query_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("index_id"),
        F.format_string("%05d", "id").alias("path"), (F.col("id") % 100).cast("double").alias("score"),
    ).repartition(16)
    got = [r.path for r in top_k(rows, 5, fanout=4).where("index_id = 'hot'").orderBy("rank").collect()]
    best = sorted((-(n % 100), f"{n:05d}") for n in range(0, 20_000, 3))[:5]
    assert got == [p for _, p in best]


def test_reasons(spark):
    specs = query_specs(
        spark,
        [
            {"query_id": "1", "kind": "term", "text": "x"}, {"query_id": "2", "kind": "term", "text": " "},
            {"query_id": "3", "kind": "nope", "text": "x"}, {"query_id": "4", "kind": "numeric_range", "lo": 2.0, "hi": 1.0},
            {"query_id": "5", "kind": "regexp", "text": "[a"}, {"query_id": "6", "kind": "date_range"},
            {"query_id": "7", "kind": "term", "text": "x", "occur": "x"}, {"query_id": "8", "kind": "term", "text": "x", "field": "x"},
        ],
    )
    reasons = {r.query_id: r.reason for r in validate_queries(specs).collect()}
    assert reasons.pop("5") == "bad pattern"
    assert reasons == {"1": None, "2": "blank text", "3": "unknown kind", "4": "lo > hi", "6": "no bound", "7": "unknown occur", "8": "unknown field"}


def test_small_functions(spark):
    row = spark.createDataFrame([("a%b_c\\*?", "/", "//", "/x/y", "a.b*")], "p string, one string, two string, path string, t string").select(
        like_pattern("p"), is_regex_input("one"), is_regex_input("two"), path_rel("path", F.lit("/x")), path_dir(F.lit("/x")), path_dir(F.lit("x")), regex_quote("t"),
    ).first()
    assert tuple(row) == ("a\\%b\\_c\\\\%_", False, True, "y", "/", ".", "a\\.b\\*")


def test_group_folders_is_a_string_prefix(spark):
    folders = spark.createDataFrame([("src1/a",), ("src10/b",), ("other",)], "folder string")
    catalog = spark.createDataFrame([("src1",), ("src10",)], "index_id string")
    got = sorted(tuple(r) for r in group_folders(folders, catalog).collect())
    assert got == [("src1/a", "src1"), ("src10/b", "src1"), ("src10/b", "src10")]


def events(spark, rows):
    df = spark.createDataFrame(rows, "index_id string, path string, op string, s double, event_id int")
    return df.withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long"))).drop("s")


def test_quiet_periods_against_brute_force(spark):
    rng = random.Random(5)
    rows, t = [], 0.0
    for n in range(400):
        t += rng.choice([0.0, 1.0, 9.9, 10.0, 10.1, 25.0])
        rows.append(("i", f"i/{n % 9}", "update", round(t, 1), n))
    starts, last, want = None, None, {}
    for _, _, _, s, n in rows:
        if last is None or round(s - last, 1) > 10:
            starts = s
        want[n], last = starts, s
    got = {r.event_id: round(r.s, 1) for r in ch.debounce(events(spark, rows)).select("event_id", (F.unix_micros("batch_start") / 1e6).alias("s")).collect()}
    assert got == want


def test_diff_applied_to_old_is_new(spark):
    old = spark.createDataFrame([("i", "a", 1), ("i", "b", 2), ("i", "c", 3)], "index_id string, path string, size int").withColumn("mod_time", F.lit(None).cast("timestamp"))
    new = spark.createDataFrame([("i", "b", 2), ("i", "c", 4), ("i", "d", 5)], "index_id string, path string, size int").withColumn("mod_time", F.lit(None).cast("timestamp"))
    diff = {r.path: r.op for r in ch.snapshot_diff(old, new).collect()}
    assert diff == {"a": "delete", "c": "update", "d": "create"}


def test_rename_is_delete_and_create(spark):
    df = spark.createDataFrame(
        [("i", "new", "old", "RENAME", 1), ("i", "x", None, "Write", 2), ("i", "y", None, "chmod", 3), ("i", "z", None, "Create|Write", 4)],
        "index_id string, path string, old_path string, event string, event_id int",
    )
    got = sorted((r.path, r.op) for r in ch.normalize_changes(df).collect())
    assert got == [("new", "create"), ("old", "delete"), ("x", "update")]


def test_folder_event_reaches_all_files_below(spark):
    listing = spark.createDataFrame([("i", "i/a/1.md"), ("i", "i/a/b/2.md"), ("i", "i/c/3.md")], "index_id string, path string")
    got = sorted((r.path, r.event_id) for r in ch.expand_dir_events(events(spark, [("i", "i/a", "create", 1.0, 1), ("i", "i/c/3.md", "update", 2.0, 2)]), listing).collect())
    assert got == [("i/a/1.md", 1), ("i/a/b/2.md", 1), ("i/c/3.md", 2)]


def test_byte_batches_are_bounded(spark):
    docs = spark.range(1000).select(F.lit("i").alias("index_id"), F.col("id").cast("string").alias("path"), (F.col("id") % 50 + 1).alias("size"))
    sizes = ch.byte_batches(docs, 200, 4).groupBy("slice", "batch_no").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    assert sizes.agg(F.max("s")).first()[0] < 200 + 50
    assert sizes.agg(F.sum("n")).first()[0] == 1000


def test_stop_words_leave_gaps(spark):
    docs = documents(spark, ["the cat and the dog", "cat dog", "dog the cat", "the"])
    for positions in (True, False):
        rows = build_postings(docs, 2, positions=positions, stopwords=("the", "and")).collect()
        assert sorted((r.path[-5], r.term, r.tf) for r in rows) == [("0", "cat", 1), ("0", "dog", 1), ("1", "cat", 1), ("1", "dog", 1), ("2", "cat", 1), ("2", "dog", 1)]
    index = index_in_memory(docs, 2, stopwords=("the", "and"))
    ask = lambda **c: sorted(r.path[-5] for r in score_documents(index, query_specs(spark, [{"query_id": "q", **c}])).collect())
    assert ask(kind="match", text="the cat") == ["0", "1", "2"]
    assert ask(kind="phrase", text="cat and the dog") == ["0"]
    assert ask(kind="phrase", text="dog the cat") == ["2"]
    assert ask(kind="match", text="the and") == []
    one = score_documents(index, query_specs(spark, [{"query_id": "q", "kind": "match", "text": "the cat"}])).collect()
    other = score_documents(index, query_specs(spark, [{"query_id": "q", "kind": "match", "text": "cat"}])).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))
