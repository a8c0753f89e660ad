"""Folders of real files: names, bytes, line ends, large files, whole life of an index."""

import os

import pytest
from pyspark.sql import functions as F

from paperlantern.operators.analyze import large_file_documents, large_file_rows, posting_rows
from paperlantern.operators.clauses import query_specs
from paperlantern.operators.changes import last_change
from paperlantern.operators.preview import highlight_segments, match_locations, preview, preview_large, preview_lines
from paperlantern.plans import index as index_plans
from paperlantern.plans.index import compact, merge_segments, open_index, read_catalog, segments, skipped, write_index
from paperlantern.plans.maintain import apply_changes, initial_scan, reindex, remove_folder
from paperlantern.plans.search import search
from paperlantern.sources.catalog import catalog_rows, list_indexes, register_index
from paperlantern.sources.changelog import read_change_log, write_change_log
from paperlantern.sources.files import corpus_listing, corpus_scan, large_file_lines, skipped_files

FILES = {
    "a.txt": b"hello\r\n\nworld",
    "B.TXT": b"upper extension",
    "noext": b"none",
    "sp ace.md": b"blank in name",
    "a+b.md": b"plus in name",
    "p%q.md": b"percent in name",
    "sub/y.go": b"caf\xe9",
    "sub/.log": b"hidden",
    "_h/x.md": b"hidden folder",
    "e.txt": b"",
}


@pytest.fixture()
def folder(tmp_path):
    for name, data in FILES.items():
        file = tmp_path / "base" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    return str(tmp_path / "base")


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def scanned_files(df):
    """Names of the files the scan node of a plan really selected."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size() > 0:
        plan = plan.children().apply(0)
    partitions = plan.inputRDDs().apply(0).partitions()
    return sorted({f.urlEncodedPath() for p in partitions for f in p.files()})


VISIBLE = ["base/a+b.md", "base/a.txt", "base/p%q.md", "base/sp ace.md", "base/sub/y.go"]


def test_scan_names_and_bytes(spark, folder):
    docs = corpus_scan(spark, folder)
    assert paths(docs) == VISIBLE
    rows = {r.path: r for r in docs.collect()}
    assert rows["base/sub/y.go"].content == "caf�"
    assert rows["base/sub/y.go"].size == 4
    assert rows["base/sub/y.go"].dir == "base/sub" and rows["base/sub/y.go"].ext == ".go"
    listing = corpus_listing(spark, folder)
    assert set(paths(listing)) >= set(VISIBLE)
    assert "content" not in listing.columns


def test_preview_lines_of_crlf(spark, folder):
    docs = corpus_scan(spark, folder).where("ext = '.txt'")
    assert [(r.row_id, r.line) for r in preview_lines(docs).orderBy("row_id").collect()] == [(0, "hello"), (1, "world")]


def test_large_file_is_not_opened_whole(spark, folder):
    with open(os.path.join(folder, "big.log"), "w") as f:
        f.write("\n".join(f"line {i} the end" for i in range(2000)))
    docs = corpus_scan(spark, folder, whole_file_bytes=1000)
    assert "base/big.log" not in paths(docs)
    # the size is known from the listing: the file is no part of the scan
    assert not any("big.log" in f for f in scanned_files(docs))
    lines = large_file_lines(spark, folder, whole_file_bytes=1000)
    assert [f.rpartition("/")[2] for f in scanned_files(lines)] == ["big.log"]


def test_large_file_lines_give_the_same_postings(spark, folder):
    with open(os.path.join(folder, "big.log"), "w") as f:
        f.write("\n".join(f"line {i % 7} the end of the line" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = large_file_lines(spark, folder, whole_file_bytes=1000)
        assert lines.select("block").distinct().count() > 2
        whole = posting_rows(corpus_scan(spark, folder).where("path = 'base/big.log'").select("index_id", "path", "content"))
        want = {r.term: (r.tf, r.n_tokens, r.positions) for r in whole.collect()}
        got = {}
        for r in large_file_rows(lines).collect():
            tf, n, pos = got.get(r.term, (0, 0, []))
            got[r.term] = (tf + r.tf, r.n_tokens, sorted(pos + r.positions))
        assert got == want
        assert large_file_documents(lines).first().n_tokens == 21000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def hits(spark, root, *clauses):
    index = open_index(spark, root)
    return search(index, query_specs(spark, [{"query_id": "q", **c} for c in clauses]))


def test_life_of_an_index(spark, folder, tmp_path):
    root = str(tmp_path / "index")
    with open(os.path.join(folder, "big.log"), "w") as f:
        f.write("\n".join(f"row {i} hello giant" for i in range(500)))
    initial_scan(spark, root, folder, whole_file_bytes=1000, buckets=4)
    assert paths(hits(spark, root, {"kind": "term", "text": "hello"})) == ["base/a.txt", "base/big.log"]
    assert paths(hits(spark, root, {"kind": "phrase", "text": "hello giant row"})) == ["base/big.log"]
    full = hits(spark, root, {"kind": "term", "text": "world"}).first().full_path
    assert full == os.path.join(folder, "a.txt")

    # a second index of that name is refused, with its documents
    initial_scan(spark, root, folder, whole_file_bytes=1000)
    assert read_catalog(spark, root).count() == 1
    assert open_index(spark, root).documents.count() == 6

    # reindex: one changed, one new, one gone
    with open(os.path.join(folder, "a.txt"), "w") as f:
        f.write("goodbye moon")
    with open(os.path.join(folder, "new.md"), "w") as f:
        f.write("hello again")
    os.remove(os.path.join(folder, "a+b.md"))
    with open(os.path.join(folder, "big.log"), "a") as f:
        f.write("\nappended walrus")
    reindex(spark, root, folder, whole_file_bytes=1000)
    assert paths(hits(spark, root, {"kind": "term", "text": "walrus"})) == ["base/big.log"]
    assert paths(hits(spark, root, {"kind": "term", "text": "hello"})) == ["base/big.log", "base/new.md"]
    assert paths(hits(spark, root, {"kind": "term", "text": "moon"})) == ["base/a.txt"]
    assert paths(hits(spark, root, {"kind": "term", "text": "plus"})) == []
    assert {r.index_id: r.n_docs for r in open_index(spark, root).stats.collect()} == {"base": 6}

    # remove a folder, then compact: same answers from one segment
    remove_folder(spark, root, "base/sub")
    everything = [{"kind": "match", "text": "hello moon name caf giant"}]
    before = [tuple(r) for r in hits(spark, root, *everything).orderBy("path").collect()]
    assert not [r for r in before if "sub/" in r[3]]
    compacted = str(tmp_path / "compacted")
    compact(spark, root, compacted)
    assert len(segments(spark, compacted)) == 1
    assert [tuple(r) for r in hits(spark, compacted, *everything).orderBy("path").collect()] == before


def test_deleting_everything_leaves_no_hit(spark, folder, tmp_path):
    root = str(tmp_path / "index")
    initial_scan(spark, root, folder, buckets=4)
    index = open_index(spark, root)
    gone = index.documents.select("index_id", "path", F.lit("delete").alias("op"), F.current_timestamp().alias("ts"), F.lit(1).alias("event_id"))
    apply_changes(spark, root, gone, corpus_scan(spark, folder))
    assert open_index(spark, root).documents.count() == 0
    assert hits(spark, root, {"kind": "match", "text": "hello name"}).count() == 0
    assert hits(spark, root, {"kind": "match_all"}).count() == 0


def test_replaying_a_batch_changes_nothing(spark, folder, tmp_path):
    root = str(tmp_path / "index")
    initial_scan(spark, root, folder, buckets=4)
    changes = spark.createDataFrame(
        [("base", "base/a.txt", "update", 1), ("base", "base/sub/y.go", "delete", 2)], "index_id string, path string, op string, event_id int"
    ).withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    state = []
    for _ in range(2):
        apply_changes(spark, root, changes, corpus_scan(spark, folder), seq=1)
        index = open_index(spark, root)
        state.append((sorted(map(str, index.stats.collect())), paths(index.documents), len(segments(spark, root))))
    assert state[0] == state[1]


def test_catalog(spark, tmp_path):
    new = catalog_rows(spark, [("/x/src", [".md"]), (" /y/src/ ", [".md"]), ("/z/doc", [".go"]), ("  ", [])])
    old = catalog_rows(spark, [("/old/doc", [".txt"])])
    accepted = [(r.index_id, r.base_path) for r in register_index(old, new).collect()]
    assert accepted == [("src", "/x")]
    lines = spark.createDataFrame([(" /a/b \r",), ("",), ("  ",), ("/c",)], "value string")
    assert sorted(r.folder for r in list_indexes(lines).collect()) == ["/a/b", "/c"]


def test_change_log_round_trip(spark, tmp_path):
    log = str(tmp_path / "log")
    changes = spark.createDataFrame([("create", "src/a:b.md"), ("delete", "src/c.md")], "op string, path string")
    write_change_log(changes, log)
    write_change_log(spark.createDataFrame([("update", "doc/d.md")], "op string, path string"), log)
    got = sorted((r.index_id, r.path, r.op) for r in read_change_log(spark, log).collect())
    assert got == [("doc", "doc/d.md", "update"), ("src", "src/a:b.md", "create"), ("src", "src/c.md", "delete")]


def test_change_log_keeps_the_order(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("src/a@1#2:b.md", "create", 10, 1), ("src/a@1#2:b.md", "delete", 10, 2), ("src/c.md", "delete", 20, 3), ("src/c.md", "create", 30, 4)]
    changes = spark.createDataFrame(rows, "path string, op string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for n in (1, 0, 3, 2):  # the later change in the earlier file
        write_change_log(changes.where(F.col("event_id") == n + 1), log)
    back = read_change_log(spark, log)
    assert sorted((r.path, r.op, r.event_id) for r in back.collect()) == sorted((p, o, n) for p, o, _, n in rows)
    final = {r.path: r.op for r in last_change(back).collect()}
    assert final == {"src/a@1#2:b.md": "delete", "src/c.md": "create"}


def test_skipped_files_are_named(spark, folder):
    os.chmod(os.path.join(folder, "a.txt"), 0o000)
    listing = corpus_listing(spark, folder)
    docs = corpus_scan(spark, folder)
    got = {(r.path, r.reason) for r in skipped_files(listing, docs).collect()}
    assert ("base/e.txt", "empty") in got or not [r for r in listing.collect() if r.path == "base/e.txt"]
    assert (("base/a.txt", "unreadable") in got) == ("base/a.txt" not in paths(docs))


def test_skipped_files_are_rows_of_the_write(spark, folder, tmp_path, monkeypatch):
    from paperlantern.plans import maintain

    root, scan, broken = str(tmp_path / "index"), maintain.corpus_scan, {"base/a.txt", "base/a+b.md"}
    monkeypatch.setattr(maintain, "corpus_scan", lambda *args, **named: scan(*args, **named).where(~F.col("path").isin(list(broken))))
    initial_scan(spark, root, folder, whole_file_bytes=1000)
    left = {r.path for r in skipped(spark, root).where("reason = 'unreadable'").collect()}
    assert left == broken and not left & set(paths(open_index(spark, root).documents))
    broken.remove("base/a.txt")
    reindex(spark, root, folder, whole_file_bytes=1000)  # tries both again
    got = {(r.path, r.seq) for r in skipped(spark, root).where("reason = 'unreadable'").collect()}
    assert got == {("base/a+b.md", 1)} and "base/a.txt" in paths(open_index(spark, root).documents)
    merge_segments(spark, root, 0, 1)
    assert {(r.path, r.seq) for r in skipped(spark, root).where("reason = 'unreadable'").collect()} == got
    os.remove(os.path.join(folder, "a+b.md"))
    reindex(spark, root, folder, whole_file_bytes=1000)
    assert skipped(spark, root).where("reason = 'unreadable'").count() == 0
    write_index(scan(spark, folder).limit(0), str(tmp_path / "other"))
    assert skipped(spark, str(tmp_path / "other")).count() == 0


def test_preview_of_a_large_file_is_that_of_the_whole(spark, folder):
    with open(os.path.join(folder, "big.log"), "w") as f:
        f.write("\r\n".join(f"line {i} the end" if i % 3 else "" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        specs = query_specs(spark, [{"query_id": "q", "kind": "match", "text": "end"}])
        hits = spark.createDataFrame([("q", "base", "base/big.log")], "query_id string, index_id string, path string")
        whole = preview(hits, corpus_scan(spark, folder), specs)
        lines = preview_large(hits, large_file_lines(spark, folder, whole_file_bytes=1000), specs)
        assert sorted(map(tuple, match_locations(lines).collect())) == sorted(map(tuple, match_locations(whole).collect()))
        assert match_locations(lines).count() > 1300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_matches_in_a_line(spark):
    line = "the x " * 20_000
    lines = spark.createDataFrame([("q", "i", "p", 0, line, r"\bthe\b")], "query_id string, index_id string, path string, row_id int, line string, pattern string")
    found = match_locations(highlight_segments(lines)).orderBy("match_no").collect()
    assert [(r.match_no, r.start, r.end, r.seg_id) for r in found] == [(i, 6 * i, 6 * i + 3, 2 * i) for i in range(20_000)]


def small_index(spark):
    docs = spark.createDataFrame([("base", f"base/{n}.txt", f"text {n}") for n in range(20)], "index_id string, path string, content string")
    docs = docs.select("*", F.lit(".txt").alias("ext"), F.length("content").cast("long").alias("size"), F.timestamp_seconds(F.lit(0)).alias("mod_time"))
    return docs, catalog_rows(spark, [("/x/base", [".txt"])])


def counts(spark, root):
    index = open_index(spark, root)
    return index.documents.count(), [(r.index_id, r.n_docs) for r in index.stats.collect()], [(r.index_id, r.base_path) for r in index.catalog.collect()]


def test_writing_a_segment_again_gives_the_same_index(spark, tmp_path):
    root = str(tmp_path / "index")
    docs, catalog = small_index(spark)
    for _ in range(2):
        write_index(docs, root, catalog, buckets=2, seq=0)
        assert counts(spark, root) == (20, [("base", 20)], [("base", "/x")])
    write_index(docs, root, catalog)  # another segment: the name is refused
    assert counts(spark, root) == (20, [("base", 20)], [("base", "/x")])


@pytest.mark.parametrize("step", ["commit", "term_dictionary"])
def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "index")
    docs, catalog = small_index(spark)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(index_plans, step, crash)
        with pytest.raises(RuntimeError):
            write_index(docs, root, catalog, buckets=2)
    assert open_index(spark, root) is None
    write_index(docs, root, catalog, buckets=2)
    assert counts(spark, root) == (20, [("base", 20)], [("base", "/x")])
    with monkeypatch.context() as m:  # a second attempt at the segment that fails leaves the first
        m.setattr(index_plans, step, crash)
        with pytest.raises(RuntimeError):
            write_index(docs, root, catalog, seq=0)
    assert counts(spark, root) == (20, [("base", 20)], [("base", "/x")])
