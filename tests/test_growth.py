"""What one task or one shuffle holds does not follow the size of the tables."""

import pytest
from pyspark.sql import functions as F

from paperlantern import session
from paperlantern.operators.clauses import query_specs
from paperlantern.operators.lookup import term_grams, term_spellings
from paperlantern.plans import index as index_plan, search as search_plan
from paperlantern.plans.index import index_in_memory, open_index, write_index
from paperlantern.plans.maintain import apply_changes
from paperlantern.sources.files import WHOLE_FILE_BYTES
from paperlantern.streaming.stream import stream_index
from paperlantern.workload import upkeep


def docs(spark, texts):
    rows = [("c", f"c/{n}.txt", "c", ".txt", len(t), t) for n, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "index_id string, path string, dir string, ext string, size long, content string")
    return d.withColumn("mod_time", F.timestamp_seconds(F.lit(0)))


def test_more_terms_make_more_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_plan, "_LOOKUP_BYTES", 100)
    path = str(tmp_path / "terms")
    spark.range(2_000).select(F.md5(F.col("id").cast("string")).alias("term")).write.parquet(path)
    assert index_plan._lookup_parts(spark.read.parquet(path)) > 100 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_large_source_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upkeep, "FILE_BYTES", 1_000)
    rows = [(n, f"text {n} " + "x" * 90, "big") for n in range(100)] + [(100, "alone", "small"), (101, None, None), (101, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    upkeep._files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "source=big").glob("*.txt"))) > 3
    assert len(list((tmp_path / "out" / "source=small").glob("*.txt"))) == 1
    lines = sorted(r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "out")).collect())
    assert lines == sorted(t or "" for _, t, _ in rows)


def test_a_scan_reads_the_files_too_large_for_one_row(spark, tmp_path):
    big = WHOLE_FILE_BYTES // 4
    rows = [(n, f"{n} \u00e9\n" + "x" * big, "big") for n in range(5)] + [(5, "alone\nand short", "small"), (6, "", "small")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.source: r.n_bytes for r in upkeep.s1(spark, str(tmp_path)).collect()}
    assert got == {"big": 5 * (big + 6), "small": 17}


def test_open_patterns_that_forbid_are_tried_on_the_postings(spark, monkeypatch):
    asked = []
    resolve = search_plan.resolve_terms

    def seen(index, clauses, *rest):
        asked.extend(r.text for r in clauses.collect())
        return resolve(index, clauses, *rest)

    monkeypatch.setattr(search_plan, "resolve_terms", seen)
    index = index_in_memory(docs(spark, ["the zoo", "the ant", "the the", "zoo", "of zoo", ""]))
    specs = query_specs(spark, [
        {"query_id": "a", "kind": "term", "text": "the"}, {"query_id": "a", "occur": "must_not", "kind": "regexp", "text": "[a-m].*"},
        {"query_id": "b", "occur": "must_not", "kind": "wildcard", "text": "t*"},
        {"query_id": "b", "occur": "must_not", "kind": "prefix", "text": "o"},
    ])
    got = sorted((r.query_id, r.path) for r in search_plan.score_documents(index, specs).collect())
    assert got == [("a", "c/0.txt"), ("a", "c/2.txt"), ("b", "c/3.txt"), ("b", "c/5.txt")]
    assert "[a-m].*" not in asked and "the" in asked


@pytest.mark.parametrize(("phrase", "found"), [("a b", {0: 2, 1: 1}), ("a a", {3: 2}), ("b a b", {0: 1, 1: 1}), ("zz a", {}), ("a", {0: 2, 1: 1, 2: 1, 3: 3})])
def test_phrases_keep_positions_as_arrays(spark, phrase, found):
    index = index_in_memory(docs(spark, ["a b a b", "b a b", "b a", "a a a"]))
    specs = query_specs(spark, [{"query_id": "q", "kind": "phrase", "text": phrase}])
    clauses = search_plan.prepare_clauses(specs)
    terms = search_plan.resolve_terms(index, clauses, index.stats, None)
    hits = search_plan._phrase_hits(index.postings.select("index_id", "path", "bucket", "term", "positions", "n_tokens"), terms, None)
    assert {int(r.path[2:-4]): r.tf for r in hits.collect()} == found
    assert "explode(positions" not in hits._jdf.queryExecution().executedPlan().toString()


def test_terms_beyond_a_broadcast_narrow_the_postings(spark, monkeypatch):
    index = index_in_memory(docs(spark, ["the thin thing", "thick sing", "zoo of rings", "that that", "of sang", "thn"]))
    specs = query_specs(spark, [
        {"query_id": "a", "kind": "prefix", "text": "th"}, {"query_id": "b", "kind": "wildcard", "text": "*ing"}, {"query_id": "c", "kind": "term", "text": "zoo"},
        {"query_id": "d", "kind": "regexp", "text": "s[ai]ng"}, {"query_id": "e", "kind": "fuzzy", "text": "thin", "fuzziness": 1},
        {"query_id": "f", "occur": "must", "kind": "match", "text": "that zoo"}, {"query_id": "f", "kind": "prefix", "text": "r"},
    ])
    columns = ["query_id", "path", "score"]
    want = sorted(map(tuple, search_plan.score_documents(index, specs).select(columns).collect()))
    seen, narrow = [], search_plan._asked_postings

    def kept(*given):
        seen.append(narrow(*given))
        return seen[-1]

    monkeypatch.setattr(search_plan, "_asked_postings", kept)
    monkeypatch.setattr(search_plan, "BROADCAST_ROWS", 2)
    got = search_plan.score_documents(index, specs)
    assert sorted(map(tuple, got.select(columns).collect())) == want and len(want) > 8
    assert sorted({r.term for r in seen[0].collect()}) == ["rings", "sang", "sing", "that", "the", "thick", "thin", "thing", "thn", "zoo"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_do_not_move_to_meet_a_few_changes(spark):
    d = docs(spark, ["one", "two", "three"])
    at = "timestamp_seconds(id)"
    changes = spark.range(1, 6).selectExpr("'c' AS index_id", "'c/' || (id % 2) || '.txt' AS path", "'update' AS op", f"{at} AS ts", "id AS event_id")
    # texts too large for a broadcast, so that without the count both sides would be shuffled
    changed = upkeep._changed(d.hint("merge"), changes)
    assert sorted((r.path, r.content, r.t) for r in changed.selectExpr("path", "content", "unix_seconds(mod_time) AS t").collect()) == [
        ("c/0.txt", "one", 4), ("c/1.txt", "two", 5)
    ]
    assert "BroadcastHashJoin" in plan(changed) and "SortMergeJoin" not in plan(changed)


def tasks_of(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_changed_documents_of_one_split_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(index_plan, "_TASK_BYTES", 100)
    together = docs(spark, [f"text {n} " + "x" * 40 for n in range(40)]).coalesce(1)
    (part,) = index_plan._parts(together, 10_000, "never written")
    assert tasks_of(together) == 1 and tasks_of(part) > 4
    assert sorted(r.path for r in part.collect()) == sorted(r.path for r in together.collect())
    (few,) = index_plan._parts(docs(spark, ["x" * 90]), 10_000, "never written")
    assert tasks_of(few) == 1


def test_a_part_of_a_large_batch_is_several_files(spark, tmp_path):
    d = docs(spark, [f"text {n} " + "x" * (n % 7) for n in range(400)] + ["y" * 900, ""])
    d = d.unionByName(d.where("path = 'c/5.txt'").withColumn("index_id", F.lit("other")))
    limit = 600
    parts = index_plan._parts(d, limit, str(tmp_path / "parts"))
    sizes = [p.agg(F.sum("size")).first()[0] for p in parts]
    assert len(parts) > 5 and sorted(sizes)[-2] <= limit and 900 <= max(sizes) < limit + 900
    assert sum(len(p.inputFiles()) > 4 for p in parts) >= len(parts) - 2
    got = sorted((r.index_id, r.path, r.content) for p in parts for r in p.collect())
    assert got == sorted((r.index_id, r.path, r.content) for r in d.collect())


def test_a_batch_in_parts_leaves_what_an_uncut_one_leaves(spark, tmp_path, monkeypatch):
    written, write = [], index_plan._write_rows

    def seen(rows, *rest):
        written.append(rows.where("bucket < 0 AND NOT deleted").agg(F.sum("size")).first()[0] or 0)
        write(rows, *rest)

    monkeypatch.setattr(index_plan, "_write_rows", seen)
    old, new = (docs(spark, [f"{word} text {n:03d} " + "filler " * 20 for n in range(60)]) for word in ("old", "new"))
    changes = new.selectExpr("index_id", "path", "if(path LIKE '%5.txt', 'delete', 'update') AS op", "mod_time AS ts", "1 AS event_id")
    states = []
    for limit in (2_000, None):
        root = str(tmp_path / str(limit))
        write_index(old, root, buckets=2)
        written.clear()
        apply_changes(spark, root, changes, new, batch_bytes=limit)
        assert (len(written) > 4) == (limit is not None) and (limit is None or max(written) <= limit + 200)
        assert [s.seq for s in index_plan.segments(spark, root)] == [0, 1]
        index = open_index(spark, root)
        tables = (index.documents.select("path", "size"), index.postings.select("path", "term", "tf"), index.stats)
        states.append([sorted(map(tuple, t.collect())) for t in tables])
    assert states[0] == states[1] and len(states[0][0]) == 54
    assert not list((tmp_path / "..").glob("shared*/parts-*"))


def test_a_stream_hands_on_the_last_change_of_a_path(spark, tmp_path):
    d = docs(spark, ["one", "two", "three"])
    write_index(d, str(tmp_path / "index"), buckets=2)
    events = spark.range(90).selectExpr("'c' AS index_id", "'c/' || (id % 3) || '.txt' AS path", "if(id = 88, 'delete', 'update') AS op", "timestamp_seconds(id) AS ts", "id AS event_id")
    events.coalesce(1).write.parquet(str(tmp_path / "feed"))
    given = []

    def corpus(batch):
        given.extend(sorted((r.path, r.op, r.event_id) for r in batch.collect()))
        return d

    feed = spark.readStream.schema(events.schema).parquet(str(tmp_path / "feed"))
    stream_index(feed, str(tmp_path / "index"), corpus, str(tmp_path / "stream"), gap=None, trigger={"availableNow": True}).awaitTermination()
    assert given == [("c/0.txt", "update", 87), ("c/1.txt", "delete", 88), ("c/2.txt", "update", 89)]
    assert sorted(r.path for r in open_index(spark, str(tmp_path / "index")).documents.collect()) == ["c/0.txt", "c/2.txt"]


def test_texts_that_no_change_names_are_not_shuffled(spark, monkeypatch):
    d = docs(spark, [f"text {n}" for n in range(50)])
    keys = spark.range(0, 6).selectExpr("if(id = 5, null, 'c') AS index_id", "'c/' || id * 9 || '.txt' AS path")
    assert session.near_keys(d, keys, ["index_id", "path"]) is d  # few enough for a broadcast
    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    near = session.near_keys(d, keys, ["index_id", "path"])
    assert sorted(r.path for r in near.collect()) == [f"c/{n}.txt" for n in (0, 18, 27, 36, 9)] and near.columns == d.columns
    assert "BroadcastHashJoin" in plan(near) and "hashpartitioning(index_id" not in plan(near)
    monkeypatch.setattr(session, "HASHED_ROWS", 5)
    assert session.near_keys(d, keys, ["index_id", "path"]) is d


def test_the_feed_of_changes_is_not_made_by_one_task(spark, tmp_path, monkeypatch):
    made, cut = [], upkeep.cut_lineage
    monkeypatch.setattr(upkeep, "cut_lineage", lambda df: made.append(cut(df)) or made[-1])
    rows = [(n, f"text {n}", "en", f"s{n % 2}") for n in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    kind = "element_at(array('signup', 'view', 'error'), CAST(id % 3 + 1 AS INT)) AS event_type"
    spark.range(0, 60).selectExpr("id AS event_id", "CAST(timestamp_seconds(id) AS timestamp_ntz) AS ts", "id % 7 AS user_id", kind).write.parquet(str(tmp_path / "events.parquet"))
    shown = {r.path: r.mod_time[:19] for r in upkeep.c12(spark, str(tmp_path)).collect()}
    assert [df.count() for df in made] == [60] and tasks_of(made[0]) > 1
    last = {n % 7: n for n in range(60)}  # of a user
    gone = {user for user, n in last.items() if n % 3 == 2}
    assert len(shown) == 20 - len(gone) and len(gone) > 1
    assert {int(p.split("/")[2].split(".")[0]) for p in shown} == set(range(20)) - gone
    user = next(u for u in last if u not in gone)
    assert [t for p, t in shown.items() if p.split("/")[2].split(".")[0] == str(user)] == [f"1970-01-01 00:00:{last[user]:02d}"]


@pytest.mark.parametrize("positions", [True, False])
def test_side_fields_of_postings_are_not_shuffled(spark, tmp_path, monkeypatch, positions):
    shuffled, write = [], index_plan._write_bucketed

    def seen(df, path, *rest, **options):
        shuffled.append((path, df.columns))
        write(df, path, *rest, **options)

    monkeypatch.setattr(index_plan, "_write_bucketed", seen)
    d = docs(spark, ["b a b", "", "c"]).withColumn("mod_time", F.timestamp_seconds("size"))
    write_index(d, str(tmp_path), buckets=4, positions=positions)
    columns = next(c for path, c in shuffled if "/rows/" in path)
    assert not {"ext", "size", "mod_time", "deleted"} & set(columns) and ("positions" in columns) == positions
    index = open_index(spark, str(tmp_path))
    assert sorted((r.path, r.ext, r.size, r.mod_time.second, r.n_tokens) for r in index.documents.collect()) == [
        ("c/0.txt", ".txt", 5, 5, 3), ("c/1.txt", ".txt", 0, 0, 0), ("c/2.txt", ".txt", 1, 1, 1)
    ]
    got = sorted((r.path, r.term, r.tf, r.positions) for r in index.postings.collect())
    held = lambda *places: list(places) if positions else None
    assert got == [("c/0.txt", "a", 1, held(1)), ("c/0.txt", "b", 2, held(0, 2)), ("c/2.txt", "c", 1, held(0))]


def test_hashes_of_a_term_are_made_from_its_characters_once(spark):
    terms = spark.createDataFrame([("aaaa",), ("ab",), ("\u00e9t\u00e9",), ("abcdefghij",)], "term string")
    grams, spelled = term_grams(terms), term_spellings(terms)
    for table, column in ((grams, "gram"), (spelled, "spelling")):
        rows = [tuple(r) for r in table.select("term", column).collect()]
        assert len(rows) == len(set(rows))
    known = spark.createDataFrame([("ab", s) for s in ("ab", "a", "b", "")] + [("aaaa", s) for s in ("aaaa", "aaa", "aa")], "term string, s string")
    want = sorted(map(tuple, known.select("term", F.hash("s")).collect()))
    assert sorted(tuple(r) for r in spelled.select("term", "spelling").collect() if r.term in ("ab", "aaaa")) == want
    assert "substring" not in next(line for line in plan(spelled).splitlines() if "Generate" in line)
