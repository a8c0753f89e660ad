"""Registered queries that write, change and read back a real index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paperlantern.operators import changes as ch
from paperlantern.operators.clauses import query_specs, validate_queries
from paperlantern.plans.index import merge_segments, open_index, read_catalog, segments, skipped, write_index
from paperlantern.plans.maintain import apply_changes, initial_scan, live_documents, reindex, remove_folder
from paperlantern.plans.search import search
from paperlantern.session import cut_lineage, near_keys, scratch_dir, settle, small_side
from paperlantern.sources.changelog import read_change_log, write_change_log
from paperlantern.sources.files import corpus_scan, large_file_lines
from paperlantern.streaming.stream import stream_index
from paperlantern.workload import fixtures as fx
from paperlantern.workload.fixtures import CHANGES_SQL, DOCS_SQL, LAST_SQL
from paperlantern.workload.registry import register

_TS = "strftime(mod_time, '%Y-%m-%d %H:%M:%S.%f')"
KEY = ["index_id", "path"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf: str, **options) -> str:
    root = _folder(spark, "upkeep")
    write_index(fx.documents(spark, sf), root, fx.catalog(spark, sf), buckets=16, positions=False, **options)
    return root


def _shown(spark: SparkSession, root: str) -> DataFrame:
    documents = open_index(spark, root).documents
    return documents.select(*KEY, "size", F.date_format("mod_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("mod_time"))


def _changed(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """The documents as the last of these changes leaves them: their time is that of the change.

    The changes are known first, so that texts are not shuffled to meet a number that can be broadcast;
    beyond it only texts whose key has the hash of a changed one are."""
    last = settle(ch.last_change(changes).select(*KEY, "ts"))
    return near_keys(docs, last, KEY).join(small_side(last), KEY).withColumn("mod_time", F.col("ts")).drop("ts")


_ALL_SQL = f"WITH {DOCS_SQL} SELECT index_id, path, size, {_TS} AS mod_time FROM docs"
_LIVE_SQL = f"""WITH {DOCS_SQL}, {CHANGES_SQL}, {LAST_SQL}
  SELECT d.index_id, d.path, d.size, strftime(coalesce(f.ts, d.mod_time), '%Y-%m-%d %H:%M:%S.%f') AS mod_time
  FROM docs d LEFT JOIN final f USING (index_id, path) WHERE coalesce(f.op, '') <> 'delete'"""


@register("s4_write_index_replayed", _ALL_SQL)
def s4(spark, sf):
    """The same segment written two times, then a second one with names that exist."""
    root = _written(spark, sf, seq=0)
    for seq in (0, 1):
        write_index(fx.documents(spark, sf), root, fx.catalog(spark, sf), positions=False, seq=seq)
    return _shown(spark, root)


@register(
    "s1_skipped_files",
    f"""WITH {DOCS_SQL}, {CHANGES_SQL}, {LAST_SQL}
  SELECT d.index_id, d.path, CASE WHEN d.size = 0 THEN 'empty' ELSE 'unreadable' END AS reason
  FROM docs d JOIN final f USING (index_id, path) WHERE f.op = 'delete'""",
)
def s1_skipped(spark, sf):
    """Files that were deleted between the listing and the reading of a folder."""
    root, docs = _folder(spark, "upkeep"), fx.documents(spark, sf)
    read = live_documents(docs, fx.changes(spark, sf))
    write_index(read, root, fx.catalog(spark, sf), buckets=16, positions=False, listing=docs.select(*KEY, "size"))
    return skipped(spark, root).select(*KEY, "reason")


@register("s6_catalog", "SELECT DISTINCT source AS index_id, '/data/corpus' AS base_path, CAST(5 AS INTEGER) AS n_extensions FROM documents")
def s6(spark, sf):
    catalog = read_catalog(spark, _written(spark, sf))
    return catalog.select("index_id", "base_path", F.size("extensions").alias("n_extensions"))


@register("s7_s8_change_log", f"WITH {DOCS_SQL}, {CHANGES_SQL} SELECT index_id, path, op, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM changes")
def s7_s8(spark, sf):
    """Written in an order of its own, read back with time and number."""
    log = _folder(spark, "log")
    write_change_log(fx.changes(spark, sf).repartition(4, "event_id"), log)
    back = read_change_log(spark, log)
    return back.select(*KEY, "op", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("g5_ingest_progress", f"WITH {DOCS_SQL} SELECT count(*) AS documents, CAST(sum(size) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS failed FROM docs")
def g5(spark, sf):
    """What the write of an index reports about itself."""
    seen = Observation("documents")
    _written(spark, sf, progress=seen)
    return spark.createDataFrame([(seen.get["documents"], seen.get["bytes"], seen.get["failed"])], "documents long, bytes long, failed long")


@register("c4_c5_apply_changes", _LIVE_SQL)
def c4_c5(spark, sf):
    root = _written(spark, sf)
    changes = fx.changes(spark, sf)
    apply_changes(spark, root, changes, _changed(fx.documents(spark, sf), changes))
    return _shown(spark, root)


@register("c4_c5_merged_segments", _LIVE_SQL)
def c4_c5_merged(spark, sf):
    """The changes in three segments, which are then merged."""
    root = _written(spark, sf)
    changes = fx.changes(spark, sf)
    for part in range(3):
        some = changes.where(F.pmod(F.floor(F.unix_seconds("ts") / 86_400), F.lit(3)) <= part)
        apply_changes(spark, root, some, _changed(fx.documents(spark, sf), some))
    found = segments(spark, root)
    merge_segments(spark, root, found[1].seq, found[-1].seq)
    return _shown(spark, root)


@register("c10_remove_folder_from_index", f"WITH {DOCS_SQL} SELECT index_id, path FROM docs WHERE NOT (dir = 'src1' OR starts_with(dir, 'src1/'))")
def c10(spark, sf):
    root = _written(spark, sf)
    remove_folder(spark, root, "src1")
    return open_index(spark, root).documents.select(*KEY)


@register("c12_stream_index", _LIVE_SQL)
def c12(spark, sf):
    """The changes as a stream of four files in order of time, taken one by one."""
    root, feed = _written(spark, sf), _folder(spark, "feed")
    # made once; a file is written by one task, but what it holds is not made by one
    changes = cut_lineage(fx.changes(spark, sf).select(*KEY, "op", "ts", "event_id"))
    bounds = changes.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75], 1000).alias("b")).first().b or []
    for low, high in zip([None, *bounds], [*bounds, None]):
        some = changes
        some = some.where(F.unix_micros("ts") > low) if low is not None else some
        some = some.where(F.unix_micros("ts") <= high) if high is not None else some
        some.repartition(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema("index_id string, path string, op string, ts timestamp, event_id long")
    stream = stream.option("maxFilesPerTrigger", 1).parquet(feed)
    docs = fx.documents(spark, sf)
    query = stream_index(stream, root, lambda batch: _changed(docs, batch), _folder(spark, "stream"), gap=None, trigger={"availableNow": True})
    query.awaitTermination()
    return _shown(spark, root)


@register("c7_c12_cut_stream_batch", _LIVE_SQL)
def c7_c12(spark, sf):
    """The changes as one batch of a stream, its documents written in parts of a quarter of all bytes."""
    root, feed, docs = _written(spark, sf), _folder(spark, "feed"), fx.documents(spark, sf)
    fx.changes(spark, sf).select(*KEY, "op", "ts", "event_id").write.parquet(feed)
    stream = spark.readStream.schema("index_id string, path string, op string, ts timestamp, event_id long").parquet(feed)
    quarter = (docs.agg(F.sum("size")).first()[0] or 0) // 4 + 1
    query = stream_index(
        stream, root, lambda batch: _changed(docs, batch), _folder(spark, "stream"), gap=None, trigger={"availableNow": True}, batch_bytes=quarter
    )
    query.awaitTermination()
    return _shown(spark, root)


#: So many bytes of texts go to one task and, of a source, to one file, at least.
FILE_BYTES = 64 * 1024 * 1024


def _files(spark: SparkSession, sf: str, folder: str, half: int | None = None) -> None:
    """Texts as files: one folder per source, new files added to those that are there.

    A source of more than ``FILE_BYTES`` is dealt over several files, so that no task grows with the table."""
    d = fx.table(spark, sf, "documents")
    d = d if half is None else d.where(F.pmod("doc_id", F.lit(2)) == half)
    sizes = settle(d.groupBy("source").agg(F.ceil(F.sum(F.octet_length("text")) / FILE_BYTES).cast("int").alias("files")))
    total = sizes.agg(F.sum("files")).first()[0] or 0
    d = d.join(small_side(sizes.select(F.col("source").alias("_source"), "files")), F.col("source").eqNullSafe(F.col("_source")))
    piece = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.coalesce("files", F.lit(1)), F.lit(1)))
    d = d.select("source", "text", piece.alias("piece")).repartition(max(2, total), "source", "piece").drop("piece")
    d.write.mode("append").partitionBy("source").option("lineSep", "\n").text(folder)


_BYTES_SQL = "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY source"


def _source():
    return F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source")


@register("s1_corpus_scan", _BYTES_SQL)
def s1(spark, sf):
    """Files of every size: those that are too large for one row are read line by line."""
    folder = _folder(spark, "corpus")
    _files(spark, sf, folder)
    whole = corpus_scan(spark, folder).select(_source(), F.octet_length("content").alias("n"))
    # every line was written with an end, which its content leaves out
    lines = large_file_lines(spark, folder).select(_source(), (F.octet_length("content") + 1).alias("n"))
    return whole.unionByName(lines).groupBy("source").agg(F.sum("n").alias("n_bytes"))


_TERMS_SQL = r"""SELECT source, term, count(*) AS n FROM (
  SELECT source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY source, term"""


def _term_counts(spark: SparkSession, root: str) -> DataFrame:
    return open_index(spark, root).postings.groupBy(_source(), "term").agg(F.sum("tf").alias("n"))


@register("c11_initial_scan", _TERMS_SQL)
def c11(spark, sf):
    """Files on disk, the larger ones read line by line."""
    folder, root = _folder(spark, "corpus"), _folder(spark, "scan")
    _files(spark, sf, folder)
    initial_scan(spark, root, folder, whole_file_bytes=20_000, buckets=16)
    return _term_counts(spark, root)


@register("c9_reindex", _TERMS_SQL)
def c9(spark, sf):
    """Half of the files indexed, the others added later."""
    folder, root = _folder(spark, "corpus"), _folder(spark, "scan")
    _files(spark, sf, folder, 0)
    initial_scan(spark, root, folder, buckets=16, positions=False)
    _files(spark, sf, folder, 1)
    reindex(spark, root, folder)
    return _term_counts(spark, root)


#: Each kind on each keyword field, and what it has to find.
_SIDE = [
    ({"query_id": "d_term", "kind": "term", "field": "dir", "text": "src1/en"}, "dir = 'src1/en'"),
    ({"query_id": "d_prefix", "kind": "prefix", "field": "dir", "text": "src1"}, "starts_with(dir, 'src1')"),
    ({"query_id": "d_regexp", "kind": "regexp", "field": "dir", "text": "src1[0-3]/.*"}, "regexp_full_match(dir, 'src1[0-3]/.*')"),
    ({"query_id": "d_wildcard", "kind": "wildcard", "field": "dir", "text": "src?/d*"}, "dir LIKE 'src_/d%'"),
    ({"query_id": "d_fuzzy", "kind": "fuzzy", "field": "dir", "text": "src1/ex", "fuzziness": 1}, "levenshtein(dir, 'src1/ex') <= 1"),
    ({"query_id": "e_match", "kind": "match", "field": "extension", "text": ".md"}, "ext = '.md'"),
    ({"query_id": "e_prefix", "kind": "prefix", "field": "extension", "text": ".m"}, "starts_with(ext, '.m')"),
    ({"query_id": "e_regexp", "kind": "regexp", "field": "extension", "text": r"\.(go|py)"}, r"regexp_full_match(ext, '\.(go|py)')"),
    ({"query_id": "e_wildcard", "kind": "wildcard", "field": "extension", "text": "*o*"}, "ext LIKE '%o%'"),
    ({"query_id": "e_fuzzy", "kind": "fuzzy", "field": "extension", "text": ".mb", "fuzziness": 1}, "levenshtein(ext, '.mb') <= 1"),
]


@register(
    "q08_side_fields",
    f"WITH {DOCS_SQL} " + " UNION ALL ".join(f"SELECT '{c['query_id']}' AS query_id, index_id, path FROM docs WHERE {sql}" for c, sql in _SIDE),
)
def q08(spark, sf):
    hits = search(fx.stored_index(spark, sf), query_specs(spark, [c for c, _ in _SIDE]), None, 1 << 30)
    return hits.select("query_id", *KEY)


@register(
    "q15_reasons",
    """SELECT CAST(conv_id AS VARCHAR) AS query_id, CAST(turn AS INTEGER) AS clause_id,
  CASE WHEN turn % 7 = 6 THEN 'unknown kind' WHEN turn % 7 IN (3, 5) AND conv_id % 2 = 1 THEN 'kind does not fit field'
       WHEN turn % 7 IN (0, 1, 2) AND trim(text) = '' THEN 'blank text' WHEN turn % 7 = 3 AND conv_id % 3 = 0 THEN 'lo > hi'
       WHEN turn % 7 = 4 THEN 'bad pattern' END AS reason
  FROM conversations""",
)
def q15(spark, sf):
    """Every turn as a clause; kind and field follow its number."""
    turn, odd = F.col("turn") % 7, F.col("conv_id") % 2 == 1
    kinds = F.array(*[F.lit(k) for k in ("term", "match", "phrase", "numeric_range", "regexp", "date_range", "soundex")])
    field = F.when(turn == 3, F.when(odd, "dir").otherwise("size")).when(turn == 5, F.when(odd, "size").otherwise("mod_time")).otherwise("content")
    c = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("query_id"), F.col("turn").cast("int").alias("clause_id"), F.lit("should").alias("occur"),
        F.element_at(kinds, (turn + 1).cast("int")).alias("kind"), field.alias("field"),
        F.when(turn == 4, F.concat(F.lit("("), F.regexp_replace("text", r"[()\\\[\]]", ""))).otherwise(F.col("text")).alias("text"),
        F.when(turn == 3, F.when(F.col("conv_id") % 3 == 0, 9.0).otherwise(1.0)).alias("lo"), F.when(turn == 3, 5.0).alias("hi"),
        F.when(turn == 5, F.timestamp_seconds(F.lit(0))).alias("lo_ts"), F.lit(None).cast("timestamp").alias("hi_ts"),
        F.lit(None).cast("int").alias("fuzziness"), F.lit(1.0).alias("boost"),
    )
    return validate_queries(c).select("query_id", "clause_id", "reason")
