"""Index tables in Parquet: writing, opening, updating, compacting.

Below ``<root>``, for every attempt to write segment N (``seq=N/attempt=…``):

``rows/…/bucket=b``   postings (b >= 0, sorted by term) and document rows (b < 0,
                    empty term)
``terms/…/bucket=b``  document frequencies
``grams/…``           trigrams of the terms (hashes), a file per share of the terms, sorted, for patterns
``spellings/…``       beginnings of the terms with characters left out (hashes), likewise, for near spellings
``stats/…``           change of document count and bytes
``catalog/…``         collections that the segment brings
``skipped/…``         listed files that gave no document
``segments/seq=N``    commit records, written last; the newest one counts
``claims/seq=N``      empty files by which writers take numbers

All collections share the tables.  A segment is addressed by its number.  An attempt
has folders of its own and nothing refers to them before its commit record is
there: a crash leaves the index as it was, a retry counts once, and writing a
segment again replaces it as a whole.  Content is not kept.  A newer segment
supersedes the rows of a key in older ones.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paperlantern.functions.paths import path_dir
from paperlantern.operators.analyze import (
    build_postings,
    corpus_stats,
    document_bucket,
    large_file_documents,
    large_file_rows,
    posting_rows,
    term_bucket,
    term_dictionary,
    terms_of,
)
from paperlantern.operators.changes import byte_batches
from paperlantern.operators.lookup import term_grams, term_spellings
from paperlantern.session import scratch_dir, settle, small_side
from paperlantern.sources.catalog import CATALOG_SCHEMA, register_index
from paperlantern.sources.files import skipped_files
from paperlantern.sources.storage import create_new, exists, listed, remove
from paperlantern.streaming.progress import ingest_progress

KEY = ["index_id", "path"]
DEFAULT_BUCKETS = 64
_META = ["ext", "size", "mod_time"]


@dataclass(frozen=True)
class IndexTables:
    """What a search needs; the same from memory and from Parquet."""

    documents: DataFrame  # index_id path dir ext size mod_time (live)
    postings: DataFrame  # index_id bucket term path n_tokens tf positions (live)
    dictionary: DataFrame  # index_id bucket term df
    stats: DataFrame  # index_id n_docs (live)
    buckets: int
    exact_df: bool = True  # False: df may count superseded documents
    catalog: DataFrame | None = None
    positions: bool = True
    stopwords: tuple[str, ...] = ()
    grams: DataFrame | None = None  # gram (hash) term
    spellings: DataFrame | None = None  # spelling (hash) term


def index_in_memory(docs: DataFrame, buckets: int = 8, positions: bool = True, catalog: DataFrame | None = None, stopwords=()) -> IndexTables:
    """Tables straight from documents, nothing written."""
    postings = build_postings(docs, buckets, positions, stopwords=stopwords)
    live = docs.withColumn("n_tokens", F.size(terms_of("content"))).drop("content")
    return IndexTables(live, postings, term_dictionary(postings), corpus_stats(docs), buckets, True, catalog, positions, tuple(stopwords))


def _segment_rows(docs: DataFrame, buckets: int, positions: bool, stopwords=()) -> DataFrame:
    rows = posting_rows(docs.select(*KEY, *_META, "content"), positions, document_row=True, stopwords=stopwords)
    return _finish_rows(rows, buckets)


def _large_rows(lines: DataFrame, buckets: int, positions: bool, stopwords=()) -> DataFrame:
    heads = large_file_documents(lines).select(*KEY, *_META, "n_tokens", F.lit("").alias("term"), F.lit(0).alias("tf"))
    body = large_file_rows(lines, positions, stopwords)
    return _finish_rows(heads.unionByName(body, allowMissingColumns=True), buckets)


def _finish_rows(rows: DataFrame, buckets: int) -> DataFrame:
    is_doc = F.col("term") == ""
    if "positions" not in rows.columns:
        rows = rows.withColumn("positions", F.lit(None).cast("array<int>"))
    return rows.select(
        *KEY, "n_tokens", "term", "tf",
        F.when(is_doc, F.lit(None)).otherwise(F.col("positions")).alias("positions"),
        *[F.when(is_doc, F.col(c)).alias(c) for c in _META],
        F.when(is_doc, F.lit(False)).alias("deleted"),
        F.when(is_doc, document_bucket(buckets)).otherwise(term_bucket("term", buckets)).alias("bucket"),
    )


def _tombstones(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.select(
        *KEY,
        F.lit(0).alias("n_tokens"), F.lit("").alias("term"), F.lit(0).alias("tf"),
        F.lit(None).cast("array<int>").alias("positions"),
        F.lit(None).cast("string").alias("ext"), F.lit(None).cast("long").alias("size"),
        F.lit(None).cast("timestamp").alias("mod_time"),
        F.lit(True).alias("deleted"), document_bucket(buckets).alias("bucket"),
    )


def _write_bucketed(df: DataFrame, path: str, mode: str = "overwrite", finish=lambda df: df, **options) -> None:
    """One shuffle by bucket.  ``rebalance`` lets AQE split a bucket that a very
    frequent term made large over several tasks and files, and join small ones.
    ``finish`` adds what need not be shuffled and sorted."""
    (
        finish(df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "index_id"))
        .write.mode(mode).partitionBy("bucket").option("compression", "zstd").options(**options).parquet(path)
    )


#: Columns of postings that no scan prunes by.
_NO_BOUNDS = {f"parquet.column.statistics.enabled#{c}": "false" for c in ("path", "n_tokens", "tf")}


def _write_rows(rows: DataFrame, path: str, positions: bool, mode: str = "overwrite") -> None:
    """Most rows are postings, which only have a document's side fields as nulls: those travel
    as one value, and positions that the index does not hold not at all."""
    side = [*_META, "deleted"]
    narrow = [*KEY, "n_tokens", "term", "tf", *(["positions"] if positions else []), "bucket"]
    packed = rows.select(*narrow, F.when(F.col("deleted").isNotNull(), F.struct(*side)).alias("side"))
    held = F.col("positions") if positions else F.lit(None).cast("array<int>").alias("positions")
    wide = [*KEY, "n_tokens", "term", "tf", held, *[F.col(f"side.{c}").alias(c) for c in side], "bucket"]
    _write_bucketed(packed, path, mode, lambda df: df.select(*wide), **_NO_BOUNDS)


@dataclass(frozen=True)
class Segment:
    """What a commit record tells."""

    seq: int
    attempt: str
    buckets: int
    positions: bool
    supersedes: bool
    catalog: bool
    first: int = -1  # of the numbers that a merged segment stands for
    weight: int = 1  # segments merged into it
    stopwords: tuple[str, ...] = ()
    skipped: bool = False

    @property
    def lowest(self) -> int:
        return self.seq if self.first < 0 else self.first

    @property
    def folder(self) -> str:
        return f"seq={self.seq}/attempt={self.attempt}"


_COMMIT = "attempt string, buckets int, positions boolean, supersedes boolean, catalog boolean, first long, weight int, stopwords array<string>, at long, skipped boolean"


def _write_segment(spark, root, seq, rows, like, supersedes, before, catalog=None, listing=None) -> None:
    """``like`` is a segment whose layout this one shares.  ``rows`` is a list of tables, written one after another."""
    segment = replace(
        like, seq=seq, attempt=uuid.uuid4().hex, supersedes=supersedes, catalog=catalog is not None, first=-1, weight=1, skipped=listing is not None
    )
    for part in rows:
        _write_rows(part, f"{root}/rows/{segment.folder}", segment.positions, "append")
    beside = [lambda: _write_terms(spark, root, segment), lambda: _write_stats(spark, root, segment, before)]
    if catalog is not None:
        found = catalog.select("index_id", "base_path", "extensions", "created_at")
        beside.append(lambda: found.write.mode("overwrite").parquet(f"{root}/catalog/{segment.folder}"))
    if listing is not None:
        beside.append(lambda: _write_skipped(spark, root, segment, listing))
    _at_once(*beside)
    commit(spark, root, segment)


def _at_once(*jobs) -> None:
    """Writes that do not wait for each other."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def _write_terms(spark: SparkSession, root: str, segment: Segment) -> None:
    """Document frequencies of the written rows, and what finds terms by pattern and spelling."""
    rows = _read_rows(spark, root, [segment])
    _write_bucketed(term_dictionary(rows.where("bucket >= 0 AND tf > 0")), f"{root}/terms/{segment.folder}")
    terms = spark.read.schema("term string").parquet(f"{root}/terms/{segment.folder}")
    terms = terms.repartition(_lookup_parts(terms), "term").distinct()

    def sorted_by(column: str, table: DataFrame, folder: str) -> None:
        # hashes are too many for a dictionary, and only they are looked up by their bounds
        cheap = {f"parquet.enable.dictionary#{column}": "false", "parquet.column.statistics.enabled#term": "false"}
        table.sortWithinPartitions(column).write.mode("overwrite").option("compression", "zstd").options(**cheap).parquet(f"{root}/{folder}/{segment.folder}")

    _at_once(
        lambda: sorted_by("gram", term_grams(terms), "grams"),
        lambda: sorted_by("spelling", term_spellings(terms), "spellings"),
    )


#: A term makes some thirty rows, which one task sorts: so many bytes of the written terms go to it.
_LOOKUP_BYTES = 512 * 1024


def _lookup_parts(terms: DataFrame) -> int:
    """Shares of the terms, from the size of the files that hold them; no job.  More
    terms make more shares, not larger ones."""
    size = int(str(terms._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, -(-size // _LOOKUP_BYTES))


def _write_stats(spark: SparkSession, root: str, segment: Segment, before) -> None:
    docs = _read_rows(spark, root, [segment]).where("bucket < 0")
    delta = docs.where("NOT deleted").groupBy("index_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("n_bytes"))
    if before is not None:
        # what the changed keys held until now, read from their buckets only
        keys = docs.select(*KEY, "bucket").where(F.length("path") > 0)
        old = before.documents.join(small_side(keys), [*KEY, "bucket"], "left_semi").groupBy("index_id").agg(
            (-F.count(F.lit(1))).alias("n_docs"), (-F.sum("size")).alias("n_bytes")
        )
        delta = delta.unionByName(old)
    delta = delta.groupBy("index_id").agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_bytes").cast("long").alias("n_bytes"))
    delta.write.mode("overwrite").parquet(f"{root}/stats/{segment.folder}")


def _write_skipped(spark: SparkSession, root: str, segment: Segment, listing: DataFrame) -> None:
    """The listed files that are not among the written documents."""
    docs = _read_rows(spark, root, [segment]).where("bucket < 0 AND NOT deleted")
    skipped_files(listing, docs, None).write.mode("overwrite").parquet(f"{root}/skipped/{segment.folder}")


def skipped(spark: SparkSession, root: str) -> DataFrame:
    """(index_id, path, reason, seq) of the files that a write listed and could not read, or
    found empty, as of the last write that tried; without those that a later segment
    holds or buries."""
    found = segments(spark, root)
    if not any(s.skipped for s in found):
        return spark.createDataFrame([], f"{_SKIPPED}, seq long")
    return _still_skipped(spark, root, found)


def _still_skipped(spark: SparkSession, root: str, found: list[Segment]) -> DataFrame:
    paths = [f"{root}/skipped/{s.folder}" for s in found if s.skipped]
    rows = spark.read.schema(f"{_SKIPPED}, seq long, attempt string").option("basePath", f"{root}/skipped").parquet(*paths)
    last = rows.groupBy(*KEY).agg(F.max_by("reason", "seq").alias("reason"), F.max("seq").alias("seq"))
    later = _read_rows(spark, root, found).where("bucket < 0").select(*KEY, F.col("seq").alias("later"))
    return last.join(later, (last.index_id == later.index_id) & (last.path == later.path) & (F.col("later") > F.col("seq")), "left_anti")


_SKIPPED = "index_id string, path string, reason string"


def commit(spark: SparkSession, root: str, segment: Segment) -> None:
    """From here on the attempt is the segment; one small file, added and never replaced."""
    record = [(segment.attempt, segment.buckets, segment.positions, segment.supersedes, segment.catalog, segment.lowest, segment.weight, list(segment.stopwords), time.time_ns(), segment.skipped)]
    spark.createDataFrame(record, _COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/segments/seq={segment.seq}")


def segments(spark: SparkSession, root: str) -> list[Segment]:
    """Committed segments, oldest first; what a merged one stands for is left out."""
    path = f"{root}/segments"
    if not exists(spark, path):
        return []
    newest: dict[tuple[int, int], tuple[int, Segment]] = {}
    for r in spark.read.schema(f"{_COMMIT}, seq long").parquet(path).collect():
        segment = Segment(r.seq, r.attempt, r.buckets, r.positions, r.supersedes, r.catalog, r.first, r.weight, tuple(r.stopwords), bool(r.skipped))
        newest[r.first, r.seq] = max(newest.get((r.first, r.seq), (-1, segment)), (r.at, segment), key=lambda x: x[0])
    kept: list[Segment] = []
    for _, segment in sorted(newest.values(), key=lambda x: (x[1].lowest - x[1].seq, x[1].seq)):  # the widest first
        if not any(k.lowest <= segment.seq <= k.seq for k in kept):
            kept.append(segment)
    return sorted(kept, key=lambda k: k.seq)


def read_catalog(spark: SparkSession, root: str, found: list[Segment] | None = None) -> DataFrame:
    """Collections of the committed segments."""
    found = segments(spark, root) if found is None else found
    paths = [f"{root}/catalog/{s.folder}" for s in found if s.catalog]
    return spark.read.schema(CATALOG_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], CATALOG_SCHEMA)


def next_seq(spark: SparkSession, root: str) -> int:
    found = segments(spark, root)
    return found[-1].seq + 1 if found else 0


def claim_seq(spark: SparkSession, root: str, first: int) -> int:
    """The smallest number from ``first`` on that no other writer has taken, taken for the caller.

    Writers that run at once get numbers of their own, so no commit hides another.  A
    writer that dies leaves a number unused."""
    seq = max([first, *(int(name[4:]) + 1 for name, _ in listed(spark, f"{root}/claims") if int(name[4:]) >= first)])
    while not create_new(spark, f"{root}/claims/seq={seq}"):
        seq += 1
    return seq


#: Folders below the root that hold one folder per attempt.
_FOLDERS = ("rows", "terms", "grams", "spellings", "stats", "catalog", "skipped")


def clean_up(spark: SparkSession, root: str, older_than: float = 86_400.0) -> int:
    """Delete what no search can read any more: attempts without a commit that counts, and
    commit records and claims of segments that were merged.  Returns how many folders went.

    ``older_than`` seconds must have passed since a folder's last change: longer than any
    write takes, and than any search that began before a merge.  The last segment's
    record always stays, so numbers are not used again.
    """
    found = segments(spark, root)
    if not found:
        return 0
    limit = (time.time() - older_than) * 1000
    used, gone = {(s.seq, s.attempt) for s in found}, []
    merged = [n for s in found for n in range(s.lowest, s.seq)]
    for folder in _FOLDERS:
        for name, _ in listed(spark, f"{root}/{folder}"):
            if not name.startswith("seq=") or int(name[4:]) > found[-1].seq:
                continue  # not yet committed
            attempts = [(a, at) for a, at in listed(spark, f"{root}/{folder}/{name}") if a.startswith("attempt=")]
            dead = [a for a, at in attempts if at < limit and (int(name[4:]), a[8:]) not in used]
            gone += [f"{root}/{folder}/{name}"] if len(dead) == len(attempts) else [f"{root}/{folder}/{name}/{a}" for a in dead]
    for folder in ("segments", "claims"):
        there = dict(listed(spark, f"{root}/{folder}"))
        gone += [f"{root}/{folder}/seq={n}" for n in merged if there.get(f"seq={n}", limit) < limit]
    for path in gone:
        remove(spark, path)
    return len(gone)


def write_index(
    docs: DataFrame,
    root: str,
    catalog: DataFrame | None = None,
    buckets: int = DEFAULT_BUCKETS,
    positions: bool = True,
    large_lines: DataFrame | None = None,
    seq: int | None = None,
    progress: Observation | str | None = None,
    stopwords=(),
    listing: DataFrame | None = None,
) -> int:
    """Add new collections as one segment; texts are read and analysed once.

    ``catalog`` rows whose collection another segment has already are refused
    together with their documents; writing the same ``seq`` again accepts what it
    accepted before.  ``large_lines`` are files read line by line.  ``progress``
    observes the documents that are written (G5).  ``listing`` rows (index_id, path, size)
    without a document are kept as :func:`skipped` files.  Buckets, positions and stop words
    are those of the first segment from then on.
    """
    spark = docs.sparkSession
    found = segments(spark, root)
    like = found[0] if found else Segment(0, "", buckets, positions, False, False, stopwords=tuple(stopwords))
    seq = seq if seq is not None else claim_seq(spark, root, found[-1].seq + 1 if found else 0)
    if catalog is not None:
        others = [s for s in found if s.seq != seq]
        accepted = settle(register_index(read_catalog(spark, root, others), catalog))
        names = small_side(accepted.select("index_id"))
        docs = docs.join(names, "index_id", "left_semi")
        if large_lines is not None:
            large_lines = large_lines.join(names, "index_id", "left_semi")
        if listing is not None:
            listing = listing.join(names, "index_id", "left_semi")
    if progress is not None:
        docs = ingest_progress(docs, progress)
    layout = (like.buckets, like.positions, like.stopwords)
    rows = _segment_rows(docs, *layout)
    if large_lines is not None:
        rows = rows.unionByName(_large_rows(large_lines, *layout))
    _write_segment(spark, root, seq, [rows], like, False, None, accepted if catalog is not None else None, listing)
    return seq


def append_segment(
    spark: SparkSession,
    root: str,
    docs: DataFrame | None,
    deleted: DataFrame | None = None,
    seq: int | None = None,
    large_lines: DataFrame | None = None,
    listing: DataFrame | None = None,
    batch_bytes: int | None = None,
) -> int:
    """Replace documents by key and delete others, as one segment.

    ``listing`` names the files that were to be read (:func:`skipped`).  With ``batch_bytes``,
    documents of more than so many bytes are analysed and written in parts of about that size,
    one after another; all parts take effect with the one commit record (C7).

    Writers may run at once; of a key that two of them change, the higher number counts."""
    found = segments(spark, root)
    if not found:
        raise ValueError(f"no index at {root}")
    seq = seq if seq is not None else claim_seq(spark, root, found[-1].seq + 1)
    layout = (found[0].buckets, found[0].positions, found[0].stopwords)
    others = []
    if deleted is not None:
        others.append(_tombstones(deleted.select(*KEY).distinct(), found[0].buckets))
    if large_lines is not None:
        others.append(_large_rows(large_lines, *layout))
    before = open_index(spark, root, upto=seq)
    parts, folder = ([docs] if docs is not None else []), None
    try:
        if docs is not None and batch_bytes is not None:
            folder = f"{scratch_dir(spark)}/parts-{uuid.uuid4().hex}"
            parts = _parts(docs, batch_bytes, folder)
        rows = [_segment_rows(part, *layout) for part in parts]
        # deletions and lines go with the first part, so that a small change is one write
        rows = [reduce(DataFrame.unionByName, [*rows[:1], *others]), *rows[1:]]
        _write_segment(spark, root, seq, rows, found[0], True, before, listing=listing)
    finally:
        if folder is not None:
            remove(spark, folder)
    return seq


#: So many bytes of documents are worth a task of their own.
_TASK_BYTES = 4 * 1024 * 1024
#: So many pieces make a part, each a file of its own, so that many tasks write a part and read it.
_PIECES = 16


def _parts(docs: DataFrame, limit: int, folder: str) -> list[DataFrame]:
    """Documents in parts of ``limit`` bytes at most, or of one piece that ends with the document that reaches it.

    Up to ``limit`` bytes they are one part, dealt over tasks by size: where the changed documents lie
    in their table does not matter.  Beyond it they are read once and written below ``folder`` in pieces,
    by hash of the path, of which a part takes as many as it holds; a task sorts about one piece."""
    total = docs.agg(F.sum("size")).first()[0] or 0
    if total <= limit:
        tasks = -(-total // _TASK_BYTES)
        return [docs.repartition(tasks, "path") if tasks > 1 else docs]
    spark = docs.sparkSession
    docs = docs.select(*KEY, *_META, "content")
    cut = byte_batches(docs, limit, -(-total * _PIECES // limit)).withColumn("part", F.concat_ws("-", "slice", "batch_no"))
    cut.drop("slice", "batch_no").write.partitionBy("part").parquet(folder)
    written = spark.read.schema("size long, part string").parquet(folder).groupBy("part").agg(F.sum("size")).collect()
    parts, held = [], limit
    for name, size in sorted((r[0], r[1] or 0) for r in written):
        if held + size > limit:
            parts, held = [*parts, []], 0
        parts[-1].append(f"{folder}/part={name}")
        held += size
    return [spark.read.schema(docs.schema).parquet(*pieces) for pieces in parts]


def _read_rows(spark: SparkSession, root: str, found: list[Segment]) -> DataFrame:
    schema = (
        "index_id string, path string, n_tokens int, term string, tf int, positions array<int>, "
        "ext string, size long, mod_time timestamp, deleted boolean, seq long, attempt string, bucket int"
    )
    paths = [f"{root}/rows/{s.folder}" for s in found]
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(*paths).drop("attempt")


def _stats(spark: SparkSession, root: str, found: list[Segment]) -> DataFrame:
    stats = spark.read.schema("index_id string, n_docs long, n_bytes long").parquet(*[f"{root}/stats/{s.folder}" for s in found])
    return stats.groupBy("index_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))


def _newest_rows(rows: DataFrame, newer: list[int]) -> DataFrame:
    """Without the rows of keys that one of the ``newer`` segments replaces."""
    latest = rows.where(F.col("seq").isin(newer) & (F.col("bucket") < 0)).groupBy(*KEY).agg(F.max("seq").alias("latest"))
    return rows.alias("r").join(
        latest.alias("n"),
        (F.col("r.index_id") == F.col("n.index_id")) & (F.col("r.path") == F.col("n.path")) & (F.col("r.seq") < F.col("n.latest")),
        "left_anti",
    )


def open_index(spark: SparkSession, root: str, upto: int | None = None) -> IndexTables | None:
    """The committed segments (below ``upto``) as live tables; None without any."""
    found = [s for s in segments(spark, root) if upto is None or s.seq < upto]
    if not found:
        return None
    rows = _read_rows(spark, root, found)
    newer = [s.seq for s in found if s.supersedes]
    live = _newest_rows(rows, newer) if newer else rows
    documents = live.where("bucket < 0 AND NOT deleted").select(
        *KEY, path_dir("path").alias("dir"), *_META, "n_tokens", "seq", "bucket"
    )
    postings = live.where("bucket >= 0").select(*KEY, "bucket", "term", "n_tokens", "tf", "positions", "seq")
    terms = spark.read.schema("index_id string, term string, df long, seq long, attempt string, bucket int").option(
        "basePath", f"{root}/terms").parquet(*[f"{root}/terms/{s.folder}" for s in found])
    if len(found) > 1:
        terms = terms.groupBy("index_id", "bucket", "term").agg(F.sum("df").alias("df"))
    stats = _stats(spark, root, found).where("n_docs > 0")

    def lookup(folder: str, column: str) -> DataFrame:
        table = spark.read.schema(f"{column} int, term string").parquet(*[f"{root}/{folder}/{s.folder}" for s in found])
        return table.distinct() if len(found) > 1 else table

    return IndexTables(
        documents, postings, terms.select("index_id", "bucket", "term", "df"), stats,
        found[0].buckets, not newer, read_catalog(spark, root, found), found[0].positions, found[0].stopwords,
        lookup("grams", "gram"), lookup("spellings", "spelling"),
    )


#: So many segments of changes of one weight become one.
FAN = 8


def merge_segments(spark: SparkSession, root: str, first: int, last: int) -> Segment:
    """One segment for those with numbers ``first`` to ``last``: the newest row of each
    key, deletions included, because older segments may hold the key.

    It takes effect with its commit record; searches before and after it find the same.
    """
    chosen = [s for s in segments(spark, root) if first <= s.lowest and s.seq <= last]
    if not chosen:
        raise ValueError(f"no segments {first} to {last}")
    rows = _read_rows(spark, root, chosen)
    newer = [s.seq for s in chosen if s.supersedes]
    rows = (_newest_rows(rows, newer) if newer else rows).drop("seq")
    merged = Segment(
        chosen[-1].seq, uuid.uuid4().hex, chosen[0].buckets, chosen[0].positions, bool(newer), any(s.catalog for s in chosen),
        chosen[0].lowest, sum(s.weight for s in chosen), chosen[0].stopwords, any(s.skipped for s in chosen),
    )
    _write_rows(rows, f"{root}/rows/{merged.folder}", merged.positions)
    _write_terms(spark, root, merged)
    _stats(spark, root, chosen).write.mode("overwrite").parquet(f"{root}/stats/{merged.folder}")
    if merged.catalog:
        read_catalog(spark, root, chosen).write.mode("overwrite").parquet(f"{root}/catalog/{merged.folder}")
    if merged.skipped:
        _still_skipped(spark, root, chosen).drop("seq").write.mode("overwrite").parquet(f"{root}/skipped/{merged.folder}")
    commit(spark, root, merged)
    return merged


def merge_tail(spark: SparkSession, root: str, fan: int = FAN) -> int:
    """Merge the last ``fan`` segments of changes while they are of one weight.

    After n batches there are some fan * log(n) segments, and a row is rewritten
    log(n) times at most.  Returns the number of merges.
    """
    merges = 0
    while True:
        tail = segments(spark, root)[-fan:]
        if len(tail) < fan or not all(s.supersedes for s in tail) or len({s.weight for s in tail}) > 1:
            return merges
        merge_segments(spark, root, tail[0].lowest, tail[-1].seq)
        merges += 1


def compact(spark: SparkSession, root: str, new_root: str) -> None:
    """Rewrite the live rows as one segment under a new path."""
    found = segments(spark, root)
    now = open_index(spark, root)
    docs = now.documents.select(
        *KEY, "n_tokens", F.lit("").alias("term"), F.lit(0).alias("tf"),
        F.lit(None).cast("array<int>").alias("positions"), *_META, F.lit(False).alias("deleted"), "bucket",
    )
    body = now.postings.select(
        *KEY, "n_tokens", "term", "tf", "positions",
        F.lit(None).cast("string").alias("ext"), F.lit(None).cast("long").alias("size"),
        F.lit(None).cast("timestamp").alias("mod_time"), F.lit(None).cast("boolean").alias("deleted"), "bucket",
    )
    _write_segment(spark, new_root, 0, [docs.unionByName(body)], found[0], False, None, now.catalog)
