"""Keeping an index current in batch form."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlantern.operators.changes import below_folder, last_change, snapshot_diff
from paperlantern.plans.index import IndexTables, append_segment, open_index, skipped, write_index
from paperlantern.session import cut_lineage, small_side, take_if_small
from paperlantern.sources.catalog import catalog_rows
from paperlantern.sources.files import (
    DEFAULT_EXTENSIONS,
    WHOLE_FILE_BYTES,
    corpus_listing,
    corpus_scan,
    filter_extensions,
    large_file_lines,
)

KEY = ["index_id", "path"]
#: So many changed files are named to the reader one by one.
CHANGED_FILES = 5_000


def initial_scan(
    spark: SparkSession, root: str, folder: str, extensions=DEFAULT_EXTENSIONS, whole_file_bytes: int = WHOLE_FILE_BYTES, **options
) -> int:
    """Index a folder: scan, analyse, write (C11).  Files that gave no document are kept as rows (``index.skipped``)."""
    listing = corpus_listing(spark, folder, extensions)  # before the scan: a file that comes in between is not missed
    docs = corpus_scan(spark, folder, extensions, whole_file_bytes=whole_file_bytes)
    lines = large_file_lines(spark, folder, extensions, whole_file_bytes=whole_file_bytes)
    return write_index(docs, root, catalog_rows(spark, [(folder, list(extensions))]), large_lines=lines, listing=listing, **options)


def apply_changes(
    spark: SparkSession,
    root: str,
    changes: DataFrame,
    corpus: DataFrame,
    extensions=DEFAULT_EXTENSIONS,
    seq: int | None = None,
    batch_bytes: int | None = None,
) -> int:
    """Last change per path wins: documents replaced by key, deleted ones buried.

    ``corpus`` supplies the content of the changed paths: the feed itself, or a
    scan of just those paths.  A path without content there stays as it is.
    ``batch_bytes``: see ``append_segment``.
    """
    final = cut_lineage(last_change(changes))
    upserts = final.where("op <> 'delete'").select(*KEY)
    docs = filter_extensions(corpus.join(small_side(upserts), KEY, "left_semi"), extensions)
    deleted = final.where("op = 'delete'").select(*KEY)
    return append_segment(spark, root, docs, deleted, seq, batch_bytes=batch_bytes)


def _opened(spark: SparkSession, root: str) -> IndexTables:
    index = open_index(spark, root)
    if index is None:
        raise ValueError(f"no index at {root}")
    return index


def _as_glob(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def reindex(
    spark: SparkSession,
    root: str,
    folder: str,
    extensions=DEFAULT_EXTENSIONS,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> int:
    """Bring one folder up to date: listing, difference, changed files only.

    Up to some thousand changed files are opened by name; more are picked from a
    scan of the folder.  Files that cannot be read are tried again each time and kept as rows.
    """
    index = _opened(spark, root)
    base, _, name = folder.rstrip("/").rpartition("/")
    listing = corpus_listing(spark, folder, extensions)
    changes = cut_lineage(snapshot_diff(index.documents.where(F.col("index_id") == name), listing))
    upserts = changes.where("op <> 'delete'").select(*KEY)
    few = take_if_small(upserts, CHANGED_FILES)
    # a file that could not be read and is gone since is buried too
    gone = skipped(spark, root).where(F.col("index_id") == name).join(listing, KEY, "left_anti")
    deleted = changes.where("op = 'delete'").select(*KEY).unionByName(gone.select(*KEY))
    if few is not None and not few:
        return append_segment(spark, root, None, deleted)
    paths = [_as_glob(f"{base}/{r.path}") for r in few] if few is not None else None
    wanted = small_side(upserts)
    docs = corpus_scan(spark, folder, extensions, whole_file_bytes, paths).join(wanted, KEY, "left_semi")
    lines = large_file_lines(spark, folder, extensions, whole_file_bytes, paths).join(wanted, KEY, "left_semi")
    return append_segment(spark, root, docs, deleted, large_lines=lines, listing=listing.join(wanted, KEY, "left_semi"))


def remove_folder(spark: SparkSession, root: str, folder: str) -> int:
    """Bury every document of a (relative) folder and of the folders below it."""
    index = _opened(spark, root)
    return append_segment(spark, root, None, below_folder(index.documents, folder).select(*KEY))


def live_documents(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """In-memory view after a replay: last change per key decides."""
    final = last_change(changes).select(*KEY, "op", "ts")
    out = docs.join(final, KEY, "left").where(F.col("op").isNull() | (F.col("op") != "delete"))
    return out.withColumn("mod_time", F.coalesce("ts", "mod_time")).drop("ts")
