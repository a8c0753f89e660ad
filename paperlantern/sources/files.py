"""Folders of text files as documents (S1-S3) and as a listing without content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlantern.functions.paths import file_uri_path, path_dir, path_ext, path_rel

#: Extensions indexed when the caller names none.
DEFAULT_EXTENSIONS = (".txt", ".log", ".md", ".go", ".py")
#: Files up to this size are read as one row; larger ones line by line.
WHOLE_FILE_BYTES = 16 * 1024 * 1024


def filter_extensions(docs: DataFrame, extensions=DEFAULT_EXTENSIONS) -> DataFrame:
    """Case-sensitive, dot included."""
    return docs.where(F.col("ext").isin(list(extensions)))


def to_documents(raw: DataFrame, index_id: str, base: str) -> DataFrame:
    """``raw(file, size, mod_time[, content…])`` to document rows below ``base``."""
    extra = [c for c in raw.columns if c not in ("file", "size", "mod_time")]
    path = path_rel("file", F.lit(base))
    docs = raw.withColumn("path", path)
    return docs.select(
        F.lit(index_id).alias("index_id"),
        "path",
        path_dir("path").alias("dir"),
        path_ext("path").alias("ext"),
        F.col("size").cast("long").alias("size"),
        "mod_time",
        *extra,
    )


def _glob(extensions) -> str:
    return "*{" + ",".join(extensions) + "}"


def _located(folder: str) -> tuple[str, str]:
    folder = folder.rstrip("/")
    base, _, name = folder.rpartition("/")
    return base, name


def _reader(spark: SparkSession, extensions, skip: bool = True):
    """``skip``: a file that cannot be read gives no row.  That is whole files only:
    of a file read by line a part could be taken for all of it."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", _glob(extensions))
        .option("ignoreCorruptFiles", skip)
        .option("ignoreMissingFiles", skip)
    )


def _meta(df: DataFrame, *more) -> DataFrame:
    return df.select(
        file_uri_path("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("mod_time"),
        *more,
    )


def corpus_scan(
    spark: SparkSession,
    folder: str,
    extensions=DEFAULT_EXTENSIONS,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    paths: list[str] | None = None,
) -> DataFrame:
    """Every allowed file below ``folder``, one row each, content as one string.

    Unreadable files are skipped; a write keeps their names (``plans.index.skipped``).  Bad bytes become U+FFFD.  Files larger than
    ``whole_file_bytes`` are left to :func:`large_file_lines`; size is a file
    attribute, so they are dropped while listing and never opened here.
    ``paths`` restricts the scan to single files below the folder.
    """
    base, name = _located(folder)
    source = paths if paths is not None else folder
    df = _reader(spark, extensions).text(source, wholetext=True)
    df = df.where(F.col("_metadata.file_size") <= whole_file_bytes)
    docs = to_documents(_meta(df, F.col("value").alias("content")), name, base)
    return filter_extensions(docs, extensions)


def corpus_listing(spark: SparkSession, folder: str, extensions=DEFAULT_EXTENSIONS) -> DataFrame:
    """As :func:`corpus_scan` without content: no file is opened."""
    base, name = _located(folder)
    df = _reader(spark, extensions).format("binaryFile").load(folder)
    raw = _meta(df)
    return filter_extensions(to_documents(raw, name, base), extensions)


def large_file_lines(
    spark: SparkSession,
    folder: str,
    extensions=DEFAULT_EXTENSIONS,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    paths: list[str] | None = None,
) -> DataFrame:
    """Lines of the files too large for one row: ``block, line_no, content``.

    A large file is read by many tasks.  ``block`` is the byte offset of the
    split a line was read from, ``line_no`` grows within it; together they give
    the order of lines in the file.  A read error fails the job, so that a part of
    a file is never indexed as the whole.
    """
    base, name = _located(folder)
    df = _reader(spark, extensions, skip=False).option("lineSep", "\n").text(paths if paths is not None else folder)
    df = df.where(F.col("_metadata.file_size") > whole_file_bytes)
    raw = _meta(
        df,
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("content"),
    )
    return filter_extensions(to_documents(raw, name, base), extensions)


def skipped_files(listing: DataFrame, docs: DataFrame, whole_file_bytes: int | None = WHOLE_FILE_BYTES) -> DataFrame:
    """(index_id, path, reason) of the listed files that gave no document: those
    that could not be read, and empty ones, which Spark's readers leave out.
    ``docs`` holds files up to ``whole_file_bytes``, None: of every size."""
    whole = listing if whole_file_bytes is None else listing.where(F.col("size") <= whole_file_bytes)
    missing = whole.join(docs.select("index_id", "path"), ["index_id", "path"], "left_anti")
    return missing.select("index_id", "path", F.when(F.col("size") == 0, "empty").otherwise("unreadable").alias("reason"))
