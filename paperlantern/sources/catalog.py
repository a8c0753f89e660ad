"""The catalog of collections (S6): which folders are indexed, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "index_id string, base_path string, extensions array<string>, created_at timestamp"


def catalog_rows(spark: SparkSession, folders: list[tuple[str, list[str]]]) -> DataFrame:
    """Catalog rows for ``(folder, extensions)``: name = last element of the folder."""
    rows = [(f.strip().rstrip("/"), list(e)) for f, e in folders if f.strip()]
    df = spark.createDataFrame(rows, "folder string, extensions array<string>")
    return df.select(
        F.substring_index("folder", "/", -1).alias("index_id"),
        F.regexp_replace("folder", "/[^/]*$", "").alias("base_path"),
        "extensions",
        F.current_timestamp().alias("created_at"),
    )


def register_index(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that may be added: a second collection of the same
    name is refused, also within ``new`` itself."""
    first = new.groupBy("index_id").agg(F.min_by(F.struct("base_path", "extensions", "created_at"), "base_path").alias("r"))
    first = first.select("index_id", "r.*")
    return first.join(catalog.select("index_id"), "index_id", "left_anti")


def list_indexes(lines: DataFrame, column: str = "value") -> DataFrame:
    """A list of folder paths, one per line, trimmed, blank lines skipped."""
    folder = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    return lines.select(folder.alias("folder")).where(F.length("folder") > 0)
