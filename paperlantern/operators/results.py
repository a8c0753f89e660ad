"""Result rows, their display form and path lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlantern.functions.paths import path_base
from paperlantern.functions.text import rfc1123, truncate_text
from paperlantern.session import BROADCAST_ROWS, cut_lineage, small_side


def project_results(hits: DataFrame, documents: DataFrame, catalog: DataFrame | None = None, at_most_rows: int | None = None) -> DataFrame:
    """Stored fields of the hits; ``full_path`` = base path + ``/`` + path.

    ``at_most_rows`` is the caller's bound (k * queries * collections).  Within the
    broadcast limit the hits go to the documents; else the hits are computed
    once, counted, and broadcast or shuffled by key accordingly.
    """
    fields = documents.select("index_id", "path", "size", "mod_time", "ext")
    if at_most_rows is not None and at_most_rows <= BROADCAST_ROWS:
        side = F.broadcast(hits)
    else:
        side = small_side(cut_lineage(hits))
    out = fields.join(side, ["index_id", "path"])
    base = F.col("path")
    if catalog is not None:
        out = out.join(small_side(catalog.select("index_id", "base_path")), "index_id", "left")
        base = F.when(F.coalesce("base_path", F.lit("")) != "", F.concat_ws("/", "base_path", "path")).otherwise(F.col("path"))
    return out.select("query_id", "index_id", "rank", "path", base.alias("full_path"), "score", "size", "mod_time", "ext")


def format_results(results: DataFrame) -> DataFrame:
    """The six columns shown to a reader."""
    return results.select(
        "query_id", "index_id", "rank",
        truncate_text(path_base("full_path"), 30).alias("file_name"),
        F.format_string("%.2f", F.col("score")).alias("score_text"),
        F.col("size").cast("string").alias("size_text"),
        F.col("ext").alias("ext"),
        truncate_text(F.col("full_path"), 80).alias("file_path"),
        rfc1123("mod_time").alias("mod_time_text"),
    )


def list_paths(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """All paths; with a ``limit`` the first ones in order."""
    paths = docs.select("index_id", "path")
    return paths.orderBy("path", "index_id").limit(limit) if limit is not None else paths


def concat_results(parts: list[DataFrame]) -> DataFrame:
    """Results of separate index roots, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)
