"""Folder trees, folder choice and routing to collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlantern.functions.paths import first_segment
from paperlantern.session import small_side


def distinct_dirs(docs: DataFrame) -> DataFrame:
    return docs.select("index_id", "dir").where(F.col("dir") != ".").distinct()


def folder_tree(dirs: DataFrame) -> DataFrame:
    """Every ancestor of every folder, once: ``node, parent, name, depth, n_children``.

    The tree is shared by all collections.  Folders are made distinct before
    they are expanded, so the work grows with folders and not with documents.
    """
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    paths = dirs.select("dir").distinct().select(parts.alias("parts")).where(F.size("parts") > 0)
    nodes = paths.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    nodes = nodes.select(
        F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("node"),
        F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/").alias("parent"),
        F.element_at("parts", F.col("depth")).alias("name"),
        "depth",
    ).distinct()
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, "node", "left").select(
        "node", "parent", "name", "depth", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")
    )


def folder_children(tree: DataFrame, node: str | None = None) -> DataFrame:
    """Children of ``node``; a blank node is the root; an unknown one has none."""
    return tree.where(F.col("parent") == (node or "")).select(
        "node", "name", (F.col("n_children") > 0).alias("has_children")
    )


def exclude_folders(folders: DataFrame, excluded: DataFrame) -> DataFrame:
    """All nodes but exactly the excluded ones; their children stay."""
    return folders.join(excluded.select("node").distinct(), "node", "left_anti")


def filter_dirs(docs: DataFrame, dirs: DataFrame) -> DataFrame:
    """Documents directly in one of the chosen folders (no prefix meaning)."""
    chosen = dirs.select("index_id", "dir").distinct()
    return docs.join(small_side(chosen), ["index_id", "dir"], "left_semi")


def group_folders(folders: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each folder with *every* collection whose name is a string prefix of it.

    A folder has as many prefixes as characters, so the prefix test becomes a
    hash join on the expanded prefixes instead of a theta join.
    """
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("folder"), F.lit(1))), lambda n: F.substring("folder", F.lit(1), n)
    )
    expanded = folders.select("folder").distinct().select("folder", F.explode(prefixes).alias("index_id"))
    return expanded.join(catalog.select("index_id").distinct(), "index_id").select("folder", "index_id")


def folder_scope(folders: DataFrame) -> DataFrame:
    """Routing inside a search: a collection holds only folders that start with
    its own name as a whole segment, so equality on it finds the same hits."""
    keys = [c for c in ("query_id",) if c in folders.columns]
    return folders.select(*keys, first_segment("folder").alias("index_id"), F.col("folder").alias("dir")).distinct()
