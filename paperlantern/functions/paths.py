"""Path expressions (F1-F4).  Paths use ``/``; all are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_ext(path) -> Column:
    """From the last dot of the last element, dot included; empty when none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def path_dir(path) -> Column:
    """Parent folder; ``.`` when there is no separator."""
    path = F.col(path) if isinstance(path, str) else path
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    return (
        F.when(F.instr(path, "/") == 0, F.lit("."))
        .when(parent == "", F.lit("/"))
        .otherwise(parent)
    )


def path_base(path) -> Column:
    """Last element."""
    return F.element_at(F.split(path, "/"), -1)


def path_rel(path, base) -> Column:
    """Path below ``base``; the full path when it is not under it."""
    path = F.col(path) if isinstance(path, str) else path
    base = F.col(base) if isinstance(base, str) else base
    root = F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, root), F.substr(path, F.length(root) + 1)).otherwise(path)


def file_uri_path(uri) -> Column:
    """Plain path of a percent-encoded ``file:`` URI (``+`` is itself there)."""
    uri = F.col(uri) if isinstance(uri, str) else uri
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, r"^file:/+", "/"), r"\+", "%2B"))


def first_segment(path) -> Column:
    """Name of the collection a relative path belongs to."""
    return F.substring_index(path, "/", 1)
