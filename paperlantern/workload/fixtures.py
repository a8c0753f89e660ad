"""The given tables as documents, folders and change events.

Each adapter exists twice: as a DataFrame here and as the SQL text next to it.
All of them keep every row and every whole text.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlantern.functions.paths import path_dir
from paperlantern.operators.changes import normalize_changes
from paperlantern.plans.index import IndexTables, open_index, write_index
from paperlantern.session import scratch_dir
from paperlantern.sources.storage import exists

EXTENSIONS = [".txt", ".log", ".md", ".go", ".py"]
#: For the extension filter: two that must not pass.
MIXED_EXTENSIONS = [".txt", ".log", ".md", ".go", ".py", ".pdf", ".TXT"]
BASE_PATH = "/data/corpus"
OPS = {"signup": "create", "view": "update", "purchase": "update", "click": "update", "error": "delete"}
EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ext(names: list[str]):
    return F.element_at(F.array(*[F.lit(e) for e in names]), (F.col("doc_id") % len(names) + 1).cast("int"))


def raw_documents(spark: SparkSession, sf: str, extensions=EXTENSIONS) -> DataFrame:
    """Before :func:`to_documents`: absolute file name, size, time, content."""
    d = table(spark, sf, "documents")
    file = F.concat(F.lit(BASE_PATH + "/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), _ext(extensions))
    return d.select(
        "doc_id", file.alias("file"), F.octet_length("text").cast("long").alias("size"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 60).alias("mod_time"), F.col("text").alias("content"),
        F.col("source").alias("index_id"),
    )


def documents(spark: SparkSession, sf: str, extensions=EXTENSIONS) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), _ext(extensions))
    d = d.withColumn("path", path)
    return d.select(
        F.col("source").alias("index_id"), "path", path_dir("path").alias("dir"), _ext(extensions).alias("ext"),
        F.octet_length("text").cast("long").alias("size"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 60).alias("mod_time"), F.col("text").alias("content"),
    )


def _docs_sql(extensions) -> str:
    names = ", ".join(f"'{e}'" for e in extensions)
    return f"""docs AS (
  SELECT source AS index_id, source || '/' || lang || '/' || doc_id || ext AS path, source || '/' || lang AS dir, ext,
         CAST(strlen(text) AS BIGINT) AS size, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS mod_time,
         text AS content, doc_id
  FROM (SELECT *, [{names}][CAST(doc_id % {len(extensions)} AS INTEGER) + 1] AS ext FROM documents))"""


DOCS_SQL = _docs_sql(EXTENSIONS)
MIXED_DOCS_SQL = _docs_sql(MIXED_EXTENSIONS)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("index_id")).distinct().select(
        "index_id", F.lit(BASE_PATH).alias("base_path"), F.array(*[F.lit(e) for e in EXTENSIONS]).alias("extensions"),
        F.current_timestamp().alias("created_at"),
    )


def page_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Folders of the pages: host/…, the last element being the file."""
    path = F.regexp_extract("url", r"^https?://([^?#]+)", 1)
    p = table(spark, sf, "pages").select(path.alias("path"))
    return p.select(F.substring_index("path", "/", 1).alias("index_id"), path_dir("path").alias("dir"))


PAGE_DIRS_SQL = r"""page_dirs AS (
  SELECT split_part(path, '/', 1) AS index_id,
         CASE WHEN instr(path, '/') = 0 THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS dir
  FROM (SELECT regexp_extract(url, '^https?://([^?#]+)', 1) AS path FROM pages))"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of the document their user stands for."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), _ext(EXTENSIONS))
    joined = e.join(d, e.user_id == d.doc_id).select(
        F.col("source").alias("index_id"), path.alias("path"), "event_type", "ts", "event_id"
    )
    return normalize_changes(joined, OPS, "event_type")


CHANGES_SQL = """changes AS (
  SELECT d.index_id, d.path, e.ts, e.event_id,
         CASE e.event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op
  FROM events e JOIN docs d ON e.user_id = d.doc_id
  WHERE e.event_type IN ('signup', 'view', 'purchase', 'click', 'error'))"""

LAST_SQL = """final AS (
  SELECT index_id, path, op, ts, event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY index_id, path ORDER BY ts DESC, event_id DESC) AS n FROM changes) WHERE n = 1)"""

_built: dict = {}
_lock = threading.Lock()


def stored_index(spark: SparkSession, sf: str) -> IndexTables:
    """All documents, indexed once per session in the shared folder, then opened."""
    key = (spark.sparkContext.applicationId, sf)
    with _lock:
        root = _built.get(key)
        if root is None or not exists(spark, f"{root}/segments"):
            root = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
            write_index(documents(spark, sf), root, catalog(spark, sf), buckets=16)
            _built[key] = root
    return open_index(spark, root)
