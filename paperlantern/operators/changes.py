"""Change events: cleaning, quiet periods, last change, batches, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlantern.functions.paths import path_dir
from paperlantern.session import cut_lineage, small_side

# Event names and the change they mean.
OPERATIONS = {"remove": "delete", "create": "create", "write": "update"}


def normalize_changes(events: DataFrame, mapping: dict[str, str] | None = None, event: str = "event") -> DataFrame:
    """Known single events to create/update/delete; all others are dropped.

    A feed that names both sides of a rename (``old_path``) yields a delete of
    the old and a create of the new path.
    """
    table = mapping or OPERATIONS
    op = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.lower(F.col(event))]
    base = [c for c in events.columns if c not in (event, "old_path")]
    if "old_path" not in events.columns:
        return events.select(*base, op.alias("op")).where(F.col("op").isNotNull())
    pair = F.array(
        F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("op")),
        F.struct(F.col("path").alias("path"), F.lit("create").alias("op")),
    )
    renamed = F.lower(F.col(event)) == "rename"
    one = F.array(F.struct(F.col("path").alias("path"), op.alias("op")))
    out = events.withColumn("_c", F.explode_outer(F.when(renamed & F.col("old_path").isNotNull(), pair).otherwise(one)))
    rest = [c for c in base if c != "path"]
    return out.select(*rest, "_c.path", "_c.op").where(F.col("op").isNotNull())


def quiet_periods(changes: DataFrame, gap_seconds: int = 10) -> DataFrame:
    """Batches of a collection's queue: released when nothing came for ``gap``.

    ``index_id, batch_start, batch_end, n_changes`` (batch_end = last event + gap).
    Events of one slice as wide as the gap are in one batch anyway, so they are
    counted together first (partial aggregation, whatever the skew); only the
    slices, at most one per gap and collection, are put in order.
    """
    return _batches(_slices(changes, gap_seconds), gap_seconds).groupBy("index_id", "batch_start").agg(
        (F.max("last") + F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("batch_end"),
        F.sum("n").alias("n_changes"),
    )


def _slice(gap_seconds: int) -> Column:
    return F.floor(F.unix_micros("ts") / (gap_seconds * 1_000_000))


def _slices(changes: DataFrame, gap_seconds: int) -> DataFrame:
    return changes.groupBy("index_id", _slice(gap_seconds).alias("slice")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")
    )


def _batches(slices: DataFrame, gap_seconds: int) -> DataFrame:
    order = Window.partitionBy("index_id").orderBy("slice")
    idle = F.unix_micros("first") - F.unix_micros(F.lag("last").over(order)) > gap_seconds * 1_000_000
    begins = slices.withColumn("begin", F.when(F.coalesce(idle, F.lit(True)), F.col("first")))
    return begins.withColumn("batch_start", F.last("begin", ignorenulls=True).over(order))


def debounce(changes: DataFrame, gap_seconds: int = 10) -> DataFrame:
    """Batch form: every change with the quiet period that releases it.

    Rows stay rows; a batch is replayed in the order ``ts, event_id``.
    """
    slices = _batches(_slices(changes, gap_seconds), gap_seconds).select("index_id", "slice", "batch_start")
    keyed = changes.withColumn("slice", _slice(gap_seconds))
    return keyed.join(slices, ["index_id", "slice"]).drop("slice")


def debounce_stream(changes: DataFrame, gap: str = "10 seconds") -> DataFrame:
    """Streaming form: a session per path that keeps its last change only.

    For file events this leaves the same final state as one queue per
    collection, with state bounded by the number of active paths.
    """
    return (
        changes.withWatermark("ts", gap)
        .groupBy("index_id", "path", F.session_window("ts", gap).alias("w"))
        .agg(
            F.max_by("op", F.struct("ts", "event_id")).alias("op"),
            F.max("ts").alias("last_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"),
            F.count(F.lit(1)).alias("n_changes"),
        )
        .select("index_id", "path", "op", F.col("last_ts").alias("ts"), "event_id", "n_changes")
    )


def last_change(changes: DataFrame) -> DataFrame:
    """Changes are replayed in order, so the last one per path decides."""
    newest = F.max_by(F.struct("op", "ts", "event_id"), F.struct("ts", "event_id"))
    return changes.groupBy("index_id", "path").agg(newest.alias("c")).select("index_id", "path", "c.op", "c.ts", "c.event_id")


def ancestors(directory) -> Column:
    """All folders above and including ``a/b/c``: ``a``, ``a/b``, ``a/b/c``."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def expand_dir_events(changes: DataFrame, listing: DataFrame) -> DataFrame:
    """Changes of a folder become changes of the files below it.

    Every listed file names its own ancestor folders, so this is a hash join on
    the folder.  Only folders that met an event are looked at again.  A delete of
    a folder and events on files pass through.
    """
    events = changes.select("index_id", "path", "op", "ts", "event_id")
    below = listing.select("index_id", F.col("path").alias("file"), F.explode(ancestors(path_dir("path"))).alias("path"))
    met = cut_lineage(below.join(small_side(events), ["index_id", "path"]))
    files = met.where("op <> 'delete'").select("index_id", F.col("file").alias("path"), "op", "ts", "event_id")
    opened = met.where("op <> 'delete'").select("index_id", "path", "op", "ts", "event_id").distinct()
    return events.join(opened, ["index_id", "path", "op", "ts", "event_id"], "left_anti").unionByName(files)


def key_slice(column: str, slices: int) -> Column:
    """A slice number from the digest of a key; the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long"), F.lit(slices))


def byte_batches(docs: DataFrame, limit: int = 32 * 1024 * 1024, slices: int = 1024) -> DataFrame:
    """Groups documents to batches of about ``limit`` bytes: ``slice, batch_no``.

    The running sum is taken within slices of the key, never over everything;
    choose ``slices`` so that one slice fits a task.
    """
    sliced = docs.withColumn("slice", key_slice("path", slices))
    before = F.sum("size").over(
        Window.partitionBy("slice").orderBy("path", "index_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    return sliced.withColumn("batch_no", F.floor(F.coalesce(before, F.lit(0)) / limit).cast("long"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that lead from one listing to another (``size``, ``mod_time`` decide)."""
    key = ["index_id", "path"]
    a = old.select(*key, F.col("size").alias("old_size"), F.col("mod_time").alias("old_time"), F.lit(True).alias("was"))
    b = new.select(*key, F.col("size").alias("new_size"), F.col("mod_time").alias("new_time"), F.lit(True).alias("now"))
    same = F.col("old_size").eqNullSafe(F.col("new_size")) & F.col("old_time").eqNullSafe(F.col("new_time"))
    op = F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "delete").when(~same, "update")
    return a.join(b, key, "full").select(*key, op.alias("op")).where(F.col("op").isNotNull())


def below_folder(docs: DataFrame, folder: str) -> DataFrame:
    """Documents in ``folder`` or anywhere under it."""
    return docs.where((F.col("dir") == folder) | F.startswith("dir", F.lit(folder.rstrip("/") + "/")))
