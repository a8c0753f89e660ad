"""Continuous maintenance of an index from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlantern.operators.changes import debounce_stream, expand_dir_events, last_change
from paperlantern.plans.index import clean_up, merge_tail, next_seq
from paperlantern.plans.maintain import apply_changes
from paperlantern.session import cut_lineage
from paperlantern.sources.files import DEFAULT_EXTENSIONS
from paperlantern.sources.storage import exists
from paperlantern.streaming.progress import ingest_progress

#: Bytes of documents that are analysed and written at a time.
BATCH_BYTES = 256 * 1024 * 1024


def first_free_seq(spark: SparkSession, root: str, checkpoint: str) -> int:
    """Number of the first segment of a stream, kept beside its checkpoint, so a
    restarted stream maps a batch to the same segment again."""
    path = f"{checkpoint}/first_seq"
    if not exists(spark, path):
        spark.range(1).select(F.lit(next_seq(spark, root)).alias("seq")).coalesce(1).write.mode("errorifexists").parquet(path)
    return spark.read.schema("seq long").parquet(path).first().seq


def stream_index(
    changes: DataFrame,
    root: str,
    corpus,
    checkpoint: str,
    listing=None,
    extensions=DEFAULT_EXTENSIONS,
    gap: str | None = "10 seconds",
    trigger: dict | None = None,
    progress: str | None = None,
    keep_seconds: float = 86_400.0,
    batch_bytes: int | None = BATCH_BYTES,
):
    """Start the stream: quiet periods → folder events → upserts and deletes.

    ``corpus(batch)`` returns the documents of the changed paths of one batch, of which it is
    given the last change of each (from the feed, or a scan of just these paths); ``listing`` is needed for
    folder events only.  Batch ``n`` is written as segment ``first + n``, and a
    replay writes that one again; a batch that was merged already stays as it is.
    Segments of one weight are merged as they add up, so a late batch finds as few
    of them as an early one.  ``progress`` names the observations of the batches.

    A batch of more than ``batch_bytes`` of documents (None: of any size) is written in parts of
    about that size under one commit, so its peak does not grow with it.  The feed's own option
    ``maxBytesPerTrigger`` bounds the events that a batch takes in.
    """
    spark = changes.sparkSession
    first = first_free_seq(spark, root, checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        # a batch of one file is one task's rows: they are dealt out before keys are compared
        batch = batch.select("index_id", "path", "op", "ts", "event_id").repartition("event_id")
        if listing is not None:
            batch = expand_dir_events(cut_lineage(batch), listing() if callable(listing) else listing)
        # only the last change of a path counts, for the documents as for the index
        batch = cut_lineage(last_change(batch))
        if batch.isEmpty():
            return
        docs = corpus(batch)
        if progress is not None:
            docs = ingest_progress(docs, f"{progress}-{batch_id}")
        apply_changes(batch.sparkSession, root, batch, docs, extensions, first + batch_id, batch_bytes)
        if merge_tail(batch.sparkSession, root):
            clean_up(batch.sparkSession, root, keep_seconds)

    source = debounce_stream(changes, gap) if gap else changes
    return (
        source.writeStream.outputMode("append")
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
