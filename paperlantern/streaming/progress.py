"""Ingest progress (G5): metrics of a running write, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def ingest_progress(docs: DataFrame, observation: Observation | str) -> DataFrame:
    """``docs`` observed: documents, bytes and documents without content."""
    failed = F.count_if(F.col("content").isNull()) if "content" in docs.columns else F.lit(0)
    return docs.observe(
        observation,
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        failed.alias("failed"),
    )


class ProgressLog(StreamingQueryListener):
    """Keeps the last progress of every streaming query by name or id."""

    def __init__(self) -> None:
        self.last: dict[str, dict] = {}
        self.done: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.last.setdefault(event.name or str(event.id), {})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.last[p.name or str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.done.add(str(event.id))
