"""Collection statistics (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stats(docs: DataFrame) -> DataFrame:
    """Live documents and content bytes per collection, 64-bit."""
    out = docs.groupBy("index_id").agg(
        F.count(F.lit(1)).alias("documents_indexed"),
        F.sum("size").cast("long").alias("total_size"),
    )
    mb = F.floor(F.col("total_size") / 1048576).cast("long")
    return out.withColumn("total_mb", mb)


def stats_text(stats: DataFrame) -> DataFrame:
    text = F.concat(
        F.col("documents_indexed").cast("string"), F.lit(" Documents Indexed of Size "), F.col("total_mb").cast("string"), F.lit(" MB")
    )
    return stats.select("index_id", text.alias("summary"))
