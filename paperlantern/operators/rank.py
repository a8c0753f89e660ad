"""Scores and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of partitions whose best rows are merged before the last step.
MERGE_FANOUT = 64


def idf(n_docs, df) -> Column:
    """1 + ln(N / (df + 1)), per collection."""
    return 1 + F.log(F.col(n_docs) / (F.col(df) + 1))


def term_weights(units: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds ``weight = mult * boost * idf^2 * qn`` to the units present in a collection.

    ``units``: query_id, clause_id, index_id, unit, boost, mult, width, present,
    idf_sum, n_docs, literal.  The norm of a query runs over all of its units; one that
    a collection lacks has df = 0, so its part follows from ``totals`` and needs
    no row: (all literal squares - those present) * (1 + ln N)^2.
    """
    absent_idf = 1 + F.log("n_docs")
    units = units.withColumn("u_idf", F.col("idf_sum") + (F.col("width") - F.col("present")) * absent_idf)
    square = F.col("mult") * F.pow(F.col("boost") * F.col("u_idf"), 2)
    base = F.when(F.col("literal"), F.col("mult") * F.pow(F.col("boost") * F.col("width"), 2)).otherwise(0.0)
    norms = units.groupBy("query_id", "index_id").agg(
        F.sum(square).alias("present_sq"), F.sum(base).alias("present_base"), F.first("n_docs").alias("n")
    )
    norms = norms.join(totals.select("query_id", "all_base"), "query_id", "left")
    rest = F.greatest(F.coalesce("all_base", F.lit(0.0)) - F.col("present_base"), F.lit(0.0))
    norms = norms.select(
        "query_id", "index_id", F.sqrt(F.col("present_sq") + rest * F.pow(1 + F.log("n"), 2)).alias("norm")
    )
    weight = F.col("mult") * F.col("boost") * F.pow("u_idf", 2) / F.nullif(F.col("norm"), F.lit(0.0))
    return units.join(norms, ["query_id", "index_id"]).withColumn("weight", F.coalesce(weight, F.lit(0.0))).drop("norm")


def contribution(weight, tf, n_tokens) -> Column:
    return F.col(weight) * F.sqrt(tf) / F.sqrt(n_tokens)


def top_k(scored: DataFrame, k: int = 1000, fanout: int = MERGE_FANOUT) -> DataFrame:
    """Best ``k`` per query and collection, ties by path; adds ``rank``.

    A collection may hold most rows, so its best are merged in two levels: by
    group of partitions first, then over at most ``fanout * k`` rows.  Both are
    limited before their shuffle (``WindowGroupLimit``), and any grouping gives
    the same result.
    """
    best = [F.desc("score"), F.asc("path")]
    group = ["query_id", "index_id"]
    salted = scored.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fanout)))
    first = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*best)))
    first = first.where(F.col("_n") <= k).drop("_n", "_salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*best))).where(F.col("rank") <= k)
