"""Session settings, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only after a count proved it is at most this long.
BROADCAST_ROWS = 200_000
#: As many keys as hashes, eight bytes each, take the room of those rows.
HASHED_ROWS = 8 * BROADCAST_ROWS
#: Up to this many rows of *query text* become literals of the plan.
LITERAL_ROWS = 256


def build_session(app_name: str = "paperlantern", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the plans here count on (AQE, UTC)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "static",
        # a checkpoint is deleted when nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # call sites per column expression: many round trips while planning
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # sessions of one key are merged before the shuffle
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only on one machine (a ``local`` master) a temporary folder is made where the
    session names none; a cluster has to name one that all its machines share.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="paperlantern-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bound(df: DataFrame) -> int | None:
    """Upper bound of the row count the optimizer proved, without running anything."""
    bound = df._jdf.queryExecution().optimizedPlan().maxRows()
    return int(bound.get()) if bound.isDefined() else None


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; counts only if the plan does not tell."""
    bound = row_bound(df)
    if bound is not None and bound <= rows:
        return True
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` behind a size check; beyond it a plain shuffled side."""
    return F.broadcast(df) if at_most(df, rows) else df


def near_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows that a join with ``keys`` can find, and a few more of the same hash.

    Where the keys are too many for a broadcast, their hashes are broadcast, so that a join
    shuffles what it finds and not all of ``df``; elsewhere ``df`` as it is."""
    if at_most(keys, BROADCAST_ROWS) or not at_most(keys, HASHED_ROWS):
        return df
    hashes = keys.select(F.xxhash64(*on).alias("_hash")).distinct()
    return df.withColumn("_hash", F.xxhash64(*on)).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")


def take_if_small(df: DataFrame, rows: int):
    """The rows of ``df`` as a list, or None when there are more than ``rows``."""
    found = df.limit(rows + 1).collect()
    return found if len(found) <= rows else None


def settle(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a query-side table once.

    Up to ``rows`` rows it becomes a local relation, whose size every later plan
    knows; beyond that a checkpoint in the shared folder.
    """
    table = df.limit(rows + 1).toArrow()
    if table.num_rows <= rows:
        return df.sparkSession.createDataFrame(table, schema=df.schema)
    return cut_lineage(df)


def in_one_task(df: DataFrame) -> DataFrame:
    """A proven small query-side table in one partition: what follows on it alone
    needs no shuffle.  Anything else is returned as it is."""
    bound = row_bound(df)
    return df.coalesce(1) if bound is not None and bound <= BROADCAST_ROWS else df
