"""Tables, folds and shared scratch tables of the operators here."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlantern.session import scratch_dir

#: Rows whose crc32 leaves this remainder are never learnt from.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back.

    Cuts the lineage, survives lost executors, and gives the optimizer the real
    size for its choice between broadcast and shuffled joins.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, once all that was made of them is written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves no remainder by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learnt from; a row without id is not one of them."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents of the learning folds.

    The bound is a parameter of the classifiers that use it.  The choice is by a
    hash of the id, so it is the same in every run.  Null labels are left out; of
    several labels of one document the largest counts.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(learnable() & F.col("label").isNotNull())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
