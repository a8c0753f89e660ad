"""Uniform shuffle into shards of exact sizes, by a communication matrix.

How many rows of source part p go to shard s is drawn first, for all p and s: a matrix
with the sizes of the parts as row sums and the sizes of the shards, at most one apart,
as column sums, distributed (multivariate hypergeometric) as under a uniform
permutation of all rows.  Then every part permutes its rows and deals them out by its row
of the matrix, rows are exchanged, and every shard permutes what it got.

The matrix is never held as a whole.  It is drawn by halving: a node of a binary tree over
the parts splits its counts per shard between its halves, with a generator seeded by the
node.  A task that needs the row of a part walks down from the root, so it needs the
totals of the left siblings on that way only, 33 numbers at most, and the nodes
that its parts share are drawn once.

A shard is permuted in bins of about ``BIN_ROWS`` rows, dealt at random, so no task holds
a shard; a row's slot is the rows of earlier bins plus its place in the bin.

Input: any table.  Each row goes to one shard; repeated rows, ties, nulls and empty texts
are rows like others, and an empty table gives none.  Columns named like the two added ones
are replaced.  The same files read in the same splits give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlantern.llm.common import stored

SHARDS = 8
SEED = 13
BIN_ROWS = 8192
#: Rows of one part that monotonically_increasing_id tells apart, in bits (a fixed value of Spark).
_ROW_BITS = 33
#: numpy's generator takes populations below this; beyond it the distribution is summed here.
_NUMPY_LIMIT = 10**9


# ------------------------------------------------------------ drawing

def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good + bad`` without replacement, for numbers of any size."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good else 0
    low, high = max(0, drawn - bad), min(good, drawn)
    total = good + bad
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    spread = (drawn * (good / total) * (bad / total) * ((total - drawn) / (total - 1))) ** 0.5
    reach = int(40 * spread) + 60  # what lies beyond has a probability below any double
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=float)
    step = np.log(good - k) - np.log(k + 1) + np.log(drawn - k) - np.log(bad - drawn + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def split_counts(counts: tuple[int, ...], left: int, seed: tuple[int, ...]) -> tuple[int, ...]:
    """How many of ``counts`` rows per shard are among the ``left`` first of all of them."""
    rng = np.random.default_rng(seed)
    rest, out = sum(counts), []
    for n in counts:
        rest -= n
        taken = hypergeometric(rng, n, rest, left)
        out.append(taken)
        left -= taken
    return tuple(out)


def shard_sizes(rows: int, shards: int) -> tuple[int, ...]:
    return tuple(rows // shards + (s < rows % shards) for s in range(shards))


class Matrix:
    """Rows of the communication matrix, drawn as they are asked for.

    ``depth`` levels of halving lead from all parts to one; ``lefts`` of a part are
    the row totals of the left halves on its way, the uppermost first.
    """

    def __init__(self, sizes: tuple[int, ...], depth: int, seed: int) -> None:
        self.sizes, self.depth, self.seed = sizes, depth, seed
        self._left = lru_cache(maxsize=4 * _ROW_BITS)(self._draw)

    def _draw(self, level: int, node: int, counts: tuple[int, ...], left: int) -> tuple[int, ...]:
        return split_counts(counts, left, (self.seed, level, node))

    def row(self, part: int, lefts: list[int]) -> tuple[int, ...]:
        counts = self.sizes
        for level, left in enumerate(lefts):
            node = part >> (self.depth - level)
            taken = self._left(level, node, counts, left)
            right = part >> (self.depth - level - 1) & 1
            counts = tuple(n - t for n, t in zip(counts, taken)) if right else taken
        return counts


# ------------------------------------------------------------ on tables

def _places(at: Column) -> tuple[Column, Column]:
    """Part of a row and its place in the part."""
    return F.shiftright(at, _ROW_BITS), at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def _matrix_rows(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, upto): for every part the ends of its runs per shard."""
    whole = sizes.agg(F.max("part").alias("last"), F.sum("n").cast("long").alias("n")).first()
    depth = int(whole.last).bit_length()
    node = lambda level: F.shiftright("part", F.lit(depth) - level).alias("node")
    levels = sizes.select("part", "n", F.explode(F.array(*[F.lit(i).cast("int") for i in range(1, depth + 1)])).alias("level"))
    level = F.col("level")
    shift = lambda c, by: F.floor(c / F.pow(F.lit(2.0), by)).cast("long")
    levels = levels.withColumn("node", shift(F.col("part"), F.lit(depth) - level))
    totals = levels.groupBy("level", "node").agg(F.sum("n").cast("long").alias("total")).where("node % 2 = 0")
    totals = totals.select(F.col("level").alias("on_level"), F.col("node").alias("of_node"), "total")
    sibling = F.col("node") - F.col("node") % 2
    ways = levels.join(totals, (level == F.col("on_level")) & (sibling == F.col("of_node")), "left")
    ways = ways.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("level", F.coalesce("total", F.lit(0)).alias("total")))).alias("way"))
    ways = sizes.join(ways.withColumnRenamed("part", "of_part"), F.col("part") == F.col("of_part"), "left")
    ways = ways.select("part", F.coalesce(F.transform("way", lambda w: w["total"]), F.array().cast("array<long>")).alias("lefts"))
    # neighbours together: they share the upper nodes of their ways
    ways = ways.repartitionByRange("part").sortWithinPartitions("part")
    wanted = shard_sizes(whole.n, shards)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = Matrix(wanted, depth, seed)
        for batch in batches:
            parts = batch.column(0).to_pylist()
            upto = [np.cumsum(matrix.row(p, lefts)).tolist() for p, lefts in zip(parts, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(upto, pa.list_(pa.int64()))], ["part", "upto"])

    return ways.mapInArrow(rows, "part long, upto array<long>")


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, shard_column: str = "shard", slot_column: str = "slot") -> DataFrame:
    """The rows of ``df`` with their shard (0 …) and their slot in it (0 …, without gaps)."""
    names = [c for c in df.columns if c not in (shard_column, slot_column)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("_")).alias("row"))
    rows = rows.withColumn("met", F.monotonically_increasing_id())
    # permute locally: sorted by a random number within the part that was read
    rows = rows.withColumn("dice", F.xxhash64(F.lit(seed), "met")).sortWithinPartitions("dice", "met")
    rows = stored(rows.select("row", F.monotonically_increasing_id().alias("at")), "shard-rows")
    part, place = _places(F.col("at"))
    sizes = stored(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "shard-parts")
    if sizes.isEmpty():
        return df.select(*[F.col(f"`{c}`") for c in names], F.lit(0).alias(shard_column), F.lit(0).cast("long").alias(slot_column)).limit(0)
    matrix = stored(_matrix_rows(sizes, shards, seed), "shard-matrix")
    matrix = matrix.select(F.col("part").alias("of_part"), "upto")
    # first run that ends behind the row's place
    dealt = rows.join(matrix, part == F.col("of_part"))
    to = F.array_size(F.filter("upto", lambda end: end <= place)).alias("shard")
    n = sizes.agg(F.sum("n")).first()[0]
    bins = 1 << max(0, (n // shards // BIN_ROWS)).bit_length()
    dice = F.xxhash64(F.lit(seed + 1), "at")
    dealt = dealt.select("row", "at", to, dice.alias("dice"), F.pmod(F.xxhash64(F.lit(seed + 2), "at"), F.lit(bins)).alias("bin"))
    # the rows before a bin come from the small columns alone
    upto = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(F.col("shard").alias("in_shard"), F.col("bin").alias("in_bin"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    before = stored(before, "shard-bins")
    order = Window.partitionBy("shard", "bin").orderBy("dice", "at")
    placed = dealt.withColumn("place", F.row_number().over(order) - 1)
    placed = placed.join(before, (F.col("shard") == F.col("in_shard")) & (F.col("bin") == F.col("in_bin")))
    return placed.select(
        *[F.col(f"row.`{c}`") for c in names], F.col("shard").cast("int").alias(shard_column),
        (F.col("before") + F.col("place")).cast("long").alias(slot_column),
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Folders ``shard=0`` … with Parquet files whose rows, in order of file name, are in order of slot."""
    sharded = shard(df, shards, seed)
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    A null text has no bytes: size 1 and the checksum of nothing, 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
    )
    return shard(rows, shards, seed).withColumn("grown_shard", F.lit(None).cast("int"))
