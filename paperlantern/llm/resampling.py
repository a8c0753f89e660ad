"""Importance resampling towards a target distribution, with exact ranks.

Word n-grams are counted in hashed buckets over all documents and over the target's
texts; a document's weight is the mean gain of its buckets, looked up in one array.
A Gumbel number from a digest of its id is added, so the highest scores are a
weighted sample without replacement (Xie et al., 2023).

Ranks come from parallel sorting by regular sampling (Shi & Schaeffer, 1992): every
part of the scored table is sorted, every ``step``-th row of a sorted run is a sample,
regularly taken samples are the splitters, rows are exchanged by segment between
splitters, segments are merged, and the counts of earlier segments give exact ranks.
Only segments that begin within the draw are exchanged: all other rows are not drawn.

Inputs: ``documents`` (doc_id, text) and a target (text).  A null or wordless text has no
features and weight 0.  A null doc_id is digested as an empty one and stands behind all
others of its score.  Repeated rows are scored and ranked each, one after the other.  An empty
target, or no documents, leaves sums of 0, for which the gains are defined all the same.
Other columns are not looked at, and ``resampled`` keeps them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from paperlantern.llm.common import stored
from paperlantern.llm.tokens import byte_classes, folded_values, slices, tokens_of

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Words are runs of digits, letters and all beyond ASCII.
_CLASSES = byte_classes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Words up to so many bytes are hashed by table.
_TABLE_BYTES = 64
#: Rows of a segment, and how many segments there are at most.
SEGMENT_ROWS = 4096
SEGMENTS = 4096
#: Samples for each splitter.
OVERSAMPLING = 16


# ------------------------------------------------------------ hashing

def _register(message: bytes) -> int:
    """The checksum without what depends on the length alone: linear in the bits of the message."""
    return zlib.crc32(message) ^ zlib.crc32(bytes(len(message)))


#: _AT[n][b]: share of byte b with n bytes behind it.
_AT = np.array([[_register(bytes([b, *bytes(n)])) for b in range(256)] for n in range(_TABLE_BYTES + 1)], np.uint32)
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(2 * _TABLE_BYTES + 2)], np.uint32)


def _shift_tables() -> np.ndarray:
    """[n][k][b]: the register that holds b in its k-th byte, after n more bytes of zero."""
    tables = np.empty((_TABLE_BYTES + 1, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for k in range(4):
        tables[0, k] = values << np.uint32(8 * k)
    for n in range(1, _TABLE_BYTES + 1):
        before = tables[n - 1]
        tables[n] = (before >> np.uint32(8)) ^ _AT[0][before & np.uint32(0xFF)]
    return tables


_SHIFT = _shift_tables()


def _shifted(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = _SHIFT[n, 0, register & 0xFF]
    for k in (1, 2, 3):
        out ^= _SHIFT[n, k, (register >> np.uint32(8 * k)) & 0xFF]
    return out


def word_checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of every word, and of every pair (word i, a space, word i + 1) for i in ``joined``.

    Whole arrays at a time; a pair with a word too long for the tables is hashed by itself.
    """
    size = ends - starts
    if not len(starts):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    behind = np.repeat(ends, size)
    run = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(run, size) + np.repeat(starts, size)
    left = np.minimum(behind - at - 1, _TABLE_BYTES)
    register = np.bitwise_xor.reduceat(_AT[left, raw[at]], run)
    long = size > _TABLE_BYTES
    single = register ^ _ZEROS[np.minimum(size, _TABLE_BYTES)]
    for i in np.flatnonzero(long):
        single[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    after = joined + 1
    spaced = _shifted(register[joined], np.ones(len(joined), np.int64)) ^ _AT[0][32]
    pair = _shifted(spaced, np.minimum(size[after], _TABLE_BYTES)) ^ register[after]
    pair ^= _ZEROS[np.minimum(size[joined] + size[after] + 1, 2 * _TABLE_BYTES + 1)]
    for k in np.flatnonzero(long[joined] | long[after]):
        i = joined[k]
        pair[k] = zlib.crc32(raw[starts[i] : ends[i]].tobytes() + b" " + raw[starts[i + 1] : ends[i + 1]].tobytes())
    return single, pair


def features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of ``texts``: (words per text, text of each feature, bucket of each feature)."""
    for first, last in slices(texts):
        found = tokens_of(texts.slice(first, last - first), _CLASSES, folded_values())
        raw = found.raw.copy()
        upper = (raw >= 65) & (raw <= 90)
        raw[upper] += 32
        joined = np.flatnonzero(found.doc[1:] == found.doc[:-1])
        single, pair = word_checksums(raw, found.starts, found.ends, joined)
        bucket = np.concatenate([single, pair]).astype(np.int64) % buckets
        yield np.diff(found.first), np.concatenate([found.doc, found.doc[joined]]), bucket


# ------------------------------------------------------------ weights

def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of (text): summed in every task, then over tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("string")).mapInArrow(partial, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) per bucket, smoothed by one."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * (s_all + buckets) / ((float(s) + 1) * (t_all + buckets)))) for s, t in zip(source, target)
    ], np.int64)


def _weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` (…, text) without the text, with n_words, n_features and weight."""
    buckets, names = len(gain), [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            words, number, weight = [], [], []
            for n_words, doc, bucket in features(texts, buckets):
                n = np.bincount(doc, minlength=len(n_words)).astype(np.int64)
                # sums of whole numbers far below 2**53 are exact in doubles
                total = np.bincount(doc, gain[bucket], minlength=len(n_words)).astype(np.int64)
                words.append(n_words)
                number.append(n)
                weight.append(total // np.maximum(n, 1))
            more = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (words, number, weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*names, "n_words", "n_features", "weight"])

    plain = rows.select(*names, "text")
    schema = StructType([*plain.schema.fields[:-1], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])
    return plain.mapInArrow(score, schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000.0 * F.ln(-F.ln(u))).cast("long")


# ------------------------------------------------------------ ranks

def not_behind(rows: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """For every column of ``rows`` (a tuple of whole numbers), how many columns of ``borders`` are not behind it."""
    both = np.concatenate([borders, rows], 1)
    row = np.arange(both.shape[1]) >= borders.shape[1]
    order = np.lexsort((row, *both[::-1]))  # of equal ones the border comes first
    met = np.empty(len(order), np.int64)
    met[order] = np.cumsum(~row[order])
    return met[borders.shape[1] :]


def _segment_of(rows: DataFrame, splitters: list) -> DataFrame:
    """Adds ``segment``: how many splitters are not behind the row."""
    if not splitters:
        return rows.withColumn("segment", F.lit(0))
    borders = np.array(splitters, np.int64).T
    names = rows.columns
    at = [names.index(c) for c in KEY]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at])
            found = not_behind(mine, borders).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, "segment"])

    return rows.mapInArrow(place, StructType([*rows.schema.fields, StructField("segment", IntegerType())]))


#: Order of ranks: falling score, then rising id (null last), then the place in the sorted run.
KEY = ["k_score", "k_null", "k_id", "k_at"]


def rank_rows(rows: DataFrame, draw: int) -> DataFrame:
    """(at, rank) of the ``draw`` first of (at, score, doc_id), in order of falling score and rising id.

    ``at`` numbers the rows of every part of a sorted run (upper bits: the run).
    """
    n = rows.count()
    segments = max(1, min(SEGMENTS, n // SEGMENT_ROWS))
    step = max(1, n // (segments * OVERSAMPLING))
    key = rows.select("at", (-F.col("score")).alias("k_score"), F.col("doc_id").isNull().cast("long").alias("k_null"),
                      F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("at").alias("k_at"))
    # every step-th row of a run, beginning at a place of the run's own, so that short runs count too
    run, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    samples = key.where(F.pmod(place + F.pmod(F.xxhash64(run), F.lit(step)), F.lit(step)) == 0)
    # some OVERSAMPLING * SEGMENTS rows, whatever the size of the table
    found = sorted(tuple(r) for r in samples.select(*KEY).collect()) if segments > 1 else []
    splitters = [found[i * len(found) // segments] for i in range(1, segments)] if len(found) >= segments else found
    dealt = stored(_segment_of(key, splitters), "resampling-segments")
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("segment").alias("of_segment"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = F.broadcast(counts.where(F.col("before") < draw))  # SEGMENTS rows at most
    chosen = dealt.join(counts, F.col("segment") == F.col("of_segment"))
    merged = Window.partitionBy("segment").orderBy(*KEY)
    ranked = chosen.withColumn("rank", (F.col("before") + F.row_number().over(merged)).cast("long"))
    return ranked.where(F.col("rank") <= draw).select(F.col("at").alias("of_at"), "rank")


def _scored(rows: DataFrame, docs: DataFrame, target: DataFrame, seed: int) -> DataFrame:
    """``rows`` (…, doc_id, text) with n_words, n_features, weight, score, at; written in sorted runs."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = _weighted(rows, gain).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    run = scored.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    return stored(run.withColumn("at", F.monotonically_increasing_id()), "resampling-runs")


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with the rank of the rows that are drawn."""
    able = scored.where(F.col("n_words") >= least_words)
    ranks = rank_rows(able.select("at", "score", "doc_id"), percent * able.count() // 100)
    return scored.join(stored(ranks, "resampling-ranks"), F.col("at") == F.col("of_at"), "left")


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _ranked(_scored(rows, docs, target, seed), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns."""
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text)
    drawn = _ranked(_scored(rows, docs, target, seed), percent, least_words).where("rank IS NOT NULL")
    return drawn.select(*[F.col(f"row.`{c}`") for c in docs.columns])


SQL = r"""
WITH RECURSIVE
words AS (
  SELECT row_number() OVER () AS n, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
wanted AS (
  SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
mine AS (SELECT n, f, count(*) AS k FROM (SELECT n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words) GROUP BY n, f),
theirs AS (SELECT f, count(*) AS k FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM wanted) GROUP BY f),
every AS (SELECT DISTINCT f FROM (SELECT f FROM mine UNION ALL SELECT f FROM theirs)),
bits(b, i, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE i < 8),
byte AS (SELECT b, v FROM bits WHERE i = 8),
longest AS (SELECT max(len(hex(f)) // 2) AS m FROM every),
behind(n, b, v) AS (
  SELECT 0, b, v FROM byte
  UNION ALL SELECT n + 1, x.b, xor(x.v >> 8, y.v) FROM behind x JOIN byte y ON y.b = (x.v & 255) WHERE n < (SELECT m FROM longest)),
zeros(n, v) AS (
  SELECT 0, 4294967295 UNION ALL SELECT n + 1, xor(x.v >> 8, y.v) FROM zeros x JOIN byte y ON y.b = (x.v & 255) WHERE n < (SELECT m FROM longest)),
spelled AS (SELECT f, h, unnest(range(len(h) // 2)) AS i FROM (SELECT f, hex(f) AS h FROM every)),
summed AS (
  SELECT f, max(len(h)) // 2 AS size, bit_xor(v) AS v
  FROM spelled JOIN behind ON behind.n = len(h) // 2 - 1 - i AND behind.b = CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT) GROUP BY f),
bucket AS (SELECT f, xor(xor(summed.v, zeros.v), 4294967295) % 10000 AS u FROM summed JOIN zeros ON zeros.n = summed.size),
s AS (SELECT u, CAST(sum(k) AS DOUBLE) AS s FROM mine JOIN bucket USING (f) GROUP BY u),
t AS (SELECT u, CAST(sum(k) AS DOUBLE) AS t FROM theirs JOIN bucket USING (f) GROUP BY u),
gain AS (
  SELECT s.u, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS g
  FROM s LEFT JOIN t ON s.u = t.u),
weight AS (SELECT n, CAST(sum(k) AS BIGINT) AS n_features, CAST(floor(sum(k * g) / sum(k)) AS BIGINT) AS weight FROM mine JOIN bucket USING (f) JOIN gain USING (u) GROUP BY n),
scored AS (
  SELECT n, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weight USING (n)),
placed AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS able FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (n)"""
