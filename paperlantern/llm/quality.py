"""Quality: random-indexing word vectors, pooled per document, and a small network.

Random indexing (Kanerva et al., 2000): every token has a fixed sparse vector of +1
and -1 drawn from its hash; the vector of a token is the sum of the sparse vectors of
its neighbours over the whole corpus.  The sums are whole numbers, so they do not
depend on the order of tasks.  Tokens share ``BUCKETS`` hash buckets, so the table has
one size at any scale of the input.  A document is the mean of its tokens' vectors and
the mean likeness (inner product) of neighbouring tokens' vectors; a network maps it to a probability, whose temperature is set on labelled rows that the
network was not fitted on.

Inputs: ``documents`` (doc_id, text), ``labels`` (doc_id, quality).  The vectors come
from all texts; labels are learnt from at most ``sample_rows`` rows of the learning
folds.  A text without tokens (null, empty) pools to the zero vector and is scored
like any other.  Repeated rows are scored one by one.  Without usable labels every
score is 0.5.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlantern.llm import tokens as tk
from paperlantern.llm.common import held_out, labelled_sample

SAMPLE_ROWS = 8_000
BUCKETS = 1 << 14
DIMENSIONS = 64
NONZERO = 4
WINDOW = 2
HIDDEN = 32
#: Pooled features of a document.
FEATURES = DIMENSIONS + 1
#: Rows of the table that travel together; tokens whose vectors are in memory at once.
BLOCK = 256
CHUNK = 100_000
#: Tasks that share the first level of adding up.
SALTS = 64


def pieces_of(texts: pa.Array) -> tk.Tokens:
    """Runs of letters, of digits and of punctuation, as written."""
    return tk.tokens_of(texts, tk.PIECES, tk.exact_values())


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def index_entries(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimension, sign) of each nonzero entry of the tokens' sparse vectors."""
    bits = DIMENSIONS.bit_length() - 1
    for j in range(NONZERO):
        at = (hashes >> np.uint64(bits * j)) & np.uint64(DIMENSIONS - 1)
        sign = (hashes >> np.uint64(bits * NONZERO + j)) & np.uint64(1)
        yield at.astype(np.int64), np.where(sign == 1, 1, -1)


def context_sums(t: tk.Tokens, into: np.ndarray) -> None:
    """Add the sparse vectors of a token and its neighbours to its bucket's row."""
    bucket = bucket_of(t.hashes) * DIMENSIONS
    for at, sign in index_entries(t.hashes):
        into += np.bincount(bucket + at, sign, into.size).astype(np.int64)
        for step in range(1, min(WINDOW, len(bucket) - 1) + 1):
            near = t.doc[step:] == t.doc[:-step]
            into += np.bincount(bucket[:-step][near] + at[step:][near], sign[step:][near], into.size).astype(np.int64)
            into += np.bincount(bucket[step:][near] + at[:-step][near], sign[:-step][near], into.size).astype(np.int64)


def unit_rows(sums: np.ndarray) -> np.ndarray:
    table = sums.reshape(BUCKETS, DIMENSIONS).astype(float)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return np.where(norm > 0, table / np.maximum(norm, 1e-12), 0.0)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the tokens of each whole text, and the mean likeness of neighbours."""
    out = np.zeros((len(texts), FEATURES))
    for a, b in tk.slices(texts):
        t = pieces_of(texts.slice(a, b - a))
        n, bucket = np.diff(t.first), bucket_of(t.hashes)
        for at in range(0, len(bucket), CHUNK):
            doc = t.doc[at : at + CHUNK]
            rows = vectors[bucket[at : at + CHUNK + 1]]
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out[a + doc[begin], :DIMENSIONS] += np.add.reduceat(rows[: len(doc)], begin)
            pair = doc[: len(rows) - 1] == t.doc[at + 1 : at + len(rows)]
            like = np.einsum("ij,ij->i", rows[:-1], rows[1:])[pair]
            out[a : b, DIMENSIONS] += np.bincount(doc[: len(rows) - 1][pair], like, b - a)
        out[a:b] /= np.maximum(n, 1)[:, None]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 1500, l2: float = 1e-4) -> Network:
    """Adam on four fifths of the rows; the temperature is chosen on the rest."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if not len(x):
        return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    rest = np.arange(len(x)) % 5 == 4
    train, y_train = x[~rest], y[~rest]
    net = Network(train.mean(0), train.std(0) + 1e-6, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    parts = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(train), min(512, len(train)))
        z = (train[pick] - net.mean) / net.scale
        h = np.tanh(z @ parts[0] + parts[1])
        error = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3], -40, 40))) - y_train[pick]) / len(pick)
        back = error[:, None] * parts[2] * (1 - h * h)
        slopes = [z.T @ back + l2 * parts[0], back.sum(0), h.T @ error + l2 * parts[2], np.array([error.sum()])]
        for i, g in enumerate(slopes):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            parts[i] -= 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
    if rest.any():
        z, target = net.logits(x[rest]), y[rest]
        loss = {t: np.mean(np.logaddexp(0, z / t) - target * z / t) for t in np.geomspace(0.25, 8, 61)}
        net.temperature = float(min(loss, key=loss.get))
    return net


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of unit vectors, from every whole text.

    Each task adds up its own table and sends blocks of it.  The blocks are added up by
    the executors in two levels, (block, salt) and block, batch by batch, so a task holds
    one table at most whatever the number of tasks; the driver gets one table of fixed size.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * DIMENSIONS, np.int64)
        for batch in batches:
            for a, b in tk.slices(batch["text"]):
                context_sums(pieces_of(batch["text"].slice(a, b - a)), sums)
        parts = sums.reshape(BUCKETS // BLOCK, -1)
        full = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([parts[i].tobytes() for i in full], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cell in zip(batch["block"].to_pylist(), batch["sums"]):
                total.setdefault(block, np.zeros(BLOCK * DIMENSIONS, np.int64))[:] += np.frombuffer(cell.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["block", "sums"])

    schema = "block long, sums binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(gather, schema)
    salted = parts.withColumn("salt", F.spark_partition_id() % SALTS).repartition(SALTS, "block", "salt")
    total = salted.select("block", "sums").mapInArrow(add, schema).repartition(BUCKETS // BLOCK, "block").mapInArrow(add, schema)
    sums = np.zeros((BUCKETS // BLOCK, BLOCK * DIMENSIONS), np.int64)
    for row in total.toArrow().to_pylist():
        sums[row["block"]] = np.frombuffer(row["sums"], np.int64)
    return unit_rows(sums)


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> Network:
    shared = docs.sparkSession.sparkContext.broadcast(vectors.astype(np.float32))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pool = pa.array(list(pooled(batch["text"], shared.value)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pool], ["doc_id", "label", "pool"])

    sample = labelled_sample(docs, labels, "quality", sample_rows)
    rows = sample.mapInArrow(features, "doc_id long, label int, pool array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows["pool"].to_pylist(), float).reshape(-1, FEATURES)
    order = np.random.default_rng(11).permutation(len(x))
    return fit(x[order], rows["label"].to_numpy().astype(float)[order])


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 at ``limit`` or more)."""
    vectors = word_vectors(docs)
    net = train(docs, labels, vectors, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors.astype(np.float32))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = net.probability(pooled(batch["text"], shared.value))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
