"""Toxicity: logistic regression on words, regularised by counterfactuals.

Group words ("muslim", "women") are frequent in toxic sentences although they say
nothing bad themselves.  For every labelled text with such words a counterfactual is
made in which each is swapped for the next of its group, and the squared change of
the score is a penalty of the training.  The model so cannot lean on which group is
named, and neutral mentions are not flagged.

Inputs: ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic).  Learning takes
at most ``sample_rows`` labelled rows of the learning folds; scoring takes every whole
text.  Empty and null texts, and those without a word of the model, get the base rate.  Repeated rows are scored one
by one.  Without usable labels every score is 0.  Other columns are not looked at.
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
MAX_WORDS = 8_192
#: A word is kept when its document frequencies in the classes differ by so many standard errors.
MIN_Z = 3.5
#: Words that name groups of people; a swap stays within its line.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives", "refugees", "foreigners"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles"),
)
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[list(tk.LETTERS)] = 1


def words_of(texts: pa.Array) -> tk.Tokens:
    """Runs of letters, A-Z folded."""
    return tk.tokens_of(texts, _CLASSES, tk.folded_values())


def word_hash(word: str) -> int:
    return int(words_of(pa.array([word])).hashes[0])


@dataclass
class Model:
    words: np.ndarray  # sorted uint64
    weights: np.ndarray
    bias: float
    base: float = 0.0  # share of label 1 in the sample


def swaps() -> tuple[np.ndarray, np.ndarray]:
    """Hash of each group word, sorted, and the hash of its counterfactual."""
    pairs = sorted((word_hash(w), word_hash(g[(i + 1) % len(g)])) for g in IDENTITY_GROUPS for i, w in enumerate(g))
    return tuple(np.array(x, np.uint64) for x in zip(*pairs))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _present(rows: np.ndarray, words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, position in the vocabulary) of the words that it holds."""
    if not len(words) or not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    hit = vocabulary[at] == words
    pair = np.unique(rows[hit] * len(vocabulary) + at[hit])
    return pair // len(vocabulary), pair % len(vocabulary)


def fit(documents: list[np.ndarray], label: np.ndarray, strength: float = 4.0, l2: float = 3e-5, steps: int = 600) -> Model:
    """Train on the distinct words of labelled texts; ``strength`` weighs the counterfactual penalty."""
    label = np.asarray(label, float)
    n = len(label)
    if not n:
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0)
    rows = np.repeat(np.arange(n), [len(d) for d in documents])
    words = np.concatenate(documents) if len(rows) else np.empty(0, np.uint64)
    names, inverse = np.unique(words, return_inverse=True)
    ones = max(label.sum(), 1.0)
    zeros = max(n - label.sum(), 1.0)
    in_one = np.bincount(inverse, label[rows], len(names))
    in_zero = np.bincount(inverse, 1 - label[rows], len(names))
    p, q, both = in_one / ones, in_zero / zeros, (in_one + in_zero) / n
    z = np.abs(p - q) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / ones + 1 / zeros))
    chosen = np.flatnonzero((z >= MIN_Z) & (in_one + in_zero >= 4))
    chosen = chosen[np.argsort(-z[chosen], kind="stable")][:MAX_WORDS]
    group, other = swaps()
    vocabulary = np.unique(np.concatenate([names[chosen], group]))
    row, col = _present(rows, words, vocabulary)
    # the counterfactual changes group words only: its difference to the text is sparse
    at = np.minimum(np.searchsorted(group, words), len(group) - 1)
    named = group[at] == words if len(words) else np.empty(0, bool)
    gone = _present(rows[named], words[named], vocabulary)
    come = _present(rows[named], other[at[named]], vocabulary)
    d_row = np.concatenate([come[0], gone[0]])
    d_col = np.concatenate([come[1], gone[1]])
    d_val = np.concatenate([np.ones(len(come[0])), -np.ones(len(gone[0]))])
    w, bias = np.zeros(len(vocabulary)), float(np.log(ones / zeros))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        error = sigmoid(np.bincount(row, w[col], n) + bias) - label
        change = np.bincount(d_row, d_val * w[d_col], n)
        slope = np.bincount(col, error[row], len(w)) / n + l2 * w
        slope += 2 * strength / n * np.bincount(d_col, d_val * change[d_row], len(w))
        g = np.append(slope, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(vocabulary, w, float(bias), float(label.mean()))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    scores = []
    for a, b in tk.slices(texts):
        t = words_of(texts.slice(a, b - a))
        row, col = _present(t.doc, t.hashes, model.words)
        known = np.bincount(row, minlength=b - a) > 0
        scores.append(np.where(known, sigmoid(np.bincount(row, model.weights[col], b - a) + model.bias), model.base))
    return np.concatenate(scores) if scores else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Features are made by the executors; the bounded sample is fitted on the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = words_of(batch["text"])
            found = [np.unique(t.hashes[a:b]).view(np.int64) for a, b in zip(t.first, t.first[1:])]
            words = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], words], ["doc_id", "label", "words"])

    sample = labelled_sample(docs, labels, "toxic", sample_rows)
    rows = sample.mapInArrow(features, "doc_id long, label int, words array<long>").toArrow().sort_by("doc_id")
    documents = [np.asarray(x.values, np.int64).view(np.uint64) for x in rows["words"]]
    return fit(documents, rows["label"].to_numpy())


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score_texts(batch["text"], model))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 at 0.5 or more)."""
    scored = toxicity_scores(docs, train(docs, labels, sample_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``limit``."""
    model = train(docs, labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch["text"], model) < limit))

    return docs.mapInArrow(clean, docs.schema)
