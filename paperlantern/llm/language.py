"""Language: rank-order n-gram profiles (Cavnar & Trenkle, 1994).

The n-grams of one to three letters (a word has one boundary mark on each side) of
all learning documents are counted for each language; a profile is the ``PROFILE``
most frequent ones in order.  A text is described in the same way, and its language
is the profile with the smallest out-of-place distance: the sum of the differences
of rank, an n-gram missing from the profile counting ``PROFILE``.

Inputs: ``documents`` (doc_id, text, lang); lang is read for learning only, from the
learning folds.  Whole texts count, at learning and at prediction.  A text that is
null or has no letter is ``und`` with score 0.  Ties go to the smaller name.  A null
lang is not learnt; without any learnt language all is ``und``.  Letters that no
profile holds count as one letter at prediction.  Repeated rows are predicted one by
one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlantern.llm import tokens as tk
from paperlantern.llm.common import held_out, learnable

PROFILE = 400
UNDETERMINED = "und"
#: Bytes of text whose n-grams are in memory at once (a longer text is taken whole).
SLICE = 1 << 20
#: In the place of the first letter: marks of the shorter n-grams, beyond any code point.
_ONE, _TWO = 0x1FFFFE, 0x1FFFFF
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For every code point: is it a letter?"""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of the texts with one 0 between words, and the text of each."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    joined = "\n" + "\n".join(texts.to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.append(np.repeat(np.arange(len(sizes)), sizes + 1), max(len(sizes) - 1, 0))
    points = np.where(is_letter()[points], points, 0)
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    keep[0] = True
    return points[keep], doc[keep]


def grams_of(letters: np.ndarray, doc: np.ndarray, bits: int, one: int, two: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams within words, and the text of each."""
    single = letters != 0
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    first, second = letters[:-1], letters[1:]
    middle = b != 0
    codes = np.concatenate([
        (one << 2 * bits) + letters[single],
        (two << 2 * bits) + (first << bits) + second,
        ((a << 2 * bits) + (b << bits) + c)[middle],
    ])
    return codes, np.concatenate([doc[single], np.where(first != 0, doc[:-1], doc[1:]), doc[1:-1][middle]])


@dataclass
class Profiles:
    """Learnt languages in order of name; ranks by compact n-gram code."""

    names: list[str]
    grams: list[list[int]]  # per language, code-point codes in order of rank
    alphabet: np.ndarray = field(init=False)
    bits: int = field(init=False)
    codes: list[np.ndarray] = field(init=False)
    ranks: list[np.ndarray] = field(init=False)
    numbers: np.ndarray | None = field(init=False, default=None)  # of all code points, made where it is used

    def __post_init__(self) -> None:
        mask = (1 << 21) - 1
        known = {x for g in self.grams for code in g for x in (code >> 42, code >> 21 & mask, code & mask)}
        self.alphabet = np.array(sorted(known - {0, _ONE, _TWO}), np.int64)
        n = len(self.alphabet)
        self.bits = (n + 3).bit_length()
        number = {0: 0, _ONE: n + 2, _TWO: n + 3} | {int(x): i for i, x in enumerate(self.alphabet, 1)}
        self.codes, self.ranks = [], []
        for g in self.grams:
            short = [(number[x >> 42] << 2 * self.bits) + (number[x >> 21 & mask] << self.bits) + number[x & mask] for x in g]
            order = np.argsort(short)
            self.codes.append(np.array(short, np.int64)[order])
            self.ranks.append(order)

    def compact(self, letters: np.ndarray) -> np.ndarray:
        """Letters as numbers from 1; letters outside the alphabet are its size + 1."""
        if self.numbers is None:
            self.numbers = np.full(0x110000, len(self.alphabet) + 1, np.int64)
            self.numbers[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
            self.numbers[0] = 0
        return self.numbers[letters]


def ranked(texts: pa.Array, profiles: Profiles) -> Iterator[np.ndarray]:
    """For each text, its most frequent n-grams in order (ties: smaller code)."""
    bits = profiles.bits
    room = (1 << 3 * bits) - 1
    most = (1 << 62 - 3 * bits) - 1
    n = len(profiles.alphabet)
    letters, doc = letters_of(texts)
    codes, owner = grams_of(profiles.compact(letters), doc, bits, n + 2, n + 3)
    for begin in range(0, len(texts), 4096):
        # a text's number and a code share 64 bits: alphabets of up to 2**16 letters
        here = (owner >= begin) & (owner < begin + 4096) if len(texts) > 4096 else slice(None)
        key = np.sort(((owner[here] - begin) << 3 * bits) + codes[here])
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        count = np.minimum(np.diff(np.append(start, len(key))), most)
        key = key[start]
        text, order = key >> 3 * bits, (count << 3 * bits) + (room - (key & room))
        bounds = np.searchsorted(text, np.arange(min(4096, len(texts) - begin) + 1))
        for a, b in zip(bounds, bounds[1:]):
            top = order[a:b]
            if len(top) > PROFILE:
                top = np.partition(top, len(top) - PROFILE)[len(top) - PROFILE :]
            yield room - (np.sort(top)[::-1] & room)


def predict(texts: pa.Array, profiles: Profiles) -> tuple[list[str], np.ndarray]:
    names, scores = [], []
    for a, b in tk.slices(texts, SLICE):
        tops = list(ranked(texts.slice(a, b - a), profiles))
        sizes = np.array([len(x) for x in tops])
        grams = np.concatenate(tops)
        owner = np.repeat(np.arange(b - a), sizes)
        rank = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        distance = np.full((len(profiles.names) + 1, b - a), np.inf)
        # most n-grams repeat from text to text: each is looked up once
        grams, inverse = np.unique(grams, return_inverse=True)
        for i, (codes, ranks) in enumerate(zip(profiles.codes, profiles.ranks)):
            at = np.minimum(np.searchsorted(codes, grams), max(len(codes) - 1, 0))
            place = np.where(codes[at] == grams, ranks[at], -1)[inverse]
            distance[i] = np.bincount(owner, np.where(place >= 0, np.abs(place - rank), PROFILE), b - a)
        best = distance.argmin(0)
        least = distance[best, np.arange(b - a)]
        empty = (sizes == 0) | ~np.isfinite(least)
        names += [UNDETERMINED if e else profiles.names[i] for i, e in zip(best, empty)]
        scores.append(np.where(empty, 0.0, 1 - np.where(empty, 0, least) / np.maximum(sizes * PROFILE, 1)))
    return names, np.concatenate(scores) if scores else np.empty(0)


def learn(docs: DataFrame) -> Profiles:
    """Profiles from all learning documents; only they come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for a, b in tk.slices(batch["text"], SLICE):
                part = batch["text"].slice(a, b - a)
                codes, owner = grams_of(*letters_of(part), 21, _ONE, _TWO)
                lang = batch["lang"].slice(a, b - a).dictionary_encode()
                number = lang.indices.to_numpy()[owner]
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    grams, n = np.unique(codes[number == i], return_counts=True)
                    if name in total:
                        both, inverse = np.unique(np.concatenate([total[name][0], grams]), return_inverse=True)
                        total[name] = both, np.bincount(inverse, np.concatenate([total[name][1], n])).astype(np.int64)
                    else:
                        total[name] = grams, n
        for name, (grams, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    texts = docs.where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string"))
    counts = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("place", place).where(F.col("place") <= PROFILE).collect()
    by: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.place)):
        by.setdefault(row.lang, []).append(row.gram)
    return Profiles(list(by), list(by.values()))


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (1: in step with the profile)."""
    profiles = learn(docs)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch["text"], profiles)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(guess, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
