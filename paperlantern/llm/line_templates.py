"""Line dedup: a fixed-depth tree of log templates (Drain; He et al., 2017).

A line is its tokens between white space; a token with a digit is the variable
``<*>``.  The tree has fixed depth: token count, then the ``LEADING`` first tokens.  In
a leaf, a line joins the template with which most tokens agree, if that is a share of
``SIMILAR`` at least, and tokens that differ become ``<*>``; else it is a template of its
own.  A template that occurs in two documents or more recurs: its lines are dropped
from all documents but the first (smallest doc_id), so no text is lost altogether.

Lines travel as 64-bit hashes.  Copies of a line are counted before they meet; only
leaves with several different lines in several documents are parsed, in order of
their text.  A line and the first line of its template differ in a share of
1 - ``SIMILAR`` of their places at most, so of one block of places more than that number
one block at least is equal in both.  A leaf with more than ``FOLD`` different lines is
divided into the components of lines that are linked by equal blocks; no template has
lines of two of them, so each is parsed alone, with the result of one pass over the
leaf.  A component is one task's work, whatever its size.

Inputs: ``documents`` (doc_id, text).  Lines end at ``\\n``; blank lines are kept.  A null
text stays null.  Rows of one doc_id are one document; rows without doc_id are another,
the last one.  Repeated rows are each returned.  Other columns are not looked at, and
``drop_recurring`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlantern.llm import tokens as tk
from paperlantern.llm.common import stored
from paperlantern.llm.jaccard_join import components

LEADING = 3
SIMILAR = 0.8
FOLD = 500
VARIABLE = "<*>"
_LAST = (1 << 63) - 1
#: Bits (as a power of two) that tell for which leaves the texts of lines are wanted.
FIELD_BITS = 23


@dataclass
class Lines:
    """Lines with a token, of consecutive texts."""

    doc: np.ndarray  # index of the text
    number: np.ndarray  # of the line in its text
    leaf: np.ndarray  # hash of token count and leading tokens
    key: np.ndarray  # hash of all tokens
    tokens: tk.Tokens
    digit: np.ndarray  # for each token: is it a variable
    first: np.ndarray  # index of the first token of each line; one entry more than lines

    def masked(self, line: int) -> str:
        """Its tokens, variables replaced, one space apart."""
        t = self.tokens
        span = range(self.first[line], self.first[line + 1])
        return " ".join(VARIABLE if self.digit[i] else t.raw[t.starts[i] : t.ends[i]].tobytes().decode() for i in span)


_VARIABLE_HASH = np.uint64(0x9D8A2F1C6B4E7351)


def lines_of(texts: pa.Array) -> Lines:
    t = tk.tokens_of(texts, tk.WORDS, tk.exact_values())
    n = len(t.hashes)
    digits = np.zeros(len(t.raw) + 1, np.int32)
    np.cumsum((t.raw >= 48) & (t.raw <= 57), out=digits[1:])
    digit = digits[t.ends] > digits[t.starts]
    hashes = np.where(digit, _VARIABLE_HASH, t.hashes)
    ends = np.flatnonzero(t.raw == 10)
    number = np.searchsorted(ends, t.starts) - np.searchsorted(ends, t.offsets)[t.doc]
    begins = np.flatnonzero(np.append(n > 0, (number[1:] != number[:-1]) | (t.doc[1:] != t.doc[:-1]))[: n or 0])
    first = np.append(begins, n)
    count = np.diff(first)
    place = np.arange(n) - np.repeat(begins, count)
    weighed = hashes * tk.powers(int(count.max(initial=0)) + 1)[place]
    size = count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    add = lambda x: np.add.reduceat(x, begins) if len(begins) else np.empty(0, np.uint64)
    key = tk.mixed(add(weighed) + size)
    leaf = tk.mixed(add(np.where(place < LEADING, weighed, np.uint64(0))) ^ tk.mixed(size))
    return Lines(t.doc[begins], number[begins], leaf.view(np.int64), key.view(np.int64), t, digit, first)


def _texts(docs: DataFrame) -> DataFrame:
    """doc, text_key, text of the documents that have a text."""
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.where(text.isNotNull()).select(doc.alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc, text_key, and for each line with a token its number, leaf and key."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_key = batch["doc"].to_numpy(), batch["text_key"].to_numpy()
            for a, b in tk.slices(batch["text"]):
                x = lines_of(batch["text"].slice(a, b - a))
                columns = [doc[a + x.doc], text_key[a + x.doc], x.number, x.leaf, x.key]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "text_key", "line_no", "leaf", "line_key"])

    return _texts(docs).mapInArrow(split, "doc long, text_key long, line_no long, leaf long, line_key long")


def _slots(leaves: np.ndarray) -> np.ndarray:
    return (leaves.view(np.uint64) >> np.uint64(64 - FIELD_BITS)).astype(np.int64)


def _masked_lines(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, line_key, masked) of lines in the leaves of ``of_leaf``; lines of a few more may be in it.

    A bit field of fixed size tells the scan which lines to give out as text.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(batch["of_leaf"].to_numpy())))], ["slot"])

    field = np.zeros(1 << FIELD_BITS, bool)
    field[leaves.select("of_leaf").mapInArrow(place, "slot long").distinct().toArrow()["slot"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(field))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        seen: set[int] = set()  # keys of the lines given out by this task
        for batch in batches:
            for a, b in tk.slices(batch["text"]):
                x = lines_of(batch["text"].slice(a, b - a))
                wanted = np.flatnonzero(bits[_slots(x.leaf)])
                places = dict(zip(x.key[wanted].tolist(), wanted.tolist()))
                fresh = [i for k, i in places.items() if k not in seen]
                seen.update(places)
                columns = [pa.array(x.leaf[fresh]), pa.array(x.key[fresh]), pa.array([x.masked(i) for i in fresh], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["leaf", "line_key", "masked"])

    return _texts(docs).select("text").mapInArrow(give, "leaf long, line_key long, masked string")


def _blocks(n: int, places: list[int], similar: float) -> list[list[int]]:
    """``places`` in so many blocks that similar lines of n tokens, equal elsewhere, agree in one."""
    k = int((1 - similar) * n + 1e-6) + 1
    return [places[len(places) * i // k : len(places) * (i + 1) // k] for i in range(k)]


def parse(lines: list[list[str]], similar: float = SIMILAR) -> tuple[list[int], list[list[str]]]:
    """Template number of each line (all of one token count), and the templates.

    A line is compared with the templates whose first line has a block in common with it.
    """
    numbers: dict[str, int] = {VARIABLE: 0}
    words = np.array([[numbers.setdefault(w, len(numbers)) for w in line] for line in lines], np.int32)
    blocks = _blocks(words.shape[1], np.flatnonzero((words != words[0]).any(0)).tolist(), similar)
    templates = np.empty_like(words)
    of: list[int] = []
    known: dict[tuple[int, bytes], list[int]] = {}
    n = 0
    for row in words:
        names = [(i, row[b].tobytes()) for i, b in enumerate(blocks)]
        near = np.array(sorted({t for x in names for t in known.get(x, ())}), np.int64)
        if len(near):
            old = templates[near]
            agree = ((old == row) & (old >= 0)).sum(1)
            at = int(agree.argmax())
            if agree[at] >= similar * len(row) - 1e-9:
                best = int(near[at])
                templates[best][templates[best] != row] = -1
                of.append(best)
                continue
        templates[n] = row
        for x in names:
            known.setdefault(x, []).append(n)
        of.append(n)
        n += 1
    names = [VARIABLE, *list(numbers)[1:]]
    return of, [[VARIABLE if w < 0 else names[w] for w in t] for t in templates[:n]]


def _components(texts: DataFrame) -> DataFrame:
    """(member, label): lines of crowded leaves, linked when they have an equal block.

    Each line of a block is linked with one of them, so links grow with the lines.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, leaves, numbers, blocks = [], [], [], []
            for leaf, key, text in zip(*(batch[c].to_pylist() for c in ("leaf", "line_key", "masked"))):
                words = text.split(" ")
                for i, block in enumerate(_blocks(len(words), list(range(LEADING, len(words))), SIMILAR)):
                    members.append(key)
                    leaves.append(leaf)
                    numbers.append(i)
                    blocks.append(" ".join(words[j] for j in block))
            columns = [pa.array(members, pa.int64()), pa.array(leaves, pa.int64()), pa.array(numbers, pa.int64()), pa.array(blocks, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["member", "leaf", "number", "block"])

    rows = texts.select("leaf", "line_key", "masked").mapInArrow(cut, "member long, leaf long, number long, block string")
    rows = stored(rows.select("member", F.xxhash64("leaf", "number", "block").alias("block")), "line-blocks")
    head = rows.groupBy(F.col("block").alias("of_block")).agg(F.min("member").alias("head"))
    links = rows.join(head, rows.block == F.col("of_block")).select(F.col("member").alias("a"), F.col("head").alias("b"))
    return components(texts.sparkSession, links)


_PARSED = "leaf long, line_key long, template long, masked string"


def _parse_leaves(rows: DataFrame) -> DataFrame:
    """(leaf, fold, line_key, masked)  →  template of each line_key: the key of its first line."""

    def run(leaf: int, found: dict[int, str]) -> pa.RecordBatch:
        keys = sorted(found, key=lambda k: (found[k], k))
        of, templates = parse([found[k].split(" ") for k in keys])
        first: dict[int, int] = {}
        for key, t in zip(keys, of):
            first.setdefault(t, key)
        columns = [pa.array([leaf] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array([first[t] for t in of], pa.int64()), pa.array([" ".join(templates[t]) for t in of], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["leaf", "line_key", "template", "masked"])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, {}
        for batch in batches:
            for leaf, fold, key, text in zip(*(batch[c].to_pylist() for c in ("leaf", "fold", "line_key", "masked"))):
                if (leaf, fold) != at:
                    if found:
                        yield run(at[0], found)
                    at, found = (leaf, fold), {}
                found[key] = text
        if found:
            yield run(at[0], found)

    ready = rows.repartition("leaf", "fold").sortWithinPartitions("leaf", "fold").select("leaf", "fold", "line_key", "masked")
    return ready.mapInArrow(parsed, _PARSED)


def recurring(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, text_key, line_no, leaf, line_key) of all lines; (line_key, first_doc) of those whose template recurs."""
    lines = stored(_lines(docs), "lines")
    known = stored(lines.groupBy("leaf", "line_key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")), "line-counts")
    crowd = known.groupBy("leaf").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    crowd = stored(crowd.where("n > 1 AND lo != hi").select(F.col("leaf").alias("of_leaf"), F.ceil(F.col("n") / FOLD).alias("folds")), "leaves")
    # one text of each different line in those leaves
    texts = _masked_lines(docs, crowd).join(crowd, F.col("leaf") == F.col("of_leaf"))
    texts = stored(texts.select("leaf", "line_key", "masked", "folds").dropDuplicates(["leaf", "line_key"]), "leaf-lines")
    plain = texts.where("folds = 1").withColumn("fold", F.lit(0).cast("long"))
    large = texts.where("folds > 1")
    if not large.isEmpty():
        of = _components(large)
        large = large.join(of, large.line_key == of.member, "left").withColumn("fold", F.coalesce("label", "line_key"))
        plain = plain.unionByName(large.select(*plain.columns))
    final = _parse_leaves(plain).select("line_key", "template")
    final = stored(final, "final-templates")
    placed = known.join(final.withColumnRenamed("line_key", "k"), F.col("line_key") == F.col("k"), "left")
    placed = stored(placed.select("line_key", F.coalesce("template", "line_key").alias("template"), "lo", "hi"), "placed-lines")
    whole = placed.groupBy("template").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("last_doc")).where("first_doc != last_doc")
    whole = whole.select(F.col("template").alias("t"), "first_doc")
    return lines, stored(placed.join(whole, placed.template == F.col("t")).select(F.col("line_key").alias("k"), "first_doc").distinct(), "recurring-lines")


def _dropped(docs: DataFrame) -> DataFrame:
    """(__of_doc, __of_text, __dropped): numbers of the lines to drop."""
    lines, again = recurring(docs)
    gone = lines.join(again, lines.line_key == again.k).where("doc != first_doc")
    return stored(gone.groupBy(F.col("doc").alias("__of_doc"), F.col("text_key").alias("__of_text")).agg(F.collect_set("line_no").alias("__dropped")), "dropped-lines")


def _cut(docs: DataFrame) -> DataFrame:
    """``docs`` with __text (its text without the dropped lines), __lines and __dropped."""
    gone = _dropped(docs)
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    # shuffled at every size: the dropped lines grow with the documents
    marked = docs.join(gone.hint("merge"), (doc == F.col("__of_doc")) & (F.xxhash64(text) == F.col("__of_text")), "left")
    marked = marked.select(*[F.col(f"`{c}`") for c in docs.columns], text.alias("__text"), F.col("__dropped"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, out = [], [], []
            for text, dropped in zip(batch["__text"].to_pylist(), batch["__dropped"].to_pylist()):
                lines = [] if text is None else text.split("\n")
                gone = set(dropped or ())
                texts.append(None if text is None else text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))
                counts.append(len(lines))
                out.append(len(gone))
            columns = [*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], "__text", "__lines", "__dropped"])

    schema = docs.withColumns({"__text": F.lit(None).cast("string"), "__lines": F.lit(None).cast("long"), "__dropped": F.lit(None).cast("long")}).schema
    return marked.mapInArrow(cut, schema)


def drop_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without recurring lines, n_lines, n_dropped of every document."""
    rows = _cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.select("doc_id", F.col("__text").alias("text"), F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with shorter texts; rows of which nothing is left go.

    A column n_chars follows the text.
    """
    rows = _cut(docs).where("__dropped = 0 OR trim(__text) != ''")
    changed = F.col("__dropped") > 0
    columns = []
    for name, kind in docs.dtypes:
        column = F.col(f"`{name}`")
        if name == "text":
            column = F.when(changed, F.col("__text")).otherwise(column).alias(name)
        elif name == "n_chars":
            column = F.when(changed, F.length("__text").cast(kind)).otherwise(column).alias(name)
        columns.append(column)
    return rows.select(*columns)
