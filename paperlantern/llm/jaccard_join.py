"""N-gram Jaccard join: T-occurrence search with DivideSkip (Li, Lu & Lu, 2008).

Documents are sets of five-word shingles; two link at a Jaccard similarity of 0.8.
Equal sets are one class from the start, so copies are never paired.

1. *Lists.*  Every class posts a few shingles, its first ones in one global order:
   by hash, the frequent shingles last.  A class of n shingles posts n - ceil(0.8 n) + 1
   of them, so linked classes share a list, whatever their size and in any such order.
   Of two classes that have to share k shingles, the first shared one is among the first
   n - k + 1 of either: a posting carries its place, and a pair needs a list
   on which both places are that early.
2. *Short and long lists.*  Documents on ``SHORT`` or fewer per list are merged: pairs are
   counted over short lists, and stay when the count, the long lists that both are on
   and all that is not posted can reach the overlap that 0.8 needs.  Long lists are not
   paired: each document on one is tried with the one document that shares most long lists
   with it as their head.  Links found so join classes; lists whose documents are all in
   one class are done.  After ``ROUNDS`` such rounds the early places left on long lists,
   between different classes only, are paired.  Documents half alike have too many
   shingles of their own before the first shared one, so they make no pairs.
   No pair is dropped for the length of a list.
3. *Search.*  Each larger set is a query over the whole sets of its candidates:
   :func:`divide_skip` heap-merges the short lists, probes the long ones by binary
   search, and keeps documents that reach the overlap which 0.8 needs.
4. Links are contracted to components.

Shingles and sets are told apart by 64-bit hashes.  A hot document, list or class is
split: lists of frequent shingles and queries with many candidates are salted.

Inputs: ``documents`` (doc_id, text).  A text of fewer than five words is one shingle; a
null text or one without words has an empty set and is linked with nothing.  Repeated
rows are each returned.  A row without doc_id links like others; the smallest id is
taken over ids that are not null.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlantern.llm import tokens as tk
from paperlantern.llm.common import release, stored

SHINGLE = 5
PERCENT = 80
#: Sets of fewer shingles link with equal sets only.
LEAST = 4
SHORT = 64
ROUNDS = 3
#: Shingles that come last in the order, at most (the most frequent ones).
FREQUENT = 1 << 18
#: A shingle of so many sets of one task is reported as frequent.
REPORTED = 4
#: Postings of one salt of a frequent list, candidates of one salt of a query.
SALT_ROWS = 2_000
UNIT_ROWS = 500
#: Bits (as a power of two, and for each document wanted) that tell whose whole sets are wanted.
FIELD_BITS = 27
BITS_EACH = 16
#: Shingles of a set that travel in one row, so that a batch of rows has a bounded size.
PART = 256
#: A posting's size and place share a number.
PLACE_BITS = 31
_COEFFICIENTS = [np.uint64(c | 1) for c in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2F4A6C1B7D93E5F7)]


# sets


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    t = tk.tokens_of(texts, tk.WORDS, tk.folded_values())
    h = t.hashes
    n = max(len(h) - SHINGLE + 1, 0)
    shingles = np.zeros(n, np.uint64)
    for j, c in enumerate(_COEFFICIENTS):
        shingles += h[j : j + n] * c
    shingles = tk.mixed(shingles)
    for a, b in zip(t.first, t.first[1:]):
        if b - a >= SHINGLE:
            yield np.unique(shingles[a : b - SHINGLE + 1])
        elif b > a:
            factors = np.array(_COEFFICIENTS[: b - a])
            yield tk.mixed(np.sum(h[a:b] * factors * factors, dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """64-bit hash of a set."""
    total = np.sum(tk.mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, keepdims=True)
    return int(tk.mixed(total + np.uint64(len(shingles))).view(np.int64)[0])


def _sets(batch_texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of the texts of a batch, a slice at a time."""
    for a, b in tk.slices(batch_texts):
        yield from enumerate(shingle_sets(batch_texts.slice(a, b - a)), a)


def set_table(docs: DataFrame) -> DataFrame:
    """One scan: (doc_id, n, key) per document, and rows with ``frequent`` for shingles that recur.

    A shingle held by 1 in 1,000 sets is held by REPORTED sets of a task of a few
    thousand documents somewhere, so it is reported; the order needs no exact counts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        often: dict[int, int] = {}
        held, size = [], 0
        for batch in batches:
            n, keys = [], []
            for _, s in _sets(batch["text"]):
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                if len(s) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    held.append(s)
                    size += len(s)
                    if size > 1 << 21:
                        _recurring(held, often)
                        held, size = [], 0
            yield _scan_rows(batch["doc_id"], n, keys, [None] * len(n))
        _recurring(held, often)
        often = {k: v for k, v in often.items() if v >= REPORTED}
        yield _scan_rows(pa.nulls(len(often), pa.int64()), list(often.values()), list(often), [True] * len(often))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, "doc_id long, n long, key long, frequent boolean")


def _recurring(held: list[np.ndarray], often: dict[int, int]) -> None:
    """Add up the shingles that several of these sets hold."""
    if held:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        many = n > 1
        for s, k in zip(found[many].view(np.int64).tolist(), n[many].tolist()):
            often[s] = often.get(s, 0) + k


def _scan_rows(doc_id: pa.Array, n: list, keys: list, frequent: list) -> pa.RecordBatch:
    columns = [doc_id, pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(frequent, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "frequent"])


# lists


def posted(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that a set posts: first in the global order, frequent ones last."""
    n = len(shingles)
    at = np.minimum(np.searchsorted(frequent, shingles), max(len(frequent) - 1, 0))
    often = frequent[at] == shingles if len(frequent) else np.zeros(n, bool)
    last = shingles[often]
    order = np.concatenate([shingles[~often], last[np.lexsort((last, counts[at[often]]))]]) if often.any() else shingles
    return order[: n - (PERCENT * n + 99) // 100 + 1]


def lists(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, salt, member, size, place) of lists with two members at least; salted lists in full.

    Sets of fewer than LEAST shingles link with equal sets only and are not posted.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequent, counts))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, often_counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            tokens, members, sizes = [], [], []
            for _, s in _sets(batch["text"]):
                if len(s) < LEAST or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                tokens.append(posted(s, often, often_counts))
                members.append(key)
                sizes.append(len(s))
            if not tokens:
                continue
            n = [len(t) for t in tokens]
            token = np.concatenate(tokens)
            member = np.repeat(np.array(members, np.int64), n)
            at = np.minimum(np.searchsorted(often, token), max(len(often) - 1, 0))
            load = np.where(often[at] == token, often_counts[at], 0) if len(often) else np.zeros(len(token), np.int64)
            salts = -(-load // SALT_ROWS)
            salt = np.where(salts > 1, np.abs(member >> 5) % np.maximum(salts, 1), -1)
            place = np.concatenate([np.arange(k) for k in n])
            yield _postings(token.view(np.int64), salt, member, np.repeat(np.array(sizes, np.int64), n) << PLACE_BITS | place)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by list and member: drop repeats, and lists of one member."""
        names = ("token", "salt", "member", "shape")
        before, open_run = None, False  # the last row so far; whether its list has been given out
        for batch in batches:
            token, salt, member, shape = (batch[c].to_numpy() for c in names)
            if before is not None:
                token, salt, member, shape = (np.append(b, x) for b, x in zip(before, (token, salt, member, shape)))
            new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            fresh = new | np.append(True, member[1:] != member[:-1])
            token, salt, member, shape, new = (x[fresh] for x in (token, salt, member, shape, new))
            run = np.cumsum(new) - 1
            keep = (np.bincount(run)[run] > 1) | (salt >= 0)
            out = keep.copy()
            if before is not None and open_run:
                keep |= run == 0
                out |= run == 0
                out[0] = False  # given out with the batch before
            before, open_run = tuple(x[-1:] for x in (token, salt, member, shape)), bool(keep[-1])
            if out.any():
                yield _postings(*(x[out] for x in (token, salt, member, shape)))

    schema = "token long, salt long, member long, shape long"
    postings = docs.select(F.col("text").cast("string")).where("text IS NOT NULL").mapInArrow(post, schema)
    met = postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "member").mapInArrow(joined, schema)
    place = F.col("shape").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place")
    return met.select("token", "salt", "member", F.shiftright("shape", PLACE_BITS).alias("size"), place)


def _postings(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "salt", "member", "shape"])


def _near_sizes(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _needed(a: str, b: str):
    """Shingles that sets of these sizes have to share."""
    return F.ceil((F.col(a) + F.col(b)) * PERCENT / (100 + PERCENT)).cast("long")


def _met(rows: DataFrame, *carried: str) -> DataFrame:
    """Members a and b of one list, a with the larger set; ``early``: both in the places of a first shared shingle."""
    a, b = (rows.select(F.col("token").alias(f"{x}_token"), F.col("member").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("size", "place", *carried)]) for x in "ab")
    larger = (F.col("a_size") > F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") > F.col("b")))
    needed = _needed("a_size", "b_size")
    early = (F.col("a_place") <= F.col("a_size") - needed) & (F.col("b_place") <= F.col("b_size") - needed)
    on = (F.col("a_token") == F.col("b_token")) & larger & _near_sizes("a_size", "b_size")
    if "label" in carried:  # only early places count there
        on = on & (F.col("a_label") != F.col("b_label")) & early
    return a.join(b, on).withColumn("early", early)


def _pairs_on_short(rows: DataFrame) -> DataFrame:
    """(a, b) that meet early and can reach their overlap: shared short lists, long lists
    that both are on, and what the larger set doesn't post."""
    counted = _met(rows, "others").groupBy("a", "b").agg(
        F.count("*").alias("n"), F.max("early").alias("early"), *[F.first(c).alias(c) for c in ("a_size", "b_size", "a_others", "b_others")])
    unposted = F.ceil(F.col("a_size") * PERCENT / 100).cast("long") - 1
    reach = F.col("n") + F.least("a_others", "b_others") + unposted
    return counted.where(F.col("early") & (reach >= _needed("a_size", "b_size"))).select("a", "b")


def _pairs_on_long(rows: DataFrame) -> DataFrame:
    """(a, b) of different classes that meet early on a long list."""
    return _met(rows, "label").select("a", "b").distinct()


def _others(rows: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """With ``others``: on how many of the lists elsewhere the member is."""
    n = elsewhere.groupBy(F.col("member").alias("who")).agg(F.count("*").alias("others_n"))
    return rows.join(n, rows.member == F.col("who"), "left").withColumn("others", F.coalesce("others_n", F.lit(0))).drop("who", "others_n")


def _heads(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): each member of a long list with the head that it shares most lists with.

    At first the head is the member with the fewest shingles of its own before the
    list's one: among near copies that is the one most of them link with."""
    order = F.struct("place", "size", "member") if turn == 0 else F.struct(F.xxhash64("member", F.lit(turn)), "member")
    part = rows.groupBy("token", "salt").agg(F.min(F.struct(order.alias("o"), "member", "size", "label")).alias("head"))
    # a salted list has a head per salt, and one of these is the head of the others
    top = part.groupBy(F.col("token").alias("t")).agg(F.min("head").alias("top"))
    first = rows.join(part.select(F.col("token").alias("t"), F.col("salt").alias("s"), "head"), (F.col("token") == F.col("t")) & (F.col("salt") == F.col("s")))
    second = part.join(top, F.col("token") == F.col("t")).select("head.*", F.col("top").alias("head"))
    tried = first.select("member", "size", "label", "head").unionByName(second.select("member", "size", "label", "head"))
    tried = tried.where((F.col("label") != F.col("head.label")) & _near_sizes("size", "head.size"))
    counted = tried.groupBy("member", "head.member", "size", "head.size").agg(F.count("*").alias("n")).toDF("member", "head", "size", "head_size", "n")
    best = counted.groupBy("member", "size").agg(F.max(F.struct("n", (-F.col("head")).alias("neg"), "head", "head_size")).alias("h"))
    larger = (F.col("size") > F.col("h.head_size")) | ((F.col("size") == F.col("h.head_size")) & (F.col("member") > F.col("h.head")))
    return best.select(F.when(larger, F.col("member")).otherwise(F.col("h.head")).alias("a"), F.when(larger, F.col("h.head")).otherwise(F.col("member")).alias("b"))


# search


def divide_skip(postings: Sequence[Sequence[int]], least: int) -> dict[int, int]:
    """Ids on at least ``least`` of the sorted lists, with the number of lists.

    The longest lists are set aside, one fewer than ``least`` at most; an id must be on
    ``least`` minus so many of the others.  Those are merged with a heap that skips ids
    which cannot be often enough; ids found are then looked up in the long lists.
    """
    postings = sorted((p for p in postings if len(p)), key=len)
    if least < 1 or len(postings) < least:
        return {}
    long = postings[len(postings) - (least - 1) :]
    short = postings[: len(postings) - (least - 1)]
    needed = least - len(long)  # 1: fewest merged lists
    heap = [(p[0], i, 0) for i, p in enumerate(short)]
    heapq.heapify(heap)
    found: dict[int, int] = {}
    while len(heap) >= needed:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        n = len(popped)
        if n >= needed:
            left = len(long)
            for p in reversed(long):
                if n + left < least:
                    break
                left -= 1
                at = bisect_left(p, top)
                n += at < len(p) and p[at] == top
            if n >= least:
                found[top] = n
            goal = top + 1
        else:
            while heap and len(popped) < needed - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(short[i], goal, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))
    return found


def linked(query: np.ndarray, candidates: Sequence[np.ndarray]) -> list[int]:
    """Positions of the candidates whose similarity to the query is high enough."""
    if not candidates:
        return []
    owner = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
    every = np.concatenate(candidates)
    at = np.minimum(np.searchsorted(query, every), len(query) - 1)
    hit = query[at] == every
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    bounds = np.searchsorted(at[order], np.arange(len(query) + 1))
    ids = owner[order].tolist()
    postings = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
    needed = [-(-PERCENT * (len(query) + len(c)) // (100 + PERCENT)) for c in candidates]
    found = divide_skip(postings, min(needed))
    return [i for i, n in found.items() if 100 * n >= PERCENT * (len(query) + len(candidates[i]) - n)]


def search(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link: each ``a`` is a query over the ``sets`` of its ``b``."""
    load = pairs.groupBy(F.col("a").alias("q")).agg(F.ceil(F.count("*") / UNIT_ROWS).alias("salts"))
    tried = pairs.join(load, pairs.a == load.q).select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b")
    asked = load.select(F.col("q").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    wanted = asked.withColumn("of", F.col("a")).unionByName(tried.withColumn("of", F.col("b")))
    rows = wanted.join(sets.hint("merge"), F.col("of") == sets.member).select("a", "salt", "b", "part", "shingles")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by query, the query's own parts (no ``b``) before its candidates'."""
        unit, sets = None, {}

        def answer() -> pa.RecordBatch:
            whole = {b: np.concatenate([parts[i] for i in sorted(parts)]) for b, parts in sets.items()}
            query = whole.pop(None, None)
            names = list(whole)
            good = linked(query, list(whole.values())) if query is not None else []
            return pa.RecordBatch.from_arrays([pa.array([unit[0]] * len(good), pa.int64()), pa.array([names[i] for i in good], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("a", "salt", "b", "part"))
            for a, salt, b, part, s in zip(*columns, batch["shingles"]):
                if (a, salt) != unit:
                    if unit is not None:
                        yield answer()
                    unit, sets = (a, salt), {}
                sets.setdefault(b, {})[part] = s.values.to_numpy().view(np.uint64)
        if unit is not None:
            yield answer()

    ready = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return ready.mapInArrow(units, "a long, b long")


# components


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(member, label) of all linked members: the label is one of the members.

    Each round every node takes its smallest neighbour as parent, parents are followed
    twice, and links are contracted to links between parents, until none is left.
    """
    edges = stored(links.select("a", "b").where("a != b").distinct(), "links")
    labels = stored(edges.select(F.col("a").alias("member")).union(edges.select("b")).distinct().withColumn("label", F.col("member")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parent = stored(parent.select("node", F.least("node", "near").alias("up")), "parents")
        for _ in range(2):
            above = parent.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
            parent = _after(stored(parent.join(above, parent.up == above.n2).select("node", F.col("up2").alias("up")), "parents"), parent)
        up_a, up_b = parent.toDF("na", "ua"), parent.toDF("nb", "ub")
        moved = edges.join(up_a, F.col("a") == F.col("na")).join(up_b, F.col("b") == F.col("nb"))
        moved = moved.where("ua != ub").select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b"))
        edges = _after(stored(moved.distinct(), "links"), edges)
        raised = labels.join(parent, labels.label == parent.node, "left").select("member", F.coalesce("up", "label").alias("label"))
        labels = _after(stored(raised, "labels"), labels, parent)
    release(edges)
    return labels


def _after(new: DataFrame, *old: DataFrame) -> DataFrame:
    """``new``, written already, in place of the tables it was made of."""
    release(*old)
    return new


# the operator


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("member"))
    known = labels.select(F.col("member").alias("who"), F.col("label").alias("found"))
    return rows.join(known, rows.member == known.who, "left").withColumn("label", F.coalesce("found", "member")).drop("who", "found")


def _divided(rows: DataFrame) -> DataFrame:
    """Long lists whose members are in different classes."""
    mixed = rows.groupBy(F.col("token").alias("t")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("t")
    return rows.join(mixed, rows.token == mixed.t).drop("t")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, key) per document, (member, label) of linked sets, and their links (a, b)."""
    spark = docs.sparkSession
    scanned = stored(set_table(docs), "shingle-sets")
    documents = scanned.where("frequent IS NULL").select("doc_id", "n", "key")
    frequent = scanned.where("frequent").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    names, counts = frequent["key"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    order = np.argsort(names)
    rows = stored(lists(docs, names[order], counts[order]), "lists")
    long = rows.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("length")).where(F.col("length") > SHORT).select("t")
    long = stored(long, "long-lists")
    on_short = rows.join(long, rows.token == long.t, "left_anti")
    on_long = stored(rows.join(long, rows.token == long.t, "left_semi"), "on-long-lists")

    pairs = stored(_pairs_on_short(_others(on_short, on_long)).unionByName(_heads(_labelled(on_long, None), 0)).distinct(), "pairs")
    release(rows, long)
    # all that this and the later rounds may ask for is read once
    members = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).union(on_long.select("member")).distinct()
    sets = stored(_whole_sets(docs, documents, members), "whole-sets")
    links = stored(search(pairs, sets), "found-links")
    release(pairs)
    labels = components(spark, links)
    for turn in range(1, ROUNDS + 1):
        left = stored(_divided(_labelled(on_long, labels)), "divided-lists")
        if left.isEmpty():
            release(left)
            break
        pairs = stored((_heads(left, turn) if turn < ROUNDS else _pairs_on_long(left)).distinct(), "pairs")
        links = _after(stored(links.unionByName(search(pairs, sets)), "found-links"), links, pairs, left)
        labels = _after(components(spark, links), labels)
    release(on_long, sets)
    return documents, labels, links


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """Place of each document id in a bit field of 2**bits."""
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy()


def _whole_sets(docs: DataFrame, documents: DataFrame, members: DataFrame) -> DataFrame:
    """(member, part, shingles) of a document of every member; a few others may be in it.

    Texts are not shuffled for this: a bit field, made of the ids of the documents
    wanted, tells the scan which texts to turn into sets.  It grows with their
    number up to 2**FIELD_BITS bits; beyond that more sets are read than needed.
    """
    wanted = documents.join(members, documents.key == members.member, "left_semi").groupBy("key").agg(F.min(F.struct("doc_id")).alias("d"))
    wanted = stored(wanted.select("d.doc_id"), "wanted-documents")
    bits = min(FIELD_BITS, max(10, (wanted.count() * BITS_EACH).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(_ids(batch["doc_id"]), bits)))], ["slot"])

    words = wanted.mapInArrow(place, "slot long").groupBy(F.shiftright("slot", 6).alias("word"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    found = words.agg(F.bit_or(one).alias("bits")).toArrow()
    release(wanted)
    field = np.zeros(1 << bits - 6, np.int64)
    field[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(_ids(batch["doc_id"]), bits)
            texts = batch["text"].filter(pa.array((shared.value[slot >> 6] >> (slot & 63) & 1).astype(bool)))
            for a, b in tk.slices(texts):
                yield _parts([s for s in shingle_sets(texts.slice(a, b - a)) if len(s)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(read, "member long, part long, shingles array<long>")


def _parts(sets: list[np.ndarray]) -> pa.RecordBatch:
    """(member, part, shingles): the sets in rows of PART shingles at most."""
    rows = [(set_key(s), i, s[i * PART : (i + 1) * PART].view(np.int64)) for s in sets for i in range(-(-len(s) // PART))]
    columns = [pa.array([k for k, _, _ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.int64()), pa.array([s for _, _, s in rows], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["member", "part", "shingles"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    documents, labels, links = classes(docs)
    release(links)
    rows = documents.join(labels, documents.key == labels.member, "left")
    rows = stored(rows.select("doc_id", "n", F.coalesce("label", "key").alias("class")), "document-classes")
    smallest = rows.where("class IS NOT NULL").groupBy(F.col("class").alias("of")).agg(F.min("doc_id").alias("smallest"))
    result = rows.join(smallest, F.col("class") == F.col("of"), "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays: its smallest doc_id."""
    documents, labels, links = classes(docs)
    release(links)
    rows = documents.join(labels, documents.key == labels.member, "left").where("key IS NOT NULL")
    first = rows.groupBy(F.coalesce("label", "key").alias("class")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("f"))
    kept = stored(first.select(F.col("f.doc_id").alias("__id"), F.col("f.key").alias("__key")), "kept-documents")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(s) if len(s) else None for _, s in _sets(batch["__text"])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.int64())], [*batch.schema.names[:-1], "__found"])

    with_text = docs.withColumn("__text", F.col("text").cast("string"))
    with_key = with_text.mapInArrow(keyed, docs.withColumn("__found", F.lit(None).cast("long")).schema)
    with_key = with_key.withColumn("__doc", F.col("doc_id").cast("long"))
    one = with_key.join(kept, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__found") == F.col("__key"))).dropDuplicates(["__id", "__key"])
    empty = with_key.where("__found IS NULL")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return one.select(*columns).unionByName(empty.select(*columns))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS n, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM w),
c AS (SELECT list_sort(g) AS k, min(doc_id) AS id, len(any_value(g)) AS size FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
p AS (SELECT id, size, unnest(k) AS t FROM c),
often AS (SELECT t, count(*) AS df FROM p GROUP BY t),
o AS (SELECT id, size, p.t, row_number() OVER (PARTITION BY id ORDER BY df, p.t) AS place FROM p JOIN often USING (t)),
pre AS (SELECT id, size, t FROM o WHERE place <= size - (80 * size + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.t = b.t AND a.id < b.id AND 100 * a.size >= 80 * b.size AND 100 * b.size >= 80 * a.size),
met AS (SELECT cand.a, cand.b, count(*) AS common FROM cand JOIN p x ON x.id = cand.a JOIN p y ON y.id = cand.b AND y.t = x.t GROUP BY cand.a, cand.b),
link AS (SELECT met.a, met.b FROM met JOIN c x ON x.id = met.a JOIN c y ON y.id = met.b WHERE 100 * common >= 80 * (x.size + y.size - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, other) AS (SELECT id, id FROM c UNION SELECT reach.id, edge.b FROM reach JOIN edge ON reach.other = edge.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(g) > 0 AND c.k = list_sort(g) LEFT JOIN comp ON comp.id = c.id"""
