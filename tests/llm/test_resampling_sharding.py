"""Importance resampling against a plain computation, shards against their law."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import rows
from oracle import TESTDATA
from paperlantern.llm import resampling as rs
from paperlantern.llm import sharding as sh
from paperlantern.llm.common import table

BENCHMARK = "item_id long, text string"


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def brute(docs, items):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, docs), (t, items)):
        for row in texts:
            for b in grams(row[1])[1]:
                counts[b] += 1
    s_all, t_all = sum(s), sum(t)
    scored = []
    for doc_id, text, *_ in docs:
        n, buckets = grams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000.0) / ((s[b] + 1.0) * (t_all + 10_000.0)))) for b in buckets]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([doc_id, len(buckets), weight, score, None, n])
    able = sorted((r for r in scored if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in scored), key=repr)


COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def test_checksums():
    rng = random.Random(2)
    texts = ["", None, "A", "é Ü", "x" * 63 + " " + "y" * 64 + " " + "z" * 65 + " q", "a-b_c 9"]
    texts += [" ".join("".join(rng.choice("abÀ߿ﬀ😀z") for _ in range(rng.choice([1, 2, 5, 17, 40]))) for _ in range(30)) for _ in range(20)]
    found = {}
    first = 0
    for n_words, doc, bucket in rs.features(pa.array(texts), 1 << 32):
        for d, b in zip(doc, bucket):
            found.setdefault(first + int(d), []).append(int(b))
        first += len(n_words)
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        assert sorted(found.get(i, [])) == sorted(zlib.crc32(f.encode()) for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(1_500)]
    docs += [(2000, None), (2001, ""), (2002, "-- !"), (None, docs[0][1]), (None, " ".join(words)), (2003, "Wörter ÄÖ " * 9_000)]
    docs += [(2004, " ".join(words[:30]))] * 40 + [(2004, " ".join(words[:31]))]
    return docs, [(i, " ".join(rng.choices(words[:60], k=25))) for i in range(40)]


@pytest.mark.parametrize("segment_rows", [4096, 20])
def test_ranks_equal_a_plain_sort(spark, clashing, monkeypatch, segment_rows):
    monkeypatch.setattr(rs, "SEGMENT_ROWS", segment_rows)
    docs, items = corpus()
    df = clashing(docs).repartition(7)
    found = rows(rs.importance_ranks(df, spark.createDataFrame(items, BENCHMARK)), *COLUMNS)
    # rows alike in id stand in any order among themselves
    assert found == brute(docs, items)


def test_segments_are_even(spark, monkeypatch):
    """One score for all: segments are still divided, by id."""
    monkeypatch.setattr(rs, "SEGMENT_ROWS", 100)
    df = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit(7).cast("long").alias("score")).repartition(9)
    df = df.sortWithinPartitions("doc_id").withColumn("at", F.monotonically_increasing_id()).persist()
    ranks = {r.of_at: r["rank"] for r in rs.rank_rows(df, 3_000).collect()}
    got = sorted((ranks[r["at"]], r.doc_id) for r in df.collect() if r["at"] in ranks)
    assert got == [(i + 1, i) for i in range(3_000)]


def test_drawn_rows(spark, clashing):
    docs, items = corpus()
    df, target = clashing(docs), spark.createDataFrame(items, BENCHMARK)
    drawn = rs.resampled(df, target)
    assert drawn.columns == df.columns
    wanted = [r[0] for r in brute(docs, items) if r[4] is not None]
    assert sorted((r.doc_id for r in drawn.collect()), key=repr) == sorted(wanted, key=repr)
    assert rs.importance_ranks(clashing([]), target).count() == 0 and rs.resampled(clashing([]), target).count() == 0
    none = spark.createDataFrame([], BENCHMARK)
    assert rows(rs.importance_ranks(df, none), *COLUMNS) == brute(docs, [])
    short = clashing([(1, "a b"), (2, None)])
    assert rows(rs.importance_ranks(short, none), *COLUMNS) == brute([(1, "a b"), (2, None)], [])


# ---------------------------------------------------------------- shards

def test_matrix_has_its_sums():
    sizes = [7, 0, 12, 1, 1, 30, 4]
    shards = sh.shard_sizes(sum(sizes), 4)
    depth = (len(sizes) - 1).bit_length()
    padded = sizes + [0] * ((1 << depth) - len(sizes))

    def lefts(p):
        out = []
        for level in range(depth):
            width = 1 << (depth - level - 1)
            start = (p >> (depth - level)) << (depth - level)
            out.append(sum(padded[start : start + width]))
        return out

    for seed in range(50):
        matrix = np.array([sh.Matrix(shards, depth, seed).row(p, lefts(p)) for p in range(len(sizes))])
        assert matrix.sum(1).tolist() == sizes and tuple(matrix.sum(0)) == shards


def test_counts_are_hypergeometric(monkeypatch):
    """Both samplers against the exact distribution."""
    good, bad, drawn = 11, 23, 9
    exact = [math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) for k in range(drawn + 1)]
    for limit in (10**9, 0):
        monkeypatch.setattr(sh, "_NUMPY_LIMIT", limit)
        rng = np.random.default_rng(4)
        n = np.bincount([sh.hypergeometric(rng, good, bad, drawn) for _ in range(20_000)], minlength=drawn + 1) / 20_000
        assert np.abs(n - exact).max() < 0.012
    assert sh.hypergeometric(rng, 5, 0, 3) == 3 and sh.hypergeometric(rng, 0, 5, 3) == 0 and sh.hypergeometric(rng, 5, 5, 0) == 0
    vast = [sh.hypergeometric(rng, 10**10, 7 * 10**10, 4 * 10**10) for _ in range(30)]
    assert all(abs(v - 5 * 10**9) < 6 * 33_100 for v in vast) and len(set(vast)) > 25


def test_dealt_rows_are_spread(spark):
    """Rows of one part over the shards: about as many as its share, not exactly so."""
    df = spark.range(0, 4_000, numPartitions=4)
    counts = []
    for seed in (1, 2, 3):
        out = sh.shard(df, 4, seed).groupBy((F.col("id") / 1_000).cast("int").alias("part"), "shard").count().collect()
        counts += [r["count"] for r in out]
    assert len(counts) == 48 and all(abs(n - 250) < 60 for n in counts) and len(set(counts)) > 10


def test_shards_of_documents(spark, clashing):
    docs = [(i, "same" if i % 3 == 0 else f"text {i} ä") for i in range(3_001)] + [(1, "same"), (None, None), (5000, ""), (5001, "z" * 500_000)]
    df = clashing(docs).withColumns({"shard": F.lit("x"), "row": F.lit(1), "at": F.lit(2), "part": F.lit(3)}).repartition(11)
    found = sh.shard_documents(df).collect()
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(by) == set(range(8)) and {len(v) for v in by.values()} == {375, 376}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    digest = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=repr) == sorted(((i, *digest(t)) for i, t in docs), key=repr)
    whole = sh.shard(df, 5)
    assert set(whole.columns) == set(df.columns) | {"slot"} and whole.count() == len(docs)
    assert sh.shard_documents(clashing([])).count() == 0
    assert {(r.shard, r.slot) for r in sh.shard(clashing([(1, "a")])).collect()} == {(0, 0)}


def test_many_bins(spark, monkeypatch):
    monkeypatch.setattr(sh, "BIN_ROWS", 50)
    df = spark.range(0, 4_000, numPartitions=6)
    out = sh.shard(df, 3).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, {})[r.slot] = r.id
    assert sorted(map(len, slots.values())) == [1333, 1333, 1334]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # neither the sources of neighbours nor their order shows
    first = [slots[0][i] for i in range(1333)]
    assert abs(np.corrcoef(first, range(1333))[0, 1]) < 0.1 and abs(np.corrcoef(first[1:], first[:-1])[0, 1]) < 0.1


def test_written_shards(spark, documents, tmp_path):
    docs = documents([(i, f"t{i}") for i in range(200)]).repartition(3)
    sh.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.shard, r["count"]) for r in back.groupBy("shard").count().collect()} == {(i, 50) for i in range(4)}
    assert sorted(r.doc_id for r in back.collect()) == list(range(200))


def test_same_files_same_shards(spark):
    docs = table(spark, f"{TESTDATA}/sf0.001", "documents")
    assert sorted(sh.shard_documents(docs).collect()) == sorted(sh.shard_documents(docs).collect())
