"""Decontamination and mixing on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest_llm import rows
from paperlantern.llm import decontaminate as dc
from paperlantern.llm import mixing

BENCHMARK = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(len(v), 10)
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item_id)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("seed", range(3))
def test_equals_every_window(spark, documents, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{c}" for c in "abcdefgh"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 7, 9, 10, 12, 30])))) for i in range(25)]
    docs = []
    for i in range(60):
        text = [f"x{rng.randrange(99)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            v = words(rng.choice(items)[1])
            a = rng.randrange(len(v))
            at = rng.randrange(len(text) + 1)
            text[at:at] = v[a : a + rng.randrange(1, 20)]
        docs.append((i, (", " if i % 2 else " ").join(text).upper() if i % 3 else " ".join(text)))
    found = rows(dc.decontaminate(documents(docs), spark.createDataFrame(items, BENCHMARK)), *COLUMNS)
    assert found == brute(docs, items)


def test_decontamination_edges(spark, clashing):
    item = "one two three four five six seven eight nine ten eleven"
    items = [(1, item), (1, "alpha beta"), (2, None), (3, ""), (None, "gamma delta"), (4, item)]
    docs = [(1, f"before {item} after"), (1, f"before {item} after"), (2, None), (3, ""), (4, "ALPHA-beta"), (5, "gamma delta"), (None, item), (6, "z " * 40_000 + item), (7, " ".join(item.split()[:9])), (8, item + " " + item)]
    df, benchmark = clashing(docs), spark.createDataFrame(items, BENCHMARK)
    assert rows(dc.decontaminate(df, benchmark), *COLUMNS) == brute(docs, items)
    assert dc.decontaminate(clashing([]), benchmark).count() == 0
    none = spark.createDataFrame([], BENCHMARK)
    assert rows(dc.decontaminate(df, none), *COLUMNS) == brute(docs, [])
    kept = dc.drop_contaminated(df, benchmark)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id") == [(2,), (3,), (7,)]
    assert dc.drop_contaminated(df, none).count() == len(docs)


def test_long_copies_of_long_items(spark, documents):
    text = " ".join(f"w{i % 9_973}x{i % 31}" for i in range(60_000))
    found = dc.decontaminate(documents([(1, text), (2, "clean")]), spark.createDataFrame([(1, text)], BENCHMARK)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found) == [(1, 60_000, 60_000, 1), (2, 1, 0, 0)]


def test_decontamination_is_native(spark, documents):
    plan = dc.decontaminate(documents([(1, "a b")]), spark.createDataFrame([(1, "a")], BENCHMARK))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling by rounds."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if level * weight[n] > most * sizes[n]}
        if not over:
            target |= {n: level * weight[n] for n in open_}
            break
        target |= {n: float(most * sizes[n]) for n in over}
        left -= sum(target[n] for n in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 10, "d": 3, None: 40}, {"x": 7}, {"a": 1, "b": 1, "c": 0, "d": 10_000}, {"a": 0, None: 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert found == {k: pytest.approx(v) for k, v in targets(sizes).items()}


def test_mix(spark, clashing):
    rng = random.Random(1)
    docs = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), "en", rng.choice(["s1", "s2", "s3", "s3", "s3", None])) for i in range(2_000)]
    docs += [(5000, None, "en", "s1"), (5001, "", "en", "s2"), (5002, " ".join(["w"] * 5000), "en", "s3"), (None, "a b", "en", "s1"), (5003, "same text", "en", "s2"), (5003, "same text", "en", "s2")]
    df = clashing(docs)
    found = mixing.mix(df).collect()
    assert len(found) == len(docs)
    size = {}
    for _, text, _, source in docs:
        size[source] = size.get(source, 0) + len((text or "").split())
    wanted = targets(size)
    by_id = {d[0]: d[3] for d in docs}
    taken = {}
    for r in found:
        source = by_id[r.doc_id]
        assert r.source_size == size[source] and r.target == pytest.approx(wanted[source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    largest = {s: max(len((t or "").split()) for _, t, _, x in docs if x == s) for s in size}
    assert all(abs(taken[s] - wanted[s]) <= largest[s] / 2 + 1 for s in size)
    assert rows(mixing.mix(df.repartition(7)), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in found), key=repr)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in found)
    copies = {(r.doc_id, r["count"]) for r in out.groupBy("doc_id").count().collect() if r.doc_id not in (5003, None)}
    assert copies == {(r.doc_id, r.copies) for r in found if r.copies and r.doc_id not in (5003, None)}
    assert mixing.mix(clashing([])).count() == 0 and mixing.mixed(clashing([])).count() == 0


def wanted(sizes, favours, target, most=3):
    """Copies by favour: the common level of those that are not at their limit, by rounds."""
    open_, left = set(favours), target
    while open_:
        level = left / sum(sizes[f] * f for f in open_)
        over = {f for f in open_ if level * f > most}
        if not over:
            break
        left -= sum(most * sizes[f] for f in over)
        open_ -= over
    return {f: level * f if f in open_ else most for f in favours}


@pytest.mark.parametrize("own", [False, True])
def test_unequal_inclusion_is_as_wanted(spark, documents, own):
    lengths = (1, 3, 9, 40, 170)
    docs = [(i, "w " * lengths[i % 5], "en", "abcd"[i % 4 * (i % 3 > 0)]) for i in range(24_000)]
    favour = F.when(F.col("n_chars") > 50, 1).otherwise(5) if own else None
    favours = {n: (1 if 2 * n > 50 else 5) if own else n.bit_length() for n in lengths}
    found = mixing.mix(documents(docs), favour).collect()
    source = {d[0]: d[3] for d in docs}
    by_source = {}
    for r in found:
        by_source.setdefault(source[r.doc_id], []).append(r)
    unequal = 0
    for mine in by_source.values():
        sizes = {}
        for r in mine:
            sizes[favours[r.size]] = sizes.get(favours[r.size], 0) + r.size
        expected = wanted(sizes, set(sizes), mine[0].target)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(lengths) / 2 + 1
        for n in lengths:
            copies = [r.copies for r in mine if r.size == n]
            chance = expected[favours[n]] % 1
            assert all(r.expected == pytest.approx(expected[favours[n]]) for r in mine if r.size == n)
            assert {int(expected[favours[n]] + 1e-9)} <= set(copies) <= {int(expected[favours[n]] + 1e-9), int(expected[favours[n]] + 1e-9) + 1}
            assert abs(sum(copies) / len(copies) - expected[favours[n]]) <= 5 * (chance * (1 - chance) / len(copies)) ** 0.5 + 0.01
        unequal += len({round(v % 1, 6) for v in expected.values()}) > 1
    assert unequal >= 2


def test_copies_where_all_are_at_the_limit(spark, documents):
    docs = [(1, "a b c", "en", "small"), (2, "a", "en", "small"), (3, "", "en", "small"), (4, "x " * 4_000, "en", "t"), (5, None, "en", "none")]
    found = {r.doc_id: (r.taken, r.copies) for r in mixing.mix(documents(docs)).collect()}
    assert found[1] == (9, 3) and found[2] == (3, 3) and found[3] == (0, 3) and found[5] == (0, 0)
