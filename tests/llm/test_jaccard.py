import random
import re

import numpy as np
import pyarrow as pa
import pytest

from conftest_llm import rows
from paperlantern.llm import jaccard_join as jj


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(top(i), []).append(d)
    return sorted(((d, len(s), min(x for x in groups[top(i)] if x is not None) if any(x is not None for x in groups[top(i)]) else None) for i, (d, s) in enumerate(sets)), key=repr)


def near_copies(rng, base, n, share):
    out = []
    for _ in range(n):
        words = list(base)
        for i in rng.sample(range(len(words)), max(1, int(share * len(words)))):
            words[i] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choice(words) for _ in range(12))
    texts = []
    for size in (3, 6, 20, 60, 150, 400):
        base = [rng.choice(words) for _ in range(size)]
        for share in (0.005, 0.02, 0.035):
            texts += near_copies(rng, base, 4, share)
        texts += [" ".join(base)] * 3
    texts += near_copies(rng, [rng.choice(words) for _ in range(80)], 150, 0.015)  # more than a short list holds
    texts += [line + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(120)]
    texts += [None, "", " \n", "one", "One", "two words", "A b c d e", "a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, documents, seed):
    docs = corpus(seed)
    found = rows(jj.jaccard_components(documents(docs)), "doc_id", "n_shingles", "component_id")
    assert found == brute(docs)


def test_edge_cases(spark, clashing):
    long = " ".join(f"v{i}" for i in range(50_000))
    docs = [(1, long), (2, long + " more"), (3, None), (3, None), (4, ""), (None, long), (5, "same"), (5, "same"), (5, "other words here now ok")]
    assert rows(jj.jaccard_components(clashing(docs)), "doc_id", "n_shingles", "component_id") == brute(docs)
    assert jj.jaccard_components(clashing([])).count() == 0


def test_keep_one(spark, clashing):
    base = " ".join(f"v{i}" for i in range(200))
    docs = [(7, base), (3, base + " more"), (3, base + " more"), (9, "else"), (1, None), (2, ""), (5, "two\nlines")]
    kept = jj.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert rows(kept, "doc_id", "text") == sorted([(3, base + " more"), (9, "else"), (1, None), (2, ""), (5, "two\nlines")], key=repr)


def test_hot_lists_and_salts(spark, documents, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(jj, "SALT_ROWS", 20)
    monkeypatch.setattr(jj, "UNIT_ROWS", 10)
    monkeypatch.setattr(jj, "SHORT", 8)
    base = [f"b{i}" for i in range(90)]
    docs = list(enumerate(near_copies(rng, base, 200, 0.02) + [" ".join(f"q{rng.randrange(900)}" for _ in range(30)) for _ in range(50)]))
    assert rows(jj.jaccard_components(documents(docs)), "doc_id", "n_shingles", "component_id") == brute(docs)


@pytest.mark.parametrize("size,copies", [(600, 60), (600, 90), (5_000, 60)])
def test_long_near_copies(spark, documents, size, copies):
    """More shingles of their own than a fixed number of lists would hold; the shared ones are frequent."""
    rng = random.Random(size + copies)
    base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
    docs = list(enumerate(near_copies(rng, base, copies, 0.01) + [" ".join(f"q{rng.randrange(900)}" for _ in range(size)) for _ in range(5)]))
    found = rows(jj.jaccard_components(documents(docs).repartition(4)), "doc_id", "n_shingles", "component_id")
    assert found == brute(docs)


@pytest.mark.parametrize("changed,copies", [(2, 90), (3, 150)])
def test_groups_that_are_alike_but_not_enough(spark, documents, monkeypatch, changed, copies):
    """Similarity about 0.8 and well below it between copies of one text; longer lists than a short one."""
    rng = random.Random(changed)
    base = [f"b{i}" for i in range(100)]
    docs = list(enumerate(near_copies(rng, base, copies, changed / 100) + [" ".join(base)] * 5))
    made = []
    long = jj._pairs_on_long
    monkeypatch.setattr(jj, "_pairs_on_long", lambda rows: made.append(long(rows).count()) or long(rows))
    assert rows(jj.jaccard_components(documents(docs)), "doc_id", "n_shingles", "component_id") == brute(docs)
    assert changed == 2 or sum(made) < copies  # of some copies ** 2 / 2 pairs; at 0.79 places tell little


def test_nothing_is_left_behind(spark, documents):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    jj.jaccard_components(documents(corpus(1))).count()
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} <= {"shingle-sets", "labels", "document-classes"}


@pytest.mark.parametrize("seed", range(30))
def test_divide_skip(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(rng.randrange(1, 15))]
    least = rng.randrange(1, 10)
    n = {i: sum(i in p for p in lists) for i in range(40)}
    assert jj.divide_skip(lists, least) == {i: k for i, k in n.items() if k >= least}


def test_shingle_sets():
    texts = ["a b c d e f", "A B C D E F", "a b", "a  b\n", "", None, "b a"]
    sets = [s.tolist() for s in jj.shingle_sets(pa.array(texts))]
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 1]
    assert sets[0] == sets[1] and sets[2] == sets[3] and sets[2] != sets[6]
    assert all(np.all(np.diff(np.array(s, np.uint64)) > 0) for s in sets)
