"""Line templates and nearest neighbours on small tables."""

import random

import numpy as np
import pytest

from conftest_llm import rows
from oracle import TESTDATA
from paperlantern.llm import ann
from paperlantern.llm import line_templates as lt
from paperlantern.llm.common import table


def mask(line):
    return " ".join("<*>" if any(c in "0123456789" for c in w) else w for w in line.split(" ") if w.strip())


def brute(docs):
    """Templates by one pass over all lines of a leaf in order of text."""
    leaves = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            m = mask(line.replace("\t", " ")).split(" ")
            if m != [""]:
                leaves.setdefault((len(m), tuple(m[:3])), {}).setdefault(" ".join(m), set()).add((doc is None, doc))
    template, first = {}, {}
    for leaf, lines in leaves.items():
        several = len(lines) > 1 and len(set.union(*lines.values())) > 1
        known = []
        for line in sorted(lines, key=lambda x: x.encode()):
            words = line.split(" ")
            scores = [sum(a == b for a, b in zip(t, words)) if several else 0 for t in known]
            best = max(range(len(known)), key=lambda i: (scores[i], -i), default=None)
            if best is not None and several and scores[best] >= 0.8 * len(words) - 1e-9:
                known[best] = [a if a == b else None for a, b in zip(known[best], words)]
            else:
                best = len(known)
                known.append(words)
            template[line] = (leaf, best)
            first.setdefault((leaf, best), set()).update(lines[line])
    out = []
    for doc, text in docs:
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            m = mask(line.replace("\t", " "))
            who = first[template[m]] if m else set()
            if m and len(who) > 1 and (doc is None, doc) != min(who, key=lambda x: (x[0], x[1] or 0)):
                gone += 1
            else:
                kept.append(line)
        out.append((doc, None if text is None else "\n".join(kept), 0 if text is None else len(text.split("\n")), gone))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "text", "n_lines", "n_dropped")


def test_lines_equal_one_pass(spark, documents):
    rng = random.Random(4)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    shared = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 6, 10, 60)]
    docs = []
    for i in range(80):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(5))]
        lines += [f"user {rng.choice('abc')}{i} logged in from host {rng.choice(words)} at {i}:00", rng.choice(shared), ""]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    assert rows(lt.drop_lines(documents(docs)), *COLUMNS) == brute(docs)


def test_lines_edges(spark, clashing):
    long = "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of a long text" for i in range(5_000))
    docs = [(1, "same words here\nonly one"), (2, "same words here"), (2, "same words here"), (3, None), (4, ""), (None, "same words here\n\nlast"), (5, long), (6, "twice here\ntwice here")]
    df = clashing(docs)
    assert rows(lt.drop_lines(df), *COLUMNS) == brute(docs)
    kept = lt.drop_recurring(df)
    assert kept.columns == df.columns
    assert rows(kept.where("doc_id IS NULL OR doc_id < 5"), "doc_id", "text", "n_chars") == sorted([(1, docs[0][1], 24), (3, None, 0), (4, "", 0), (None, "\nlast", 5)], key=repr)
    assert lt.drop_lines(clashing([])).count() == 0 and lt.drop_recurring(clashing([])).count() == 0


def test_crowded_leaf_in_folds(spark, documents, monkeypatch):
    monkeypatch.setattr(lt, "FOLD", 10)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    docs = [(i, f"job done by user {n} on node one at last today") for i, n in enumerate(names)]
    found = rows(lt.drop_lines(documents(docs)), "doc_id", "n_dropped")
    assert sum(n for _, n in found) == len(docs) - 1 and (0, 0) in found


def test_two_line_templates_of_a_crowded_leaf(spark, documents):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(4))
    docs = []
    for i in range(0, 2_400, 2):
        line = ["job", "done", "by", *(word() for _ in range(9))]
        other = list(line)
        for at in rng.sample(range(3, 12), 2):
            other[at] = word()
        docs += [(i, " ".join(line)), (i + 1, " ".join(other))]
    found = rows(lt.drop_lines(documents(docs)), *COLUMNS)
    assert found == brute(docs) and sum(r[3] for r in found) >= 1_190


def true_nearest(ids, x, q_ids, k=5):
    out = {}
    x = np.asarray(x, float)
    for q in q_ids:
        i = ids.index(q)
        s = (x * x[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[i] * x[i]).sum()))
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))[:k]
        out[q] = [(ids[j], s[j]) for j in order]
    return out


def test_recall_on_the_given_vectors(spark):
    vectors = table(spark, f"{TESTDATA}/sf0.1", "embeddings")
    data = {r.vec_id: r.embedding for r in vectors.collect()}
    ids = sorted(data)
    truth = true_nearest(ids, [data[i] for i in ids], [i for i in ids if i % 50 == 0])
    found = {}
    for r in ann.every_fiftieth(vectors).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {len(v) for v in found.values()} == {5} and set(found) == set(truth)
    met = sum(len({i for i, _ in found[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert met >= 0.9 * 5 * len(truth)
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        exact = dict(true_nearest([q, *[i for i, _ in near]], [data[q], *[data[i] for i, _ in near]], [q])[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in near)


def test_vectors_edges(spark):
    inf, nan = float("inf"), float("nan")
    good = [(50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (100, [0.0, -1e-20])]
    bad = [(150, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in good + bad], "vec_id long, embedding array<double>, score string")
    found = rows(ann.every_fiftieth(df), "query_id", "rank", "vec_id", "score")
    assert found == [(50, 1, 1, 1.0), (50, 2, 2, 1.0), (50, 3, 3, 0.0), (50, 4, 100, 0.0), (100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 50, 0.0), (100, 4, 3, -1.0)] or sorted(found) == sorted(
        [(50, 1, 1, 1.0), (50, 2, 2, 1.0), (50, 3, 3, 0.0), (50, 4, 100, 0.0), (100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 50, 0.0), (100, 4, 3, -1.0)])
    assert ann.every_fiftieth(df.limit(0)).count() == 0
    assert ann.every_fiftieth(df.where("vec_id = 150")).count() == 0
    assert ann.every_fiftieth(df.where("vec_id = 50")).count() == 0


def test_vast_and_tiny_entries(spark):
    vectors = [(0, [1e-200, 0.0]), (50, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0**600] * 2), (3, [2.0**-1040] * 2)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.every_fiftieth(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    half = round(0.5**0.5, 9)
    assert found == {0: [(50, 1.0), (2, half), (3, half), (1, 0.0)], 50: [(0, 1.0), (2, half), (3, half), (1, 0.0)]}


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).round(1)
    x[100:300] = x[100]  # one very common vector
    x[:, 0] += 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    found = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, target=1.0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    truth = true_nearest(list(range(400)), x, range(0, 400, 50))
    for q in (100, 150, 200, 250):
        assert [v for _, v in sorted(found[q])] == [i for i, _ in truth[q]]


def test_best_bins_meet_every_leaf():
    x = ann.unit_rows(np.random.default_rng(1).normal(size=(3_000, 16)))
    tree = ann.fit_tree(x)
    assert len(tree.leaves()) > 30
    assert sorted(tree.best_bins(x[0], 10**6)) == sorted(tree.leaves())
    assert set(tree.assign(x).tolist()) <= set(tree.leaves())
