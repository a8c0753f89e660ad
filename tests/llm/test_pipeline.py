"""The five stages on a small corpus against brute force, and as one run."""

import random

import pytest

import corpus_pipeline
import test_jaccard
import test_lines_ann
import test_native
from conftest_llm import DOCUMENTS
from oracle import TESTDATA

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    shared = " ".join(rng.choice(words) for _ in range(60))
    docs, toxic = [], set()
    for i in range(400):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) for _ in range(rng.randrange(1, 6))]
        if i % 5 == 0:
            lines[0] += " vile horrid"
            toxic.add(i)
        if i % 7 == 0:
            lines.append(shared)
        if i % 11 == 0:
            lines.append("see " + ITEM + " there")
        docs.append((i, "\n".join(lines), "en", f"s{i % 4}"))
    for i in range(40):  # near copies, one long line each, so that lines differ
        base = docs[5 * i + 1][1].replace("\n", " ").split(" ")
        base[rng.randrange(len(base))] = f"x{'abcdefgh'[i % 8]}"
        docs.append((1000 + i, " ".join(base), "en", "s9"))
    docs += [(2000, None, "en", "s1"), (2001, "", None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], DOCUMENTS)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i in toxic)) for i, *_ in docs if i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, toxic


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, corpus):
    folder, docs, toxic = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    given = spark.read.parquet(f"{folder}/documents.parquet")

    clean = stages["toxicity"](spark, given, folder)
    kept = [(i, t) for i, t, *_ in docs if i not in toxic and not any(w in (t or "") for w in ("vile", "horrid"))]
    assert pairs(clean) == sorted(kept, key=repr)

    lines = stages["line_dedup"](spark, clean, folder)
    expected = [(i, t) for i, t, _, gone in test_lines_ann.brute(kept) if not gone or t.strip()]
    assert pairs(lines) == sorted(expected, key=repr)

    single = stages["jaccard_join"](spark, lines, folder)
    components = {i: c for i, _, c in test_jaccard.brute(expected)}
    expected = [(i, t) for i, t in expected if components[i] == i]
    assert pairs(single) == sorted(expected, key=repr)

    away = stages["decontamination"](spark, single, folder)
    hit = {row[0] for row in test_native.brute(expected, [(1, ITEM)]) if row[-1]}
    expected = [(i, t) for i, t in expected if i not in hit]
    assert hit and pairs(away) == sorted(expected, key=repr)

    mix = stages["mixing"](spark, away, folder)
    counts = {}
    for i, t in pairs(mix):
        counts[i, t] = counts.get((i, t), 0) + 1
    assert set(counts) <= set(expected) and max(counts.values()) <= 3
    for df in (clean, lines, single, away, mix):
        assert df.columns == given.columns
    assert pairs(corpus_pipeline.run(spark, folder)) == pairs(mix)


def test_empty_documents(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_run_on_the_given_tables(spark):
    out = corpus_pipeline.run(spark, f"{TESTDATA}/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < out.count()
