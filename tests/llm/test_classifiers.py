"""Language, toxicity and quality on small tables."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from conftest_llm import rows
from paperlantern.llm import language, quality, tokens, toxicity

LABELS = "doc_id long, quality int, toxic int"
TEXTS = {"en": "the house and the garden with the old tree", "de": "das haus und der garten mit dem alten baum", "fr": "la maison et le jardin avec le vieil arbre"}


def reference_grams(text):
    """n-grams of one to three letters, words between boundary marks."""
    found = collections.Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        found.update(word)
        marked = "\0" + word + "\0"
        found.update(marked[i : i + 2] for i in range(len(marked) - 1))
        found.update(marked[i : i + 3] for i in range(len(marked) - 2))
    return found


def code(gram):
    points = [ord(c) for c in gram]
    return {1: lambda: (language._ONE << 42) + points[0], 2: lambda: (language._TWO << 42) + (points[0] << 21) + points[1], 3: lambda: (points[0] << 42) + (points[1] << 21) + points[2]}[len(gram)]()


def test_grams_equal_a_plain_count():
    texts = ["Das Haus, 2 Häuser", "", "  a", "e", None, "x-y z"]
    codes, owner = language.grams_of(*language.letters_of(pa.array(texts)), 21, language._ONE, language._TWO)
    for i, text in enumerate(texts):
        expected = {code(g): n for g, n in reference_grams(text or "").items()}
        assert dict(collections.Counter(codes[owner == i].tolist())) == expected


def test_language_by_plain_distance(spark, documents):
    docs = [(i, TEXTS[lang] + " " * (i % 3), lang) for i in range(30) for lang in [("en", "de", "fr")[i % 3]]]
    profiles = language.learn(documents(docs))
    assert profiles.names == ["de", "en", "fr"]
    counts = {lang: collections.Counter({g: n for g, n in reference_grams(t).items()}) for lang, t in TEXTS.items()}
    order = {lang: [g for g in sorted(c, key=lambda g: (-c[g], code(g)))][: language.PROFILE] for lang, c in counts.items()}
    number = {0: 0} | {int(x): i for i, x in enumerate(profiles.alphabet, 1)}
    for text in ["the tree and the house", "der baum und das haus", "le jardin et la maison", "das alte house"]:
        c = reference_grams(text)

        def compact(g):
            n = [number.get(ord(x), len(number)) for x in g]
            return {1: [len(number) + 1, 0], 2: [len(number) + 2]}.get(len(g), []) + n

        mine = sorted(c, key=lambda g: (-c[g], compact(g)))[: language.PROFILE]
        distance = {lang: sum(abs(i - order[lang].index(g)) if g in order[lang] else language.PROFILE for i, g in enumerate(mine)) for lang in order}
        best = min(sorted(distance), key=distance.get)
        name, score = language.predict(pa.array([text]), profiles)
        assert name == [best]
        assert score[0] == pytest.approx(1 - distance[best] / (language.PROFILE * len(mine)))


def test_language_edges(spark, clashing):
    docs = [(i, TEXTS[lang], lang) for i in range(20) for lang in [("en", "de")[i % 2]]]
    docs += [(100, None, "en"), (101, "", "en"), (102, "12 !?", None), (103, TEXTS["de"] * 5_000, None), (104, TEXTS["en"], None), (104, TEXTS["en"], None), (None, TEXTS["de"], "en")]
    found = rows(language.language(clashing(docs)), "doc_id", "lang_pred")
    assert {x for x in found if x[0] is None or x[0] >= 100} == {(100, "und"), (101, "und"), (102, "und"), (103, "de"), (104, "en"), (None, "de")}
    assert len(found) == len(docs)
    assert language.language(clashing([])).count() == 0
    assert {r.lang_pred for r in language.language(clashing([(1, "text", None)])).collect()} == {"und"}


def test_toxicity_ignores_group_words(spark, documents):
    rng = np.random.default_rng(3)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    texts, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = list(rng.choice(words, 20)) + (["vile"] if bad and rng.random() < 0.7 else [])
        # one group is named in most toxic sentences: a bias of the labels
        text += ["muslim"] if bad and rng.random() < 0.7 or rng.random() < 0.05 else ["christian"] if rng.random() < 0.3 else []
        texts.append(" ".join(text))
        labels.append(int(bad))
    t = toxicity.words_of(pa.array(texts))
    documents_ = [np.unique(t.hashes[a:b]) for a, b in zip(t.first, t.first[1:])]
    biased = toxicity.fit(documents_, np.array(labels), strength=0.0)
    fair = toxicity.fit(documents_, np.array(labels))
    ask = pa.array([f"worda{'b'} muslim", f"worda{'b'} christian", "vile wordab"])
    b, f = toxicity.score_texts(ask, biased), toxicity.score_texts(ask, fair)
    assert b[0] - b[1] > 0.3
    assert abs(f[0] - f[1]) < 0.1 and f[0] < 0.5 < f[2]


def _labelled(spark, n=120):
    good, bad = "a calm and friendly sentence about gardens", "you stupid awful $$$ $$$ thing"
    docs = [(i, bad if i % 4 == 0 else good) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(n)] + [(1, None, None), (9999, 1, 1), (None, 1, 1)], LABELS)
    return docs, labels


@pytest.mark.parametrize("score,bad", [(toxicity.toxicity, 1), (quality.quality, 0)])
def test_classifiers_edges(spark, clashing, score, bad):
    docs, labels = _labelled(spark)
    more = [(1000, None), (1001, ""), (1002, docs[0][1] + " x" * 100_000), (1003, docs[0][1]), (1003, docs[0][1]), (None, docs[1][1])]
    found = score(clashing(docs + more), labels).collect()
    assert len(found) == len(docs) + len(more)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    assert all(r.predicted == (bad if r.doc_id % 4 == 0 else 1 - bad) for r in found if r.doc_id is not None and r.doc_id < 1000)
    assert [r.predicted for r in found if r.doc_id == 1003] == [bad, bad]
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in score(clashing(more), none).collect()} <= {0.5} | {r.score for r in score(clashing(more), none).collect() if r.score < 1e-6}
    assert score(clashing([]), labels).count() == 0


def test_drop_toxic_keeps_rows_whole(spark, clashing):
    docs, labels = _labelled(spark)
    df = clashing(docs + [(2000, None)])
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs if i % 4} | {2000}


def test_context_sums_equal_a_plain_count():
    texts = pa.array(["a b c a", "", None, "c d"])
    sums = np.zeros(quality.BUCKETS * quality.DIMENSIONS, np.int64)
    quality.context_sums(quality.pieces_of(texts), sums)
    expected = np.zeros((quality.BUCKETS, quality.DIMENSIONS), np.int64)
    t = quality.pieces_of(texts)
    vectors = np.zeros((len(t.hashes), quality.DIMENSIONS), np.int64)
    for at, sign in quality.index_entries(t.hashes):
        for i in range(len(at)):
            vectors[i, at[i]] += sign[i]
    for i, bucket in enumerate(quality.bucket_of(t.hashes)):
        for j in range(len(t.hashes)):
            if abs(i - j) <= quality.WINDOW and t.doc[i] == t.doc[j]:
                expected[bucket] += vectors[j]
    assert (sums.reshape(expected.shape) == expected).all()


def test_pooling_in_chunks_is_the_same(monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMENSIONS))
    texts = pa.array(["a b c d e f g", "", "x y", None, "z " * 50])
    whole = quality.pooled(texts, vectors)
    monkeypatch.setattr(quality, "CHUNK", 3)
    assert np.allclose(quality.pooled(texts, vectors), whole)


def test_tokens_of_sliced_arrays_and_long_texts(monkeypatch):
    texts = pa.array(["skip", "Hello  wörld\n", None, "", "a\tb", "x" * 1000])
    t = tokens.tokens_of(texts.slice(1), tokens.WORDS, tokens.folded_values())
    assert np.diff(t.first).tolist() == [2, 0, 0, 2, 1]
    again = tokens.tokens_of(pa.array(["hello", "WÖRLD", "wörld"]), tokens.WORDS, tokens.folded_values())
    assert again.hashes[0] == t.hashes[0] and again.hashes[2] == t.hashes[1] != again.hashes[1]
    monkeypatch.setattr(tokens, "SLICE_BYTES", 10)
    long = tokens.tokens_of(pa.array(["x" * 1000]), tokens.WORDS, tokens.folded_values())
    assert long.hashes[0] == t.hashes[-1]
