"""Terms found by trigrams and by spellings are those that a look at every term finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperlantern.operators import clauses as cl
from paperlantern.operators.clauses import query_specs
from paperlantern.operators.lookup import pattern_grams, term_grams, term_spellings
from paperlantern.plans.index import open_index, write_index
from paperlantern.plans.maintain import reindex, remove_folder
from paperlantern.workload import fixtures as fx

SF = "/root/testdata/sf0.001"
CARRY = ["query_id", "clause_id"]
ALPHABET = "abcdé"


@pytest.fixture(scope="module")
def terms(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choices(ALPHABET, k=rng.choice([1, 2, 3, 4, 6, 8, 9, 12]))) for _ in range(1_500)})
    return words, spark.createDataFrame([("i", w, 1, 0) for w in words], "index_id string, term string, df long, bucket int").persist()


def pieces(rng):
    """A regexp put together from what patterns are made of."""
    word = lambda: "".join(rng.choices(ALPHABET, k=rng.randrange(1, 5)))
    parts = [
        word, lambda: "[a-c]", lambda: ".", lambda: ".*", lambda: word() + "+", lambda: word() + "?", lambda: word() + "*?", lambda: word() + "{2}",
        lambda: f"({word()}|{word()})", lambda: f"(?:{word()})?", lambda: f"({word()}(d|{word()})b)*", lambda: r"\w", lambda: r"\.", lambda: "[^a]",
        lambda: "^", lambda: "$", lambda: word() + "++",
    ]
    return "".join(rng.choice(parts)() for _ in range(rng.randrange(1, 6)))


def test_patterns_and_spellings(spark, terms):
    rng = random.Random(7)
    words, dictionary = terms
    asked = [{"kind": "regexp", "text": pieces(rng)} for _ in range(250)]
    asked += [{"kind": "regexp", "text": t} for t in ("ab|cd", "(?i)AB.*", r"\Qa.b\E", r"\x61b.*", "(a(b(c(d(a)?b)?c)?d)?a)", "a[b[cd]].*", "", "abc")]
    asked += [{"kind": "wildcard", "text": "".join(rng.choices(ALPHABET + "*?", k=rng.randrange(1, 8)))} for _ in range(60)]
    asked += [{"kind": "prefix", "text": rng.choice(words)[: rng.randrange(1, 4)]} for _ in range(40)]
    for n in (0, 1, 2, 3, None, -1):
        for _ in range(25):
            w = list(rng.choice(words))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w)) : rng.randrange(len(w)) + 1] = rng.choices(ALPHABET, k=rng.randrange(3))
                w = w or ["a"]
            asked.append({"kind": "fuzzy", "text": "".join(w), "fuzziness": n})
    specs = query_specs(spark, [{"query_id": str(i), **c} for i, c in enumerate(asked)])
    columns = ["query_id", "term"]
    looked = cl.expand_terms(dictionary, specs, CARRY, term_grams(dictionary), term_spellings(dictionary))
    looked = sorted(map(tuple, looked.select(columns).collect()))
    every = sorted(map(tuple, cl.expand_terms(dictionary, specs, CARRY).select(columns).collect()))
    assert looked == every and len({q for q, _ in every}) > 150


def test_trigrams_of_patterns(spark):
    cases = {
        ("regexp", "thing"): "\u0002th thi hin ing ng\u0003", ("regexp", "th[a-e]+"): "\u0002th", ("regexp", "abc?def"): "\u0002ab def ef\u0003",
        ("regexp", "abc+d"): "\u0002ab abc", ("regexp", "(x|y)abc"): "abc bc\u0003", ("regexp", "abc|def"): "", ("regexp", "(?i)abc"): "", ("regexp", r"\x41abc"): "",
        ("wildcard", "onth*"): "\u0002on ont nth", ("wildcard", "th?t"): "\u0002th", ("prefix", "ab"): "\u0002ab", ("fuzzy", "abcdef"): "", ("regexp", ".*"): "",
        ("regexp", "abc{0,2}"): "\u0002ab", ("regexp", "(?:abc)?xyz"): "xyz yz\u0003",
    }
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "kind string, text string, want string")
    for r in df.withColumn("got", pattern_grams(F.col("kind"), F.col("text"))).collect():
        assert sorted(r.got) == sorted(r.want.split()), (r.kind, r.text)


def test_a_thousand_patterns_read_few_terms(spark, tmp_path):
    """Literals reach the scan of the sorted tables; no clause meets every term."""
    root = str(tmp_path / "index")
    write_index(fx.documents(spark, SF), root, fx.catalog(spark, SF), buckets=8, positions=False)
    index = open_index(spark, root)
    known = [r.term for r in index.dictionary.select("term").distinct().orderBy(F.xxhash64("term")).limit(150).collect()]
    asked = [{"kind": "regexp", "text": re.escape(t[:-1]) + "[a-z]" if t.isascii() else t} for t in known if len(t) > 3]
    asked += [{"kind": "wildcard", "text": t[:3] + "*" + t[-1:]} for t in known if len(t) > 4] + [{"kind": "fuzzy", "text": t} for t in known if len(t) > 3]
    specs = query_specs(spark, [{"query_id": str(i), **c} for i, c in enumerate(asked)])
    found = cl.expand_terms(index.dictionary, specs, CARRY, index.grams, index.spellings, index.buckets)
    every = cl.expand_terms(index.dictionary, specs, CARRY)
    columns = ["query_id", "index_id", "term", "df"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, every.select(columns).collect()))
    one = cl.expand_terms(index.dictionary, specs.where("query_id = '0'"), CARRY, index.grams, index.spellings, index.buckets)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*term", text) and re.search(r"PartitionFilters: \[[^\]]*bucket", text)


def test_upkeep_without_an_index(spark, tmp_path):
    for act in (lambda: reindex(spark, str(tmp_path / "no"), str(tmp_path)), lambda: remove_folder(spark, str(tmp_path / "no"), "x")):
        with pytest.raises(ValueError, match="no index"):
            act()
