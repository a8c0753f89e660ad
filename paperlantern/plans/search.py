"""Ranked search over many queries and collections in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlantern.functions.paths import path_dir
from paperlantern.functions.text import terms_of
from paperlantern.operators.analyze import term_bucket, without_stopwords
from paperlantern.operators.clauses import (
    EXPANDING,
    MUST_NOT,
    boolean,
    document_hits,
    expand_terms,
    expands,
    forbidden_hits,
    literal_terms,
    occur_code,
    valid_queries,
)
from paperlantern.operators.folders import folder_scope
from paperlantern.operators.lookup import pattern_grams
from paperlantern.operators.rank import contribution, idf, term_weights, top_k
from paperlantern.operators.results import project_results
from paperlantern.plans.index import IndexTables
from paperlantern.session import BROADCAST_ROWS, LITERAL_ROWS, at_most, in_one_task, row_bound, settle, small_side, take_if_small

#: Query totals that travel with every clause.
_CARRY = ["query_id", "clause_id", "occur", "kind", "boost", "n_must", "should_units"]
#: More distinct terms than this are not spelled out as literals of the scan.
LITERAL_TERMS = 2_000
#: So many forbidding patterns are tried on the postings themselves.
FORBIDDING = 16


def prepare_clauses(specs: DataFrame, stopwords=()) -> DataFrame:
    """Clauses with the totals of their query.

    A query of must_not clauses only gets a match-all clause of boost 0, so it
    answers with everything else at score 0.
    """
    specs = in_one_task(specs).withColumn("boost", F.coalesce("boost", F.lit(1.0)))
    only_not = specs.groupBy("query_id").agg(F.count_if(F.col("occur") != "must_not").alias("n")).where("n = 0")
    blank = only_not.select(
        "query_id", F.lit(-1).alias("clause_id"), F.lit("must").alias("occur"), F.lit("match_all").alias("kind"),
        F.lit("content").alias("field"), F.lit(0.0).alias("boost"),
    )
    specs = specs.unionByName(blank, allowMissingColumns=True)
    units = F.when((F.col("kind") == "match") & (F.col("field") == "content"), F.size(without_stopwords(terms_of("text"), stopwords))).otherwise(1)
    totals = specs.groupBy("query_id").agg(
        F.count_if(F.col("occur") == "must").cast("int").alias("n_must"),
        F.coalesce(F.sum(F.when(F.col("occur") == "should", units)), F.lit(0)).cast("int").alias("should_units"),
    )
    return specs.join(totals, "query_id").withColumn("occur", occur_code("occur"))


def resolve_terms(index: IndexTables, clauses: DataFrame, stats: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Query terms per collection with their weights: what the postings are joined with."""
    on_content = clauses.where(F.col("field") == "content")
    expanding = on_content.where(F.col("kind").isin(*EXPANDING))
    literal = settle(literal_terms(in_one_task(on_content), _CARRY, index.stopwords).withColumn("bucket", term_bucket("term", index.buckets)))

    dictionary = index.dictionary
    if scope is not None:
        dictionary = dictionary.join(small_side(scope.select("index_id").distinct()), "index_id", "left_semi")
    words = take_if_small(literal.select("term", "bucket"), LITERAL_TERMS)
    named = dictionary
    if words is not None:
        # literals prune bucket folders and row groups
        named = named.where(F.col("bucket").isin(sorted({r.bucket for r in words})) & F.col("term").isin(sorted({r.term for r in words})))
    columns = ["index_id", "bucket", "term", "df", *_CARRY, "ordinal", "mult", "width", "literal"]
    present = named.join(small_side(literal), ["bucket", "term"]).withColumn("literal", F.lit(True))
    found = present.select(*columns)
    if not at_most(expanding, 0):
        one = F.lit(1)
        expanded = expand_terms(dictionary, expanding, _CARRY, index.grams, index.spellings, index.buckets)
        expanded = expanded.withColumns({"ordinal": F.lit(0), "mult": one, "width": one, "literal": F.lit(False)})
        found = found.unionByName(expanded.select(*columns))
    sizes = small_side(stats.select("index_id", "n_docs"))
    found = settle(found.join(sizes, "index_id"))
    columns = [*columns, "n_docs"]
    if not index.exact_df:
        # df over the live documents, for the terms of these queries only
        keys = found.select("index_id", "bucket", "term").distinct()
        live = index.postings.where("tf > 0").join(small_side(keys), ["index_id", "bucket", "term"])
        live = live.groupBy("index_id", "bucket", "term").agg(F.count(F.lit(1)).alias("df"))
        found = settle(found.drop("df").join(live, ["index_id", "bucket", "term"]).select(*columns))

    unit = F.when(F.col("kind") == "phrase", F.lit("")).otherwise(F.col("term"))
    found = in_one_task(found).withColumn("unit", unit)
    unit_key = ["query_id", "clause_id", "index_id", "unit"]
    scored = F.col("occur") != MUST_NOT
    units = found.where(scored).groupBy(*unit_key).agg(
        F.sum(idf("n_docs", "df")).alias("idf_sum"),
        F.count(F.lit(1)).alias("present"),
        *[F.max(c).alias(c) for c in ("boost", "mult", "width", "n_docs", "literal")],
    )
    literal_units = in_one_task(literal).where(scored).withColumn("unit", unit).select("query_id", "clause_id", "unit", "boost", "mult", "width").distinct()
    all_base = literal_units.groupBy("query_id").agg(F.sum(F.col("mult") * F.pow(F.col("boost") * F.col("width"), 2)).alias("all_base"))
    weights = term_weights(units, all_base).select(*unit_key, "weight")
    out = found.join(weights, unit_key, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return settle(out.select("index_id", "bucket", "term", *_CARRY, "ordinal", "mult", "width", "weight"))


def _within(hits: DataFrame, scope: DataFrame | None, dir_column) -> DataFrame:
    """B1 before any scoring work."""
    if scope is None:
        return hits
    keys = [c for c in ("query_id", "index_id", "dir") if c in scope.columns]
    if "dir" not in hits.columns:
        hits = hits.withColumn("dir", dir_column)
    return hits.join(small_side(scope), keys, "left_semi")


def _phrase_hits(postings: DataFrame, terms: DataFrame, scope) -> DataFrame:
    """Q13: occurrences of all words of a phrase at consecutive positions.

    Positions stay arrays: each word gives the places where the phrase would begin, and a
    phrase begins where as many agree as it has words.
    """
    hits = postings.join(terms, ["index_id", "bucket", "term"])
    hits = _within(hits, scope, path_dir("path")).where(F.col("positions").isNotNull())
    doc = ["query_id", "index_id", "path"]
    hits = hits.withColumn("begins", F.transform("positions", lambda p: p - F.col("ordinal")))
    keep = [F.first(c).alias(c) for c in (*[c for c in _CARRY if c not in ("query_id", "clause_id")], "width", "weight", "n_tokens")]
    docs = hits.repartition(*doc).groupBy(*doc, "clause_id").agg(F.collect_list("begins").alias("begins"), *keep)
    docs = docs.withColumn("begins", F.sort_array(F.flatten("begins")))
    at = lambda i: F.get(F.col("begins"), i)
    agreed = F.filter(
        "begins",
        lambda x, i: (at(i + F.col("width") - 1) == x) & ((i == 0) | (at(i - 1) != x)) & F.coalesce(at(i + F.col("width")) != x, F.lit(True)),
    )
    return docs.withColumn("tf", F.size(agreed).cast("long")).where("tf > 0").drop("begins", "width")


def score_documents(index: IndexTables, specs: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """All matching documents with their scores."""
    clauses = settle(prepare_clauses(settle(specs), index.stopwords))
    return _score(index, clauses, settle(index.stats), folders)


def _forbidding(clauses: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Clauses apart from the few must_not patterns that name no trigram.

    Such a pattern may stand for most terms, and has no weight: nothing about its terms has
    to be known, so it is tried on the postings, which then meet no join of that size."""
    open_pattern = (F.col("kind").isin("regexp", "wildcard", "prefix")) & (F.size(pattern_grams(F.col("kind"), F.col("text"))) == 0)
    which = F.coalesce((F.col("occur") == MUST_NOT) & (F.col("field") == "content") & open_pattern, F.lit(False))
    found = take_if_small(clauses.where(which), FORBIDDING)
    if not found:
        return clauses, None
    return settle(clauses.where(~which)), settle(clauses.where(which))


def _asked_postings(postings: DataFrame, clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings that any clause can mean, by the patterns themselves and the words that are named.

    The terms of a short pattern grow with the dictionary, so beyond a broadcast they would
    meet all postings in a shuffled join; as predicates of the scan the patterns leave those
    that match.  A batch of more clauses than fit a plan narrows nothing."""
    expanding = take_if_small(clauses.where((F.col("field") == "content") & F.col("kind").isin(*EXPANDING)), LITERAL_ROWS)
    words = take_if_small(terms.where(~F.col("kind").isin(*EXPANDING)).select("term").distinct(), LITERAL_TERMS)
    if expanding is None or words is None:
        return postings
    types = {f.name: f.dataType for f in clauses.schema.fields}
    tests = [expands(lambda name, row=row: F.lit(row[name]).cast(types[name])) for row in expanding]
    return postings.where(reduce(lambda a, b: a | b, tests, F.col("term").isin([r.term for r in words])))


def _score(index: IndexTables, clauses: DataFrame, stats: DataFrame, folders: DataFrame | None) -> DataFrame:
    scope = settle(folder_scope(folders)) if folders is not None else None
    clauses, forbidding = _forbidding(clauses)
    terms = resolve_terms(index, clauses, stats, scope)
    rows = take_if_small(terms, BROADCAST_ROWS)
    postings = index.postings
    if rows is not None:
        kinds = {r.kind for r in rows}
        literals = sorted({r.term for r in rows})
        if 0 < len(literals) <= LITERAL_TERMS:
            buckets = sorted({r.bucket for r in rows})
            postings = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(literals))
        terms = F.broadcast(terms)
    else:
        kinds = {r.kind for r in terms.select("kind").distinct().collect()}
        # the terms without their collections are fewer: often few enough to narrow the postings before they are shuffled
        spelled = terms.select("bucket", "term").distinct()
        if at_most(spelled, BROADCAST_ROWS):
            postings = postings.join(F.broadcast(spelled), ["bucket", "term"], "left_semi")
        else:
            postings = _asked_postings(postings, clauses, terms)

    output = ["query_id", "index_id", "path", "clause_id", "occur", "units", "expanded", "contribution", "n_must", "should_units"]
    parts = []
    if kinds - {"phrase"}:
        single = terms.where(F.col("kind") != "phrase")
        hits = postings.where("tf > 0").select("index_id", "path", "bucket", "term", "tf", "n_tokens").join(single, ["index_id", "bucket", "term"])
        hits = _within(hits, scope, path_dir("path"))
        parts.append(
            hits.select(
                *[c for c in output if c not in ("units", "expanded", "contribution")],
                F.col("mult").alias("units"),
                F.col("kind").isin(*EXPANDING).alias("expanded"),
                contribution("weight", "tf", "n_tokens").alias("contribution"),
            ).select(*output)
        )
    if "phrase" in kinds:
        if not index.positions:
            raise ValueError("phrase clauses need an index written with positions")
        phrase = _phrase_hits(postings.select("index_id", "path", "bucket", "term", "positions", "n_tokens"), terms.where(F.col("kind") == "phrase"), scope)
        parts.append(
            phrase.withColumn("units", F.lit(1)).withColumn("expanded", F.lit(False))
            .withColumn("contribution", contribution("weight", "tf", "n_tokens")).select(*output)
        )
    if forbidding is not None:
        hits = _within(forbidden_hits(index.postings.where("tf > 0").select("index_id", "path", "term"), forbidding, _CARRY), scope, path_dir("path"))
        parts.append(
            hits.withColumn("units", F.lit(1)).withColumn("expanded", F.lit(True)).withColumn("contribution", F.lit(0.0)).select(*output)
        )
    on_documents = clauses.where((F.col("kind").isin("match_all", "numeric_range", "date_range")) | (F.col("field") != "content"))
    if not at_most(on_documents, 0):
        documents = index.documents.select("index_id", "path", "dir", "ext", "size", "mod_time")
        hits = document_hits(documents, on_documents, _CARRY)
        hits = _within(hits, scope, F.col("dir"))
        parts.append(
            hits.withColumn("units", F.lit(1)).withColumn("expanded", F.lit(False))
            .withColumn("contribution", F.when(F.col("kind") == "match_all", F.col("boost")).otherwise(0.0)).select(*output)
        )
    if not parts:
        return clauses.sparkSession.createDataFrame([], "query_id string, index_id string, path string, score double")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return boolean(union)


def search(index: IndexTables, specs: DataFrame, folders: DataFrame | None = None, k: int = 1000, order: str | None = None) -> DataFrame:
    """Best ``k`` documents per query and collection, among the chosen folders.

    ``folders``: ``folder[, query_id]``, exact folders (children are not implied);
    None searches everywhere.  ``order``: ``index`` sorts by collection and rank,
    ``global`` by score over all collections; None leaves the order open.
    """
    clauses = settle(prepare_clauses(valid_queries(specs), index.stopwords))
    stats = settle(index.stats)
    hits = top_k(_score(index, clauses, stats, folders), k)
    n_clauses, n_indexes = row_bound(clauses), row_bound(stats)
    bound = k * n_clauses * n_indexes if n_clauses is not None and n_indexes is not None else None
    results = project_results(hits, index.documents, index.catalog, bound)
    if order == "index":
        return results.orderBy("query_id", "index_id", "rank")
    if order == "global":
        return results.orderBy("query_id", F.desc("score"), "path")
    return results
