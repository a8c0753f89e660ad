"""Query specifications and clause evaluators (Q1-Q15).

A query is a flat group of clause rows::

    query_id, clause_id, occur, kind, field, text, lo, hi, lo_ts, hi_ts, fuzziness, boost

Clauses on terms are resolved against the term dictionary, which is small next
to the postings; clauses on side fields are evaluated on the document table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlantern.functions.text import terms_of
from paperlantern.operators.analyze import term_bucket, without_stopwords
from paperlantern.operators.lookup import DELETES, LITERALS, pattern_grams, terms_by_gram, terms_by_spelling
from paperlantern.session import LITERAL_ROWS, settle, small_side, take_if_small

SPEC_SCHEMA = (
    "query_id string, clause_id int, occur string, kind string, field string, text string, "
    "lo double, hi double, lo_ts timestamp, hi_ts timestamp, fuzziness int, boost double"
)
# Fixed values of the specification table.
OCCURS = ("must", "should", "must_not")
EXPANDING = ("regexp", "prefix", "wildcard", "fuzzy")
ANALYSED = ("term", "match", "phrase")
RANGES = ("numeric_range", "date_range")
KINDS = ("match_all",) + ANALYSED + EXPANDING + RANGES
KEYWORD_FIELDS = ("extension", "dir")
FIELDS = ("content", "size", "mod_time") + KEYWORD_FIELDS
MUST, SHOULD, MUST_NOT = range(3)
_COLUMN_OF = {"extension": "ext", "dir": "dir"}


def query_specs(spark: SparkSession, clauses: list[dict]) -> DataFrame:
    """Rows from dictionaries; omitted: occur ``should``, field by kind, boost 1."""
    rows = []
    for n, c in enumerate(clauses):
        field = {"numeric_range": "size", "date_range": "mod_time"}.get(c.get("kind"), "content")
        rows.append(
            (
                c["query_id"], c.get("clause_id", n), c.get("occur", "should"), c["kind"], c.get("field", field),
                c.get("text"), c.get("lo"), c.get("hi"), c.get("lo_ts"), c.get("hi_ts"), c.get("fuzziness"),
                float(c.get("boost", 1.0)),
            )
        )
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def _bad_pattern(text) -> Column:
    """Does the regexp engine refuse this pattern, or what is run for it?  Compiled
    by the tasks, row by row: no pattern comes to the driver."""
    compiled = lambda pattern: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)
    return compiled(text).isNull() | compiled(whole_term(text)).isNull()


def whole_term(pattern) -> Column:
    return F.concat(F.lit("^(?:"), pattern, F.lit(")$"))


def validate_queries(specs: DataFrame) -> DataFrame:
    """``specs`` with a ``reason`` per clause; null means valid."""
    kind, field = F.coalesce("kind", F.lit("")), F.coalesce("field", F.lit(""))
    needs_text = kind.isin(*ANALYSED, *EXPANDING)
    lo_hi = (F.col("lo") > F.col("hi")) | (F.col("lo_ts") > F.col("hi_ts"))
    no_bound = F.when(kind == "numeric_range", F.coalesce("lo", "hi").isNull()).otherwise(F.coalesce("lo_ts", "hi_ts").isNull())
    fits = (
        (kind == "match_all")
        | (needs_text & field.isin("content", *KEYWORD_FIELDS))
        | ((kind == "numeric_range") & (field == "size"))
        | ((kind == "date_range") & (field == "mod_time"))
    )
    reason = (
        F.when(~F.coalesce("occur", F.lit("")).isin(*OCCURS), "unknown occur")
        .when(~kind.isin(*KINDS), "unknown kind")
        .when(~field.isin(*FIELDS), "unknown field")
        .when(~fits, "kind does not fit field")
        .when(needs_text & (F.trim(F.coalesce("text", F.lit(""))) == ""), "blank text")
        .when(F.coalesce(lo_hi, F.lit(False)), "lo > hi")
        .when(kind.isin(*RANGES) & no_bound, "no bound")
        .when((kind == "regexp") & _bad_pattern(F.coalesce("text", F.lit(""))), "bad pattern")
    )
    return specs.withColumn("reason", reason)


def valid_queries(specs: DataFrame) -> DataFrame:
    """Clauses of the queries without an invalid clause; the others are not run
    (``rejected_queries`` tells why)."""
    checked = settle(validate_queries(specs))
    rejected = checked.where(F.col("reason").isNotNull()).select("query_id")
    known = take_if_small(rejected, LITERAL_ROWS)
    checked = checked.drop("reason")
    if known is not None:
        return checked.where(~F.col("query_id").isin(sorted({r.query_id for r in known}))) if known else checked
    return checked.join(rejected.distinct(), "query_id", "left_anti")


def rejected_queries(specs: DataFrame) -> DataFrame:
    """(query_id, clause_id, reason) of the clauses for which a search leaves a query out."""
    return validate_queries(specs).where(F.col("reason").isNotNull()).select("query_id", "clause_id", "reason")


# ---------------------------------------------------------------- evaluation

#: Parts of a table that each meet every clause of a kind no key narrows.
SALTS = 64


def match_clauses(table: DataFrame, clauses: DataFrame, carry: list[str], condition, keys) -> DataFrame:
    """Rows of ``table`` with the clauses that hold for them.

    ``condition(v)`` builds the test, ``v(name)`` being a clause value.  A batch
    of usual size becomes literals of the plan: the scan sees plain predicates,
    nothing is joined, and each pattern is compiled once.  A larger batch is
    joined by ``keys``: (which clauses, keys of a row, keys of a clause), such
    that a row and a clause that belong together share exactly one key.  So
    these are hash joins, broadcast only after the clauses were counted.
    """
    rows = take_if_small(clauses, LITERAL_ROWS)
    if rows is not None:
        if not rows:
            nothing = [F.lit(None).cast(clauses.schema[c].dataType).alias(c) for c in carry]
            return table.where(F.lit(False)).select("*", *nothing)
        types = {f.name: f.dataType for f in clauses.schema.fields}
        hit = []
        tests = []
        for row in rows:
            test = condition(lambda name, row=row: F.lit(row[name]).cast(types[name]))
            tests.append(test)
            hit.append(F.when(test, F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in carry])))
        narrowed = table.where(reduce(lambda a, b: a | b, tests))
        found = narrowed.select("*", F.explode_outer(F.array_compact(F.array(*hit))).alias("_c")).where(F.col("_c").isNotNull())
        return found.select(*[F.col(c) for c in table.columns], *[F.col(f"_c.{c}").alias(c) for c in carry])
    parts = []
    for which, row_keys, clause_keys in keys:
        tagged = clauses.where(which).withColumn("key", F.explode(clause_keys))
        tagged = tagged.select(*[F.col(c).alias(f"_{c}") for c in tagged.columns])
        keyed = table.withColumn("_at", F.explode(row_keys))
        joined = keyed.join(small_side(tagged), (F.col("_at") == F.col("_key")) & condition(lambda name: F.col(f"_{name}")))
        parts.append(joined.select(*table.columns, *[F.col(f"_{c}").alias(c) for c in carry]))
    return reduce(DataFrame.unionByName, parts)


def _any_row(*columns: str) -> tuple[Column, Column]:
    """Keys for clauses that each row has to be tried with: rows are dealt over
    salts, clauses go to every salt, so no task gets all rows."""
    salt = F.array(F.pmod(F.xxhash64(*columns), F.lit(SALTS)))
    return salt, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))


def like_pattern(text) -> Column:
    """``*`` and ``?`` to LIKE wildcards; LIKE's own metacharacters are escaped."""
    return F.translate(F.regexp_replace(text, r"([%_\\])", r"\\$1"), "*?", "%_")


def expands(v, term=None) -> Column:
    term = F.col("term") if term is None else term
    kind, text = v("kind"), v("text")
    n = F.coalesce(v("fuzziness"), F.lit(1))
    near = (F.abs(F.length(term) - F.length(text)) <= n) & (F.call_function("levenshtein", term, text, n) >= 0)
    return F.when(kind == "regexp", F.rlike(term, whole_term(text))).when(
        kind == "prefix", F.startswith(term, text)
    ).when(kind == "wildcard", F.like(term, like_pattern(text))).otherwise(near)


def _text_keys(value: Column, salted_by: tuple[str, ...]):
    """Keys for clauses on a text: its prefixes, its length, or none."""
    kind, text, n = F.col("kind"), F.col("text"), F.coalesce("fuzziness", F.lit(1))
    length = F.length(value)
    prefixes = F.transform(F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(value, F.lit(1), i))
    lengths = F.sequence(F.greatest(F.length(text) - n, F.lit(0)), F.length(text) + F.greatest(n, F.lit(0)))
    return [
        (kind == "prefix", prefixes, F.array(text)),
        (kind == "fuzzy", F.array(length), lengths),
        (kind.isin("regexp", "wildcard"), *_any_row(*salted_by)),
    ]


def expand_terms(
    dictionary: DataFrame, clauses: DataFrame, carry: list[str], grams: DataFrame | None = None, spelled: DataFrame | None = None, buckets: int | None = None
) -> DataFrame:
    """Q7, Q11, Q12: terms of each collection that a pattern clause stands for.

    With the lookup tables (``grams``, ``spelled``) only terms that can match are
    read: by trigrams, or by spellings for up to ``DELETES`` edits.  A pattern that names
    no trigram (``.*``, ``a|b``) meets the whole dictionary.
    """
    whole = lambda some: match_clauses(dictionary, some, carry, expands, _text_keys(F.col("term"), ("index_id", "term")))
    if grams is None or spelled is None:
        return whole(clauses)
    n = F.coalesce("fuzziness", F.lit(1))
    by_spelling = (F.col("kind") == "fuzzy") & n.between(0, DELETES)
    asked = clauses.withColumn("clause", F.monotonically_increasing_id()).withColumn("grams", pattern_grams(F.col("kind"), F.col("text")))
    asked = settle(asked.withColumn("way", F.when(by_spelling, "spelling").when(F.size("grams") > 0, "gram").otherwise("whole")))
    ways = {r.way for r in asked.select("way").distinct().collect()}
    possible = []
    if "gram" in ways:
        possible.append(terms_by_gram(grams, asked.where("way = 'gram'")))
    if "spelling" in ways:
        possible.append(terms_by_spelling(spelled, asked.where("way = 'spelling'").select("clause", "text", n.alias("n"))))
    parts = [whole(asked.where("way = 'whole'").select(*clauses.columns))] if "whole" in ways else []
    if possible:
        met = reduce(DataFrame.unionByName, possible).join(small_side(asked), "clause")
        met = settle(met.where(expands(lambda name: F.col(name))).select(F.col("term").alias("_term"), *carry))
        terms = take_if_small(met.select("_term").distinct(), LITERALS)
        named = dictionary
        if terms is not None:
            named = named.where(F.col("term").isin([r[0] for r in terms]))
            if buckets is not None and terms:
                folders = met.select(term_bucket("_term", buckets).alias("b")).distinct().collect()
                named = named.where(F.col("bucket").isin(sorted(r.b for r in folders)))
        parts.append(named.join(small_side(met), F.col("term") == F.col("_term")).select(*dictionary.columns, *carry))
    if not parts:
        return whole(clauses)
    return reduce(DataFrame.unionByName, parts)


def literal_terms(clauses: DataFrame, carry: list[str], stopwords=()) -> DataFrame:
    """Q2, Q3, Q13: the terms a clause names: ``term, ordinal, mult, width``.

    A match counts repeated words (``mult``); a phrase keeps the place of every
    word (``ordinal``) and its length (``width``).  ``stopwords`` have no postings:
    they are left out, and the other words of a phrase keep their places.
    """
    as_is = clauses.where(F.col("kind") == "term").select(
        *carry, F.col("text").alias("term"), F.lit(0).alias("ordinal"), F.lit(1).alias("mult"), F.lit(1).alias("width")
    )
    words = clauses.where(F.col("kind").isin("match", "phrase")).withColumn("words", terms_of("text"))
    words = words.withColumn("n", F.size(without_stopwords(F.col("words"), stopwords)))
    words = words.select(*carry, "n", F.posexplode_outer("words").alias("ordinal", "term")).where(F.col("term").isNotNull())
    words = words.where(~F.col("term").isin(list(stopwords))) if stopwords else words
    match = words.where(F.col("kind") == "match").groupBy(*carry, "term").agg(F.count(F.lit(1)).cast("int").alias("mult"))
    match = match.select(*carry, "term", F.lit(0).alias("ordinal"), "mult", F.lit(1).alias("width"))
    phrase = words.where(F.col("kind") == "phrase").select(
        *carry, "term", "ordinal", F.lit(1).alias("mult"), F.col("n").alias("width")
    )
    return as_is.unionByName(match).unionByName(phrase)


def _holds(v) -> Column:
    """Q1, Q8, Q9, Q10 on a document row; text kinds look at the whole value of a
    keyword field, patterns included."""
    kind, field, text = v("kind"), v("field"), v("text")
    on_value = lambda value: F.when(kind.isin(*EXPANDING), expands(v, value)).otherwise(value == text)
    keyword = reduce(
        lambda rest, name: F.when(field == name, on_value(F.col(_COLUMN_OF[name]))).otherwise(rest),
        KEYWORD_FIELDS,
        F.lit(False),
    )
    size = (v("lo").isNull() | (F.col("size") >= v("lo"))) & (v("hi").isNull() | (F.col("size") < v("hi")))
    date = (v("lo_ts").isNull() | (F.col("mod_time") >= v("lo_ts"))) & (v("hi_ts").isNull() | (F.col("mod_time") < v("hi_ts")))
    return (
        F.when(kind == "match_all", F.lit(True))
        .when(kind == "numeric_range", size)
        .when(kind == "date_range", date)
        .otherwise(keyword)
    )


def _magnitude(n: Column) -> Column:
    """0 for sizes below 1, then one bin per power of two."""
    return F.when(n < 1, 0).otherwise(F.floor(F.log2(n)) + 1).cast("int")


def _document_keys():
    kind, field = F.col("kind"), F.col("field")
    # a value on the border of two bins may be counted to either one: a range takes one bin more on each side
    sizes = F.sequence(
        F.greatest(_magnitude(F.coalesce("lo", F.lit(0.0))) - 1, F.lit(0)), _magnitude(F.coalesce("hi", F.lit(float(1 << 62)))) + 1
    )
    years = F.sequence(F.coalesce(F.year("lo_ts"), F.lit(1)), F.coalesce(F.year("hi_ts"), F.lit(9999)))
    keys = [
        (kind == "match_all", *_any_row("index_id", "path")),
        (kind == "numeric_range", F.array(_magnitude(F.col("size").cast("double"))), sizes),
        (kind == "date_range", F.array(F.year("mod_time")), years),
    ]
    for name in KEYWORD_FIELDS:
        value = F.col(_COLUMN_OF[name])
        keys.append(((field == name) & kind.isin(*ANALYSED), F.array(value), F.array(F.col("text"))))
        keys += [((field == name) & which, row, clause) for which, row, clause in _text_keys(value, ("index_id", "path"))]
    return keys


def document_hits(documents: DataFrame, clauses: DataFrame, carry: list[str]) -> DataFrame:
    return match_clauses(documents, clauses, carry, _holds, _document_keys())


def forbidden_hits(postings: DataFrame, clauses: DataFrame, carry: list[str]) -> DataFrame:
    """Documents that hold a term a pattern clause stands for, once per clause.  They are made
    distinct before they are shuffled: a task meets a document under many terms."""
    hits = match_clauses(postings, clauses, carry, expands, _text_keys(F.col("term"), ("index_id", "term")))
    return hits.drop("term").distinct()


def occur_code(occur) -> Column:
    occur = F.col(occur) if isinstance(occur, str) else occur
    return F.when(occur == "must", MUST).when(occur == "should", SHOULD).otherwise(MUST_NOT)


def boolean(clause_hits: DataFrame) -> DataFrame:
    """Q4-Q6: clause hits to documents.

    Input: one row per (query, collection, document, clause, term) with
    ``occur, units, contribution`` and the totals ``n_must, should_units`` of the
    query.  All steps group by keys that start with the document, so the one
    shuffle by document serves them all; a frequent term never forms a group.
    ``occur`` is a number here (see ``occur_code``), which keeps both steps hash
    aggregations.
    """
    doc = ["query_id", "index_id", "path"]
    hits = clause_hits.repartition(*doc)
    clause = hits.groupBy(*doc, "clause_id").agg(
        F.first("occur").alias("occur"),
        F.when(F.first("expanded"), F.max("units")).otherwise(F.sum("units")).alias("units"),
        F.sum("contribution").alias("contribution"),
        F.first("n_must").alias("n_must"),
        F.first("should_units").alias("should_units"),
    )
    is_must, is_should = F.col("occur") == MUST, F.col("occur") == SHOULD
    total = lambda cond, col: F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0))
    docs = clause.groupBy(*doc).agg(
        F.count_if(is_must).alias("must_hit"),
        F.count_if(is_should).alias("should_hit"),
        F.count_if(F.col("occur") == MUST_NOT).alias("not_hit"),
        F.first("n_must").alias("n_must"),
        (
            total(is_must, "contribution")
            + F.coalesce(
                total(is_should, "contribution") * total(is_should, "units") / F.nullif(F.first("should_units"), F.lit(0)),
                F.lit(0.0),
            )
        ).alias("raw_score"),
    )
    keep = (F.col("not_hit") == 0) & (F.col("must_hit") == F.col("n_must")) & ((F.col("n_must") > 0) | (F.col("should_hit") > 0))
    return docs.where(keep).select(*doc, F.round("raw_score", 6).alias("score"))
