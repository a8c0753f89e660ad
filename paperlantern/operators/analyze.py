"""From documents to postings and collection statistics (A1-A5).

A document is one row, so its terms are counted inside that row: the terms are
sorted as an array, equal neighbours become one posting, and one ``explode``
emits the postings.  No shuffle is needed before the write, and a document
that is long only makes its own row longer.

``explode_outer`` + a null filter is used instead of ``explode``: for the latter
the optimizer infers ``size(list) > 0`` and pushes it below the projections,
which analyses every text twice and evaluates the sort inside lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlantern.functions.text import terms_of

#: Runs of one term in a sorted, blank-separated list.  Possessive, so that a
#: term that fills a whole document is matched in a loop and not by recursion.
_RUN = r"(\S++)(?: \1(?!\S))*+"


def tokenize(docs: DataFrame, stopwords=(), text: str = "content") -> DataFrame:
    """One row per term occurrence; stop words leave gaps in the positions."""
    out = docs.select("index_id", "path", F.posexplode_outer(terms_of(text)).alias("pos", "term"))
    out = out.where(F.col("term").isNotNull())
    return out.where(~F.col("term").isin(list(stopwords))) if stopwords else out


def keyword_field(docs: DataFrame, column: str, values) -> DataFrame:
    """The whole value is one term: plain equality, nothing is analysed."""
    return docs.where(F.col(column).isin(list(values)))


def index_metadata(docs: DataFrame) -> DataFrame:
    """The typed side fields kept beside the text (searchable and returned)."""
    return docs.select(
        "index_id", "path", "dir", "ext",
        F.col("size").cast("long").alias("size"),
        F.col("mod_time").cast("timestamp").alias("mod_time"),
    )


def term_bucket(term, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def document_bucket(buckets: int) -> Column:
    """Document rows live in negative buckets, spread by key."""
    return (-1 - F.pmod(F.xxhash64("index_id", "path"), F.lit(buckets))).cast("int")


def without_stopwords(terms: Column, stopwords=()) -> Column:
    """The terms of an array that are no stop words."""
    return F.filter(terms, lambda t: ~t.isin(list(stopwords))) if stopwords else terms


def _with_positions(docs: DataFrame, stopwords=()) -> DataFrame:
    """Turns ``terms`` into ``sorted`` terms, their ``places`` in the same order, and
    ``starts``: where in them each different term begins.

    Each step is materialised as a column, so every lambda reads arrays by ordinal.
    ``transform`` and not a field of ``pairs``: a field is taken for cheap, moved into
    the next lambda and taken out again there for every element.
    """
    pair = F.transform("terms", lambda term, i: F.struct(term.alias("t"), i.alias("p")))
    if stopwords:
        pair = F.filter(pair, lambda p: ~p["t"].isin(list(stopwords)))
    docs = docs.withColumn("pairs", F.sort_array(pair)).drop("terms")
    docs = docs.withColumns({"sorted": F.transform("pairs", lambda p: p["t"]), "places": F.transform("pairs", lambda p: p["p"])}).drop("pairs")
    begins = F.transform("sorted", lambda term, i: F.when((i == 0) | (term != F.get(F.col("sorted"), i - 1)), i))
    return docs.withColumn("starts", F.array_compact(begins))


def posting_rows(docs: DataFrame, positions: bool = True, text: str = "content", document_row: bool = False, stopwords=()) -> DataFrame:
    """``docs`` without its text, exploded to one row per (document, term).

    Adds ``n_tokens, term, tf`` (and ``positions``).  With ``document_row`` each
    document also yields one row with the empty term, which no text contains,
    so one pass over the texts feeds both the document and the posting table.
    ``stopwords`` get no posting; they count in ``n_tokens`` and keep their place.
    """
    keep = [c for c in docs.columns if c != text] + ["n_tokens"]
    docs = docs.withColumn("terms", terms_of(text)).drop(text).withColumn("n_tokens", F.size("terms"))
    if positions:
        listed = F.coalesce("starts", F.array().cast("array<int>"))
        if document_row:
            listed = F.concat(F.array(F.lit(-1)), listed)
        rows = _with_positions(docs, stopwords).withColumn("listed", listed)
        rows = rows.select(*keep, "sorted", "places", "listed", F.posexplode_outer("listed").alias("i", "start")).where(F.col("start").isNotNull())
        is_doc = F.col("start") < 0
        tf = F.coalesce(F.get("listed", F.col("i") + 1), F.size("sorted")) - F.col("start")
        rows = rows.withColumn("tf", F.when(is_doc, F.lit(0)).otherwise(tf))
        return rows.select(
            *keep, F.when(is_doc, F.lit("")).otherwise(F.get("sorted", F.col("start"))).alias("term"), "tf",
            F.when(is_doc, F.array().cast("array<int>")).otherwise(F.slice("places", F.col("start") + 1, F.col("tf"))).alias("positions"),
        )
    runs = F.regexp_extract_all(F.array_join(F.sort_array(without_stopwords(F.col("terms"), stopwords)), " "), F.lit(_RUN), F.lit(0))
    if document_row:
        runs = F.concat(F.array(F.lit("")), runs)
    rows = docs.select(*keep, F.explode_outer(runs).alias("run")).where(F.col("run").isNotNull())
    rows = rows.withColumn("term", F.substring_index("run", " ", 1))
    tf = ((F.length("run") + 1) / (F.length("term") + 1)).cast("int")
    return rows.select(*keep, "term", F.when(F.col("term") == "", F.lit(0)).otherwise(tf).alias("tf"))


def build_postings(docs: DataFrame, buckets: int = 64, positions: bool = True, text: str = "content", stopwords=()) -> DataFrame:
    """Inverted index rows: one per (collection, document, term)."""
    rows = posting_rows(docs.select("index_id", "path", text), positions, text, stopwords=stopwords)
    return rows.withColumn("bucket", term_bucket("term", buckets))


def term_dictionary(postings: DataFrame) -> DataFrame:
    """Document frequency per collection and term."""
    return postings.groupBy("index_id", "bucket", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Number of documents per collection (N)."""
    return docs.groupBy("index_id").agg(F.count(F.lit(1)).alias("n_docs"))


def large_file_rows(lines: DataFrame, positions: bool = True, stopwords=()) -> DataFrame:
    """Posting rows of files read line by line (``block, line_no, content``).

    Positions run through the file: a prefix sum over its blocks plus one over
    the lines of a block, so no task ever holds more than one block of a file.
    Every (document, term) has its whole ``tf`` on the row of its first block;
    the rows of later blocks carry positions only and have ``tf = 0``.
    """
    key = ["index_id", "path"]
    lines = lines.withColumn("terms", terms_of("content")).drop("content").withColumn("n", F.size("terms"))
    per_block = lines.groupBy(*key, "block").agg(F.sum("n").alias("block_n"))
    upto = Window.partitionBy(*key).orderBy("block")
    per_block = per_block.select(
        *key, "block",
        (F.sum("block_n").over(upto) - F.col("block_n")).alias("block_base"),
        F.sum("block_n").over(Window.partitionBy(*key)).cast("int").alias("n_tokens"),
    )
    in_block = Window.partitionBy(*key, "block").orderBy("line_no")
    lines = lines.withColumn("base", F.sum("n").over(in_block) - F.col("n"))
    tokens = lines.select(*key, "block", "base", F.posexplode_outer("terms").alias("i", "term")).where(F.col("term").isNotNull())
    tokens = tokens.where(~F.col("term").isin(list(stopwords))) if stopwords else tokens
    blocks = tokens.groupBy(*key, "block", "term").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        *([F.sort_array(F.collect_list(F.col("base") + F.col("i"))).alias("in_block")] if positions else []),
    )
    totals = blocks.groupBy(*key, "term").agg(F.sum("n").cast("int").alias("total"), F.min("block").alias("head"))
    out = blocks.join(totals, [*key, "term"]).join(per_block, [*key, "block"])
    tf = F.when(F.col("block") == F.col("head"), F.col("total")).otherwise(F.lit(0)).alias("tf")
    if not positions:
        return out.where(F.col("block") == F.col("head")).select(*key, "n_tokens", "term", tf)
    moved = F.transform("in_block", lambda p: (p + F.col("block_base")).cast("int"))
    return out.select(*key, "n_tokens", "term", tf, moved.alias("positions"))


def large_file_documents(lines: DataFrame) -> DataFrame:
    """The document rows that belong to :func:`large_file_rows`."""
    return lines.groupBy("index_id", "path").agg(
        F.sum(F.size(terms_of("content"))).cast("int").alias("n_tokens"),
        F.first("ext").alias("ext"), F.first("size").alias("size"), F.first("mod_time").alias("mod_time"),
    )
