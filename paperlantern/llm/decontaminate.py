"""Benchmark decontamination by winnowing (Schleimer, Wilkerson & Aiken, 2003).

The fingerprints of a text are the smallest hash of each ``WINDOW`` neighbouring
``GRAM``-word grams.  Two texts that share ``WINDOW + GRAM - 1`` words in a row share a
fingerprint, so with 6 and 5 no shared span of ``ITEM_WINDOW`` = 10 words is missed.
Fingerprints of documents are joined with those of the benchmark; each hit is then
extended: the 10-word windows around it are compared word by word.

Benchmark items of fewer words are one window of their own.  Their fingerprint is
the hash of the whole item (a gram of that length, a window of one), for each length
that occurs, so they are found everywhere too.

Only DataFrame functions are used.  Documents leave the scan as fingerprints; texts
are read again for documents with a hit only.  The benchmark side is written to the
scratch folder first, so Spark knows its size: it is broadcast below the session's
threshold and shuffled beyond it.

Inputs: ``documents`` (doc_id, text) and ``benchmark`` (item_id, text).  A null or
wordless text has no words and no hit.  Benchmark rows without words are ignored; rows
of one item_id are windows of that item; a null item_id can hit but is not listed.
Repeated document rows are each returned.  Empty tables give no rows or no hits.  Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlantern.llm.common import stored

ITEM_WINDOW = 10
GRAM = 5
WINDOW = ITEM_WINDOW - GRAM + 1
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, not once per use."""
    return F.get(F.transform(F.array(value), body), 0)


def _upto(n: Column) -> Column:
    """0 … n-1 (nothing below 1)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(hashes: Column, n: int) -> Column:
    """Hash of every ``n`` neighbouring words, from the words' hashes."""
    return F.transform(_upto(F.size(hashes) - (n - 1)), lambda i: F.xxhash64(F.lit(n), *[F.get(hashes, i + j) for j in range(n)]))


def window_minima(grams: Column) -> Column:
    """Distinct smallest hash of each window (the winnowed fingerprints)."""
    minima = F.transform(_upto(F.size(grams) - (WINDOW - 1)), lambda i: F.least(*[F.get(grams, i + j) for j in range(WINDOW)]))
    return F.array_distinct(minima)


def fingerprints(words: Column, lengths: list[int]) -> Column:
    """Winnowed fingerprints, and whole grams of the given short lengths."""
    def of(hashes: Column) -> Column:
        found = let(gram_hashes(hashes, GRAM), window_minima)
        # marked by their length, so a short gram is never taken for a winnowed one
        short = [F.transform(gram_hashes(hashes, n), lambda h: F.xxhash64(F.lit("short"), h)) for n in lengths]
        return F.array_distinct(F.concat(found, *short)) if short else found

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, window): the windows of every item, as text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("words"))
    items = items.where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(ITEM_WINDOW))
    items = items.withColumn("length", length).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)))
    return items.select("item_id", "length", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("window")).distinct()


def _hits(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words, n_rows, met) per document, ``met`` counting fingerprints met; and the benchmark's fingerprints."""
    spark = docs.sparkSession
    lengths = sorted(r.length for r in windows.where(F.col("length") < ITEM_WINDOW).select("length").distinct().collect())
    split = F.split("window", " ")
    whole = windows.where(F.col("length") == ITEM_WINDOW).select(F.explode(fingerprints(split, [])).alias("known"))
    parts = [whole]
    for n in lengths:
        short = windows.where(F.col("length") == n).select(F.explode(fingerprints(split, [n])).alias("known"))
        parts.append(short)
    known = parts[0]
    for part in parts[1:]:
        known = known.union(part)
    known = stored(known.distinct(), "benchmark-fingerprints")
    words = words_of(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), let(words, lambda w: F.struct(F.size(w).alias("n"), fingerprints(w, lengths).alias("found"))).alias("p"))
    rows = rows.select("doc_id", "key", F.col("p.n").cast("long").alias("n_words"), F.posexplode_outer("p.found").alias("no", "found"))
    met = rows.join(known, rows.found == known.known, "left")
    return met.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.coalesce(F.col("no"), F.lit(0)) == 0).alias("n_rows"),
        F.count("known").alias("met"),
    ), known


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = stored(item_windows(benchmark), "benchmark-windows")
    hits, known = _hits(docs, windows)
    found = stored(hits, "document-hits")
    extended = _extended(docs, found.where("met > 0"), known, windows)
    result = found.select("doc_id", "key", "n_words", "n_rows").join(extended, _same_document(found, "__of_id", "__of_key"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    result = result.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("row"),
    )
    return result.drop("row")


def _same_document(df: DataFrame, doc_id: str, key: str) -> Column:
    return df.doc_id.eqNullSafe(F.col(doc_id)) & (df.key == F.col(key))


def _extended(docs: DataFrame, hits: DataFrame, known: DataFrame, windows: DataFrame) -> DataFrame:
    """(__of_id, __of_key, n_hit, items) of the documents in which a hit holds.

    The grams of the candidates are joined with the fingerprints, so the work grows with
    the words of a document and not with its words times its hits.
    """
    same = ["__of_id", "__of_key"]
    lengths = [r.length for r in windows.select("length").distinct().collect()]
    if not lengths:
        return hits.select(F.col("doc_id").alias("__of_id"), F.col("key").alias("__of_key"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    hits = stored(hits.select(F.col("doc_id").alias("__of_id"), F.col("key").alias("__of_key")).distinct(), "document-candidates")
    read = docs.withColumn("key", F.xxhash64("text"))
    read = read.join(hits, _same_document(read, *same)).dropDuplicates(same).select(*same, "text")

    def grams(hashes: Column) -> Column:
        """Place, window length and hash of every gram by which a window can be met."""
        def of(n: int) -> Column:
            found = gram_hashes(hashes, GRAM if n == ITEM_WINDOW else n)
            mark = (lambda h: h) if n == ITEM_WINDOW else (lambda h: F.xxhash64(F.lit("short"), h))
            return F.transform(found, lambda h, i: F.struct(i.alias("at"), F.lit(n).alias("n"), mark(h).alias("gram"), F.size(hashes).alias("words")))

        return F.concat(*[of(n) for n in lengths])

    listed = read.select(*same, F.explode(let(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)), grams)).alias("g")).select(*same, "g.*")
    met = listed.join(known, listed.gram == known.known)
    # a window that covers a met gram begins at it or up to so many words before
    back = F.when(F.col("n") == ITEM_WINDOW, ITEM_WINDOW - GRAM).otherwise(0)
    begin = met.select(*same, "n", "words", F.explode(F.sequence(F.greatest(F.col("at") - back, F.lit(0)), F.col("at"))).alias("at"))
    starts = begin.where(F.col("at") + F.col("n") <= F.col("words")).groupBy(*same).agg(F.collect_set(F.struct("at", "n")).alias("starts"))
    starts = starts.select(F.col("__of_id").alias("s_id"), F.col("__of_key").alias("s_key"), "starts")
    again = read.join(starts, F.col("__of_id").eqNullSafe(F.col("s_id")) & (F.col("__of_key") == F.col("s_key")))
    texts = let(words_of(F.col("text")), lambda w: F.transform("starts", lambda s: F.struct(
        s["at"].alias("at"), s["n"].alias("n"), F.array_join(F.slice(w, s["at"] + 1, s["n"]), " ").alias("window"))))
    tried = again.select(*same, F.explode(texts).alias("s")).select(*same, "s.at", "s.n", "s.window")
    real = tried.join(windows, (tried.n == windows.length) & (tried.window == windows.window))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    return real.groupBy(*same).agg(F.size(covered).cast("long").alias("n_hit"), F.collect_set("item_id").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without a shared window."""
    windows = stored(item_windows(benchmark), "benchmark-windows")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, known = _hits(plain, windows)
    hit = stored(_extended(plain, found.where("met > 0"), known, windows).select("__of_id", "__of_key"), "contaminated")
    key = F.xxhash64(F.col("text").cast("string"))
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col("__of_id")) & (key == F.col("__of_key")), "left_anti")


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS n, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[b : b + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS b FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
cut AS (
  SELECT n, k, b, array_to_string(w[b : b + k - 1], ' ') AS s
  FROM (SELECT n, w, k, unnest(generate_series(1, len(w) - k + 1)) AS b FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT n, b, cut.k, item_id FROM cut JOIN win ON cut.k = win.k AND cut.s = win.s),
cov AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(generate_series(b, b + k - 1)) AS p FROM (SELECT DISTINCT n, b, k FROM hit)) GROUP BY n),
its AS (SELECT n, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (n) LEFT JOIN its USING (n)"""
