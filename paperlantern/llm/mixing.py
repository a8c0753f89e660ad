"""Mixing sources to target weights by Pareto order sampling (Rosén, 1997).

Every source gets a target number of words from its weight; no target exceeds
``MAX_COPIES`` times what the source has, and what is cut off is shared again by
weight until no source is above.  Inside a source, documents differ in how often they
are wanted: in proportion to their favour, a whole number that is the bit length of
their size unless the caller gives another, and at most ``MAX_COPIES`` times; one level
per source makes the wanted words add up to the target.  The whole part of what a
document is wanted is certain, the rest is its inclusion probability p.  All documents
of a source, of whatever p, are ranked together by (u / (1 - u)) / (p / (1 - p)), u being
uniform from a hash of the document, and drawn from the smallest on until the words
that the source still lacks are filled; the last one is drawn when that brings the sum
nearer.  The sample has its fixed size in words, the unit of the targets, so each source
comes within half a document of its target.

Only DataFrame functions are used.  No source is ranked in one task: words are summed
in ``BINS`` ranges of the rank first, and only documents of the one range in which the
target is reached are put in order, one source's range in a task.  Levels are found
from the words of each (source, favour), a table of at most ``FAVOURS`` rows a source.

Inputs: ``documents`` (doc_id, text, source).  A null text has no words; a null source is
a source of its own, the last.  A document without words is not drawn; it gets the
whole part of target / source_size.  Documents that are alike in id and text are ranked
side by side and counted each.  An empty table gives no rows.  Other columns are not
looked at, and ``mixed`` keeps them.  Sources are categories: their table, one row
each, is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlantern.llm.common import stored

#: Weights in order of source, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 4096
#: Favours above this count as this one.
FAVOURS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """Strictly between 0 and 1, from 48 bits of a digest: the same in every run."""
    digest = F.md5(F.concat_ws("|", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    With sources in order of limit by weight, those at their limit are the first
    ones: a source is when the level that the open ones share would exceed its limit.
    The level computed at the first open source is the largest of the open ones.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    limited = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * float(most))
    by_limit = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    # what is left for this source and all later ones, if the earlier ones are at their limit
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    level = limited.withColumn("level", left / F.sum("weight").over(after))
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level"))).over(whole)
    target = F.least("bound", F.coalesce(open_level, F.lit(math.inf)) * F.col("weight"))
    return level.withColumn("target", target).select("source", "source_size", "target")


def wanted_copies(strata: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """(source, favour, words, source_size, target)  →  with expected (copies of a
    document of that favour) and lacking (words that the source draws by chance).

    Within a source the greatest favours reach ``most`` first, so the level is found
    as in :func:`source_targets`.  Favour 0, documents without words, takes no part.
    """
    by_favour = Window.partitionBy("source").orderBy(F.desc("favour"))
    before = by_favour.rowsBetween(Window.unboundedPreceding, -1)
    after = by_favour.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("source")
    left = F.col("target") - F.coalesce(F.sum("words").over(before), F.lit(0)) * float(most)
    share = F.sum(F.col("words") * F.col("favour")).over(after)
    level = strata.withColumn("level", F.when(F.col("favour") > 0, left / share))
    open_level = F.max(F.when(F.col("level") * F.col("favour") <= float(most), F.col("level"))).over(whole)
    drawn = F.least(F.lit(float(most)), F.coalesce(open_level, F.lit(math.inf)) * F.col("favour"))
    blank = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) + 1e-12)).otherwise(0.0)
    expected = level.withColumn("expected", F.when(F.col("favour") > 0, drawn).otherwise(blank).cast("double"))
    expected = expected.withColumn("certain", F.floor(F.col("expected") + 1e-12))
    lacking = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole)
    return expected.withColumn("lacking", lacking).drop("level", "words")


def _taken(rows: DataFrame) -> DataFrame:
    """doc_id, source, size, u, favour  →  with source_size, target, expected and copies."""
    strata = stored(rows.groupBy("source", "favour").agg(F.sum("size").alias("words")), "mix-strata")
    targets = source_targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")))
    targets = targets.select(F.col("source").alias("of"), "source_size", "target")
    strata = strata.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    wanted = wanted_copies(strata).withColumnsRenamed({"source": "of", "favour": "of_favour"})
    wanted = stored(wanted, "mix-wanted")
    rows = rows.join(wanted, F.col("source").eqNullSafe(F.col("of")) & (F.col("favour") == F.col("of_favour")))
    chance = F.greatest(F.col("expected") - F.col("certain"), F.lit(0.0))
    odds = F.when(chance > 0, chance / (1 - chance))
    rows = rows.withColumn("rank", (F.col("u") / (1 - F.col("u"))) / odds)
    # equal ranges of rank / (1 + rank); the sample ends near rank 1, the middle
    rows = rows.withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BINS), F.lit(BINS - 1)).cast("int"))
    bins = rows.where("rank IS NOT NULL").groupBy("of", "bin").agg(F.sum("size").alias("in_bin"), F.first("lacking").alias("lacks"))
    upto = Window.partitionBy("of").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("in_bin").over(upto))
    reached = bins.where(F.col("upto") >= F.col("lacks")).groupBy("of").agg(
        F.min(F.struct("bin", (F.col("upto") - F.col("in_bin")).alias("before"))).alias("at"))
    reached = stored(reached.select(F.col("of").alias("at_source"), F.col("at.bin").alias("at_bin"), F.col("at.before").alias("before")), "mix-reached")
    rows = rows.join(reached, F.col("of").eqNullSafe(F.col("at_source")), "left")
    edge = rows.where((F.col("bin") == F.col("at_bin")) & F.col("rank").isNotNull())
    in_order = Window.partitionBy("of", "bin").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("before") + F.col("size") / 2 <= F.col("lacking")).cast("long"))
    others = rows.where(F.col("rank").isNull() | F.col("at_bin").isNull() | (F.col("bin") != F.col("at_bin")))
    below = F.col("rank").isNotNull() & (F.col("at_bin").isNull() | (F.col("bin") < F.col("at_bin")))
    others = others.withColumn("extra", below.cast("long"))
    columns = ["doc_id", "u", "size", "source_size", "target", "expected", (F.col("certain") + F.col("extra")).cast("long").alias("copies")]
    return others.select(*columns).unionByName(edge.select(*columns))


def _rows(docs: DataFrame, favour: Column | None) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(text).alias("size"), uniform(F.col("doc_id"), text).alias("u"),
        (F.lit(None) if favour is None else favour).cast("int").alias("favour"),
    )
    given = F.coalesce("favour", F.length(F.bin("size")))
    return rows.withColumn("favour", F.when(F.col("size") > 0, F.greatest(F.lit(1), F.least(given, F.lit(FAVOURS)))).otherwise(0))


def mix(docs: DataFrame, favour: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, expected: one row per document.

    ``favour``: an expression over ``docs``, 1 to ``FAVOURS``; null stands for the default.
    """
    taken = _taken(stored(_rows(docs, favour), "mix-sizes"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "expected")


def mixed(docs: DataFrame, favour: Column | None = None) -> DataFrame:
    """The rows of ``docs`` in the mix, all columns, each as often as it is taken."""
    drawn = uniform(F.col("doc_id"), F.col("text").cast("string"))
    copies = _taken(stored(_rows(docs, favour), "mix-sizes"))
    # rows alike in id and text share u; of those the number of copies is spread by rank
    same = Window.partitionBy("doc_id", "u").orderBy(F.desc("copies"))
    copies = copies.withColumn("no", F.row_number().over(same)).where("copies > 0")
    copies = copies.select(F.col("doc_id").alias("__id"), F.col("u").alias("__u"), F.col("no").alias("__no"), F.col("copies").alias("__copies"))
    numbered = docs.withColumn("__at", drawn)
    numbered = numbered.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "__at").orderBy("__at")))
    found = numbered.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__u")) & (F.col("__nth") == F.col("__no")))
    repeated = found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH n AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
d AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS favour FROM n),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
             source_size * 3.0::DOUBLE AS bound FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(bound) OVER (ORDER BY bound / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
              / sum(weight) OVER (ORDER BY bound / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(bound, coalesce((SELECT max(level) FROM l WHERE level * weight <= bound), 'inf'::DOUBLE) * weight) AS target FROM l),
f AS (SELECT source, favour, sum(size) AS words FROM d GROUP BY source, favour),
v AS (SELECT f.*, t.source_size, t.target,
             CASE WHEN favour > 0 THEN (t.target - coalesce(sum(words) OVER (PARTITION BY f.source ORDER BY favour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3.0::DOUBLE)
               / sum(CAST(words * favour AS DOUBLE)) OVER (PARTITION BY f.source ORDER BY favour DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS level
      FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CASE WHEN favour > 0 THEN least(3.0::DOUBLE, coalesce(max(CASE WHEN level * favour <= 3.0::DOUBLE THEN level END) OVER (PARTITION BY source), 'inf'::DOUBLE) * favour)
                     WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0.0::DOUBLE END AS expected FROM v),
y AS (SELECT *, floor(expected + 1e-12) AS certain,
             target - sum(floor(expected + 1e-12) * CAST(words AS DOUBLE)) OVER (PARTITION BY source) AS lacking FROM x),
o AS (SELECT d.doc_id, d.source, d.size, d.u, y.source_size, y.target, y.expected, y.certain, y.lacking, greatest(y.expected - y.certain, 0.0::DOUBLE) AS chance
      FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source AND d.favour = y.favour),
r AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM o),
b AS (SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, expected FROM (
  SELECT *, CAST(certain + CASE WHEN rank IS NOT NULL AND before + size / 2 <= lacking THEN 1 ELSE 0 END AS BIGINT) AS copies FROM b)"""
