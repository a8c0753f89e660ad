"""Line-by-line previews with highlighted matches.

Lines and pieces are arrays inside the row of their document or line, built
with string functions; only matches are numbered across a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlantern.functions.text import ASCII_BOUNDARY, is_regex_input, regex_quote
from paperlantern.session import cut_lineage, small_side

DOC = ["query_id", "index_id", "path"]


def search_terms(specs: DataFrame, compat: bool = False) -> DataFrame:
    """Highlight terms per query, in clause order; regexps as ``/…/``.

    must_not terms are left out; ``compat`` takes them in for queries with a
    should clause.
    """
    text = F.when(F.col("kind") == "regexp", F.concat(F.lit("/"), F.col("text"), F.lit("/"))).otherwise(F.col("text"))
    shown = F.col("kind").isin("term", "match", "regexp")
    positive = F.col("occur") != "must_not"
    has_should = F.max(F.when(F.col("occur") == "should", 1).otherwise(0))
    group = F.when(F.col("occur") == "must", 0).when(F.col("occur") == "should", 1).otherwise(2)
    listed = lambda cond: F.sort_array(
        F.collect_list(F.when(cond & shown, F.struct(group.alias("g"), F.col("clause_id").alias("c"), text.alias("t"))))
    )
    both = specs.groupBy("query_id").agg(
        listed(positive).alias("pos"), listed(F.lit(True)).alias("every"), has_should.alias("has_should")
    )
    chosen = F.when(F.lit(compat) & (F.col("has_should") == 1), F.col("every")).otherwise(F.col("pos"))
    return both.select("query_id", F.transform(chosen, lambda x: x["t"]).alias("terms"))


def highlight_pattern(terms) -> Column:
    """One pattern for all terms; null when there is none.

    A literal is quoted and bounded on both sides, a regexp on its right only;
    alternatives are joined as they are.
    """
    one = lambda t: F.when(
        is_regex_input(t), F.concat(F.lit("(?iu)"), F.substr(t, F.lit(2), F.length(t) - 2), F.lit(ASCII_BOUNDARY))
    ).otherwise(F.concat(F.lit("(?iu)" + ASCII_BOUNDARY), regex_quote(t), F.lit(ASCII_BOUNDARY)))
    joined = F.array_join(F.transform(terms, one), "|")
    return F.when(F.size(terms) > 0, joined)


def lines_of(text) -> Column:
    """Non-empty lines; one ``\\r`` before a line end belongs to the end."""
    unix = F.regexp_replace(text, "\r(?=\n|\\z)", "")
    return F.filter(F.split(unix, "\n", -1), lambda line: F.length(line) > 0)


def preview_lines(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row per non-empty line, numbered from 0 within its document."""
    keep = [c for c in docs.columns if c != text]
    out = docs.select(*keep, F.posexplode_outer(lines_of(text)).alias("row_id", "line"))
    return out.where(F.col("line").isNotNull())


def pieces_of(line, pattern) -> Column:
    """array<struct<text,is_match>>: plain and matching pieces of a line in turn.

    Matches are wrapped in two marks and the line is split there.  A mark is a
    control character, or, in a line that has it already, that character around
    the digest of the line.  Empty matches are taken out again.  Empty plain
    pieces are left out, but the piece after the last match always stays.
    """
    mark = lambda char: F.when(F.instr(line, char) == 0, F.lit(char)).otherwise(
        F.concat(F.lit(char), F.md5(line), F.lit(char))
    )
    opened, closed = mark("\u0001"), mark("\u0002")
    marked = F.regexp_replace(line, pattern, F.concat(opened, F.lit("$0"), closed))
    marked = F.replace(marked, F.concat(opened, closed), F.lit(""))
    parts = F.split(marked, F.concat(opened, F.lit("|"), closed), -1)
    typed = F.transform(parts, lambda text, i: F.struct(text.alias("text"), (i % 2 == 1).alias("is_match"), i.alias("i")))
    kept = F.filter(typed, lambda p: p["is_match"] | (p["text"] != "") | (p["i"] == F.size(parts) - 1))
    plain = F.array(F.struct(line.alias("text"), F.lit(False).alias("is_match")))
    found = F.transform(kept, lambda p: F.struct(p["text"].alias("text"), p["is_match"].alias("is_match")))
    return F.when(pattern.isNull(), plain).otherwise(found)


def highlight_segments(lines: DataFrame) -> DataFrame:
    """Adds ``segments`` to lines that carry ``line`` and ``pattern``."""
    return lines.withColumn("segments", pieces_of(F.col("line"), F.col("pattern")))


def segment_rows(segmented: DataFrame) -> DataFrame:
    """One row per piece."""
    out = segmented.select(*DOC, "row_id", F.posexplode_outer("segments").alias("seg_id", "s"))
    return out.select(*DOC, "row_id", "seg_id", "s.text", "s.is_match")


def match_locations(segmented: DataFrame) -> DataFrame:
    """Matches as ``row_id, start, end, seg_id`` (characters within the line),
    numbered from 0 across the document.

    The pieces of lines with a match go to their document, plain ones as lengths
    only.  There a running sum gives the offsets and a count the numbers: one
    shuffle serves both, and a line of many matches costs as much as many lines.
    """
    any_match = F.exists("segments", lambda s: s["is_match"])
    pieces = segmented.where(any_match).select(*DOC, "row_id", F.posexplode_outer("segments").alias("seg_id", "s"))
    pieces = pieces.where(F.col("s").isNotNull()).select(
        *DOC, "row_id", "seg_id", F.length("s.text").alias("n"), F.when(F.col("s.is_match"), F.col("s.text")).alias("text")
    )
    in_line = Window.partitionBy(*DOC, "row_id").orderBy("seg_id")
    placed = pieces.repartition(*DOC).withColumn("end", F.sum("n").over(in_line).cast("int"))
    rows = placed.where(F.col("text").isNotNull()).select(
        *DOC, "row_id", (F.col("end") - F.col("n")).alias("start"), "end", "seg_id", "text"
    )
    order = Window.partitionBy(*DOC).orderBy("row_id", "start")
    return rows.withColumn("match_no", F.row_number().over(order) - 1)


def nth_match(matches: DataFrame, wanted: DataFrame) -> DataFrame:
    """The match number ``n`` asked per (query, document), clamped to what exists.

    ``label`` is its 1-based number, ``n_matches`` how many there are.
    """
    counts = matches.groupBy(*DOC).agg(F.count(F.lit(1)).cast("int").alias("n_matches"))
    asked = wanted.join(counts, DOC).withColumn(
        "match_no", F.greatest(F.lit(0), F.least(F.col("n"), F.col("n_matches") - 1)).cast("int")
    )
    found = matches.join(asked.select(*DOC, "match_no", "n_matches"), [*DOC, "match_no"])
    return found.withColumn("label", F.col("match_no") + 1)


def _wanted(hits: DataFrame, specs: DataFrame, compat: bool) -> DataFrame:
    """Hits with the pattern of their query, computed once."""
    patterns = search_terms(specs, compat).select("query_id", highlight_pattern("terms").alias("pattern"))
    return small_side(cut_lineage(hits.select(*DOC).join(patterns, "query_id", "left")))


def preview(hits: DataFrame, corpus: DataFrame, specs: DataFrame, compat: bool = False) -> DataFrame:
    """Lines with segments of every hit: the corpus is read for the hits only."""
    texts = corpus.select("index_id", "path", "content").join(_wanted(hits, specs, compat), ["index_id", "path"])
    return highlight_segments(preview_lines(texts.select(*DOC, "pattern", "content")))


def preview_large(hits: DataFrame, lines: DataFrame, specs: DataFrame, compat: bool = False) -> DataFrame:
    """As :func:`preview` for files read line by line (``block, line_no, content``).

    Rows are numbered within a block; the blocks before it tell where it begins.
    """
    key = ["index_id", "path"]
    unix = F.regexp_replace("content", "\r\\z", "")
    shown = lines.select(*key, "block", "line_no", unix.alias("line")).where(F.length("line") > 0)
    asked = _wanted(hits, specs, compat)
    shown = shown.join(asked.select(*key).distinct(), key, "left_semi")
    upto = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shown.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select(*key, "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    in_block = Window.partitionBy(*key, "block").orderBy("line_no")
    numbered = shown.withColumn("in_block", F.row_number().over(in_block) - 1).join(blocks, [*key, "block"])
    numbered = numbered.withColumn("row_id", (F.col("base") + F.col("in_block")).cast("int"))
    return highlight_segments(numbered.join(asked, key).select(*DOC, "pattern", "row_id", "line"))
