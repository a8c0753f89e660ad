"""Which terms a pattern or a near spelling can mean, without looking at all of them (Q7, Q11, Q12).

Two tables beside the term dictionary, written with every segment.  Each file holds all
rows of its share of the terms, sorted by what they are asked for, as a 32-bit hash: it
sorts fast and is short, and the statistics of a file's pages lead to the few that hold it.  Two
texts of one hash only give candidates more, and all candidates are tried:

*Trigrams* ``(gram, term)``, a mark before and after the term counting as characters.  A
pattern is taken apart into the runs of characters that a match must hold; a term that
lacks one of their trigrams cannot match.  The trigrams that the fewest terms hold are
intersected, and only what is left meets the pattern itself.

*Spellings* ``(spelling, term)``: the first ``PREFIX`` characters of a term with up to
``DELETES`` of them left out.  Two terms at an edit distance of n share a spelling with at
most n characters left out on either side, so an equal join finds all candidates.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlantern.session import settle, small_side, take_if_small

#: Marks that no term holds: before it, after it, and between runs of a pattern.
START, END, CUT = "\u0002", "\u0003", "\u0001"
GRAM = 3
PREFIX = 7
DELETES = 2
#: So many trigrams of a pattern are intersected, the rarest ones.
RAREST = 3
#: More values than this are not spelled out as literals of a scan.
LITERALS = 2_000


def _none() -> Column:
    return F.array().cast("array<string>")


def _grams(text: Column) -> Column:
    n = F.length(text) - (GRAM - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(_none())


def term_grams(terms: DataFrame) -> DataFrame:
    """(gram, term) of every term, each hash once.  The marked term is a column of its own: the lambda would build it again for every gram."""
    marked = terms.select("term", F.concat(F.lit(START), F.col("term"), F.lit(END)).alias("marked"))
    hashes = F.transform(F.sequence(F.lit(1), F.length("marked") - (GRAM - 1)), lambda i: F.hash(F.substring("marked", i, F.lit(GRAM))))
    hashes = F.when(F.length("marked") >= GRAM, hashes).otherwise(F.array().cast("array<int>"))
    return marked.select(F.explode(F.array_distinct(hashes)).alias("gram"), "term")


def _characters(text) -> list[Column]:
    return [F.substring(text, place, 1) for place in range(1, PREFIX + 1)]


def _left_out(characters: list[Column], most: int) -> list[Column]:
    """The characters put together with up to ``most`` of them left out, in all ways.

    One plain expression per choice of places, no lambda, so that it is compiled; a place
    behind the end leaves nothing out, which repeats a spelling that is there already.
    """
    places = range(PREFIX)
    return [F.concat(*[characters[i] for i in places if i not in chosen]) for n in range(most + 1) for chosen in combinations(places, n)]


def spellings(text, most: int) -> Column:
    """The beginning of a text with up to ``most`` characters left out, in all ways."""
    return F.array_distinct(F.array(*_left_out(_characters(text), most)))


def term_spellings(terms: DataFrame) -> DataFrame:
    """(spelling, term) of every term, each hash once.  The characters are columns, cut once for all choices, and hashes are made distinct, not texts."""
    names = [f"_{place}" for place in range(PREFIX)]
    cut = terms.select("term", *[c.alias(name) for c, name in zip(_characters("term"), names)])
    hashes = [F.hash(spelling) for spelling in _left_out([F.col(name) for name in names], DELETES)]
    return cut.select(F.explode(F.array_distinct(F.array(*hashes))).alias("spelling"), "term")


def pattern_grams(kind: Column, text: Column) -> Column:
    """Trigrams that every term a pattern clause matches must hold; none if that cannot be told.

    Of a regexp, escapes, sets, groups and repeated characters end a run; one with
    alternatives outside of groups, flags, or anything else is not taken apart.
    """
    plain = F.regexp_replace(text, r"\\[bBdDwWsS]|\\[^A-Za-z0-9]", CUT)
    plain = F.regexp_replace(plain, r"\[[^\[\]]*\]", CUT)
    flagged = F.rlike(plain, F.lit(r"\(\?(?!:)"))
    for _ in range(3):
        plain = F.regexp_replace(plain, r"\((?:\?:)?[^()]*\)", CUT)
    strange = flagged | F.rlike(plain, F.lit(r"[\\|()\[\]]"))
    plain = F.regexp_replace(plain, r"(?s).(?:[*?]|\{[^{}]*\})[+?]?", CUT)
    plain = F.translate(F.regexp_replace(plain, r"\++", CUT), ".^${}", CUT * 5)
    marked = (
        F.when((kind == "regexp") & ~strange, F.concat(F.lit(START), plain, F.lit(END)))
        .when(kind == "wildcard", F.concat(F.lit(START), F.translate(text, "*?", CUT * 2), F.lit(END)))
        .when(kind == "prefix", F.concat(F.lit(START), text))
    )
    return F.coalesce(F.array_distinct(F.flatten(F.transform(F.split(marked, CUT), _grams))), _none())


def _asked(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of a lookup table that any clause asks for; literals prune its row groups."""
    values = take_if_small(wanted.select(column).distinct(), LITERALS)
    if values is not None:
        return table.where(F.col(column).isin([r[0] for r in values]))
    return table.join(wanted.select(column).distinct(), column, "left_semi")


def terms_by_gram(grams: DataFrame, clauses: DataFrame) -> DataFrame:
    """(clause, term) from (clause, grams): terms that hold the rarest trigrams of a clause."""
    wanted = settle(clauses.select("clause", F.explode("grams").alias("gram")).select("clause", F.hash("gram").alias("gram")).distinct())
    there = _asked(grams, "gram", wanted)
    counts = there.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("clause").orderBy(F.coalesce("n", F.lit(0)), "gram")
    chosen = wanted.join(small_side(counts), "gram", "left").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= RAREST)
    chosen = settle(chosen.select("clause", "gram", F.count(F.lit(1)).over(Window.partitionBy("clause")).alias("needed")))
    met = _asked(grams, "gram", chosen).join(small_side(chosen), "gram")
    held = met.groupBy("clause", "term").agg(F.count(F.lit(1)).alias("held"), F.first("needed").alias("needed"))
    return held.where("held = needed").select("clause", "term")


def terms_by_spelling(table: DataFrame, clauses: DataFrame) -> DataFrame:
    """(clause, term) from (clause, text, n): terms that share a spelling with n characters left out at most."""
    n, text = F.col("n"), F.col("text")
    each = F.when(n == 0, spellings(text, 0)).when(n == 1, spellings(text, 1)).otherwise(spellings(text, DELETES))
    wanted = clauses.select("clause", "n", F.explode(each).alias("spelling"))
    wanted = settle(wanted.select("clause", "n", F.length("spelling").alias("kept"), F.hash("spelling").alias("spelling")))
    met = _asked(table, "spelling", wanted).join(small_side(wanted), "spelling")
    left_out = F.length(F.substring("term", 1, PREFIX)) - F.col("kept")
    return met.where(left_out <= F.col("n")).select("clause", "term").distinct()
