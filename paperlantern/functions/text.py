"""Text expressions: analysis, dates, quoting, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates two terms; the ASCII word boundary spelled out
# (the engine's own \b is Unicode-aware); the metacharacters of a regexp.
SEPARATOR = r"[^\p{L}\p{N}_]+"
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
METACHARACTERS = r"([\\.+*?()|\[\]{}^$])"
RFC1123 = "EEE, dd MMM yyyy HH:mm:ss zzz"


def terms_of(text) -> Column:
    """Lower-case runs of letters, digits and ``_``; ordinal = position."""
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def rfc1123(ts) -> Column:
    return F.date_format(ts, RFC1123)


def parse_rfc1123(text) -> Column:
    """The weekday is redundant, and the parser refuses it, so it is skipped."""
    return F.to_timestamp(F.substr(text, F.lit(6)), "dd MMM yyyy HH:mm:ss zzz")


def truncate_text(text, n: int) -> Column:
    """At most ``n`` characters, then ``...`` when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def regex_quote(text) -> Column:
    return F.regexp_replace(text, METACHARACTERS, r"\\$1")


def is_regex_input(text) -> Column:
    return F.rlike(text, F.lit(r"(?s)^/.*/$"))
