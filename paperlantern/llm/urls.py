"""URL filter: a trie over reversed host labels and path segments.

A rule names a host and a path.  It fits its host and all subdomains when the path of
the url starts with the rule's path.  The trie is walked by host label from the right
(``org``, ``example``, …), then by path segment; of all rules on the way the one with
the most host labels wins, then the longest path.  Rules are configuration, known
before the job: at most ``MAX_RULES`` of them, so the trie that every task gets has a
proven bound.

Inputs: ``pages`` (page_id, url) and the rules.  A null url, or one without ``://``, has
an empty host and path.  A url that no rule fits is allowed.  Of rules for the same
host and path, block wins.  A rule path without an end slash fits longer segments too
(``/en`` fits ``/english``).  Repeated rows are judged one by one; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
ALLOW, BLOCK = "allow", "block"
#: The registered query's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


class Trie:
    """Nodes are dictionaries: label or segment to node.

    A node of the host part keeps its path part under ``None``.  Each node of the path
    part keeps under ``None`` the rules that end within the next segment, as a list of
    (beginning of that segment, rule), longest first.
    """

    def __init__(self, rules: Iterable[Rule | tuple]):
        rules = [Rule(*r) for r in rules]
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.root: dict = {}
        for rule in sorted(rules, key=lambda r: r.verdict == BLOCK):  # block comes last and stays
            if rule.verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict {rule.verdict!r}")
            node = self.root
            for label in reversed(rule.host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = [e for e in node.get(None, ()) if e[0] != rest]
            node[None] = sorted([*ends, (rest, rule)], key=lambda e: -len(e[0]))

    def find(self, host: str, path: str) -> Rule | None:
        """The rule that decides, or None."""
        if not host:
            return None
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], path) or best
        return best

    @staticmethod
    def _path(node: dict, path: str) -> Rule | None:
        best = None
        for segment in path.split("/"):
            best = next((rule for start, rule in node.get(None, ()) if segment.startswith(start)), best)
            node = node.get(segment)
            if node is None:
                break
        return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Iterable[Rule | tuple] = RULES) -> DataFrame:
    """page_id, host, path, rule (like ``net/``; null when none fits), verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            found = [find(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            rule = pa.array([r and r.host + r.path for r in found], pa.string())
            verdict = pa.array([r.verdict if r else ALLOW for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"))
    return parts.mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")


SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n
  FROM pages),
r(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT u.n, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY u.n ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)"""
