"""The search definition once more, as one SQL text for any clause rows."""

from __future__ import annotations

from paperlantern.workload.fixtures import DOCS_SQL

_COLUMNS = ("query_id", "clause_id", "occur", "kind", "field", "text", "lo", "hi", "lo_ts", "hi_ts", "fuzziness", "boost")
_TYPES = ("VARCHAR", "INTEGER", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "DOUBLE", "DOUBLE", "TIMESTAMP", "TIMESTAMP", "INTEGER", "DOUBLE")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + str(value).replace("'", "''") + "'"


def clause_values(clauses: list[dict]) -> str:
    """``q AS (…)`` from the same dictionaries the Spark side takes."""
    rows = []
    for n, c in enumerate(clauses):
        field = {"numeric_range": "size", "date_range": "mod_time"}.get(c.get("kind"), "content")
        values = (
            c["query_id"], c.get("clause_id", n), c.get("occur", "should"), c["kind"], c.get("field", field), c.get("text"),
            c.get("lo"), c.get("hi"), c.get("lo_ts"), c.get("hi_ts"), c.get("fuzziness"), c.get("boost", 1.0),
        )
        rows.append("(" + ", ".join(f"CAST({_literal(v)} AS {t})" for v, t in zip(values, _TYPES)) + ")")
    return "q0(" + ", ".join(_COLUMNS) + ") AS (VALUES " + ",\n ".join(rows) + ")"


def scored_ctes(clauses: list[dict], folders: list[str] | None = None) -> str:
    """(levenshtein counts bytes there, so characters outside ASCII, which no
    query text here has, are made one byte first.)

    CTEs up to ``scored(query_id, index_id, path, score)``."""
    scope = "TRUE"
    if folders is not None:
        scope = "dir IN (" + ", ".join(_literal(f) for f in folders) + ")"
    return rf"""WITH {DOCS_SQL},
{clause_values(clauses)},
q AS (
  SELECT * FROM q0 UNION ALL
  SELECT query_id, -1, 'must', 'match_all', 'content', NULL, NULL, NULL, NULL, NULL, NULL, 0.0
  FROM q0 GROUP BY query_id HAVING count(*) FILTER (occur <> 'must_not') = 0),
lists AS (SELECT index_id, path, dir, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS l FROM docs),
toks AS (SELECT index_id, path, dir, len(l) AS n_tokens, unnest(l) AS term, unnest(range(len(l))) AS pos FROM lists),
post AS (SELECT index_id, path, dir, n_tokens, term, count(*) AS tf FROM toks GROUP BY ALL),
dict AS (SELECT index_id, term, count(*) AS df FROM post GROUP BY ALL),
nd AS (SELECT index_id, count(*) AS n FROM docs GROUP BY ALL),
words AS (
  SELECT query_id, clause_id, unnest(w) AS term, unnest(range(len(w))) AS ordinal, len(w) AS width, kind FROM (
    SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM q WHERE field = 'content' AND kind IN ('match', 'phrase'))),
lit AS (
  SELECT query_id, clause_id, text AS term, 0 AS ordinal, 1 AS mult, 1 AS width, text AS unit FROM q WHERE kind = 'term' AND field = 'content'
  UNION ALL SELECT query_id, clause_id, term, 0, count(*), 1, term FROM words WHERE kind = 'match' GROUP BY ALL
  UNION ALL SELECT query_id, clause_id, term, ordinal, 1, width, '' FROM words WHERE kind = 'phrase'),
exps AS (
  SELECT q.query_id, q.clause_id, d.index_id, d.term FROM dict d JOIN q ON q.field = 'content' AND (
       (q.kind = 'regexp' AND regexp_full_match(d.term, q.text))
    OR (q.kind = 'prefix' AND starts_with(d.term, q.text))
    OR (q.kind = 'wildcard' AND regexp_full_match(d.term, replace(replace(q.text, '*', '.*'), '?', '.')))
    OR (q.kind = 'fuzzy' AND levenshtein(regexp_replace(d.term, '[^\x00-\x7F]', '~', 'g'), q.text) <= coalesce(q.fuzziness, 1)))),
qt AS (
  SELECT l.query_id, l.clause_id, nd.index_id, l.term, l.ordinal, l.mult, l.width, l.unit, 1 + ln(nd.n / (coalesce(d.df, 0) + 1.0)) AS idf
  FROM lit l CROSS JOIN nd LEFT JOIN dict d ON d.index_id = nd.index_id AND d.term = l.term
  UNION ALL
  SELECT e.query_id, e.clause_id, e.index_id, e.term, 0, 1, 1, e.term, 1 + ln(nd.n / (d.df + 1.0))
  FROM exps e JOIN nd USING (index_id) JOIN dict d ON d.index_id = e.index_id AND d.term = e.term),
units AS (
  SELECT t.query_id, t.clause_id, t.index_id, t.unit, any_value(t.mult) AS mult, sum(t.idf) AS idf, any_value(q.boost) AS boost
  FROM qt t JOIN q USING (query_id, clause_id) WHERE q.occur <> 'must_not' GROUP BY ALL),
norms AS (SELECT query_id, index_id, sqrt(sum(mult * (boost * idf) ** 2)) AS norm FROM units GROUP BY ALL),
weights AS (
  SELECT u.query_id, u.clause_id, u.index_id, u.unit,
         CASE WHEN norm = 0 THEN 0 ELSE mult * boost * idf * idf / norm END AS weight
  FROM units u JOIN norms USING (query_id, index_id)),
single AS (
  SELECT t.query_id, t.clause_id, p.index_id, p.path, t.mult AS units, coalesce(w.weight, 0) * sqrt(p.tf) / sqrt(p.n_tokens) AS s
  FROM post p JOIN qt t ON t.index_id = p.index_id AND t.term = p.term AND t.unit <> ''
  LEFT JOIN weights w ON w.query_id = t.query_id AND w.clause_id = t.clause_id AND w.index_id = t.index_id AND w.unit = t.unit
  WHERE {scope}),
starts AS (
  SELECT l.query_id, l.clause_id, k.index_id, k.path, k.n_tokens, k.pos - l.ordinal AS start
  FROM toks k JOIN lit l ON l.term = k.term AND l.unit = '' WHERE {scope}
  GROUP BY l.query_id, l.clause_id, k.index_id, k.path, k.n_tokens, k.pos - l.ordinal, l.width HAVING count(*) = l.width),
phrases AS (
  SELECT s.query_id, s.clause_id, s.index_id, s.path, 1 AS units, coalesce(any_value(w.weight), 0) * sqrt(count(*)) / sqrt(any_value(s.n_tokens)) AS s
  FROM starts s LEFT JOIN weights w ON w.query_id = s.query_id AND w.clause_id = s.clause_id AND w.index_id = s.index_id AND w.unit = ''
  GROUP BY s.query_id, s.clause_id, s.index_id, s.path),
filters AS (
  SELECT q.query_id, q.clause_id, d.index_id, d.path, 1 AS units, CASE WHEN q.kind = 'match_all' THEN q.boost ELSE 0 END AS s
  FROM docs d JOIN q ON
       q.kind = 'match_all'
    OR (q.kind = 'numeric_range' AND (q.lo IS NULL OR d.size >= q.lo) AND (q.hi IS NULL OR d.size < q.hi))
    OR (q.kind = 'date_range' AND (q.lo_ts IS NULL OR d.mod_time >= q.lo_ts) AND (q.hi_ts IS NULL OR d.mod_time < q.hi_ts))
    OR (q.field = 'extension' AND d.ext = q.text) OR (q.field = 'dir' AND d.dir = q.text)
  WHERE {scope}),
clause_hits AS (
  SELECT h.query_id, h.clause_id, h.index_id, h.path, q.occur,
         CASE WHEN q.kind IN ('regexp', 'prefix', 'wildcard', 'fuzzy') THEN max(units) ELSE sum(units) END AS units, sum(s) AS s
  FROM (SELECT * FROM single UNION ALL SELECT * FROM phrases UNION ALL SELECT * FROM filters) h
  JOIN q USING (query_id, clause_id) GROUP BY h.query_id, h.clause_id, h.index_id, h.path, q.occur, q.kind),
totals AS (
  SELECT q.query_id, count(*) FILTER (q.occur = 'must') AS n_must,
         sum(CASE WHEN q.occur <> 'should' THEN 0 WHEN q.kind = 'match' AND q.field = 'content'
             THEN len(regexp_extract_all(lower(q.text), '[\p{{L}}\p{{N}}_]+')) ELSE 1 END) AS should_units
  FROM q GROUP BY q.query_id),
scored AS (
  SELECT h.query_id, h.index_id, h.path,
         round(coalesce(sum(s) FILTER (occur = 'must'), 0)
               + CASE WHEN should_units > 0 THEN coalesce(sum(s) FILTER (occur = 'should'), 0)
                      * coalesce(sum(units) FILTER (occur = 'should'), 0) / should_units ELSE 0 END, 6) AS score
  FROM clause_hits h JOIN totals t USING (query_id)
  GROUP BY h.query_id, h.index_id, h.path, n_must, should_units
  HAVING count(*) FILTER (occur = 'must_not') = 0 AND count(*) FILTER (occur = 'must') = n_must
     AND (n_must > 0 OR count(*) FILTER (occur = 'should') > 0)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, index_id ORDER BY score DESC, path) AS INTEGER) AS rank FROM scored)"""


def search_sql(clauses: list[dict], k: int, folders: list[str] | None = None) -> str:
    return scored_ctes(clauses, folders) + f"\nSELECT query_id, index_id, rank, path, score FROM ranked WHERE rank <= {k}"
