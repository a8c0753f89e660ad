"""Registered queries with their SQL, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlantern.functions.paths import path_base, path_dir, path_ext, path_rel
from paperlantern.functions.text import is_regex_input, parse_rfc1123, regex_quote, rfc1123, truncate_text
from paperlantern.operators import analyze, changes as ch, clauses as cl, folders as fo, preview as pv, rank, results as rs, stats
from paperlantern.plans.maintain import live_documents
from paperlantern.plans.search import score_documents, search
from paperlantern.sources.files import filter_extensions, to_documents
from paperlantern.workload import fixtures as fx
from paperlantern.workload.fixtures import CHANGES_SQL, DOCS_SQL, LAST_SQL, MIXED_DOCS_SQL, PAGE_DIRS_SQL
from paperlantern.workload.oracle_search import scored_ctes, search_sql
from paperlantern.workload.registry import ORACLES, QUERIES, register as _register  # noqa: F401

# ------------------------------------------------------------- scans, documents


@_register("s2_filter_extensions", f"WITH {MIXED_DOCS_SQL} SELECT index_id, path, ext FROM docs WHERE ext IN ('.txt', '.log', '.md', '.go', '.py')")
def s2(spark, sf):
    return filter_extensions(fx.documents(spark, sf, fx.MIXED_EXTENSIONS)).select("index_id", "path", "ext")


@_register(
    "s3_to_documents",
    f"WITH {DOCS_SQL} SELECT index_id, path, dir, ext, size, strftime(mod_time, '%a, %d %b %Y %H:%M:%S UTC') AS mod_time, md5(content) AS digest FROM docs",
)
def s3(spark, sf):
    docs = to_documents(fx.raw_documents(spark, sf).drop("index_id", "doc_id"), "", fx.BASE_PATH)
    return docs.select(
        F.substring_index("path", "/", 1).alias("index_id"), "path", "dir", "ext", "size", rfc1123("mod_time").alias("mod_time"),
        F.md5("content").alias("digest"),
    )


# ------------------------------------------------------------------- functions

_NAMES_SQL = """names AS (
  SELECT page_id AS id, regexp_extract(url, '^https?://([^?#]+)', 1) AS p FROM pages
  UNION ALL SELECT doc_id, source || '/' || lang || '/' || doc_id || ['.txt', '.tar.gz', '.', '', '/.log'][CAST(doc_id % 5 AS INTEGER) + 1] FROM documents)"""


def _names(spark, sf) -> DataFrame:
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", r"^https?://([^?#]+)", 1).alias("p"))
    tails = F.array(*[F.lit(t) for t in (".txt", ".tar.gz", ".", "", "/.log")])
    name = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.element_at(tails, (F.col("doc_id") % 5 + 1).cast("int")))
    return pages.unionByName(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), name.alias("p")))


@_register("f1_path_ext", rf"WITH {_NAMES_SQL} SELECT id, p, regexp_extract(p, '(\.[^./]*)$', 1) AS ext FROM names")
def f1(spark, sf):
    return _names(spark, sf).select("id", "p", path_ext("p").alias("ext"))


@_register("f2_path_dir", f"WITH {_NAMES_SQL} SELECT id, p, CASE WHEN instr(p, '/') = 0 THEN '.' ELSE regexp_replace(p, '/[^/]*$', '') END AS dir FROM names")
def f2(spark, sf):
    return _names(spark, sf).select("id", "p", path_dir("p").alias("dir"))


@_register("f3_path_base", f"WITH {_NAMES_SQL} SELECT id, p, string_split(p, '/')[-1] AS base FROM names")
def f3(spark, sf):
    return _names(spark, sf).select("id", "p", path_base("p").alias("base"))


@_register(
    "f4_path_rel",
    f"""WITH {_NAMES_SQL} SELECT id, p, CASE WHEN starts_with(p, 'src1/') THEN substr(p, 6) ELSE p END AS rel FROM names""",
)
def f4(spark, sf):
    return _names(spark, sf).select("id", "p", path_rel("p", F.lit("src1")).alias("rel"))


@_register(
    "f5_rfc1123",
    """SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S UTC') AS shown, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS back FROM events""",
)
def f5(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", rfc1123(F.col("ts").cast("timestamp")).alias("shown"))
    return e.withColumn("back", F.unix_seconds(parse_rfc1123(F.col("shown"))))


@_register("f6_truncate_text", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS shown FROM documents")
def f6(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", truncate_text(F.col("text"), 80).alias("shown"))


@_register(
    "f7_regex_quote",
    r"""SELECT page_id, md5(regexp_replace(html, '([\\.+*?()|\[\]{}^$])', '\\\1', 'g')) AS quoted FROM pages""",
)
def f7(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", F.md5(regex_quote("html")).alias("quoted"))


@_register(
    "f8_is_regex_input",
    """SELECT doc_id, part, length(part) >= 2 AND part[1] = '/' AND part[-1] = '/' AS is_regex FROM (
       SELECT doc_id, '/' || source || ['/', '', 'x/'][CAST(doc_id % 3 AS INTEGER) + 1] AS part FROM documents)""",
)
def f8(spark, sf):
    tails = F.array(F.lit("/"), F.lit(""), F.lit("x/"))
    part = F.concat(F.lit("/"), "source", F.element_at(tails, (F.col("doc_id") % 3 + 1).cast("int")))
    return fx.table(spark, sf, "documents").select("doc_id", part.alias("part")).withColumn("is_regex", is_regex_input("part"))


# ------------------------------------------------------------ text and index

_TOKS = r"""toks AS (SELECT index_id, path, len(l) AS n_tokens, unnest(l) AS term, unnest(range(len(l))) AS pos
  FROM (SELECT index_id, path, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS l FROM docs))"""


@_register("a1_tokenize", f"WITH {DOCS_SQL}, {_TOKS} SELECT index_id, path, CAST(pos AS INTEGER) AS pos, term FROM toks")
def a1(spark, sf):
    return analyze.tokenize(fx.documents(spark, sf))


@_register(
    "a1_tokenize_stopwords",
    f"WITH {DOCS_SQL}, {_TOKS} SELECT index_id, path, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM toks WHERE term NOT IN ('the', 'of', 'and') GROUP BY ALL",
)
def a1_stop(spark, sf):
    t = analyze.tokenize(fx.documents(spark, sf), ("the", "of", "and"))
    return t.groupBy("index_id", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").cast("long").alias("pos_sum"))


@_register("a2_keyword_field", f"WITH {DOCS_SQL} SELECT index_id, path FROM docs WHERE dir IN ('src1/en', 'src10/fr')")
def a2(spark, sf):
    return analyze.keyword_field(fx.documents(spark, sf), "dir", ["src1/en", "src10/fr"]).select("index_id", "path")


@_register(
    "a3_build_postings",
    f"""WITH {DOCS_SQL}, {_TOKS} SELECT index_id, path, term, CAST(any_value(n_tokens) AS INTEGER) AS n_tokens, CAST(count(*) AS INTEGER) AS tf,
        string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM toks GROUP BY index_id, path, term""",
)
def a3(spark, sf):
    p = analyze.build_postings(fx.documents(spark, sf), 16)
    shown = F.array_join(F.col("positions").cast("array<string>"), ",")
    return p.select("index_id", "path", "term", "n_tokens", "tf", shown.alias("positions"))


@_register(
    "a4_corpus_stats",
    f"""WITH {DOCS_SQL}, {_TOKS}, dict AS (SELECT index_id, term, count(DISTINCT path) AS df FROM toks GROUP BY ALL),
        nd AS (SELECT index_id, count(*) AS n_docs FROM docs GROUP BY ALL) SELECT index_id, term, df, n_docs FROM dict JOIN nd USING (index_id)""",
)
def a4(spark, sf):
    index = fx.stored_index(spark, sf)
    return index.dictionary.join(index.stats, "index_id").select("index_id", "term", "df", "n_docs")


@_register("a5_index_metadata", f"WITH {DOCS_SQL} SELECT index_id, path, dir, ext, size, strftime(mod_time, '%Y-%m-%d %H:%M:%S') AS mod_time FROM docs")
def a5(spark, sf):
    d = analyze.index_metadata(fx.stored_index(spark, sf).documents)
    return d.withColumn("mod_time", F.date_format("mod_time", "yyyy-MM-dd HH:mm:ss"))


# ------------------------------------------------------------------- searching

K = 10
SPECS: dict[str, list[dict]] = {
    "q01_match_all": [{"query_id": "all", "kind": "match_all", "boost": 2.0}],
    "q02_term": [{"query_id": "the", "kind": "term", "text": "the"}, {"query_id": "upper", "kind": "term", "text": "The"}],
    "q03_match": [{"query_id": "match", "kind": "match", "text": "The that, the"}],
    "q04_boolean": [
        {"query_id": "bool", "occur": "must", "kind": "term", "text": "the"},
        {"query_id": "bool", "occur": "should", "kind": "term", "text": "of"},
        {"query_id": "bool", "occur": "must_not", "kind": "term", "text": "and"},
    ],
    "q04_boolean_only_not": [{"query_id": "not", "occur": "must_not", "kind": "term", "text": "the"}],
    "q05_conjunction": [{"query_id": "conj", "occur": "must", "kind": "term", "text": t} for t in ("the", "in")],
    "q06_disjunction": [{"query_id": "disj", "occur": "should", "kind": "term", "text": t} for t in ("the", "in", "zzzz")],
    "q07_regexp": [{"query_id": "regexp", "kind": "regexp", "text": "th[a-e]+"}, {"query_id": "regexp_not", "occur": "must_not", "kind": "regexp", "text": "[a-m].*"}],
    "q08_field_scope": [
        {"query_id": "ext", "occur": "must", "kind": "term", "field": "extension", "text": ".md"},
        {"query_id": "ext", "kind": "term", "text": "the"},
        {"query_id": "dir", "occur": "must", "kind": "term", "field": "dir", "text": "src3/en"},
    ],
    "q09_numeric_range": [{"query_id": "size", "occur": "must", "kind": "numeric_range", "lo": 500, "hi": 1500}, {"query_id": "open", "kind": "numeric_range", "lo": 4000}],
    "q10_date_range": [
        {"query_id": "date", "occur": "must", "kind": "date_range", "lo_ts": "2024-01-01 03:00:00", "hi_ts": "2024-01-01 09:00:00"},
        {"query_id": "date", "kind": "match", "text": "the of"},
    ],
    "q11_prefix_wildcard": [
        {"query_id": "prefix", "kind": "prefix", "text": "th"},
        {"query_id": "wild", "kind": "wildcard", "text": "th?t"},
        {"query_id": "wild_star", "kind": "wildcard", "text": "*ing"},
    ],
    "q12_fuzzy": [{"query_id": "fuzzy", "kind": "fuzzy", "text": "that", "fuzziness": 1}, {"query_id": "fuzzy2", "occur": "must", "kind": "fuzzy", "text": "wher", "fuzziness": 2}],
    "q13_phrase": [
        {"query_id": "phrase", "kind": "phrase", "text": "of the"},
        {"query_id": "mixed", "occur": "must", "kind": "phrase", "text": "in the"},
        {"query_id": "mixed", "kind": "term", "text": "that", "boost": 2.0},
    ],
    "q14_boost": [
        {"query_id": "boost", "kind": "term", "text": "the", "boost": 1.0},
        {"query_id": "boost", "kind": "term", "text": "that", "boost": 2.0},
        {"query_id": "boost", "kind": "term", "text": "les", "boost": 0.5},
    ],
}


def _specs(spark, clauses):
    import datetime as dt

    parsed = [
        {k: dt.datetime.fromisoformat(v + "+00:00") if k in ("lo_ts", "hi_ts") and isinstance(v, str) else float(v) if k in ("lo", "hi") else v for k, v in c.items()}
        for c in clauses
    ]
    return cl.query_specs(spark, parsed)


def _searcher(clauses, k, folders=None):
    def run(spark, sf):
        index = fx.stored_index(spark, sf)
        chosen = spark.createDataFrame([(f,) for f in folders], "folder string") if folders is not None else None
        return search(index, _specs(spark, clauses), chosen, k).select("query_id", "index_id", "rank", "path", "score")

    return run


for _name, _clauses in SPECS.items():
    QUERIES[_name] = _searcher(_clauses, K)
    ORACLES[_name] = search_sql(_clauses, K)

BAD = [
    {"query_id": "good", "kind": "term", "text": "the"},
    {"query_id": "blank", "kind": "match", "text": "  "},
    {"query_id": "kind", "kind": "near", "text": "x"},
    {"query_id": "occur", "occur": "maybe", "kind": "term", "text": "x"},
    {"query_id": "field", "kind": "term", "field": "author", "text": "x"},
    {"query_id": "lohi", "kind": "numeric_range", "lo": 9.0, "hi": 1.0},
    {"query_id": "nobound", "kind": "numeric_range"},
    {"query_id": "pattern", "kind": "regexp", "text": "(a"},
    {"query_id": "half", "kind": "term", "text": "the"},
    {"query_id": "half", "kind": "phrase", "text": ""},
]


@_register("q15_validate_queries", search_sql(BAD[:1], K))
def q15(spark, sf):
    """Invalid queries do not run; the valid one answers."""
    return _searcher(BAD, K)(spark, sf)


ALL_CLAUSES = [c for name in SPECS if name not in ("q01_match_all",) for c in SPECS[name]]
MATCHES = [c for name in ("q03_match", "q04_boolean", "q14_boost") for c in SPECS[name]]
FOLDERS = ["src1/en", "src10/fr", "src10/de", "src2", "src7/es"]


_WORD_SQL = "regexp_extract(lower(text), '[a-z]{5,}', 0)"


@_register(
    "q07_q11_q12_expand_batch",
    rf"""WITH {DOCS_SQL},
dict AS (SELECT index_id, term, count(DISTINCT path) AS df FROM (SELECT index_id, path, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) AS term FROM docs) GROUP BY ALL),
terms AS (SELECT term, count(*) AS n_indexes, CAST(sum(df) AS BIGINT) AS df FROM dict GROUP BY term),
w AS (SELECT item_id, {_WORD_SQL} AS w FROM benchmark),
q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, item_id % 4 AS kind, w, substr(w, 1, 2) || '.' || substr(w, 4) || '.*' AS wild,
             substr(w, 1, 3) || '[a-z]*' || substr(w, length(w) - 1) AS pattern, CASE WHEN item_id % 8 = 3 THEN 2 ELSE 1 END AS n FROM w WHERE w <> '')
SELECT query_id, term, n_indexes, df FROM terms JOIN q ON
     (kind = 0 AND regexp_full_match(term, pattern)) OR (kind = 1 AND regexp_full_match(term, wild)) OR (kind = 2 AND starts_with(term, substr(w, 1, 4)))
  OR (kind = 3 AND levenshtein(regexp_replace(term, '[^\x00-\x7F]', '~', 'g'), w) <= n)""",
)
def expand_batch(spark, sf):
    """A pattern or near spelling of a word of every benchmark item, found by the lookup tables."""
    index = fx.stored_index(spark, sf)
    items = fx.table(spark, sf, "benchmark").select("item_id", F.regexp_extract(F.lower("text"), "[a-z]{5,}", 0).alias("w")).where("w != ''")
    part = lambda first, n: F.substring("w", first, n)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("regexp", "wildcard", "prefix", "fuzzy")]), (F.col("item_id") % 4 + 1).cast("int"))
    text = (
        F.when(kind == "regexp", F.concat(part(1, 3), F.lit("[a-z]*"), F.substring("w", F.length("w") - 1, F.lit(2))))
        .when(kind == "wildcard", F.concat(part(1, 2), F.lit("?"), part(4, 1_000), F.lit("*")))
        .when(kind == "prefix", part(1, 4)).otherwise(F.col("w"))
    )
    specs = items.select(
        F.col("item_id").cast("string").alias("query_id"), F.lit(0).alias("clause_id"), kind.alias("kind"), text.alias("text"),
        F.when(F.col("item_id") % 8 == 3, 2).otherwise(1).alias("fuzziness"),
    )
    found = cl.expand_terms(index.dictionary, specs, ["query_id", "clause_id"], index.grams, index.spellings, index.buckets)
    return found.groupBy("query_id", "term").agg(F.count("*").alias("n_indexes"), F.sum("df").alias("df"))


@_register("r1_score", scored_ctes(MATCHES) + "\nSELECT query_id, index_id, path, score FROM scored")
def r1(spark, sf):
    return score_documents(fx.stored_index(spark, sf), _specs(spark, MATCHES))


@_register("r2_top_k", search_sql(MATCHES, 3))
def r2(spark, sf):
    scored = score_documents(fx.stored_index(spark, sf), _specs(spark, MATCHES))
    return rank.top_k(scored, 3).select("query_id", "index_id", "rank", "path", "score")


QUERIES["r3_search_folders"] = _searcher(ALL_CLAUSES, 1000, FOLDERS)
ORACLES["r3_search_folders"] = search_sql(ALL_CLAUSES, 1000, FOLDERS)
QUERIES["r3_search_batch"] = _searcher(ALL_CLAUSES, 1000)
ORACLES["r3_search_batch"] = search_sql(ALL_CLAUSES, 1000)


@_register("q_in_memory_match", search_sql(SPECS["q03_match"], K))
def in_memory(spark, sf):
    """The same search on tables that were never written."""
    from paperlantern.plans.index import index_in_memory

    index = index_in_memory(fx.documents(spark, sf), positions=False)
    return search(index, _specs(spark, SPECS["q03_match"]), None, K).select("query_id", "index_id", "rank", "path", "score")


# --------------------------------------------------------------------- results

_RESULTS = search_sql(MATCHES, K)
_RESULTS_CTE = scored_ctes(MATCHES) + f""",
hits AS (SELECT r.query_id, r.index_id, r.rank, r.path, '{fx.BASE_PATH}/' || r.path AS full_path, r.score, d.size, d.mod_time, d.ext
  FROM ranked r JOIN docs d USING (index_id, path) WHERE rank <= {K})"""


@_register("b3_project_results", _RESULTS_CTE + "\nSELECT query_id, index_id, rank, full_path, score, size, ext FROM hits")
def b3(spark, sf):
    hits = search(fx.stored_index(spark, sf), _specs(spark, MATCHES), None, K)
    return hits.select("query_id", "index_id", "rank", "full_path", "score", "size", "ext")


@_register(
    "b4_format_results",
    _RESULTS_CTE + """
SELECT query_id, index_id, rank,
  CASE WHEN length(b) > 30 THEN substr(b, 1, 30) || '...' ELSE b END AS file_name,
  printf('%.2f', score) AS score_text, CAST(size AS VARCHAR) AS size_text, ext,
  CASE WHEN length(full_path) > 80 THEN substr(full_path, 1, 80) || '...' ELSE full_path END AS file_path,
  strftime(mod_time, '%a, %d %b %Y %H:%M:%S UTC') AS mod_time_text
FROM (SELECT *, string_split(full_path, '/')[-1] AS b FROM hits)""",
)
def b4(spark, sf):
    return rs.format_results(search(fx.stored_index(spark, sf), _specs(spark, MATCHES), None, K))


@_register("b5_list_paths", f"WITH {DOCS_SQL} SELECT index_id, path FROM docs")
def b5(spark, sf):
    return rs.list_paths(fx.stored_index(spark, sf).documents)


@_register("b5_list_paths_all", f"WITH {DOCS_SQL} SELECT index_id, path FROM docs")
def b5_all(spark, sf):
    return rs.list_paths(fx.stored_index(spark, sf).documents, None)


@_register("b1_filter_dirs", f"WITH {DOCS_SQL} SELECT index_id, path, dir FROM docs WHERE dir IN ({', '.join(repr(f) for f in FOLDERS)})")
def b1(spark, sf):
    dirs = fo.folder_scope(spark.createDataFrame([(f,) for f in FOLDERS], "folder string"))
    return fo.filter_dirs(fx.documents(spark, sf), dirs).select("index_id", "path", "dir")


@_register(
    "u1_concat_results",
    f"""WITH {DOCS_SQL} SELECT index_id, path FROM docs UNION ALL SELECT index_id, path FROM docs WHERE dir IN ({', '.join(repr(f) for f in FOLDERS)})""",
)
def u1(spark, sf):
    docs = fx.documents(spark, sf).select("index_id", "path", "dir")
    dirs = fo.folder_scope(spark.createDataFrame([(f,) for f in FOLDERS], "folder string"))
    return rs.concat_results([docs, fo.filter_dirs(docs, dirs)]).select("index_id", "path")


# --------------------------------------------------------------- folders, stats


@_register("j1_group_folders", f"WITH {DOCS_SQL} SELECT DISTINCT f.dir AS folder, c.index_id FROM docs f JOIN (SELECT DISTINCT index_id FROM docs) c ON starts_with(f.dir, c.index_id)")
def j1(spark, sf):
    folders = fo.distinct_dirs(fx.documents(spark, sf)).select(F.col("dir").alias("folder"))
    return fo.group_folders(folders, fx.catalog(spark, sf))


_STATS_SQL = f"""WITH {DOCS_SQL}, s AS (SELECT index_id, count(*) AS documents_indexed, CAST(sum(size) AS BIGINT) AS total_size,
  CAST(floor(sum(size) / 1048576) AS BIGINT) AS total_mb FROM docs GROUP BY index_id)"""


@_register("g1_index_stats", _STATS_SQL + " SELECT s.*, documents_indexed || ' Documents Indexed of Size ' || total_mb || ' MB' AS summary FROM s")
def g1(spark, sf):
    s = stats.index_stats(fx.stored_index(spark, sf).documents)
    return s.join(stats.stats_text(s), "index_id")


@_register("g2_distinct_dirs", f"WITH {PAGE_DIRS_SQL} SELECT DISTINCT index_id, dir FROM page_dirs WHERE dir <> '.'")
def g2(spark, sf):
    return fo.distinct_dirs(fx.page_dirs(spark, sf))


_TREE_SQL = f"""WITH {PAGE_DIRS_SQL}, parts AS (
  SELECT DISTINCT list_filter(string_split(dir, '/'), lambda x: x <> '') AS p FROM page_dirs WHERE dir <> '.'),
nodes AS (
  SELECT DISTINCT array_to_string(p[1:d], '/') AS node, array_to_string(p[1:d-1], '/') AS parent, p[d] AS name, CAST(d AS INTEGER) AS depth
  FROM (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM parts)),
tree AS (
  SELECT n.*, CAST((SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS BIGINT) AS n_children FROM nodes n)"""


def _tree(spark, sf):
    return fo.folder_tree(fo.distinct_dirs(fx.page_dirs(spark, sf)))


@_register("g3_folder_tree", _TREE_SQL + " SELECT node, parent, name, depth, n_children FROM tree")
def g3(spark, sf):
    return _tree(spark, sf)


@_register("g4_folder_children", _TREE_SQL + " SELECT node, name, n_children > 0 AS has_children FROM tree WHERE parent = ''")
def g4(spark, sf):
    return fo.folder_children(_tree(spark, sf))


@_register("b2_exclude_folders", _TREE_SQL + " SELECT node FROM tree WHERE node NOT IN (SELECT node FROM tree WHERE depth = 1 AND n_children > 1)")
def b2(spark, sf):
    tree = _tree(spark, sf)
    return fo.exclude_folders(tree, tree.where("depth = 1 AND n_children > 1")).select("node")


# --------------------------------------------------------------------- preview

PREVIEW = [
    {"query_id": "p1", "occur": "must", "kind": "term", "text": "the"},
    {"query_id": "p1", "occur": "should", "kind": "match", "text": "of"},
    {"query_id": "p1", "occur": "must_not", "kind": "term", "text": "zzz"},
    {"query_id": "p2", "occur": "should", "kind": "regexp", "text": "th[a-e]+"},
    {"query_id": "p2", "occur": "must_not", "kind": "term", "text": "and"},
]
# What the highlighted terms come to, spelled for an engine with an ASCII \b.
_PATTERNS_SQL = r"""patterns(query_id, pattern) AS (VALUES ('p1', '(?i)\bthe\b|(?i)\bof\b'), ('p2', '(?i)th[a-e]+\b'))"""
_HITS_SQL = scored_ctes(PREVIEW) + f""",
{_PATTERNS_SQL},
hits AS (SELECT r.*, d.content FROM ranked r JOIN docs d USING (index_id, path)),
lines AS (
  SELECT query_id, index_id, path, CAST(i - 1 AS INTEGER) AS row_id, l[i] AS line
  FROM (SELECT query_id, index_id, path, l, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT query_id, index_id, path, list_filter(string_split(content, chr(10)), lambda x: x <> '') AS l FROM hits))),
cut AS (
  SELECT query_id, index_id, path, row_id, line, string_split_regex(regexp_replace(line, pattern, chr(1) || '\\0' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']') AS p
  FROM lines JOIN patterns USING (query_id)),
raw AS (SELECT query_id, index_id, path, row_id, len(p) AS n, unnest(p) AS text, unnest(range(len(p))) AS i FROM cut),
pieces AS (
  SELECT query_id, index_id, path, row_id, text, i % 2 = 1 AS is_match, CAST(row_number() OVER w - 1 AS INTEGER) AS seg_id,
    CAST(coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
  FROM raw WHERE i % 2 = 1 OR text <> '' OR i = n - 1
  WINDOW w AS (PARTITION BY query_id, index_id, path, row_id ORDER BY i)),
matches AS (
  SELECT query_id, index_id, path, row_id, start, CAST(start + length(text) AS INTEGER) AS "end", seg_id, text,
    CAST(row_number() OVER (PARTITION BY query_id, index_id, path ORDER BY row_id, start) - 1 AS INTEGER) AS match_no
  FROM pieces WHERE is_match)"""
_HITS_SQL = _HITS_SQL.replace(r"'\\0'", r"'\0'")


def _segments(spark, sf):
    specs = _specs(spark, PREVIEW)
    hits = score_documents(fx.stored_index(spark, sf), specs)
    return pv.preview(hits, fx.documents(spark, sf), specs)


_TALK_SQL = """SELECT CAST(conv_id AS VARCHAR) AS query_id, turn, text,
  CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 ELSE 2 END AS g FROM conversations"""


def _talk(spark, sf) -> DataFrame:
    """Every conversation as a query: what users say should, answers must match."""
    occur = F.when(F.col("role") == "user", "should").when(F.col("role") == "assistant", "must").otherwise("must_not")
    return fx.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("query_id"), F.col("turn").cast("int").alias("clause_id"), occur.alias("occur"),
        F.lit("match").alias("kind"), "text",
    )


def _joined_terms(terms: DataFrame) -> DataFrame:
    return terms.select("query_id", F.size("terms").alias("n"), F.md5(F.array_join("terms", "|")).alias("digest"))


@_register(
    "p1_search_terms",
    f"""SELECT query_id, CAST(count(text) FILTER (g < 2) AS INTEGER) AS n,
        md5(coalesce(string_agg(text, '|' ORDER BY g, turn, text) FILTER (g < 2), '')) AS digest FROM ({_TALK_SQL}) GROUP BY query_id""",
)
def p1(spark, sf):
    return _joined_terms(pv.search_terms(_talk(spark, sf)))


@_register(
    "p1_search_terms_compat",
    f"""SELECT query_id, CAST(count(text) FILTER (g < 2 OR s) AS INTEGER) AS n,
        md5(coalesce(string_agg(text, '|' ORDER BY g, turn, text) FILTER (g < 2 OR s), '')) AS digest
        FROM (SELECT *, bool_or(g = 1) OVER (PARTITION BY query_id) AS s FROM ({_TALK_SQL})) GROUP BY query_id""",
)
def p1_compat(spark, sf):
    return _joined_terms(pv.search_terms(_talk(spark, sf), compat=True))


@_register("p2_highlight_pattern", _HITS_SQL + """ SELECT query_id, index_id, path, len(regexp_extract_all(content, pattern)) AS n
  FROM hits JOIN patterns USING (query_id)""")
def p2(spark, sf):
    """The pattern as a column, as a preview uses it, on every hit."""
    specs = _specs(spark, PREVIEW)
    patterns = pv.search_terms(specs).select("query_id", pv.highlight_pattern("terms").alias("pattern"))
    hits = score_documents(fx.stored_index(spark, sf), specs).select(*pv.DOC).join(patterns, "query_id")
    docs = fx.documents(spark, sf).select("index_id", "path", "content").join(hits, ["index_id", "path"])
    return docs.select(*pv.DOC, F.regexp_count("content", F.col("pattern")).cast("long").alias("n"))


@_register(
    "p3_preview_lines",
    f"""WITH {DOCS_SQL}, l AS (SELECT index_id, path, list_filter(string_split(content, chr(10)), lambda x: x <> '') AS l FROM docs)
        SELECT index_id, path, CAST(i - 1 AS INTEGER) AS row_id, md5(l[i]) AS digest FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)""",
)
def p3(spark, sf):
    lines = pv.preview_lines(fx.documents(spark, sf).select("index_id", "path", "content"))
    return lines.select("index_id", "path", "row_id", F.md5("line").alias("digest"))


@_register("p4_match_locations", _HITS_SQL + ' SELECT query_id, index_id, path, match_no, row_id, start, "end", seg_id, text FROM matches')
def p4(spark, sf):
    return pv.match_locations(_segments(spark, sf)).select(*pv.DOC, "match_no", "row_id", "start", "end", "seg_id", "text")


@_register("p5_highlight_segments", _HITS_SQL + " SELECT query_id, index_id, path, row_id, seg_id, md5(text) AS digest, is_match FROM pieces")
def p5(spark, sf):
    s = pv.segment_rows(_segments(spark, sf))
    return s.select(*pv.DOC, "row_id", "seg_id", F.md5("text").alias("digest"), "is_match")


@_register(
    "p6_nth_match",
    _HITS_SQL
    + """, counts AS (SELECT query_id, index_id, path, CAST(count(*) AS INTEGER) AS n_matches FROM matches GROUP BY ALL)
SELECT m.query_id, m.index_id, m.path, m.match_no, m.row_id, m.start, CAST(m.match_no + 1 AS INTEGER) AS label, c.n_matches
FROM matches m JOIN counts c USING (query_id, index_id, path) WHERE m.match_no = greatest(0, least(7, c.n_matches - 1))""",
)
def p6(spark, sf):
    matches = pv.match_locations(_segments(spark, sf))
    wanted = matches.select(*pv.DOC).distinct().withColumn("n", F.lit(7))
    return pv.nth_match(matches, wanted).select(*pv.DOC, "match_no", "row_id", "start", "label", "n_matches")


# --------------------------------------------------------------------- changes

_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
_ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@_register("c1_normalize_changes", f"WITH {DOCS_SQL}, {CHANGES_SQL} SELECT index_id, path, op, event_id, {_TS} AS ts FROM changes")
def c1(spark, sf):
    return fx.changes(spark, sf).select("index_id", "path", "op", "event_id", _ts("ts").alias("ts"))


_BATCH_SQL = f"""WITH {DOCS_SQL}, {CHANGES_SQL}, gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 300 SECONDS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS begins
  FROM changes WINDOW w AS (PARTITION BY index_id ORDER BY ts)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY index_id ORDER BY ts) AS b FROM gaps),
batches AS (SELECT *, min(ts) OVER (PARTITION BY index_id, b) AS batch_start FROM numbered)"""


@_register(
    "c2_debounce",
    _BATCH_SQL + " SELECT index_id, path, op, event_id, strftime(batch_start, '%Y-%m-%d %H:%M:%S.%f') AS batch_start FROM batches",
)
def c2(spark, sf):
    d = ch.debounce(fx.changes(spark, sf), 300)
    return d.select("index_id", "path", "op", "event_id", _ts("batch_start").alias("batch_start"))


@_register(
    "c2_quiet_periods",
    _BATCH_SQL
    + """ SELECT index_id, strftime(batch_start, '%Y-%m-%d %H:%M:%S.%f') AS batch_start,
  strftime(max(ts) + INTERVAL 300 SECONDS, '%Y-%m-%d %H:%M:%S.%f') AS batch_end, count(*) AS n_changes FROM batches GROUP BY index_id, batch_start""",
)
def c2_periods(spark, sf):
    q = ch.quiet_periods(fx.changes(spark, sf), 300)
    return q.select("index_id", _ts("batch_start").alias("batch_start"), _ts("batch_end").alias("batch_end"), "n_changes")


@_register("c3_last_change", f"WITH {DOCS_SQL}, {CHANGES_SQL}, {LAST_SQL} SELECT index_id, path, op, event_id, {_TS} AS ts FROM final")
def c3(spark, sf):
    return ch.last_change(fx.changes(spark, sf)).select("index_id", "path", "op", "event_id", _ts("ts").alias("ts"))


@_register(
    "c4_c5_live_documents",
    f"""WITH {DOCS_SQL}, {CHANGES_SQL}, {LAST_SQL} SELECT d.index_id, d.path, d.size, strftime(coalesce(f.ts, d.mod_time), '%Y-%m-%d %H:%M:%S.%f') AS mod_time
        FROM docs d LEFT JOIN final f USING (index_id, path) WHERE coalesce(f.op, '') <> 'delete'""",
)
def c4(spark, sf):
    live = live_documents(fx.documents(spark, sf), fx.changes(spark, sf))
    return live.select("index_id", "path", "size", _ts("mod_time").alias("mod_time"))


@_register(
    "c6_expand_dir_events",
    f"""WITH {DOCS_SQL}, {CHANGES_SQL},
     e AS (SELECT index_id, CASE WHEN event_id % 3 = 0 THEN path ELSE regexp_replace(path, '/[^/]*$', '') END AS path, op, max(ts) AS ts, max(event_id) AS event_id
           FROM changes GROUP BY ALL)
     SELECT e.index_id, coalesce(d.path, e.path) AS path, e.op, e.event_id
     FROM e LEFT JOIN docs d ON e.op <> 'delete' AND d.index_id = e.index_id AND starts_with(d.path, e.path || '/')""",
)
def c6(spark, sf):
    """Events on files and on folders, deletes among both."""
    name = F.when(F.col("event_id") % 3 == 0, F.col("path")).otherwise(path_dir("path"))
    c = fx.changes(spark, sf).groupBy("index_id", name.alias("path"), "op").agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    return ch.expand_dir_events(c, fx.documents(spark, sf).select("index_id", "path")).select("index_id", "path", "op", "event_id")


@_register(
    "c7_byte_batches",
    f"""WITH {DOCS_SQL}, s AS (SELECT index_id, path, size, CAST(('0x' || substr(md5(path), 1, 8))::BIGINT % 16 AS BIGINT) AS slice FROM docs),
     r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY slice ORDER BY path, index_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
     SELECT index_id, path, size, slice, CAST(floor(before / 65536) AS BIGINT) AS batch_no FROM r""",
)
def c7(spark, sf):
    b = ch.byte_batches(fx.documents(spark, sf).select("index_id", "path", "size"), 65536, 16)
    return b.select("index_id", "path", "size", F.col("slice").cast("long").alias("slice"), "batch_no")


@_register(
    "c8_snapshot_diff",
    f"""WITH {DOCS_SQL}, {CHANGES_SQL}, {LAST_SQL},
     after AS (
       SELECT d.index_id, CASE WHEN f.op = 'create' THEN d.path || '.new' ELSE d.path END AS path, d.size + CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN f.op = 'update' THEN f.ts ELSE d.mod_time END AS mod_time
       FROM docs d LEFT JOIN final f USING (index_id, path) WHERE coalesce(f.op, '') <> 'delete'),
     diff AS (
       SELECT coalesce(o.index_id, n.index_id) AS index_id, coalesce(o.path, n.path) AS path,
         CASE WHEN o.path IS NULL THEN 'create' WHEN n.path IS NULL THEN 'delete' WHEN o.size <> n.size OR o.mod_time <> n.mod_time THEN 'update' END AS op
       FROM docs o FULL JOIN after n ON o.index_id = n.index_id AND o.path = n.path)
     SELECT * FROM diff WHERE op IS NOT NULL""",
)
def c8(spark, sf):
    """Old: all documents.  New: what the event log leaves, creates under a new name, some sizes changed."""
    docs = fx.documents(spark, sf).select("index_id", "path", "size", "mod_time", F.regexp_extract("path", r"/([0-9]+)\.[a-z]+$", 1).cast("long").alias("doc_id"))
    last = ch.last_change(fx.changes(spark, sf)).select("index_id", "path", "op", "ts")
    after = docs.join(last, ["index_id", "path"], "left").where(F.col("op").isNull() | (F.col("op") != "delete"))
    after = after.select(
        "index_id", F.when(F.col("op") == "create", F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"),
        (F.col("size") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"),
        F.when(F.col("op") == "update", F.col("ts")).otherwise(F.col("mod_time")).alias("mod_time"),
    )
    return ch.snapshot_diff(docs, after)


@_register("c10_remove_folder", f"WITH {DOCS_SQL} SELECT index_id, path FROM docs WHERE NOT (dir = 'src1' OR starts_with(dir, 'src1/'))")
def c10(spark, sf):
    docs = fx.documents(spark, sf)
    gone = ch.below_folder(docs, "src1").select("index_id", "path")
    return docs.join(gone, ["index_id", "path"], "left_anti").select("index_id", "path")
