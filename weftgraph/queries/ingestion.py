"""Queries of ingestion, security rules, storage operations and streams over the code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import GRAPH_SQL, edges, meta_sql, nodes
from weftgraph.operators import ingest as I
from weftgraph.operators import security as X
from weftgraph.sources import scan as C
from weftgraph.sources import store as O
from weftgraph.streaming import feed as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(sql: str | None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return deco


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """``repo, path, language, text`` of the stored files."""
    f = nodes(spark, d, ["id", "ord", "repo", "kind", "file_path", "content"], ["file"])
    return f.select("repo", F.col("file_path").alias("path"), C.language_of(F.col("file_path")).alias("language"), F.col("content").alias("text"))


_EXT = "regexp_extract(file_path, '\\.([^./]+)$', 1)"
_FILES = f"files AS (SELECT id, repo, file_path, content, {_EXT} AS ext FROM nodes WHERE kind = 'file' AND content IS NOT NULL)"
_TRIM = "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LINES = f"{_FILES}, lines AS (SELECT repo, file_path, ext, {_TRIM} AS s FROM (SELECT repo, file_path, ext, unnest(string_split(content, chr(10))) AS line FROM files))"


@_register(f"WITH {GRAPH_SQL} SELECT file_path AS path FROM nodes WHERE kind = 'file' AND NOT (list_contains(string_split(file_path, '/'), 'tests') OR regexp_matches(file_path, '^.*[.]min[.]js$') OR starts_with(file_path, 'quarry-core/shared/'))")
def s2_exclusions(spark, d):
    f = nodes(spark, d, ["id", "ord", "kind", "file_path"], ["file"])
    return f.where(~C.exclusion(F.col("file_path"), ["tests", "*.min.js", "quarry-core/shared"])).select(F.col("file_path").alias("path"))


@_register(f"""WITH {GRAPH_SQL}, p AS (SELECT DISTINCT file_path FROM nodes WHERE kind = 'file'), a AS (SELECT string_split(file_path, '/') AS l FROM p), k AS (SELECT l, unnest(range(1, len(l))) AS i FROM a),
d AS (SELECT DISTINCT array_to_string(list_slice(l, 1, i), '/') AS file_path FROM k) SELECT 'directory' AS kind, file_path FROM d UNION ALL SELECT 'file', file_path FROM p""")
def s4_structure(spark, d):
    f = nodes(spark, d, ["id", "ord", "kind", "file_path"], ["file"]).select(F.col("file_path").alias("path")).distinct()
    return C.structure(f).select("kind", "file_path")


@_register(f"WITH {GRAPH_SQL}, gone AS (SELECT id FROM nodes WHERE file_path = 'quarry-core/shared/log/emit.ts') SELECT source, kind, target FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)")
def s9_delete_file(spark, d):
    """The edges left after one file is deleted."""
    gone = spark.createDataFrame([("quarry-core/shared/log/emit.ts",)], "file_path string")
    return O.delete_files(nodes(spark, d, ["id", "ord", "file_path"]), edges(spark, d).select("source", "kind", "target"), gone)[1]


@_register(f"WITH {GRAPH_SQL} SELECT source, kind, target FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)")
def s6_persistable_edges(spark, d):
    return O.drop_dangling(nodes(spark, d, ["id"]), edges(spark, d).select("source", "kind", "target"))


_PY = f"""py AS (SELECT DISTINCT repo, file_path, CASE WHEN regexp_matches(s, '^(?:async\\s+)?def\\s+__\\w+') THEN 'method' WHEN regexp_matches(s, '^(?:async\\s+)?def\\s+\\w+') THEN 'function' ELSE 'class' END AS kind,
 coalesce(nullif(regexp_extract(s, '^(?:async\\s+)?def\\s+(\\w+)', 1), ''), regexp_extract(s, '^class\\s+(\\w+)', 1)) AS name FROM lines WHERE ext IN ('py', 'pyi') AND regexp_matches(s, '^(?:(?:async\\s+)?def|class)\\s+\\w+'))"""
_GO = """go_ AS (SELECT DISTINCT repo, file_path, CASE WHEN regexp_matches(s, '^func\\s+\\w+\\s*\\(') THEN 'function' WHEN regexp_matches(s, '^func\\s+\\([^)]+\\)\\s+\\w+\\s*\\(') THEN 'method' WHEN regexp_matches(s, '^type\\s+\\w+\\s+struct\\b') THEN 'struct' WHEN regexp_matches(s, '^type\\s+\\w+\\s+interface\\b') THEN 'interface' END AS kind,
 coalesce(nullif(regexp_extract(s, '^func\\s+(\\w+)\\s*\\(', 1), ''), nullif(regexp_extract(s, '^func\\s+\\([^)]+\\)\\s+(\\w+)\\s*\\(', 1), ''), regexp_extract(s, '^type\\s+(\\w+)', 1)) AS name FROM lines WHERE ext = 'go')"""
_RUBY = "rb AS (SELECT DISTINCT repo, file_path, CASE WHEN starts_with(s, 'class') THEN 'class' WHEN starts_with(s, 'module') THEN 'module' ELSE 'method' END AS kind, regexp_extract(s, '^(?:class|module|def)\\s+(?:self\\.)?(\\w+)', 1) AS name FROM lines WHERE ext = 'rb' AND regexp_matches(s, '^(?:class\\s+\\w|module\\s+\\w|def\\s+(?:self\\.)?\\w)'))"


@_register(f"WITH {GRAPH_SQL}, {_LINES}, {_PY}, {_GO}, {_RUBY} SELECT repo, file_path AS path, kind, name FROM (SELECT * FROM py UNION ALL SELECT * FROM go_ WHERE kind IS NOT NULL UNION ALL SELECT * FROM rb) GROUP BY ALL")
def i2_symbols_line_languages(spark, d):
    """Symbols of all files in the languages whose declarations start a line: Python, Go and Ruby."""
    return I.parse(source_files(spark, d)).where(F.col("language").isin("python", "go", "ruby")).select("repo", "path", "kind", "name").distinct()


@_register(f"""WITH {GRAPH_SQL}, {_LINES}, {_PY}, {_GO}, {_RUBY} SELECT repo, file_path AS path, kind, name, CASE lang WHEN 'py' THEN NOT starts_with(name, '_') WHEN 'go' THEN name[1] = upper(name[1]) ELSE true END AS exported
FROM (SELECT *, 'py' AS lang FROM py UNION ALL SELECT *, 'go' FROM go_ WHERE kind IS NOT NULL UNION ALL SELECT *, 'rb' FROM rb) GROUP BY ALL""")
def i3_exported(spark, d):
    """What is visible outside, by the rules of Python, Go and Ruby."""
    return I.parse(source_files(spark, d)).where(F.col("language").isin("python", "go", "ruby")).select("repo", "path", "kind", "name", "exported").distinct()


@_register(None)
def i2_symbols(spark, d):
    return I.parse(source_files(spark, d)).select("repo", "path", "kind", "name", "start_line", "end_line", "exported")


@_register(None)
def i1_signatures(spark, d):
    """Python symbols from the syntax tree, with parameters, return type, documentation and decorators."""
    joined = F.when(F.col("parameters").isNotNull(), F.array_join("parameters", ", "))
    return I.signatures(source_files(spark, d)).withColumn("parameters", joined).withColumn("decorators", F.array_join("decorators", ", "))


def _read(spark, d):
    f = source_files(spark, d)
    return (f, *I.parse_and_extract(f))


_IMPORTS = r"""SELECT DISTINCT repo, file_path AS path, name FROM (SELECT repo, file_path, CASE
 WHEN ext IN ('ts', 'mts', 'js', 'mjs') THEN regexp_extract(replace(s, chr(65279), ''), '^import\s.*\sfrom\s+[''"]([^''"]+)[''"]', 1)
 WHEN ext = 'py' THEN coalesce(nullif(regexp_extract(s, '^from\s+([\w.]+)\s+import\s', 1), ''), regexp_extract(s, '^import\s+([\w.]+)', 1))
 WHEN ext = 'java' THEN regexp_extract(s, '^import\s+([\w.]+)', 1) WHEN ext = 'go' THEN regexp_extract(s, '^import\s+"([^"]+)"', 1) WHEN ext = 'rs' THEN regexp_extract(s, '^use\s+([\w:]+)', 1)
 WHEN ext IN ('c', 'h') THEN regexp_extract(s, '^#include\s*[<"]([^>"]+)[>"]', 1) WHEN ext = 'rb' THEN regexp_extract(s, '^require(?:_relative)?\s+''([^'']+)''', 1) END AS name FROM lines) WHERE name <> ''"""


@_register(f"WITH {GRAPH_SQL}, {_LINES} {_IMPORTS}")
def i4_import_statements(spark, d):
    """What the files of all languages name in their imports."""
    return _read(spark, d)[2].where("fact = 'import'").select("repo", "path", "name").distinct()


@_register(None)
def i4_imports(spark, d):
    f, _, facts = _read(spark, d)
    return I.resolve_imports(facts, f)


@_register(None)
def i6_call_sites(spark, d):
    return _read(spark, d)[2].where("fact = 'call'").select("repo", "path", "name", "other", "line", "owner_kind", "owner", I.call_class(F.col("other"), F.col("name")).alias("call_kind"))


@_register(None)
def i7_calls(spark, d):
    _, symbols, facts = _read(spark, d)
    return I.resolve_calls(facts, symbols)


@_register(None)
def i8_heritage(spark, d):
    _, symbols, facts = _read(spark, d)
    return I.resolve_heritage(facts, symbols)


@_register(None)
def i9_tiered_calls(spark, d):
    f, symbols, facts = _read(spark, d)
    imports = I.resolve_imports(facts, f)
    return I.resolve_calls(facts, symbols, imports, I.resolve_bindings(facts, imports))


@_register(None)
def i11_bindings(spark, d):
    f, _, facts = _read(spark, d)
    return I.resolve_bindings(facts, I.resolve_imports(facts, f))


@_register(f"WITH {GRAPH_SQL} SELECT id, substring(sha256(content), 1, 16) AS code_hash FROM nodes WHERE kind IN ('function', 'class', 'method', 'interface') AND content IS NOT NULL")
def i13_summary_candidates(spark, d):
    n = nodes(spark, d, ["id", "ord", "kind", "content"])
    return I.summary_candidates(n, n.where("false").select("id", F.lit("").alias("code_hash"))).select("id", "code_hash")


@_register("""WITH a AS (SELECT file_path AS path, max(indexed_at) AS m, count(*) AS n FROM code_nodes WHERE kind = 'file' AND file_path IS NOT NULL GROUP BY 1),
b AS (SELECT file_path AS path, max(indexed_at) AS m, count(*) AS n FROM code_nodes WHERE kind = 'file' AND file_path IS NOT NULL AND indexed_at < TIMESTAMP '2031-05-01 00:00:00' GROUP BY 1)
SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.m IS DISTINCT FROM b.m OR a.n <> b.n THEN 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE b.path IS NULL OR a.m IS DISTINCT FROM b.m OR a.n <> b.n""")
def i15_file_changes(spark, d):
    """What changed in the index since May: the manifest then against the manifest now."""
    from weftgraph.tables import load

    f = load(spark, d, "code_nodes").where("kind = 'file' and file_path is not null").select(F.col("file_path").alias("path"), "indexed_at")
    manifest = lambda x: x.groupBy("path").agg(F.count("*").alias("length"), F.max("indexed_at").alias("modified"))
    return I.file_changes(manifest(f.where("indexed_at < timestamp_ntz'2031-05-01 00:00:00'")), manifest(f))


def _signals(spark, d):
    return X.signals(source_files(spark, d))


@_register(None)
def d7_signals(spark, d):
    return _signals(spark, d)


def _any(names: list[str]) -> str:
    return "|".join(n.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)") for n in names)


_NO_TEXT = r"""regexp_replace(replace(s0, chr(65279), ''), '"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|`[^`]*`', '""', 'g')"""
_CODE_LINES = rf"""{_FILES}, ln AS (SELECT repo, file_path, line, {_TRIM} AS s FROM (SELECT repo, file_path, line, s0, {_NO_TEXT} AS txt FROM (SELECT repo, file_path, unnest(l) AS s0, CAST(generate_subscripts(l, 1) AS BIGINT) AS line
 FROM (SELECT repo, file_path, string_split(content, chr(10)) AS l FROM files WHERE ext IN ('go', 'java', 'rs', 'c', 'h', 'rb'))))),
 g AS (SELECT repo, file_path, line, regexp_extract_all(s, '([\w$]+(?:(?:\.|->|::)[\w$]+)*)\s*\(\s*(?:[^)\s]|$)', 1) AS c FROM ln WHERE NOT (starts_with(s, '//') OR starts_with(s, '#') OR starts_with(s, 'import ')))""".replace("trim(line,", "trim(txt,")
_SINKS = " UNION ALL ".join(f"SELECT repo, file_path AS path, line, '{t}' AS type, list_filter(c, lambda x : regexp_matches(x, '(?i){_any(n)}'))[1] AS sink FROM g" for t, n in X.GENERIC_SINKS.items())
_SINKS += rf" UNION ALL SELECT repo, file_path, line, 'COMMAND_INJECTION', regexp_extract(list_filter(c, lambda x : regexp_matches(x, '(?i)(?:^|[^\w])(?:{_any(X.GENERIC_COMMANDS)})$'))[1], '(?i)({_any(X.GENERIC_COMMANDS)})$', 1) FROM g"


@_register(f"WITH {GRAPH_SQL}, {_CODE_LINES} SELECT DISTINCT path, type, sink FROM ({_SINKS}) WHERE sink IS NOT NULL")
def d7_sinks(spark, d):
    """Which sinks each file calls, statements of several lines included."""
    return _signals(spark, d).select("path", "type", "sink").distinct()


_CALLED = rf"""{_FILES}, flat AS (SELECT file_path, ext, regexp_replace(content, '(?s)/\*.*?\*/|\"\"\".*?\"\"\"|`[^`]*`', '""', 'g') AS text FROM files WHERE ext IN ('go', 'java', 'rs', 'c', 'h', 'rb', 'py', 'ts', 'mts', 'js', 'mjs')),
 whole AS (SELECT file_path, ext, unnest(string_split(text, chr(10))) AS s0 FROM flat), bare AS (SELECT file_path, regexp_replace({_NO_TEXT}, CASE WHEN ext IN ('py', 'rb') THEN '#.*$' ELSE '//.*$' END, '', 'g') AS s FROM whole),
 c AS (SELECT file_path AS path, unnest(regexp_extract_all(s, '(?:\w+\s+)?[\w$@]+(?:(?:\.|->|::)[\w$@]+)*\s*\(')) AS m FROM bare WHERE NOT starts_with(ltrim(s), '#')),
 k AS (SELECT path, regexp_extract(m, '^(\w+)\s+[\w$@]', 1) AS word, regexp_extract(m, '([\w$@]+(?:(?:\.|->|::)[\w$@]+)*)\s*\($', 1) AS chain FROM c)"""
_WORDS = ", ".join(f"'{w}'" for w in I.NO_CALLS)
_DECL = ", ".join(f"'{w}'" for w in sorted(I.DECLARERS))


@_register(rf"""WITH {GRAPH_SQL}, {_CALLED} SELECT DISTINCT path, regexp_extract(chain, '([\w$@]+)$', 1) AS name FROM k
WHERE word NOT IN ({_DECL}) AND regexp_extract(chain, '([\w$@]+)$', 1) NOT IN ({_WORDS}) AND regexp_extract(chain, '^([\w$@]+)', 1) NOT IN ({_WORDS})""")
def i6_called_names(spark, d):
    """The names each file calls, those in strings and comments aside."""
    return _read(spark, d)[2].where("fact = 'call'").select("path", "name").distinct()


@_register(f"""WITH {GRAPH_SQL}, {_CODE_LINES}, k AS (SELECT repo, path, line, type, sink FROM ({_SINKS}) WHERE sink IS NOT NULL),
o AS (SELECT k.path, k.type, k.sink, k.line, max_by(n.id, (n.start_line, n.id)) AS node_id FROM k LEFT JOIN nodes n ON n.kind IN ('function', 'method') AND n.repo = k.repo AND n.file_path = k.path AND n.start_line <= k.line AND (n.end_line IS NULL OR k.line <= n.end_line) GROUP BY 1, 2, 3, 4)
SELECT DISTINCT path, type, sink, node_id FROM o""")
def d9_attached_signals(spark, d):
    fns = nodes(spark, d, ["id", "ord", "repo", "kind", "file_path", "start_line", "end_line"], ["function", "method"])
    return X.attach(_signals(spark, d), fns).select("path", "type", "sink", "node_id").distinct()


@_register(None)
def d10_findings(spark, d):
    return X.findings(_signals(spark, d)).select("path", "line", "type", "sink", "severity", "cwe")


_HITS = " UNION ALL ".join(
    f"SELECT id, file_path, start_line, ord, '{t}' AS type, '{s}' AS severity, name AS symbol FROM nodes WHERE kind IN ('function', 'method', 'file') AND regexp_matches(name, '{X.NAME_SINKS[t]}') AND ({c})"
    for t, s, c in [
        ("SQL_INJECTION", "MEDIUM", f"id IN (SELECT target FROM edges WHERE kind = 'calls') OR {meta_sql('hasStringConcatenation')} = 'true'"), ("XSS", "HIGH", "true"),
        *[(t, "HIGH", f"{meta_sql(k)} = 'true'") for t, k in (("SSRF", "dynamicUrl"), ("PATH_TRAVERSAL", "dynamicPath"), ("COMMAND_INJECTION", "dynamicArgs"))],
    ]
)


@_register(f"""WITH {GRAPH_SQL}, hits AS ({_HITS} UNION ALL SELECT n.id, n.file_path, n.start_line, n.ord, 'XSS', 'HIGH', n.name FROM nodes n WHERE n.id IN (SELECT e.source FROM edges e JOIN nodes t ON t.id = e.target WHERE e.kind = 'calls' AND regexp_matches(t.name, '{X.NAME_SINKS["XSS"]}')))
SELECT min(id) AS id, type, min(severity) AS severity, symbol FROM hits GROUP BY type, file_path, start_line, symbol""")
def d11_name_findings(spark, d):
    return X.name_findings(nodes(spark, d, ["id", "ord", "kind", "name", "file_path", "start_line", "metadata"]), edges(spark, d, ["calls"])).select("id", "type", "severity", "symbol")


_RULES = " UNION ALL ".join(f"SELECT id, line, '{n}' AS pattern, '{s}' AS severity FROM ln WHERE regexp_matches(text, '{p}')" for n, p, s in X.SECRET_PATTERNS)


@_register(rf"""WITH {GRAPH_SQL}, f AS (SELECT id, string_split(content, chr(10)) AS l FROM nodes WHERE kind = 'file' AND content IS NOT NULL AND NOT regexp_matches(file_path, '\.test\.|\.spec\.|_test\.|__tests__|(^|/)Test[^/]*\.java$|Test\.php$|(^|/)((?i)test_[^/]*\.py)$|((?i)_test\.py)$|((?i)_spec\.rb)$')),
ln AS (SELECT id, unnest(l) AS text, CAST(generate_subscripts(l, 1) AS BIGINT) AS line FROM f) {_RULES}""")
def d16_secret_patterns(spark, d):
    f = nodes(spark, d, ["id", "ord", "kind", "file_path", "content"], ["file"])
    return X.secrets(f).where("pattern <> 'named-secret'")


@_register(None)
def d16_secrets(spark, d):
    return X.secrets(nodes(spark, d, ["id", "ord", "kind", "file_path", "content"], ["file"]))


# ---------------------------------------------------------------- streams over events

_LIMIT = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@_register(f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_LIMIT}""")
def w6_tumbling(spark, d):
    return W.windowed_counts(spark, f"{d}/events.parquet").select(F.date_format("began", "yyyy-MM-dd").alias("began"), "event_type", "n", "total")


@_register(f"""WITH s AS (SELECT *, unnest([0, 1]) AS k FROM events), w AS (SELECT date_trunc('day', ts) + (CASE WHEN hour(ts) >= 12 THEN 12 ELSE 0 END - 12 * k) * INTERVAL 1 HOUR AS began, event_type, value FROM s)
SELECT strftime(began, '%Y-%m-%d %H') AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY w.began, event_type HAVING w.began + INTERVAL 1 DAY <= {_LIMIT}""")
def w6_sliding(spark, d):
    out = W.windowed_counts(spark, f"{d}/events.parquet", "1 day", "12 hours")
    return out.select(F.date_format("began", "yyyy-MM-dd HH").alias("began"), "event_type", "n", "total")


@_register("SELECT DISTINCT event_id, user_id FROM events")
def w6_distinct(spark, d):
    return W.distinct_events(spark, f"{d}/events.parquet")


@_register("""WITH g AS (SELECT repo, indexed_at, CASE WHEN lag(indexed_at) OVER (PARTITION BY repo ORDER BY indexed_at) + INTERVAL 1 HOUR > indexed_at THEN 0 ELSE 1 END AS first FROM code_nodes WHERE indexed_at IS NOT NULL AND repo IS NOT NULL),
s AS (SELECT repo, indexed_at, sum(first) OVER (PARTITION BY repo ORDER BY indexed_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT repo, strftime(min(indexed_at), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY repo, k""")
def w2_sessions(spark, d):
    """Bursts of indexing per repo: rows that follow each other within an hour."""
    from weftgraph.tables import load

    r = load(spark, d, "code_nodes").where("indexed_at is not null and repo is not null").select("repo", F.col("indexed_at").cast("timestamp").alias("at"))
    return r.groupBy("repo", F.session_window("at", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("repo", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@_register("""WITH e AS (SELECT user_id AS job, ts AS t0, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS what FROM events WHERE user_id IS NOT NULL),
l AS (SELECT job, max(t0) AS t1, max_by(what, (t0, what)) AS last, count(*) FILTER (WHERE what = 'failed') AS f FROM e GROUP BY job)
SELECT job, CASE WHEN last = 'succeeded' THEN 'success' WHEN last = 'cancelled' THEN 'cancelled' WHEN last = 'failed' AND f > 3 THEN 'dead' WHEN last = 'failed' THEN 'failed' WHEN last = 'started' AND date_diff('second', t1, TIMESTAMP '2024-01-30 23:58:00') > 1800 THEN 'dead' WHEN last = 'started' THEN 'running' ELSE 'pending' END AS status FROM l""")
def w5_job_status(spark, d):
    """The events of a user read as those of a job."""
    from weftgraph.tables import load

    what = F.create_map(*[F.lit(x) for x in ("view", "queued", "click", "started", "purchase", "succeeded", "error", "failed")])
    e = load(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.coalesce(F.try_element_at(what, F.col("event_type")), F.lit("cancelled")).alias("what"))
    return W.job_status(e, "2024-01-30 23:58:00").select("job", "status")
