"""Queries of the graph language, lookups and traversals over the code graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.graph import GRAPH_SQL, edges, first_named, meta, meta_sql, nodes
from weftgraph.operators import lookup as L
from weftgraph.operators import reach as R
from weftgraph.plans import gql

_SLIM = ["id", "repo", "ord", "kind", "name", "file_path", "start_line", "exported"]
_META = [*_SLIM, "metadata"]
HUB = "emitEvent"
START = "startService"


def _gql(text: str, part: str, columns: list[str] | None = None):
    def query(spark: SparkSession, d: str) -> DataFrame:
        kind = getattr(gql.parse(text), "kind", "*")
        result = gql.run(text, nodes(spark, d, _META, None if kind == "*" else [kind]), edges(spark, d))
        if isinstance(result, gql.GqlError):
            raise ValueError(result.message)
        df = getattr(result, part)
        return df.select(*columns) if columns else df

    return query


_FIND_COLUMNS = ["id", "kind", "name", "file_path", "exported"]
QUERIES = {
    "q1_find_kind": _gql("FIND class", "matched", _FIND_COLUMNS),
    "q1_find_page": _gql("FIND * LIMIT 100 OFFSET 40", "nodes", _FIND_COLUMNS),
    "q2_find_metadata": _gql('FIND file WHERE language = "Python"', "matched", _FIND_COLUMNS),
    "q3_find_equal": _gql('FIND function WHERE exported = "TRUE" AND name STARTS_WITH "load"', "matched", _FIND_COLUMNS),
    "q4_find_not_equal": _gql('FIND * WHERE language != "python"', "matched", _FIND_COLUMNS),
    "q5_find_contains": _gql('FIND function WHERE name CONTAINS "token" AND filePath STARTS_WITH "quarry"', "matched", _FIND_COLUMNS),
    "q6_find_in": _gql('FIND * WHERE kind IN ["struct", "Interface", "enum"]', "matched", _FIND_COLUMNS),
    "q9_count": _gql('COUNT function WHERE exported = "true"', "groups"),
    "q10_count_by_kind": _gql("COUNT * GROUP BY kind", "groups"),
    "q10_count_by_language": _gql("COUNT file GROUP BY language", "groups"),
    "q10_count_by_exported": _gql("COUNT * GROUP BY exported", "groups"),
    "q11_traverse_in": _gql(f"TRAVERSE CALLS FROM {HUB} DEPTH 2 INCOMING", "nodes", ["id", "kind", "name", "depth"]),
    "q11_traverse_edges": _gql(f"TRAVERSE CALLS FROM {HUB} DEPTH 3 BOTH", "edges"),
    "q11_traverse_out": _gql("TRAVERSE IMPORTS FROM 'all.ts'", "nodes", ["id", "kind", "name", "depth"]),
}

_SEL = "SELECT id, kind, name, file_path, exported FROM nodes"
_LANG = f"lower({meta_sql('language')})"


def _bfs(seed: str, step: str, hops: int) -> str:
    """Least depth of every node within ``hops``; ``step`` is a query of (src, dst)."""
    return f"""walk AS (SELECT id, 0 AS depth FROM ({seed}) UNION SELECT s.dst, w.depth + 1 FROM walk w JOIN ({step}) s ON s.src = w.id WHERE w.depth < {hops}),
found AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


def _named(name: str) -> str:
    return f"SELECT id FROM nodes WHERE name = '{name}' ORDER BY ord, id LIMIT 1"


_IN_CALLS = "SELECT target AS src, source AS dst FROM edges WHERE kind = 'calls' AND source IN (SELECT id FROM nodes)"
_BOTH_CALLS = "SELECT target AS src, source AS dst FROM edges WHERE kind = 'calls' AND source IN (SELECT id FROM nodes) UNION SELECT source, target FROM edges WHERE kind = 'calls' AND target IN (SELECT id FROM nodes)"
_OUT_IMPORTS = "SELECT source AS src, target AS dst FROM edges WHERE kind = 'imports' AND target IN (SELECT id FROM nodes)"
SQL = {
    "q1_find_kind": f"WITH {GRAPH_SQL} {_SEL} WHERE kind = 'class'",
    "q1_find_page": f"WITH {GRAPH_SQL} {_SEL} ORDER BY ord, id LIMIT 100 OFFSET 40",
    "q2_find_metadata": f"WITH {GRAPH_SQL} {_SEL} WHERE kind = 'file' AND {_LANG} = 'python'",
    "q3_find_equal": f"WITH {GRAPH_SQL} {_SEL} WHERE kind = 'function' AND exported AND starts_with(lower(name), 'load')",
    "q4_find_not_equal": f"WITH {GRAPH_SQL} {_SEL} WHERE {_LANG} <> 'python'",
    "q5_find_contains": f"WITH {GRAPH_SQL} {_SEL} WHERE kind = 'function' AND contains(lower(name), 'token') AND starts_with(lower(file_path), 'quarry')",
    "q6_find_in": f"WITH {GRAPH_SQL} {_SEL} WHERE lower(kind) IN ('struct', 'interface', 'enum')",
    "q9_count": f"WITH {GRAPH_SQL} SELECT 'total' AS key, count(*) AS count FROM nodes WHERE kind = 'function' AND exported HAVING count(*) > 0",
    "q10_count_by_kind": f"WITH {GRAPH_SQL} SELECT coalesce(kind, '(none)') AS key, count(*) AS count FROM nodes GROUP BY 1",
    "q10_count_by_language": f"WITH {GRAPH_SQL} SELECT coalesce({meta_sql('language')}, '(none)') AS key, count(*) AS count FROM nodes WHERE kind = 'file' GROUP BY 1",
    "q10_count_by_exported": f"WITH {GRAPH_SQL} SELECT coalesce(CAST(exported AS VARCHAR), '(none)') AS key, count(*) AS count FROM nodes GROUP BY 1",
    "q11_traverse_in": f"WITH RECURSIVE {GRAPH_SQL}, {_bfs(_named(HUB), _IN_CALLS, 2)} SELECT n.id, n.kind, n.name, f.depth FROM found f JOIN nodes n ON n.id = f.id",
    "q11_traverse_edges": f"""WITH RECURSIVE {GRAPH_SQL}, {_bfs(_named(HUB), _BOTH_CALLS, 3)}, inner_ AS (SELECT id FROM found WHERE depth < 3)
SELECT source, kind, target FROM edges WHERE kind = 'calls' AND (source IN (SELECT id FROM inner_) OR target IN (SELECT id FROM inner_))""",
    "q11_traverse_out": f"WITH RECURSIVE {GRAPH_SQL}, {_bfs(_named('all.ts'), _OUT_IMPORTS, 5)} SELECT n.id, n.kind, n.name, f.depth FROM found f JOIN nodes n ON n.id = f.id",
}


def _register(sql: str | None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return deco


# ---------------------------------------------------------------- paths and closures

_UNDIRECTED = "SELECT source AS src, target AS dst FROM edges WHERE target IN (SELECT id FROM nodes) UNION SELECT target, source FROM edges WHERE source IN (SELECT id FROM nodes)"
_CALLS_IMPORTS = ["calls", "imports"]
_CALLERS = "SELECT target AS src, source AS dst FROM edges WHERE kind IN ('calls', 'imports')"
_AROUND = "SELECT source AS src, target AS dst FROM edges WHERE kind IN ('calls', 'imports') UNION SELECT target, source FROM edges WHERE kind IN ('calls', 'imports')"


@_register(f"WITH RECURSIVE {GRAPH_SQL}, {_bfs(_named('bootstrap'), _UNDIRECTED, 4)} SELECT CAST(depth AS INTEGER) AS length FROM found WHERE id = ({_named(HUB)}) AND depth > 0")
def q12_path_length(spark, d):
    return gql.run(f"PATH FROM bootstrap TO {HUB}", nodes(spark, d, _META), edges(spark, d)).path.select("length")


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, {_bfs(_named('all.ts'), "SELECT source AS src, target AS dst FROM edges WHERE kind IN ('calls', 'imports')", 8)}
SELECT CAST(depth AS INTEGER) AS hops FROM found WHERE id = ({_named('index.ts')})""")
def g3_find_path(spark, d):
    return L.find_path(nodes(spark, d, _SLIM), edges(spark, d, _CALLS_IMPORTS), "all.ts", "index.ts")


@_register(f"WITH RECURSIVE {GRAPH_SQL}, {_bfs(_named(HUB), _AROUND, 2)} SELECT count(*) AS n_affected, CASE WHEN count(*) > 10 THEN 'HIGH' WHEN count(*) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM found")
def g8_blast_radius(spark, d):
    return L.blast_radius(nodes(spark, d, _SLIM), edges(spark, d, _CALLS_IMPORTS), HUB, "both", 2)


@_register(f"WITH RECURSIVE {GRAPH_SQL}, {_bfs(_named(HUB), _AROUND, 5)} SELECT id, depth FROM found WHERE depth > 0")
def g9_blast_radius_nodes(spark, d):
    seed = first_named(nodes(spark, d, _SLIM), HUB).select("id")
    return R.reach(seed, R.steps_of(edges(spark, d, _CALLS_IMPORTS), direction="both"), 5).where("depth > 0")


@_register(f"WITH RECURSIVE {GRAPH_SQL}, {_bfs(_named(HUB), _CALLERS, 5)} SELECT count(*) AS n_affected, CASE WHEN count(*) > 10 THEN 'HIGH' WHEN count(*) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM found")
def g10_impact(spark, d):
    return L.blast_radius(nodes(spark, d, _SLIM), edges(spark, d, _CALLS_IMPORTS), HUB, "in", 5)


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, goal AS ({_named(HUB)}),
back AS (SELECT id, 0 AS d FROM goal UNION SELECT e.source, b.d + 1 FROM back b JOIN edges e ON e.target = b.id WHERE b.d < 5), near AS (SELECT id, min(d) AS d FROM back GROUP BY 1),
w AS (SELECT id AS cur, [id] AS path, CAST([] AS BIGINT[]) AS o, 0 AS h, CAST(NULL AS VARCHAR) AS last_kind FROM ({_named('all.ts')})
 UNION ALL SELECT e.target, list_append(w.path, e.target), list_append(w.o, e.ord), w.h + 1, e.kind FROM w JOIN edges e ON e.source = w.cur JOIN near n ON n.id = e.target WHERE w.h < 5 AND n.d <= 4 - w.h AND NOT list_contains(w.path, e.target) AND w.cur NOT IN (SELECT id FROM goal))
SELECT h AS n, array_to_string(path, ' > ') AS path, last_kind FROM (SELECT * FROM w WHERE h > 0 AND cur IN (SELECT id FROM goal) ORDER BY h, o LIMIT 10)""")
def g4_relationship_paths(spark, d):
    n = nodes(spark, d, _SLIM)
    return R.all_paths(first_named(n, "all.ts").select("id"), first_named(n, HUB).select("id"), edges(spark, d), hops=5, limit=10).select("n", F.concat_ws(" > ", "path").alias("path"), "last_kind")


@_register(f"""WITH {GRAPH_SQL} SELECT DISTINCT a.target AS id FROM edges a JOIN edges b ON a.target = b.target AND a.kind = 'imports' AND b.kind = 'imports'
WHERE a.source = ({_named('all.ts')}) AND b.source = ({_named('index.ts')})""")
def g5_shared_imports(spark, d):
    return L.shared_imports(nodes(spark, d, _SLIM), edges(spark, d, ["imports"]), "all.ts", "index.ts")


@_register(f"""WITH {GRAPH_SQL} SELECT a.name AS child, b.name AS parent, e.kind FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind IN ('extends', 'implements')""")
def g6_heritage(spark, d):
    return L.heritage(nodes(spark, d, ["id", "ord", "name"]), edges(spark, d, ["extends", "implements"]))


@_register(f"""WITH {GRAPH_SQL} SELECT name FROM (SELECT name, min(ord) AS o FROM nodes WHERE starts_with(lower(name), 'e') OR contains(lower(name), 'emitevnt') GROUP BY name) ORDER BY o, name LIMIT 5""")
def g7_suggestions(spark, d):
    return L.suggestions(nodes(spark, d, ["id", "ord", "name"]), "emitEvnt", 5)


# ---------------------------------------------------------------- lookups and services


@_register(f"WITH {GRAPH_SQL} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def sv1_overview(spark, d):
    return L.overview(nodes(spark, d, ["id", "kind"]), edges(spark, d))


@_register(f"""WITH {GRAPH_SQL}, me AS ({_named(HUB)})
SELECT 'callers' AS relation, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'calls' AND e.target IN (SELECT id FROM me)
UNION ALL SELECT 'callees', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'calls' AND e.source IN (SELECT id FROM me)
UNION ALL SELECT 'imports', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'imports' AND e.source IN (SELECT id FROM me)
UNION ALL SELECT 'importedBy', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'imports' AND e.target IN (SELECT id FROM me)
UNION ALL SELECT 'heritage', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind IN ('extends', 'implements') AND e.source IN (SELECT id FROM me)
UNION ALL SELECT 'members', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'has_member' AND e.source IN (SELECT id FROM me)
UNION ALL SELECT 'cluster', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'belongs_to' AND e.source IN (SELECT id FROM me)""")
def sv2_inspect(spark, d):
    return L.inspect(nodes(spark, d, ["id", "ord", "name"]), edges(spark, d), HUB)


ALL_FILE = "file:quarry-core/shared/registry/all.ts:all.ts"


@_register(f"""WITH {GRAPH_SQL}, me AS (SELECT id FROM nodes WHERE id = '{ALL_FILE}')
SELECT 'callers' AS relation, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'calls' AND e.target IN (SELECT id FROM me)
UNION ALL SELECT 'callees', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'calls' AND e.source IN (SELECT id FROM me)
UNION ALL SELECT 'imports', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'imports' AND e.source IN (SELECT id FROM me)
UNION ALL SELECT 'importedBy', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'imports' AND e.target IN (SELECT id FROM me)
UNION ALL SELECT 'heritage', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind IN ('extends', 'implements') AND e.source IN (SELECT id FROM me)
UNION ALL SELECT 'members', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'has_member' AND e.source IN (SELECT id FROM me)
UNION ALL SELECT 'cluster', n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'belongs_to' AND e.source IN (SELECT id FROM me)""")
def sv3_node_detail(spark, d):
    return L.node_detail(nodes(spark, d, ["id", "ord", "name"]), edges(spark, d), ALL_FILE)


@_register(f"WITH {GRAPH_SQL} SELECT id, kind, name, start_line FROM nodes WHERE contains(file_path, 'shared/') ORDER BY coalesce(start_line, 0), ord, id LIMIT 200 OFFSET 5")
def sv4_file_symbols(spark, d):
    return L.file_symbols(nodes(spark, d, _SLIM), "shared/", limit=200, offset=5).select("id", "kind", "name", "start_line")


@_register(f"WITH {GRAPH_SQL} SELECT id, kind, name FROM nodes WHERE exported AND kind = 'class' ORDER BY ord, id LIMIT 100")
def sv5_list_exports(spark, d):
    return L.list_exports(nodes(spark, d, _SLIM), "class", limit=100).select("id", "kind", "name")


@_register(f"WITH {GRAPH_SQL} SELECT id, name FROM nodes WHERE kind = 'route' OR (kind = 'function' AND regexp_matches(lower(file_path), 'route|handler|controller'))")
def sv6_routes(spark, d):
    return L.routes(nodes(spark, d, ["id", "kind", "name", "file_path"])).select("id", "name")


@_register(f"WITH {GRAPH_SQL} SELECT id, kind, name FROM nodes ORDER BY ord, id LIMIT 200 OFFSET 100")
def sv9_graph_page(spark, d):
    return L.page(nodes(spark, d, _SLIM), 200, 100).select("id", "kind", "name")


@_register(f"""WITH {GRAPH_SQL}, l AS (SELECT id, ord, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM nodes WHERE kind = 'file' AND content IS NOT NULL)
SELECT id, CAST(line AS BIGINT) AS line, text FROM l WHERE regexp_matches(lower(text), 'todo.*device') ORDER BY ord, id, line LIMIT 100""")
def sv10_grep(spark, d):
    return L.grep(nodes(spark, d, ["id", "ord", "kind", "content"], ["file"]), "todo.*device", 100)


@_register(f"""WITH {GRAPH_SQL} SELECT f.id, array_to_string(list_slice(string_split(f.content, chr(10)), 1, 30), chr(10)) AS text FROM nodes f WHERE f.kind = 'file' AND f.content IS NOT NULL""")
def sv11_source_window(spark, d):
    return L.source_window(nodes(spark, d, ["id", "ord", "kind", "content"], ["file"]), 5, 10, 20)


@_register(f"""WITH {GRAPH_SQL} SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_matches(lower(file_path), '(^|/)(src|lib|app|cmd|pkg|internal)(/|$)') THEN 0 ELSE 1 END, file_path, start_line NULLS FIRST, kind, id) AS INTEGER) AS rank
FROM nodes WHERE name = 'split_turbine' AND NOT regexp_matches(lower(file_path), '(^|/)(dist|build|coverage|generated|gen|fixtures?|__fixtures__|mocks?|__mocks__|bench|benches|benchmark|benchmarks|eval|test|tests|__tests__|spec|specs)(/|$)')""")
def sv12_resolve_symbol(spark, d):
    return L.resolve_symbol(nodes(spark, d, _SLIM), "split_turbine").where("intent in ('main', 'unknown')").select("id", "rank")


@_register(f"""WITH {GRAPH_SQL}, n AS (SELECT repo, count(*) AS n_nodes FROM nodes GROUP BY repo), e AS (SELECT s.repo, count(*) AS n_edges FROM edges x JOIN nodes s ON s.id = x.source GROUP BY s.repo)
SELECT n.repo, n_nodes, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN e ON e.repo IS NOT DISTINCT FROM n.repo""")
def sv15_topology(spark, d):
    return L.topology(nodes(spark, d, ["id", "repo"]), edges(spark, d))


@_register("SELECT repo_id, name, CASE WHEN indexed_at IS NULL THEN 'UNKNOWN' WHEN date_diff('minute', indexed_at, TIMESTAMP '2031-07-01 00:00:00') > 1440 THEN 'STALE' ELSE 'FRESH' END AS status FROM repos")
def sv14_group_status(spark, d):
    from weftgraph.tables import load

    return L.freshness(load(spark, d, "repos"), "2031-07-01 00:00:00").select("repo_id", "name", "status")


@_register(f"""WITH {GRAPH_SQL} SELECT source AS id, count(*) AS n_out FROM edges GROUP BY source ORDER BY n_out DESC, id LIMIT 50""")
def s13_cache_warm(spark, d):
    return L.warm_set(edges(spark, d), 50)


@_register(f"""WITH {GRAPH_SQL}, hit AS (SELECT * FROM nodes WHERE name = '{HUB}') SELECT h.id, h.kind, (SELECT count(*) FROM edges WHERE source = h.id) AS n_out, (SELECT count(*) FROM edges WHERE target = h.id) AS n_in FROM hit h""")
def q16_legacy(spark, d):
    return gql.legacy(f"MATCH (n) WHERE n.name = '{HUB}' RETURN n", nodes(spark, d, _SLIM), edges(spark, d)).select("id", "kind", "n_out", "n_in")


_EXTRA = [("!", "%21"), ("''", "%27"), ("(", "%28"), (")", "%29"), ("*", "%2A")]
_ENCODED = "url_encode(file_path)"
for _c, _x in _EXTRA:
    _ENCODED = f"replace({_ENCODED}, '{_x}', '{_c}')"


@_register(f"WITH {GRAPH_SQL} SELECT DISTINCT {_ENCODED} AS encoded, file_path AS decoded FROM nodes WHERE file_path IS NOT NULL")
def x14_uri_components(spark, d):
    encoded = T.uri_encode(F.col("file_path"))
    return nodes(spark, d, ["id", "file_path"]).where("file_path is not null").select(encoded.alias("encoded"), T.uri_decode(encoded).alias("decoded")).distinct()
