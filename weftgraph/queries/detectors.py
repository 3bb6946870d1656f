"""Queries of the detectors, components, flows and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions.text import INTENT_RULES, TEST_FILE
from weftgraph.graph import EDGES_SQL, GRAPH_SQL, edges, meta, meta_sql, nodes
from weftgraph.operators import components as C
from weftgraph.operators import detect as D
from weftgraph.operators import flows as W
from weftgraph.operators import lookup as L
from weftgraph.operators.reach import steps_of
from weftgraph.queries.graph import _named

QUERIES: dict = {}
SQL: dict[str, str] = {}
_SLIM = ["id", "ord", "kind", "name", "file_path", "exported"]
_CALLS_IMPORTS = ["calls", "imports"]
CLUSTER = "quarry-core/shared"


def _register(sql: str | None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return deco


_DEAD = f"""SELECT id FROM nodes WHERE exported AND kind IN ('function', 'class', 'method', 'interface') AND NOT regexp_matches(lower(file_path), 'test|spec|__test')
AND NOT regexp_matches(lower(name), '^(main|index|bootstrap|server|app)$') AND coalesce({meta_sql('deprecated')}, 'false') <> 'true'
AND id NOT IN (SELECT source FROM edges WHERE kind = 'step_of' UNION SELECT target FROM edges WHERE kind = 'step_of') AND id NOT IN (SELECT target FROM edges WHERE kind IN ('calls', 'imports'))"""
_ORPHAN = r"""SELECT id FROM nodes WHERE kind = 'file' AND NOT regexp_matches(lower(file_path), '\.(d\.ts|config\.[tj]s|fixture|mock)$') AND NOT regexp_matches(lower(file_path), '[/\\](tests?|__tests__)[/\\]')
AND id NOT IN (SELECT source FROM edges WHERE kind = 'imports' UNION SELECT target FROM edges WHERE kind = 'imports')"""
_GOD = """SELECT n.id, coalesce(m.n, 0) AS n_methods, coalesce(c.n, 0) AS n_callers FROM nodes n
LEFT JOIN (SELECT e.source AS id, count(*) AS n FROM edges e JOIN nodes t ON t.id = e.target AND t.kind IN ('method', 'constructor') WHERE e.kind = 'has_member' GROUP BY 1) m ON m.id = n.id
LEFT JOIN (SELECT target AS id, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1) c ON c.id = n.id WHERE n.kind = 'class'"""
_SCC = """er AS (SELECT source AS src, target AS dst FROM edges WHERE kind = '{kind}' AND source <> target{extra}),
cl AS (SELECT src, dst FROM er UNION SELECT c.src, e.dst FROM cl c JOIN er e ON e.src = c.dst),
pair AS (SELECT a.src AS id, a.dst AS other FROM cl a JOIN cl b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst),
comp AS (SELECT id, least(id, min(other)) AS component, count(*) + 1 AS size FROM pair GROUP BY id)"""
_FILES = " AND source IN (SELECT id FROM nodes WHERE kind = 'file') AND target IN (SELECT id FROM nodes WHERE kind = 'file')"


def _import_cycles(spark, d):
    files = nodes(spark, d, ["id", "kind"], ["file"])
    steps = steps_of(edges(spark, d, ["imports"]))
    steps = steps.join(files.select(F.col("id").alias("src")), "src", "left_semi").join(files.select(F.col("id").alias("dst")), "dst", "left_semi")
    return C.strong_components(steps.select("src", "dst"))


@_register(f"WITH RECURSIVE {GRAPH_SQL}, {_SCC.format(kind='imports', extra=_FILES)} SELECT id, component, size FROM comp")
def c1_import_cycles(spark, d):
    return _import_cycles(spark, d)


@_register(f"WITH RECURSIVE {GRAPH_SQL}, {_SCC.format(kind='calls', extra='')} SELECT id, component, size FROM comp")
def c1_call_cycles(spark, d):
    return C.strong_components(steps_of(edges(spark, d, ["calls"])))


@_register(f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT DISTINCT source AS src, target AS dst FROM edges WHERE kind = 'extends'), ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
cl AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM cl c JOIN e ON e.src = c.dst), cyc AS (SELECT src AS id FROM cl WHERE src = dst), bad AS (SELECT id FROM cyc UNION SELECT dst FROM cl WHERE src IN (SELECT id FROM cyc)),
walk AS (SELECT id, 0 AS layer FROM ids WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.layer + 1 FROM walk w JOIN e ON e.src = w.id WHERE e.dst NOT IN (SELECT id FROM bad)),
top AS (SELECT id, max(layer) AS layer FROM walk GROUP BY 1) SELECT i.id, t.layer FROM ids i LEFT JOIN top t USING (id)""")
def c4_extends_layers(spark, d):
    return C.layers(steps_of(edges(spark, d, ["extends"])))


@_register(f"WITH {GRAPH_SQL} {_DEAD}")
def h1_dead_code(spark, d):
    return D.dead_code(nodes(spark, d, [*_SLIM, "metadata"]), edges(spark, d, ["step_of", "calls", "imports"]), meta("deprecated") == "true").select("id")


@_register(f"WITH {GRAPH_SQL} {_ORPHAN}")
def h2_orphan_files(spark, d):
    return D.orphan_files(nodes(spark, d, _SLIM), edges(spark, d, ["imports"])).select("id")


@_register(f"""WITH {GRAPH_SQL}, g AS ({_GOD}) SELECT id, n_methods, n_callers, concat_ws(', ', CASE WHEN n_methods > 3 THEN n_methods || ' methods' END, CASE WHEN n_callers > 5 THEN n_callers || ' callers' END) AS reason
FROM g WHERE n_methods > 3 OR n_callers > 5""")
def h3_god_classes(spark, d):
    """At lower limits than the defaults, so that the tables hold cases."""
    return D.god_classes(nodes(spark, d, ["id", "ord", "kind"]), edges(spark, d, ["has_member", "calls"]), methods=3, callers=5)


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, {_SCC.format(kind='imports', extra=_FILES)},
k AS (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM ({_DEAD})) AS n_dead, (SELECT count(DISTINCT component) FROM comp) AS n_cycles, (SELECT count(*) FROM ({_GOD}) WHERE n_methods > 20 OR n_callers > 50) AS n_god, (SELECT count(*) FROM ({_ORPHAN})) AS n_orphan),
s AS (SELECT *, greatest(0.0, least(100.0, 100 - 100 * (CAST(0.5 AS DOUBLE) * n_dead + 5 * n_cycles + 2 * n_god + n_orphan) / greatest(n_nodes, 1))) AS raw FROM k)
SELECT n_nodes, n_dead, n_cycles, n_god, n_orphan, round(raw, 6) AS score, CASE WHEN round(raw, 6) >= 80 THEN 'green' WHEN round(raw, 6) >= 60 THEN 'amber' ELSE 'red' END AS grade FROM s""")
def h5_health_score(spark, d):
    n, e = nodes(spark, d, [*_SLIM, "metadata"]), edges(spark, d)
    return D.health_score(n, D.dead_code(n, e, meta("deprecated") == "true"), C.cycle_count(_import_cycles(spark, d)), D.god_classes(n, e), D.orphan_files(n, e))


@_register(f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE NOT coalesce(exported, false) AND kind IN ('function', 'method', 'class') AND id NOT IN (SELECT target FROM edges) ORDER BY ord, id LIMIT 20")
def r1_dead_scoped(spark, d):
    return D.dead_scoped(nodes(spark, d, _SLIM), edges(spark, d)).select("id")


@_register(f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE NOT coalesce(exported, false) AND kind IN ('function', 'method', 'class') AND id NOT IN (SELECT target FROM edges WHERE kind NOT IN ('contains', 'has_member'))")
def r1_dead_scoped_uncontained(spark, d):
    """All of them, not counting the links from a container to its members."""
    e = edges(spark, d).where(~F.col("kind").isin("contains", "has_member"))
    return D.dead_scoped(nodes(spark, d, _SLIM), e, limit=None).select("id")


@_register(f"WITH {GRAPH_SQL} SELECT n.id, count(*) AS n_out FROM nodes n JOIN edges e ON e.source = n.id GROUP BY n.id, n.ord HAVING count(*) > 10 ORDER BY n_out DESC, n.ord, n.id LIMIT 10")
def r2_god_nodes(spark, d):
    return D.god_nodes(nodes(spark, d, _SLIM), edges(spark, d))


@_register(f"""WITH {GRAPH_SQL} SELECT file_path FROM (SELECT file_path, min(ord) AS o, max(CASE WHEN id IN (SELECT source FROM edges UNION SELECT target FROM edges) THEN 1 ELSE 0 END) AS linked
FROM nodes WHERE file_path IS NOT NULL GROUP BY 1) WHERE linked = 0 ORDER BY o, file_path LIMIT 10""")
def r3_orphan_paths(spark, d):
    return D.orphan_paths(nodes(spark, d, _SLIM), edges(spark, d))


@_register(None)
def r4_hotspots_sketched(spark, d):
    """The estimated form, which also holds on graphs whose exact pairs do not fit."""
    return D.hotspots(nodes(spark, d, _SLIM), edges(spark, d, _CALLS_IMPORTS), sketched=True)


def _all_radius(hops: int) -> str:
    return f"""er AS (SELECT DISTINCT target AS src, source AS dst FROM edges WHERE kind IN ('calls', 'imports')),
cl AS (SELECT id AS origin, id, 0 AS depth FROM seeds UNION SELECT c.origin, e.dst, c.depth + 1 FROM cl c JOIN er e ON e.src = c.id WHERE c.depth < {hops}),
radius AS (SELECT origin AS id, count(DISTINCT id) - 1 AS n FROM cl GROUP BY origin)"""


@_register(f"WITH RECURSIVE {GRAPH_SQL}, seeds AS (SELECT id FROM nodes), {_all_radius(5)} SELECT id, n AS blast_radius FROM radius ORDER BY n DESC, id LIMIT 5")
def r4_hotspots(spark, d):
    return D.hotspots(nodes(spark, d, _SLIM), edges(spark, d, _CALLS_IMPORTS))


@_register(f"""WITH {GRAPH_SQL}, c AS (SELECT n.id, least(50, 1 + count(e.target) // 2) AS cyclomatic FROM nodes n LEFT JOIN edges e ON e.source = n.id AND e.kind = 'calls' WHERE n.kind IN ('function', 'method') GROUP BY n.id)
SELECT id, CAST(cyclomatic AS BIGINT) AS cyclomatic, CAST(ceil(cyclomatic * CAST(1.3 AS DOUBLE)) AS BIGINT) AS cognitive, CASE WHEN cyclomatic > 20 THEN 'CRITICAL' WHEN cyclomatic > 10 THEN 'HIGH' WHEN cyclomatic > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c""")
def d1_complexity(spark, d):
    return D.complexity(nodes(spark, d, ["id", "ord", "kind"], ["function", "method"]), edges(spark, d, ["calls"]))


_COUNT = " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in [r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b", r"\bcase\b", r"\bcatch\b", "&&", r"\|\|", r"\?[^?]|\?$"])


@_register(f"""WITH {GRAPH_SQL}, c AS (SELECT id, 1 + {_COUNT} AS cyclomatic FROM nodes WHERE kind IN ('function', 'method') AND content IS NOT NULL)
SELECT id, CAST(cyclomatic AS BIGINT) AS cyclomatic, CAST(ceil(cyclomatic * CAST(1.3 AS DOUBLE)) AS BIGINT) AS cognitive FROM c""")
def d2_text_complexity(spark, d):
    return D.text_complexity(nodes(spark, d, ["id", "ord", "kind", "content"], ["function", "method"]))


_DEP = f"""SELECT id, name, file_path FROM nodes WHERE contains(coalesce({meta_sql('jsdoc')}, ''), '@deprecated') OR contains(coalesce({meta_sql('comment')}, ''), '@deprecated') OR contains(coalesce({meta_sql('doc')}, ''), '@deprecated')
OR {meta_sql('deprecated')} = 'true' OR """ + " OR ".join(f"contains(name, '{a}')" for a in D.DEPRECATED_APIS)


@_register(f"WITH {GRAPH_SQL} {_DEP}")
def d3_deprecated(spark, d):
    return D.deprecated(nodes(spark, d, ["id", "ord", "name", "file_path", "metadata"])).select("id", "name", "file_path")


@_register(f"""WITH {GRAPH_SQL}, t AS (SELECT DISTINCT target AS id FROM edges WHERE kind = 'deprecated_use')
SELECT DISTINCT t.id, u.caller FROM t LEFT JOIN (SELECT e.target, n.id AS caller FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind IN ('calls', 'deprecated_use')) u ON u.target = t.id""")
def d4_deprecated_usage(spark, d):
    """Of everything that has a deprecated use."""
    e = edges(spark, d, ["calls", "deprecated_use"])
    found = e.where("kind = 'deprecated_use'").select(F.col("target").alias("id")).distinct()
    return D.deprecated_usage(found, nodes(spark, d, ["id", "ord", "file_path"]), e)


_TESTS = TEST_FILE.replace("(?i:", "(")
_STEM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '\.test\.[^.]+$', ''), '\.spec\.[^.]+$', ''), '_test\.[^.]+$', ''), '_test$', '')"
_COVER = rf"""subj AS (SELECT id, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]+$', '') AS stem FROM nodes WHERE exported AND kind IN ('function', 'method', 'class')),
tests AS (SELECT id, regexp_extract(file_path, '([^/]*)$', 1) AS b FROM nodes WHERE regexp_matches(file_path, '{_TESTS}')),
stems AS (SELECT {_STEM} AS s FROM tests UNION SELECT regexp_replace(b, 'Test\.php$', '') FROM tests WHERE b LIKE '%Test.php' UNION SELECT regexp_replace(regexp_replace(b, '^test_', ''), '\.py$', '') FROM tests WHERE regexp_matches(lower(b), '^test_.*\.py$')
 UNION SELECT regexp_replace(b, '_test\.py$', '') FROM tests WHERE regexp_matches(lower(b), '_test\.py$') UNION SELECT regexp_replace(b, '_spec\.rb$', '') FROM tests WHERE regexp_matches(lower(b), '_spec\.rb$')),
tested AS (SELECT source AS id FROM edges WHERE kind = 'tested_by' AND target IN (SELECT id FROM nodes) UNION SELECT target FROM edges WHERE kind = 'imports' AND source IN (SELECT id FROM tests) UNION SELECT id FROM subj WHERE stem IN (SELECT s FROM stems))"""


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, {_COVER}, seeds AS (SELECT id FROM subj), {_all_radius(3)}
SELECT s.id, s.id IN (SELECT id FROM tested) AS tested, r.n AS blast_radius, CASE WHEN r.n > 20 THEN 'HIGH' WHEN r.n >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM subj s JOIN radius r ON r.id = s.id""")
def d6_coverage(spark, d):
    return D.coverage(nodes(spark, d, _SLIM), edges(spark, d, ["tested_by", "imports", "calls"]))


@_register(f"""WITH {GRAPH_SQL}, {_COVER} SELECT count(*) AS n_exported, CAST(sum(CASE WHEN id IN (SELECT id FROM tested) THEN 1 ELSE 0 END) AS BIGINT) AS n_tested,
CAST(floor(sum(CASE WHEN id IN (SELECT id FROM tested) THEN 1 ELSE 0 END) / count(*) * 100 + 0.5) AS BIGINT) AS pct FROM subj""")
def d6_coverage_summary(spark, d):
    return D.coverage_summary(D.coverage(nodes(spark, d, _SLIM), edges(spark, d, ["tested_by", "imports", "calls"])))


@_register(f"""WITH {GRAPH_SQL}, m AS (SELECT e.source AS owner, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target AND n.kind = 'method' WHERE e.kind = 'has_member')
SELECT DISTINCT a.id AS child_method, b.id AS parent_method FROM edges x JOIN m a ON a.owner = x.source JOIN m b ON b.owner = x.target AND b.name = a.name WHERE x.kind = 'extends'""")
def d17_overrides(spark, d):
    return D.overrides(nodes(spark, d, ["id", "ord", "kind", "name"]), edges(spark, d, ["has_member", "extends"]))


_TESTLIKE = "(" + " OR ".join(f"regexp_matches(lower(file_path), '{r}')" for n, r in INTENT_RULES if n in ("fixture", "bench", "test")) + f") AND NOT regexp_matches(lower(file_path), '{INTENT_RULES[0][1]}')"


def _entry_sql(words, places):
    return f"""SELECT id, score FROM (SELECT n.id, (CASE WHEN n.id NOT IN (SELECT target FROM edges WHERE kind = 'calls') AND n.id IN (SELECT source FROM edges WHERE kind = 'calls') THEN 10 ELSE 0 END)
+ (CASE WHEN exported THEN 5 ELSE 0 END) + (CASE WHEN regexp_matches(name, '^({'|'.join(words)})') THEN 3 ELSE 0 END) - (CASE WHEN ({_TESTLIKE}) OR contains(file_path, '__test') THEN 20 ELSE 0 END)
+ (CASE WHEN {' OR '.join(f"contains(file_path, '{p}')" for p in places)} THEN 8 ELSE 0 END) AS score FROM nodes n WHERE kind IN ('function', 'method')) WHERE score >= 5"""


@_register(f"WITH {GRAPH_SQL} {_entry_sql(W.ENTRY_WORDS, ['route', 'controller', 'handler'])}")
def f1_entry_points(spark, d):
    return W.entry_points(nodes(spark, d, _SLIM), edges(spark, d, ["calls"])).select("id", "score")


@_register(f"WITH {GRAPH_SQL} {_entry_sql(W.ENTRY_WORDS[:-1], ['route', 'controller'])}")
def f2_entry_points_library(spark, d):
    return W.entry_points(nodes(spark, d, _SLIM), edges(spark, d, ["calls"]), library=True).select("id", "score")


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, {_SCC.format(kind='imports', extra=_FILES)}, ends AS (SELECT source AS id FROM edges UNION SELECT target FROM edges), s AS (SELECT * FROM nodes WHERE contains(file_path, 'quarry-core')),
k AS (SELECT (SELECT count(*) FROM s) AS n_nodes, (SELECT count(*) FROM (SELECT 1 FROM s WHERE NOT coalesce(exported, false) AND kind IN ('function', 'method', 'class') AND id NOT IN (SELECT target FROM edges) LIMIT 20)) AS n_dead,
 (SELECT count(*) FROM (SELECT s.id FROM s JOIN edges e ON e.source = s.id GROUP BY 1 HAVING count(*) > 10 LIMIT 10)) AS n_god, (SELECT count(*) FROM (SELECT file_path FROM s GROUP BY 1 HAVING NOT bool_or(id IN (SELECT id FROM ends)) LIMIT 10)) AS n_orphan, least(5, (SELECT count(DISTINCT component) FROM comp)) AS n_cycles)
SELECT *, round(greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), 100 - CAST(100 AS DOUBLE) * (2 * n_dead + 5 * n_cycles + 3 * n_god + n_orphan) / greatest(n_nodes, 1))), 6) AS score FROM k""")
def r5_scoped_report(spark, d):
    """Counts and score of one repo."""
    return D.scoped_report(nodes(spark, d, _SLIM), edges(spark, d), C.cycle_count(_import_cycles(spark, d)), "quarry-core")


@_register(f"""WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT id FROM nodes WHERE regexp_matches(name, '(?i)(req|request|params|query|body|input|user)') UNION SELECT e.target FROM r JOIN edges e ON e.source = r.id AND e.kind = 'calls')
SELECT DISTINCT e.target AS id FROM r JOIN edges e ON e.source = r.id AND e.kind = 'calls'""")
def g15_callers_matching(spark, d):
    return D.callers_matching(nodes(spark, d, ["id", "name"]), edges(spark, d, ["calls"]))


@_register(None)
def f3_flows(spark, d):
    return W.trace_flows(nodes(spark, d, _SLIM), edges(spark, d, ["calls"]))


@_register(None)
def f4_flows_deduplicated(spark, d):
    return W.trace_flows(nodes(spark, d, _SLIM), edges(spark, d, ["calls"]), dedup=0.7)


@_register(None)
def f5_flow_steps(spark, d):
    return W.flow_steps(W.trace_flows(nodes(spark, d, _SLIM), edges(spark, d, ["calls"])))


@_register(None)
def sv8_flows(spark, d):
    """The listing of the traced flows."""
    return L.flows(nodes(spark, d, ["id", "name"]), f5_flow_steps(spark, d)).withColumn("steps", F.array_join("steps", " > "))


_DIR = "CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END"
_KINDS = ", ".join(f"'{k}'" for k in W.CLUSTER_KINDS)


@_register(f"WITH {GRAPH_SQL} SELECT {_DIR} AS directory, count(*) AS n_members FROM nodes WHERE kind IN ({_KINDS}) GROUP BY 1 HAVING count(*) >= 2")
def f6_directory_clusters(spark, d):
    return W.directory_clusters(nodes(spark, d, ["id", "ord", "kind", "file_path"]))


_LKINDS = ", ".join(f"'{k}'" for k in W.LIBRARY_CLUSTER_KINDS)


@_register(f"WITH {GRAPH_SQL}, m AS (SELECT {_DIR} AS directory FROM nodes WHERE kind IN ({_LKINDS})) SELECT directory, count(*) AS n_members FROM m WHERE (SELECT count(*) FROM m) >= 10 GROUP BY 1 HAVING count(*) >= 2")
def f7_library_clusters(spark, d):
    return W.directory_clusters(nodes(spark, d, ["id", "ord", "kind", "file_path"]), library=True)


@_register(f"""WITH {GRAPH_SQL}, m AS (SELECT id, ord, name, {_DIR} AS directory FROM nodes WHERE kind IN ({_KINDS})), c AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY ord, id) AS r, count(*) OVER (PARTITION BY directory) AS n FROM m)
SELECT 'cluster:' || directory AS id, directory AS name, n AS n_members, string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 10) AS members FROM c WHERE n >= 2 GROUP BY directory, n""")
def sv7_clusters(spark, d):
    """The cluster listing over the directory clusters."""
    n = nodes(spark, d, ["id", "ord", "kind", "name", "file_path"])
    links = W.cluster_edges(n).join(n.select(F.col("id").alias("source"), "ord"), "source")
    heads = W.directory_clusters(n).select(F.concat(F.lit("cluster:"), F.col("directory")).alias("id"), F.lit(None).cast("long").alias("ord"), F.lit("cluster").alias("kind"), F.col("directory").alias("name"), F.lit(None).cast("string").alias("file_path"))
    return L.clusters(n.unionByName(heads), links).withColumn("members", F.array_join("members", ", "))


@_register(f"""WITH {GRAPH_SQL}, m AS (SELECT id, {_DIR} AS directory FROM nodes WHERE kind IN ({_KINDS}))
SELECT id AS source, 'belongs_to' AS kind, 'cluster:' || directory AS target FROM m WHERE directory IN (SELECT directory FROM m GROUP BY 1 HAVING count(*) >= 2)""")
def f6_cluster_edges(spark, d):
    return W.cluster_edges(nodes(spark, d, ["id", "ord", "kind", "file_path"]))


@_register(f"WITH {GRAPH_SQL} SELECT n.id, count(e.source) AS n_in FROM nodes n LEFT JOIN edges e ON e.target = n.id WHERE starts_with(file_path, '{CLUSTER}') GROUP BY n.id, n.ord ORDER BY n_in DESC, n.ord, n.id LIMIT 5")
def f8_cluster_symbols(spark, d):
    return W.cluster_symbols(nodes(spark, d, ["id", "ord", "file_path"]), edges(spark, d), CLUSTER)


@_register(f"""WITH {GRAPH_SQL}, x AS (SELECT s.file_path AS sp, t.file_path AS tp, coalesce(starts_with(s.file_path, '{CLUSTER}'), false) AS si, coalesce(starts_with(t.file_path, '{CLUSTER}'), false) AS ti FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind = 'imports')
SELECT DISTINCT CASE WHEN si THEN 'dependency' ELSE 'dependent' END AS relation, array_to_string(list_slice(string_split(CASE WHEN si THEN tp ELSE sp END, '/'), 1, 2), '/') AS place FROM x WHERE si <> ti""")
def f8_cluster_links(spark, d):
    return W.cluster_links(nodes(spark, d, ["id", "ord", "file_path"]), edges(spark, d, ["imports"]), CLUSTER)


@_register(f"""WITH {GRAPH_SQL}, t AS (SELECT id AS tid, kind AS tk FROM nodes WHERE id = ({_named('wrapResult')})),
s AS (SELECT n.id, n.ord, 1 - levenshtein(name, 'wrapResult') / greatest(length(name), 10) AS close, n.kind = tk AS same FROM nodes n, t WHERE n.id <> tid)
SELECT id, round(0.5 * close + CASE WHEN same THEN 0.25 ELSE 0.0 END, 6) AS similarity, concat_ws(', ', CASE WHEN close >= 0.6 THEN 'similar name' END, CASE WHEN same THEN 'same kind' END) AS reasons FROM s ORDER BY similarity DESC, ord, id LIMIT 10""")
def f9_similar_symbols(spark, d):
    return W.similar_symbols(nodes(spark, d, ["id", "ord", "kind", "name"]), edges(spark, d, ["belongs_to"]), "wrapResult", 10)
