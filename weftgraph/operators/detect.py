"""Rule detectors over the graph: two health reports, complexity, deprecation, coverage, heritage.

Every detector is a plan of filters, grouped counts and anti-joins; none collects rows. Missing flags count as
false, missing edges as zero. Hot nodes only meet in grouped counts, which are merged from partial counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators.lookup import degree, zero
from weftgraph.operators.reach import closure_sizes, closure_sizes_sketched, reach, risk, steps_of
from weftgraph.session import Stash

#: Deprecated interfaces known by name, and what to say about them.
DEPRECATED_APIS = {
    "url.parse": "deprecated in Node.js v11.0.0 — use the WHATWG URL API instead",
    "url.resolve": "deprecated in Node.js v11.0.0 — use the WHATWG URL API instead",
    "url.format": "deprecated in Node.js v11.0.0 — use the WHATWG URL API instead",
    "fs.exists": "deprecated — use fs.access instead",
    "crypto.createCipher": "deprecated — use crypto.createCipheriv instead",
    "crypto.createDecipher": "deprecated — use crypto.createDecipheriv instead",
    "new Buffer()": "deprecated — use Buffer.from() instead",
    "domain.create": "deprecated — the domain module is discouraged",
    "process.binding": "deprecated internal API",
}


def _without(df: DataFrame, edges: DataFrame, end: str, kinds: list[str] | None) -> DataFrame:
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    return df.join(e.select(F.col(end).alias("__x")), F.col("id") == F.col("__x"), "left_anti")


# -- first report: exported symbols nobody uses, files nobody imports, large classes, import cycles


def dead_code(nodes: DataFrame, edges: DataFrame, deprecated: Column | None = None) -> DataFrame:
    """Exported functions, classes, methods and interfaces outside tests, with no step_of, caller or importer."""
    hit = nodes.where(F.col("exported") & F.col("kind").isin("function", "class", "method", "interface") & ~F.col("file_path").rlike("(?i)test|spec|__test") & ~F.col("name").rlike("(?i)^(main|index|bootstrap|server|app)$"))
    if deprecated is not None:
        hit = hit.where(~F.coalesce(deprecated, F.lit(False)))
    hit = _without(_without(hit, edges, "source", ["step_of"]), edges, "target", ["step_of"])
    return _without(hit, edges, "target", ["calls", "imports"])


def orphan_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    p = F.col("file_path")
    hit = nodes.where((F.col("kind") == "file") & ~p.rlike(r"(?i)\.(d\.ts|config\.[tj]s|fixture|mock)$") & ~p.rlike(r"(?i)[/\\](tests?|__tests__)[/\\]"))
    return _without(_without(hit, edges, "source", ["imports"]), edges, "target", ["imports"])


def god_classes(nodes: DataFrame, edges: DataFrame, methods: int = 20, callers: int = 50) -> DataFrame:
    """``id, n_methods, n_callers, reason``."""
    members = edges.where(F.col("kind") == "has_member").join(nodes.where(F.col("kind").isin("method", "constructor")).select(F.col("id").alias("target")), "target")
    n = nodes.where(F.col("kind") == "class").join(degree(members, "source", name="n_methods"), "id", "left").join(degree(edges, "target", ["calls"], "n_callers"), "id", "left").fillna(0, ["n_methods", "n_callers"])
    reason = F.concat_ws(", ", F.when(F.col("n_methods") > methods, F.concat(F.col("n_methods").cast("string"), F.lit(" methods"))), F.when(F.col("n_callers") > callers, F.concat(F.col("n_callers").cast("string"), F.lit(" callers"))))
    return n.withColumn("reason", reason).where(F.col("reason") != "").select("id", "n_methods", "n_callers", "reason")


def grade(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 60, "amber").otherwise("red")


def health_score(nodes: DataFrame, dead: DataFrame, n_cycles: DataFrame, gods: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row of counts, score and grade; ``n_cycles`` has one row with column n."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(nodes, "n_nodes"), one(dead, "n_dead"), n_cycles.select(F.col("n").alias("n_cycles")), one(gods, "n_god"), one(orphans, "n_orphan")]
    row = reduce(DataFrame.crossJoin, parts)  # five single rows
    weight = 0.5 * F.col("n_dead") + 5 * F.col("n_cycles") + 2 * F.col("n_god") + F.col("n_orphan")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 100 * weight / F.greatest(F.col("n_nodes"), F.lit(1))))
    return row.withColumn("score", F.round(score, 6)).withColumn("grade", grade(score))


# -- second report, scoped: symbols without any incoming edge, nodes with many outgoing edges


def in_scope(scope: str) -> Column:
    return F.lit(True) if scope == "." else F.col("file_path").contains(scope)


def dead_scoped(nodes: DataFrame, edges: DataFrame, scope: str = ".", limit: int | None = 20) -> DataFrame:
    hit = nodes.where(in_scope(scope) & ~F.coalesce("exported", F.lit(False)) & F.col("kind").isin("function", "method", "class"))
    hit = _without(hit, edges, "target", None)
    return hit if limit is None else hit.orderBy("ord", "id").limit(limit)


def god_nodes(nodes: DataFrame, edges: DataFrame, scope: str = ".", least: int = 10, limit: int = 10) -> DataFrame:
    hit = nodes.where(in_scope(scope)).join(degree(edges, "source", name="n_out"), "id").where(F.col("n_out") > least)
    return hit.orderBy(F.desc("n_out"), "ord", "id").limit(limit).select("id", "n_out")


def orphan_paths(nodes: DataFrame, edges: DataFrame, scope: str = ".", limit: int | None = 10) -> DataFrame:
    """File paths none of whose nodes has an edge, by first arrival."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().withColumn("linked", F.lit(1))
    paths = nodes.where(in_scope(scope) & F.col("file_path").isNotNull()).join(ends, "id", "left").groupBy("file_path").agg(F.max("linked").alias("linked"), F.min("ord").alias("ord"))
    hit = paths.where(F.col("linked").isNull())
    return (hit if limit is None else hit.orderBy("ord", "file_path").limit(limit)).select("file_path")


def hotspots(nodes: DataFrame, edges: DataFrame, scope: str = ".", hops: int = 5, limit: int = 5, sketched: bool = False) -> DataFrame:
    """``id, blast_radius``: nodes with the most transitive callers and importers.

    All sizes are first estimated by sketches, one pass over the edges per hop. The exact form then counts only nodes
    whose estimate, at ten times its standard error, could belong to the ``limit`` largest; ``sketched`` returns the
    estimates (relative standard error 1.6 %)."""
    steps = steps_of(edges, ["calls", "imports"], "in")
    sizes = Stash(nodes.sparkSession, "hotspots").put(closure_sizes_sketched(nodes.where(in_scope(scope)).select("id"), steps, hops), "sizes")
    top = sizes.orderBy(F.desc("n"), "id").limit(limit)
    if not sketched:
        least = top.agg(F.min("n").alias("least"))
        near = sizes.crossJoin(F.broadcast(least)).where(F.col("n") + 1 >= (F.col("least") - 1) * 0.72)  # least: one row
        top = closure_sizes(near.select("id"), steps, hops)
    return top.select("id", F.col("n").cast("long").alias("blast_radius")).orderBy(F.desc("blast_radius"), "id").limit(limit)


def scoped_score(n: Column, dead: Column, cycles: Column, gods: Column, orphans: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 100 * (2 * dead + 5 * cycles + 3 * gods + orphans) / F.greatest(n, F.lit(1))))


# -- complexity


def complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, cyclomatic, cognitive, severity`` from the number of callees, a proxy for branches."""
    n = nodes.where(F.col("kind").isin("function", "method")).join(degree(edges, "source", ["calls"], "n_calls"), "id", "left")
    c = F.least(F.lit(50), 1 + F.floor(zero("n_calls") / 2)).cast("long")
    return n.select("id", c.alias("cyclomatic")).withColumn("cognitive", F.ceil(F.col("cyclomatic") * 1.3).cast("long")).withColumn("severity", severity(F.col("cyclomatic")))


def severity(c: Column) -> Column:
    return F.when(c > 20, "CRITICAL").when(c > 10, "HIGH").when(c > 5, "MEDIUM").otherwise("LOW")


def text_complexity(nodes: DataFrame) -> DataFrame:
    """``id, cyclomatic, cognitive`` counted in the stored text."""
    n = nodes.where(F.col("kind").isin("function", "method") & F.col("content").isNotNull())
    return n.select("id", (1 + T.decision_points(F.col("content"))).cast("long").alias("cyclomatic")).withColumn("cognitive", F.ceil(F.col("cyclomatic") * 1.3).cast("long"))


# -- deprecation


def deprecated(nodes: DataFrame) -> DataFrame:
    """``id, name, file_path, message`` of deprecated nodes: a doc tag, a flag, an annotation, an attribute, or a
    known interface name, in this order."""

    def text(key: str) -> Column:
        return F.try_variant_get(F.try_parse_json("metadata"), f"$.{key}", "string")

    def listed(key: str, word: str) -> Column:
        return F.array_contains(F.try_variant_get(F.try_parse_json("metadata"), f"$.{key}", "array<string>"), word)

    docs = [text(k) for k in ("jsdoc", "comment", "doc")]
    doc = F.coalesce(*[F.when(x.contains("@deprecated"), x) for x in docs])
    told = F.trim(F.regexp_extract(doc, r"@deprecated\s+(.*)", 1))
    api = None
    for name, message in DEPRECATED_APIS.items():
        api = F.when(F.col("name").contains(name), message) if api is None else api.when(F.col("name").contains(name), message)
    message = (
        F.when(doc.isNotNull(), F.when(told != "", told).otherwise("deprecated"))
        .when(text("deprecated") == "true", F.coalesce(text("deprecationMessage"), F.lit("deprecated")))
        .when(listed("annotations", "Deprecated") | listed("decorators", "Deprecated"), "marked @Deprecated")
        .when(listed("attributes", "deprecated"), "marked #[deprecated]")
        .otherwise(api)
    )
    return nodes.withColumn("message", message).where(F.col("message").isNotNull()).select("id", "name", "file_path", "message")


def deprecated_usage(found: DataFrame, nodes: DataFrame, edges: DataFrame, scope: str | None = None) -> DataFrame:
    """``id, caller``: one row per caller of a deprecated node, one with a null caller if it has none."""
    callers = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("__p"))
    uses = edges.where(F.col("kind").isin("calls", "deprecated_use")).join(callers, "source")
    if scope:
        uses = uses.where(F.col("__p").startswith(scope))
    return found.select("id").join(uses.select(F.col("target").alias("id"), F.col("source").alias("caller")).distinct(), "id", "left")


def deprecated_use_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to add: every caller of a deprecated node uses it."""
    return edges.where(F.col("kind") == "calls").join(found.select(F.col("id").alias("target")), "target", "left_semi").select("source", F.lit("deprecated_use").alias("kind"), "target").distinct()


# -- coverage


def test_subjects(path: Column) -> Column:
    """Base names that a test file is about, by naming convention."""
    base = T.basename(path)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"\.test\.[^.]+$", ""), r"\.spec\.[^.]+$", ""), r"_test\.[^.]+$", ""), r"_test$", "")
    return F.array_distinct(F.array_compact(F.array(
        plain, F.when(base.rlike(r"Test\.php$"), F.regexp_replace(base, r"Test\.php$", "")), F.when(base.rlike(r"(?i)^test_.*\.py$"), F.regexp_replace(F.regexp_replace(base, "^test_", ""), r"(?i)\.py$", "")),
        F.when(base.rlike(r"(?i)_test\.py$"), F.regexp_replace(base, r"(?i)_test\.py$", "")), F.when(base.rlike(r"(?i)_spec\.rb$"), F.regexp_replace(base, r"(?i)_spec\.rb$", "")),
    )))


def coverage(nodes: DataFrame, edges: DataFrame, scope: str = "", hops: int = 3) -> DataFrame:
    """``id, tested, blast_radius, risk`` of exported functions, methods and classes."""
    subjects = nodes.where(F.col("exported") & F.col("kind").isin("function", "method", "class") & F.col("file_path").startswith(scope))
    tests = nodes.where(T.is_test_file(F.col("file_path")))
    by_edge = edges.where(F.col("kind") == "tested_by").join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    by_import = edges.where(F.col("kind") == "imports").join(tests.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    names = tests.select(F.explode(test_subjects(F.col("file_path"))).alias("stem")).distinct()
    by_name = subjects.withColumn("stem", T.stem(F.col("file_path"))).join(names, "stem", "left_semi").select("id")
    tested = by_edge.union(by_import).union(by_name).distinct().withColumn("tested", F.lit(True))
    radius = closure_sizes(subjects.select("id"), steps_of(edges, ["calls", "imports"], "in"), hops)
    out = subjects.select("id").join(tested, "id", "left").fillna(False, ["tested"]).join(radius, "id").withColumnRenamed("n", "blast_radius")
    return out.withColumn("risk", risk("blast_radius", 20, 5, at_least=True))


def coverage_summary(cover: DataFrame) -> DataFrame:
    n, t = F.count("*"), F.sum(F.col("tested").cast("long"))
    return cover.agg(n.alias("n_exported"), F.coalesce(t, F.lit(0)).alias("n_tested"), F.when(n == 0, 100).otherwise(F.floor(t / n * 100 + 0.5)).cast("long").alias("pct"))


# -- heritage


def overrides(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``child_method, parent_method``: members of the same name along an extends link."""
    name = nodes.where(F.col("kind") == "method").select("id", "name")
    member = edges.where(F.col("kind") == "has_member").select(F.col("source").alias("owner"), F.col("target").alias("id")).join(name, "id")
    child = member.select(F.col("owner").alias("c"), F.col("id").alias("child_method"), "name")
    parent = member.select(F.col("owner").alias("p"), F.col("id").alias("parent_method"), "name")
    link = edges.where(F.col("kind") == "extends").select(F.col("source").alias("c"), F.col("target").alias("p"))
    return link.join(child, "c").join(parent, ["p", "name"]).select("child_method", "parent_method").distinct()


def scoped_report(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, scope: str = ".") -> DataFrame:
    """One row with the capped counts of the scoped report and its score; ``cycles`` has one row, column n."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(nodes.where(in_scope(scope)), "n_nodes"), one(dead_scoped(nodes, edges, scope), "n_dead"), one(god_nodes(nodes, edges, scope), "n_god"), one(orphan_paths(nodes, edges, scope), "n_orphan"), cycles.select(F.least("n", F.lit(5)).alias("n_cycles"))]
    row = reduce(DataFrame.crossJoin, parts)  # five single rows
    return row.withColumn("score", F.round(scoped_score(F.col("n_nodes"), F.col("n_dead"), F.col("n_cycles"), F.col("n_god"), F.col("n_orphan")), 6))


def callers_matching(nodes: DataFrame, edges: DataFrame, pattern: str = r"(?i)(req|request|params|query|body|input|user)") -> DataFrame:
    """``id`` of nodes with a transitive caller, at any distance, whose name matches."""
    seeds = nodes.where(F.col("name").rlike(pattern)).select("id")
    steps = steps_of(edges, ["calls"], "out")
    return steps.join(reach(seeds, steps, None).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
