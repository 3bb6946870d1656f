import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import components as C
from weftgraph.operators import detect as D
from weftgraph.operators import flows as W
from weftgraph.operators import impact as I
from weftgraph.operators import lookup as L
from weftgraph.operators import reach as R

NODE = "id string, kind string, name string, file_path string, exported boolean, ord long, metadata string, start_line long, end_line long, content string"


def nodes_of(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], i, *(list(r[5:]) + [None] * 4)[:4]) for i, r in enumerate(rows)], NODE)


def edges_of(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, kind string, target string, ord long")


def random_steps(seed, n, m):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


def bfs(steps, seeds, hops):
    out = {}
    for s in seeds:
        depth, front = {s: 0}, [s]
        for h in range(1, hops + 1):
            front = [b for a, b in steps if a in front and b not in depth and not depth.update({b: h})]
        for k, v in depth.items():
            out[s, k] = v
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_matches_breadth_first_search(spark, seed):
    steps = random_steps(seed, 30, 50)
    df = spark.createDataFrame(steps, "src string, dst string")
    seeds = ["n1", "n2", "n7"]
    got = R.reach(spark.createDataFrame([(s, s) for s in seeds] + [("n1", None)], "origin string, id string"), df, 3, ["origin"])
    assert {(r.origin, r.id): r.depth for r in got.collect()} == bfs(steps, seeds, 3)
    sizes = {r.id: r.n for r in R.closure_sizes(spark.createDataFrame([(s,) for s in seeds], "id string"), df, 3).collect()}
    want = bfs(steps, seeds, 3)
    assert sizes == {s: sum(1 for a, b in want if a == s) - 1 for s in seeds}


def test_sketched_sizes_are_close(spark):
    steps = random_steps(9, 400, 900)
    df = spark.createDataFrame(steps, "src string, dst string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(60)] + [("alone",)], "id string")
    exact = {r.id: r.n for r in R.closure_sizes(seeds, df, 4).collect()}
    near = {r.id: r.n for r in R.closure_sizes_sketched(seeds, df, 4).collect()}
    assert set(near) == set(exact) and all(abs(near[i] - exact[i]) <= 1 + 0.06 * exact[i] for i in exact)


def test_reach_without_seeds_or_steps(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert R.reach(spark.createDataFrame([("a",)], "id string"), none, None).collect()[0].id == "a"
    assert R.reach(spark.createDataFrame([], "id string"), none, 3).collect() == []


def test_all_paths_are_simple_and_short(spark):
    e = edges_of(spark, [("a", "calls", "b"), ("b", "calls", "c"), ("a", "imports", "c"), ("c", "calls", "a"), ("b", "calls", "a")])
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    assert [(r.n, r.path, r.last_kind) for r in R.all_paths(one("a"), one("c"), e).collect()] == [(1, ["a", "c"], "imports"), (2, ["a", "b", "c"], "calls")]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_strong_components_match_closure(spark, seed):
    steps = random_steps(seed, 25, 40)
    got = {r.id: (r.component, r.size) for r in C.strong_components(spark.createDataFrame(steps, "src string, dst string")).collect()}
    far = bfs(steps, {x for s in steps for x in s}, 25)
    groups = {}
    for a, b in far:
        if a != b and (b, a) in far:
            groups.setdefault(a, {a}).add(b)
    assert got == {a: (min(g), len(g)) for a, g in groups.items()}


def test_layers(spark):
    got = {r.id: r.layer for r in C.layers(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


def test_phases_and_linearisation():
    assert C.phase_order({"c": ["b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    assert C.validate_phases({"a": ["x"]}) and C.validate_phases({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError):
        C.phase_order({"a": ["b"], "b": ["a"]})
    bases = {"D": ["B", "C"], "B": ["A"], "C": ["A"]}
    assert C.linearise("D", bases) == ["D", "B", "A", "C"] and C.linearise("D", bases, "c3") == ["D", "B", "C", "A"] and C.linearise("D", bases, "mixin") == ["D", "C", "A", "B"] and C.linearise("D", bases, "none") == ["D"]
    assert C.linearise("A", {"A": ["B"], "B": ["A"]}, "c3")[0] == "A"


def test_dead_code_and_orphans(spark):
    n = nodes_of(spark, [("f", "function", "orphanFn", "src/a.ts", True), ("g", "function", "used", "src/a.ts", True), ("m", "function", "main", "src/a.ts", True), ("t", "function", "helper", "src/a.test.ts", True), ("h", "function", "hidden", "src/a.ts", False), ("x", "file", "a.ts", "src/a.ts", None), ("y", "file", "b.d.ts", "src/b.d.ts", None), ("z", "file", "c.ts", "pkg/tests/c.ts", None)])
    e = edges_of(spark, [("m", "calls", "g")])
    assert [r.id for r in D.dead_code(n, e).collect()] == ["f"]
    assert [r.id for r in D.orphan_files(n, e).collect()] == ["x"]
    assert [r.id for r in D.dead_scoped(n, e).collect()] == ["h"]
    assert {r.file_path for r in D.orphan_paths(n, e).collect()} == {"src/a.test.ts", "src/b.d.ts", "pkg/tests/c.ts"}


def test_god_classes_and_score(spark):
    n = nodes_of(spark, [("god", "class", "God", "a.ts", True)] + [(f"m{i}", "method", f"m{i}", "a.ts", False) for i in range(25)])
    e = edges_of(spark, [("god", "has_member", f"m{i}") for i in range(25)])
    row = D.god_classes(n, e).collect()[0]
    assert row.id == "god" and "25 methods" in row.reason
    none = n.where("false")
    score = D.health_score(n, none, n.select(F.lit(1).alias("n")).limit(1), D.god_classes(n, e), none).collect()[0]
    assert score.score == round(100 - 100 * (5 + 2) / 26, 6) and score.grade == "amber"
    assert [r.id for r in D.god_nodes(n, e).collect()] == ["god"]


def test_two_file_cycle(spark):
    got = C.strong_components(spark.createDataFrame([("fileA", "fileB"), ("fileB", "fileA")], "src string, dst string")).collect()
    assert {(r.id, r.component, r.size) for r in got} == {("fileA", "fileA", 2), ("fileB", "fileA", 2)}


def test_complexity_and_coverage(spark):
    n = nodes_of(spark, [(f"f{i}", "function", f"f{i}", f"src/u{i}.ts", True) for i in range(4)] + [("t", "file", "x.test.ts", "src/x.test.ts", None), ("t2", "file", "u3.test.ts", "src/u3.test.ts", None)])
    e = edges_of(spark, [("f0", "calls", "f1"), ("f0", "calls", "f2"), ("f0", "calls", "f3"), ("t", "imports", "f0"), ("f1", "tested_by", "t")])
    assert {r.id: r.cyclomatic for r in D.complexity(n, e).collect()}["f0"] == 2
    cover = {r.id: (r.tested, r.blast_radius) for r in D.coverage(n, e).collect()}
    assert cover == {"f0": (True, 1), "f1": (True, 2), "f2": (False, 2), "f3": (True, 2)}
    assert D.coverage_summary(D.coverage(n, e)).collect()[0].pct == 75
    assert D.coverage_summary(D.coverage(n.where("false"), e)).collect()[0].pct == 100
    text = spark.createDataFrame([("a", "function", "if (a && b) { for (;;) {} } else if (c) {} x ? 1 : 2; y ?? 3")], "id string, kind string, content string")
    assert D.text_complexity(text).collect()[0].cyclomatic == 1 + 2 + 1 + 1 + 1 + 1 + 1


def test_deprecated(spark):
    n = nodes_of(spark, [("a", "function", "old", "a.ts", True, '{"jsdoc": "text @deprecated use b"}'), ("b", "function", "fs.exists", "a.ts", True), ("c", "method", "j", "A.java", True, '{"annotations": ["Deprecated"]}'), ("d", "function", "r", "a.rs", True, '{"attributes": ["deprecated"]}'), ("e", "function", "ok", "a.ts", True, "{cut"), ("f", "function", "fl", "a.ts", True, '{"deprecated": true}')])
    found = D.deprecated(n)
    assert {r.id: r.message for r in found.collect()} == {"a": "use b", "b": "deprecated — use fs.access instead", "c": "marked @Deprecated", "d": "marked #[deprecated]", "f": "deprecated"}
    use = {(r.id, r.caller) for r in D.deprecated_usage(found, n, edges_of(spark, [("e", "calls", "a")])).collect()}
    assert ("a", "e") in use and ("b", None) in use


def test_overrides(spark):
    n = nodes_of(spark, [("p", "class", "P", "a", True), ("c", "class", "C", "a", True), ("pm", "method", "run", "a", True), ("cm", "method", "run", "a", True), ("co", "method", "other", "a", True)])
    e = edges_of(spark, [("c", "extends", "p"), ("p", "has_member", "pm"), ("c", "has_member", "cm"), ("c", "has_member", "co")])
    assert [(r.child_method, r.parent_method) for r in D.overrides(n, e).collect()] == [("cm", "pm")]


def test_flows(spark):
    n = nodes_of(spark, [("e", "function", "handleX", "src/x.ts", True), ("a", "function", "a", "src/x.ts", False), ("b", "function", "b", "src/x.ts", False), ("c", "function", "c", "src/x.ts", False), ("t", "function", "t", "tests/x.ts", False)])
    e = edges_of(spark, [("e", "calls", "a"), ("a", "calls", "b"), ("e", "calls", "c"), ("c", "calls", "b"), ("a", "calls", "t")])
    assert {r.id: r.score for r in W.entry_points(n, e).collect()} == {"e": 18}
    flows = W.trace_flows(n, e)
    assert [r.steps for r in flows.collect()] == [["e", "a", "b"]]
    assert [(r.target, r.label) for r in W.flow_steps(flows).orderBy("label").collect()] == [("e", "step 0"), ("a", "step 1"), ("b", "step 2")]
    assert {r.directory: r.n_members for r in W.directory_clusters(n).collect()} == {"src": 4}
    assert W.directory_clusters(n, library=True).count() == 0


def test_similar_symbols(spark):
    n = nodes_of(spark, [("1", "function", "parseUserInput", "a", True), ("2", "function", "parseAdminInput", "a", True), ("3", "class", "Parser", "a", True)])
    rows = W.similar_symbols(n, edges_of(spark, [("1", "belongs_to", "k"), ("2", "belongs_to", "k")]), "parseUserInput", 5).collect()
    assert rows[0].id == "2" and rows[0].reasons == "similar name, same kind, same module" and len(rows) == 2
    assert W.similar_symbols(n, edges_of(spark, [("1", "belongs_to", "k")]), "none", 5).count() == 0


def test_pr_impact(spark):
    callers = [(f"c{i}", "function", f"c{i}", f"src/c{i}.ts", True) for i in range(75)]
    n = nodes_of(spark, [("auth", "function", "authenticate", "src/api/users.ts", True), ("order", "function", "processOrder", "src/api/users.ts", True), ("fmt", "function", "formatDate", "src/util.ts", True), ("t", "file", "a.test.ts", "src/a.test.ts", None), *callers])
    e = edges_of(spark, [(f"c{i}", "calls", "auth") for i in range(60)] + [(f"c{i}", "calls", "order") for i in range(60, 75)] + [("t", "imports", "auth")])
    diff = "--- a/src/api/users.ts\n+++ b/src/api/users.ts\n@@ -1 +1 @@\n+x\n--- a/src/util.ts\n+++ b/src/util.ts\n"
    assert I.diff_files(diff) == ["src/api/users.ts", "src/util.ts"]
    changed, impacted = I.pr_impact(n, e, I.diff_files(diff))
    got = {r.name: (r.risk, r.n_callers, r.has_test, r.is_gap) for r in changed.collect()}
    assert got == {"authenticate": ("HIGH", 60, True, False), "processOrder": ("MEDIUM", 15, False, True), "formatDate": ("LOW", 0, False, False)}
    assert impacted.count() == 76


def test_diff_lines_and_changes(spark):
    diff = "+++ b/src/a.ts\n@@ -1,2 +5,3 @@\n ctx\n+new\n-old\n+more\n\\ No newline\n"
    assert [(r.file, r.line) for r in I.diff_lines(spark, diff).collect()] == [("src/a.ts", 6), ("src/a.ts", 7)]
    n = nodes_of(spark, [("f", "function", "f", "repo/src/a.ts", True, None, 4, 6), ("g", "function", "g", "repo/src/a.ts", True, None, 9, None), ("h", "function", "h", "repo/src/a.ts", True, None, 20, 30), ("k", "function", "k", "other/b.ts", True, None, 1, 99)])
    assert {r.id for r in I.changed_symbols(n, I.diff_lines(spark, diff)).collect()} == {"f", "g"}
    row = I.detect_changes(n, edges_of(spark, [("k", "calls", "f")]), I.diff_lines(spark, diff)).collect()[0]
    assert (row.n_changed, row.n_affected, row.risk) == (2, 3, "LOW")


def test_suggestions_for_tests(spark):
    n = nodes_of(spark, [("p", "function", "processPayment", "src/p.ts", True), ("c", "function", "checkout", "src/c.ts", True), ("s", "function", "subscribe", "src/s.ts", True), ("t", "file", "p.test.ts", "src/p.test.ts", None)])
    e = edges_of(spark, [("c", "calls", "p"), ("s", "calls", "p"), ("t", "imports", "p"), ("t", "imports", "c")])
    assert [r.id for r in I.untested_callers(n, e, "processPayment").collect()] == ["s"]
    assert [r.file_path for r in I.existing_tests(n, e, "processPayment").collect()] == ["src/p.test.ts"]
    assert [r.path for r in I.call_paths(n, e, "processPayment").collect()] == ["checkout > processPayment", "subscribe > processPayment"]
    doc = I.context_document(n, e, ["processPayment"], "who calls it", budget=200)
    assert doc["intent"] == "callers" and "checkout" in doc["blocks"]["relation"] and sum(doc["tokens"].values()) <= 200
    assert I.question_intent("show the source") == "code" and I.cut_to("word " * 400, 20)[1]


def test_inspect_direction(spark):
    n = nodes_of(spark, [("a", "file", "a.ts", "a.ts", None), ("b", "file", "b.ts", "b.ts", None), ("c", "file", "c.ts", "c.ts", None)])
    got = {(r.relation, r.name) for r in L.inspect(n, edges_of(spark, [("a", "imports", "b"), ("c", "imports", "a")]), "a.ts").collect()}
    assert got == {("imports", "b.ts"), ("importedBy", "c.ts")}
    two = nodes_of(spark, [("1", "function", "f", "tests/a.ts", True), ("2", "function", "f", "src/a.ts", True), ("3", "function", "f", "x.ts", True)])
    assert [r.id for r in L.resolve_symbol(two, "f").orderBy("rank").collect()] == ["2", "3", "1"]
    assert [r.id for r in L.resolve_symbol(two, "function:f@x.ts").collect()] == ["3"]


def test_clusters(spark):
    n = nodes_of(spark, [("k", "cluster", "auth", None, None), ("a", "function", "x", "f", True), ("b", "function", "y", "f", True)])
    row = L.clusters(n, edges_of(spark, [("b", "belongs_to", "k"), ("a", "belongs_to", "k")])).collect()[0]
    assert (row.n_members, row.members) == (2, ["y", "x"])
