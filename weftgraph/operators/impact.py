"""Change impact: diffs to files, lines and symbols, closures of callers, tests to write, context documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.graph import first_named
from weftgraph.operators.reach import reach, risk, steps_of
from weftgraph.session import Stash

_LINES = "file string, line long"
#: Suggested cases by what a name says.
CASES = [
    ("parse|validate|check|verify", ["Valid input → success", "Invalid input → throws error", "Edge case: empty/null input → handled gracefully"]),
    ("create|add|insert|save", ["Success: valid data → created", "Duplicate: existing item → error or no-op", "Missing required fields → validation error"]),
    ("delete|remove|destroy", ["Existing item → deleted successfully", "Non-existent item → no error or 404", "Unauthorized access → rejected"]),
    ("get|find|fetch|load", ["Found: returns correct data", "Not found: returns null or throws", "Empty collection: returns []"]),
]
DEFAULT_CASES = ["Happy path: valid input → expected output", "Error case: invalid input → error handled", "Edge case: boundary values → correct behavior"]


def diff_files(diff: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"^\+\+\+ b/(.+?)\s*$", diff, re.M)))


def diff_lines(spark: SparkSession, diff: str) -> DataFrame:
    """``file, line``: added lines on the new side of a unified diff."""
    out, path, at = [], None, 0
    for row in diff.split("\n"):
        if m := re.match(r"\+\+\+ b/(.+?)\s*$", row):
            path = m[1]
        elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", row):
            at = int(m[1])
        elif path and at and row[:1] == "+" and not row.startswith("+++"):
            out.append((path, at))
            at += 1
        elif at and row[:1] not in ("-", "\\"):
            at += 1
    return spark.createDataFrame(out, _LINES)


def same_file(node_path: Column, file: Column) -> Column:
    """Equal, or one is the end of the other."""
    return (node_path == file) | node_path.endswith(file) | file.endswith(node_path)


def changed_symbols(nodes: DataFrame, lines: DataFrame, near: int = 3) -> DataFrame:
    """``id``: nodes whose line range holds a changed line, or that start within ``near`` lines of one when they
    have no end. Files meet by base name first, so the range test runs within files only."""
    n = nodes.where(F.col("start_line").isNotNull()).withColumn("__b", F.element_at(F.split("file_path", "/"), -1))
    d = lines.withColumn("__b", F.element_at(F.split("file", "/"), -1))
    line = F.col("line")
    held = F.when(F.col("end_line").isNotNull(), line.between(F.col("start_line"), F.col("end_line"))).otherwise(F.abs(line - F.col("start_line")) <= near)
    return n.join(d, "__b").where(same_file(F.col("file_path"), F.col("file")) & held).select("id").distinct()


def detect_changes(nodes: DataFrame, edges: DataFrame, lines: DataFrame, hops: int = 5) -> DataFrame:
    """One row: ``n_changed, n_affected, risk``."""
    seeds = changed_symbols(nodes, lines)
    found = reach(seeds, steps_of(edges, ["calls", "imports"], "in"), hops)
    return found.agg(F.sum((F.col("depth") == 0).cast("long")).alias("n_changed"), F.count("*").alias("n_affected")).withColumn("risk", risk("n_affected", 10, 4))


def file_symbols(nodes: DataFrame, files: list[str]) -> DataFrame:
    hit = F.lit(False)
    for f in files:
        hit = hit | same_file(F.col("file_path"), F.lit(f))
    return nodes.where(hit)


def pr_impact(nodes: DataFrame, edges: DataFrame, files: list[str], hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(``id, name, n_affected, risk, n_callers, has_test, is_gap`` of changed symbols; ``id`` of impacted ones)."""
    changed = file_symbols(nodes, files).select("id", "name")
    steps = steps_of(edges, ["calls", "imports"], "in")
    pairs = reach(changed.select(F.col("id").alias("origin"), "id"), steps, hops, ["origin"]).where(F.col("depth") > 0)
    size = pairs.groupBy(F.col("origin").alias("id")).agg(F.count("*").alias("n_affected"))
    callers = edges.where(F.col("kind") == "calls").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_callers"))
    tests = nodes.where(F.col("file_path").contains(".test.") | F.col("file_path").contains(".spec.")).select(F.col("id").alias("source"))
    tested = edges.where(F.col("kind") == "imports").join(tests, "source", "left_semi").select(F.col("target").alias("id")).distinct().withColumn("has_test", F.lit(True))
    out = changed.join(size, "id", "left").join(callers, "id", "left").join(tested, "id", "left").fillna(0, ["n_affected", "n_callers"]).fillna(False, ["has_test"])
    out = out.withColumn("risk", risk("n_affected", 50, 10, at_least=True)).withColumn("is_gap", (F.col("risk") != "LOW") & ~F.col("has_test"))
    impacted = pairs.select("id").distinct().join(changed, "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
    return out, impacted


def files_to_review(nodes: DataFrame, impacted: DataFrame, top: int = 5) -> DataFrame:
    return impacted.join(nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(top)


def call_paths_of(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 3, limit: int = 5) -> DataFrame:
    """``symbol, n, path``: for each of ``starts`` (symbol, id, name) the first ``limit`` chains of callers that end at
    it, shorter ones first, cut at ``hops`` callers or where nobody calls. Chains that end early come before all longer
    ones, so a symbol that has ``limit`` of them is not followed further."""
    calls = edges.where(F.col("kind") == "calls").join(nodes.select(F.col("id").alias("source"), F.col("name").alias("caller")), "source").select("source", "target", "caller", "ord")
    stash = Stash(nodes.sparkSession, "callers")
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("n", "order"))
    front = starts.select("symbol", F.col("id").alias("at"), F.array("name").alias("path"), F.array().cast("array<bigint>").alias("order"))
    done = None
    for h in range(1, hops + 1):
        nxt = stash.put(front.join(calls, F.col("at") == F.col("target"), "left"), f"hop-{h}")
        ends = nxt.where(F.col("source").isNull() & (F.size("path") > 1)).select("symbol", (F.size("path") - 1).alias("n"), "path", "order")
        front = nxt.where(F.col("source").isNotNull()).select("symbol", F.col("source").alias("at"), F.concat(F.array("caller"), "path").alias("path"), F.concat("order", F.array("ord")).alias("order"))
        done = stash.put((ends if done is None else done.unionByName(ends)).withColumn("r", first).where(F.col("r") <= limit).drop("r"), f"ends-{h}")
        front = front.join(done.groupBy("symbol").count().where(F.col("count") >= limit), "symbol", "left_anti")
    whole = done.unionByName(front.select("symbol", (F.size("path") - 1).alias("n"), "path", "order"))
    return whole.withColumn("r", first).where(F.col("r") <= limit).select("symbol", "n", F.array_join("path", " > ").alias("path"), "r")


def call_paths(nodes: DataFrame, edges: DataFrame, name: str, hops: int = 3, limit: int = 5) -> DataFrame:
    """``n, path``: the chains of one symbol, see ``call_paths_of``."""
    starts = first_named(nodes, name).select(F.lit(name).alias("symbol"), "id", "name")
    return call_paths_of(nodes, edges, starts, hops, limit).orderBy("r").select("n", "path")


def existing_tests(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    from weftgraph.functions.text import is_test_file

    me = first_named(nodes, name).select(F.col("id").alias("target"))
    tests = nodes.where(is_test_file(F.col("file_path"))).select(F.col("id").alias("source"), "file_path")
    return edges.where(F.col("kind") == "imports").join(me, "target", "left_semi").join(tests, "source").select("file_path").distinct()


def untested_callers(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``id`` of callers that no test file imports."""
    from weftgraph.functions.text import is_test_file

    me = first_named(nodes, name).select(F.col("id").alias("target"))
    callers = edges.where(F.col("kind") == "calls").join(me, "target", "left_semi").select(F.col("source").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    tests = nodes.where(is_test_file(F.col("file_path"))).select(F.col("id").alias("source"))
    covered = edges.where(F.col("kind") == "imports").join(tests, "source", "left_semi").select(F.col("target").alias("id"))
    return callers.join(covered, "id", "left_anti")


def suggested_cases(name: Column) -> Column:
    out = None
    for pattern, cases in CASES:
        arr = F.array(*[F.lit(c) for c in cases])
        hit = F.lower(name).rlike(pattern)
        out = F.when(hit, arr) if out is None else out.when(hit, arr)
    return out.otherwise(F.array(*[F.lit(c) for c in DEFAULT_CASES]))


# -- context documents: a handful of seeds, formatted on the driver

#: Token budgets of the blocks by intent, and the words that tell an intent.
BUDGETS = {
    "code": {"summary": 300, "logic": 400, "relation": 300, "focus": 5000}, "callers": {"summary": 500, "logic": 300, "relation": 2500, "focus": 700},
    "architecture": {"summary": 1200, "logic": 800, "relation": 800, "focus": 1200}, "auto": {"summary": 800, "logic": 600, "relation": 500, "focus": 1500},
}
INTENTS = [("code", r"\b(show|code|implement|source|how is written|function body|method body)\b"), ("callers", r"\b(who calls|callers?|depends on|blast radius|impact|upstream)\b"), ("architecture", r"\b(architecture|overview|structure|design|how is built|system)\b")]
MAX_SEEDS = 10


def question_intents(question: Column) -> Column:
    """The same of a column of questions."""
    text, out = F.lower(question), None
    for name, pattern in INTENTS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("auto")


def question_intent(question: str) -> str:
    return next((n for n, p in INTENTS if re.search(p, question.lower())), "auto")


def tokens_of(text: str) -> int:
    return -int(-(len(text.split()) * 1.3 + len(text) * 0.25) // 2) if text else 0


def cut_to(text: str, most: int) -> tuple[str, bool]:
    """The longest beginning that fits the budget with a mark, by bisection."""
    if tokens_of(text) <= most:
        return text, False
    mark, low, high = "\n… [truncated]", 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if tokens_of(text[:mid].rstrip() + mark) <= most else (low, mid - 1)
    return (text[:low].rstrip() + mark if tokens_of(mark) < most else ""), True


def context_document(nodes: DataFrame, edges: DataFrame, names: list[str], question: str = "", budget: int | None = None) -> dict:
    """Blocks summary, logic, relation and focus about at most ten symbols. The rows that come to the driver are
    the seeds and, per seed and direction, at most 50 neighbours."""
    intent = question_intent(question)
    seeds = nodes.where(F.col("name").isin(names)).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("ord", "id"))).where("r = 1").orderBy("ord").limit(MAX_SEEDS)
    rows = seeds.select("id", "kind", "name", "file_path", "start_line", "content").collect()
    ids = [r.id for r in rows]
    who = nodes.select("id", "name")

    def around(end: str, other: str) -> dict[str, list[str]]:
        e = edges.where((F.col("kind") == "calls") & F.col(end).isin(ids)).withColumn("r", F.row_number().over(Window.partitionBy(end).orderBy("ord"))).where(F.col("r") <= 50)
        out: dict[str, list[str]] = {}
        for x in e.join(who, F.col(other) == F.col("id")).select(F.col(end).alias("k"), "name", "r").orderBy("r").collect():
            out.setdefault(x.k, []).append(x.name)
        return {k: list(dict.fromkeys(v)) for k, v in out.items()}

    callees, callers = around("source", "target"), around("target", "source")
    place = lambda r: "/".join((r.file_path or "").split("/")[-2:]) + (f":{r.start_line}" if r.start_line else "")
    blocks = {
        "summary": "\n".join(["[SUMMARY]", *[f"{r.name} [{r.kind}] {place(r)}" for r in rows]]) if rows else "",
        "logic": "\n".join(["[LOGIC]", *[f"{r.name} → {', '.join(callees[r.id])}" for r in rows if callees.get(r.id)]]) if callees else "",
        "relation": "\n".join(["[RELATION]", *[f"{r.name} ← {', '.join(callers[r.id])}" for r in rows if callers.get(r.id)]]) if callers else "",
        "focus": "\n".join(["[FOCUS]", *[f"--- {place(r)}\n{r.content}" for r in rows if r.content]]) if rows else "",
    }
    cut = []
    for name, most in BUDGETS[intent].items():
        blocks[name], was = cut_to(blocks[name], most)
        cut += [name] * was
    if budget is not None:
        for name in ("focus", "relation", "logic", "summary"):
            over = sum(map(tokens_of, blocks.values())) - budget
            if over > 0:
                blocks[name], _ = cut_to(blocks[name], max(0, tokens_of(blocks[name]) - over))
                cut.append(name)
    return {"intent": intent, "blocks": blocks, "tokens": {k: tokens_of(v) for k, v in blocks.items()}, "truncated": sorted(set(cut))}


def change_context(nodes: DataFrame, edges: DataFrame, files: list[str], hops: int = 2, question: str = "") -> dict:
    """Impact, context and test suggestions of a set of changed files."""
    paths = list(dict.fromkeys(re.sub(r"^\./", "", f.replace("\\", "/")) for f in files if f))
    changed, impacted = pr_impact(nodes, edges, paths, min(hops, 10))
    names = [r.name for r in changed.orderBy(F.desc("n_affected"), "id").limit(MAX_SEEDS).collect()]
    starts = nodes.where(F.col("name").isin(names)).groupBy(F.col("name").alias("symbol")).agg(F.min(F.struct("ord", "id")).alias("f")).select("symbol", F.col("f.id").alias("id"), F.col("symbol").alias("name"))
    tests: dict[str, list[str]] = {n: [] for n in names}
    for r in call_paths_of(nodes, edges, starts).orderBy("symbol", "r").collect():  # at most five chains of ten symbols
        tests[r.symbol].append(r.path)
    return {"changed": changed, "impacted": impacted, "context": context_document(nodes, edges, names, question), "tests": tests}
