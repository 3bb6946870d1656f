"""The same queries on a small graph that holds a case for each: what the large tables have none of.

The rows below are written as input tables to the shared folder once; the SQL twin of a query is its own SQL over the
same rows. Names end in ``_case``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import edges, nodes
from weftgraph.operators import security
from weftgraph.queries import detectors, graph, ingestion, ranking
from weftgraph.session import shared_dir
from weftgraph.sources.folder import Folder

_NODE = "ord long, repo string, id string, kind string, name string, file_path string, start_line long, end_line long, exported boolean, content string, metadata string"
_EDGE = "ord long, source string, target string, kind string"
_CONTRACT = "ord long, repo string, kind string, name string, parameters array<struct<name: string, type: string>>, return_type string"


def _n(kind: str, name: str, path: str, start: int | None = None, end: int | None = None, exported: bool | None = False, content: str | None = None, meta: dict | None = None) -> tuple:
    return ("r", f"{kind}:r/{path}:{name}", kind, name, f"r/{path}", start, end, exported, content, None if meta is None else json.dumps(meta))


_NODES = [
    _n("file", "all.ts", "src/all.ts", exported=None, content="import { send } from './mail.js';\n"), _n("file", "index.ts", "src/index.ts", exported=None, content="import { send } from './mail.js';\n"), _n("file", "mail.ts", "src/mail.ts", exported=None),
    _n("class", "Store", "src/store.ts", 1, 9, True), _n("class", "FastStore", "src/fast.ts", 1, 30, True), _n("method", "save", "src/store.ts", 2, 4), _n("method", "save", "src/fast.ts", 2, 4), _n("method", "load", "src/fast.ts", 5, 9),
    _n("method", "close", "src/fast.ts", 10, 12), _n("method", "open", "src/fast.ts", 13, 15), _n("function", "unusedHelper", "src/util.ts", 3, 5), _n("function", "oldSend", "src/mail.ts", 1, 4, True, None, {"jsdoc": "@deprecated use send"}),
    _n("function", "older", "src/mail.ts", 6, 8, True, None, {"deprecated": "true"}), _n("function", "setInnerHTML", "src/view.ts", 1, 5, True), _n("function", "lonely", "src/lonely.ts", 1, 2), _n("function", "send", "src/mail.ts", 10, 20, True),
    _n("function", "emitEvent", "src/bus.ts", 1, 5, True), _n("function", "db.query", "src/db.ts", 1, 3, True), _n("function", "fetch", "src/net.ts", 1, 3, True, None, {"dynamicUrl": "true"}), _n("function", "exec", "src/net.ts", 4, 6, True), _n("function", "pool.execute", "src/db.ts", 5, 7, True), _n("file", "lonely.ts", "src/lonely.ts", exported=None),
    _n("file", "base.ts", "src/base.ts", exported=None, content="export class Base {\n}\nexport interface Port {\n}\nexport function helper() {\n}\n"), _n("file", "util.ts", "src/util.ts", exported=None, content="export function pad() {\n}\nexport function helper() {\n}\n"),
    _n("file", "impl.ts", "src/impl.ts", exported=None, content="import { Base as B, helper } from './base';\nimport * as util from './util';\nexport class Impl extends Base implements Port {\n}\nexport function start() {\n  helper();\n  util.pad();\n  log('pad()');\n}\n"),
    _n("file", "job.py", "src/job.py", exported=None, content='class Job:\n    """Runs."""\n\n    @once\n    def run(self, n: int = 1, *rest) -> int:\n        return n\n'),
    _n("file", "api.ts", "src/api.ts", exported=None, content="const q = 'select 1';\nfetch(req.query.url);\nfetch('https://a.example');\ndb.query('select ' + req.body.id);\ndb.query('select ?', [id]);\ndb.query(q);\nexec('ls ' + name);\nbox.innerHTML = clean(DOMPurify.sanitize(req.body.text));\n"),
]
_ID = {(n[4].rsplit("/", 1)[-1], n[3]): n[1] for n in _NODES}


def _e(source: tuple[str, str], kind: str, target: tuple[str, str]) -> tuple:
    return (_ID[source], _ID[target], kind)


_EDGES = [
    _e(("all.ts", "all.ts"), "imports", ("mail.ts", "mail.ts")), _e(("index.ts", "index.ts"), "imports", ("mail.ts", "mail.ts")), _e(("fast.ts", "FastStore"), "extends", ("store.ts", "Store")), _e(("store.ts", "Store"), "has_member", ("store.ts", "save")),
    *[_e(("fast.ts", "FastStore"), "has_member", ("fast.ts", m)) for m in ("save", "load", "close", "open")], _e(("fast.ts", "save"), "calls", ("mail.ts", "oldSend")), _e(("mail.ts", "send"), "calls", ("bus.ts", "emitEvent")), _e(("fast.ts", "save"), "calls", ("view.ts", "setInnerHTML")),
    _e(("util.ts", "unusedHelper"), "calls", ("mail.ts", "send")), _e(("mail.ts", "send"), "calls", ("db.ts", "db.query")),
]
_CONTRACTS = [
    ("a", "export", "fetchOrders", [("id", "string"), ("n", "number")], "Order"), ("b", "export", "fetchOrders", [("id", "string"), ("n", "number")], "Order"), ("c", "export", "fetchOrdersLater", [("id", "string")], None), ("b", "route", "GET /orders", None, None), ("d", "route", "GET /orders", [("q", "string")], "Page"),
]


def case_tables(spark: SparkSession) -> str:
    """The folder of the small tables, written by the first query that needs them."""
    rows = [(i, *n) for i, n in enumerate(_NODES)], [(i, *e) for i, e in enumerate(_EDGES)], [(i, *c) for i, c in enumerate(_CONTRACTS)]
    key = hashlib.sha256(repr(rows).encode()).hexdigest()[:16]
    folder = Folder(spark, f"{shared_dir(spark)}/weft-cases-{key}")
    for name, data, schema in zip(("code_nodes", "code_edges", "contracts"), rows, (_NODE, _EDGE, _CONTRACT), strict=True):
        if not folder.exists(f"{name}.parquet/_SUCCESS"):
            spark.createDataFrame(data, schema).withColumn("indexed_at", F.lit("2031-01-01").cast("timestamp_ntz")).coalesce(1).write.mode("overwrite").parquet(folder.at(f"{name}.parquet"))
    return folder.root


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return "[" + ", ".join(f"{{'name': {_sql_value(a)}, 'type': {_sql_value(b)}}}" for a, b in v) + "]"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _sql_table(name: str, rows: list[tuple], schema: str) -> str:
    columns = [c.strip().split(" ")[0] for c in schema.replace("<name: string, type: string>", "").split(",")]
    values = ", ".join("(" + ", ".join(map(_sql_value, (i, *r))) + ")" for i, r in enumerate(rows))
    return f"{name} AS (SELECT *, TIMESTAMP '2031-01-01 00:00:00' AS indexed_at FROM (VALUES {values}) AS t({', '.join(columns)}))"


_TABLES = ", ".join([_sql_table("code_nodes", _NODES, _NODE), _sql_table("code_edges", _EDGES, _EDGE), _sql_table("contracts", _CONTRACTS, _CONTRACT)])


def _case(query):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return query(spark, case_tables(spark))

    return run


def _own_sql(sql: str) -> str:
    _, rest = sql.split(" ", 1)
    recursive = "RECURSIVE " if rest.startswith("RECURSIVE ") else ""
    return f"WITH {recursive}{_TABLES}, {rest.removeprefix('RECURSIVE ')}"


def _rows(columns: str, *rows: tuple) -> str:
    """SQL of rows written by hand."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql_value, r)) + ')' for r in rows)}) AS t({columns})"


def _found(spark: SparkSession, d: str) -> DataFrame:
    return security.name_findings(nodes(spark, d, ["id", "ord", "kind", "name", "file_path", "start_line", "metadata"]), edges(spark, d, ["calls"]))


def _vulnerabilities(spark: SparkSession, d: str) -> DataFrame:
    return security.materialise(_found(spark, d))[0].select("id", "name", "severity")


def _severe(spark: SparkSession, d: str) -> DataFrame:
    return security.at_least(_found(spark, d), "HIGH").select("id", "type")


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return detectors.QUERIES["f3_flows"](spark, d).select("entry", "flow", F.concat_ws(" > ", "steps").alias("steps"))


_SAME = [(graph, ["g5_shared_imports"]), (detectors, ["h3_god_classes", "r1_dead_scoped", "r3_orphan_paths", "d3_deprecated", "d17_overrides"]), (ingestion, ["d11_name_findings"]), (ranking, ["i17_contract_links"])]
QUERIES: dict = {f"{n}_case": _case(m.QUERIES[n]) for m, names in _SAME for n in names}
SQL: dict[str, str] = {f"{n}_case": _own_sql(m.SQL[n]) for m, names in _SAME for n in names}

_FN = "function:r/src/"
QUERIES |= {f"{n}_case": _case(ingestion.QUERIES[n]) for n in ("i1_signatures", "i4_imports", "i7_calls", "i8_heritage", "i9_tiered_calls", "i11_bindings", "d10_findings")}
QUERIES |= {"d14_vulnerabilities_case": _case(_vulnerabilities), "d15_severe_case": _case(_severe), "f3_flows_case": _case(_flows), "f5_flow_steps_case": _case(detectors.QUERIES["f5_flow_steps"]), "sv8_flows_case": _case(detectors.QUERIES["sv8_flows"])}
_FLOW = f"{_FN}util.ts:unusedHelper", f"{_FN}mail.ts:send"
SQL |= {
    "i1_signatures_case": _rows(
        "repo, path, kind, name, qualified, start_line, end_line, parameters, returns, doc, decorators",
        ("r", "r/src/job.py", "class", "Job", "Job", 1, 6, None, None, "Runs.", ""), ("r", "r/src/job.py", "method", "run", "Job.run", 5, 6, "self, n, *rest", "int", None, "once"),
    ),
    "i4_imports_case": _rows("repo, path, target, name", *[("r", f"r/src/{a}.ts", f"r/src/{b}.ts", n) for a, b, n in (("all", "mail", "./mail.js"), ("index", "mail", "./mail.js"), ("impl", "base", "./base"), ("impl", "util", "./util"))]),
    "i7_calls_case": "SELECT source, kind, target, CAST(weight AS DOUBLE) AS weight FROM (" + _rows("source, kind, target, weight", (f"{_FN}impl.ts:start", "calls", f"{_FN}util.ts:helper", "0.5"), (f"{_FN}impl.ts:start", "calls", f"{_FN}util.ts:pad", "0.5")) + ")",
    "i8_heritage_case": _rows("source, kind, target", ("class:r/src/impl.ts:Impl", "extends", "class:r/src/base.ts:Base"), ("class:r/src/impl.ts:Impl", "implements", "interface:r/src/base.ts:Port")),
    "i9_tiered_calls_case": "SELECT source, kind, target, CAST(weight AS DOUBLE) AS weight FROM (" + _rows("source, kind, target, weight", (f"{_FN}impl.ts:start", "calls", f"{_FN}base.ts:helper", "0.9"), (f"{_FN}impl.ts:start", "calls", f"{_FN}util.ts:pad", "0.9")) + ")",
    "i11_bindings_case": _rows("repo, path, local, target, exported", *[("r", f"r/src/{p}.ts", a, f"r/src/{t}.ts", b) for p, a, t, b in (("impl", "B", "base", "Base"), ("impl", "helper", "base", "helper"), ("impl", "util", "util", "*"), ("all", "send", "mail", "send"), ("index", "send", "mail", "send"))]),
    "d10_findings_case": "SELECT path, CAST(line AS BIGINT) AS line, type, sink, severity, cwe FROM (" + _rows("path, line, type, sink, severity, cwe", *[("r/src/api.ts", *x) for x in ((2, "SSRF", "fetch", "HIGH", "CWE-918"), (4, "SQL_INJECTION", "db.query", "HIGH", "CWE-89"), (7, "COMMAND_INJECTION", "exec", "HIGH", "CWE-78"))]) + ")",
    "d14_vulnerabilities_case": f"SELECT 'vuln:' || type || ':' || id AS id, type AS name, severity FROM ({_own_sql(ingestion.SQL['d11_name_findings'])})",
    "d15_severe_case": f"SELECT id, type FROM ({_own_sql(ingestion.SQL['d11_name_findings'])}) WHERE severity IN ('HIGH', 'CRITICAL')",
    "f3_flows_case": _rows("entry, flow, steps", *[(_FLOW[0], i + 1, " > ".join([*_FLOW, e])) for i, e in enumerate((f"{_FN}bus.ts:emitEvent", f"{_FN}db.ts:db.query"))]),
    "sv8_flows_case": _rows("id, n_steps, steps", ("flow:1", 3, "unusedHelper > send > emitEvent"), ("flow:2", 3, "unusedHelper > send > db.query")),
    "f5_flow_steps_case": _rows("source, kind, target, label", *[(f"flow:{i + 1}", "step_of", t, f"step {k}") for i, e in enumerate((f"{_FN}bus.ts:emitEvent", f"{_FN}db.ts:db.query")) for k, t in enumerate([*_FLOW, e])]),
}
