import pytest

from weftgraph.functions.scanner import fixed, read
from weftgraph.operators import ingest as I
from weftgraph.operators import security as X


def test_calls_arguments_and_statements():
    src = read("a(b(1, 'x, )'), [2, 3])\nc.d(\n  e,\n  f\n)\n// g(h)\nconst K: string = \"v\";\nlist = [\n  1,\n]\nx.y().z(q)\n")
    calls = {c.callee: ([src.cut(a) for a in c.args], src.line(c.start), c.around) for c in src.calls}
    assert calls == {"a": (["b(1, 'x, )')", "[2, 3]"], 1, None), "b": (["1", "'x, )'"], 1, 0), "c.d": (["e", "f"], 2, None), "x.y": ([], 11, None), "x.y().z": (["q"], 11, None)}
    assert [src.line(s) for s, _ in src.statements] == [1, 2, 6, 7, 8, 9, 10, 11, 12]
    assert src.cut(src.bound["K"]) == '"v";' and src.cut(src.bound["list"]) == "["
    assert read("").calls == [] and read("f(((").calls[0].callee == "f" and read("(" * 5000 + ")" * 5000).calls == []
    assert read("# f(x)\ng(1)", hash_notes=True).calls[0].callee == "g" and len(read("f(\n1,\n2,\n3,\n4,\n5,\n6,\n7)\n", span_lines=3).statements) > 1


@pytest.mark.parametrize("text,want", [('"a"', True), ("'a'", True), ("`a`", True), ("`a${b}`", False), ("[1, 'b', [true]]", True), ("[a]", False), ("12.5", True), ("None", True), ("x", False), ("", False), ("'a' + b", False)])
def test_fixed_expressions(text, want):
    assert fixed(text) is want


def flags(spark, language, text):
    df = spark.createDataFrame([("r", "f", language, text)], "repo string, path string, language string, text string")
    return {(r.type, r.sink): r for r in X.signals(df).collect()}


def test_script_sinks(spark):
    got = flags(spark, "javascript", "fetch(req.query.u);\ndb.query(`select ${req.params.i}`);\nbox.innerHTML = req.body.h;\nfs.readFile(req.query.p);\nexec('cat ' + req.query.f);\nprisma.$queryRaw(`x ${a}`);\naxios.post(req.body.u);\nres.html(req.body.h);\nfs.open(req.query.p);\nexecFile('git', [req.query.b]);\npattern.exec(line);\ndocument.write(x);\nview({ dangerouslySetInnerHTML: { __html: req.body.h } });\n")
    assert got["SSRF", "fetch"].hasUserInput and got["SQL_INJECTION", "db.query"].hasTemplateInterpolation and got["XSS", "innerHTML"].hasUserInput and got["PATH_TRAVERSAL", "fs.readFile"].hasUserInput and got["COMMAND_INJECTION", "exec"].hasStringConcat
    assert {("SQL_INJECTION", "prisma.$queryRaw"), ("SSRF", "axios.post"), ("XSS", "html"), ("PATH_TRAVERSAL", "fs.open"), ("COMMAND_INJECTION", "execFile"), ("XSS", "document.write"), ("XSS", "dangerouslySetInnerHTML")} <= got.keys()
    assert got["COMMAND_INJECTION", "execFile"].isDynamic and got["COMMAND_INJECTION", "exec"].source == "'cat ' + req.query.f"


def test_safe_calls(spark):
    got = flags(spark, "typescript", 'fetch("https://a.example");\nconst q = "select 1";\ndb.query("select ? ", [id]);\nknex.raw(q);\nbox.innerHTML = DOMPurify.sanitize(\n  req.body.h\n);\nfs.readFile("/tmp/a (b");\nexec("ls");\nspawn("git", ["status"]);\n')
    dynamic = {k: r.isDynamic for k, r in got.items()}
    assert not any(dynamic[k] for k in [("SSRF", "fetch"), ("SQL_INJECTION", "knex.raw"), ("PATH_TRAVERSAL", "fs.readFile"), ("COMMAND_INJECTION", "exec"), ("COMMAND_INJECTION", "spawn")])
    assert got["SQL_INJECTION", "db.query"].isParameterized and got["XSS", "innerHTML"].hasSanitizer
    got = flags(spark, "typescript", "fetch(assertAllowedHost(req.query.u));\nfs.readFile(safeJoin(base, req.query.p));\n")
    assert all(r.hasSanitizer for r in got.values()) and len(got) == 2
    assert not flags(spark, "typescript", "fetch(`${this.base}/c`, { method: 'PUT', body: text });")["SSRF", "fetch"].hasUserInput
    assert flags(spark, "typescript", "import { D } from 'kuzu';\nconst q = `MATCH ${i}`;\nd.query(q);\n") == {} and ("SQL_INJECTION", "c.query") in flags(spark, "typescript", "c.query(`SELECT ${req.params.i}`);")


@pytest.mark.parametrize(
    "use,dynamic",
    [("TOOLS.filter((t) => t.names.some(exists))", False), ("TOOLS.forEach(exists)", False), ("TOOLS.filter((t) => other.names.some(exists))", True), ("exists(process.argv[2])", True), ("things.forEach(exists)", True), ("TOOLS.forEach(exists); exists(x)", True)],
)
def test_listed_parameters(spark, use, dynamic):
    text = "const TOOLS = [\n  { names: ['a'] },\n];\nfunction exists(bin) {\n  execSync(`which ${bin}`, { stdio: 'pipe' });\n}\n" + use + ";\n"
    assert flags(spark, "typescript", text)["COMMAND_INJECTION", "execSync"].isDynamic is dynamic


@pytest.mark.parametrize(
    "language,lines",
    [
        ("python", 'requests.get(request.args["u"])\ncursor.execute(f"select {request.args[1]}")\nreturn render_template_string(request.form["h"])\nopen(request.args["p"])\nsubprocess.run(request.args["c"], shell=True)'),
        ("go", 'http.Get(r.URL.Query().Get("u"))\ndb.Query("SELECT " + user)\nos.Open(r.URL.Query().Get("p"))\nexec.Command("sh", user).Run()\nrespondText(user)'), ("java", 'HttpClient.newHttpClient().send(request)\nstmt.executeQuery("SELECT " + user)\nPaths.get(user)\nRuntime.getRuntime().exec(user)\nResponse.Write(user)'),
        ("php", 'file_get_contents($_GET["u"])\n$db->query("SELECT " . $_GET["i"])\nfopen($_GET["p"], "r")\nshell_exec($_GET["c"])\nHtml.Raw($_GET["h"])'), ("ruby", 'Net::HTTP.get(params[:u])\ndb.execute("SELECT #{params[:i]}")\nFile.read(params[:p])\nsystem(params[:c])\nhtml_safe(params[:h])'),
        ("c", 'curl_easy_setopt(curl, CURLOPT_URL, argv[1])\nmysql_query(conn, user)\nfopen(argv[1], "r")\nsystem(argv[1])\nResponse.Write(user)'), ("rust", 'reqwest::get(env::args().nth(1))\nconn.execute(user)\nfs::read_to_string(env::args().nth(1))\nCommand::new(user)\nrespondText(user)'),
        ("csharp", 'client.GetAsync(Request.Query["u"])\ncmd.ExecuteReader(user)\nFile.Open(Request.Query["p"])\nProcess.run(user)\nResponse.Write(user)'), ("kotlin", 'httpClient.get(user)\nstmt.executeQuery(user)\nPaths.get(user)\nRuntime.getRuntime().exec(user)\nrespondText(user)'),
        ("swift", 'URLSession.shared.dataTask(with: user)\ndb.execute(user)\nFileManager.default.open(user)\nProcess.run(user)\nrespondText(user)'), ("dart", 'http.get(Uri.parse(user))\ndb.rawQuery(user)\nFile.readAsString(user)\nProcess.run(user, [])\nrespondText(user)'), ("cpp", 'curl_easy_setopt(curl, CURLOPT_URL, argv[1])\ndb.exec(user)\nstd::ifstream open(argv[1])\nsystem(argv[1])\nResponse.Write(user)'),
    ],
)
def test_sinks_of_languages(spark, language, lines):
    got = flags(spark, language, lines + "\n")
    assert {k[0] for k in got} == {"SSRF", "SQL_INJECTION", "PATH_TRAVERSAL", "COMMAND_INJECTION", "XSS"}
    assert any(r.isDynamic for k, r in got.items() if k[0] == "SQL_INJECTION")
    assert flags(spark, language, ('query = "SELECT 1"\n' + ("cursor" if language == "python" else "db") + ".execute(query)\n"))[("SQL_INJECTION", "cursor.execute" if language == "python" else "db.execute")].isDynamic is False


def imported(text, language):
    return I.imports_of(text, language, read(text, hash_notes=language in ("python", "ruby")))


def named(text, language):
    return [i[0] for i in imported(text, language)]


def test_import_bindings(spark):
    assert imported("import D, { a, b as c } from './x.js';\nimport * as ns from './y';\nimport type { T } from './t';\nconst z = require('./z');\nexport { q } from './q';\n", "javascript") == [("./x.js", [("D", "default"), ("a", "a"), ("c", "b")], 1), ("./y", [("ns", "*")], 2), ("./t", [("T", "T")], 3), ("./z", [], 4)]
    assert imported("import os.path as p, sys\nfrom a.b import (c as d,\n  e)\n", "python") == [("os.path", [("p", "*")], 1), ("sys", [("sys", "*")], 1), ("a.b", [("d", "c"), ("e", "e")], 2)]
    assert named('package a\nimport "x/y"\nimport (\n\t"z"\n\tq "w/v"\n)\nvar s = "no"\n', "go") == ["x/y", "z", "w/v"]
    assert named("import java.util.List;\nimport static a.B.c;\n", "java") == ["java.util.List", "a.B.c"]
    assert named("use crate::a::B;\npub use x::y;\n", "rust") == ["crate::a::B", "x::y"] and named("#include <a.h>\n#include \"b.h\"\n", "c") == ["a.h", "b.h"]
    assert named("require_relative 'a'\nrequire('b')\nputs 'c'\n", "ruby") == ["a", "b"]
    rows = [
        ("r", "a.ts", "typescript", "import { go as run } from './b';\nimport * as ns from './c';\nimport Main from './d';\nexport function top() {\n  run();\n  ns.far();\n  Main();\n  near('f()');\n}\n"), ("r", "b.ts", "typescript", "export function go() {\n}\nexport function far() {\n}\n"),
        ("r", "c.ts", "typescript", "export function far() {\n}\n"), ("r", "d.ts", "typescript", "export default function Main() {\n}\n"), ("r", "e.ts", "typescript", "export function near() {\n}\nexport function f() {\n}\nexport function go() {\n}\n"),
    ]
    files = spark.createDataFrame(rows, "repo string, path string, language string, text string")
    symbols, facts = I.parse_and_extract(files)
    imports = I.resolve_imports(facts, files)
    bound = I.resolve_bindings(facts, imports)
    assert {tuple(r) for r in bound.collect()} == {("r", "a.ts", "run", "b.ts", "go"), ("r", "a.ts", "ns", "c.ts", "*"), ("r", "a.ts", "Main", "d.ts", "default")}
    got = {(r.target, r.weight) for r in I.resolve_calls(facts, symbols, imports, bound).where("source like '%top'").collect()}
    assert got == {("function:b.ts:go", 0.9), ("function:c.ts:far", 0.9), ("function:d.ts:Main", 0.9), ("function:e.ts:near", 0.5)}


def test_python_signatures(spark):
    text = 'class A(B):\n    """About A."""\n\n    @property\n    def p(self, x: int, *rest, k=1, **more) -> list[int]:\n        """About p."""\n        def inner(): pass\n\nasync def go(a, /, b): ...\n'
    got = {r.qualified: r for r in I.signatures(spark.createDataFrame([("r", "a.py", "python", text), ("r", "b.py", "python", "def broken(:"), ("r", "c.py", "python", None), ("r", "d.ts", "typescript", "x")], "repo string, path string, language string, text string")).collect()}
    assert set(got) == {"A", "A.p", "A.p.inner", "go"} and got["A"].doc == "About A." and got["A"].kind == "class" and got["A"].parameters is None
    p = got["A.p"]
    assert (p.kind, p.parameters, p.returns, p.doc, p.decorators, p.start_line, p.end_line) == ("method", ["self", "x", "*rest", "k", "**more"], "list[int]", "About p.", ["property"], 5, 7)
    assert got["go"].kind == "function" and got["go"].parameters == ["a", "b"]
