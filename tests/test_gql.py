import pytest

from weftgraph.plans import gql

NODES = [
    ("fn1", "function", "handleLogin", "auth/login.ts", True, "auth", "typescript"), ("fn2", "function", "handleLogout", "auth/logout.ts", True, "auth", "typescript"), ("fn3", "function", "validateToken", "auth/token.ts", False, "auth", "typescript"),
    ("fn4", "function", "createUser", "user/create.ts", True, "user", "typescript"), ("fn5", "function", "sendEmail", "mail/send.ts", True, "mail", "typescript"), ("fn6", "function", "hashPassword", "auth/crypto.ts", False, "auth", None),
    ("cls1", "class", "UserService", "user/service.ts", True, "user", None), ("cls2", "class", "AuthService", "auth/service.ts", True, "auth", None), ("iface1", "interface", "IUserRepository", "user/repo.ts", True, "user", None),
]
EDGES = [("fn1", "calls", "fn3"), ("fn1", "calls", "fn6"), ("fn4", "calls", "fn5"), ("cls2", "has_member", "fn1"), ("cls1", "implements", "iface1"), ("fn4", "calls", "fn6"), ("fn5", "calls", "nowhere")]


@pytest.fixture(scope="module")
def graph(spark):
    import json

    n = [(i, k, nm, p, e, json.dumps({"cluster": c} | ({"language": lang} if lang else {})), o) for o, (i, k, nm, p, e, c, lang) in enumerate(NODES)]
    nodes = spark.createDataFrame(n, "id string, kind string, name string, file_path string, exported boolean, metadata string, ord long").cache()
    edges = spark.createDataFrame([(*e, o) for o, e in enumerate(EDGES)], "source string, kind string, target string, ord long").cache()
    return nodes, edges


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("FIND class", ["cls1", "cls2"]), ("find * LIMIT 2 OFFSET 1", ["fn2", "fn3"]), ("FIND function OFFSET 4 LIMIT 5", ["fn5", "fn6"]), ('FIND function WHERE name CONTAINS "TOKEN"', ["fn3"]), ("FIND function WHERE name STARTS_WITH 'handle' AND exported = \"true\"", ["fn1", "fn2"]),
        ('FIND * WHERE language != "python"', ["fn1", "fn2", "fn3", "fn4", "fn5"]), ('FIND * WHERE kind IN ["class", "INTERFACE"]', ["cls1", "cls2", "iface1"]), ("FIND * WHERE kind IN []", []), ("FIND function WHERE cluster = mail # note", ["fn5"]), ("FIND nothing", []), ("FIND class LIMIT 0", []),
    ],
)
def test_find(graph, text, want):
    assert ids(gql.run(text, *graph).nodes) == want


def test_total_count_is_before_paging(graph):
    assert gql.run("FIND function LIMIT 1", *graph).total_count() == 6
    assert len(ids(gql.run("FIND function LIMIT 1", *graph, limit=3).nodes)) == 3


def test_count(graph):
    rows = lambda t: [(r.key, r["count"]) for r in gql.run(t, *graph).groups.collect()]
    assert rows("COUNT function") == [("total", 6)]
    assert rows("COUNT nothing") == []
    assert rows("COUNT function GROUP BY cluster") == [("auth", 4), ("user", 1), ("mail", 1)]
    assert rows("COUNT * GROUP BY language") == [("typescript", 5), ("(none)", 4)]
    assert rows("COUNT * GROUP BY exported") == [("true", 7), ("false", 2)]


def test_traverse(graph):
    r = gql.run('TRAVERSE CALLS FROM "handleLogin"', *graph)
    assert sorted(ids(r.nodes)) == ["fn1", "fn3", "fn6"] and r.edges.count() == 2
    back = gql.run("TRAVERSE CALLS FROM hashPassword DEPTH 1 INCOMING", *graph)
    assert sorted(ids(back.nodes)) == ["fn1", "fn4", "fn6"]
    both = gql.run("TRAVERSE CALLS FROM handleLogin DEPTH 2 BOTH", *graph)
    assert sorted(ids(both.nodes)) == ["fn1", "fn3", "fn4", "fn6"]
    dangling = gql.run("TRAVERSE CALLS FROM sendEmail", *graph)
    assert ids(dangling.nodes) == ["fn5"] and dangling.edges.count() == 1
    assert ids(gql.run("TRAVERSE CALLS FROM HANDLELOGIN", *graph).nodes) == []


def test_path(graph):
    path = lambda a, b: [r.length for r in gql.run(f'PATH FROM "{a}" TO "{b}"', *graph).path.collect()]
    assert path("createUser", "sendEmail") == [1]
    assert path("createUser", "handleLogin") == [2]
    assert path("createUser", "createUser") == [] and path("createUser", "IUserRepository") == [] and path("x", "y") == []


@pytest.mark.parametrize("text", ["", "FIND", "FIND function WHERE", "FIND function WHERE name", "FIND function WHERE name = 3", "FIND function LIMIT x", "TRAVERSE CONTAINS FROM a", "PATH FROM a", "COUNT function GROUP kind", "FIND function extra", 'FIND function WHERE name = "open', "FIND ?", "FIND a WHERE b IN [c", "PATH FROM a.ts TO b", "FIND café"])
def test_errors_are_values(text):
    e = gql.parse(text)
    assert isinstance(e, gql.GqlError) and 0 <= e.pos <= len(text)


def test_parse_shapes():
    assert gql.parse("TRAVERSE imports FROM x DEPTH 3 BOTH") == gql.Traverse("imports", "x", 3, "BOTH")
    assert gql.parse(r'FIND * WHERE a = "q\"\n"').where[0].value == 'q"\n'
    assert gql.parse("find Function").kind == "function"
    assert gql.explain(gql.parse("TRAVERSE CALLS FROM a DEPTH 2"), 1000, 9)["cost"] == 16
    assert gql.explain(gql.parse("PATH FROM a TO b"), 10, 9)["cost"] == 19


def test_saved_queries(tmp_path):
    q = gql.SavedQueries(str(tmp_path / "q"))
    assert q.list() == [] and q.load("a") is None
    q.save("b", "FIND class"), q.save("a", "COUNT *")
    assert q.list() == ["a", "b"] and q.load("b") == "FIND class" and q.delete("a") and not q.exists("a") and not q.delete("a")
    with pytest.raises(ValueError):
        q.save("../x", "")


def test_deadline_keeps_what_came(spark):
    import time

    def slow(batches):
        for pdf in batches:
            time.sleep(0.0 if (pdf["id"] < 2).all() else 30.0)
            yield pdf

    df = spark.range(0, 6, 1, 3).mapInPandas(slow, "id long")
    began = time.time()
    rows, cut = gql.within(df, 3.0)
    assert cut and time.time() - began < 20 and {r.id for r in rows} <= {0, 1}
    assert gql.within(spark.range(5), 60.0) == ([*spark.range(5).collect()], False)
    with pytest.raises(Exception, match="raised here"):
        gql.within(spark.range(1).selectExpr("raise_error('raised here')"), 60.0)
