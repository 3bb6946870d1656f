import math

import pytest

from weftgraph.operators import contracts as K
from weftgraph.operators import search as S
from weftgraph.functions import text as T
from pyspark.sql import functions as F

NODE = "id string, ord long, kind string, name string, file_path string, content string, metadata string"


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([
        ("1", 1, "function", "authenticate", "src/auth.ts", "check the password of a user", None), ("2", 2, "function", "logout", "src/auth.ts", "end the session", None), ("3", 3, "class", "UserService", "src/user.ts", "authenticate authenticate users", None),
        ("4", 4, "directory", "authenticate", "src", None, None), ("5", 5, "function", "authenticate", "tests/auth.test.ts", "x", None),
    ], NODE).cache()


def test_bm25(spark, nodes):
    rows = S.bm25(S.build_index(nodes), "authenticate", 10).collect()
    assert [r.id for r in rows][0] in ("3", "5") and {r.id for r in rows} == {"1", "3", "5"}
    assert S.bm25(S.build_index(nodes), "zzz", 10).collect() == [] and S.bm25(S.build_index(nodes.where("false")), "authenticate", 10).collect() == []
    one = spark.createDataFrame([("a", 1, "function", "foo", "p", None, None), ("b", 2, "function", "bar", "p", None, None)], NODE)
    score = S.bm25(S.build_index(one), "foo").collect()[0].score
    assert score == round(math.log((2 - 1 + 0.5) / 1.5 + 1) * 2.2 / (1 + 1.2), 6)


def test_common_terms_are_skipped(spark):
    many = spark.createDataFrame([(str(i), i, "function", "same" if i % 10 else "rare", "p", None, None) for i in range(120)], NODE)
    index = S.build_index(many)
    assert S.bm25(index, "same", None).count() == 0 and S.bm25(index, "rare", None).count() == 12


def test_index_update_equals_fresh_build(spark, nodes):
    changed = nodes.where("id = '2'").withColumn("content", F.lit("authenticate again"))
    up = S.update_index(S.build_index(nodes), changed, nodes.where("id = '5'").select("id"))
    fresh = S.build_index(nodes.where("id not in ('2', '5')").unionByName(changed))
    assert S.bm25(up, "authenticate").collect() == S.bm25(fresh, "authenticate").collect()


def test_lexical(spark):
    n = spark.createDataFrame([("1", 1, "class", "LoginPage", "src/login.ts", None, None), ("2", 2, "function", "login", "src/a.ts", None, None), ("3", 3, "function", "token", "src/b.ts", None, None), ("4", 4, "function", "login", "tests/a.ts", None, None)], NODE)
    assert {r.id for r in S.lexical(n, "how to login portal", 2).collect()} == {"1", "2"}
    assert S.lexical(n, "how to", 5).collect() == []


def test_vectors_and_fusion(spark, nodes):
    v = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 0.0]), ("3", [0.6, 0.8])], "id string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    top = S.vector_top(v, q, 3).collect()
    assert [(r.id, round(r.score, 4)) for r in top] == [("1", 1.0), ("3", 0.6), ("2", 0.0)]
    words = S.ranked(S.bm25(S.build_index(nodes), "authenticate"))
    near = S.ranked(S.vector_top(v, q, 3))
    out = S.hybrid(nodes, words, near, 10).collect()
    assert "5" not in {r.id for r in out} and out[0].lexical_rank is not None
    assert S.fuse(near).where("id = '1'").collect()[0].score == round(1 / 61, 9)
    assert S.scoped("vector", words, None, nodes)[1] == {"requestedMode": "vector", "actualMode": "bm25", "fallbackReason": "vector index unavailable"}
    fed = S.federated(spark.createDataFrame([("r1", "x", 2.0), ("r1", "y", 1.0), ("r2", "x", 9.0)], "repo string, id string, score double")).collect()
    assert [(r.repo, r.id) for r in fed] == [("r1", "x"), ("r2", "x"), ("r1", "y")]
    made = S.embed(nodes.select("id", F.col("name").alias("text")), lambda texts: [[float(len(t))] for t in texts], batch=2)
    assert {r.id: r.embedding for r in made.collect()}["2"] == [6.0]
    assert S.embedding_plan(False, False, 0, 0)[0] == "full" and S.embedding_plan(True, False, 0, 0)[0] == "skip" and S.embedding_plan(True, False, 1, 0)[0] == "incremental"
    assert nodes.select(S.embedding_text().alias("t")).first().t.startswith("function authenticate\nsrc/auth.ts")


def test_text_functions(spark):
    df = spark.createDataFrame([("src/dist/a.ts",), ("src/a.test.ts",), ("lib/a.ts",), ("a.ts",), ("benchmark/a.py",), ("x/fixtures/y.ts",), ("pkg/test_a.py",)], "p string")
    assert [r[0] for r in df.select(T.path_intent(F.col("p"))).collect()] == ["generated", "test", "main", "unknown", "bench", "fixture", "test"]
    row = spark.createDataFrame([("a/b/c.d.ts", "Foo-bar (x) yy", None)], "p string, t string, n string").select(T.basename(F.col("p")).alias("b"), T.dirname(F.col("p")).alias("d"), T.stem(F.col("p")).alias("s"), T.first_segments(F.col("p")).alias("f"), T.lexical_tokens(F.col("t")).alias("k"), T.estimated_tokens(F.col("n")).alias("z"), T.estimated_tokens(F.col("t")).alias("e")).first()
    assert (row.b, row.d, row.s, row.f, row.k, row.z, row.e) == ("c.d.ts", "a/b", "c.d", "a/b", ["foo", "bar", "yy"], 0, 4)


CONTRACT = "ord long, repo string, kind string, name string, parameters array<struct<name:string,type:string>>, return_type string"


def test_contract_similarity(spark):
    def sim(pa, pb, ra, rb):
        df = spark.createDataFrame([(pa, pb, ra, rb)], "pa array<struct<name:string,type:string>>, pb array<struct<name:string,type:string>>, ra string, rb string")
        return df.select(K.parameter_similarity(F.col("pa"), F.col("pb")), K.return_similarity(F.col("ra"), F.col("rb")), F.round(K.similarity(F.lit(1.0), F.col("pa"), F.col("pb"), F.col("ra"), F.col("rb")), 6)).first()

    assert tuple(sim([("a", "string")], [("b", "String")], "string", "str"))[:2] == (1.0, 0.8)
    assert tuple(sim([("a", "string")], [("b", "int")], "x", "y"))[:2] == (0.0, 0.0)
    assert tuple(sim(None, None, None, "y")) == (1.0, 0.5, round(0.9 * 1.2, 6) if 0.9 * 1.2 < 1 else 1.0)
    assert sim([("a", None)], [("b", "int")], "a", "a")[0] == 0.0


def test_contract_matching(spark):
    rows = [(1, "A", "export", "createUser", None, None), (2, "B", "export", "createUser", [("x", "int")], "int"), (3, "B", "route", "createUser", None, None), (4, "C", "export", "createUserNow", None, None), (5, "A", "export", "abc", None, None), (6, "B", "export", "abcdef", None, None), (7, None, "export", "createUser", None, None)]
    got = {(r.provider_repo, r.provider, r.consumer_repo, r.consumer): (r.match_kind, r.confidence) for r in K.match(spark.createDataFrame(rows, CONTRACT)).collect()}
    assert got["A", "createUser", "B", "createUser"] == ("name-match", 1.0)  # the last consumer counts; boosted score
    assert got["A", "createUser", "C", "createUserNow"] == ("name-match", 0.4) and got["C", "createUserNow", "B", "createUser"][1] == 0.4
    assert ("A", "abc", "B", "abcdef") not in got
    assert K.match(spark.createDataFrame([], CONTRACT)).collect() == []


def test_contract_extraction(spark):
    n = spark.createDataFrame([("1", "r", "interface", "UserEvent", True), ("2", "r", "interface", "OrderSchema", False), ("3", "r", "route", "GET /x", None), ("4", "r", "function", "f", None)], "id string, repo string, kind string, name string, exported boolean")
    assert sorted((r.kind, r.name) for r in K.extract(n).collect()) == [("event", "UserEvent"), ("export", "UserEvent"), ("route", "GET /x"), ("schema", "OrderSchema")]
