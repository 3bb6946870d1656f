from pyspark.sql import functions as F

from weftgraph import graph as G
from weftgraph.functions import text as T
from weftgraph.sources.folder import Folder, Versions
from weftgraph.sources.published import published


def test_folder_files(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "a"))
    assert f.names() == [] and not f.exists()
    f.write("x", "größe\n")
    assert f.read("x") == "größe\n" and f.names() == ["x"] and f.exists("x")
    f.delete("x")
    assert f.names() == []
    spark.range(3).selectExpr("concat(',', id) as value").repartition(3).write.text(f.at("parts"))
    f.join_parts("parts", "all", "[", "]", skip=1)
    assert sorted(f.read("all")[1:-1].replace("\n", "").split(",")) == ["0", "1", "2"]


def test_readers_see_whole_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"), keep=2)
    assert v.current() is None and v.versions() == []
    first = v.save({"t": spark.range(3)})["version"]
    staged = v.stage({"t": spark.range(5)})
    assert v.table("t").count() == 3 and v.current()["version"] == first
    v.publish(staged, ["t"])
    assert v.table("t").count() == 5 and v.versions() == [first, staged]
    v.abort(staged)
    assert v.table("t").count() == 5
    v.save({"t": spark.range(1)})
    assert first not in v.versions() and v.table("t").count() == 1
    v.folder.write("current-99999999999999999999", "{broken")
    assert v.table("t").count() == 1  # an unreadable record is passed over


def test_published_tables_follow_their_input(spark, tmp_path):
    path, built = str(tmp_path / "in.parquet"), []

    def build():
        built.append(1)
        return {"t": spark.read.parquet(path).selectExpr("id * 2 as x")}

    spark.range(3).write.parquet(path)
    for _ in range(2):
        assert {r.x for r in published(spark, [path], "twice", build).table("t").collect()} == {0, 2, 4}
    assert len(built) == 1
    spark.range(5, 7).write.mode("overwrite").parquet(path)
    assert {r.x for r in published(spark, [path], "twice", build).table("t").collect()} == {10, 12} and len(built) == 2


def test_graph_of_odd_rows(spark, tmp_path):
    schema = "ord long, repo string, id string, kind string, name string, file_path string, start_line long, end_line long, exported boolean, content string, metadata string, t string, marks int"
    rows = [
        (1, "r", "a", "file", "old", "p", None, None, None, "x" * 100_000, None, "2031-01-01", 1), (2, "r", "a", "class", "new", "p", 1, 2, True, None, "{", "2031-02-01", 1), (3, "r", "a", "file", "late", "p", 1, 2, True, None, "{", "2030-02-01", 1),
        (4, "r", "b", None, None, None, None, None, None, None, None, None, None), (4, "r", "b", None, None, None, None, None, None, None, None, None, None), (5, "r", None, "file", "none", "p", 1, 1, None, None, None, None, 1),
    ]
    spark.createDataFrame(rows, schema).withColumn("indexed_at", F.to_timestamp_ntz("t")).write.parquet(str(tmp_path / "code_nodes.parquet"))
    got = {r.id: (r.ord, r.kind, r.name) for r in G.nodes(spark, str(tmp_path), ["id", "ord", "kind", "name"]).collect()}
    assert got == {"a": (1, "class", "new"), "b": (4, None, None)}
    assert [r.id for r in G.nodes(spark, str(tmp_path), ["id"], ["class"]).collect()] == ["a"] and G.nodes(spark, str(tmp_path), ["id"], ["file"]).count() == 0
    spark.createDataFrame([(1, "a", "b", "calls"), (2, "a", "b", "calls"), (3, None, "b", "calls"), (4, "a", "b", None)], "ord long, source string, target string, kind string").write.parquet(str(tmp_path / "code_edges.parquet"))
    assert [tuple(r) for r in G.edges(spark, str(tmp_path)).collect()] == [("a", "calls", "b", 1)]


def test_uri_components(spark):
    df = spark.createDataFrame([("a b/c?d=é&f#g+h~i!j'(k)*",), ("",), (None,)], "t string")
    got = df.select(T.uri_encode(F.col("t")).alias("e")).withColumn("d", T.uri_decode(F.col("e"))).collect()
    assert got[0].e == "a%20b%2Fc%3Fd%3D%C3%A9%26f%23g%2Bh~i!j'(k)*" and got[0].d == "a b/c?d=é&f#g+h~i!j'(k)*" and got[1].e == "" and got[2].e is None
    assert spark.range(1).select(T.uri_decode(F.lit("%zz"))).first()[0] is None
