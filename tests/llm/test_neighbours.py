import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import neighbours as N


def groups(seed, n_groups, size, dim, noise):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n_groups, dim))
    x = (c[:, None, :] + noise * rng.normal(size=(n_groups, size, dim))).reshape(-1, dim).astype(np.float32)
    return x * rng.uniform(0.1, 9, size=(len(x), 1)).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(f"id{i}", i, [float(v) for v in r]) for i, r in enumerate(x)], "id string, ord long, embedding array<float>")


def exact(x, k):
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k], s


def test_hilbert_keys_are_a_curve():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = N.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve touch


def test_recall_against_brute_force(spark):
    x = groups(1, 150, 8, 48, 0.35)
    near, names = N.nearest(frame(spark, x), 48, k=5, time=None, block=64, curves=8)
    got = {}
    for r in near.collect():
        got.setdefault(r.vid, []).append(r.other)
    want, _ = exact(x, 5)
    hits = sum(len(set(got[i]) & set(want[i])) for i in range(len(x)))
    assert hits / want.size >= 0.9
    assert names.count() == len(x)


def test_small_input_is_exact(spark):
    x = groups(2, 6, 5, 16, 0.3)
    near, names = N.nearest(frame(spark, x), 16, k=3, time=None)
    _, s = exact(x, 3)
    rows = near.collect()
    for i in range(len(x)):
        mine = [r for r in rows if r.vid == i]
        assert sorted(r.rank for r in mine) == [1, 2, 3]
        assert np.allclose(sorted((r.similarity for r in mine), reverse=True), sorted(s[i], reverse=True)[:3], atol=0.02)
    pairs = {(r.id_a, r.id_b) for r in N.similar_pairs(near, names, 0.7).collect()}
    assert pairs and all(a < b for a, b in pairs)


def test_unusable_and_versions(spark):
    rows = [("a", 1, "2031-01-01", [1.0, 0.0]), ("a", 2, "2031-02-01", [0.0, 1.0]), ("b", 3, None, [0.0, 2.0]), ("c", 4, None, None), ("d", 5, None, [0.0, 0.0]), ("e", 6, None, [float("nan"), 1.0]), ("f", 7, None, [1.0]), ("g", 8, "2031-01-01", [1.0, 0.1]), ("g", 9, "2031-02-01", None), (None, 10, None, [1.0, 1.0]), ("h", 11, None, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id string, ord long, t string, embedding array<float>").withColumn("indexed_at", F.to_timestamp_ntz("t")).withColumn("rank", F.lit(0)).withColumn("vid", F.lit("clash"))
    near, names = N.nearest(df, 2, k=5)
    assert {r.id for r in names.collect()} == {"a", "b", "h"}
    assert {(r.vid, r.other) for r in near.collect()} == {(2, 3), (2, 11), (3, 2), (3, 11), (11, 2), (11, 3)}
    first = {r.vid: r.other for r in near.where("rank = 1").collect()}
    assert first[2] == 3  # equal similarity: the smaller row number


@pytest.mark.parametrize("rows", [[], [("a", 1, [1.0, 2.0])]])
def test_too_few(spark, rows):
    near, names = N.nearest(spark.createDataFrame(rows, "id string, ord long, embedding array<float>"), 2, time=None)
    assert near.collect() == [] and N.similar_pairs(near, names, 0.7).collect() == []


def test_a_hot_group_of_copies(spark):
    x = np.concatenate([np.tile(groups(3, 1, 1, 12, 0.0), (120, 1)), groups(4, 40, 4, 12, 0.2)])
    near, _ = N.nearest(frame(spark, x), 12, k=5, time=None, block=32, curves=4)
    counts = {r.vid: r.n for r in near.groupBy("vid").agg(F.count("*").alias("n")).collect()}
    assert len(counts) == len(x) and set(counts.values()) == {5}
    copies = near.where("vid < 120").agg(F.min("similarity")).first()[0]
    assert copies > 0.999


def near_copies(seed, dim, size, noise):
    """A third of the rows in one group of near copies."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=dim) + noise * rng.normal(size=(size, dim)), groups(seed + 1, size // 4, 8, dim, 0.35)]).astype(np.float32)
    return x[rng.permutation(len(x))]


def recall(near, x, k=5):
    got = {}
    for r in near.collect():
        got.setdefault(r.vid, set()).add(r.other)
    want, _ = exact(x, k)
    return sum(len(got[i] & set(want[i])) for i in range(len(x))) / want.size


def test_a_dense_group_is_searched_whole(spark):
    x = near_copies(5, 64, 800, 0.4)
    near, _ = N.nearest(frame(spark, x), 64, k=5, time=None, block=32, curves=6, side=300)
    assert recall(near, x) >= 0.95
    assert near.groupBy("vid", "other").count().where("count > 1").count() == 0


def test_lists_of_near_copies_are_exact(spark):
    x = near_copies(7, 64, 800, 0.1)
    near, _ = N.nearest(frame(spark, x), 64, k=5, time=None, block=32, curves=4, side=300)
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    copies = np.flatnonzero((s > 0.95).sum(axis=1) > 100)
    rows = near.where(F.col("vid").isin(copies.tolist())).collect()
    assert len(copies) == 800 and len(rows) == 4000
    assert max(abs(r.similarity - s[r.vid, r.other]) for r in rows) < 1e-5
    want = {i: set(np.argsort(-s[i])[:5]) for i in copies}
    assert sum(r.other in want[r.vid] for r in rows) >= 0.995 * len(rows)


def test_neighbours_across_parts(spark):
    angle = np.linspace(0, 1.2, 500)
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1).astype(np.float32)
    found = {}
    for rows_per_task in (40, 100_000):
        near, _ = N.nearest(frame(spark, x), 2, k=4, time=None, block=16, curves=1, axes=1, bits=12, rows_per_task=rows_per_task)
        got = {}
        for r in near.collect():
            got.setdefault(r.vid, set()).add(r.other)
        found[rows_per_task] = sum(i + 1 in got[i] and i in got[i + 1] for i in range(499))
    assert found[40] == found[100_000] == 499
