import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import hierarchy as H
from weftgraph.operators import orphans as O
from weftgraph.operators import skew as K


# -- heavy keys


def test_heavy_keys_match_counts(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.34 else f"k{rng.randrange(300)}", f"v{rng.randrange(40)}") for _ in range(4000)] + [(None, "v1")] * 90 + [("even", None)] * 40
    df = spark.createDataFrame(rows, "source string, target string").withColumn("node_id", F.lit("clash"))
    got = {(r.ref_column, r.node_id): r.n_rows for r in K.heavy_keys(df, ["source", "target"]).collect()}
    want = defaultdict(int)
    for s, t in rows:
        want["source", s] += 1
        want["target", t] += 1
    assert got == {k: n for k, n in want.items() if k[1] is not None and n * 100 >= len(rows)}


def test_heavy_keys_edge_of_share(spark):
    df = spark.createDataFrame([("a",)] * 1 + [(f"x{i}",) for i in range(99)], "source string")
    assert K.heavy_keys(df, ["source"]).count() == 100  # every value holds exactly 1 %
    df = spark.createDataFrame([(f"x{i}",) for i in range(101)], "source string")
    assert K.heavy_keys(df, ["source"]).count() == 0


def test_heavy_keys_empty_and_null(spark):
    empty = spark.createDataFrame([], "source string, target string")
    assert K.heavy_keys(empty, ["source", "target"]).collect() == []
    nulls = spark.createDataFrame([(None, None)] * 5, "source string, target string")
    assert K.heavy_keys(nulls, ["source", "target"]).collect() == []
    with pytest.raises(ValueError):
        K.heavy_keys(empty, ["source"], share="0")


def test_key_counts(spark):
    rows = [("a", "x"), ("a", "x"), ("a", None), ("b", "x"), (None, "x")]
    got = {(r.ref_column, r.node_id): (r.n_rows, r.n_other) for r in K.key_counts(spark.createDataFrame(rows, "source string, target string"), ["source", "target"]).collect()}
    assert got == {("source", "a"): (3, 1), ("source", "b"): (1, 1), ("target", "x"): (4, 2)}


def test_key_quantiles_match_sorting(spark):
    rng = random.Random(2)
    values = defaultdict(list)
    for _ in range(6000):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(30)}"
        v = rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e12, float(rng.randrange(5)), None, float("nan"), float("inf")])
        values[key].append(v)
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(None, 1.0)]
    got = {(r.key, r.q): r.v for r in K.key_quantiles(spark.createDataFrame(rows, "key string, v double"), ["key"], "v", [0.0, 0.25, 0.5, 0.999, 1.0], cells=16).collect()}
    for k, vs in values.items():
        s = sorted(v for v in vs if v is not None and math.isfinite(v))
        for q in (0.0, 0.25, 0.5, 0.999, 1.0):
            assert got[k, q] == s[max(1, math.ceil(q * len(s))) - 1]
    assert len(got) == 5 * len(values)


def test_key_quantiles_empty(spark):
    assert K.key_quantiles(spark.createDataFrame([], "key string, v double"), ["key"], "v", [0.5]).collect() == []


# -- hierarchies


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(parent.get(c, p), p)
    ids = {x for kv in parent.items() for x in kv}
    out = {}
    for i in ids:
        seen, at = [i], i
        while at in parent and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        out[i] = (H.CYCLE, -1, None) if at in parent else (at, len(seen) - 1, " > ".join(reversed(seen)))
    return out, parent


@pytest.mark.parametrize("seed,n,shape", [(1, 60, "random"), (2, 80, "chain"), (3, 50, "star"), (4, 70, "cycles")])
def test_hierarchy_against_walking(spark, seed, n, shape):
    rng = random.Random(seed)
    if shape == "chain":
        links = [(f"n{i:03}", f"n{i - 1:03}") for i in range(1, n)]
    elif shape == "star":
        links = [(f"n{i:03}", "n000") for i in range(1, n)]
    else:
        links = [(f"n{i:03}", f"n{rng.randrange(i):03}") for i in range(1, n)]
    if shape == "cycles":
        links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("tail", "c1"), ("leaf", "tail"), ("self", "self"), ("n010", "zz"), (None, "n1"), ("n2", None)]
    links += links[:5]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "child string, parent string").withColumn("depth", F.lit(1))
    want, parent = brute(links)
    tree = H.hierarchy(df, between=" > ").cache()
    got = {r.id: (r.root_id, r.depth) for r in tree.collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    paths = {r.id: r.path for r in H.paths(tree).collect()}
    assert paths == {k: v[2] for k, v in want.items() if v[2]}
    below = defaultdict(set)
    for i, (_, d, p) in want.items():
        for a in (p or "").split(" > ")[:-1]:
            below[a].add(i)
    assert {r.id: r.size - 1 for r in tree.where("size is not null").collect()} == {i: len(below[i]) for i, v in want.items() if v[2]}
    some = [i for i in list(want)[:7]]
    found = defaultdict(set)
    for r in H.descendants(tree, spark.createDataFrame([(i,) for i in some], "id string")).collect():
        found[r.ancestor].add(r.id)
    assert {i: found[i] for i in some} == {i: below[i] if want[i][2] else set() for i in some}


def test_parent_of_lowest_rank(spark):
    links = spark.createDataFrame([("m", "file:a", 2), ("m", "class:b", 1), ("m", "class:a", 1), ("class:a", "file:a", 2)], "child string, parent string, rank int")
    assert {r.id: r.parent for r in H.hierarchy(links).collect()} == {"m": "class:a", "class:a": "file:a", "file:a": None}
    assert {r.id: r.path for r in H.paths(H.hierarchy(links, between="/"), "/").collect()}["m"] == "file:a/class:a/m"


def test_hierarchy_empty(spark):
    tree = H.hierarchy(spark.createDataFrame([], "child string, parent string"), between=" > ")
    assert tree.collect() == [] and H.paths(tree).collect() == []
    only = H.hierarchy(spark.createDataFrame([("a", "a"), (None, "b")], "child string, parent string"))
    assert [(r.id, r.root_id, r.depth) for r in only.collect()] == [("a", H.CYCLE, -1)]


# -- orphan references


def _tables(spark):
    edges = spark.createDataFrame([(1, "a", "b", "2031-01-05"), (2, "a", "gone", "2031-02-01"), (3, None, "never", None), (4, "late", "a", "2031-02-09"), (4, "a", "gone", "2031-02-01")], "ord long, source string, target string, t string").withColumn("indexed_at", F.to_timestamp_ntz("t"))
    nodes = spark.createDataFrame([("a", "2031-01-01"), ("b", "2031-01-01"), ("b", "2031-03-01"), ("gone", "2031-01-01"), ("late", "2031-09-01"), ("nulltime", None), (None, "2031-01-01")], "id string, t string").withColumn("indexed_at", F.to_timestamp_ntz("t"))
    removals = spark.createDataFrame([("b", "2031-02-01"), ("gone", "2031-01-01"), ("nulltime", "2031-01-01"), ("ghost", "2031-01-01"), (None, "2031-01-01")], "node_id string, t string").withColumn("removed_at", F.to_timestamp_ntz("t"))
    return edges, nodes, removals


def test_orphans(spark):
    edges, nodes, removals = _tables(spark)
    refs = O.references(edges, "code_edges", ["source", "target"])
    state = O.merge_state(O.reference_deltas(refs), O.node_deltas(nodes), O.removal_deltas(removals))
    rows = sorted((r.ref_column, r.ord, r.key) for r in O.orphan_references(refs, state).collect())
    assert rows == [("target", 2, "gone"), ("target", 3, "never"), ("target", 4, "gone")]
    report = {(r.ref_column, r.month): (r.n_refs, r.n_orphans) for r in O.orphan_report(refs, state).collect()}
    assert report["target", "2031-02"] == (3, 2) and report["target", None] == (1, 1) and report["source", "2031-01"] == (1, 0)


def test_orphan_state_is_incremental(spark):
    edges, nodes, removals = _tables(spark)
    refs = O.references(edges, "code_edges", ["source", "target"])
    whole = O.merge_state(O.reference_deltas(refs), O.node_deltas(nodes), O.removal_deltas(removals))
    step = O.merge_state(O.reference_deltas(refs.where("ord < 3")), O.node_deltas(nodes.where("id = 'a'")))
    step = O.merge_state(step, O.reference_deltas(refs.where("ord >= 3")), O.node_deltas(nodes.where("id is null or id <> 'a'")), O.removal_deltas(removals))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, step.collect()), key=str)
    less = O.merge_state(whole, O.reference_deltas(refs.where("key = 'gone'"), sign=-1))
    assert {r.key for r in O.orphan_keys(less).collect()} == {"never"}


def test_ledger_applies_and_withdraws(spark, tmp_path):
    t = lambda rows: spark.createDataFrame(rows, "id string, t string").withColumn("indexed_at", F.to_timestamp_ntz("t"))
    refs = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    gone = t([("a", "2031-02-01")]).select(F.col("id").alias("node_id"), F.col("indexed_at").alias("removed_at"))
    ledger = O.Ledger(spark, str(tmp_path / "ledger"))
    keys = lambda: {(r.key, r.refs) for r in O.orphan_keys(O.Ledger(spark, str(tmp_path / "ledger")).table("state")).collect()}
    ledger.apply(O.reference_deltas(refs), O.node_deltas(t([("a", "2031-01-01"), ("b", "2031-01-01")])))
    assert keys() == set()
    ledger.apply(O.removal_deltas(gone))
    assert keys() == {("a", 1)}
    ledger.apply(O.node_deltas(t([("a", "2031-03-01")])))
    assert keys() == set()
    ledger.apply(O.node_deltas(t([("a", "2031-03-01"), ("b", "2031-01-01")]), sign=-1))
    assert keys() == {("a", 1), ("b", 2)}
    state = ledger.apply(O.removal_deltas(gone, sign=-1), O.reference_deltas(refs.where("key = 'b'"), sign=-1))
    assert keys() == set() and state.where("key = 'b'").count() == 0 and len(ledger.versions()) == 1


def test_quantiles_of_a_hot_key(spark):
    rows = [("hot", float(i % 7919) * 1.5) for i in range(20000)] + [(f"k{i % 50}", float(i)) for i in range(3000)]
    by = {}
    for key, x in rows:
        by.setdefault(key, []).append(x)
    got = {(r.key, r.q): r.v for r in K.key_quantiles(spark.createDataFrame(rows, "key string, v double"), ["key"], "v", [0.5, 0.9]).collect()}
    assert got == {(key, q): sorted(x)[max(1, -(-int(q * 10) * len(x) // 10)) - 1] for key, x in by.items() for q in (0.5, 0.9)}


def test_orphans_empty(spark):
    edges, nodes, removals = (t.where("false") for t in _tables(spark))
    refs = O.references(edges, "code_edges", ["source", "target"])
    state = O.merge_state(O.reference_deltas(refs), O.node_deltas(nodes), O.removal_deltas(removals))
    assert O.orphan_references(refs, state).collect() == [] and O.orphan_report(refs, state).collect() == []
