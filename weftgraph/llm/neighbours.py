"""The most similar vectors for every vector, by shifted space-filling curves.

Vectors are packed to two signed bytes per value, which moves a cosine by about 2e-6 (by 1e-5 if one value outweighs all others). A projection to the leading principal
directions is fitted on a bounded sample (``fit_rows``); each curve rotates and shifts it at random, cuts every
coordinate into 2^bits cells and takes the Hilbert index as a sort key. Spark range-partitions by (key, row
number) into parts of about ``rows_per_task`` rows, so equal keys of a hot group still split over tasks. Each block of
``block`` rows is compared with itself and the next block in one matrix product, also where the next block begins
another part: parts hand out their first and last block, which meet in a job of their own. Every row keeps its best k.
The lists of all curves merge per row. Every row is on every curve; only the projection is fitted on a sample. Equal keys stand in
another order on every curve.

Near copies have no order that a curve could find, so dense groups are searched whole. A row that has a quarter of
its block within ``DENSE`` is in one; tasks send one direction per group, those within ``DENSE`` of each other are
one group, all rows within ``DENSE`` of a direction join the nearest, and every row of a group is compared with every
other in pairs of parts of ``side`` rows.

Cost per curve: one shuffle of the packed vectors and n * 2 * block * dim multiplications. A dense group of m rows
costs m * m * dim multiplications more and a shuffle of m * m / side vectors. Each curve's result is written to the shared folder and its shuffle files are released.

Defined cases. A row is used if its vector is the current one of its id, has the common length and only finite
values, not all zero; null, short, zero and NaN vectors have no neighbours and are nobody's. Equal vectors
are ordinary neighbours with similarity 1; ties go to the smaller row number. An empty table or a single vector
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Stash

#: Cosine from which rows count as near copies of each other.
DENSE = 0.7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned ``cells`` (n x d), by the published transposition of the
    coordinates: undo excess rotations from the top bit down, then Gray-encode and interleave."""
    x = cells.T.astype(np.uint64).copy()
    d, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = q - one
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        flip ^= np.where((x[d - 1] & q) != 0, q - one, np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _pack(vectors: np.ndarray) -> np.ndarray:
    peak = np.abs(vectors).max(axis=1, keepdims=True)
    return np.rint(vectors / peak * 32767).astype("<i2")


def _unpack(blobs: pd.Series, dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), dtype="<i2").reshape(-1, dim).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _best(sim: np.ndarray, vids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each row; ``sim`` is used up. A few passes for the maximum beat a partition."""
    take = min(k, sim.shape[1])
    if take > 16:
        at = np.argpartition(sim, sim.shape[1] - take, axis=1)[:, -take:]
        return np.take_along_axis(sim, at, 1), vids[at]
    rows = np.arange(len(sim))
    at = np.empty((len(sim), take), np.int64)
    top = np.empty((len(sim), take), np.float32)
    for i in range(take):
        at[:, i] = sim.argmax(axis=1)
        top[:, i] = sim[rows, at[:, i]]
        sim[rows, at[:, i]] = -4.0
    return top, vids[at]


def _lists(vid: np.ndarray, sims: list[np.ndarray], ids: list[np.ndarray], k: int) -> pd.DataFrame:
    s, v = np.concatenate(sims, axis=1), np.concatenate(ids, axis=1)
    if s.shape[1] > k:
        at = np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:]
        s, v = np.take_along_axis(s, at, 1), np.take_along_axis(v, at, 1)
    flat = np.concatenate([np.ascontiguousarray(v, "<i8").view(np.uint8), np.ascontiguousarray(s, "<f4").view(np.uint8)], axis=1)
    return pd.DataFrame({"vid": vid, "near": [x.tobytes() for x in flat]})


def _directions(close: np.ndarray, m: np.ndarray, least: int, known: list[np.ndarray]) -> list[np.ndarray]:
    """Mean directions of the groups of rows that have at least ``least`` others ``close``, but for known ones."""
    counts = close.sum(axis=1)
    open_ = counts >= least
    out = []
    while open_.any():
        lead = int(np.where(open_, counts, -1).argmax())
        v = m[close[lead]].mean(axis=0)
        v /= np.linalg.norm(v)
        open_ &= ~close[lead]
        open_[lead] = False
        if not known or (np.stack(known) @ v).max() < 0.95:
            known.append(v)
            out.append(v)
    return out


def _components(v: np.ndarray) -> np.ndarray:
    """A number per direction, the same for those linked by steps of cosine ``DENSE``."""
    group = np.full(len(v), -1)
    for i in range(len(v)):
        todo = [i] if group[i] < 0 else []
        while todo:
            j = todo.pop()
            group[j] = i
            more = np.flatnonzero((v @ v[j] >= DENSE) & (group < 0))
            group[more] = i
            todo += list(more)
    return group


def _dense_lists(keyed: DataFrame, leaders: np.ndarray, dim: int, k: int, side: int, stash: Stash) -> DataFrame:
    """``vid, near``: the best k of every row of a dense group among all others of the group."""
    group = _components(leaders)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sim = _unpack(pdf["q"], dim) @ leaders.T
                at = sim.argmax(axis=1)
                keep = sim[np.arange(len(sim)), at] >= DENSE
                yield pdf.assign(grp=group[at])[keep]

    members = stash.put(keyed.select("vid", "q").mapInPandas(assign, "vid long, q binary, grp long"), "members")
    parts = members.groupBy("grp").agg(F.ceil(F.count("*") / side).cast("int").alias("n"))
    split = members.join(parts, "grp").withColumn("p", F.pmod(F.xxhash64("vid"), F.col("n")).cast("int"))
    split = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    split = split.select("grp", F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b"), "p", "vid", "q")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid")
        vid, m = pdf["vid"].to_numpy(), _unpack(pdf["q"], dim)
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        left = np.ones(len(pdf), bool) if same else (pdf["p"] == pdf["a"]).to_numpy()
        x, xv = m[left], vid[left]
        y, yv = (x, xv) if same else (m[~left], vid[~left])
        out, ys, yi = [], [], []
        if not len(x) or not len(y):
            return pd.DataFrame({"vid": vid[:0], "near": []})
        for s in range(0, len(x), 1024):
            sim = x[s : s + 1024] @ y.T
            if same:
                sim[np.arange(len(sim)), s + np.arange(len(sim))] = -3.0
            else:
                top, ids = _best(np.ascontiguousarray(sim.T), xv[s : s + 1024], k)
                ys.append(top), yi.append(ids)
            top, ids = _best(sim, yv, k)
            out.append(_lists(xv[s : s + 1024], [top], [ids], k))
        if ys:
            out.append(_lists(yv, ys, yi, k))
        return pd.concat(out, ignore_index=True)

    done = stash.put(split.groupBy("grp", "a", "b").applyInPandas(compare, "vid long, near binary"), "dense")
    stash.drop("members")
    return done


def _gathered(lists: DataFrame) -> DataFrame:
    return lists.groupBy("vid").agg(F.collect_list("near").alias("all"))


def _ranked(lists: pd.Series, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best k of the lists of each row: number of the row, neighbour, similarity, rank."""
    blobs = [b for row in lists for b in row]
    r = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    parts = [(np.zeros(0, np.int64), np.zeros(0, "<i8"), np.zeros(0, "<f4"))]
    for size in {len(b) for b in blobs} - {0}:  # one size but for the smallest inputs
        here = [i for i, b in enumerate(blobs) if len(b) == size]
        m = size // 12
        raw = np.frombuffer(b"".join([blobs[i] for i in here]), np.uint8).reshape(-1, size)
        parts.append((np.repeat(r[here], m), raw[:, : 8 * m].copy().view("<i8").ravel(), raw[:, 8 * m :].copy().view("<f4").ravel()))
    r, o, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    real = s > -2  # fewer neighbours than k leave fillers
    r, o, s = r[real], o[real], s[real]
    at = np.lexsort((-s, o, r))
    r, o, s = r[at], o[at], s[at]
    first = np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])] if len(r) else np.zeros(0, bool)
    r, o, s = r[first], o[first], s[first]
    at = np.lexsort((o, -s, r))
    r, o, s = r[at], o[at], s[at]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)])) + 1
    top = rank <= k
    return r[top], o[top], s[top], rank[top].astype("int32")


def packed_vectors(rows: DataFrame, dim: int, id_col: str, number: str, vector: str, time: str | None) -> DataFrame:
    """``vid, id, q``: the packed current vector of every id that has a usable one."""
    times = [F.col(time).alias("__t")] if time else [F.lit(0).alias("__t")]
    slim = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(number).cast("long").alias("vid"), *times, F.col(vector).cast("array<float>").alias("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["v"].map(lambda a: len(a) if isinstance(a, (np.ndarray, list)) else -1).to_numpy()
            q = np.full(len(pdf), None, dtype=object)
            at = np.flatnonzero(n == dim)
            if len(at):
                m = np.stack([np.asarray(a, dtype=np.float32) for a in pdf["v"].iloc[at]])
                good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                for i, row in zip(at[good], _pack(m[good]), strict=True):
                    q[i] = row.tobytes()
            yield pd.DataFrame({"id": pdf["id"], "vid": pdf["vid"], "__t": pdf["__t"], "q": q})

    kind = dict(slim.dtypes)["__t"]
    done = slim.mapInPandas(pack, f"id string, vid long, __t {kind}, q binary")
    best = done.groupBy("id").agg(F.max(F.struct("__t", "vid", "q")).alias("b"))
    return best.select("b.vid", "id", "b.q").where(F.col("q").isNotNull())


def _release(spark) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def nearest(
    rows: DataFrame, dim: int, k: int = 5, *, id_col: str = "id", number: str = "ord", vector: str = "embedding", time: str | None = "indexed_at",
    curves: int = 10, block: int = 640, project: int = 24, axes: int = 12, bits: int = 5, fit_rows: int = 20000, seed: int = 7, side: int = 8192, rows_per_task: int = 16384,
) -> tuple[DataFrame, DataFrame]:
    """Returns (``vid, rank, other, similarity`` with rank from 1, ``vid, id``). ``number`` is unique per row. Inputs of
    any size take the same way; one of fewer than two blocks is one window."""
    spark = rows.sparkSession
    stash = Stash(spark, "neighbours")
    base = stash.put(packed_vectors(rows, dim, id_col, number, vector, time), "base")
    n = base.count()
    _release(spark)
    share = min(1.0, 1.2 * fit_rows / max(n, 1))
    fit = base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(fit_rows).select("q").toPandas()
    if len(fit) < 2:
        fit = base.limit(fit_rows).select("q").toPandas()
    names = stash.put(base.select("vid", "id"), "names")
    if n < 2 or len(fit) < 1:
        return spark.createDataFrame([], "vid long, rank int, other long, similarity float"), names

    sample = _unpack(fit["q"], dim)
    mean = sample.mean(axis=0)
    kept = min(project, dim)
    _, directions = np.linalg.eigh(np.cov((sample - mean).T) if len(sample) > 1 else np.eye(dim))
    leading = directions[:, ::-1][:, :kept].astype(np.float32)
    rng = np.random.default_rng(seed)
    d = min(axes, kept)
    maps, shifts = [], []
    for _ in range(curves):
        turn, _r = np.linalg.qr(rng.normal(size=(kept, kept)))
        m = (leading @ turn[:, :d]).astype(np.float32)
        spread = ((sample - mean) @ m).std(axis=0) + 1e-9
        maps.append(m / spread / 3.0)
        shifts.append(rng.uniform(-0.3, 0.3, d).astype(np.float32))
    every = np.concatenate(maps, axis=1)
    offset = mean @ every

    def with_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            p = _unpack(pdf["q"], dim) @ every - offset
            out = {"vid": pdf["vid"], "q": pdf["q"]}
            for c in range(curves):
                z = p[:, c * d : (c + 1) * d] + shifts[c]
                cells = np.clip((z + 1.3) / 2.6 * (1 << bits), 0, (1 << bits) - 1).astype(np.uint64)
                out[f"k{c}"] = hilbert_keys(cells, bits)
            yield pd.DataFrame(out)

    keyed = stash.put(base.select("vid", "q").mapInPandas(with_keys, "vid long, q binary, " + ", ".join(f"k{c} long" for c in range(curves))), "keyed")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks():
            parts, have = [], 0
            for pdf in batches:
                parts.append(pdf)
                have += len(pdf)
                if have < block:
                    continue
                whole = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
                cut = have - have % block
                for s in range(0, cut, block):
                    yield whole.iloc[s : s + block]
                parts, have = [whole.iloc[cut:]], have - cut
            if have:
                yield pd.concat(parts, ignore_index=True)

        last, known, place = None, [], TaskContext.get().partitionId()
        handed = lambda x, end: pd.DataFrame({"vid": x["vid"], "near": x["q"], "part": place, "end": end})
        part = None
        for part in blocks():
            vid, m = part["vid"].to_numpy(), _unpack(part["q"], dim)
            if last is None:
                yield handed(part, 1)
            own = m @ m.T
            np.fill_diagonal(own, -3.0)
            fresh = _directions(own >= DENSE, m, block // 4, known)
            if fresh:
                yield pd.DataFrame({"vid": pd.array([None] * len(fresh), "Int64"), "near": [x.astype("<f4").tobytes() for x in fresh], "part": place, "end": 0})
            s, v = _best(own, vid, k)
            now = (vid, m, [s], [v])
            if last is not None:
                cross = last[1] @ m.T
                s, v = _best(np.ascontiguousarray(cross.T), last[0], k)
                now[2].append(s), now[3].append(v)
                s, v = _best(cross, vid, k)
                last[2].append(s), last[3].append(v)
                yield _lists(last[0], last[2], last[3], k).assign(part=place, end=0)
            last = now
        if last is not None:
            yield _lists(last[0], last[2], last[3], k).assign(part=place, end=0)
            yield handed(part, 2)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        """The last block of a part against the first of the next."""
        x, y = pdf[pdf["end"] == 2], pdf[pdf["end"] == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"vid": pdf["vid"].iloc[:0], "near": []})
        sim = _unpack(x["near"], dim) @ _unpack(y["near"], dim).T
        back = _best(np.ascontiguousarray(sim.T), x["vid"].to_numpy(), k)
        there = _best(sim, y["vid"].to_numpy(), k)
        return pd.concat([_lists(x["vid"].to_numpy(), [there[0]], [there[1]], k), _lists(y["vid"].to_numpy(), [back[0]], [back[1]], k)], ignore_index=True)

    stash.drop("base")  # from here on the packed vectors are those of the keyed table
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r, o, s, rank = _ranked(pdf["all"], k)
            yield pd.DataFrame({"vid": pdf["vid"].to_numpy()[r], "rank": rank, "other": o, "similarity": s})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r, o, s, _ = _ranked(pdf["all"], k)
            ends = np.searchsorted(r, np.arange(len(pdf) + 1))
            o, s = o.astype("<i8"), s.astype("<f4")
            yield pd.DataFrame({"vid": pdf["vid"], "near": [o[i:j].tobytes() + s[i:j].tobytes() for i, j in zip(ends, ends[1:])]})

    parts = -(-n // rows_per_task)
    steps: dict[str, DataFrame] = {}
    leaders: list[np.ndarray] = []
    for c in range(curves):
        order = [F.col("key"), F.col("tie")]
        line = keyed.select("vid", F.col(f"k{c}").alias("key"), F.xxhash64("vid", F.lit(c)).alias("tie"), "q").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        step = stash.put(line.mapInPandas(windows, "vid long, near binary, part int, end int"), f"curve-{c}")
        # One direction per dense group and task of a curve.
        leaders += [np.frombuffer(r.near, "<f4") for r in step.where(F.col("vid").isNull()).select("near").collect()]
        lists = step.where(F.col("vid").isNotNull() & (F.col("end") == 0)).select("vid", "near")
        # Parts follow each other in the order of the curve; those without rows are passed over.
        held = [r.part for r in step.where(F.col("end") == 2).select("part").distinct().orderBy("part").collect()]  # one number per task
        if len(held) > 1:
            following = F.create_map(*[F.lit(x) for i, p in enumerate(held) for x in (p, i)])[F.col("part")]
            edge = step.where(F.col("end") > 0).withColumn("edge", following - F.when(F.col("end") == 1, 1).otherwise(0))
            lists = lists.unionByName(edge.select("edge", "vid", "near", "end").groupBy("edge").applyInPandas(across, "vid long, near binary"))
        steps[f"curve-{c}"] = lists
        _release(spark)
        if len(steps) == 4 and c < curves - 1:  # one list per row instead of four
            done = stash.put(_gathered(reduce(DataFrame.unionByName, steps.values())).mapInPandas(fold, "vid long, near binary"), f"fold-{c}")
            for slot in steps:
                stash.drop(slot)
            steps = {f"fold-{c}": done}
            _release(spark)

    found = reduce(DataFrame.unionByName, steps.values())
    if leaders:
        found = found.unionByName(_dense_lists(keyed, np.stack(leaders), dim, k, side, stash))
        _release(spark)
    stash.drop("keyed")

    return _gathered(found).mapInPandas(merge, "vid long, rank int, other long, similarity float"), names


def similar_pairs(near: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b), distinct: pairs at least ``least`` similar where one names the other."""
    pairs = near.where(F.col("similarity") >= least).select(F.least("vid", "other").alias("a"), F.greatest("vid", "other").alias("b")).distinct()
    first = names.select(F.col("vid").alias("a"), F.col("id").alias("x"))
    second = names.select(F.col("vid").alias("b"), F.col("id").alias("y"))
    both = pairs.join(first, "a").join(second, "b")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
