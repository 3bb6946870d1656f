"""Per-key results when a few keys hold most rows.

Nothing here gathers the values of a key. Ranks are found by exact distributed selection: a histogram of counts that
tasks build for themselves and merge, narrowed round by round to the cells that hold a rank, until each of them is one
value. Quantiles per key are such ranks; so are heavy keys, since a value with a share of 1/k of the rows stands at
one of the k ranks that lie so many rows apart, in any order of the values.

Defined cases. Null keys form no group (their rows still count towards the total that a share refers to).
Null and non-finite values take no part in quantiles, a key without any value has null quantiles. Repeated
rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.session import Stash

_BITS = 16
#: A key with more than this share of all different (key, value) is spread; there are at most 1/share of them.
_SPREAD = 1000


def _melt(df: DataFrame, columns: list[str], keep: list[Column] = ()) -> DataFrame:
    """One row per (column, row): a single scan serves all key columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("ref_column"), F.col(c).cast("string").alias("node_id")) for c in columns])
    return df.select(F.explode(pairs).alias("__p"), *keep).select("__p.ref_column", "__p.node_id", *[k for k in (df.select(*keep).columns if keep else [])])


def heavy_keys(df: DataFrame, columns: list[str], share: str = "1/100") -> DataFrame:
    """Values that stand in at least ``share`` of all rows of a column: ``ref_column, node_id, n_rows``.

    With L the number of rows the share asks for, such a value stands at one of the ranks L, 2L, 3L, ... of the
    column's values in the order of their hashes. These at most ``1/share`` ranks per column are selected: each round
    counts the rows of the cells that still hold a rank by the next 16 bits of the hash, running sums say which cell
    a rank falls into, and a cell of fewer than L rows is dropped. Cells of one hash are resolved; their values are
    counted at the end by the values themselves, so equal hashes cannot change the result. Shuffled are cells, never
    one row per value; the ranks and cells that travel between rounds are at most ``1/share`` per column.
    """
    part = Fraction(share)
    if not 0 < part <= 1:
        raise ValueError("share must be in (0, 1]")
    stash = Stash(df.sparkSession, "heavy")
    rows = _melt(df, columns).withColumn("h", F.xxhash64("node_id"))
    least, done, cells, used = 0, set(), [], 0
    while used < 64:
        cell = F.shiftrightunsigned("h", 64 - _BITS - used)
        inside = rows if not used else rows.where(F.col("node_id").isNotNull() & _among([(c, x) for c, x, _ in cells], F.shiftrightunsigned("h", 64 - used)))
        outer = F.shiftrightunsigned("h", 64 - used) if used else F.lit(0).cast("long")
        hist = inside.groupBy("ref_column", F.col("node_id").isNull().alias("is_null"), outer.alias("outer"), cell.alias("cell")).agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        hist = stash.put(hist, "cells")
        if not used:
            total = hist.where(F.col("ref_column") == columns[0]).agg(F.sum("n")).first()[0] or 0
            least = -(-total * part.numerator // part.denominator)
            if not least:
                break
        # Ranks before the cell: of the whole column in the first round, of the outer cell afterwards.
        before = F.lit(0).cast("long")
        for c, x, n in cells if used else []:
            before = F.when((F.col("ref_column") == c) & (F.col("outer") == x), F.lit(n)).otherwise(before)
        upto = before + F.sum("n").over(Window.partitionBy("ref_column", "outer").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        ranked = hist.where(~F.col("is_null")).withColumn("upto", upto).withColumn("base", F.col("upto") - F.col("n"))
        holds = (F.floor(F.col("upto") / least) > F.floor(F.col("base") / least)) & (F.col("n") >= least)
        found = ranked.where(holds).select("ref_column", "cell", "base", "lo", "hi").collect()  # at most 1/share rows per column
        used += _BITS
        done |= {(r.ref_column, r.lo) for r in found if r.lo == r.hi}
        cells = [(r.ref_column, r.cell, r.base) for r in found if r.lo != r.hi]
        if not cells:
            break
    stash.drop("cells")
    if not done:
        return rows.where(F.lit(False)).select("ref_column", "node_id", F.lit(0).cast("long").alias("n_rows"))
    counts = rows.where(F.col("node_id").isNotNull() & _among(sorted(done), F.col("h"))).groupBy("ref_column", "node_id").agg(F.count("*").alias("n_rows"))
    return counts.where(F.col("n_rows") >= least)


def _among(alive: list[tuple[str, int]], value: Column) -> Column:
    test = F.lit(False)
    for c in sorted({a for a, _ in alive}):
        test = test | ((F.col("ref_column") == c) & value.isin([b for a, b in alive if a == c]))
    return test


def key_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``ref_column, node_id, n_rows, n_other``: rows of every key and distinct non-null other ends.

    ``columns`` is a pair. Rows first collapse to (key, other end), which spreads a hot key over all
    tasks by its other ends; the second aggregation then merges one partial row per task and key. The other end
    travels as 128 bits of hash, so that only keys are shuffled as text.
    """
    a, b = columns
    end = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(F.col(c)).alias("x"), F.xxhash64(F.lit(1), F.col(c)).alias("y")))
    both = F.array(F.struct(F.lit(a).alias("ref_column"), F.col(a).alias("node_id"), end(b).alias("other")), F.struct(F.lit(b).alias("ref_column"), F.col(b).alias("node_id"), end(a).alias("other")))
    pairs = df.select(F.explode(both).alias("p")).select("p.*").where(F.col("node_id").isNotNull()).groupBy("ref_column", "node_id", "other").agg(F.count("*").alias("c"))
    return pairs.groupBy("ref_column", "node_id").agg(F.sum("c").alias("n_rows"), F.count("other").alias("n_other"))


def key_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: list[float], cells: int = 256) -> DataFrame:
    """Exact discrete quantiles per key: ``*keys, q, v`` with v the smallest value whose rank reaches ceil(q*n).

    Counts per (key, value) are merged first. The bracket that holds a rank, at first all values of the key, is cut
    into ``cells``, the cells are counted, and the cell with the rank becomes the next bracket, narrowed to the values
    it really holds, until a bracket is one value; every key takes this way. Counts meet the brackets by (key, slot):
    a key with more than a thousandth of all different values is spread over slots by its values, and its brackets,
    a few numbers, go to all of them, so no task meets the values of a hot key. A cell split is monotone, so rounding
    cannot misplace a rank, and the ends of a bracket always fall in different cells, so every round makes progress.
    """
    spark = df.sparkSession
    stash = Stash(spark, "quantiles")
    k = [F.col(c) for c in keys]
    present = F.lit(True)
    for c in k:
        present = present & c.isNotNull()
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    counts = stash.put(df.where(present & finite).select(*keys, (v + F.lit(0.0)).alias("__v")).groupBy(*keys, "__v").agg(F.count("*").alias("__c")), "counts")
    stats = stash.put(counts.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.count("*").alias("__d"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")), "stats")
    unit = max(1, (stats.agg(F.sum("__d")).first()[0] or 0) // _SPREAD)
    hot = stats.where(F.col("__d") > unit).select(*keys, F.ceil(F.col("__d") / unit).cast("int").alias("__slots"))  # at most _SPREAD rows
    spread = lambda x: x.join(F.broadcast(hot), keys, "left").withColumn("__slots", F.coalesce("__slots", F.lit(1)))
    placed = stash.put(spread(counts).withColumn("__slot", F.pmod(F.xxhash64("__v"), F.col("__slots")).cast("int")).drop("__slots"), "placed")
    stash.drop("counts")

    qs = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("q") * F.col("__n")))
    step = stash.put(stats.withColumn("q", qs).select(*keys, "q", rank.alias("__rank"), "__lo", "__hi"), "open-0")
    done, round_no = [], 0
    while True:
        done.append(step.where(F.col("__lo") == F.col("__hi")).select(*keys, "q", F.col("__lo").alias("v")))
        open_ = step.where(F.col("__lo") < F.col("__hi"))
        if open_.isEmpty():
            break
        round_no += 1
        brackets = spread(open_.select(*keys, F.col("__lo").alias("__a"), F.col("__hi").alias("__b")).distinct()).withColumn("__slot", F.explode(F.sequence(F.lit(0), F.col("__slots") - 1))).drop("__slots")
        inside = placed.join(brackets, [*keys, "__slot"]).where(F.col("__v").between(F.col("__a"), F.col("__b")))
        cell = F.least(F.lit(cells - 1), F.floor((F.col("__v") / 2 - F.col("__a") / 2) / (F.col("__b") / 2 - F.col("__a") / 2) * cells))
        hist = inside.groupBy(*keys, "__a", "__b", cell.alias("__cell")).agg(F.sum("__c").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        order = Window.partitionBy(*keys, "__a", "__b").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("__cum", F.sum("__c").over(order))
        asked = open_.select(*keys, "q", "__rank", F.col("__lo").alias("__a"), F.col("__hi").alias("__b"))
        hit = asked.join(hist, [*keys, "__a", "__b"]).where((F.col("__cum") >= F.col("__rank")) & (F.col("__cum") - F.col("__c") < F.col("__rank")))
        step = stash.put(hit.select(*keys, "q", (F.col("__rank") - F.col("__cum") + F.col("__c")).alias("__rank"), "__lo", "__hi"), f"open-{round_no}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
