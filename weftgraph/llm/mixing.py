"""Mixing sources to target weights, by hash-threshold histograms.

Each source gets a budget of tokens. It is used whole as often as fits; the rest of the budget is the documents
whose hash lies below a threshold, so a larger budget always contains a smaller one. The threshold is found
without sorting: tokens are summed by source and the top bits of the hash, the bucket in which the running sum
passes the budget is split by the next bits, and only that bucket, written apart, is looked at again. Four rounds resolve 48
bits, at most 4096 sums per source and round.

Total size. By default the largest total at which every usable source reaches its share within its repeats; a
given total may leave small sources short, which the report shows. Sources without tokens cannot take part; the
weights of the others are scaled to sum to 1.

Defined cases. Null sources, sources without a target and documents without tokens are not chosen; targets that
are null, not positive or repeated (the first by weight counts) are ignored. Repeated documents are separate
documents. An empty table gives an empty mix and a report with zero shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.session import Stash

_ROUND, _ROUNDS = 12, 4


def plan_mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``docs``: key, source, tokens. Returns the mix (``key, source, tokens, copies``) and the report."""
    stash = Stash(docs.sparkSession, "mixing")
    bits = _ROUND * _ROUNDS
    h = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("mix")), 64 - bits)
    sized = stash.put(docs.where((F.col("tokens") > 0) & F.col("source").isNotNull()).select(key, "source", "tokens", h.alias("__h")), "sized")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n_docs"))
    goal = targets.where((F.col("weight") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("t")).select("source", "t.weight", "t.max_repeats")
    both = goal.join(have, "source", "left").fillna(0, ["available", "n_docs"])
    usable = F.col("available") > 0
    sums = both.agg(F.sum(F.when(usable, F.col("weight"))).alias("w"), F.min(F.when(usable, F.col("max_repeats") * F.col("available") / F.col("weight"))).alias("t"))
    scaled = both.crossJoin(sums)  # one row of totals
    total = F.lit(int(total_tokens)).cast("double") if total_tokens is not None else F.col("t") * F.col("w")
    want = F.when(usable, F.col("weight") / F.col("w") * total).otherwise(0.0)
    budget = F.least(F.floor(want + 1e-6), F.col("max_repeats") * F.col("available"))
    plan = scaled.select("source", "weight", "max_repeats", "available", "n_docs", F.when(usable, F.col("weight") / F.col("w")).otherwise(0.0).alias("target_share"), budget.cast("long").alias("budget"))
    plan = plan.withColumn("full", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("long"))
    plan = stash.put(plan.withColumn("rest", F.col("budget") - F.col("full") * F.col("available")), "plan")

    open_ = plan.where(F.col("rest") > 0).select("source", F.col("rest").alias("__rest"), F.lit(0).cast("long").alias("__at"))
    rows = sized
    for r in range(1, _ROUNDS + 1):
        shift = bits - _ROUND * r
        bucket = F.shiftright("__h", shift)
        inside = rows.join(open_, "source").where(F.shiftright("__h", shift + _ROUND) == F.col("__at"))
        if r > 1:  # about one row in 4096 of the round before
            rows = stash.put(inside.select("source", "tokens", "__h"), f"bucket-{r}")
            inside = rows.join(open_, "source")
        hist = inside.groupBy("source", "__rest", bucket.alias("__b")).agg(F.sum("tokens").alias("__n"))
        upto = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        first = F.min(F.when(F.col("__cum") > F.col("__rest"), F.struct(F.col("__b"), (F.col("__rest") - F.col("__cum") + F.col("__n")).alias("left"))))
        cut = hist.withColumn("__cum", F.sum("__n").over(upto)).groupBy("source").agg(first.alias("c"))
        open_ = stash.put(cut.where(F.col("c").isNotNull()).select("source", F.col("c.left").alias("__rest"), F.col("c.__b").alias("__at")), "open")
    marked = sized.join(plan.select("source", "full"), "source").join(open_.select("source", "__at"), "source", "left")
    copies = F.col("full") + F.when(F.col("__h") < F.col("__at"), 1).otherwise(0)
    mix = marked.select(key, "source", "tokens", copies.cast("long").alias("copies")).where(F.col("copies") > 0)

    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_docs"), F.max("copies").alias("most_repeats"))
    out = plan.join(used, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_repeats"])
    whole = out.agg(F.sum("mixed_tokens").alias("__all"))
    report = out.crossJoin(whole).select(
        "source", "weight", "target_share", "max_repeats", "n_docs", F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"), "mixed_docs", "mixed_tokens", "most_repeats",
        F.when(F.col("__all") > 0, F.col("mixed_tokens") / F.col("__all")).otherwise(0.0).alias("actual_share"),
    )
    return mix, report
