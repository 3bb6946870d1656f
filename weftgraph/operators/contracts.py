"""Contracts between repositories: extraction, similarity and matching.

Exact names meet in an equi-join on the name. Contained names need a substring search: every name gives its
substrings of ``GRAM`` letters, a contained name must share its first gram with the longer one, so candidates
meet in an equi-join on (gram) and are then checked; no pair of repos is compared as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORTED_KINDS = ["function", "class", "interface", "method", "type_alias", "constant", "enum", "struct", "trait"]
#: Pairs of type names that agree across languages.
COMPATIBLE = [("string", "str"), ("number", "int"), ("number", "float"), ("number", "double"), ("boolean", "bool"), ("void", "unit"), ("void", "none")]
GRAM = 4


def extract(nodes: DataFrame) -> DataFrame:
    """``repo, kind, name, node_id``: exports, routes, and interfaces named like events or schemas."""
    low = F.lower("name")
    interface = F.col("kind").isin("interface", "type_alias")
    event = low.contains("event") | low.contains("message")
    schema = low.contains("schema") | low.contains("dto") | low.contains("request") | low.contains("response")
    kinds = F.array_compact(F.array(
        F.when(F.col("exported") & F.col("kind").isin(EXPORTED_KINDS), "export"), F.when(F.col("kind") == "route", "route"),
        F.when(interface & event, "event").when(interface & schema, "schema"),
    ))
    return nodes.select("repo", F.explode(kinds).alias("contract"), "name", F.col("id").alias("node_id")).withColumnRenamed("contract", "kind")


def normal_type(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), r"[\[\]?<>\s]", "")


def type_set(parameters: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(parameters, F.array().cast("array<struct<name:string,type:string>>")), lambda p: F.coalesce(normal_type(p["type"]), F.lit(""))), lambda t: t != ""))


def count_of(parameters: Column) -> Column:
    return F.coalesce(F.size(parameters), F.lit(0))


def parameter_similarity(a: Column, b: Column) -> Column:
    sa, sb = type_set(a), type_set(b)
    na, nb = F.greatest(count_of(a), F.lit(0)), F.greatest(count_of(b), F.lit(0))
    jaccard = F.size(F.array_intersect(sa, sb)) / F.size(F.array_union(sa, sb))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).when((F.size(sa) == 0) & (F.size(sb) == 0), 1.0).when((F.size(sa) == 0) | (F.size(sb) == 0), 0.0).otherwise(jaccard)


def return_similarity(a: Column, b: Column) -> Column:
    x, y = normal_type(a), normal_type(b)
    agree = F.lit(False)
    for p, q in COMPATIBLE:
        agree = agree | ((x == p) & (y == q)) | ((x == q) & (y == p))
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(missing, 0.5).when(x == y, 1.0).when(agree, 0.8).otherwise(0.0)


def count_similarity(a: Column, b: Column) -> Column:
    na, nb = F.greatest(count_of(a), F.lit(0)), F.greatest(count_of(b), F.lit(0))
    return 1 - F.abs(na - nb) / F.greatest(na, nb, F.lit(1))


def similarity(name: Column, pa: Column, pb: Column, ra: Column, rb: Column) -> Column:
    types = parameter_similarity(pa, pb)
    score = 0.4 * name + 0.3 * types + 0.2 * return_similarity(ra, rb) + 0.1 * count_similarity(pa, pb)
    return F.when((name > 0.8) & (types > 0.8), F.least(F.lit(1.0), score * 1.2)).otherwise(score)


def match(contracts: DataFrame) -> DataFrame:
    """``provider_repo, provider, consumer_repo, consumer, match_kind, confidence``.

    ``contracts``: ord, repo, kind, name, parameters, return_type. In every other repo a provider meets the last
    consumer of its name; if there is none, consumers whose name contains its own or is contained in it, both of
    at least four letters. The best confidence per pair of names and repos counts."""
    rows = contracts.where(F.col("repo").isNotNull() & F.col("name").isNotNull())
    last = rows.groupBy("repo", "name").agg(F.max(F.struct("ord", "kind", "parameters", "return_type")).alias("c"))
    p = rows.select(F.col("repo").alias("provider_repo"), F.col("name").alias("provider"), F.col("kind").alias("pk"), F.col("parameters").alias("pp"), F.col("return_type").alias("pr"))
    c = last.select(F.col("repo").alias("consumer_repo"), F.col("name").alias("consumer"), F.col("c.kind").alias("ck"), F.col("c.parameters").alias("cp"), F.col("c.return_type").alias("cr"))
    exact = p.join(c, (F.col("provider") == F.col("consumer")) & (F.col("provider_repo") != F.col("consumer_repo")))
    typed = similarity(F.lit(1.0), F.col("pp"), F.col("cp"), F.col("pr"), F.col("cr"))
    sure = F.least(F.lit(1.0), F.greatest(typed, F.when(F.col("pk") == F.col("ck"), 0.9).otherwise(0.6)))
    exact = exact.select("provider_repo", "provider", "consumer_repo", "consumer", F.when(F.col("pk") == "route", "route-match").otherwise("name-match").alias("match_kind"), sure.alias("confidence"))

    names = rows.select("name").distinct().where(F.length("name") >= 4).select("name", F.lower("name").alias("low"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - (GRAM - 1)), lambda i: F.substring(F.col("low"), i, F.lit(GRAM))))
    longer = names.select(F.col("name").alias("long"), F.col("low").alias("ll"), F.explode(grams).alias("gram"))
    shorter = names.select(F.col("name").alias("short"), F.col("low").alias("ls"), F.substring("low", 1, GRAM).alias("gram"))
    inside = longer.join(shorter, "gram").where(F.col("ll").contains(F.col("ls")) & (F.col("long") != F.col("short"))).select("long", "short").distinct()
    either = inside.select(F.col("long").alias("provider"), F.col("short").alias("consumer")).union(inside.select("short", "long")).distinct()
    who = rows.select("repo", "name").distinct()
    near = either.join(who.select(F.col("name").alias("provider"), F.col("repo").alias("provider_repo")), "provider").join(who.select(F.col("name").alias("consumer"), F.col("repo").alias("consumer_repo")), "consumer")
    near = near.where(F.col("provider_repo") != F.col("consumer_repo")).join(who.select(F.col("name").alias("provider"), F.col("repo").alias("consumer_repo")), ["provider", "consumer_repo"], "left_anti")
    near = near.select("provider_repo", "provider", "consumer_repo", "consumer", F.lit("name-match").alias("match_kind"), F.lit(0.4).alias("confidence"))
    best = F.max(F.struct("confidence", "match_kind")).alias("b")
    return exact.unionByName(near).groupBy("provider_repo", "provider", "consumer_repo", "consumer").agg(best).select("provider_repo", "provider", "consumer_repo", "consumer", "b.match_kind", F.round("b.confidence", 6).alias("confidence"))


def filtered(contracts: DataFrame, kind: str | None = None, repo: str | None = None) -> DataFrame:
    out = contracts if kind is None else contracts.where(F.col("kind") == kind)
    return out if repo is None else out.where(F.col("repo") == repo)
