"""File trees as DataFrames: scan with exclusions, structure nodes, contract files, workspaces.

The scan reads paths and lengths first; the content column is only read for files that pass the predicates.
"""

from __future__ import annotations

import fnmatch
import glob
import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import SUFFIX_LANGUAGE

#: Directories never entered, and the largest file read.
IGNORED_DIRS = [
    "node_modules", ".git", ".svn", ".hg", "dist", "dist-tests", "build", "out", "__pycache__", ".tox", ".pytest_cache", ".mypy_cache", "vendor", "target", ".weftgraph", "coverage", ".next", ".turbo", ".cache", "tmp", "temp",
    ".parcel-cache", ".venv", "venv", ".env", "env", "__snapshots__", ".nyc_output", "storybook-static",
]
MAX_BYTES = 512 * 1024


def language_of(path: Column) -> Column:
    """By the suffix after the last dot, case as written; null if it is not a known one."""
    table = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    return F.try_element_at(table, F.regexp_extract(path, r"\.([^./]+)$", 1))


def exclusion(relative: Column, patterns: list[str]) -> Column:
    """Whether a path is excluded. A glob with a slash tests the whole path, without one every name on it; a
    plain path excludes itself and what is below; a plain name excludes every entry of that name."""
    names = F.split(relative, "/")
    out = F.lit(False)
    for p in (x.strip().rstrip("/") for x in patterns):
        if not p:
            continue
        if re.search(r"[*?\[{]", p):
            rule = "^" + "|".join(fnmatch.translate(x).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") for x in _braces(p)) + "$"
            rule = rule.replace(".*", "[^/]*") if "**" not in p and "/" in p else rule
            out = out | (relative.rlike(rule) if "/" in p else F.exists(names, _matches(rule)))
        elif "/" in p:
            out = out | (relative == p) | relative.startswith(p + "/")
        else:
            out = out | F.array_contains(names, p)
    return out


def _matches(rule: str):
    return lambda name: name.rlike(rule)


def _braces(p: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", p)
    return [q for x in m[1].split(",") for q in _braces(p[: m.start()] + x + p[m.end() :])] if m else [p]


def ignore_patterns(root: str, files: tuple[str, ...] = (".graphignore", ".graphignore.local"), extra: list[str] = ()) -> list[str]:
    """Patterns of the ignore files of a root, one per line with # comments, then those given at call time."""
    out = []
    for name in files:
        path = os.path.join(root, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                out += [x.split("#")[0].strip() for x in f if x.split("#")[0].strip()]
    return [*out, *extra]


def scan(spark: SparkSession, root: str, patterns: list[str] = (), depth: int | None = None, max_bytes: int = MAX_BYTES, all_suffixes: bool = False) -> DataFrame:
    """``path`` (relative), ``language``, ``length``, ``modified``, ``content`` (binary) of the files to analyse."""
    base = "file:" + os.path.abspath(root) if "://" not in root and not root.startswith("file:") else root
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    prefix = re.sub(r"^file:/*", "/", base).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(prefix), "")
    dirs = F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1)
    ok = ~F.exists(dirs, lambda d: d.startswith(".") | d.isin(IGNORED_DIRS)) & (F.col("length") <= max_bytes) & ~exclusion(F.col("rel"), list(patterns))
    files = raw.withColumn("rel", rel).where(ok).withColumn("language", language_of(F.col("rel")))
    if not all_suffixes:
        files = files.where(F.col("language").isNotNull())
    if depth is not None:
        files = files.where(F.size(F.split("rel", "/")) <= depth + 1)
    return files.select(F.col("rel").alias("path"), "language", "length", F.col("modificationTime").alias("modified"), "content")


def structure(paths: DataFrame) -> DataFrame:
    """``id, kind, name, file_path``: one file node per path and one directory node per ancestor."""
    parts = F.split("path", "/")
    files = paths.select(F.lit("file").alias("kind"), F.element_at(parts, -1).alias("name"), F.col("path").alias("file_path"))
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    dirs = paths.select(F.explode(up).alias("file_path")).distinct().select(F.lit("directory").alias("kind"), F.element_at(F.split("file_path", "/"), -1).alias("name"), "file_path")
    return files.unionByName(dirs).select(F.concat_ws(":", "kind", "file_path", "name").alias("id"), "kind", "name", "file_path")


# -- contract files

METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]


def openapi(files: DataFrame) -> DataFrame:
    """``path, name``: METHOD /route for every operation of OpenAPI JSON texts; other files give nothing."""
    doc = files.select("path", F.from_json("text", "paths map<string,map<string,string>>").alias("d"))
    routes = doc.select("path", F.explode("d.paths").alias("route", "ops")).select("path", "route", F.explode(F.map_keys("ops")).alias("method"))
    return routes.where(F.lower("method").isin(METHODS)).select("path", F.concat_ws(" ", F.upper("method"), "route").alias("name"))


def graphql(files: DataFrame) -> DataFrame:
    """``path, name``: Query.field and the like for the root types, type.X for the others."""
    types = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)\btype\s+(\w+[^{]*\{[^}]*\})"), 1)).alias("t"))
    types = types.select("path", F.regexp_extract("t", r"^(\w+)", 1).alias("type"), F.regexp_extract("t", r"(?s)\{(.*)\}", 1).alias("body"))
    fields = types.where(F.col("type").isin("Query", "Mutation", "Subscription")).select("path", "type", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^\s*(\w+)\s*(?:\([^)]*\))?\s*:"), 1)).alias("f")).select("path", F.concat_ws(".", "type", "f").alias("name"))
    return fields.unionByName(types.where(~F.col("type").isin("Query", "Mutation", "Subscription")).select("path", F.concat(F.lit("type."), F.col("type")).alias("name")))


def protobuf(files: DataFrame) -> DataFrame:
    """``path, name, request, response``: Service.Method of every rpc."""
    services = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)\bservice\s+(\w+\s*\{(?:[^{}]|\{[^{}]*\})*\})"), 1)).alias("s"))
    calls = services.select("path", F.regexp_extract("s", r"^(\w+)", 1).alias("svc"), F.explode(F.regexp_extract_all("s", F.lit(r"(\brpc\s+\w+\s*\(\s*(?:stream\s+)?[\w.]+\s*\)\s*returns\s*\(\s*(?:stream\s+)?[\w.]+\s*\))"), 1)).alias("r"))
    part = lambda i: F.regexp_extract("r", r"rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)", i)
    return calls.select("path", F.concat_ws(".", "svc", part(1)).alias("name"), part(2).alias("request"), part(3).alias("response"))


def workspace_packages(root: str) -> list[tuple[str, str]]:
    """(name, relative folder) of the packages of an npm, pnpm, nx or turborepo workspace."""

    def read(name: str) -> dict:
        try:
            with open(os.path.join(root, name), encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    globs = read("package.json").get("workspaces", [])
    globs = list(globs.get("packages", []) if isinstance(globs, dict) else globs)
    pnpm = os.path.join(root, "pnpm-workspace.yaml")
    if os.path.exists(pnpm):
        with open(pnpm, encoding="utf-8") as f:
            globs += re.findall(r"^\s*-\s*['\"]?([^'\"\n#]+?)['\"]?\s*$", f.read(), re.M)
    if not globs and (read("nx.json") or read("turbo.json")):
        globs = ["apps/*", "packages/*", "libs/*"]
    out = []
    for g in globs:
        for folder in sorted(glob.glob(os.path.join(root, g))):
            meta = os.path.join(folder, "package.json")
            if os.path.exists(meta):
                with open(meta, encoding="utf-8") as f:
                    out.append((json.load(f).get("name", os.path.basename(folder)), os.path.relpath(folder, root)))
    return list(dict.fromkeys(out))
