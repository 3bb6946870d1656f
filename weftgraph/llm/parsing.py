"""Source files that do not parse, per file and as rates per repository and language.

Each file is read by the generalised parser with the grammar of its suffix, all dialects at once; it is flagged
if every dialect rejects it. Files are parsed where they lie and only the verdict is shuffled to find the current
version of an id. The steps that a worker has learnt serve all files of its partitions.

Defined cases. Null content is not judged. Empty and blank content and a leading byte-order mark are valid,
except that an empty JSON text is not. A NUL character is never valid. Unknown suffixes, YAML and properties
files are not judged. Very long files are parsed whole. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.grammars import LANGUAGE_OF, NAMES, language
from weftgraph.tables import current


def parses(path: str | None, text: str | None) -> bool | None:
    """None where there is nothing to judge."""
    if not isinstance(path, str) or not isinstance(text, str):
        return None
    _, dot, suffix = path.rsplit("/", 1)[-1].rpartition(".")
    lang = language(suffix.lower()) if dot else None
    if lang is None:
        return None
    return lang.parses(text.removeprefix("﻿"))


def language_name(path: Column, metadata: Column) -> Column:
    """By suffix, else by the ``language`` of the metadata where that is readable; lower case."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for s, k in LANGUAGE_OF.items() for x in (s, NAMES[k])])
    told = F.lower(F.trim(F.get_json_object(metadata, "$.language")))
    return F.coalesce(F.try_element_at(known, suffix), F.when(told != "", told), F.when(suffix != "", suffix), F.lit("unknown"))


def verdicts(nodes: DataFrame) -> DataFrame:
    """``id, repo, language, ok`` of current file rows; ok is null where nothing was judged."""
    files = nodes.where((F.col("kind") == "file") & F.col("id").isNotNull()).select("id", "ord", "indexed_at", "repo", language_name(F.col("file_path"), F.col("metadata")).alias("language"), "file_path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [parses(p, t) for p, t in zip(pdf["file_path"], pdf["content"], strict=True)]
            yield pdf[["id", "ord", "indexed_at", "repo", "language"]].assign(ok=pd.array(ok, dtype="boolean"))

    judged = files.mapInPandas(run, "id string, ord long, indexed_at timestamp_ntz, repo string, language string, ok boolean")
    return current(judged, ["id", "repo", "language", "ok"])


def rates(verdict: DataFrame) -> DataFrame:
    """``repo, language, n_files, n_bad, rate`` over judged files."""
    bad = F.sum((~F.col("ok")).cast("long"))
    return verdict.where(F.col("ok").isNotNull()).groupBy("repo", "language").agg(F.count("*").alias("n_files"), bad.alias("n_bad"), F.round(bad / F.count("*"), 6).alias("rate"))
