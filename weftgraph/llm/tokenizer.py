"""Byte-level BPE of a public vocabulary, by a contiguous rank array per word.

A text is split by the vocabulary's pre-tokenizer pattern. Each word keeps two short arrays: the starts of its
parts and, for each adjacent pair, the rank of the joined piece. The smallest rank is found by a scan, its
boundary deleted and the two neighbouring ranks refreshed, until no pair has a rank. Words are short, so a scan
of a contiguous array beats a heap; words beyond ``LONG`` bytes use a heap over the same arrays, linked, since
repeated scans would cost the square of the length. Results of words are kept in a bounded table per worker.

Defined cases. Null and empty texts have the empty list. Blank, very long and repeated texts are encoded like
any other; special tokens are never produced, their spelling is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokenizer pattern that the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 96
KEPT_WORDS = 1 << 18
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def word(self, data: bytes) -> list[int]:
        if len(data) > LONG:
            return self._long(data)
        get = self.ranks.get
        starts = list(range(len(data) + 1))
        pair = [get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pair:
            low = min(pair)
            if low == _NONE:
                break
            i = pair.index(low)
            del starts[i + 1]
            del pair[i]
            if i < len(pair):
                pair[i] = get(data[starts[i] : starts[i + 2]], _NONE)
            if i:
                pair[i - 1] = get(data[starts[i - 1] : starts[i + 1]], _NONE)
        return [self.ranks[data[a:b]] for a, b in zip(starts, starts[1:])]

    def _long(self, data: bytes) -> list[int]:
        n = len(data)
        get = self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2], _NONE)) != _NONE]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := get(data[a : end[after[a]]], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, a, end[after[a]]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for w in self.split(text):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8"))
                if len(w) <= LONG:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[w] = ids
            out += ids
        return out


_LOADED: dict[tuple[str, str], BytePairs] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> BytePairs:
    """The encoder of this process; a worker loads a vocabulary once."""
    if (name, folder) not in _LOADED:
        _LOADED[name, folder] = BytePairs(load_ranks(f"{folder}/{name}.tiktoken"))
    return _LOADED[name, folder]


def _present(v) -> str | None:
    return v if isinstance(v, str) else None


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids``: a narrow pass without a shuffle; whole texts, one list per row."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(name, folder)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ids": [np.asarray(enc.encode(_present(t)), dtype=np.int32) for t in pdf["__text"]]})

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``*keep, tokens``; null and empty texts have 0."""

    @F.pandas_udf("long")
    def size(s: pd.Series) -> pd.Series:
        enc = encoder(name, folder)
        return pd.Series([len(enc.encode(_present(t))) for t in s], dtype="int64")

    return docs.select(*keep, size(F.col(text)).alias("tokens"))
