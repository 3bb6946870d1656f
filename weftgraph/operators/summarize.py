"""Summaries of code by an outside model: batches per task, patience with a busy model, a pause when it fails.

The model is any callable from a list of texts to a list of summaries; nothing here knows a provider. A batch that
fails after its attempts leaves its nodes without a summary, so they are candidates again in the next run.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Nodes per call; attempts on a busy model, first and longest wait; failures in a row that open the
#: breaker, and for how long, in seconds.
BATCH, ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, FAILURES, PAUSE = 20, 5, 0.5, 30.0, 5, 60.0
BUSY = ["429", "rate limit", "rate_limit", "ratelimit", "too many requests"]


class BreakerOpen(RuntimeError):
    pass


class Breaker:
    """Lets calls through until ``FAILURES`` in a row have failed, then refuses them for ``PAUSE`` seconds."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.row, self.until = clock, 0, 0.0

    def __call__(self, work: Callable):
        if self.clock() < self.until:
            raise BreakerOpen(f"closed again in {self.until - self.clock():.0f} s")
        if self.until:
            self.row, self.until = 0, 0.0
        try:
            out = work()
        except Exception:
            self.row += 1
            if self.row >= FAILURES:
                self.until = self.clock() + PAUSE
            raise
        self.row = 0
        return out


def patiently(work: Callable, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """The result of ``work``; a busy model is asked again after doubling waits with some chance in them, any other
    error and the last attempt are final."""
    wait = FIRST_WAIT
    while True:
        attempts -= 1
        try:
            return work()
        except Exception as e:
            if attempts <= 0 or not any(b in str(e).lower() for b in BUSY):
                raise
        sleep(min(wait, LONGEST_WAIT) + random.random() * 0.2)
        wait *= 2


def summarize(candidates: DataFrame, model: Callable[[list[str]], list[str]], batch: int = BATCH, attempts: int = ATTEMPTS) -> DataFrame:
    """``id, code_hash, summary`` of candidates (id, code_hash, content); rows of a failed batch are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker = Breaker()
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                try:
                    told = breaker(lambda part=part: patiently(lambda: list(model(list(part["content"]))), attempts))
                except Exception:  # noqa: BLE001  whatever the model raises
                    continue
                if len(told) == len(part):
                    yield part[["id", "code_hash"]].assign(summary=told)

    return candidates.select("id", "code_hash", "content").mapInPandas(run, "id string, code_hash string, summary string")
