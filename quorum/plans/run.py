"""Calls to models as a resumable job: recorded, then cached, then called.

Completions are written before they are parsed, so a verdict that can't be read never costs a second call. Equal
requests are made once: keys are deduplicated before any call. A task that is run again may call again what it had not
written, so calls are made at least once.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.sources.store import append_new, with_cache_key

_COMPLETION = "cache_key string, completion string, tokens long, error string"


class RateLimited(Exception):
    """The model asks for a pause."""


@dataclass(frozen=True)
class Completion:
    text: str
    tokens: int


class Client(Protocol):
    def complete(self, prompt: str, *, model: str, seed: int, params: str) -> Completion: ...


@dataclass(frozen=True)
class Retries:
    """Pauses double from ``base`` to ``most`` seconds, times a factor between a half and one and a half."""

    attempts: int = 5
    base: float = 1.0
    most: float = 30.0


def with_retries(call: Callable[[], Completion], retries: Retries, seed: int, sleep: Callable[[float], None] = time.sleep) -> Completion:
    """Calls again after RateLimited only; the last failure is raised."""
    rng = random.Random(seed)
    for attempt in range(retries.attempts):
        try:
            return call()
        except RateLimited:
            if attempt == retries.attempts - 1:
                raise
            sleep(min(retries.most, retries.base * 2**attempt) * (0.5 + rng.random()))
    raise ValueError("one attempt at least is needed")


def bounded(calls: DataFrame, limit: int, threads: int) -> tuple[DataFrame, int]:
    """The calls in as many partitions as may call at once, and the threads of each: their product is within ``limit``.

    The bound is one of the stage, whatever the cluster's size: there are no more tasks than partitions. It presumes that
    tasks aren't run twice at once (speculation off); calls are dealt evenly, so that all partitions work to the end.
    """
    if limit < 1 or threads < 1:
        raise ValueError("a limit and threads of one at least are needed")
    threads = min(threads, limit)
    return calls.repartition(limit // threads), threads


def completions(calls: DataFrame, client: Client, retries: Retries = Retries(), threads: int = 5, limit: int | None = None) -> DataFrame:
    """(cache_key, completion, tokens, error) of each call, ``threads`` at a time in each task and ``limit`` in all."""
    if limit is not None:
        calls, threads = bounded(calls, limit, threads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row) -> tuple:
            try:
                done = with_retries(lambda: client.complete(row.prompt, model=row.model, seed=row.seed, params=row.params), retries, int(row.seed))
                return row.cache_key, done.text, done.tokens, None
            except Exception as error:  # the rows that succeeded are kept, and the run fails after they are written
                return row.cache_key, None, None, f"{type(error).__name__}: {error}"

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch.itertuples())), columns=["cache_key", "completion", "tokens", "error"])

    return calls.select("cache_key", "prompt", "model", "seed", "params").mapInPandas(run, _COMPLETION)


def _load(calls: DataFrame, path: str) -> DataFrame:
    try:
        return calls.sparkSession.read.parquet(path)
    except AnalysisException:
        return calls.sparkSession.createDataFrame([], _COMPLETION)


def run_calls(calls: DataFrame, client: Client, cache: str, retries: Retries = Retries(), threads: int = 5, limit: int | None = None) -> DataFrame:
    """The calls with their completions; those that the cache (a Parquet folder) lacks are made and added to it.

    No more than ``limit`` calls are in flight over all tasks, if it is given.
    """
    calls = with_cache_key(calls)
    todo = calls.join(_load(calls, cache).select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    folder = f"{cache.rstrip('/')}-made"
    made = completions(todo, client, retries, threads, limit)
    made.write.mode("overwrite").parquet(folder)  # once: a second pass over ``made`` would call again
    made = calls.sparkSession.read.parquet(folder)
    append_new(made.where(F.col("error").isNull()), cache, "cache_key")
    failed = made.where(F.col("error").isNotNull()).select("error").first()
    if failed:
        raise RuntimeError(f"a call failed; what succeeded is kept: {failed['error']}")
    return calls.join(_load(calls, cache).drop("error"), "cache_key")
