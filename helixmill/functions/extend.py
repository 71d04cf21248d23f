"""User-supplied work: per chunk of a table, per item of a list, timed and cached."""

from __future__ import annotations

import functools
import logging
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("helixmill")


def by_chunk(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 10_000) -> DataFrame:
    """``work`` on chunks of at most ``rows`` rows of each partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), rows):
                yield work(pdf.iloc[start : start + rows].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def by_item(spark: SparkSession, work: Callable[[str], str], items: Iterable[str], slices: int | None = None) -> list[str | None]:
    """``work`` on every item in parallel, in order; None where it fails."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x in pdf["item"]:
                try:
                    out.append(work(x))
                except Exception:  # a failed item has no result
                    out.append(None)
            yield pd.DataFrame({"position": pdf["position"], "result": out})

    rows = [(i, x) for i, x in enumerate(items)]
    if not rows:
        return []
    df = spark.createDataFrame(rows, "position long, item string").repartition(slices or spark.sparkContext.defaultParallelism)
    return [r["result"] for r in df.mapInPandas(run, "position long, result string").orderBy("position").collect()]


def timed(f: Callable) -> Callable:
    """Log how long a step took."""
    @functools.wraps(f)
    def inner(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            log.info("%s took %.3f s", f.__name__, time.perf_counter() - began)

    return inner


def observed(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """``df`` and an observation that holds its number of rows once it has been used."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


class ResultCache:
    """The latest results by key, at most ``most`` of them."""

    def __init__(self, most: int = 1000) -> None:
        self.most, self._held = most, OrderedDict()

    def get(self, key: str, make: Callable[[], object]) -> object:
        if key not in self._held:
            self._held[key] = make()
            while len(self._held) > self.most:
                self._held.popitem(last=False)
        self._held.move_to_end(key)
        return self._held[key]


def efficiency_score(memory_percent: float, cpu_percent: float, disk_percent: float) -> int:
    """100 less a penalty for each resource that is nearly used up."""
    # From which percentage how much is taken off.
    steps = ((memory_percent, ((80, 20), (60, 10))), (cpu_percent, ((80, 15), (60, 7))), (disk_percent, ((90, 15), (80, 7))))
    return 100 - sum(next((off for limit, off in limits if used > limit), 0) for used, limits in steps)
