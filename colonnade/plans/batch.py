"""Many queries at once: driver threads that submit jobs into FAIR pools."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from queue import Empty, PriorityQueue

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Done:
    name: str
    worker: int
    seconds: float
    result: object
    error: Exception | None = None


def run_batch(
    spark: SparkSession,
    queries: dict[str, Callable[[], DataFrame]],
    workers: int = 2,
    action: Callable[[DataFrame], object] = DataFrame.count,
    cost: Callable[[str], float] | None = None,
) -> list[Done]:
    """Run all queries, ``workers`` at a time, first come first served; with ``cost``, dearest first,
    so that no long one is left over at the end. A query that fails does not stop the others."""
    waiting: PriorityQueue = PriorityQueue()
    for i, name in enumerate(queries):
        waiting.put((-cost(name) if cost else 0, i, name))
    done: list[Done] = []

    def work(k: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"worker-{k}")
        while True:
            try:
                name = waiting.get_nowait()[2]
            except Empty:
                return
            begun = time.perf_counter()
            try:
                result, error = action(queries[name]()), None
            except Exception as e:  # reported with the query
                result, error = None, e
            done.append(Done(name, k, time.perf_counter() - begun, result, error))

    threads = [InheritableThread(target=work, args=(k,)) for k in range(workers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return done
