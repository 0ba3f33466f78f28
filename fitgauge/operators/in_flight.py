"""Several Spark jobs at a time from one driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Item = TypeVar("Item")


def in_flight(spark: SparkSession, items: Iterable[Item], work: Callable[[Item], None], limit: int, tag: str) -> None:
    """Calls ``work`` for every item, for up to ``limit`` of them at the same time. Their jobs carry ``tag``.

    Items are taken one by one as threads come free, so that a long list is never held as a whole, and a slow item delays only its own
    thread. An error ends the call once the items that run are done; what they have stored stays.
    """

    def tagged(item: Item) -> None:
        spark.addTag(tag)
        try:
            work(item)
        finally:
            spark.removeTag(tag)

    running: set[Future] = set()

    def settle(done: set[Future]) -> None:
        for future in done:
            future.result()

    with ThreadPoolExecutor(limit, thread_name_prefix=tag) as pool:
        for item in items:
            if len(running) >= limit:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                settle(done)
            running.add(pool.submit(inheritable_thread_target(spark)(tagged), item))
        settle(wait(running).done)
