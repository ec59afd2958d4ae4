"""Independent actions, run at the same time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Actions at a time; more wait their turn.
AT_ONCE = 8


def together(spark: SparkSession, *actions: Callable[[], Any]) -> list[Any]:
    """The results of actions that don't need one another. Small jobs leave most of a cluster idle; run side by side they share it."""
    if len(actions) < 2:
        return [a() for a in actions]
    with ThreadPoolExecutor(min(AT_ONCE, len(actions))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(a)) for a in actions]]
