"""Timed steps whose names show up as Spark job descriptions."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def duration(seconds: float) -> str:
    """12.3s, 4m05s or 2h03m."""
    if seconds < 60:
        return f"{seconds:.1f}s"
    m, s = divmod(int(seconds), 60)
    return f"{m}m{s:02d}s" if m < 60 else f"{m // 60}h{m % 60:02d}m"


@contextmanager
def step(name: str, spark: SparkSession | None = None, say=print) -> Iterator[None]:
    """Say when a step begins, ends or fails, and how long it took."""
    spark = spark or SparkSession.getActiveSession()
    if spark:
        spark.sparkContext.setJobDescription(name)
    began = time.monotonic()
    say(f"{name} ...")
    try:
        yield
    except BaseException:
        say(f"{name} FAILED after {duration(time.monotonic() - began)}")
        raise
    finally:
        if spark:
            spark.sparkContext.setJobDescription(None)
    say(f"{name} done in {duration(time.monotonic() - began)}")
