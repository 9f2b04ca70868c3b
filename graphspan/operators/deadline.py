"""Work that is stopped when its time is over.

The jobs that the work starts carry a tag of their own. When the deadline passes, a timer cancels
every job with that tag, again and again until the work has come to its end, since a loop on the
driver may start its next job while the last one is cancelled.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from graphspan.session import clearing

T = TypeVar("T")
_AGAIN = 0.1  # seconds between two cancellations


class DeadlineExceeded(RuntimeError):
    """The work was stopped; `elapsed` is how many seconds it had run."""

    def __init__(self, seconds: float, elapsed: float):
        super().__init__(f"stopped after {elapsed:.3f} s of {seconds:g} s")
        self.elapsed = elapsed


def run_within(spark: SparkSession, work: Callable[[], T], seconds: float | None = None) -> tuple[T, float]:
    """work()'s value and the seconds it took; DeadlineExceeded if it isn't done in time.

    work computes on Spark and returns a value (not a table: what it materialises is cleared at its
    end, however it ends). Other work of the session, in other threads, goes on. A deadline of zero
    or less is over before the work begins; without one nothing is stopped. An error of the work
    itself is raised as it is.
    """
    began = time.monotonic()
    if seconds is not None and seconds <= 0:
        raise DeadlineExceeded(seconds, 0.0)
    context, tag = spark.sparkContext, f"graphspan-{uuid.uuid4().hex}"
    ended, late = threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(seconds):
            return
        late.set()
        while not ended.is_set():
            context.cancelJobsWithTag(tag)
            ended.wait(_AGAIN)

    timer = threading.Thread(target=watch, name=tag, daemon=True) if seconds is not None else None
    context.addJobTag(tag)
    if timer:
        timer.start()
    try:
        with clearing():
            value = work()
    except Exception as error:
        if late.is_set():
            raise DeadlineExceeded(seconds, time.monotonic() - began) from error
        raise
    finally:
        ended.set()
        if timer:
            timer.join()
        context.removeJobTag(tag)
    if late.is_set():  # the last job was done, but not in time
        raise DeadlineExceeded(seconds, time.monotonic() - began)
    return value, time.monotonic() - began
