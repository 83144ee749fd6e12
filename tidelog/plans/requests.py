"""Requests around a store: a log line for each, a deadline that cancels its Spark jobs, and their errors."""

from __future__ import annotations

import functools
import logging
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

log = logging.getLogger("tidelog.requests")


class DeadlineExceeded(TimeoutError):
    """A request's jobs were cancelled, as its time was over."""


class LogApplyError(ValueError):
    """A batch of changes could not be applied; none of it was."""

    def __init__(self, batch: str | None, cause: BaseException):
        super().__init__(f"batch {batch or 'without a name'}: {cause}")
        self.batch, self.cause = batch, cause


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancel the Spark jobs that this thread starts inside, once so many seconds are over. What a request had
    committed by then stays, what it had not never appears."""
    sc, group, over = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        over.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel)
    sc.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise DeadlineExceeded(f"not done in {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)
    if over.is_set():
        raise DeadlineExceeded(f"not done in {seconds} s")


def logged(method):
    """Log each call of a method by its name, with how it ended and how long it took."""

    @functools.wraps(method)
    def call(self, *args, **named):
        began, how = time.perf_counter(), "failed"
        try:
            out = method(self, *args, **named)
            how = "ok"
            return out
        finally:
            log.info("%s %s %.3f s", method.__name__, how, time.perf_counter() - began)

    return call
