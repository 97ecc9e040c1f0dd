"""Cancellation of running work by tag, and several reads at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Cancelled(RuntimeError):
    """Work that was cancelled before it began."""


@dataclass
class CancellationToken:
    """Cancels all jobs that were started under it, and refuses new ones from then on."""

    spark: SparkSession
    tag: str = field(default_factory=lambda: f"colscan-{uuid.uuid4().hex}")
    _cancelled: bool = False

    def cancel(self) -> None:
        self._cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @property
    def is_cancelled(self) -> bool:
        return self._cancelled

    @contextmanager
    def running(self):
        """Jobs started in this block, in this thread, are the token's."""
        if self._cancelled:
            raise Cancelled(self.tag)
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        try:
            yield self
        finally:
            sc.removeJobTag(self.tag)


@dataclass
class ReadOptions:
    """How many reads run at once, and the token that stops them."""

    threads: int = 4
    cancel: CancellationToken | None = None


def read_columns(targets: Iterable[DataFrame], action: Callable[[DataFrame], object], options: ReadOptions | None = None) -> list:
    """``action`` (a job, such as ``DataFrame.toArrow``) of each target, some at once; results in the order of the targets.

    Spark already reads all columns and row groups of one target in parallel; this is for several targets. The first error
    ends the rest: reads that have not begun are dropped, and a token's running jobs are cancelled.
    """
    options = options or ReadOptions()

    def one(df: DataFrame):
        if options.cancel is None:
            return action(df)
        with options.cancel.running():
            return action(df)

    pool = ThreadPoolExecutor(max(1, options.threads))
    reads = [pool.submit(one, df) for df in targets]
    try:
        return [r.result() for r in reads]
    except BaseException:
        for r in reads:
            r.cancel()
        if options.cancel is not None:
            options.cancel.cancel()
        raise
    finally:
        pool.shutdown(wait=True, cancel_futures=True)
