"""Progress and cancellation of running work, by tags on its jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that start in this context can be watched and cancelled by the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def running(spark: SparkSession) -> tuple[int, int]:
    """(tasks that are done, tasks that there are) of the stages that run now."""
    t = spark.sparkContext.statusTracker()
    stages = [s for s in map(t.getStageInfo, t.getActiveStageIds()) if s]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)


def watched(spark: SparkSession, run: Callable[[], object], report: Callable[[int, int], object], every: float = 0.5) -> object:
    """The result of `run`, while `report` hears how far its tasks are; an exception in `report` cancels the work."""
    import threading
    import uuid

    tag, done, failed = f"driftlake-{uuid.uuid4().hex[:8]}", threading.Event(), []

    def listen() -> None:
        while not done.wait(every):
            try:
                report(*running(spark))
            except Exception as e:
                failed.append(e)
                cancel(spark, tag)
                return

    t = threading.Thread(target=listen, daemon=True)
    with tagged(spark, tag):
        t.start()
        try:
            return run()
        except Exception as e:
            if failed:
                raise failed[0] from e
            raise
        finally:
            done.set()
            t.join()
