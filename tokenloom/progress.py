"""Progress of a running job, from what Spark knows of its tasks: no second pass, and nothing in the job itself."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class _Watched:
    """Tasks of a group of jobs; what a stage had when it was last seen stays counted when it is gone."""

    def __init__(self, spark: SparkSession, group: str):
        self.tracker, self.group, self.stages = spark.sparkContext.statusTracker(), group, {}

    def look(self) -> tuple[int, int]:
        for job in self.tracker.getJobIdsForGroup(self.group):
            info = self.tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = self.tracker.getStageInfo(stage)
                if s:
                    done = max(s.numCompletedTasks, self.stages.get(stage, (0, 0))[0])
                    self.stages[stage] = (done, s.numTasks)
        return sum(d for d, _ in self.stages.values()), sum(n for _, n in self.stages.values())


@contextmanager
def watched(spark: SparkSession, on_progress: Callable[[int, int], None], every: float = 0.25) -> Iterator[None]:
    """While the block runs its jobs, ``on_progress`` gets the tasks that are done and those known of so far, whenever more
    are done, and once more at the end. Files are dealt to tasks by their bytes, so tasks stand for shares of a count."""
    group, stop, said = f"watched-{uuid.uuid4().hex}", threading.Event(), [0]
    context, state = spark.sparkContext, _Watched(spark, group)
    before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")

    def tell(last: bool = False) -> None:
        done, known = state.look()
        if done > said[0] or last:
            said[0] = done
            on_progress(done, known)

    def poll() -> None:
        while not stop.wait(every):
            tell()

    context.setJobGroup(group, "watched")
    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
        context.setLocalProperty("spark.jobGroup.id", before[0])
        context.setLocalProperty("spark.job.description", before[1])
        tell(last=True)
