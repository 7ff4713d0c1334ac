"""What a run read, wrote and took, by Spark's own metrics of its stages."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass
class Measures:
    """Filled when the measured block ends. Bytes are those of the files, compressed as they lie; of those read, Spark counts what the tasks' own threads fetch."""

    elapsed_s: float = 0.0
    task_s: float = 0.0
    stages: int = 0
    rows_in: int = 0
    bytes_in: int = 0
    rows_out: int = 0
    bytes_out: int = 0
    shuffle_bytes: int = 0
    spill_bytes: int = 0

    def rates(self, cells: int) -> dict:
        """Cells, and bytes read and written, a second."""
        seconds = max(self.elapsed_s, 1e-9)
        return {"cells_per_s": cells / seconds, "bytes_in_per_s": self.bytes_in / seconds, "bytes_out_per_s": self.bytes_out / seconds}

    def __str__(self) -> str:
        mb = lambda n: f"{n / 1e6:.1f} MB"
        return (
            f"{self.elapsed_s:.2f} s ({self.task_s:.2f} s of tasks, {self.stages} stages); read {self.rows_in} rows, {mb(self.bytes_in)}; "
            f"wrote {self.rows_out} rows, {mb(self.bytes_out)}; shuffled {mb(self.shuffle_bytes)}, spilled {mb(self.spill_bytes)}"
        )


@contextmanager
def measured(spark: SparkSession) -> Iterator[Measures]:
    """Measure the jobs that this thread runs inside the block."""
    context, out, group, began = spark.sparkContext, Measures(), uuid.uuid4().hex, time.time()
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, "measured run")
    try:
        yield out
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)
        out.elapsed_s = time.time() - began
        scala = context._jsc.sc()
        # Metrics come with events, which may still be on their way.
        scala.listenerBus().waitUntilEmpty()
        store, tracker = scala.statusStore(), context.statusTracker()
        for job in tracker.getJobIdsForGroup(group):
            for stage in tracker.getJobInfo(job).stageIds:
                try:
                    seen = store.lastStageAttempt(stage)
                except Py4JJavaError:
                    continue  # never ran: what it would have written was there
                if str(seen.status()) == "SKIPPED":
                    continue
                out.stages += 1
                out.task_s += seen.executorRunTime() / 1000
                out.rows_in += seen.inputRecords()
                out.bytes_in += seen.inputBytes()
                out.rows_out += seen.outputRecords()
                out.bytes_out += seen.outputBytes()
                out.shuffle_bytes += seen.shuffleWriteBytes()
                out.spill_bytes += seen.diskBytesSpilled()
