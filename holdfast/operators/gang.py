"""Fits that pass over their rows many times, as one job whose tasks run side by side and add up numbers between them.

Barrier execution starts all tasks of a stage together.  Each task takes its rows from Spark once and keeps them in the form
that the fit reads; what tasks add up (histograms, gradients) has the size of the model, not of the rows.  A barrier message
of Spark's own takes about a second, so sums go through files in the folder that all executors share; where that is no
mounted folder, they go through barrier messages.  Sums are taken in the order of the tasks: all tasks get the same bits.
"""

from __future__ import annotations

import base64
import os
import sys
import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path, tasks_for

# what tasks run travels with them, so it does not depend on where a worker looks for modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Seconds between two looks for the others' numbers, and after which a task that waits gives up.
LOOK, PATIENCE = 0.0005, 3600.0


def tasks(spark: SparkSession, rows: int) -> int | None:
    """How many tasks run side by side on `rows` rows: what their number asks for, and the cluster has.  None if executors
    come and go, which barrier execution does not allow."""
    wanted = tasks_for(rows)
    if wanted == 1:
        return 1
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    sc = spark.sparkContext._jsc.sc()
    return max(1, min(wanted, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())))


class Peers:
    """The other tasks of a gang, as one of them sees them."""

    def __init__(self, rank: int, size: int, folder: str | None, ask: Callable[[str], list[str]] | None):
        self.rank, self.size, self.folder, self.ask, self.step = rank, size, folder, ask, 0

    def total(self, own: np.ndarray) -> np.ndarray:
        """The sum over all tasks of arrays of one shape."""
        own = np.ascontiguousarray(own, dtype=np.float64)
        if self.size == 1:
            return own
        if self.folder is None:
            said = [np.frombuffer(base64.b64decode(m)) for m in self.ask(base64.b64encode(own.tobytes()).decode())]
            return np.sum(said, axis=0).reshape(own.shape)
        self.step += 1
        mine = self._file(self.step, self.rank)
        own.tofile(f"{mine}.part")
        os.rename(f"{mine}.part", mine)
        out = np.zeros(own.size)
        for rank in range(self.size):
            out += own.reshape(-1) if rank == self.rank else self._read(self._file(self.step, rank), own.size)
        # all have written this step, so all have read the one before
        if self.step > 1:
            os.unlink(self._file(self.step - 1, self.rank))
        return out.reshape(own.shape)

    def _file(self, step: int, rank: int) -> str:
        return f"{self.folder}/{step}-{rank}"

    @staticmethod
    def _read(path: str, size: int) -> np.ndarray:
        parent, until = os.getppid(), time.monotonic() + PATIENCE
        while not os.path.exists(path):
            if os.getppid() != parent or time.monotonic() > until:
                raise RuntimeError(f"no numbers from another task: {path}")
            time.sleep(LOOK)
        return np.fromfile(path, count=size)


def run(rows: DataFrame, by: str, size: int, work: Callable, schema: str) -> DataFrame:
    """`work(batches, peers)` on `size` tasks at the same time, which hold rows by the hash of column `by`.

    Tasks must call `peers.total` equally often.  What the first task yields is the result; read it by one action.
    """
    path = scratch_path(rows.sparkSession, "gang")
    mounted = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    folder = mounted if mounted.startswith("/") and "://" not in mounted else None

    def task(batches):
        if size == 1:
            peers = Peers(0, 1, None, None)
        else:
            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()
            # a name that no earlier attempt of the stage has used
            own = folder and f"{folder}/{context.allGather(uuid.uuid4().hex)[0]}"
            if own:
                os.makedirs(own, exist_ok=True)
            peers = Peers(context.partitionId(), size, own, context.allGather)
        for batch in work(batches, peers):
            if peers.rank == 0:
                yield batch

    return rows.repartition(size, by).mapInArrow(task, schema, barrier=size > 1)
