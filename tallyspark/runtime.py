"""Slots, deadlines and cancellation of Spark jobs, and a byte-bounded result cache."""

from __future__ import annotations

import contextlib
import os
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .errors import ComputeError, EngineBusy, EngineError, QueryTimeout


class Executor:
    """Runs actions: a few at a time, each up to a deadline, at which its jobs are cancelled."""

    def __init__(self, spark: SparkSession, slots: int = 2, queue_timeout_s: float = 10.0) -> None:
        self.spark, self.queue_timeout_s = spark, queue_timeout_s
        self._slots = threading.BoundedSemaphore(slots)

    @contextlib.contextmanager
    def slot(self) -> Iterator[None]:
        if not self._slots.acquire(timeout=self.queue_timeout_s):
            raise EngineBusy(f"no slot became free within {self.queue_timeout_s:g} s")
        try:
            yield
        finally:
            self._slots.release()

    def run(self, action: Callable[[], Any], deadline: float | None = None) -> Any:
        """The action's result. Spark's failures become compute errors, its jobs' cancellation at the deadline a timeout."""
        context, tag = self.spark.sparkContext, f"tallyspark-{uuid.uuid4().hex}"
        if deadline is not None and deadline <= time.monotonic():
            raise QueryTimeout("the deadline passed before the query began")
        context.addJobTag(tag)
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(deadline - time.monotonic(), stop) if deadline is not None else None
        try:
            if timer is not None:
                timer.daemon = True
                timer.start()
            return action()
        except EngineError:
            raise
        except PySparkException as e:
            if late.is_set():
                raise QueryTimeout("the query ran past its timeout") from None
            raise ComputeError(str(e).split("\n")[0][:500], spark_condition=e.getCondition()) from e
        except Exception as e:
            if late.is_set():
                raise QueryTimeout("the query ran past its timeout") from None
            raise ComputeError(str(e).split("\n")[0][:500]) from e
        finally:
            if timer is not None:
                timer.cancel()
            context.removeJobTag(tag)


class ResultCache:
    """Results by content key, the least recently used dropped beyond a number of bytes. Results are final tables, capped
    in rows, so the driver holds little."""

    def __init__(self, max_bytes: int) -> None:
        self.max_bytes, self.size = max_bytes, 0
        self._lock, self._held = threading.Lock(), OrderedDict()

    def get(self, key: str) -> Any:
        with self._lock:
            if key not in self._held:
                return None
            self._held.move_to_end(key)
            return self._held[key][0]

    def put(self, key: str, value: Any, size: int) -> None:
        with self._lock:
            if size > self.max_bytes:
                return
            self.size += size - self._held.pop(key, (None, 0))[1]
            self._held[key] = (value, size)
            while self.size > self.max_bytes:
                self.size -= self._held.popitem(last=False)[1][1]

    def clear(self) -> None:
        with self._lock:
            self._held.clear()
            self.size = 0


def cpu_limit(root: str = "/sys/fs/cgroup") -> float | None:
    """CPUs that the control group allows, if it limits them."""
    with contextlib.suppress(OSError, ValueError):
        quota, period = (Path(root) / "cpu.max").read_text().split()
        return None if quota == "max" else int(quota) / int(period)
    with contextlib.suppress(OSError, ValueError):
        quota, period = (int((Path(root) / "cpu" / f"cpu.cfs_{x}_us").read_text()) for x in ("quota", "period"))
        return quota / period if quota > 0 else None
    return None


def runtime_check(spark: SparkSession, root: str = "/sys/fs/cgroup") -> dict:
    """Spark's parallelism against the CPUs at hand; a warning if local threads outnumber them."""
    limit, master = cpu_limit(root), spark.sparkContext.master
    cpus = limit or float(os.cpu_count() or 1)
    threads = spark.sparkContext.defaultParallelism
    warnings = [f"{threads} local threads on {cpus:g} CPUs"] if master.startswith("local") and threads > cpus + 0.5 else []
    return {"master": master, "parallelism": threads, "cpu_limit": limit, "cpus": cpus, "warnings": warnings}
