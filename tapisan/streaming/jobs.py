"""Runs as jobs of a session: started, listed, paused, stopped, and watched while they go on."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Job:
    """A run and what it has come to; states are QUEUED, RUNNING, PAUSED, COMPLETED, FAILED and STOPPED."""

    id: str
    name: str
    status: str = "QUEUED"
    processed: int = 0
    saved: int = 0
    error: str = ""
    started_at: float = 0.0
    finished_at: float = 0.0
    events: list = field(default_factory=list)


class Jobs:
    """Jobs of a session. Each runs in a job group of its own, so stopping one cancels its Spark jobs and no others'."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs, self.lock = spark, {}, threading.RLock()
        self.open, self.stopped, self.threads = {}, {}, {}

    def start(self, name: str, batches: Iterable[Callable[[], tuple[int, int]]], target: int | None = None) -> str:
        """Runs the batches one after another; each gives (processed, saved). The run ends when `target` are saved."""
        job = Job(uuid.uuid4().hex[:12], name)
        self.jobs[job.id], self.open[job.id], self.stopped[job.id] = job, threading.Event(), threading.Event()
        self.open[job.id].set()
        thread = InheritableThread(target=self._run, args=(job, batches, target), daemon=True, session=self.spark)
        self.threads[job.id] = thread
        thread.start()
        return job.id

    def _set(self, job: Job, status: str, **more) -> None:
        with self.lock:
            job.status = status
            for k, v in more.items():
                setattr(job, k, v)
            job.events.append((time.time(), status, job.processed, job.saved))

    def _run(self, job: Job, batches, target) -> None:
        self.spark.sparkContext.setJobGroup(job.id, job.name, True)
        self._set(job, "RUNNING", started_at=time.time())
        try:
            for batch in batches:
                self.open[job.id].wait()
                if self.stopped[job.id].is_set():
                    break
                processed, saved = batch()
                self._set(job, job.status, processed=job.processed + processed, saved=job.saved + saved)
                if target is not None and job.saved >= target:
                    break
            self._set(job, "STOPPED" if self.stopped[job.id].is_set() else "COMPLETED", finished_at=time.time())
        except Exception as e:  # noqa: BLE001 - whatever ended the run is its result
            self._set(job, "STOPPED" if self.stopped[job.id].is_set() else "FAILED", error=str(e)[:2000], finished_at=time.time())

    def pause(self, job_id: str) -> None:
        """After the batch that runs now."""
        if self.jobs[job_id].status == "RUNNING":
            self.open[job_id].clear()
            self._set(self.jobs[job_id], "PAUSED")

    def resume(self, job_id: str) -> None:
        if self.jobs[job_id].status == "PAUSED":
            self._set(self.jobs[job_id], "RUNNING")
            self.open[job_id].set()

    def stop(self, job_id: str) -> None:
        """At once: what runs is cancelled. A job that has ended stays as it is."""
        self.stopped[job_id].set()
        self.open[job_id].set()
        self.spark.sparkContext.cancelJobGroup(job_id)

    def wait(self, job_id: str, seconds: float | None = None) -> Job:
        self.threads[job_id].join(seconds)
        return self.jobs[job_id]

    def get(self, job_id: str) -> Job:
        if job_id not in self.jobs:
            raise KeyError(f"no job {job_id}")
        return self.jobs[job_id]

    def all(self) -> DataFrame:
        """(id, name, status, processed, saved, error), newest first."""
        rows = sorted(self.jobs.values(), key=lambda j: -j.started_at)
        return self.spark.createDataFrame([(j.id, j.name, j.status, j.processed, j.saved, j.error) for j in rows], "id string, name string, status string, processed long, saved long, error string")
