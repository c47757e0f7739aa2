"""A job queue that several workers share: the transitions of :mod:`delta`, committed one after another.

A queue is one key of a :class:`Store`, so a change rewrites that queue alone. A worker whose commit comes second runs
its transition again on what the first one left, so no job is claimed twice and no job is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import delta
from sparkloom.sources.store import Store

JOB = "id long, dedupe_key string, status string, attempts int, available_at timestamp, lease_until timestamp"


class Queue:
    """The jobs of queue ``name`` below ``root``: ``id, dedupe_key, status, attempts, available_at, lease_until``."""

    def __init__(self, spark: SparkSession, root: str, name: str = "jobs"):
        self.spark, self.name, self.store = spark, name, Store(spark, root, key="queue")

    def jobs(self, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        held = self.store.read(keys=[self.name]) if tables is None else tables
        return held["job"].drop("queue") if "job" in held else self.spark.createDataFrame([], JOB)

    def change(self, step) -> int:
        return self.store.update([self.name], lambda tables: {"job": step(self.jobs(tables)).withColumn("queue", F.lit(self.name))})

    def put(self, new: DataFrame) -> int:
        """Add jobs; of those with a dedupe key, one each and none that is ready or processing."""
        return self.change(lambda jobs: jobs.unionByName(delta.enqueue(jobs, new)))

    def claim(self, now: Column, limit: int, lease: str = "5 minutes") -> DataFrame:
        """Claim up to ``limit`` due jobs for the caller alone; returns them as they were before."""
        won = []

        def step(jobs: DataFrame) -> DataFrame:
            won[:] = [delta.claimable(jobs, now).limit(limit)]
            return delta.claim(jobs, now, limit, lease)

        self.change(step)
        return won[0]

    def settle(self, outcomes: DataFrame, now: Column, most: int = 5) -> int:
        return self.change(lambda jobs: delta.settle(jobs, outcomes, now, most))
