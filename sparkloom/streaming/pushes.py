"""Pushes as a stream: the filter and the dedupe that turn them into jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands for no commit.
ZERO_SHA = "0" * 40


def jobs_of(pushes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Jobs of ``pushes(ts, project_id, ref, default_branch, deleted, sha)``: default branch, a real commit, once each.

    On a stream a project's commit is remembered for as long as the watermark allows.
    """
    ok = (F.col("ref") == F.concat(F.lit("refs/heads/"), F.col("default_branch"))) & ~F.col("deleted") & F.col("sha").rlike("^[0-9a-f]{40}$") & (F.col("sha") != ZERO_SHA)
    jobs = pushes.filter(ok).select("ts", "project_id", "sha", F.concat_ws(":", "project_id", "sha").alias("dedupe_key"))
    return jobs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dedupe_key"]) if pushes.isStreaming else jobs.dropDuplicates(["dedupe_key"])
