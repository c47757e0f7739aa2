"""Upserts, replacement, deltas, the fragment cache and the job queue as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.keys import backoff_ceiling


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``stored``: of new rows with a key the one with the largest ``seq`` wins. Idempotent."""
    last = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    new = new.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "seq")
    return stored.join(new, keys, "left_anti").unionByName(new)


def replace_project(stored: DataFrame, new: DataFrame, project_id: str) -> DataFrame:
    return stored.filter(F.col("project_id") != project_id).unionByName(new.filter(F.col("project_id") == project_id))


def classify_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """``project_id, path, change`` of two tables of content hashes."""
    b = before.withColumnRenamed("content_hash", "old")
    n = now.withColumnRenamed("content_hash", "new")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return b.join(n, ["project_id", "path"], "full").select("project_id", "path", change.alias("change"))


def unchanged(before: DataFrame, now: DataFrame) -> bool:
    """Whether nothing has to be parsed or written."""
    return classify_delta(before, now).filter("change != 'unchanged'").isEmpty()


def cache_partition(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """``files(project_id, path, content_hash)`` with their cache key and whether the cache holds it."""
    key = F.concat_ws(":", F.lit(version), "content_hash")
    held = cache.select(F.col("cache_key"), F.lit(True).alias("hit")).distinct()
    return files.withColumn("cache_key", key).join(held, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def decoded(cache: DataFrame, shape: str, version: str, required: tuple[str, ...]) -> DataFrame:
    """The rows of ``cache(cache_key, fragment)`` that decode to ``shape``, as ``cache_key, value``.

    Text that isn't JSON, a value of another type, a missing ``required`` field or another ``version`` is no fragment.
    """
    read = F.from_json("fragment", f"{shape}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    sound = F.col("value._bad").isNull() & (F.col("value.version") == version)
    for field in required:
        sound = sound & F.col(f"value.{field}").isNotNull()
    return cache.select("cache_key", read.alias("value")).filter(F.coalesce(sound, F.lit(False))).withColumn("value", F.col("value").dropFields("_bad"))


def cache_get(files: DataFrame, cache: DataFrame, version: str, shape: str, required: tuple[str, ...]) -> DataFrame:
    """``files(project_id, path, content_hash)`` with ``cache_key`` and ``value``; where that is null, the file has to be
    parsed again, whether its fragment is absent or corrupt."""
    key = F.concat_ws(":", F.lit(version), "content_hash")
    held = decoded(cache, shape, version, required).groupBy("cache_key").agg(F.first("value").alias("value"))
    return files.withColumn("cache_key", key).join(held, "cache_key", "left")


def link_guarded(stored: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stored(id, owner, created_at, updated_at)`` after ``asks(seq, id, owner, at)``, and each ask's ``outcome``.

    An id belongs to its stored owner, or else to the first asker by ``seq``. An owner's ask is ``linked`` and touches
    the row; anyone else's is an ``owner-mismatch`` and changes nothing.
    """
    first = asks.groupBy("id").agg(F.min_by("owner", "seq").alias("_first"), F.min_by("at", "seq").alias("_at"))
    holder = first.join(stored.select("id", F.col("owner").alias("_owner"), F.col("created_at").alias("_made")), "id", "left")
    holder = holder.select("id", F.coalesce("_owner", "_first").alias("_holder"), F.coalesce("_made", "_at").alias("_made"))
    judged = asks.join(holder, "id").withColumn("outcome", F.when(F.col("owner") == F.col("_holder"), "linked").otherwise("owner-mismatch"))
    touched = judged.filter("outcome = 'linked'").groupBy("id").agg(F.first("_holder").alias("owner"), F.first("_made").alias("created_at"), F.max_by("at", "seq").alias("updated_at"))
    return stored.join(touched, "id", "left_anti").unionByName(touched), judged.select("seq", "id", "owner", "outcome")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Keys that the cache holds keep their fragment."""
    return cache.unionByName(new.dropDuplicates(["cache_key"]).join(cache, "cache_key", "left_anti"))


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The jobs of ``new`` that are added: one for each dedupe key, none while one is ready or processing."""
    active = jobs.filter(F.col("status").isin("ready", "processing")).select("dedupe_key")
    first = Window.partitionBy("dedupe_key").orderBy("id")
    once = new.filter("dedupe_key IS NOT NULL").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    return once.join(active, "dedupe_key", "left_anti").select(*new.columns).unionByName(new.filter("dedupe_key IS NULL"))


def claimable(jobs: DataFrame, now) -> DataFrame:
    """Jobs that are due or whose lease ran out, the oldest first."""
    due = ((F.col("status") == "ready") & (F.col("available_at") <= now)) | ((F.col("status") == "processing") & (F.col("lease_until") <= now))
    return jobs.filter(due).orderBy("available_at", "id")


def claim(jobs: DataFrame, now: Column, limit: int, lease: str = "5 minutes") -> DataFrame:
    """``jobs`` after a claim: the first ``limit`` due ones are processing, with one more attempt and a new lease."""
    won = claimable(jobs, now).limit(limit).select("id", F.lit(True).alias("_won"))
    out = jobs.join(F.broadcast(won), "id", "left")
    changed = {"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "lease_until": now + F.expr(f"INTERVAL {lease}")}
    return out.withColumns({k: F.when(F.col("_won"), v).otherwise(F.col(k)) for k, v in changed.items()}).select(*jobs.columns)


def settle(jobs: DataFrame, outcomes: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """``jobs`` after ``outcomes(id, ok)`` of processing ones: done, or ready again behind the backoff's ceiling, or
    dead after ``most`` attempts. Outcomes of other jobs change nothing; a job with several is done if one is ok."""
    known = outcomes.groupBy("id").agg(F.max("ok").alias("_ok"))
    hit = (F.col("status") == "processing") & F.col("_ok").isNotNull()
    status = F.when(F.col("_ok"), "done").when(F.col("attempts") >= most, "dead").otherwise("ready")
    wait = F.make_dt_interval(secs=backoff_ceiling(F.col("attempts")).cast("decimal(18,6)"))
    out = jobs.join(known, "id", "left").withColumns({"_s": F.when(hit, status).otherwise(F.col("status")), "_a": F.when(hit & (status == "ready"), now + wait).otherwise(F.col("available_at")), "_l": F.when(~F.coalesce(hit, F.lit(False)), F.col("lease_until"))})
    return out.drop("status", "available_at", "lease_until").withColumnsRenamed({"_s": "status", "_a": "available_at", "_l": "lease_until"}).select(*jobs.columns)
