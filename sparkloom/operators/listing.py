"""Lists that are read page by page: dead jobs, projects, cycles. Each page is a filter and a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.reads import Page, page, top_rows

#: Rows of a page of cycles, by default and at most.
CYCLES, MOST_CYCLES = 50, 200


def dead_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'dead'")


def dead_letters(jobs: DataFrame, limit: int | None = None, cursor: str | None = None) -> Page:
    """A page of the jobs that used up their attempts, by id; a page behind a cursor carries no total."""
    return page(dead_jobs(jobs), ["id"], limit, cursor, (True,))


def dead_rows(jobs: DataFrame, limit: int | None = None, after_id: int | None = None) -> DataFrame:
    """:func:`dead_letters` as a plan."""
    return top_rows(dead_jobs(jobs), ["id"], limit, None if after_id is None else (after_id,))


def of_repo(projects: DataFrame, host: str, owner: str, name: str) -> DataFrame:
    """Projects of ``projects(id, workspace_id, installation_id, host, owner, name, archived_at)`` for one repository."""
    return projects.filter((F.col("host") == host) & (F.col("owner") == owner) & (F.col("name") == name))


def of_installation(projects: DataFrame, installation_id: int) -> DataFrame:
    return projects.filter(F.col("installation_id") == installation_id)


def in_workspaces(projects: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Projects that aren't archived, in any of ``workspaces(workspace_id)``. Without workspaces there are none."""
    return projects.filter("archived_at IS NULL").join(workspaces.select("workspace_id").distinct(), "workspace_id", "left_semi").select(*projects.columns)


def project_page(projects: DataFrame, workspaces: DataFrame, limit: int | None = None, cursor: str | None = None) -> Page:
    return page(in_workspaces(projects, workspaces), ["id"], limit, cursor)


def cycle_rows(found: DataFrame, project_id: str, limit: int | None = None, after_id: str | None = None) -> DataFrame:
    """A page of one project's cycles, by ``cycle_id``; the cursor is the last page's last id as it stands."""
    own = found.filter(F.col("project_id") == project_id)
    rows = own if after_id is None else own.filter(F.col("cycle_id") > after_id)
    return rows.orderBy("cycle_id").limit(cycle_limit(limit))


def cycle_limit(limit: int | None) -> int:
    return CYCLES if limit is None else max(1, min(limit, MOST_CYCLES))


def cycle_page(found: DataFrame, project_id: str, limit: int | None = None, cursor: str | None = None) -> Page:
    """:func:`cycle_rows` fetched, with the next cursor; the first page has the total."""
    n = cycle_limit(limit)
    own = found.filter(F.col("project_id") == project_id)
    rows = (own if cursor is None else own.filter(F.col("cycle_id") > cursor)).orderBy("cycle_id").limit(n + 1).collect()
    return Page(rows[:n], rows[n - 1].cycle_id if len(rows) > n else None, own.count() if cursor is None else None)


def job_references(asks: DataFrame, now: Column, host: str = "github.com") -> DataFrame:
    """``asks(project_id, host, owner, name, commit_sha, delay_ms)``, trimmed, with ``problem`` and ``available_at``.

    A job names a project, a repository of ``host`` alone, and a whole commit id of 40 or 64 lower-case hex digits. The
    first field that doesn't is the ``problem``, and such a row is never available. Null counts as empty; a delay that
    is null or not above zero is none.
    """
    trimmed = {c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "") for c in ("project_id", "host", "owner", "name", "commit_sha")}
    rows = asks.withColumns(trimmed)
    sha = F.length("commit_sha").isin(40, 64) & F.col("commit_sha").rlike("^[0-9a-f]*$")
    wrong = [("project_id", F.col("project_id") == ""), ("host", F.col("host") != host), ("owner", F.col("owner") == ""), ("name", F.col("name") == ""), ("commit_sha", ~sha)]
    problem = F.coalesce(*(F.when(bad, field) for field, bad in wrong))
    wait = F.make_dt_interval(secs=(F.greatest(F.coalesce("delay_ms", F.lit(0)), F.lit(0)) / 1000).cast("decimal(18,6)"))
    return rows.withColumn("problem", problem).withColumn("available_at", F.when(F.col("problem").isNull(), now + wait))
