"""Pages of dead jobs, projects and cycles, and validated job references."""

from datetime import datetime as at

import pytest
from pyspark.sql import functions as F
from test_graph import SF, got

from sparkloom.operators import delta, listing
from sparkloom.plans import queries


def test_dead_letters_page_by_id(spark):
    jobs = spark.createDataFrame([(i, "dead" if i % 2 else "done") for i in range(12)], "id long, status string")
    first = listing.dead_letters(jobs, 4)
    assert ([r.id for r in first.items], first.total) == ([1, 3, 5, 7], 6)
    last = listing.dead_letters(jobs, 4, first.next_cursor)
    assert ([r.id for r in last.items], last.next_cursor, last.total) == ([9, 11], None, None)
    assert got(listing.dead_rows(jobs, 4, 7), "id") == [(9,), (11,)]
    none = listing.dead_letters(jobs.filter("id < 0"))
    assert (none.items, none.next_cursor, none.total) == ([], None, 0)


def test_projects(spark):
    rows = [("a", "w1", 1, "h", "o", "n", None), ("b", "w1", 1, "h", "o", "m", "1995-01-01"), ("c", "w2", 2, "h", "o", "n", None), ("d", None, None, None, None, None, None)]
    projects = spark.createDataFrame(rows, "id string, workspace_id string, installation_id long, host string, owner string, name string, archived_at string")
    spaces = spark.createDataFrame([("w1",), ("w1",), ("w2",), (None,)], "workspace_id string")
    page = listing.project_page(projects, spaces, 1)
    assert ([r.id for r in page.items], page.total) == (["a"], 2)
    assert [r.id for r in listing.project_page(projects, spaces, 1, page.next_cursor).items] == ["c"]
    assert listing.project_page(projects, spaces.limit(0)).items == []
    assert got(listing.of_repo(projects, "h", "o", "n"), "id") == [("a",), ("c",)]
    assert got(listing.of_installation(projects, 1), "id") == [("a",), ("b",)]


def test_cycles_page_by_raw_id(spark):
    found = spark.createDataFrame([("p", f"c{i:03}", 2) for i in range(260)] + [("q", "c000", 3)], "project_id string, cycle_id string, size int")
    page = listing.cycle_page(found, "p")
    assert (len(page.items), page.next_cursor, page.total) == (50, "c049", 260)
    page = listing.cycle_page(found, "p", 999, page.next_cursor)
    assert (len(page.items), page.items[0].cycle_id, page.next_cursor, page.total) == (200, "c050", "c249", None)
    page = listing.cycle_page(found, "p", 0, "c258")
    assert ([r.cycle_id for r in page.items], page.next_cursor) == (["c259"], None)
    assert listing.cycle_page(found, "none").total == 0
    assert listing.cycle_rows(found, "p", None, "c257").count() == 2


def test_job_references(spark):
    sha = "0123456789abcdef" * 4
    rows = [
        (1, " p ", "github.com\t", "o", "n", sha[:40] + "\n", 1500),
        (2, "p", "github.com", "o", "n", sha, -5),
        (3, "p", "github.com", "o", "n", sha[:41], None),
        (4, "p", "github.com", "o", "n", sha[:40].upper(), None),
        (5, "p", "GitHub.com", "o", "n", "", None),
        (6, None, "evil", "", None, None, None),
        (7, "p", "github.com", " ", "", sha, None),
        (8, "p", "github.com", "o", " ", sha, None),
        (9, "p", "github.com", "o", "n", "x" * 40, None),
    ]
    asks = spark.createDataFrame(rows, "id int, project_id string, host string, owner string, name string, commit_sha string, delay_ms long")
    out = listing.job_references(asks, F.lit(at(2024, 1, 1)))
    assert got(out, "id", "problem") == [(1, None), (2, None), (3, "commit_sha"), (4, "commit_sha"), (5, "host"), (6, "project_id"), (7, "owner"), (8, "name"), (9, "commit_sha")]
    assert got(out.filter("problem IS NULL"), "available_at", "commit_sha") == [(at(2024, 1, 1), sha), (at(2024, 1, 1, 0, 0, 1, 500_000), sha[:40])]
    assert out.filter("problem IS NOT NULL AND available_at IS NOT NULL").isEmpty()
    assert listing.job_references(asks.limit(0), F.lit(at(2024, 1, 1))).isEmpty()


def test_tail_rows_are_upserted_by_reference(spark):
    stored = spark.createDataFrame([("p", "k1", "a"), ("q", "k1", "b")], "project_id string, ref_key string, code string")
    new = spark.createDataFrame([("p", "k1", "c", 1), ("p", "k1", "d", 2), ("p", "k2", "e", 1)], "project_id string, ref_key string, code string, seq int")
    once = delta.upsert(stored, new, ["project_id", "ref_key"])
    assert got(once, "project_id", "ref_key", "code") == [("p", "k1", "d"), ("p", "k2", "e"), ("q", "k1", "b")]
    assert got(delta.upsert(once, new, ["project_id", "ref_key"]), "code") == got(once, "code")


@pytest.mark.parametrize("name", ["dead_letters", "dead_letters_next", "projects_in_workspaces", "projects_of_repo", "projects_of_installation", "job_references", "tail_upsert", "cycle_page"])
def test_list_query_has_rows(spark, name):
    assert not queries.queries()[name](spark, SF).isEmpty()
