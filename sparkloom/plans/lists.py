"""Queries of the lists, of job references and of tail upserts over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import delta, listing, traverse
from sparkloom.plans import testgraph
from sparkloom.plans.graph import Graph

NOW = "1995-01-01"
KEY = "project_id, ref_key"


def dead(spark: SparkSession, sf_dir: str, after_id: int | None) -> DataFrame:
    """Pages of the orders that stand for dead jobs."""
    jobs = testgraph.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("dedupe_key"), F.when(F.col("o_orderkey") % 4 == 3, "dead").otherwise("done").alias("status"))
    return listing.dead_rows(jobs, 200, after_id)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for projects, their nations for workspaces, regions of keys for installations."""
    c = testgraph.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("c_nationkey").alias("workspace_id"), (k % 7).alias("installation_id"), F.lit("github.com").alias("host"), F.concat(F.lit("o"), (k % 10).cast("string")).alias("owner"), F.concat(F.lit("r"), (k % 100).cast("string")).alias("name"), F.when(k % 5 == 0, F.lit(NOW)).alias("archived_at"))


PROJECTS = f"SELECT 'p' || c_custkey AS id, c_nationkey AS workspace_id, c_custkey % 7 AS installation_id, 'github.com' AS host, 'o' || (c_custkey % 10) AS owner, 'r' || (c_custkey % 100) AS name, CASE WHEN c_custkey % 5 = 0 THEN '{NOW}' END AS archived_at FROM customer"


def workspace_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = testgraph.read(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("workspace_id"))
    return listing.in_workspaces(projects(spark, sf_dir), held)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for asks; some of each kind have a wrong host, an empty owner, or an id that isn't whole."""
    o, k = testgraph.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    digits = F.md5(k.cast("string"))
    sha = F.when(k % 11 == 0, digits).when(k % 11 == 1, F.upper(F.concat(digits, F.substring(digits, 1, 8)))).when(k % 11 == 2, F.concat(digits, digits)).otherwise(F.concat(F.lit(" "), digits, F.substring(digits, 1, 8)))
    asks = o.select(k.alias("id"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project_id"), F.when(k % 13 == 0, "git.example").otherwise(" github.com ").alias("host"), F.when(k % 17 == 0, "  ").otherwise("o").alias("owner"), F.lit("r").alias("name"), sha.alias("commit_sha"), F.when(k % 3 > 0, (k % 3 - 1) * 1500).alias("delay_ms"))
    return listing.job_references(asks, F.lit(NOW).cast("timestamp")).select("id", "host", "owner", "commit_sha", "problem", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("available_at"))


REFERENCES = f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, md5(o_orderkey::VARCHAR) AS d FROM orders),
    a AS (SELECT id, CASE WHEN k % 13 = 0 THEN 'git.example' ELSE 'github.com' END AS host, CASE WHEN k % 17 = 0 THEN '' ELSE 'o' END AS owner, CASE k % 11 WHEN 0 THEN d WHEN 1 THEN upper(d || d[1:8]) WHEN 2 THEN d || d ELSE d || d[1:8] END AS commit_sha, CASE WHEN k % 3 = 2 THEN 1500 ELSE 0 END AS ms FROM o),
    p AS (SELECT *, CASE WHEN host <> 'github.com' THEN 'host' WHEN owner = '' THEN 'owner' WHEN NOT regexp_full_match(commit_sha, '[0-9a-f]{{40}}|[0-9a-f]{{64}}') THEN 'commit_sha' END AS problem FROM a)
    SELECT id, host, owner, commit_sha, problem, CASE WHEN problem IS NULL THEN strftime(TIMESTAMP '{NOW}' + to_milliseconds(ms), '%Y-%m-%d %H:%M:%S.%g') END AS available_at FROM p"""


def tail_upsert(g: Graph) -> DataFrame:
    """Each reference comes twice more, by odd ones also under a new key; the later one wins, and a second run of the
    same rows changes nothing."""
    stored = g.tail.select("project_id", "ref_key", "code")
    odd = F.length("ref_key") % 2 == 1
    again = stored.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("code", F.concat("code", F.lit("#"), F.col("seq").cast("string")))
    new = again.unionByName(again.filter(odd).withColumn("ref_key", F.concat("ref_key", F.lit("+"))))
    keys = KEY.split(", ")
    return delta.upsert(delta.upsert(stored, new, keys), new, keys)


def cycle_rows(g: Graph) -> DataFrame:
    """The first page of the project with the smallest id that has cycles."""
    found = traverse.cycles(g)
    first = found.agg(F.min("project_id")).first()[0]
    return listing.cycle_rows(found, first or "", 20)


TAIL_SQL = "SELECT project_id, ref_key, code || '#2' AS code FROM tail UNION ALL SELECT project_id, ref_key || '+', code || '#2' FROM tail WHERE length(ref_key) % 2 = 1"

#: name: (function of the session and the folder, SQL over the tables)
LISTS = {
    "dead_letters": (lambda spark, d: dead(spark, d, None), "SELECT o_orderkey AS id, 'k' || o_custkey AS dedupe_key, 'dead' AS status FROM orders WHERE o_orderkey % 4 = 3 ORDER BY id LIMIT 200"),
    "dead_letters_next": (lambda spark, d: dead(spark, d, 799), "SELECT o_orderkey AS id, 'k' || o_custkey AS dedupe_key, 'dead' AS status FROM orders WHERE o_orderkey % 4 = 3 AND o_orderkey > 799 ORDER BY id LIMIT 200"),
    "projects_in_workspaces": (workspace_projects, f"SELECT * FROM ({PROJECTS}) WHERE archived_at IS NULL AND workspace_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "projects_of_repo": (lambda spark, d: listing.of_repo(projects(spark, d), "github.com", "o3", "r13"), f"SELECT * FROM ({PROJECTS}) WHERE owner = 'o3' AND name = 'r13'"),
    "projects_of_installation": (lambda spark, d: listing.of_installation(projects(spark, d), 3), f"SELECT * FROM ({PROJECTS}) WHERE installation_id = 3"),
    "job_references": (references, REFERENCES),
}
