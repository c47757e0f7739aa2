"""Queries of the store, the shared queue and nested re-exports over the test graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import keys
from sparkloom.operators import resolve, workspace
from sparkloom.operators.queue import Queue
from sparkloom.plans.binding import IMPORTS, imports, number
from sparkloom.plans.graph import Graph, scratch
from sparkloom.sources import store

#: Package that every third barrel re-exports beside its files.
OUTSIDE = "outside"


def store_replace(g: Graph) -> DataFrame:
    """Edges of each project before and after one project was replaced, and whether its snapshot was taken over."""
    spark = g.nodes.sparkSession
    root = scratch(spark, "store")
    store.save(Graph(g.nodes, g.edges, g.tail), root)
    kept = Graph(g.nodes, g.edges.filter("kind = 'contains'"), g.tail)
    s = store.Store(spark, root)
    first = s.view()
    store.save_project(kept, root, "proj:0")
    now = s.view()
    counted = lambda view, name: s.read(view)["edge"].groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    taken = first.manifest.select("project_id", F.col("snapshot").alias("old")).join(now.manifest.select("project_id", "snapshot"), "project_id").select("project_id", (F.col("old") == F.col("snapshot")).alias("taken_over"))
    return counted(first, "before").join(counted(now, "after"), "project_id").join(taken, "project_id")


def store_one_project(g: Graph) -> DataFrame:
    """The symbols of one project, read from its own folders after two writers changed two projects."""
    spark = g.nodes.sparkSession
    root = scratch(spark, "store")
    store.save(Graph(g.nodes, g.edges, g.tail), root)
    s = store.Store(spark, root)
    for project in ("proj:1", "proj:2"):
        s.update([project], lambda tables: tables | {"node": tables["node"].withColumn("name", F.upper("name"))})
    return s.read(keys=["proj:1"])["node"].filter("kind = 'symbol'").select("project_id", "id", "name")


def job_claim_commit(jobs: DataFrame, now: F.Column) -> DataFrame:
    """All jobs after two workers claimed a hundred each, and the second settled its own."""
    q = Queue(jobs.sparkSession, scratch(jobs.sparkSession, "queue"))
    q.put(jobs)
    q.claim(now, 100)
    won = q.claim(now, 100)
    q.settle(won.select("id", (F.col("id") % 2 == 0).alias("ok")), now)
    return q.jobs().select("id", "status", "attempts", F.col("lease_until").isNotNull().alias("leased"))


def job_claim_sql(jobs: str, now: str) -> str:
    return f"""WITH j AS (SELECT *, (id % 7)::INT AS attempts FROM ({jobs})), a AS (SELECT * FROM j WHERE status IN ('ready', 'processing')), put AS (SELECT * FROM j WHERE dedupe_key IS NULL UNION ALL SELECT * FROM j WHERE dedupe_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY id) = 1),
    due AS (SELECT id, row_number() OVER (ORDER BY available_at, id) AS k FROM put WHERE (status = 'ready' AND available_at <= {now}) OR (status = 'processing' AND lease_until <= {now}))
    SELECT p.id, CASE WHEN k <= 100 THEN 'processing' WHEN k <= 200 THEN CASE WHEN p.id % 2 = 0 THEN 'done' WHEN attempts + 1 >= 5 THEN 'dead' ELSE 'ready' END ELSE status END AS status, CASE WHEN k <= 200 THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN k <= 100 THEN true WHEN k <= 200 THEN false ELSE lease_until IS NOT NULL END AS leased FROM put p LEFT JOIN due USING (id)"""


def nested_stars(g: Graph) -> DataFrame:
    """Names asked at each project's top, which re-exports all barrels; every third barrel stars a package too, and
    every fifth a module that failed."""
    _, _, exports, stars = imports(g)
    scoped = lambda c: keys.key_of(F.col("project_id"), F.col(c))
    none = F.lit(None).cast("string")
    star = lambda df, file, target, package: df.select("project_id", file.alias("file_id"), F.lit("star").alias("kind"), none.alias("exported_as"), none.alias("name"), target.alias("target_file"), package.alias("package"))
    barrels = stars.select("project_id", F.col("file_id").alias("barrel")).distinct()
    at = number("barrel")
    hops = stars.unionByName(star(barrels, F.lit("top"), F.col("barrel"), none)).unionByName(star(barrels.filter(at % 3 == 0), F.col("barrel"), none, F.lit(OUTSIDE))).unionByName(star(barrels.filter(at % 5 == 0), F.col("barrel"), none, none))
    hops = hops.withColumns({"target_file": F.when(F.col("target_file").isNotNull(), scoped("target_file")), "file_id": scoped("file_id")})
    names = exports.select("project_id", F.explode(F.array("exported_name", F.concat("exported_name", F.lit("?")))).alias("name")).distinct()
    asked = names.select("project_id", "name", keys.key_of(F.col("project_id"), F.lit("top")).alias("file_id")).withColumn("request_id", keys.key_of(F.col("project_id"), F.col("name")))
    found = resolve.export_chain(asked.select("request_id", "file_id", "name"), exports.select(scoped("file_id").alias("file_id"), "exported_name", "symbol_id"), hops)
    return asked.select("project_id", "name", "request_id").join(found, "request_id").drop("request_id")


#: Each barrel's stars are its files, and what it re-exports beside them; a barrel with one star infers.
NESTED = f"""{IMPORTS}, bar AS (SELECT DISTINCT project_id, pkg, files, split_part(pkg, ':', 2)::BIGINT AS n FROM home),
    nm AS (SELECT DISTINCT project_id, x.name || s.q AS name FROM x CROSS JOIN (VALUES (''), ('?')) s(q)),
    inner_ AS (SELECT m.project_id, m.name, b.pkg, coalesce(w.k, 0) AS k, w.sym, b.n % 3 = 0 AS away, b.files + (b.n % 3 = 0)::INT + (b.n % 5 = 0)::INT = 1 AS one FROM nm m JOIN bar b ON b.project_id = m.project_id LEFT JOIN wide w ON w.project_id = b.project_id AND w.pkg = b.pkg AND w.name = m.name),
    gives AS (SELECT *, CASE WHEN away AND k = 0 THEN 'npm {OUTSIDE} ' || CASE WHEN regexp_full_match(name, '[A-Za-z0-9_+$-]+') THEN name ELSE '`' || replace(name, '`', '``') || '`' END || '.' WHEN NOT away AND k = 1 THEN sym END AS got FROM inner_),
    ends AS (SELECT project_id, name, count(DISTINCT got) AS k, min(got) AS got, bool_or(one) FILTER (got IS NOT NULL) AS one, count(*) AS barrels, bool_or(k + away::INT > 1) AS split FROM gives GROUP BY 1, 2)
    SELECT project_id, name, CASE WHEN k = 0 THEN CASE WHEN barrels = 1 AND split THEN 'ambiguous' ELSE 'unresolved' END WHEN k > 1 THEN 'ambiguous' WHEN got LIKE 'npm %' THEN 'external' ELSE 'bound' END AS outcome,
    CASE WHEN k = 1 THEN got END AS symbol_id, CASE WHEN k = 1 THEN CASE WHEN got LIKE 'npm %' OR NOT (one OR barrels = 1) THEN 'deterministic' ELSE 'inferred' END END AS resolution FROM ends"""


def superseded(g: Graph) -> DataFrame:
    """Imports of an external package; every fourth name has a source in a workspace package, and its edge turns there.

    Each name has two records, of which the first that ends at a symbol holds.
    """
    n = number("target_id")
    edges = g.edges.filter("kind = 'imports' AND target_id LIKE 'sym:%'").withColumn("name", F.concat(F.lit("n"), n))
    names = edges.select("project_id", "name", n.alias("n")).distinct()
    records = names.select("project_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("rank"), F.lit("w").alias("package"), F.lit("").alias("subpath"), "name", F.lit("named").alias("kind"))
    entries = names.select("project_id", F.lit("w").alias("name"), F.lit("").alias("subpath"), F.lit("entry").alias("module_id")).distinct()
    exports = names.filter("n % 4 = 0").select("project_id", F.lit("entry").alias("file_id"), F.col("name").alias("exported_name"), F.concat(F.lit("own:"), "project_id", F.lit(":"), "name").alias("symbol_id"))
    none = g.nodes.sparkSession.createDataFrame([], "project_id string, file_id string, kind string, exported_as string, name string, target_file string, package string")
    symbols = workspace.workspace_symbols(records, entries, exports, none)
    outside = edges.withColumn("target_id", keys.external_symbol(F.lit("w"), F.col("name"))).drop("name")
    return workspace.supersede_workspace(outside, symbols).select("project_id", "source_id", "target_id", "resolution", "provenance_rule")


def aliases(g: Graph) -> DataFrame:
    """Specifiers by two nested rules, the deeper of which falls back to a second target."""
    spark = g.nodes.sparkSession
    rules = spark.createDataFrame([(0, "@/*", 0, "src/*"), (1, "@/lib/*", 0, "gone/*"), (1, "@/lib/*", 1, "lib/*"), (2, "~/*", 0, "home/*")], "rank int, pattern string, pos int, target string")
    rules = rules.crossJoin(g.nodes.filter("kind = 'repo'").select("project_id"))  # a few rules for each project
    files = g.nodes.filter("kind = 'file'")
    deep = number("id") % 2 == 0
    asked = files.select("project_id", F.concat(F.when(deep, "@/lib/").otherwise("@/"), F.regexp_replace("path", r"\.ts$", "")).alias("specifier"))
    held = files.select("project_id", F.concat(F.when(deep, "lib/").otherwise("src/"), "path").alias("path"), "id")
    return workspace.resolve_paths(asked, rules, held)


#: name: (function of the graph, SQL over node, edge, payload and tail)
COMMITTED = {
    "store_replace": (store_replace, "SELECT project_id, count(*) AS before, count(*) FILTER (project_id <> 'proj:0' OR kind = 'contains') AS after, project_id <> 'proj:0' AS taken_over FROM edge GROUP BY 1"),
    "store_one_project": (store_one_project, "SELECT project_id, id, upper(name) AS name FROM node WHERE kind = 'symbol' AND project_id = 'proj:1'"),
    "export_probe": (nested_stars, NESTED),
    "workspace_supersede": (superseded, "SELECT project_id, source_id, CASE WHEN split_part(target_id, ':', 2)::BIGINT % 4 = 0 THEN 'own:' || project_id || ':n' || split_part(target_id, ':', 2) ELSE 'npm w n' || split_part(target_id, ':', 2) || '.' END AS target_id, CASE WHEN split_part(target_id, ':', 2)::BIGINT % 4 = 0 THEN 'deterministic' ELSE resolution END AS resolution, CASE WHEN split_part(target_id, ':', 2)::BIGINT % 4 = 0 THEN 'resolve/workspace' ELSE provenance_rule END AS provenance_rule FROM edge WHERE kind = 'imports' AND target_id LIKE 'sym:%'"),
    "alias_longest_prefix": (aliases, "SELECT project_id, CASE WHEN split_part(id, ':', 2)::BIGINT % 2 = 0 THEN '@/lib/' ELSE '@/' END || regexp_replace(path, '\\.ts$', '') AS specifier, id AS module_id FROM node WHERE kind = 'file'"),
}
