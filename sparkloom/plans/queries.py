"""One query for each graph operator over the test graph, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import keys
from sparkloom.operators import delta, reads, report, resolve, rollup, traverse, views
from sparkloom.plans import testgraph
from sparkloom.plans.binding import BINDING, IMPORTS, imports
from sparkloom.plans.committed import COMMITTED, job_claim_commit, job_claim_sql
from sparkloom.plans.details import DETAILS, TABLES, external_imports, with_external_ids
from sparkloom.plans.graph import DEPENDENCIES, Graph
from sparkloom.plans.lists import LISTS, TAIL_SQL, cycle_rows, tail_upsert

K = "('imports', 'references', 'calls', 'extends', 'implements')"
HOT = f"hot AS (SELECT e.target_id AS id FROM edge e JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id AND n.kind = 'symbol' WHERE e.kind IN {K} GROUP BY 1, e.project_id ORDER BY count(*) DESC, e.project_id, 1 LIMIT 1)"
TOP = "top AS (SELECT * FROM node s WHERE s.kind = 'symbol' AND EXISTS (SELECT 1 FROM edge e JOIN node f ON f.project_id = e.project_id AND f.id = e.source_id WHERE e.project_id = s.project_id AND e.target_id = s.id AND e.kind = 'contains' AND f.kind = 'file'))"
NODE = "project_id, id, kind, sub_kind, name, path"
#: Specifiers and what they name from a file in ``src/<dir>``.
SPECIFIERS = {"../lib/./util/../index.ts": "src/lib/index.ts", "./a//b": "src/<dir>/a/b", "./": "src/<dir>", "..": "src", "../../x": "x", "../../../y/../z": "z"}


def report_sql(imported: str, related: str) -> str:
    """SQL of :func:`report.project_reports`, from that of the metrics of imports and relationships."""
    tally = lambda table, value: f"coalesce((SELECT string_agg(v || '=' || n, ' ' ORDER BY v) FROM (SELECT {value} AS v, count(*) AS n FROM {table} x WHERE x.project_id = p.project_id AND {value} IS NOT NULL GROUP BY 1)), 'none')"
    listed = lambda names: " || ' ' || ".join(f"'{n}=' || coalesce({n}, 0)" for n in names)
    rates = " || ".join(f"'\n{n}: ' || round(coalesce({n}, 0) * 100, 1)::DECIMAL(5, 1) || '%'" for n in report.RATES)
    text = f"'project: ' || p.project_id || '\nnodes: ' || {tally('node', 'kind')} || '\nsymbols: ' || {tally('symbol', 'sub_kind')} || '\nedges: ' || {tally('edge', 'kind')} || '\nimports: ' || {listed(report.IMPORTS)} || {rates} || '\nrelations: ' || {listed(report.RELATIONS)}".replace("\n", "' || chr(10) || '")
    return f"WITH p AS (SELECT project_id FROM node UNION SELECT project_id FROM edge UNION SELECT project_id FROM tail), symbol AS (SELECT * FROM node WHERE kind = 'symbol'), i AS ({imported}), l AS ({related}) SELECT p.project_id, {text} AS text FROM p LEFT JOIN i ON i.project_id = p.project_id LEFT JOIN l ON l.project_id = p.project_id"


def hot(g: Graph) -> str:
    return rollup.hot_symbols(g, 1).first().id


def first_id(g: Graph, kind: str) -> str:
    return g.nodes.filter(F.col("kind") == kind).agg(F.min("id")).first()[0]


def inner_file(g: Graph) -> str:
    """The first file with a dependency between two of its symbols, else the first file."""
    s = g.nodes.filter("kind = 'symbol'").select("project_id", F.col("id").alias("source_id"), "file_id")
    t = s.select("project_id", F.col("source_id").alias("target_id"), F.col("file_id").alias("other"))
    e = g.dependencies().filter("source_id <> target_id").select("project_id", "source_id", "target_id")
    found = e.join(s, ["project_id", "source_id"]).join(t, ["project_id", "target_id"]).filter("file_id = other").agg(F.min("file_id")).first()[0]
    return found or first_id(g, "file")


def marked_names(g: Graph) -> Graph:
    """The graph with props whose names end in characters that mean something in patterns."""
    name = F.when(F.col("sub_kind") == "react:prop", F.concat("name", F.lit("%_o"))).otherwise(F.col("name"))
    return Graph(g.nodes.withColumn("name", name), g.edges, g.tail)


def broken(g: Graph) -> Graph:
    """The graph with rows that break each of its rules."""
    kind = F.when(F.col("kind") == "package", "thing").otherwise(F.col("kind"))
    sub = F.when(F.col("sub_kind") == "react:prop", "Prop").otherwise(F.col("sub_kind"))
    lost = F.when(F.col("kind") != "calls", F.col("confidence"))
    wide = F.when(F.col("kind") == "extends", "widens").otherwise(F.col("kind"))
    return Graph(g.nodes.withColumns({"kind": kind, "sub_kind": sub}), g.edges.withColumn("confidence", lost).withColumn("kind", wide), g.tail)


def node_cols(df: DataFrame) -> DataFrame:
    return df.select(*NODE.split(", "))


def neighbours(g: Graph, direction: str, kind: str | None = None) -> DataFrame:
    return reads.neighbors(g, hot(g), direction, kind)


def neighbours_sql(near: str, far: str, more: str = "") -> str:
    return f"WITH {HOT} SELECT e.project_id, e.edge_key, e.kind, e.resolution, e.{far} AS far_id, n.kind AS far_kind, coalesce(n.name, n.path) AS far_label FROM edge e LEFT JOIN node n ON n.project_id = e.project_id AND n.id = e.{far} WHERE e.{near} = (SELECT id FROM hot) {more}"


def second_page(df: DataFrame, key: list[str], size: int) -> DataFrame:
    last = df.orderBy(*key).limit(size).agg(*(F.max(k).alias(k) for k in key)).first() if len(key) == 1 else df.orderBy(*key).limit(size).orderBy(*(F.desc(k) for k in key)).first()
    return reads.top_rows(df, key, size, None if last is None or last[0] is None else tuple(last[k] for k in key))


def blast(g: Graph, **options) -> DataFrame:
    return traverse.blast_radius(g, hot(g), **options)


def blast_sql(depth: int = 32, kinds: str = K, tail: str = "") -> str:
    return f"""WITH {HOT}, dep AS (SELECT DISTINCT project_id, source_id, target_id, resolution = 'deterministic' AS det FROM edge WHERE kind IN {kinds}),
    walk AS (SELECT DISTINCT project_id, target_id AS id, 0::BIGINT AS depth, true AS det FROM dep WHERE target_id = (SELECT id FROM hot)
      UNION SELECT w.project_id, d.source_id, w.depth + 1, w.det AND d.det FROM walk w JOIN dep d ON d.project_id = w.project_id AND d.target_id = w.id WHERE w.depth < {depth})
    SELECT project_id, id, min(depth) AS depth, CASE WHEN bool_or(det) THEN 'deterministic' ELSE 'inferred' END AS resolution FROM walk WHERE id <> (SELECT id FROM hot) GROUP BY 1, 2 {tail}"""


REACH = f"""WITH dep AS (SELECT DISTINCT project_id AS p, source_id AS a, target_id AS b FROM edge e WHERE kind IN {K} AND EXISTS (SELECT 1 FROM node n WHERE n.project_id = e.project_id AND n.id = e.target_id)),
    core AS (SELECT * FROM dep d WHERE EXISTS (SELECT 1 FROM dep x WHERE x.p = d.p AND x.b = d.a) AND EXISTS (SELECT 1 FROM dep x WHERE x.p = d.p AND x.a = d.b)),
    core2 AS (SELECT * FROM core d WHERE EXISTS (SELECT 1 FROM core x WHERE x.p = d.p AND x.b = d.a) AND EXISTS (SELECT 1 FROM core x WHERE x.p = d.p AND x.a = d.b)),
    reach AS (SELECT p, a, b FROM core2 UNION SELECT r.p, r.a, c.b FROM reach r JOIN core2 c ON c.p = r.p AND c.a = r.b),
    member AS (SELECT x.p AS project_id, x.a AS id, min(x.b) AS cycle_id FROM reach x JOIN reach y ON y.p = x.p AND y.a = x.b AND y.b = x.a GROUP BY 1, 2)"""


def cycle_members(g: Graph) -> DataFrame:
    c = traverse.components(g)
    loops = g.dependencies().filter("source_id = target_id").select("project_id", F.col("source_id").alias("id")).distinct().withColumn("loop", F.lit(True))
    real = c.groupBy("project_id", "id").agg(F.min("component").alias("cycle_id"))
    size = real.groupBy("project_id", "cycle_id").agg(F.count(F.lit(1)).alias("n"))
    return real.join(size, ["project_id", "cycle_id"]).join(loops, ["project_id", "id"], "left").filter("n > 1 OR loop").select("project_id", "id", "cycle_id")


def map_sql(level: str) -> str:
    at = {"package": "SELECT n.project_id, n.id, c.source_id AS at FROM node n JOIN edge c ON c.project_id = n.project_id AND c.target_id = n.file_id AND c.kind = 'contains' JOIN node p ON p.project_id = c.project_id AND p.id = c.source_id AND p.kind = 'package'", "file": "SELECT project_id, id, file_id AS at FROM node WHERE file_id IS NOT NULL"}[level]
    return f"WITH spot AS ({at}) SELECT e.project_id, s.at AS src, t.at AS tgt, count(*) FILTER (resolution = 'deterministic') AS deterministic, count(*) FILTER (resolution <> 'deterministic') AS inferred FROM edge e JOIN spot s ON s.project_id = e.project_id AND s.id = e.source_id JOIN spot t ON t.project_id = e.project_id AND t.id = e.target_id WHERE e.kind IN {K} AND s.at <> t.at GROUP BY 1, 2, 3"


def hashes(g: Graph, salt: bool) -> DataFrame:
    """Content hashes; with ``salt`` some files change, go or come."""
    n = F.substring_index("id", ":", -1).cast("long")
    f = g.nodes.filter("kind = 'file'").select("project_id", "path", "content_hash", n.alias("n"))
    if not salt:
        return f.filter("n % 7 != 1").select("project_id", "path", "content_hash")
    return f.filter("n % 7 != 2").select("project_id", "path", F.when(F.col("n") % 7 == 3, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")).alias("content_hash"))


def upsert_symbols(g: Graph) -> DataFrame:
    n = F.substring_index("id", ":", -1)
    s = g.nodes.filter("kind = 'symbol' AND id LIKE 'sym:%'").select("project_id", "id", "name")
    new = s.filter(n.cast("long") % 5 == 0)
    new = new.select("project_id", "id", F.concat("name", F.lit(" v1")).alias("name"), F.lit(1).alias("seq")).unionByName(new.select("project_id", "id", F.concat("name", F.lit(" v2")).alias("name"), F.lit(2).alias("seq")))
    return delta.upsert(delta.upsert(s, new, ["project_id", "id"]), new, ["project_id", "id"])


def probe(g: Graph) -> DataFrame:
    files = g.nodes.filter("kind = 'file'").select("project_id", "path", "id")
    asked = files.select("project_id", F.regexp_replace("path", r"\.ts$", ".js").alias("target")).unionByName(files.select("project_id", F.regexp_replace("path", r"\.ts$", "").alias("target"))).unionByName(files.select("project_id", F.concat("path", F.lit("x")).alias("target")))
    return resolve.probe_modules(asked, files)


def relative(g: Graph) -> DataFrame:
    """A specifier of each form from every file, two of them above the root."""
    forms = F.array(*map(F.lit, SPECIFIERS))
    asked = g.nodes.filter("kind = 'file'").select("project_id", F.concat(F.lit("src/"), "path").alias("importer_path"), F.explode(forms).alias("specifier"))
    return resolve.relative_targets(asked)


def owners(g: Graph) -> DataFrame:
    files = g.nodes.filter("kind = 'file'").select("project_id", "id", "path")
    dirs = g.nodes.filter("kind = 'package'").select("project_id", F.lower("name").alias("dir"), F.col("id").alias("package_id"))
    return resolve.package_owner(files, dirs)


def certainty(g: Graph) -> DataFrame:
    hop = g.dependencies().select("project_id", F.col("edge_key").alias("k1"), F.col("target_id").alias("mid"), F.col("resolution").alias("r1"), F.col("confidence").alias("c1"))
    nxt = g.dependencies().filter("sub_kind IS NULL").select("project_id", F.col("edge_key").alias("k2"), F.col("source_id").alias("mid"), F.col("resolution").alias("r2"), F.col("confidence").alias("c2"))
    # Each side is counted first: at a node with many edges, kinds of certainty meet instead of edges.
    hop = hop.groupBy("project_id", "mid", "r1", "c1").agg(F.count(F.lit(1)).alias("n1"))
    nxt = nxt.groupBy("project_id", "mid", "r2", "c2").agg(F.count(F.lit(1)).alias("n2"))
    both = hop.join(nxt, ["project_id", "mid"])
    return both.groupBy("project_id", resolve.combine_certainty(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2")).alias("certainty")).agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))


def export_chains(g: Graph) -> DataFrame:
    """Names that files export, and as many that none does, asked at the barrel of their package."""
    _, _, exports, re_exports = imports(g)
    away = lambda c: keys.key_of(F.col("project_id"), F.col(c))
    at = exports.join(re_exports.select("project_id", F.col("file_id").alias("barrel"), F.col("target_file").alias("file_id")), ["project_id", "file_id"])
    at = at.select("project_id", "barrel", F.explode(F.array("exported_name", F.concat("exported_name", F.lit("?")))).alias("name")).distinct()
    asked = at.withColumn("request_id", keys.key_of(F.col("project_id"), F.col("barrel"), F.col("name")))
    hops = re_exports.select(away("file_id").alias("file_id"), "kind", "exported_as", "name", away("target_file").alias("target_file"))
    found = resolve.export_chain(asked.select("request_id", away("barrel").alias("file_id"), "name"), exports.select(away("file_id").alias("file_id"), "exported_name", "symbol_id"), hops)
    return asked.join(found, "request_id").select("project_id", "barrel", "name", "outcome", "symbol_id", "resolution")


def map_page(g: Graph) -> DataFrame:
    _, edges, truncated = rollup.map_view(g, "package", limit=10)
    return edges.withColumn("truncated", F.lit(truncated))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = testgraph.read(spark, sf_dir, "orders")
    status = F.element_at(F.array(*map(F.lit, ("ready", "processing", "done", "dead"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("k"), (F.col("o_custkey") % 50).cast("string")).alias("dedupe_key"), status.alias("status"), F.col("o_orderdate").alias("available_at"), F.when(status == "processing", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("lease_until"))


JOB = "SELECT o_orderkey AS id, 'k' || (o_custkey % 50) AS dedupe_key, CASE o_orderkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'dead' END AS status, o_orderdate AS available_at, CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL 30 DAY END AS lease_until FROM orders"


def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.claimable(jobs(spark, sf_dir), now()).select("id", "status").limit(100)


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).withColumn("attempts", (F.col("id") % 7).cast("int"))


NOW_SQL = "TIMESTAMP '1995-01-01'"


def now() -> F.Column:
    return F.to_timestamp(F.lit("1995-01-01 00:00:00"))


def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.claim(job_states(spark, sf_dir), now(), 100).select("id", "status", "attempts", F.col("lease_until").cast("string").alias("lease"))


def job_two_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_claim_commit(job_states(spark, sf_dir).withColumn("dedupe_key", F.concat(F.lit("k"), F.col("id") % 1000)), now())


def job_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_jobs = job_states(spark, sf_dir)
    outcomes = all_jobs.filter("id % 3 <> 0").select("id", (F.col("id") % 3 == 1).alias("ok"))
    return delta.settle(all_jobs, outcomes, now()).select("id", "status", "attempts", F.col("available_at").cast("string").alias("available"), F.col("lease_until").isNotNull().alias("leased"))


def job_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_jobs = jobs(spark, sf_dir)
    new = all_jobs.select("id", F.concat(F.lit("k"), (F.col("id") % 80).cast("string")).alias("dedupe_key"))
    return delta.enqueue(all_jobs, new)


def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = testgraph.read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("attempt"))
    return n.withColumn("seconds", keys.backoff_ceiling(F.col("attempt")))


def specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = testgraph.read(spark, sf_dir, "part")
    spec = F.concat(F.element_at(F.array(*map(F.lit, ("./", "../", "@/", "~/", "@scope/", ""))), (F.col("p_partkey") % 6 + 1).cast("int")), F.lower("p_name"), F.lit("/sub"))
    return p.select(F.col("p_partkey").alias("id"), keys.specifier_kind(spec).alias("spec_kind"), keys.package_name(spec).alias("package"))


#: name: (function of the graph, SQL over node, edge, payload and tail or None)
GRAPH: dict[str, tuple[Callable[[Graph], DataFrame], str | None]] = {
    "map_package_nodes": (lambda g: rollup.map_nodes(g, "package"), "SELECT p.project_id, p.id, p.name AS label, count(DISTINCT s.id) AS children FROM node p LEFT JOIN edge c ON c.project_id = p.project_id AND c.source_id = p.id AND c.kind = 'contains' LEFT JOIN node s ON s.project_id = p.project_id AND s.file_id = c.target_id AND s.kind = 'symbol' WHERE p.kind = 'package' GROUP BY ALL"),
    "map_package_edges": (lambda g: rollup.map_edges(g, "package"), map_sql("package")),
    "map_file_nodes": (lambda g: rollup.map_nodes(g, "file"), "SELECT f.project_id, f.id, f.path AS label, count(s.id) AS children FROM node f LEFT JOIN node s ON s.project_id = f.project_id AND s.file_id = f.id AND s.kind = 'symbol' WHERE f.kind = 'file' GROUP BY ALL"),
    "map_file_edges": (lambda g: rollup.map_edges(g, "file"), map_sql("file")),
    "map_symbol_nodes": (lambda g: rollup.map_nodes(g, "symbol", first_id(g, "file")), "SELECT s.project_id, s.id, s.name AS label, count(c.edge_key) AS children FROM node s LEFT JOIN edge c ON c.project_id = s.project_id AND c.source_id = s.id AND c.kind = 'contains' WHERE s.kind = 'symbol' AND s.file_id = (SELECT min(id) FROM node WHERE kind = 'file') GROUP BY ALL"),
    "map_symbol_edges": (lambda g: rollup.map_edges(g, "symbol", inner_file(g)), f"WITH v AS (SELECT project_id, id FROM node WHERE kind = 'symbol' AND file_id = (SELECT min(s.file_id) FROM edge e JOIN node s ON s.project_id = e.project_id AND s.id = e.source_id AND s.kind = 'symbol' JOIN node t ON t.project_id = e.project_id AND t.id = e.target_id AND t.kind = 'symbol' AND t.file_id = s.file_id WHERE s.id <> t.id AND e.kind IN {K})) SELECT e.project_id, e.source_id AS src, e.target_id AS tgt, count(*) FILTER (resolution = 'deterministic') AS deterministic, count(*) FILTER (resolution <> 'deterministic') AS inferred FROM edge e JOIN v a ON a.project_id = e.project_id AND a.id = e.source_id JOIN v b ON b.project_id = e.project_id AND b.id = e.target_id WHERE e.kind IN {K} AND e.source_id <> e.target_id GROUP BY 1, 2, 3"),
    "map_edge_trust_rows": (lambda g: rollup.trust_rows(rollup.map_edges(g, "package")), f"WITH m AS (SELECT * FROM ({map_sql('package')})) SELECT project_id, src, tgt, 'deterministic' AS trust, deterministic AS n FROM m WHERE deterministic > 0 UNION ALL SELECT project_id, src, tgt, 'inferred', inferred FROM m WHERE inferred > 0"),
    "get_node": (lambda g: node_cols(reads.get_node(g, hot(g))), f"WITH {HOT} SELECT {NODE} FROM node WHERE id = (SELECT id FROM hot)"),
    "file_content_hashes": (reads.file_content_hashes, "SELECT project_id, path, content_hash FROM node WHERE kind = 'file' AND path IS NOT NULL AND content_hash IS NOT NULL"),
    "neighbors_out": (partial(neighbours, direction="out"), neighbours_sql("source_id", "target_id")),
    "neighbors_in": (partial(neighbours, direction="in"), neighbours_sql("target_id", "source_id")),
    "neighbors_kind": (partial(neighbours, direction="in", kind="calls"), neighbours_sql("target_id", "source_id", "AND e.kind = 'calls'")),
    "neighbors_page2": (lambda g: second_page(neighbours(g, "in"), ["edge_key"], 5), neighbours_sql("target_id", "source_id", "ORDER BY e.edge_key LIMIT 5 OFFSET 5")),
    "search_name": (lambda g: node_cols(reads.search(g, "BOLT")), f"SELECT {NODE} FROM node WHERE contains(lower(coalesce(name, '')), 'bolt') OR contains(lower(coalesce(path, '')), 'bolt')"),
    "search_path": (lambda g: node_cols(reads.search(g, "supplier#", "file")), f"SELECT {NODE} FROM node WHERE kind = 'file' AND (contains(lower(coalesce(name, '')), 'supplier#') OR contains(lower(coalesce(path, '')), 'supplier#'))"),
    "search_kind": (lambda g: node_cols(reads.search(g, kind="package")), f"SELECT {NODE} FROM node WHERE kind = 'package'"),
    "search_subkind": (lambda g: node_cols(reads.search(g, sub_kind="react:prop")), f"SELECT {NODE} FROM node WHERE sub_kind = 'react:prop'"),
    "search_wildcard_literal": (lambda g: node_cols(reads.search(marked_names(g), "t%_O")), f"SELECT {NODE.replace('name', 'name || chr(37) || chr(95) || chr(111) AS name')} FROM node WHERE sub_kind = 'react:prop' AND contains(lower(name) || '%_o', 't%_o')"),
    "declared_interface": (lambda g: node_cols(reads.declared_interface(g, first_id(g, "file"))), f"SELECT {', '.join('n.' + c for c in NODE.split(', '))} FROM edge e JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id WHERE e.kind = 'contains' AND n.kind = 'symbol' AND e.source_id = (SELECT min(id) FROM node WHERE kind = 'file')"),
    "contained_declarations": (lambda g: node_cols(reads.contained_declarations(g, first_id(g, "package"))), f"SELECT {', '.join('n.' + c for c in NODE.split(', '))} FROM edge e JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id WHERE e.kind = 'contains' AND n.kind <> 'callSite' AND e.source_id = (SELECT min(id) FROM node WHERE kind = 'package')"),
    "call_sites_of": (lambda g: reads.call_sites_of(g, g.nodes.agg(F.min("enclosing_symbol_id")).first()[0]).select("project_id", "id", "callee", "ordinal"), "SELECT project_id, id, callee, ordinal FROM node WHERE kind = 'callSite' AND enclosing_symbol_id = (SELECT min(enclosing_symbol_id) FROM node)"),
    "call_bindings": (reads.call_bindings, "WITH b AS (SELECT e.project_id, e.source_id AS id, n.name AS arg_name, max(e.edge_key) AS edge_key FROM edge e JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id AND n.kind = 'symbol' WHERE e.kind = 'references' GROUP BY 1, 2, 3) SELECT p.project_id, p.id, p.pos, p.arg_name, p.pass_kind, e.target_id AS bound_id, e.resolution AS bound_resolution FROM payload p LEFT JOIN b ON b.project_id = p.project_id AND b.id = p.id AND b.arg_name = p.arg_name LEFT JOIN edge e ON e.project_id = b.project_id AND e.edge_key = b.edge_key"),
    "unresolved_all": (lambda g: reads.unresolved_references(g), "SELECT * FROM tail"),
    "unresolved_by_file": (lambda g: reads.unresolved_references(g, g.tail.agg(F.min("target_file_id")).first()[0]), "SELECT * FROM tail WHERE target_file_id = (SELECT min(target_file_id) FROM tail)"),
    "unresolved_usage_family": (lambda g: reads.unresolved_references(g, codes=["unresolved-member", "unbound-callee"]), "SELECT * FROM tail WHERE code IN ('unresolved-member', 'unbound-callee')"),
    "name_collisions": (rollup.name_collisions, f"WITH {TOP} SELECT project_id, name, id, file_id FROM top WHERE name IS NOT NULL QUALIFY count(*) OVER (PARTITION BY project_id, name) > 1"),
    "name_collisions_page2": (lambda g: second_page(rollup.name_collisions(g), ["name", "id"], 20), f"WITH {TOP} SELECT * FROM (SELECT project_id, name, id, file_id FROM top WHERE name IS NOT NULL QUALIFY count(*) OVER (PARTITION BY project_id, name) > 1) ORDER BY name, id LIMIT 20 OFFSET 20"),
    "unused_symbols": (rollup.unused_symbols, f"WITH {TOP} SELECT project_id, id, name, EXISTS (SELECT 1 FROM tail t WHERE t.project_id = top.project_id AND t.name = top.name AND ((t.code = 'unresolved-member' AND t.target_file_id = top.file_id) OR t.code = 'unbound-callee')) AS candidate, EXISTS (SELECT 1 FROM edge x WHERE x.project_id = top.project_id AND x.target_id = top.id AND x.kind = 'exports') AS exported FROM top WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.project_id = top.project_id AND e.target_id = top.id AND e.kind IN {K})"),
    "cycle_candidate_edges": (lambda g: traverse.cycle_candidates(g).select("project_id", "edge_key"), f"WITH d AS (SELECT * FROM edge WHERE kind IN {K}) SELECT project_id, edge_key FROM d SEMI JOIN (SELECT DISTINCT project_id, target_id AS source_id FROM d) USING (project_id, source_id) SEMI JOIN (SELECT DISTINCT project_id, source_id AS target_id FROM d) USING (project_id, target_id)"),
    "cycles": (traverse.cycles, f"{REACH} SELECT m.project_id, cycle_id, count(DISTINCT m.id) AS size, bool_or(e.resolution <> 'deterministic') AS candidate FROM member m JOIN edge e ON e.project_id = m.project_id AND e.source_id = m.id AND e.kind IN {K} JOIN member t ON t.project_id = m.project_id AND t.id = e.target_id AND t.cycle_id = m.cycle_id GROUP BY 1, 2".replace("JOIN member t", "JOIN (SELECT project_id, id, cycle_id AS cid FROM member) t").replace("t.cycle_id = m.cycle_id", "t.cid = m.cycle_id")),
    "cycle_members": (cycle_members, f"{REACH} SELECT project_id, id, cycle_id FROM member"),
    "blast_radius": (blast, blast_sql()),
    "blast_radius_depth2": (partial(blast, max_depth=2), blast_sql(2)),
    "blast_radius_calls_only": (partial(blast, kinds=("calls",)), blast_sql(kinds="('calls')")),
    "blast_radius_page2": (lambda g: second_page(blast(g), ["depth", "id"], 10), blast_sql(tail="ORDER BY depth, id LIMIT 10 OFFSET 10")),
    "hot_symbols": (lambda g: rollup.hot_symbols(g, 25), f"SELECT e.project_id, e.target_id AS id, count(*) AS degree FROM edge e JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id AND n.kind = 'symbol' WHERE e.kind IN {K} GROUP BY 1, 2 ORDER BY degree DESC, 1, 2 LIMIT 25"),
    "nodes_by_kind": (lambda g: rollup.tally(g.nodes, "kind"), "SELECT kind AS value, count(*) AS n FROM node GROUP BY 1"),
    "symbols_by_subkind": (lambda g: rollup.tally(g.nodes.filter("kind = 'symbol'"), "sub_kind"), "SELECT sub_kind AS value, count(*) AS n FROM node WHERE kind = 'symbol' AND sub_kind IS NOT NULL GROUP BY 1"),
    "edges_by_kind": (lambda g: rollup.tally(g.edges, "kind"), "SELECT kind AS value, count(*) AS n FROM edge GROUP BY 1"),
    "import_resolution_metrics": (external_imports, "WITH e AS (SELECT e.project_id, count(*) FILTER (n.id IS NOT NULL AND resolution = 'deterministic') AS deterministic, count(*) FILTER (n.id IS NOT NULL AND resolution <> 'deterministic') AS inferred, count(*) FILTER (n.id IS NULL) AS external FROM edge e LEFT JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id WHERE e.kind = 'imports' GROUP BY 1), t AS (SELECT project_id, count(*) FILTER (code LIKE 'ambiguous-%') AS ambiguous, count(*) FILTER (code IN ('unresolved-module', 'unresolved-export')) AS unresolved FROM tail WHERE code NOT IN ('unresolved-member', 'unbound-callee') GROUP BY 1), m AS (SELECT project_id, coalesce(deterministic, 0) AS deterministic, coalesce(inferred, 0) AS inferred, coalesce(external, 0) AS external, coalesce(ambiguous, 0) AS ambiguous, coalesce(unresolved, 0) AS unresolved FROM e FULL JOIN t USING (project_id)) SELECT *, deterministic + inferred + external + ambiguous + unresolved AS total, round(coalesce((deterministic + inferred + external) / nullif(deterministic + inferred + external + ambiguous + unresolved, 0), 0.0), 6) AS resolved_rate, round(coalesce(deterministic / nullif(deterministic + inferred, 0), 0.0), 6) AS deterministic_share FROM m"),
    "relationship_metrics": (rollup.relationship_metrics, "SELECT project_id, " + ", ".join(f"count(*) FILTER ({c} AND provenance_pass {o} 'resolve') AS {n}_{w}" for n, c in (("renders", "sub_kind = 'react:renders'"), ("calls", "kind = 'calls' AND sub_kind IS NULL"), ("prop_bindings", "sub_kind = 'react:propBinding'")) for w, o in (("cross", "="), ("intra", "<>"))) + " FROM edge GROUP BY 1"),
    "json_property_filter": (lambda g: g.nodes.filter(F.get_json_object("properties", "$.flavor") == "PROMO").select("project_id", "id", F.get_json_object("properties", "$.size").alias("size")), "SELECT project_id, id, properties::JSON ->> 'size' AS size FROM node WHERE (properties::JSON ->> 'flavor') = 'PROMO'"),
    "json_property_missing": (lambda g: g.nodes.filter("kind = 'symbol'").filter(F.get_json_object("properties", "$.flavor").isNull()).select("project_id", "id"), "SELECT project_id, id FROM node WHERE kind = 'symbol' AND (properties::JSON ->> 'flavor') IS NULL"),
    "file_association": (traverse.file_association, "SELECT project_id, id, file_id FROM node"),
    "edge_identity_keys": (lambda g: g.edges.select("project_id", keys.key_of(F.col("source_id"), F.col("kind"), F.col("target_id"), F.col("sub_kind"), F.col("resolution")).alias("key")), "SELECT project_id, edge_key AS key FROM edge"),
    "upsert_idempotent": (upsert_symbols, "SELECT project_id, id, CASE WHEN split_part(id, ':', 2)::BIGINT % 5 = 0 THEN name || ' v2' ELSE name END AS name FROM node WHERE kind = 'symbol' AND id LIKE 'sym:%'"),
    "replace_project": (lambda g: delta.replace_project(g.edges, g.edges.filter("kind = 'contains'"), "proj:0").select("project_id", "edge_key"), "SELECT project_id, edge_key FROM edge WHERE project_id <> 'proj:0' OR kind = 'contains'"),
    "delta_classification": (lambda g: delta.classify_delta(hashes(g, False), hashes(g, True)), "SELECT project_id, path, CASE split_part(id, ':', 2)::BIGINT % 7 WHEN 1 THEN 'new' WHEN 2 THEN 'removed' WHEN 3 THEN 'changed' ELSE 'unchanged' END AS change FROM node WHERE kind = 'file'"),
    "cache_partition": (lambda g: delta.cache_partition(hashes(g, True), hashes(g, False).select(F.concat(F.lit("v1:"), "content_hash").alias("cache_key")), "v1").select("project_id", "path", "hit"), "SELECT project_id, path, split_part(id, ':', 2)::BIGINT % 7 NOT IN (1, 3) AS hit FROM node WHERE kind = 'file' AND split_part(id, ':', 2)::BIGINT % 7 <> 2"),
    "module_probe": (probe, "SELECT project_id, replace(path, '.ts', '.js') AS target, id AS module_id FROM node WHERE kind = 'file' UNION ALL SELECT project_id, replace(path, '.ts', ''), id FROM node WHERE kind = 'file' UNION ALL SELECT project_id, path || 'x', NULL FROM node WHERE kind = 'file'"),
    "relative_resolve": (relative, f"SELECT project_id, 'src/' || path AS importer_path, specifier, replace(target, '<dir>', split_part(path, '/', 1)) AS target FROM node, (VALUES {', '.join(f'{pair!r}' for pair in SPECIFIERS.items())}) v(specifier, target) WHERE kind = 'file'"),
    "package_owner": (owners, "SELECT f.project_id, f.id, f.path, p.id AS package_id FROM node f LEFT JOIN node p ON p.project_id = f.project_id AND p.kind = 'package' AND lower(p.name) = split_part(f.path, '/', 1) WHERE f.kind = 'file'"),
    "certainty_combine": (certainty, f"WITH d AS (SELECT *, CASE WHEN resolution = 'deterministic' THEN 4 WHEN confidence = 'high' THEN 3 WHEN confidence = 'medium' THEN 2 ELSE 1 END AS r FROM edge WHERE kind IN {K}) SELECT a.project_id, CASE least(a.r, b.r) WHEN 4 THEN 'deterministic' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS certainty, count(*) AS n FROM d a JOIN d b ON b.project_id = a.project_id AND b.source_id = a.target_id WHERE b.sub_kind IS NULL GROUP BY 1, 2"),
    "focus_neighbourhood": (lambda g: reads.focus(g, hot(g)), f"WITH {HOT}, e AS (SELECT * FROM edge WHERE source_id = (SELECT id FROM hot) OR target_id = (SELECT id FROM hot)) SELECT project_id, source_id AS id FROM e UNION SELECT project_id, target_id FROM e"),
    "declaration_buckets": (reads.declaration_buckets, "SELECT project_id, id, CASE WHEN sub_kind IN ('react:prop', 'ts:parameter') THEN 'parameter' WHEN sub_kind = 'ts:local' THEN 'local' WHEN kind = 'symbol' THEN 'nested' ELSE 'none' END AS bucket FROM node"),
    "signature_text": (reads.signatures, "SELECT project_id, id, 'call(' || string_agg(coalesce(arg_name, '...'), ', ' ORDER BY pos) || ')' AS signature FROM payload GROUP BY 1, 2"),
    "graph_invariants": (lambda g: broken(g).violations().groupBy("rule").count(), "SELECT 'confidence' AS rule, count(*) AS count FROM edge WHERE resolution = 'inferred' AND kind = 'calls' UNION ALL SELECT 'edge-kind', count(*) FROM edge WHERE kind = 'extends' UNION ALL SELECT 'node-kind', count(*) FROM node WHERE kind = 'package' UNION ALL SELECT 'sub-kind', count(*) FROM node WHERE sub_kind = 'react:prop'"),
}

GRAPH |= BINDING | COMMITTED | DETAILS
GRAPH |= {
    "export_chain": (export_chains, f"{IMPORTS}, h AS (SELECT DISTINCT project_id, pkg, files FROM home), w AS (SELECT w.*, h.files FROM wide w JOIN h ON h.project_id = w.project_id AND h.pkg = w.pkg) SELECT project_id, 'barrel:' || pkg AS barrel, name, CASE WHEN k = 1 THEN 'bound' ELSE 'ambiguous' END AS outcome, CASE WHEN k = 1 THEN sym END AS symbol_id, CASE WHEN k = 1 THEN CASE WHEN files = 1 THEN 'inferred' ELSE 'deterministic' END END AS resolution FROM w UNION ALL SELECT project_id, 'barrel:' || pkg, name || '?', 'unresolved', NULL, NULL FROM w"),
    "map_view_page": (map_page, f"WITH m AS (SELECT * FROM ({map_sql('package')})), v AS (SELECT project_id, id FROM node WHERE kind = 'package' ORDER BY project_id, id LIMIT 10) SELECT m.*, (SELECT count(*) FROM node WHERE kind = 'package') > 10 AS truncated FROM m JOIN v a ON a.project_id = m.project_id AND a.id = m.src JOIN v b ON b.project_id = m.project_id AND b.id = m.tgt"),
    "blast_radius_hydrated": (lambda g: traverse.blast_radius_page(g, hot(g), 30, None, 2), f"SELECT h.*, n.kind AS node_kind, coalesce(n.name, n.path) AS label, (SELECT count(*) FROM ({blast_sql(2).replace('WITH', 'WITH RECURSIVE', 1)}) WHERE depth >= 2) > 0 AS truncated FROM (SELECT * FROM ({blast_sql(2).replace('WITH', 'WITH RECURSIVE', 1)}) ORDER BY depth, id LIMIT 30) h LEFT JOIN node n ON n.project_id = h.project_id AND n.id = h.id"),
    "cycle_list": (traverse.cycle_list, f"{REACH}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, cycle_id ORDER BY id) AS r FROM member), c AS (SELECT project_id, cycle_id, count(*) AS size, string_agg(id, ' ' ORDER BY id) FILTER (r <= 100) AS members FROM r GROUP BY 1, 2), x AS (SELECT m.project_id, m.cycle_id, bool_or(e.resolution <> 'deterministic') AS candidate FROM member m JOIN edge e ON e.project_id = m.project_id AND e.source_id = m.id AND e.kind IN {K} JOIN (SELECT project_id, id, cycle_id AS cid FROM member) t ON t.project_id = m.project_id AND t.id = e.target_id AND t.cid = m.cycle_id GROUP BY 1, 2) SELECT c.*, candidate, size > 100 AS truncated FROM c JOIN x USING (project_id, cycle_id)"),
}

GRAPH |= {
    "declared_signatures": (lambda g: views.declared_signatures(g, "flavor", "size"), "SELECT s.project_id, s.id, s.name || CASE WHEN count(c.id) > 0 THEN '(' || string_agg(c.name || coalesce(': ' || (c.properties::JSON ->> 'flavor'), ''), ', ' ORDER BY c.id) || ')' ELSE '' END || coalesce(': ' || (s.properties::JSON ->> 'size'), '') AS signature FROM node s LEFT JOIN edge e ON e.project_id = s.project_id AND e.source_id = s.id AND e.kind = 'contains' LEFT JOIN node c ON c.project_id = e.project_id AND c.id = e.target_id AND c.kind = 'symbol' WHERE s.kind = 'symbol' GROUP BY s.project_id, s.id, s.name, s.properties"),
    "detail_uses": (lambda g: views.uses(g, hot(g)).select("project_id", "direction", "edge_key", "far_id", "has_inferred"), f"WITH {HOT}, e AS (SELECT *, 'in' AS direction, source_id AS far_id FROM edge WHERE target_id = (SELECT id FROM hot) UNION ALL SELECT *, 'out', target_id FROM edge WHERE source_id = (SELECT id FROM hot)) SELECT project_id, direction, edge_key, far_id, (SELECT bool_or(resolution = 'inferred') FROM e) AS has_inferred FROM e WHERE kind IN {K}"),
    "binding_rows": (views.binding_rows, f"SELECT *, bound_id IS NULL OR coalesce(bound_resolution = 'inferred', false) AS uncertain FROM ({GRAPH['call_bindings'][1]})"),
    "blast_rows": (lambda g: views.blast_rows(g, hot(g), 2), f"SELECT h.*, coalesce(n.name, n.path) AS label FROM ({blast_sql(2).replace('WITH', 'WITH RECURSIVE', 1)}) h LEFT JOIN node n ON n.project_id = h.project_id AND n.id = h.id"),
}

GRAPH |= {
    "cycle_page": (cycle_rows, f"{REACH}, c AS ({GRAPH['cycles'][1].removeprefix(REACH)}) SELECT * FROM c WHERE project_id = (SELECT min(project_id) FROM c) ORDER BY cycle_id LIMIT 20"),
    "tail_upsert": (tail_upsert, TAIL_SQL),
    "project_report": (lambda g: report.project_reports(with_external_ids(g)).select("project_id", "text"), report_sql(GRAPH["import_resolution_metrics"][1], GRAPH["relationship_metrics"][1])),
}

#: name: (function of session and folder, SQL over the tables)
PLAIN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = TABLES | LISTS | {
    "job_two_workers": (job_two_workers, job_claim_sql(f"SELECT * REPLACE ('k' || id % 1000 AS dedupe_key) FROM ({JOB})", NOW_SQL)),
    "job_claim_order": (job_claims, f"WITH j AS ({JOB}) SELECT id, status FROM j WHERE (status = 'ready' AND available_at <= TIMESTAMP '1995-01-01') OR (status = 'processing' AND lease_until <= TIMESTAMP '1995-01-01') ORDER BY available_at, id LIMIT 100"),
    "job_dedupe": (job_dedupe, f"WITH j AS ({JOB}) SELECT min(id) AS id, 'k' || (id % 80) AS dedupe_key FROM j WHERE 'k' || (id % 80) NOT IN (SELECT dedupe_key FROM j WHERE status IN ('ready', 'processing')) GROUP BY 2"),
    "job_claim": (job_claim, f"WITH j AS ({JOB}), won AS (SELECT id FROM j WHERE (status = 'ready' AND available_at <= {NOW_SQL}) OR (status = 'processing' AND lease_until <= {NOW_SQL}) ORDER BY available_at, id LIMIT 100) SELECT j.id, CASE WHEN won.id IS NULL THEN status ELSE 'processing' END AS status, (j.id % 7)::INTEGER + CASE WHEN won.id IS NULL THEN 0 ELSE 1 END AS attempts, strftime(CASE WHEN won.id IS NULL THEN lease_until ELSE {NOW_SQL} + INTERVAL 5 MINUTE END, '%Y-%m-%d %H:%M:%S') AS lease FROM j LEFT JOIN won ON won.id = j.id"),
    "job_settle": (job_settle, f"WITH j AS (SELECT *, (id % 7)::INTEGER AS attempts, status = 'processing' AND id % 3 <> 0 AS hit FROM ({JOB})), s AS (SELECT *, CASE WHEN NOT hit THEN status WHEN id % 3 = 1 THEN 'done' WHEN attempts >= 5 THEN 'dead' ELSE 'ready' END AS after FROM j) SELECT id, after AS status, attempts, strftime(CASE WHEN hit AND after = 'ready' THEN {NOW_SQL} + to_microseconds((least(300.0, pow(2.0, attempts - 1)) * 1000000)::BIGINT) ELSE available_at END, '%Y-%m-%d %H:%M:%S') || CASE WHEN hit AND after = 'ready' AND attempts = 0 THEN '.5' ELSE '' END AS available, NOT hit AND lease_until IS NOT NULL AS leased FROM s"),
    "backoff_ceiling": (backoff, "SELECT n_nationkey::BIGINT + 1 AS attempt, least(300.0, pow(2.0, n_nationkey)) AS seconds FROM nation"),
    "specifier_kinds": (specifiers, "WITH s AS (SELECT p_partkey AS id, (['./', '../', '@/', '~/', '@scope/', ''])[p_partkey % 6 + 1] || lower(p_name) || '/sub' AS spec FROM part) SELECT id, CASE WHEN starts_with(spec, '.') THEN 'relative' WHEN starts_with(spec, '@/') OR starts_with(spec, '~/') THEN 'alias' ELSE 'bare' END AS spec_kind, CASE WHEN starts_with(spec, '@') THEN split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) ELSE split_part(spec, '/', 1) END AS package FROM s"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: (lambda spark, d, f=f: f(testgraph.load(spark, d))) for k, (f, _) in GRAPH.items()}
    return out | {k: f for k, (f, _) in PLAIN.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: testgraph.duckdb(sql) for k, (_, sql) in GRAPH.items() if sql is not None}
    return out | {k: sql for k, (_, sql) in PLAIN.items()}


__all__ = ["DEPENDENCIES", "oracle_sql", "queries"]
