"""Queries of ids, comments, ignore rules, caches, trails and links over the test graph, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import comments, keys, symbols
from sparkloom.operators import delta, reads, rollup, traverse, workspace
from sparkloom.plans import testgraph
from sparkloom.plans.binding import number
from sparkloom.plans.graph import DEPENDENCIES, Graph
from sparkloom.sources import ignore

K = "(" + ", ".join(f"'{k}'" for k in DEPENDENCIES) + ")"


def with_external_ids(g: Graph) -> Graph:
    """The graph whose edges to absent nodes carry ids of a package."""
    known = g.nodes.select("project_id", F.col("id").alias("target_id"), F.lit(True).alias("known"))
    edges = g.edges.join(known, ["project_id", "target_id"], "left")
    away = F.when(F.col("known"), F.col("target_id")).otherwise(keys.external_symbol(F.lit("@s/away x"), F.col("target_id")))
    return Graph(g.nodes, edges.withColumn("target_id", away).select(*g.edges.columns), g.tail, g.payload)


def external_imports(g: Graph) -> DataFrame:
    return rollup.import_metrics(with_external_ids(g))


def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of odd names, written and parsed; every fifth lacks its end."""
    p = testgraph.read(spark, sf_dir, "part")
    made = F.struct(F.lit("npm").alias("manager"), F.concat(F.lit("@s/"), "p_name").alias("package"), F.array(F.struct(F.col("p_type").alias("name"), F.lit("namespace").alias("suffix"), F.lit(None).cast("string").alias("disambiguator")), F.struct(F.concat(F.lit("`"), "p_brand").alias("name"), F.lit("method").alias("suffix"), F.col("p_size").cast("string").alias("disambiguator"))).alias("descriptors"))
    text = symbols.format_symbol(made)
    cut_short = F.when(F.col("p_partkey") % 5 == 0, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t"))
    p = p.withColumn("t", text).select("p_partkey", cut_short.alias("symbol"))
    got = p.withColumn("s", symbols.parse_symbol(F.col("symbol")))
    last = F.element_at("s.descriptors", -1)
    return got.select(F.col("p_partkey").alias("id"), "symbol", F.col("s.manager").alias("manager"), F.col("s.package").alias("package"), F.get("s.descriptors", F.lit(0))["name"].alias("first"), last["name"].alias("last"), last["suffix"].alias("suffix"), last["disambiguator"].alias("disambiguator"), symbols.is_external(F.col("symbol")).alias("external"))


SYMBOL_SQL = """WITH p AS (SELECT *, p_partkey % 5 <> 0 AS ok, 'npm @s/' || replace(p_name, ' ', '  ') || ' ' || CASE WHEN regexp_full_match(p_type, '[A-Za-z0-9_+$-]+') THEN p_type ELSE '`' || p_type || '`' END || '/```' || p_brand || '`(' || p_size || ').' AS t FROM part)
    SELECT p_partkey AS id, CASE WHEN ok THEN t ELSE t[:-2] END AS symbol, CASE WHEN ok THEN 'npm' END AS manager, CASE WHEN ok THEN '@s/' || p_name END AS package, CASE WHEN ok THEN p_type END AS first, CASE WHEN ok THEN '`' || p_brand END AS last, CASE WHEN ok THEN 'method' END AS suffix, CASE WHEN ok THEN p_size::VARCHAR END AS disambiguator, ok AS external FROM p"""


def doc_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of parts: a description of two lines, a tag that runs on with a link, and one that stands alone."""
    p = testgraph.read(spark, sf_dir, "part")
    raw = F.concat(F.lit("/**\n * "), "p_name", F.lit("  \n *\n *  two\n * @param p "), "p_type", F.lit("\n *   then {@link P"), F.col("p_partkey").cast("string"), F.lit("|label} on\n * @internal\n */ "))
    doc = comments.parse_doc(F.when(F.col("p_partkey") % 7 == 0, "/** */").otherwise(raw))
    return p.select(F.col("p_partkey").alias("id"), doc.alias("doc")).select("id", F.col("doc.description").alias("description"), F.array_join(F.transform("doc.tags", lambda t: F.concat_ws("=", t["tag"], t["text"])), ";").alias("tags"))


DOC_SQL = "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_name || chr(10) || chr(10) || ' two' END AS description, CASE WHEN p_partkey % 7 <> 0 THEN 'param=p ' || p_type || ' then P' || p_partkey || ' on;internal=' END AS tags FROM part"


def ignored_files(g: Graph) -> DataFrame:
    """Files by a root ignore file and by one in every fourth package's folder."""
    dirs = g.nodes.filter("kind = 'package'").select("project_id", F.lower("name").alias("dir"), number("id").alias("n"))
    root = dirs.select("project_id", F.lit("").alias("dir"), F.lit("# all\n*7.ts\n!*17.ts  \n/nation_3/\nSupplier#00000002?.ts\n").alias("text")).distinct()
    nested = dirs.filter("n % 4 = 0").select("project_id", "dir", F.lit("!*7.ts\r\n*[!3-9x].ts").alias("text"))
    return ignore.with_ignored(g.nodes.filter("kind = 'file'").select("project_id", "path"), root.unionByName(nested))


IGNORED_SQL = """WITH f AS (SELECT f.project_id, f.path, split_part(f.path, '/', 1) AS dir, split_part(p.id, ':', 2)::BIGINT % 4 = 0 AS nested FROM node f JOIN node p ON p.project_id = f.project_id AND p.kind = 'package' AND lower(p.name) = split_part(f.path, '/', 1) WHERE f.kind = 'file')
    SELECT project_id, path, coalesce(CASE WHEN nested AND regexp_matches(path, '[^3-9x]\\.ts$') THEN true WHEN nested AND path LIKE '%7.ts' THEN false END,
      CASE WHEN dir = 'nation_3' THEN true WHEN regexp_full_match(path, '.*/Supplier#00000002.\\.ts') THEN true WHEN path LIKE '%17.ts' THEN false WHEN path LIKE '%7.ts' THEN true END, false) AS ignored FROM f"""


SHAPE = "version string, path string, symbols array<string>"


def fragment_cache(g: Graph) -> DataFrame:
    """Files against a cache that holds sound, cut, foreign, mistyped and incomplete fragments in turn."""
    files = g.nodes.filter("kind = 'file'").select("project_id", "path", "content_hash", number("id").alias("n"))
    whole = F.to_json(F.struct(F.when(F.col("n") % 7 == 2, "v0").otherwise("v1").alias("version"), F.when(F.col("n") % 7 != 4, F.col("path")).alias("path"), F.array("path", "content_hash").alias("symbols")))
    text = F.when(F.col("n") % 7 == 1, F.substring(whole, 1, 30)).when(F.col("n") % 7 == 3, F.replace(whole, F.lit("["), F.lit('{"x":1},"y":['))).otherwise(whole)
    cache = files.filter("n % 7 <> 5").select(F.concat(F.lit("v1:"), "content_hash").alias("cache_key"), text.alias("fragment"))
    got = delta.cache_get(files.drop("n"), cache, "v1", SHAPE, ("path", "symbols"))
    return got.select("project_id", "path", F.col("value").isNotNull().alias("hit"), F.size("value.symbols").alias("n_symbols"))


def trails(g: Graph) -> DataFrame:
    t = traverse.breadcrumbs(g).select("project_id", "id", F.array_join(F.transform("trail", lambda x: x["label"]), " > ").alias("trail"))
    return t.join(g.nodes.select("project_id", "id", traverse.drill_level(F.col("kind")).alias("drill")), ["project_id", "id"])


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders ask for one of five hundred ids in the name of their customer; the first hundred ids have an owner."""
    o = testgraph.read(spark, sf_dir, "orders")
    stored = o.select((F.col("o_orderkey") % 100).alias("id")).distinct().select("id", (F.col("id") % 40).alias("owner"), F.lit("1990-01-01").alias("created_at"), F.lit("1990-01-01").alias("updated_at"))
    asks = o.select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 500).alias("id"), (F.col("o_custkey") % 40).alias("owner"), F.col("o_orderdate").cast("date").cast("string").alias("at"))
    return delta.link_guarded(stored, asks)


LINKS = """WITH stored AS (SELECT DISTINCT o_orderkey % 100 AS id, o_orderkey % 100 % 40 AS owner FROM orders), ask AS (SELECT o_orderkey AS seq, o_orderkey % 500 AS id, o_custkey % 40 AS owner, o_orderdate::DATE::VARCHAR AS day FROM orders),
    first AS (SELECT id, arg_min(owner, seq) AS owner, arg_min(day, seq) AS day FROM ask GROUP BY id), holder AS (SELECT id, coalesce(s.owner, f.owner) AS owner, CASE WHEN s.id IS NULL THEN f.day ELSE '1990-01-01' END AS created_at FROM first f FULL JOIN stored s USING (id))"""


def node_parts(g: Graph) -> DataFrame:
    """The parts of the view of the first package, and of the hottest symbol: node, interface, neighbours, call-sites."""
    ids = [g.nodes.filter("kind = 'file'").agg(F.min("id")).first()[0], rollup.hot_symbols(g, 1).first().id]
    key = {"node": "id", "interface": "id", "callers": "edge_key", "callees": "edge_key", "call_sites": "id"}
    parts = [df.select(F.lit(i).alias("of"), F.lit(part).alias("part"), F.col(key[part]).alias("id")) for i in ids for part, df in reads.node_detail(g, i).items()]
    return reduce(DataFrame.unionByName, parts)


NODE_SQL = f"""WITH ask AS (SELECT min(id) AS id FROM node WHERE kind = 'file' UNION ALL SELECT id FROM (SELECT e.target_id AS id FROM edge e JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id AND n.kind = 'symbol' WHERE e.kind IN {K} GROUP BY 1, e.project_id ORDER BY count(*) DESC, e.project_id, 1 LIMIT 1)),
    p AS (SELECT a.id AS of, 'node' AS part, n.id FROM ask a JOIN node n ON n.id = a.id UNION ALL SELECT a.id, 'interface', n.id FROM ask a JOIN edge e ON e.source_id = a.id AND e.kind = 'contains' JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id AND n.kind = 'symbol'
      UNION ALL SELECT a.id, 'callers', e.edge_key FROM ask a JOIN edge e ON e.target_id = a.id UNION ALL SELECT a.id, 'callees', e.edge_key FROM ask a JOIN edge e ON e.source_id = a.id UNION ALL SELECT a.id, 'call_sites', n.id FROM ask a JOIN node n ON n.kind = 'callSite' AND n.enclosing_symbol_id = a.id)
    SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY of, part ORDER BY id) <= 50"""


def manifests(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``manifests, globs, files``: packages by folder, of which some are shut out or have no name."""
    p = g.nodes.filter("kind = 'package'").select("project_id", F.concat(F.lit("packages/"), F.lower("name")).alias("dir"), "name", number("id").alias("n"))
    exports = F.when(F.col("n") % 2 == 0, '"exports":{"./ui":{"types":"./dist/ui.d.ts"},"./*":"./dist/*.js"},').otherwise("")
    text = F.concat(F.lit("{"), exports, F.when(F.col("n") % 6 == 5, '"version":"1"').otherwise(F.concat(F.lit('"name":"@s/'), F.lower("name"), F.lit('"'))), F.lit("}"))
    globs = p.select("project_id", F.explode(F.array(F.lit("packages/*"), F.lit("!packages/nation_1*"))).alias("glob")).distinct()
    at = lambda path, keep: p.filter(keep).select("project_id", F.concat("dir", F.lit(path)).alias("path"), F.concat(F.lit("file:"), "n", F.lit(path)).alias("id"))
    files = at("/src/index.ts", "n % 3 <> 0").unionByName(at("/index.tsx", "true")).unionByName(at("/src/ui/index.ts", "n % 4 = 0"))
    return p.select("project_id", "dir", text.alias("manifest")), globs, files


def workspace_entries(g: Graph) -> DataFrame:
    made, globs, files = manifests(g)
    return workspace.workspace_entries(workspace.members(made, globs), files)


def modules(g: Graph) -> DataFrame:
    """The imports of made-up texts of all files: one of each kind of specifier, resolved among the files."""
    n = number("id")
    files = g.nodes.filter("kind = 'file'").select("project_id", "path", "id", n.alias("n"), F.regexp_replace("path", r"\.ts$", "").alias("stem"))
    lines = ["import a from '../", F.col("stem"), "'\nexport * from \"./../../../", F.col("stem"), ".js\"\n/* import x from './gone' */\nimport {b} from '@/", F.col("path"), "'\nimport './none", F.col("n").cast("string"), "'\nimport type C from '@s/pkg/sub/", F.col("n").cast("string"), "'\nimport d from 'react'\n"]
    text = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    rules = g.nodes.filter("kind = 'repo'").select("project_id", F.lit(0).alias("rank"), F.lit("@/*").alias("pattern"), F.posexplode(F.array(F.lit("lost/*"), F.lit("*"))).alias("pos", "target"))
    found = workspace.resolve_modules(workspace.module_requests(files.select("project_id", "path", "id", text.alias("text"))), rules, files)
    return found.select("project_id", "file_id", "specifier", "status", "module_id", "package", "subpath")


MODULES_SQL = """WITH f AS (SELECT project_id, id, path, regexp_replace(path, '\\.ts$', '') AS stem, split_part(id, ':', 2) AS n FROM node WHERE kind = 'file')
    SELECT f.project_id, f.id AS file_id, s.specifier, s.status, CASE WHEN s.status = 'internal' THEN f.id END AS module_id, s.package, s.subpath FROM f, LATERAL (VALUES ('../' || stem, 'internal', NULL, NULL), ('./../../../' || stem || '.js', 'internal', NULL, NULL), ('@/' || path, 'internal', NULL, NULL), ('./none' || n, 'unresolved', NULL, NULL), ('@s/pkg/sub/' || n, 'external', '@s/pkg', 'sub/' || n), ('react', 'external', 'react', '')) s(specifier, status, package, subpath)"""
ENTRIES_SQL = """WITH p AS (SELECT project_id, lower(name) AS low, split_part(id, ':', 2)::BIGINT AS n FROM node WHERE kind = 'package'), m AS (SELECT * FROM p WHERE n % 6 <> 5 AND NOT regexp_full_match(low, 'nation_1[^/]+'))
    SELECT project_id, '@s/' || low AS name, '' AS subpath, 'file:' || n || CASE WHEN n % 3 <> 0 THEN '/src/index.ts' ELSE '/index.tsx' END AS module_id FROM m UNION ALL SELECT project_id, '@s/' || low, 'ui', 'file:' || n || '/src/ui/index.ts' FROM m WHERE n % 4 = 0"""
PROBE_SQL = f"""WITH hot AS (SELECT e.target_id AS id FROM edge e JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id AND n.kind = 'symbol' WHERE e.kind IN {K} GROUP BY 1, e.project_id ORDER BY count(*) DESC, e.project_id, 1 LIMIT 1),
    dep AS (SELECT project_id, source_id, target_id FROM edge WHERE kind IN {K}),
    walk AS (SELECT DISTINCT project_id, target_id AS id, [target_id] AS path, 0::BIGINT AS depth FROM dep WHERE target_id = (SELECT id FROM hot)
      UNION ALL SELECT d.project_id, d.source_id, list_append(w.path, d.source_id), w.depth + 1 FROM walk w JOIN dep d ON d.project_id = w.project_id AND d.target_id = w.id WHERE w.depth < 3 AND NOT list_contains(w.path, d.source_id))
    SELECT project_id, depth, count(*) AS paths, count(DISTINCT id) AS nodes FROM walk WHERE depth > 0 GROUP BY 1, 2"""
TRAIL_SQL = """WITH up AS (SELECT project_id, target_id AS id, arg_max(source_id, edge_key) AS up FROM edge WHERE kind = 'contains' GROUP BY 1, 2),
    t AS (SELECT n.project_id, n.id, u.up, coalesce(n.name, n.path, n.id) AS trail FROM node n LEFT JOIN up u ON u.project_id = n.project_id AND u.id = n.id UNION ALL SELECT t.project_id, t.id, u.up, coalesce(n.name, n.path, t.up) || ' > ' || t.trail FROM t LEFT JOIN node n ON n.project_id = t.project_id AND n.id = t.up LEFT JOIN up u ON u.project_id = t.project_id AND u.id = t.up WHERE t.up IS NOT NULL)
    SELECT t.project_id, t.id, t.trail, CASE n.kind WHEN 'package' THEN 'file' WHEN 'file' THEN 'symbol' END AS drill FROM t JOIN node n ON n.project_id = t.project_id AND n.id = t.id WHERE t.up IS NULL"""

#: name: (function of the graph, SQL over node, edge, payload and tail)
DETAILS = {
    "ignored_files": (ignored_files, IGNORED_SQL),
    "fragment_cache": (fragment_cache, "WITH f AS (SELECT *, split_part(id, ':', 2)::BIGINT % 7 IN (0, 6) AS hit FROM node WHERE kind = 'file') SELECT project_id, path, hit, CASE WHEN hit THEN 2 END AS n_symbols FROM f"),
    "breadcrumbs": (trails, TRAIL_SQL),
    "node_detail": (node_parts, NODE_SQL),
    "resolve_modules": (modules, MODULES_SQL),
    "workspace_entries": (workspace_entries, ENTRIES_SQL),
    "expansion_probe": (lambda g: traverse.expansion_probe(g, rollup.hot_symbols(g, 1).first().id, 3), PROBE_SQL),
}
#: name: (function of the session and the folder, SQL over the tables)
TABLES = {
    "symbol_ids": (symbol_ids, SYMBOL_SQL),
    "doc_comments": (doc_comments, DOC_SQL),
    "guarded_links": (lambda spark, d: links(spark, d)[1], f"{LINKS} SELECT seq, id, a.owner, CASE WHEN a.owner = h.owner THEN 'linked' ELSE 'owner-mismatch' END AS outcome FROM ask a JOIN holder h USING (id)"),
    "guarded_link_table": (lambda spark, d: links(spark, d)[0], f"{LINKS} SELECT h.id, h.owner, h.created_at, coalesce(arg_max(a.day, a.seq), '1990-01-01') AS updated_at FROM holder h LEFT JOIN ask a ON a.id = h.id AND a.owner = h.owner GROUP BY ALL"),
}
