"""Imports and call-sites of the test graph for the binding operators, and their SQL.

A file imports the symbols that its dependencies name in other files, one statement for each such file. Files with odd
numbers import by way of a barrel that re-exports all files of the package. Call-sites name the file's first import, a
member of it, or a member of something unknown, in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import bind, workspace
from sparkloom.plans.graph import Graph, cut


def number(column: str) -> F.Column:
    return F.substring_index(column, ":", -1).cast("long")


def imports(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``statements, bindings, exports, re_exports``."""
    symbols = g.nodes.filter("kind = 'symbol'").select("project_id", F.col("id").alias("target_id"), F.col("file_id").alias("m"), "name")
    pairs = cut(g.dependencies().select("project_id", "target_id", "file_id").join(symbols, ["project_id", "target_id"]).filter("file_id <> m").select("project_id", "file_id", "m", "name").distinct(), "pairs")
    homes = g.edges.filter("kind = 'contains' AND target_id LIKE 'file:%'").select("project_id", F.col("target_id").alias("m"), F.concat(F.lit("barrel:"), "source_id").alias("barrel"))
    statement = F.concat("file_id", F.lit(">"), "m")
    status = F.when(number("m") % 11 == 0, "unresolved").when(number("m") % 13 == 0, "ambiguous").otherwise("internal")
    statements = pairs.select("project_id", "file_id", "m").distinct().join(homes, ["project_id", "m"]).select("project_id", statement.alias("statement_id"), "file_id", F.concat(F.lit("./"), "m").alias("specifier"), status.alias("status"), F.when(number("file_id") % 2 == 1, F.col("barrel")).otherwise(F.col("m")).alias("module_id"))
    bindings = pairs.select("project_id", statement.alias("statement_id"), "name", F.col("name").alias("local_name"), F.lit("named").alias("kind"), F.lit(False).alias("type_only"))
    exports = g.edges.filter("kind = 'exports'").select("project_id", F.col("source_id").alias("file_id"), "target_id").join(symbols, ["project_id", "target_id"]).select("project_id", "file_id", F.col("name").alias("exported_name"), F.col("target_id").alias("symbol_id"))
    none = F.lit(None).cast("string")
    return statements, bindings, exports, homes.select("project_id", F.col("barrel").alias("file_id"), F.lit("star").alias("kind"), none.alias("exported_as"), none.alias("name"), F.col("m").alias("target_file"), none.alias("package"))


def import_edges(g: Graph) -> DataFrame:
    return bind.bind_imports(*imports(g)).edges.select("project_id", "source_id", "target_id", "rule", "resolution", "confidence")


def import_gaps(g: Graph) -> DataFrame:
    return bind.bind_imports(*imports(g)).gaps


def unbound(g: Graph, bound: bind.Bound) -> Graph:
    """The graph with callees of its own, as a parser would leave it: no call-site is bound."""
    first = bound.values.groupBy("project_id", "file_id").agg(F.min("root").alias("first"))
    callee = F.when(F.col("ordinal") % 3 == 0, F.col("first")).when(F.col("ordinal") % 3 == 1, F.concat("first", F.lit(".run"))).otherwise("handler.go.now")
    sites = g.nodes.filter("kind = 'callSite'").join(first, ["project_id", "file_id"], "left").withColumns({"callee": callee, "sub_kind": F.when(F.col("ordinal") % 2 == 0, bind.RENDER)}).select(*g.nodes.columns)
    return Graph(g.nodes.filter("kind <> 'callSite'").unionByName(sites), g.edges.filter("kind <> 'calls'"), g.tail, g.payload)


def calls(g: Graph) -> tuple[DataFrame, DataFrame]:
    asked = imports(g)
    bound = bind.bind_imports(*asked)
    return bind.bind_calls(unbound(g, bound), bound, *asked[2:])


def resolved(g: Graph) -> DataFrame:
    """All edges that the resolver adds to the parsed graph."""
    asked = imports(g)
    bound = bind.bind_imports(*asked)
    whole = workspace.resolve_project(unbound(g, bound), *asked, bound=bound)
    return whole.edges.filter("provenance_rule LIKE 'resolve/%' OR provenance_rule LIKE 'react/%'").select("project_id", "source_id", "target_id", "kind", "sub_kind", F.col("provenance_rule").alias("rule"), "resolution", "confidence")


def synthesised(g: Graph) -> DataFrame:
    """Edges from package nodes that are made anew, from folders and names."""
    dirs = g.nodes.filter("kind = 'package'").select("project_id", F.concat(F.lit("pkg "), "name").alias("name"), F.lower("name").alias("dir"))
    whole = workspace.with_packages(Graph(g.nodes.filter("kind <> 'package'"), g.edges, g.tail), dirs)
    made = whole.edges.filter(F.col("provenance_rule") == workspace.CONTAINS_FILE)
    return made.join(whole.nodes.filter("kind = 'package'").select("project_id", F.col("id").alias("source_id"), F.col("name").alias("label")), ["project_id", "source_id"]).select("project_id", "source_id", "label", "target_id")


IMPORTS = """WITH pair AS (SELECT DISTINCT e.project_id, e.file_id AS f, t.file_id AS m, t.name FROM edge e JOIN node t ON t.project_id = e.project_id AND t.id = e.target_id AND t.kind = 'symbol' WHERE e.kind IN ('imports', 'references', 'calls', 'extends', 'implements') AND e.file_id <> t.file_id),
    home AS (SELECT project_id, target_id AS m, source_id AS pkg, count(*) OVER (PARTITION BY project_id, source_id) AS files FROM edge WHERE kind = 'contains' AND target_id LIKE 'file:%'),
    st AS (SELECT DISTINCT p.project_id, p.f, p.m, p.f || '>' || p.m AS sid, h.pkg, h.files, split_part(p.f, ':', 2)::BIGINT % 2 = 1 AS via, CASE WHEN split_part(p.m, ':', 2)::BIGINT % 11 = 0 THEN 'unresolved' WHEN split_part(p.m, ':', 2)::BIGINT % 13 = 0 THEN 'ambiguous' ELSE 'internal' END AS status FROM pair p JOIN home h ON h.project_id = p.project_id AND h.m = p.m),
    x AS (SELECT e.project_id, e.source_id AS m, n.name, min(n.id) AS sym FROM edge e JOIN node n ON n.project_id = e.project_id AND n.id = e.target_id AND n.kind = 'symbol' WHERE e.kind = 'exports' GROUP BY 1, 2, 3),
    wide AS (SELECT x.project_id, h.pkg, x.name, count(DISTINCT sym) AS k, min(sym) AS sym FROM x JOIN home h ON h.project_id = x.project_id AND h.m = x.m GROUP BY 1, 2, 3),
    b AS (SELECT s.*, p.name, CASE WHEN via THEN 'barrel:' || s.pkg ELSE s.m END AS module, CASE WHEN via THEN coalesce(w.k, 0) ELSE (x.sym IS NOT NULL)::BIGINT END AS k, CASE WHEN via THEN w.sym ELSE x.sym END AS sym, CASE WHEN via AND files = 1 THEN 'inferred' ELSE 'deterministic' END AS resolution
      FROM st s JOIN pair p ON p.project_id = s.project_id AND p.f = s.f AND p.m = s.m LEFT JOIN x ON x.project_id = s.project_id AND x.m = s.m AND x.name = p.name LEFT JOIN wide w ON w.project_id = s.project_id AND w.pkg = s.pkg AND w.name = p.name WHERE s.status = 'internal')"""
EDGES_SQL = f"{IMPORTS} SELECT project_id, f AS source_id, sym AS target_id, 'resolve/import' AS rule, resolution, CASE WHEN resolution = 'inferred' THEN 'high' END AS confidence FROM b WHERE k = 1 UNION SELECT project_id, f, module, 'resolve/import-module', 'deterministic', NULL FROM b GROUP BY project_id, f, module, sid HAVING NOT bool_or(k = 1)"
GAPS_SQL = f"{IMPORTS} SELECT project_id, status || '-module' AS code, f AS importer_file_id, './' || m AS specifier, NULL::VARCHAR AS target_file_id, NULL::VARCHAR AS name FROM st WHERE status <> 'internal' UNION SELECT project_id, CASE WHEN k > 1 THEN 'ambiguous-export' ELSE 'unresolved-export' END, f, './' || m, module, name FROM b WHERE k <> 1"
CALLS = f"""{IMPORTS}, val AS (SELECT project_id, f AS file_id, name AS root, arg_max(sym, sid) AS sym, arg_max(resolution, sid) AS resolution FROM b WHERE k = 1 GROUP BY 1, 2, 3),
    fst AS (SELECT project_id, file_id, root, sym, resolution FROM val QUALIFY row_number() OVER (PARTITION BY project_id, file_id ORDER BY root) = 1),
    site AS (SELECT c.project_id, c.id, c.file_id, c.ordinal % 3 AS how, c.ordinal % 2 = 0 AS render, v.root, v.sym, v.resolution FROM node c JOIN edge e ON e.project_id = c.project_id AND e.kind = 'contains' AND e.target_id = c.enclosing_symbol_id AND e.source_id = c.file_id JOIN fst v ON v.project_id = c.project_id AND v.file_id = c.file_id WHERE c.kind = 'callSite')"""
CALL_EDGES_SQL = f"""{CALLS} SELECT project_id, id AS source_id, sym AS target_id, 'calls' AS kind, CASE WHEN how = 1 THEN 'react:memberRoot' WHEN render THEN 'react:renders' END AS sub_kind, CASE WHEN render THEN 'react/renders-' ELSE 'react/calls-' END || CASE how WHEN 1 THEN 'member-root' ELSE 'import' END AS rule, CASE how WHEN 1 THEN 'inferred' ELSE resolution END AS resolution, CASE WHEN how = 1 THEN 'medium' WHEN resolution = 'inferred' THEN 'high' END AS confidence FROM site WHERE how < 2
    UNION SELECT s.project_id, s.id, n.id, 'references', 'react:propBinding', 'react/binds-prop', s.resolution, CASE WHEN s.resolution = 'inferred' THEN 'high' END FROM site s JOIN edge c ON c.project_id = s.project_id AND c.source_id = s.sym AND c.kind = 'contains' JOIN node n ON n.project_id = c.project_id AND n.id = c.target_id AND n.sub_kind = 'react:prop' JOIN payload p ON p.project_id = s.project_id AND p.id = s.id AND p.pass_kind = 'named' AND p.arg_name = n.name WHERE s.how = 0 AND s.render"""
CALL_GAPS_SQL = f"{CALLS} SELECT DISTINCT s.project_id, CASE WHEN how = 1 THEN 'unresolved-member' ELSE 'unbound-callee' END AS code, s.file_id AS importer_file_id, CASE WHEN how = 1 THEN s.root || '.run' ELSE 'handler.go.now' END AS specifier, CASE WHEN how = 1 THEN n.file_id END AS target_file_id, CASE WHEN how = 1 THEN 'run' ELSE 'go.now' END AS name FROM site s JOIN node n ON n.project_id = s.project_id AND n.id = s.sym WHERE how > 0"

#: name: (function of the graph, SQL over node, edge, payload and tail)
BINDING = {
    "import_binding": (import_edges, EDGES_SQL),
    "import_gaps": (import_gaps, GAPS_SQL),
    "call_site_binding": (lambda g: calls(g)[0], CALL_EDGES_SQL),
    "call_site_gaps": (lambda g: calls(g)[1], CALL_GAPS_SQL),
    "resolve_project": (resolved, f"SELECT project_id, source_id, target_id, 'imports' AS kind, NULL::VARCHAR AS sub_kind, rule, resolution, confidence FROM ({EDGES_SQL}) UNION ALL SELECT project_id, source_id, target_id, kind, sub_kind, rule, resolution, confidence FROM ({CALL_EDGES_SQL})"),
    "package_synthesis": (synthesised, "SELECT f.project_id, 'pkg ' || p.name AS source_id, 'pkg ' || p.name AS label, f.id AS target_id FROM node f JOIN node p ON p.project_id = f.project_id AND p.kind = 'package' AND lower(p.name) = split_part(f.path, '/', 1) WHERE f.kind = 'file'"),
}
