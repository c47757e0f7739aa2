"""A code graph made of the star-schema tables, so that every graph operator has data at any scale.

The text is SQL that Spark and DuckDB both read. ``{sha}`` stands for the engine's SHA-256 function.
Regions are projects, nations packages, suppliers files and parts symbols; see README for the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans.graph import Graph, cut

TABLES = ("region", "nation", "supplier", "part", "lineitem")
ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"

_NODE = "project_id, id, kind, sub_kind, name, path, content_hash, enclosing_symbol_id, callee, ordinal, file_id, properties"
_S = "CAST(NULL AS VARCHAR(64))"


def _edge(project: str, source: str, target: str, kind: str, sub: str, resolution: str, confidence: str, rule_pass: str, rule: str, file_id: str, rest: str) -> str:
    return f"SELECT {project} AS project_id, {source} AS source_id, {target} AS target_id, {kind} AS kind, {sub} AS sub_kind, {resolution} AS resolution, {confidence} AS confidence, {rule_pass} AS provenance_pass, {rule} AS provenance_rule, {file_id} AS file_id {rest}"


_DET = "CASE WHEN l_linestatus = 'F' THEN 'deterministic' ELSE 'inferred' END"
_RANK = "CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 3 END"
_CONF = "CASE conf WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END"
_KIND = "CASE month(l_shipdate) % 5 WHEN 0 THEN 'imports' WHEN 1 THEN 'references' WHEN 2 THEN 'calls' WHEN 3 THEN 'extends' ELSE 'implements' END"

CTES = [
    ("g_file", "SELECT s_suppkey, 'proj:' || n_regionkey AS project_id, 'file:' || s_suppkey AS id, lower(n_name) || '/' || s_name || '.ts' AS path, {sha} AS content_hash, 'pkg:' || n_nationkey AS pkg_id FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    ("g_part", "SELECT p_partkey, p_name || ' ' || p_brand AS name, 'ts:' || lower(replace(p_type, ' ', '-')) AS sub_kind, p_size, p_type, f.project_id, f.id AS file_id, f.path, p_size <= 45 AS top, min(CASE WHEN p_size <= 45 THEN p_partkey END) OVER (PARTITION BY f.id) AS receiver FROM (SELECT part.*, p_partkey % n AS owner FROM part CROSS JOIN (SELECT count(*) AS n FROM supplier) c) p JOIN g_file f ON f.s_suppkey = p.owner"),
    ("g_line", f"SELECT l.*, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS next_part FROM lineitem l"),
    ("g_call", f"SELECT l.*, p.project_id, p.file_id, p.receiver, 'call:' || l_partkey || '#' || (row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, {ORDER}) - 1) AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, {ORDER}) - 1 AS ordinal FROM lineitem l JOIN g_part p ON p.p_partkey = l_partkey WHERE l_quantity = 50"),
    ("g_prop", "SELECT DISTINCT project_id, file_id, receiver, 'prop:' || receiver || ':' || v.name AS id, v.name AS name FROM g_part CROSS JOIN (VALUES ('discount'), ('tax')) AS v(name)"),
    (
        "node",
        f"SELECT 'proj:' || r_regionkey AS project_id, 'repo:' || r_regionkey AS id, 'repo' AS kind, {_S} AS sub_kind, r_name AS name, {_S} AS path, {_S} AS content_hash, {_S} AS enclosing_symbol_id, {_S} AS callee, CAST(NULL AS BIGINT) AS ordinal, {_S} AS file_id, '{{{{}}}}' AS properties FROM region"
        f" UNION ALL SELECT 'proj:' || n_regionkey, 'pkg:' || n_nationkey, 'package', NULL, n_name, NULL, NULL, NULL, NULL, NULL, NULL, '{{{{}}}}' FROM nation"
        f" UNION ALL SELECT project_id, id, 'file', NULL, NULL, path, content_hash, NULL, NULL, NULL, id, '{{{{}}}}' FROM g_file"
        f""" UNION ALL SELECT project_id, 'sym:' || p_partkey, 'symbol', sub_kind, name, NULL, NULL, NULL, NULL, NULL, file_id, CASE WHEN p_size > 40 THEN '{{{{}}}}' ELSE '{{{{"flavor":"' || p_type || '","size":"' || p_size || '"}}}}' END FROM g_part"""
        f" UNION ALL SELECT project_id, id, 'symbol', 'react:prop', name, NULL, NULL, NULL, NULL, NULL, file_id, '{{{{}}}}' FROM g_prop"
        f" UNION ALL SELECT project_id, id, 'callSite', NULL, NULL, NULL, NULL, 'sym:' || l_partkey, 'sym:' || receiver, ordinal, file_id, '{{{{}}}}' FROM g_call",
    ),
    (
        "g_dep",
        f"SELECT p.project_id, 'sym:' || l_partkey AS source_id, 'sym:' || next_part AS target_id, {_KIND} AS kind, {_DET} AS resolution, min({_RANK}) AS conf, p.file_id FROM g_line JOIN g_part p ON p.p_partkey = l_partkey WHERE l_quantity >= 36 AND next_part IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 7",
    ),
    (
        "g_edge",
        " UNION ALL ".join([
            _edge("'proj:' || n_regionkey", "'repo:' || n_regionkey", "'pkg:' || n_nationkey", "'contains'", _S, "'deterministic'", _S, "'parse'", "'workspace/contains-package'", _S, "FROM nation"),
            _edge("project_id", "pkg_id", "id", "'contains'", "NULL", "'deterministic'", "NULL", "'parse'", "'workspace/contains-file'", "NULL", "FROM g_file"),
            _edge("project_id", "CASE WHEN top THEN file_id ELSE 'sym:' || receiver END", "'sym:' || p_partkey", "'contains'", "NULL", "'deterministic'", "NULL", "'parse'", "'extract/declaration'", "file_id", "FROM g_part"),
            _edge("project_id", "'sym:' || receiver", "id", "'contains'", "NULL", "'deterministic'", "NULL", "'parse'", "'extract/prop'", "file_id", "FROM g_prop"),
            _edge("project_id", "'sym:' || l_partkey", "id", "'contains'", "NULL", "'deterministic'", "NULL", "'parse'", "'extract/invocation'", "file_id", "FROM g_call"),
            _edge("project_id", "file_id", "'sym:' || p_partkey", "'exports'", "NULL", "'deterministic'", "NULL", "'parse'", "'extract/export'", "file_id", "FROM g_part WHERE top AND p_partkey % 3 = 0"),
            _edge("project_id", "source_id", "target_id", "kind", "NULL", "resolution", _CONF, "'resolve'", "'bind/dependency'", "file_id", "FROM g_dep"),
            _edge("project_id", "id", "'sym:' || receiver", "'calls'", "'react:renders'", _DET, f"CASE {_RANK} WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END", "'resolve'", "'bind/call-site'", "file_id", "FROM g_call"),
            _edge("project_id", "id", "'prop:' || receiver || ':discount'", "'references'", "'react:propBinding'", _DET, f"CASE {_RANK} WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END", "'resolve'", "'bind/prop'", "file_id", "FROM g_call"),
            _edge("project_id", "id", "'prop:' || receiver || ':tax'", "'references'", "'react:propBinding'", _DET, f"CASE {_RANK} WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END", "'parse'", "'bind/prop'", "file_id", "FROM g_call WHERE l_linenumber % 2 = 1"),
        ]),
    ),
    ("edge", """SELECT '["' || source_id || '","' || kind || '","' || target_id || '",' || coalesce('"' || sub_kind || '"', 'null') || ',"' || resolution || '"]' AS edge_key, * FROM g_edge"""),
    (
        "payload",
        "SELECT project_id, id, a.pos, CASE a.pos WHEN 0 THEN 'discount' WHEN 1 THEN 'tax' WHEN 2 THEN 'qty' END AS arg_name, CASE WHEN a.pos = 3 THEN 'spread' ELSE 'named' END AS pass_kind FROM g_call CROSS JOIN (VALUES (0), (1), (2), (3)) AS a(pos) WHERE a.pos < 3 OR l_returnflag = 'R'",
    ),
    (
        "g_tail",
        "SELECT DISTINCT p.project_id, p.file_id AS importer_file_id, CASE l_linenumber % 6 WHEN 0 THEN 'unresolved-module' WHEN 1 THEN 'ambiguous-module' WHEN 2 THEN 'unresolved-export' WHEN 3 THEN 'ambiguous-export' WHEN 4 THEN 'unresolved-member' ELSE 'unbound-callee' END AS code, 'spec:' || p.name AS specifier, CASE WHEN l_linenumber % 6 IN (2, 3, 4) THEN p.file_id END AS target_file_id, CASE WHEN l_linenumber % 6 >= 2 THEN p.name END AS name FROM lineitem JOIN g_part p ON p.p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity <= 2",
    ),
    ("tail", """SELECT '["' || importer_file_id || '","' || code || '","' || specifier || '",' || coalesce('"' || name || '"', 'null') || ']' AS ref_key, * FROM g_tail"""),
]


def with_ctes(sha: str) -> str:
    text = "s_name || '|' || CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR(32))"
    return "WITH " + ", ".join(f"{k} AS ({v.replace('{sha}', sha.format(text)).replace('{{{{', '{').replace('}}}}', '}').replace('{{', '{').replace('}}', '}')})" for k, v in CTES) + " "


def duckdb(sql: str) -> str:
    """``sql`` over the tables ``node``, ``edge``, ``payload`` and ``tail`` for DuckDB."""
    head = with_ctes("sha256({})").replace("WITH ", "WITH RECURSIVE ", 1)
    for t in ("node", "edge", "payload", "tail"):
        head = head.replace(f", {t} AS (", f", {t} AS MATERIALIZED (", 1)
    return head.rstrip() + (", " + sql[5:] if sql.upper().startswith("WITH ") else " " + sql)


_stored: dict[tuple[str, str], Graph] = {}


def load(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the tables in ``sf_dir``, projected and stored once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        head = with_ctes("sha2({}, 256)")
        _stored[key] = Graph(*(cut(spark.sql(f"{head} SELECT * FROM {t}"), t) for t in ("node", "edge", "tail", "payload")))
        for t in TABLES:
            spark.catalog.dropTempView(t)
    return _stored[key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
