"""Point reads, neighbours, search and keyset pages. Every join carries the project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.keys import clamp_limit, decode_cursor, encode_cursor
from sparkloom.plans.graph import Graph


@dataclass
class Page:
    items: list
    next_cursor: str | None
    total: int | None


def after(df: DataFrame, keys: list[str], cursor: tuple | None) -> DataFrame:
    """Rows behind a cursor, in the order of ``keys``."""
    if cursor is None:
        return df
    cond: Column = F.lit(False)
    for i in range(len(keys)):
        step: Column = F.col(keys[i]) > F.lit(cursor[i])
        for j in range(i):
            step = (F.col(keys[j]) == F.lit(cursor[j])) & step
        cond = cond | step
    return df.filter(cond)


def top_rows(df: DataFrame, keys: list[str], limit: int | None = None, cursor: tuple | None = None) -> DataFrame:
    """A page as a plan: a filter and a top-k, without counting or fetching."""
    return after(df, keys, cursor).orderBy(*keys).limit(clamp_limit(limit))


def page(df: DataFrame, keys: list[str], limit: int | None = None, cursor: str | None = None, numeric: tuple[bool, ...] | None = None) -> Page:
    """A fetched page: one row more than wanted tells whether another follows; the total comes with the first."""
    n = clamp_limit(limit)
    at = None if cursor is None else decode_cursor(cursor, numeric or (False,) * len(keys))
    rows = after(df, keys, at).orderBy(*keys).limit(n + 1).collect()
    kept = rows[:n]
    return Page(kept, encode_cursor(tuple(kept[-1][k] for k in keys)) if len(rows) > n else None, df.count() if cursor is None else None)


def get_node(g: Graph, node_id: str) -> DataFrame:
    return g.nodes.filter(F.col("id") == node_id)


def file_content_hashes(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'file'").select("project_id", "path", "content_hash").dropna()


def neighbors(g: Graph, node_id: str, direction: str, kind: str | None = None) -> DataFrame:
    """Edges at a node with the node at the far end, whose columns are null where it has no row."""
    near, far = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    e = g.edges.filter(F.col(near) == node_id)
    e = e if kind is None else e.filter(F.col("kind") == kind)
    n = g.nodes.select("project_id", F.col("id").alias(far), F.col("kind").alias("far_kind"), F.coalesce("name", "path").alias("far_label"))
    return e.select("project_id", "edge_key", "kind", "resolution", far).join(n, ["project_id", far], "left").withColumnRenamed(far, "far_id")


def search(g: Graph, query: str = "", kind: str | None = None, sub_kind: str | None = None) -> DataFrame:
    """Literal, case-insensitive part of a name or path; an empty query matches all."""
    df = g.nodes if kind is None else g.nodes.filter(F.col("kind") == kind)
    df = df if sub_kind is None else df.filter(F.col("sub_kind") == sub_kind)
    if query:
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(query)))
        df = df.filter(has("name") | has("path"))
    return df


def contained(g: Graph, node_id: str) -> DataFrame:
    e = g.edges.filter((F.col("kind") == "contains") & (F.col("source_id") == node_id)).select("project_id", F.col("target_id").alias("id"))
    return e.join(g.nodes, ["project_id", "id"])


def declared_interface(g: Graph, node_id: str) -> DataFrame:
    return contained(g, node_id).filter("kind = 'symbol'")


def contained_declarations(g: Graph, node_id: str) -> DataFrame:
    return contained(g, node_id).filter("kind != 'callSite'")


def call_sites_of(g: Graph, node_id: str) -> DataFrame:
    return g.nodes.filter((F.col("enclosing_symbol_id") == node_id) & (F.col("kind") == "callSite"))


def unresolved_references(g: Graph, target_file_id: str | None = None, codes: list[str] | None = None) -> DataFrame:
    df = g.tail if target_file_id is None else g.tail.filter(F.col("target_file_id") == target_file_id)
    return df if codes is None else df.filter(F.col("code").isin(codes) if codes else F.lit(False))


def call_bindings(g: Graph) -> DataFrame:
    """Arguments of all call-sites with the symbol that an outgoing ``references`` edge binds by the argument's name.

    Of several edges to one name, that with the largest key binds. Positional and spread arguments stay unbound.
    """
    e = g.edges.filter("kind = 'references'").select("project_id", F.col("source_id").alias("id"), "target_id", "edge_key", "resolution")
    names = g.nodes.filter("kind = 'symbol'").select("project_id", F.col("id").alias("target_id"), F.col("name").alias("arg_name"))
    bound = e.join(names, ["project_id", "target_id"]).groupBy("project_id", "id", "arg_name").agg(F.max(F.struct("edge_key", "target_id", "resolution")).alias("b"))
    return g.payload.join(bound, ["project_id", "id", "arg_name"], "left").select("project_id", "id", "pos", "arg_name", "pass_kind", F.col("b.target_id").alias("bound_id"), F.col("b.resolution").alias("bound_resolution"))


def node_detail(g: Graph, node_id: str) -> dict[str, DataFrame]:
    """The parts of a node's view, each lazy."""
    return {"node": get_node(g, node_id), "interface": top_rows(declared_interface(g, node_id), ["id"]), "callers": top_rows(neighbors(g, node_id, "in"), ["edge_key"]), "callees": top_rows(neighbors(g, node_id, "out"), ["edge_key"]), "call_sites": top_rows(call_sites_of(g, node_id), ["id"])}


def focus(g: Graph, node_id: str) -> DataFrame:
    """One undirected hop around a node, the node included."""
    e = g.edges.filter((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    return e.select("project_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def declaration_buckets(g: Graph) -> DataFrame:
    bucket = F.when(F.col("sub_kind").isin("react:prop", "ts:parameter"), "parameter").when(F.col("sub_kind") == "ts:local", "local").when(F.col("kind") == "symbol", "nested").otherwise("none")
    return g.nodes.select("project_id", "id", bucket.alias("bucket"))


def signatures(g: Graph) -> DataFrame:
    """``call(arg, arg)`` of each call-site's arguments, in order; :func:`views.declared_signatures` has those of symbols."""
    args = g.payload.groupBy("project_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("arg_name", F.lit("...")).alias("a")))), lambda x: x["a"]), ", ").alias("args"))
    return args.select("project_id", "id", F.concat(F.lit("call("), "args", F.lit(")")).alias("signature"))
