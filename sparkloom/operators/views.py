"""What pages about a node show: signatures, users and used nodes, bindings of arguments, hits in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import reads, traverse
from sparkloom.plans.graph import DEPENDENCIES, Graph


def label() -> Column:
    return F.coalesce("name", "path")


def declared_signatures(g: Graph, type_field: str = "type", return_field: str = "returnType") -> DataFrame:
    """``name(p: T, q): R`` of each symbol, from the symbols in it by id and from fields of ``properties``.

    What isn't recorded is left out: a parameter's type, the result, and the brackets of a symbol that holds none.
    """
    kept = lambda field: F.coalesce(F.concat(F.lit(": "), F.get_json_object("properties", f"$.{field}")), F.lit(""))
    symbols = g.nodes.filter("kind = 'symbol'")
    inner = symbols.select("project_id", F.col("id").alias("target_id"), F.concat(label(), kept(type_field)).alias("text"))
    held = g.edges.filter("kind = 'contains'").select("project_id", F.col("source_id").alias("id"), "target_id").join(inner, ["project_id", "target_id"])
    # The list of a symbol's parameters is as long as its source says.
    lists = held.groupBy("project_id", "id").agg(F.array_sort(F.collect_list(F.struct("target_id", "text"))).alias("list"))
    args = lists.select("project_id", "id", F.concat(F.lit("("), F.array_join(F.col("list.text"), ", "), F.lit(")")).alias("args"))
    return symbols.join(args, ["project_id", "id"], "left").select("project_id", "id", F.concat(label(), F.coalesce("args", F.lit("")), kept(return_field)).alias("signature"))


def uses(g: Graph, node_id: str) -> DataFrame:
    """A node's callers and callees, by dependencies only; ``has_inferred`` looks at all of its edges."""
    near = reads.neighbors(g, node_id, "in").withColumn("direction", F.lit("in")).unionByName(reads.neighbors(g, node_id, "out").withColumn("direction", F.lit("out")))
    inferred = not near.filter("resolution = 'inferred'").isEmpty()
    return near.filter(F.col("kind").isin(*DEPENDENCIES)).withColumn("has_inferred", F.lit(inferred))


def binding_rows(g: Graph) -> DataFrame:
    """The arguments of call-sites; ``uncertain`` are those without a parameter or with an inferred one."""
    unsure = F.col("bound_id").isNull() | F.coalesce(F.col("bound_resolution") == "inferred", F.lit(False))
    return reads.call_bindings(g).withColumn("uncertain", unsure)


def blast_rows(g: Graph, node_id: str, max_depth: int = 32) -> DataFrame:
    """Hits with labels, by depth and then by label, or by id where a node has none or is absent."""
    names = g.nodes.select("project_id", "id", label().alias("label"))
    return traverse.blast_radius(g, node_id, max_depth=max_depth).join(names, ["project_id", "id"], "left").orderBy("depth", F.coalesce("label", "id"))
