"""A report for each project, as text and as JSON, made from the metrics without fetching them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.rollup import import_metrics, relationship_metrics
from sparkloom.plans.graph import Graph

#: The counts of imports and of relationships, in the report's order.
IMPORTS = ("total", "deterministic", "inferred", "external", "ambiguous", "unresolved")
RATES = ("resolved_rate", "deterministic_share")
RELATIONS = ("renders_cross", "renders_intra", "calls_cross", "calls_intra", "prop_bindings_cross", "prop_bindings_intra")


def counts(df: DataFrame, value: str, name: str) -> DataFrame:
    """``project_id`` and a sorted array of ``(value, n)``; the values are kinds, of which a project has a few dozen."""
    each = df.filter(F.col(value).isNotNull()).groupBy("project_id", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias(name))


def inline(pairs: Column) -> Column:
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["value"], F.lit("="), p["n"].cast("string"))), " ")
    return F.when(F.size(pairs) > 0, text).otherwise("none")


def percent(rate: Column) -> Column:
    return F.concat(F.round(rate * 100, 1).cast("decimal(5,1)").cast("string"), F.lit("%"))


def project_reports(g: Graph, files: DataFrame | None = None) -> DataFrame:
    """``project_id, text, json`` of every project that has nodes, edges or unresolved references.

    ``files(project_id, status)`` adds how many files were analyzed, skipped and so on. The same graph gives the same
    report. A project without imports has rates of 0; kinds that don't occur are left out, and ``none`` stands for no
    kind at all.
    """
    parts = {"nodes": counts(g.nodes, "kind", "nodes"), "symbols": counts(g.nodes.filter("kind = 'symbol'"), "sub_kind", "symbols"), "edges": counts(g.edges, "kind", "edges")}
    if files is not None:
        parts = {"files": counts(files, "status", "files")} | parts
    out = g.nodes.select("project_id").union(g.edges.select("project_id")).union(g.tail.select("project_id")).distinct()
    for part in (*parts.values(), import_metrics(g), relationship_metrics(g)):
        out = out.join(part, "project_id", "left")
    empty = F.array().cast("array<struct<value:string,n:bigint>>")
    out = out.withColumns({k: F.coalesce(k, empty) for k in parts} | {k: F.coalesce(k, F.lit(0)) for k in (*IMPORTS, *RATES, *RELATIONS)})
    listed = lambda names: F.concat_ws(" ", *(F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names))
    lines = [("project", F.col("project_id")), *((k, inline(F.col(k))) for k in parts), ("imports", listed(IMPORTS)), *((k, percent(F.col(k))) for k in RATES), ("relations", listed(RELATIONS))]
    text = F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in lines))
    json = F.to_json(F.struct("project_id", *(F.map_from_entries(k).alias(k) for k in parts), F.struct(*IMPORTS, *RATES).alias("imports"), F.struct(*RELATIONS).alias("relations")))
    return out.select("project_id", text.alias("text"), json.alias("json"))
