"""Map roll-ups, global views and metrics: joins and one group-by each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.keys import clamp_limit
from sparkloom.functions.symbols import is_external
from sparkloom.plans.graph import IMPORT_CODES, USAGE_CODES, Graph


def containers(g: Graph, level: str, scope: str | None = None) -> DataFrame:
    if level == "symbol" and scope is None:
        raise ValueError("the symbol level needs a file as its scope")
    n = g.nodes.filter(F.col("kind") == level)
    if scope is None:
        return n
    if level == "symbol":
        return n.filter(F.col("file_id") == scope)
    inside = g.edges.filter((F.col("kind") == "contains") & (F.col("source_id") == scope)).select("project_id", F.col("target_id").alias("id"))
    return n.join(inside, ["project_id", "id"], "left_semi")


def package_of_file(g: Graph) -> DataFrame:
    p = g.nodes.filter("kind = 'package'").select("project_id", F.col("id").alias("source_id"))
    e = g.edges.filter("kind = 'contains'").join(p, ["project_id", "source_id"], "left_semi")
    return e.select("project_id", F.col("target_id").alias("file_id"), F.col("source_id").alias("package_id"))


def child_counts(g: Graph, level: str) -> DataFrame:
    symbols = g.nodes.filter("kind = 'symbol'").select("project_id", "id", "file_id")
    if level == "package":
        return symbols.join(package_of_file(g), ["project_id", "file_id"]).groupBy("project_id", F.col("package_id").alias("id")).agg(F.countDistinct("id").alias("children"))
    if level == "file":
        return symbols.filter("file_id IS NOT NULL").groupBy("project_id", F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return g.edges.filter("kind = 'contains'").groupBy("project_id", F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))


def map_nodes(g: Graph, level: str, scope: str | None = None) -> DataFrame:
    out = containers(g, level, scope).join(child_counts(g, level), ["project_id", "id"], "left")
    return out.select("project_id", "id", F.coalesce("name", "path").alias("label"), F.coalesce("children", F.lit(0)).alias("children"))


def trust_counts() -> list:
    det = F.col("resolution") == "deterministic"
    return [F.count(F.when(det, 1)).alias("deterministic"), F.count(F.when(~det, 1)).alias("inferred")]


def map_edges(g: Graph, level: str, scope: str | None = None) -> DataFrame:
    """Dependencies projected to a level, pairs with both ends in view, self pairs left out."""
    of = g.nodes.select("project_id", "id", "file_id", F.col("id").alias("self"))
    if level == "package":
        of = of.join(package_of_file(g), ["project_id", "file_id"]).select("project_id", "id", F.col("package_id").alias("at"))
    else:
        of = of.select("project_id", "id", F.col("file_id" if level == "file" else "self").alias("at")).dropna()
    shown = containers(g, level, scope).select("project_id", F.col("id").alias("at"))
    of = of.join(shown, ["project_id", "at"], "left_semi")
    src = of.select("project_id", F.col("id").alias("source_id"), F.col("at").alias("src"))
    tgt = of.select("project_id", F.col("id").alias("target_id"), F.col("at").alias("tgt"))
    e = g.dependencies().select("project_id", "source_id", "target_id", "resolution")
    e = e.join(src, ["project_id", "source_id"]).join(tgt, ["project_id", "target_id"]).filter("src != tgt")
    return e.groupBy("project_id", "src", "tgt").agg(*trust_counts())


def map_view(g: Graph, level: str, scope: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, truncated): the first containers by id, the dependencies between them, and whether there are more."""
    n = clamp_limit(limit)
    nodes = map_nodes(g, level, scope)
    first = [r.id for r in nodes.orderBy("project_id", "id").limit(n + 1).collect()]
    shown = nodes.orderBy("project_id", "id").limit(n)
    ends = lambda c: shown.select("project_id", F.col("id").alias(c))
    edges = map_edges(g, level, scope).join(ends("src"), ["project_id", "src"], "left_semi").join(ends("tgt"), ["project_id", "tgt"], "left_semi")
    return shown, edges, len(first) > n


def trust_rows(edges: DataFrame) -> DataFrame:
    """One row for each pair and trust with a count."""
    return edges.unpivot(["project_id", "src", "tgt"], ["deterministic", "inferred"], "trust", "n").filter("n > 0")


def top_level(g: Graph) -> DataFrame:
    files = g.nodes.filter("kind = 'file'").select("project_id", F.col("id").alias("source_id"))
    inside = g.edges.filter("kind = 'contains'").join(files, ["project_id", "source_id"], "left_semi").select("project_id", F.col("target_id").alias("id"))
    return g.nodes.filter("kind = 'symbol'").join(inside, ["project_id", "id"], "left_semi")


def name_collisions(g: Graph) -> DataFrame:
    top = top_level(g).filter("name IS NOT NULL").select("project_id", "name", "id", "file_id")
    twice = top.groupBy("project_id", "name").count().filter("count > 1").drop("count")
    return top.join(twice, ["project_id", "name"], "left_semi")


def unused_symbols(g: Graph) -> DataFrame:
    """Top-level symbols without an incoming dependency; ``candidate`` where an unresolved reference may use them."""
    used = g.dependencies().select("project_id", F.col("target_id").alias("id"))
    out = top_level(g).join(used, ["project_id", "id"], "left_anti")
    gaps = g.tail.filter(F.col("code").isin(*USAGE_CODES))
    anchored = gaps.filter("code = 'unresolved-member' AND target_file_id IS NOT NULL").select("project_id", F.col("target_file_id").alias("file_id"), "name", F.lit(True).alias("a")).distinct()
    loose = gaps.filter("code = 'unbound-callee'").select("project_id", "name", F.lit(True).alias("l")).distinct()
    exported = g.edges.filter("kind = 'exports'").select("project_id", F.col("target_id").alias("id"), F.lit(True).alias("x")).distinct()
    out = out.join(anchored, ["project_id", "file_id", "name"], "left").join(loose, ["project_id", "name"], "left").join(exported, ["project_id", "id"], "left")
    return out.select("project_id", "id", "name", F.coalesce(F.col("a") | F.col("l"), F.col("a"), F.col("l"), F.lit(False)).alias("candidate"), F.coalesce("x", F.lit(False)).alias("exported"))


def hot_symbols(g: Graph, top: int) -> DataFrame:
    symbols = g.nodes.filter("kind = 'symbol'").select("project_id", F.col("id").alias("target_id"))
    degree = g.dependencies().join(symbols, ["project_id", "target_id"], "left_semi").groupBy("project_id", F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return degree.orderBy(F.desc("degree"), "project_id", "id").limit(top)


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def import_metrics(g: Graph) -> DataFrame:
    """Resolution of imports by project; rates are 0 where there is nothing to resolve."""
    e = g.edges.filter("kind = 'imports'").withColumn("out", is_external(F.col("target_id")))
    det, out = F.col("resolution") == "deterministic", F.col("out")
    edges = e.groupBy("project_id").agg(F.count(F.when(~out & det, 1)).alias("deterministic"), F.count(F.when(~out & ~det, 1)).alias("inferred"), F.count(F.when(out, 1)).alias("external"))
    bad = g.tail.filter(F.col("code").isin(*IMPORT_CODES)).groupBy("project_id").agg(F.count(F.when(F.col("code").startswith("ambiguous"), 1)).alias("ambiguous"), F.count(F.when(F.col("code").startswith("unresolved"), 1)).alias("unresolved"))
    m = edges.join(bad, "project_id", "full").fillna(0)
    found = F.col("deterministic") + F.col("inferred") + F.col("external")
    total = found + F.col("ambiguous") + F.col("unresolved")
    return m.withColumns({"total": total, "resolved_rate": F.round(F.coalesce(F.try_divide(found, total), F.lit(0.0)), 6), "deterministic_share": F.round(F.coalesce(F.try_divide(F.col("deterministic"), F.col("deterministic") + F.col("inferred")), F.lit(0.0)), 6)})


def relationship_metrics(g: Graph) -> DataFrame:
    cross = F.col("provenance_pass") == "resolve"
    kinds = {"renders": F.col("sub_kind") == "react:renders", "calls": (F.col("kind") == "calls") & F.col("sub_kind").isNull(), "prop_bindings": F.col("sub_kind") == "react:propBinding"}
    return g.edges.groupBy("project_id").agg(*(F.count(F.when(k & c, 1)).alias(f"{n}_{w}") for n, k in kinds.items() for w, c in (("cross", cross), ("intra", ~cross))))
