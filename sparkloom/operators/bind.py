"""Binding of imports and call-sites to symbols, as joins over resolved modules and export chains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.keys import key_of
from sparkloom.operators.resolve import export_chain
from sparkloom.plans.graph import Graph, cut

#: Sub-kinds of call-sites, edges and symbols.
RENDER, RENDERS, MEMBER_ROOT, PROP, PROP_BINDING = "react:element", "react:renders", "react:memberRoot", "react:prop", "react:propBinding"
EDGE = ["project_id", "source_id", "target_id", "kind", "sub_kind", "rule", "resolution", "confidence"]
GAP = ["project_id", "code", "importer_file_id", "specifier", "target_file_id", "name"]


@dataclass(frozen=True)
class Bound:
    """``edges`` and ``gaps`` of imports; ``values(project_id, file_id, root, symbol_id, resolution)`` and
    ``spaces(project_id, file_id, root, module_id)`` say what a file's local names stand for."""

    edges: DataFrame
    gaps: DataFrame
    values: DataFrame
    spaces: DataFrame


def confidence(resolution: Column) -> Column:
    """Export chains infer with high confidence only."""
    return F.when(resolution == "inferred", "high")


def chains(asked: DataFrame, exports: DataFrame, re_exports: DataFrame) -> DataFrame:
    """The distinct ``asked(project_id, module_id, name)`` with ``outcome, symbol_id, resolution, external``.

    File ids are scoped by project. What a package re-exports, by name or by star, ends at the external symbol of that
    package, proven whatever led there.
    """
    scoped = lambda c: F.when(F.col(c).isNotNull(), key_of(F.col("project_id"), F.col(c)))
    hops = re_exports.withColumns({"file_id": scoped("file_id"), "target_file": scoped("target_file")})
    known = exports.select(scoped("file_id").alias("file_id"), "exported_name", "symbol_id")
    ask = cut(asked.select("project_id", "module_id", "name").distinct().withColumn("request_id", key_of(F.col("project_id"), F.col("module_id"), F.col("name"))), "asked")
    found = export_chain(ask.select("request_id", scoped("module_id").alias("file_id"), "name"), known, hops)
    external = F.col("outcome") == "external"
    return ask.join(found, "request_id").select("project_id", "module_id", "name", F.when(external, "bound").otherwise(F.col("outcome")).alias("outcome"), "symbol_id", "resolution", external.alias("external"))


def bind_imports(statements: DataFrame, bindings: DataFrame, exports: DataFrame, re_exports: DataFrame) -> Bound:
    """Edges of ``statements(project_id, statement_id, file_id, specifier, status, module_id)``.

    ``status`` is ``internal``, ``external`` (nothing to bind), ``unresolved`` or ``ambiguous`` (a gap, no edge).
    ``bindings(project_id, statement_id, name, local_name, kind, type_only)`` are the imported names; those of values
    follow their export chain, the others bind nothing. A statement that binds no symbol gets an edge to its module.
    Of a file's equal local names that of the last statement holds. Repeated edges and gaps count once.
    """
    inside = statements.filter("status = 'internal'")
    names = cut(inside.select("project_id", "statement_id", "file_id", "specifier", "module_id").join(bindings, ["project_id", "statement_id"]), "names")
    wanted = names.filter("kind <> 'namespace' AND NOT type_only")
    found = cut(wanted.join(chains(wanted, exports, re_exports), ["project_id", "module_id", "name"]), "imports")
    bound = found.filter("outcome = 'bound'")
    rule = F.when(F.col("external"), "resolve/import-external").otherwise("resolve/import")
    exact = bound.select("project_id", F.col("file_id").alias("source_id"), F.col("symbol_id").alias("target_id"), rule.alias("rule"), "resolution")
    bare = inside.join(bound.select("project_id", "statement_id").distinct(), ["project_id", "statement_id"], "left_anti")
    coarse = bare.select("project_id", F.col("file_id").alias("source_id"), F.col("module_id").alias("target_id"), F.lit("resolve/import-module").alias("rule"), F.lit("deterministic").alias("resolution"))
    edges = exact.unionByName(coarse).distinct().withColumns({"kind": F.lit("imports"), "sub_kind": F.lit(None).cast("string"), "confidence": confidence(F.col("resolution"))})
    none = F.lit(None).cast("string")
    lost = statements.filter("status IN ('unresolved', 'ambiguous')").select("project_id", F.concat("status", F.lit("-module")).alias("code"), F.col("file_id").alias("importer_file_id"), "specifier", none.alias("target_file_id"), none.alias("name"))
    missing = found.filter("outcome <> 'bound'").select("project_id", F.concat("outcome", F.lit("-export")).alias("code"), F.col("file_id").alias("importer_file_id"), "specifier", F.col("module_id").alias("target_file_id"), "name")
    last = lambda df, *c: df.groupBy("project_id", "file_id", F.col("local_name").alias("root")).agg(F.max(F.struct("statement_id", *c)).alias("_m")).select("project_id", "file_id", "root", *(f"_m.{x}" for x in c))
    spaces = last(names.filter("kind = 'namespace' AND NOT type_only"), "module_id")
    return Bound(edges.select(*EDGE), lost.unionByName(missing).distinct().select(*GAP), last(bound, "symbol_id", "resolution"), spaces)


def bind_calls(g: Graph, bound: Bound, exports: DataFrame, re_exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and gaps of the unbound call-sites in top-level symbols, in files that import something.

    A plain callee binds to its import. A member of a value binds its root only, inferred, and leaves a gap there; a
    member of a namespace follows the export chain, or leaves a gap in that module; another root leaves a gap without
    a file. A callee that ends in its first dot names nothing. Rendered targets also bind named arguments to props.
    """
    here = ["project_id", "file_id", "root"]
    files = g.nodes.filter("kind = 'file'").select("project_id", F.col("id").alias("source_id"))
    contained = g.edges.filter("kind = 'contains'").select("project_id", "source_id", "target_id")
    top = contained.join(files, ["project_id", "source_id"], "left_semi").select("project_id", F.col("target_id").alias("enclosing_symbol_id"))
    calls = g.edges.filter("kind = 'calls'").select("project_id", F.col("source_id").alias("id"))
    active = bound.values.select("project_id", "file_id").unionByName(bound.spaces.select("project_id", "file_id"))
    sites = g.nodes.filter("kind = 'callSite' AND callee <> ''").join(top, ["project_id", "enclosing_symbol_id"], "left_semi").join(calls, ["project_id", "id"], "left_anti").join(active, ["project_id", "file_id"], "left_semi")
    dot = F.instr("callee", ".")
    sites = sites.select("project_id", "file_id", "id", "sub_kind", "callee", F.substring_index("callee", ".", 1).alias("root"), F.when(dot > 0, F.expr("substring(callee, instr(callee, '.') + 1)")).alias("member")).filter("member IS NULL OR member <> ''")
    known = cut(sites.join(bound.values, here, "left").join(bound.spaces, here, "left"), "calls")
    by_space = known.filter("member IS NOT NULL AND symbol_id IS NULL AND module_id IS NOT NULL")
    found = chains(by_space.withColumn("name", F.col("member")), exports, re_exports).filter("outcome = 'bound' AND NOT external")
    found = found.select("project_id", "module_id", F.col("name").alias("member"), F.col("symbol_id").alias("m_symbol"), F.col("resolution").alias("m_resolution"))
    member, value, space = F.col("member").isNotNull(), F.col("symbol_id").isNotNull(), F.col("module_id").isNotNull()
    how = F.when(~member & value, "import").when(member & value, "member-root").when(member & F.col("m_symbol").isNotNull(), "namespace-member").when(member & space, "namespace-gap").when(member, "unbound-root")
    done = cut(known.join(found, ["project_id", "module_id", "member"], "left").withColumn("how", how).filter("how IS NOT NULL"), "bound-calls")

    render, root = F.col("sub_kind").eqNullSafe(RENDER), F.col("how") == "member-root"
    via_space = F.col("how") == "namespace-member"
    target = F.when(via_space, F.col("m_symbol")).otherwise(F.col("symbol_id"))
    certainty = F.when(root, "inferred").when(via_space, F.col("m_resolution")).otherwise(F.col("resolution"))
    aims = done.filter("how IN ('import', 'member-root', 'namespace-member')").select("project_id", F.col("id").alias("source_id"), target.alias("target_id"), render.alias("render"), "how", certainty.alias("resolution"))
    sub = F.when(F.col("how") == "member-root", MEMBER_ROOT).when(F.col("render"), RENDERS)
    rule = F.concat(F.when(F.col("render"), "react/renders-").otherwise("react/calls-"), "how")
    edges = aims.select("project_id", "source_id", "target_id", F.lit("calls").alias("kind"), sub.alias("sub_kind"), rule.alias("rule"), "resolution", F.when(F.col("how") == "member-root", "medium").otherwise(confidence(F.col("resolution"))).alias("confidence"))
    props = contained.join(g.nodes.filter(F.col("sub_kind") == PROP).select("project_id", F.col("id").alias("target_id"), F.col("name").alias("arg_name")), ["project_id", "target_id"]).groupBy("project_id", F.col("source_id").alias("aim"), "arg_name").agg(F.max("target_id").alias("prop"))
    given = g.payload.filter("pass_kind = 'named' AND arg_name IS NOT NULL").select("project_id", F.col("id").alias("source_id"), "arg_name")
    passed = aims.filter("render AND how <> 'member-root'").withColumnRenamed("target_id", "aim").join(given, ["project_id", "source_id"]).join(props, ["project_id", "aim", "arg_name"])
    passed = passed.select("project_id", "source_id", F.col("prop").alias("target_id"), F.lit("references").alias("kind"), F.lit(PROP_BINDING).alias("sub_kind"), F.lit("react/binds-prop").alias("rule"), "resolution", confidence(F.col("resolution")).alias("confidence"))

    home = g.nodes.filter("kind = 'symbol'").select("project_id", F.col("id").alias("symbol_id"), F.col("file_id").alias("home"))
    gaps = done.filter("how IN ('member-root', 'namespace-gap', 'unbound-root')").join(home, ["project_id", "symbol_id"], "left")
    place = F.when(F.col("how") == "namespace-gap", F.col("module_id")).otherwise(F.col("home"))
    gaps = gaps.select("project_id", F.when(place.isNull(), "unbound-callee").otherwise("unresolved-member").alias("code"), F.col("file_id").alias("importer_file_id"), F.col("callee").alias("specifier"), place.alias("target_file_id"), F.col("member").alias("name"))
    return edges.unionByName(passed).distinct().select(*EDGE), gaps.distinct().select(*GAP)
