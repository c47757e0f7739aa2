"""Workspaces and whole projects: configuration files as tables, imports across packages, package nodes, one driver.

Configuration comes as rows of JSON text, one a file, so a run over many projects reads them as it reads sources. All
joins carry ``project_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.keys import external_symbol, key_of, normalise_path, package_name, specifier_kind
from sparkloom.operators.bind import Bound, bind_calls, bind_imports, chains, confidence
from sparkloom.operators.resolve import candidates, package_owner, probe_modules, relative_targets
from sparkloom.plans.graph import NODE_KINDS, Graph
from sparkloom.sources.tree import imports_of

#: Entries of a package, conditions of its exports in the order of preference, suffixes of built files.
ENTRIES = ("src/index.ts", "src/index.tsx", "index.ts", "index.tsx")
CONDITIONS = ("import", "default", "types")
BUILT = r"\.(d\.ts|tsx?|jsx?|mjs|cjs|mts|cts)$"
#: Names of the rules.
SUPERSEDED, CONTAINS_FILE = "resolve/workspace", "workspace/contains-file"


def alias_rules(configs: DataFrame) -> DataFrame:
    """Path rules of ``configs(project_id, dir, config)``: ``project_id, rank, pattern, pos, target``.

    Targets count from the root of the project, by way of ``baseUrl``; a project has one configuration.
    """
    options = F.from_json("config", "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")["compilerOptions"]
    base = F.concat_ws("/", "dir", F.coalesce(options["baseUrl"], F.lit(".")))
    rules = configs.select("project_id", base.alias("base"), F.posexplode(options["paths"]).alias("rank", "pattern", "targets"))
    rules = rules.select("project_id", "base", "rank", "pattern", F.posexplode("targets").alias("pos", "target"))
    return rules.select("project_id", "rank", "pattern", "pos", normalise_path(F.concat_ws("/", "base", "target")).alias("target"))


def resolve_paths(requests: DataFrame, rules: DataFrame, files: DataFrame) -> DataFrame:
    """``requests(project_id, specifier, ...)`` with ``module_id``: the first file that the best rule's targets name.

    The rule with the longest text before its ``*`` is best, the first among equals; a rule without ``*`` must be the
    whole specifier. Its targets are tried in order, each by the order of :func:`candidates`.
    """
    key, star = ["project_id", "specifier"], F.instr("pattern", "*")
    head = rules.select("project_id", "rank", F.when(star > 0, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern")).alias("head"), F.when(star > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")).alias("tail")).distinct()
    spec, enough = F.col("specifier"), F.length("specifier") >= F.length("head") + F.length("tail")
    fits = F.when(F.col("tail").isNull(), spec == F.col("head")).otherwise(F.startswith(spec, F.col("head")) & F.endswith(spec, F.col("tail")) & enough)
    best = requests.select(*key).distinct().join(head, "project_id").filter(fits).groupBy(*key).agg(F.max(F.struct(F.length("head").alias("n"), (-F.col("rank")).alias("order"), F.length("tail").alias("cut"))).alias("m"))
    middle = F.expr("coalesce(substring(specifier, m.n + 1, length(specifier) - m.n - m.cut), '')")
    best = best.select(*key, (-F.col("m.order")).alias("rank"), middle.alias("middle"))
    path = F.when(F.instr("target", "*") > 0, F.concat(F.substring_index("target", "*", 1), F.col("middle"), F.expr("substring(target, instr(target, '*') + 1)"))).otherwise(F.col("target"))
    tried = best.join(rules.select("project_id", "rank", "pos", "target"), ["project_id", "rank"]).select(*key, "pos", path.alias("path"))
    tried = tried.select(*key, "pos", F.posexplode(candidates("path")).alias("k", "path"))
    hit = tried.join(files.select("project_id", "path", F.col("id").alias("module_id")), ["project_id", "path"]).groupBy(*key).agg(F.min_by("module_id", F.struct("pos", "k")).alias("module_id"))
    return requests.join(hit, key, "left")


def module_requests(files: DataFrame) -> DataFrame:
    """The imports of ``files(project_id, path, id, text)``: ``project_id, file_id, importer_path, specifier``, once each."""
    found = imports_of(files, "project_id", F.col("id").alias("file_id"))
    return found.distinct()


def resolve_modules(requests: DataFrame, rules: DataFrame, files: DataFrame) -> DataFrame:
    """``requests(project_id, importer_path, specifier, ...)`` with ``status, module_id, package, subpath``.

    Relative specifiers and those of path rules are ``internal`` where a candidate exists among ``files(project_id,
    path, id)``, else ``unresolved``; all others name a package and are ``external``. Each distinct target is probed
    once, whatever the number of its importers.
    """
    key = ["project_id", "importer_path", "specifier"]
    asked = requests.select(*key).distinct().withColumn("_kind", specifier_kind(F.col("specifier")))
    near = probe_modules(relative_targets(asked.filter("_kind = 'relative'")), files).select(*key, "module_id")
    ruled = resolve_paths(asked.filter("_kind = 'alias'"), rules, files).select(*key, "module_id")
    name = package_name(F.col("specifier"))
    away = asked.filter("_kind = 'bare'").select(*key, F.lit(None).cast("string").alias("module_id"), name.alias("package"), F.regexp_replace(F.substring(F.col("specifier"), F.length(name) + 1, F.length("specifier")), "^/", "").alias("subpath"))
    ends = near.unionByName(ruled).unionByName(away, allowMissingColumns=True)
    status = F.when(F.col("package").isNotNull(), "external").when(F.col("module_id").isNotNull(), "internal").otherwise("unresolved")
    return requests.join(ends.withColumn("status", status), key)


def workspace_globs(configs: DataFrame) -> DataFrame:
    """``project_id, glob`` of the projects' roots, from ``configs(project_id, path, text)``.

    The list ``packages`` of ``pnpm-workspace.yaml`` holds where that file exists, in block or flow style; else the
    field ``workspaces`` of ``package.json``, a list or an object with ``packages``. What isn't a string is left out.
    """
    item = r"""(?m)(?:^\s*-\s+|[\[,]\s*)(?:"([^"\n]*)"|'([^'\n]*)'|([^\s"'#,\[\]][^#,\]\n]*))"""
    yaml = configs.filter("path = 'pnpm-workspace.yaml'").select("project_id", F.regexp_extract("text", r"(?ms)^packages:[ \t]*(?:#[^\n]*)?(\[.*?\]|(?:\n[ \t]*-[^\n]*|\n[ \t]*(?:#[^\n]*)?(?=\n|\z))*)", 1).alias("list"))
    texts = F.arrays_zip(*(F.regexp_extract_all("list", F.lit(item), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)))
    listed = yaml.select("project_id", F.explode(texts).alias("t")).select("project_id", F.rtrim(F.concat("t.g1", "t.g2", "t.g3")).alias("glob")).filter("glob <> ''")
    plain = configs.filter("path = 'package.json'").join(yaml.select("project_id"), "project_id", "left_anti")
    field = lambda p: F.get_json_object("text", p)
    chosen = F.when(F.startswith(F.ltrim(field("$.workspaces")), F.lit("[")), field("$.workspaces")).otherwise(field("$.workspaces.packages"))
    values = plain.select("project_id", F.explode(F.from_json(chosen, "array<string>")).alias("glob")).filter("glob IS NOT NULL")
    return listed.unionByName(values)


def workspace_packages(configs: DataFrame) -> DataFrame:
    """``project_id, dir, name, manifest`` of a workspace's named packages, from its configuration files."""
    manifests = configs.filter("path = 'package.json' OR path LIKE '%/package.json'").select("project_id", F.regexp_replace("path", "/?package\\.json$", "").alias("dir"), F.col("text").alias("manifest"))
    return members(manifests, workspace_globs(configs))


def glob_pattern(glob: Column) -> Column:
    """The pattern of a workspace glob: ``*`` is one segment, ``**`` any text; a slash at the end doesn't count."""
    quoted = F.regexp_replace(F.regexp_replace(glob, "/+$", ""), r"([\\^$+?.()|\[\]{}])", r"\\$1")
    for old, new in (("**", "\x00"), ("*", "[^/]+"), ("\x00", ".*")):
        quoted = F.replace(quoted, F.lit(old), F.lit(new))
    return F.concat(F.lit("^"), quoted, F.lit("$"))


def members(manifests: DataFrame, globs: DataFrame) -> DataFrame:
    """The ``manifests(project_id, dir, manifest)`` with a ``name`` whose folder a glob takes in and none shuts out."""
    name = F.get_json_object("manifest", "$.name")
    named = manifests.filter("dir <> ''").withColumn("name", name).filter("name IS NOT NULL")
    out = F.startswith("glob", F.lit("!"))
    rules = globs.select("project_id", out.alias("out"), glob_pattern(F.when(out, F.expr("substring(glob, 2)")).otherwise(F.col("glob"))).alias("pattern"))
    met = named.select("project_id", "dir").join(rules, "project_id").filter(F.regexp(F.col("dir"), F.col("pattern"))).groupBy("project_id", "dir").agg(F.max("out").alias("out"))
    return named.join(met.filter("NOT out").select("project_id", "dir"), ["project_id", "dir"], "left_semi")


def source_of(built: Column) -> Column:
    """The source path that a built path stands for, its suffix apart."""
    return F.regexp_replace(F.regexp_replace(built, r"^\./", ""), "^((?:.*?/)?)dist/", "$1src/")


def workspace_entries(packages: DataFrame, files: DataFrame) -> DataFrame:
    """``project_id, name, subpath, module_id`` of ``packages(project_id, dir, name, manifest)``; the root is ``''``.

    The first existing source of a package's candidates holds. Subpaths with wildcards, and targets without a source
    among ``files(project_id, path, id)``, give no row.
    """
    field = lambda k: F.get_json_object("manifest", f"$.{k}")
    main = lambda k: F.regexp_replace(F.regexp_replace(F.regexp_replace(source_of(field(k)), r"\.d\.ts$", ".ts"), r"\.jsx$", ".tsx"), r"\.js$", ".ts")
    roots = packages.select("project_id", "name", "dir", F.lit("").alias("subpath"), F.posexplode(F.array(*map(F.lit, ENTRIES), *map(main, ("module", "main", "types")))).alias("pos", "path"))
    subs = packages.select("project_id", "name", "dir", F.explode(F.from_json(field("exports"), "map<string, string>")).alias("key", "value")).filter("key <> '.' AND NOT contains(key, '*')")
    plain = lambda c: F.when(~F.ltrim(c).startswith("{"), c)
    target = F.coalesce(plain(F.col("value")), *(plain(F.get_json_object("value", f"$.{c}")) for c in CONDITIONS))
    stem = F.regexp_replace(source_of(F.col("target")), BUILT, "")
    subs = subs.withColumn("target", target).filter(F.col("target").rlike(BUILT)).select("project_id", "name", "dir", F.regexp_replace("key", r"^\./", "").alias("subpath"), F.posexplode(F.array(*(F.concat(stem, F.lit(x)) for x in (".ts", ".tsx", "/index.ts", "/index.tsx")))).alias("pos", "path"))
    tried = roots.unionByName(subs).withColumn("path", F.concat("dir", F.lit("/"), "path"))
    return tried.join(files.select("project_id", "path", "id"), ["project_id", "path"]).groupBy("project_id", "name", "subpath").agg(F.min_by("id", "pos").alias("module_id"))


def workspace_symbols(records: DataFrame, entries: DataFrame, exports: DataFrame, re_exports: DataFrame) -> DataFrame:
    """What external names of workspace packages stand for: ``project_id, target_id, symbol_id, certainty``.

    ``records(project_id, rank, package, subpath, name, kind)`` are the imported names; each follows the exports of its
    entry. Of several records of one external name the first that ends at a symbol holds; the others stay external.
    """
    asked = records.filter("kind <> 'namespace'").join(entries.withColumnRenamed("name", "package"), ["project_id", "package", "subpath"])
    found = chains(asked, exports, re_exports).filter("outcome = 'bound' AND NOT external")
    ends = asked.join(found, ["project_id", "module_id", "name"]).select("project_id", external_symbol(F.col("package"), F.col("name")).alias("target_id"), F.struct("rank", "symbol_id", "resolution").alias("m"))
    return ends.groupBy("project_id", "target_id").agg(F.min("m").alias("m")).select("project_id", "target_id", "m.symbol_id", F.col("m.resolution").alias("certainty"))


def supersede_workspace(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``edges`` whose targets are among ``symbols`` point at the symbol, with its certainty and the resolver's mark."""
    hit = F.col("symbol_id").isNotNull()
    new = {"target_id": F.col("symbol_id"), "resolution": F.col("certainty"), "confidence": confidence(F.col("certainty")), "provenance_pass": F.lit("resolve"), "provenance_rule": F.lit(SUPERSEDED)}
    joined = edges.join(symbols, ["project_id", "target_id"], "left")
    return joined.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in edges.columns))


def edge_key() -> Column:
    return key_of(*(F.col(c) for c in ("source_id", "kind", "target_id", "sub_kind", "resolution")))


def resolve_project(g: Graph, statements: DataFrame, bindings: DataFrame, exports: DataFrame, re_exports: DataFrame, symbols: DataFrame | None = None, bound: Bound | None = None) -> Graph:
    """The parsed graph with all imports and call-sites bound, workspace externals superseded, and the gaps as tail.

    ``symbols`` come from :func:`workspace_symbols`, ``bound`` from :func:`bind_imports` of the same tables, if it ran
    already. Rows that are equal in every column count once.
    """
    bound = bound or bind_imports(statements, bindings, exports, re_exports)
    edges, gaps = bind_calls(g, bound, exports, re_exports)
    made = bound.edges.unionByName(edges).withColumn("provenance_pass", F.lit("resolve")).withColumnRenamed("rule", "provenance_rule")
    every = g.edges.drop("edge_key").unionByName(made, allowMissingColumns=True)
    every = every if symbols is None else supersede_workspace(every, symbols)
    lost = bound.gaps.unionByName(gaps).withColumn("ref_key", key_of(*(F.col(c) for c in ("importer_file_id", "code", "specifier", "name"))))
    return Graph(g.nodes.distinct(), every.distinct().withColumn("edge_key", edge_key()), g.tail.unionByName(lost, allowMissingColumns=True).distinct(), g.payload)


def with_packages(g: Graph, packages: DataFrame) -> Graph:
    """The graph with a node for each of ``packages(project_id, name, dir)`` that holds a file, and edges to its files.

    A file belongs to the deepest folder above it; files outside all of them stay as they are.
    """
    files = g.nodes.filter("kind = 'file'").select("project_id", "id", "path")
    owned = package_owner(files, packages.withColumn("package_id", F.col("name"))).filter("package_id IS NOT NULL")
    nodes = owned.select("project_id", F.col("package_id").alias("id"), F.lit("package").alias("kind"), F.col("package_id").alias("name")).distinct()
    edges = owned.select("project_id", F.col("package_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("kind"), F.lit(None).cast("string").alias("sub_kind"), F.lit("deterministic").alias("resolution"), F.lit("resolve").alias("provenance_pass"), F.lit(CONTAINS_FILE).alias("provenance_rule")).withColumn("edge_key", edge_key())
    return Graph(g.nodes.unionByName(nodes, allowMissingColumns=True), g.edges.unionByName(edges, allowMissingColumns=True), g.tail, g.payload)


def in_order(g: Graph) -> Graph:
    """The graph's tables in the order in which a document lists them; absent values come first. For sinks only."""
    rank = F.array_position(F.array(*map(F.lit, NODE_KINDS)), F.col("kind"))
    message = ["message"] if "message" in g.tail.columns else []
    return Graph(
        g.nodes.orderBy("project_id", "id", rank),
        g.edges.orderBy("project_id", "source_id", "kind", "target_id", "sub_kind", "resolution"),
        g.tail.orderBy("project_id", "importer_file_id", "code", "specifier", "target_file_id", "name", *message),
        g.payload,
    )
