"""Configuration tables, workspace externals, package nodes and the driver on small fixtures."""

import json

from pyspark.sql import functions as F
from test_graph import got, graph

from sparkloom.functions import keys
from sparkloom.operators import bind, workspace
from sparkloom.plans import binding, testgraph
from sparkloom.plans.graph import Graph


def files_of(spark, *paths):
    return spark.createDataFrame([("p", x, "file:" + x) for x in paths], "project_id string, path string, id string")


def test_path_rules(spark):
    config = {"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["gone/*", "*"], "@/lib/*": ["../lib/*"], "@app": ["app"], "#*.x": ["x/*"]}}}
    rules = workspace.alias_rules(spark.createDataFrame([("p", "web", json.dumps(config))], "project_id string, dir string, config string"))
    assert got(rules, "rank", "pattern", "target")[:3] == [(0, "@/*", "web/src/*"), (0, "@/*", "web/src/gone/*"), (1, "@/lib/*", "web/lib/*")]
    files = files_of(spark, "web/src/a.ts", "web/src/app/index.ts", "web/lib/b.ts", "web/src/lib/b.ts", "web/src/x/n.tsx")
    asked = spark.createDataFrame([("p", x) for x in ("@/a", "@/lib/b", "@app", "@app/z", "#n.x", "@/none", "@/a")], "project_id string, specifier string")
    assert got(workspace.resolve_paths(asked, rules, files).na.fill("-"), "specifier", "module_id") == [("#n.x", "file:web/src/x/n.tsx"), ("@/a", "file:web/src/a.ts"), ("@/a", "file:web/src/a.ts"), ("@/lib/b", "file:web/lib/b.ts"), ("@/none", "-"), ("@app", "file:web/src/app/index.ts"), ("@app/z", "-")]


def test_members_and_entries(spark):
    made = {"packages/a": {"name": "a", "module": "./dist/main.js", "exports": {".": "./dist/main.js", "./ui/button": {"import": "./dist/ui/button.js"}, "./all/*": "./dist/all/*.js", "./css": "./dist/a.css", "./gone": "./dist/gone.js"}}, "packages/a/deep": {"name": "deep"}, "packages/old": {"name": "old"}, "tools/x/y": {"name": "y"}, "packages/z": {"version": "1"}, "": {"name": "root"}}
    manifests = spark.createDataFrame([("p", d, json.dumps(m)) for d, m in made.items()], "project_id string, dir string, manifest string")
    globs = spark.createDataFrame([("p", x) for x in ("packages/*/", "!packages/old", "tools/**")], "project_id string, glob string")
    inside = workspace.members(manifests, globs)
    assert got(inside, "name") == [("a",), ("y",)]
    entries = workspace.workspace_entries(inside, files_of(spark, "packages/a/src/main.ts", "packages/a/src/ui/button/index.tsx", "tools/x/y/index.ts", "tools/x/y/src/index.tsx"))
    assert got(entries, "name", "subpath", "module_id") == [("a", "", "file:packages/a/src/main.ts"), ("a", "ui/button", "file:packages/a/src/ui/button/index.tsx"), ("y", "", "file:tools/x/y/src/index.tsx")]


def test_globs_of_workspaces(spark):
    texts = {
        "block": {"pnpm-workspace.yaml": "# all\npackages:  # here\n  - 'packages/*'\n\n  # more\n  - \"apps/**\" # deep\n- !tools/x\n  - plain/dir  \ncatalog:\n  - other\n", "package.json": '{"workspaces": ["no"]}'},
        "flow": {"pnpm-workspace.yaml": "x: 1\npackages: ['a/*', \"b\",\n  c/d]\ny: [z]\n"},
        "none": {"pnpm-workspace.yaml": "catalog:\n  - other\n", "package.json": '{"workspaces": ["no"]}'},
        "list": {"package.json": '{"workspaces": ["p/*", "!p/x"]}'},
        "object": {"package.json": '{"workspaces": {"packages": ["q/*"], "nohoist": ["r"]}}'},
        "single": {"package.json": '{"name": "one"}'},
        "broken": {"package.json": "{"},
    }
    configs = spark.createDataFrame([(k, p, t) for k, files in texts.items() for p, t in files.items()], "project_id string, path string, text string")
    out = {}
    for r in workspace.workspace_globs(configs).collect():
        out.setdefault(r.project_id, set()).add(r.glob)
    assert out == {"block": {"packages/*", "apps/**", "!tools/x", "plain/dir"}, "flow": {"a/*", "b", "c/d"}, "list": {"p/*", "!p/x"}, "object": {"q/*"}}
    tree = [("list", "package.json", '{"workspaces": ["p/*", "!p/x"]}'), ("list", "p/a/package.json", '{"name": "a"}'), ("list", "p/x/package.json", '{"name": "x"}'), ("list", "p/b/package.json", "{}"), ("flow", "p/a/package.json", '{"name": "b"}')]
    assert got(workspace.workspace_packages(spark.createDataFrame(tree, configs.schema)), "project_id", "dir", "name") == [("list", "p/a", "a")]


def test_modules_of_a_tree(spark):
    texts = {"src/a.ts": "import './b.js'\nimport {c} from '../lib'\nimport x from '@/b'\nimport y from '@s/p'\nimport z from 'p/sub/x'\nimport '../../../../lib/index'\nimport './b.js'", "src/b.ts": "export * from './none'", "lib/index.tsx": ""}
    files = spark.createDataFrame([("p", k, "file:" + k, t) for k, t in texts.items()], "project_id string, path string, id string, text string")
    rules = spark.createDataFrame([("p", 0, "@/*", 0, "src/*"), ("q", 0, "@/*", 0, "lib/*")], "project_id string, rank int, pattern string, pos int, target string")
    out = workspace.resolve_modules(workspace.module_requests(files), rules, files)
    assert got(out.na.fill("-"), "file_id", "specifier", "status", "module_id", "package", "subpath") == [
        ("file:src/a.ts", "../../../../lib/index", "internal", "file:lib/index.tsx", "-", "-"),
        ("file:src/a.ts", "../lib", "internal", "file:lib/index.tsx", "-", "-"),
        ("file:src/a.ts", "./b.js", "internal", "file:src/b.ts", "-", "-"),
        ("file:src/a.ts", "@/b", "internal", "file:src/b.ts", "-", "-"),
        ("file:src/a.ts", "@s/p", "external", "-", "@s/p", ""),
        ("file:src/a.ts", "p/sub/x", "external", "-", "p", "sub/x"),
        ("file:src/b.ts", "./none", "unresolved", "-", "-", "-"),
    ]


def test_ids_of_external_symbols(spark):
    df = spark.createDataFrame([("a b", "x$1"), ("@s/p", "a`b c"), ("k", "default")], "package string, name string")
    assert got(df.select(keys.external_symbol(F.col("package"), F.col("name")).alias("id")), "id") == [("npm @s/p `a``b c`.",), ("npm a  b x$1.",), ("npm k default.",)]


def test_a_project_resolves_its_workspace(spark):
    entries = spark.createDataFrame([("p", "lib", "", "m"), ("p", "lib", "sub", "s"), ("q", "lib", "", "other")], "project_id string, name string, subpath string, module_id string")
    exports = spark.createDataFrame([("p", "m", "F", "symF"), ("p", "s", "F", "symF2"), ("p", "s", "G", "symG")], "project_id string, file_id string, exported_name string, symbol_id string")
    re = spark.createDataFrame([("p", "m", "star", None, None, "s", None)], "project_id string, file_id string, kind string, exported_as string, name string, target_file string, package string")
    names = [("p", 2, "lib", "", "F", "named"), ("p", 1, "lib", "sub", "F", "named"), ("p", 3, "lib", "", "G", "named"), ("p", 4, "lib", "", "lost", "named"), ("p", 5, "lib", "", "*", "namespace"), ("q", 6, "lib", "", "F", "named"), ("p", 7, "react", "", "F", "named")]
    records = spark.createDataFrame(names, "project_id string, rank int, package string, subpath string, name string, kind string")
    symbols = workspace.workspace_symbols(records, entries, exports, re)
    assert got(symbols, "project_id", "target_id", "symbol_id", "certainty") == [("p", "npm lib F.", "symF2", "deterministic"), ("p", "npm lib G.", "symG", "inferred")]
    statements = spark.createDataFrame([("p", "s1", "a", "./m", "internal", "m"), ("p", "s2", "a", "./no", "unresolved", None)], "project_id string, statement_id string, file_id string, specifier string, status string, module_id string")
    bindings = spark.createDataFrame([("p", "s1", "F", "F", "named", False)], "project_id string, statement_id string, name string, local_name string, kind string, type_only boolean")
    nodes = [("a", "file", None, "a", None, None), ("top", "symbol", "top", "a", None, None), ("c1", "callSite", None, "a", "top", "F")]
    parsed = graph(spark, [], ["a -contains-> top", "a -imports-> npm lib G.", "a -imports-> npm lib lost.", "a -imports-> npm lib lost."])
    g = Graph(spark.createDataFrame([("p", i, k, None, n, f, e, c) for i, k, n, f, e, c in nodes], "project_id string, id string, kind string, sub_kind string, name string, file_id string, enclosing_symbol_id string, callee string"), parsed.edges, parsed.tail, spark.createDataFrame([], "project_id string, id string, pos int, arg_name string, pass_kind string"))
    done = workspace.in_order(workspace.resolve_project(g, statements, bindings, exports, re, symbols))
    assert [(r.source_id, r.kind, r.target_id, r.resolution, r.confidence, r.provenance_rule) for r in done.edges.collect()] == [("a", "contains", "top", "deterministic", None, None), ("a", "imports", "npm lib lost.", "deterministic", None, None), ("a", "imports", "symF", "deterministic", None, "resolve/import"), ("a", "imports", "symG", "inferred", "high", "resolve/workspace"), ("c1", "calls", "symF", "deterministic", None, "react/calls-import")]
    assert [(r.code, r.specifier) for r in done.tail.collect()] == [("unresolved-module", "./no")]


def test_a_project_binds_its_imports_once(spark, monkeypatch):
    runs, real = [], bind.bind_imports
    for module in (bind, workspace):
        monkeypatch.setattr(module, "bind_imports", lambda *asked: runs.append(1) or real(*asked))
    assert set(binding.resolved(testgraph.load(spark, "/root/testdata/sf0.001")).columns) == {*bind.EDGE}
    assert len(runs) == 1


def test_package_nodes(spark):
    g = graph(spark, [], [])
    files = files_of(spark, "packages/a/x.ts", "packages/a/in/y.ts", "packages/ab/z.ts").withColumn("kind", F.lit("file"))
    packages = spark.createDataFrame([("p", "a", "packages/a"), ("p", "in", "packages/a/in"), ("p", "none", "other")], "project_id string, name string, dir string")
    made = workspace.with_packages(Graph(files, g.edges, g.tail), packages)
    assert got(made.nodes.filter("kind = 'package'"), "id") == [("a",), ("in",)]
    assert got(made.edges, "source_id", "target_id") == [("a", "file:packages/a/x.ts"), ("in", "file:packages/a/in/y.ts")]
