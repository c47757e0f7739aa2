"""Graph operators on literal fixtures, and every query against its SQL."""

from collections import Counter

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.functions import keys
from sparkloom.operators import bind, delta, reads, resolve, rollup, traverse
from sparkloom.plans import queries
from sparkloom.plans.graph import Graph
from sparkloom.sources import tree
from sparkloom.streaming.pushes import jobs_of

SF = "/root/testdata/sf0.001"
NODE = "project_id string, id string, kind string, sub_kind string, name string, path string, file_id string, enclosing_symbol_id string"
EDGE = "project_id string, edge_key string, source_id string, target_id string, kind string, sub_kind string, resolution string, confidence string, provenance_pass string"
TAIL = "project_id string, ref_key string, importer_file_id string, code string, specifier string, target_file_id string, name string"


def graph(spark, nodes, edges, tail=()):
    """nodes: (id, kind, name, file); edges: "a -kind-> b" with an optional " inf"."""
    e = []
    for x in edges:
        a, kind, b = x.removesuffix(" inf").replace("-> ", "-").split(" -", 1)[0], x.split("-")[1], x.split("-> ")[1].removesuffix(" inf")
        inf = x.endswith(" inf")
        e.append(("p", x, a, b, kind, None, "inferred" if inf else "deterministic", "medium" if inf else None, "resolve"))
    return Graph(
        spark.createDataFrame([("p", i, k, None, n, None, f, None) for i, k, n, f in nodes], NODE),
        spark.createDataFrame(e, EDGE),
        spark.createDataFrame([("p", str(i), "f", c, "s", t, n) for i, (c, t, n) in enumerate(tail)], TAIL),
    )


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


BLAST = ["B -calls-> A", "C -calls-> B", "D -calls-> C", "E -calls-> B", "E -calls-> C", "A -calls-> D", "F -contains-> A"]


def test_blast_radius_of_a_cycle(spark):
    g = graph(spark, [(x, "symbol", x, "F") for x in "ABCDE"] + [("F", "file", None, "F")], BLAST)
    assert got(traverse.blast_radius(g, "A"), "id", "depth") == [("B", 1), ("C", 2), ("D", 3), ("E", 2)]
    assert got(traverse.blast_radius(g, "A", max_depth=1), "id") == [("B",)]
    assert traverse.blast_radius(g, "A", kinds=()).count() == traverse.blast_radius(g, "nobody").count() == 0
    with pytest.raises(ValueError):
        traverse.blast_radius(g, "a\x1fb")


def test_proof_is_independent_of_depth(spark):
    g = graph(spark, [], ["D1 -calls-> T", "I1 -references-> T inf", "I2 -calls-> I1", "M -references-> T inf", "M -calls-> D1"])
    assert got(traverse.blast_radius(g, "T"), "id", "depth", "resolution") == [("D1", 1, "deterministic"), ("I1", 1, "inferred"), ("I2", 2, "inferred"), ("M", 1, "deterministic")]


def test_cycles(spark):
    g = graph(spark, [], ["sa -calls-> sb", "sb -calls-> sa", "sc -calls-> sd", "se -calls-> se inf"])
    assert got(traverse.cycle_candidates(g), "source_id") == [("sa",), ("sb",), ("se",)]
    assert got(traverse.cycles(g), "cycle_id", "size", "candidate") == [("sa", 2, False), ("se", 1, True)]


def test_name_collisions_are_top_level_only(spark):
    nodes = [("fA", "file", None, "fA"), ("fB", "file", None, "fB"), ("b1", "symbol", "Button", "fA"), ("h", "symbol", "helper", "fA"), ("b2", "symbol", "Button", "fB"), ("w", "symbol", "widget", "fB"), ("w2", "symbol", "widget", "fA"), ("prop", "symbol", "Button", "fA")]
    g = graph(spark, nodes, ["fA -contains-> b1", "fA -contains-> h", "fB -contains-> b2", "fB -contains-> w", "h -contains-> w2", "b1 -contains-> prop"])
    assert got(rollup.name_collisions(g), "id") == [("b1",), ("b2",)]


def test_unused_symbols(spark):
    names = ["caller", "used", "dead", "exportedDead", "Item", "run", "Base", "Sub"]
    g = graph(spark, [("f", "file", None, "f")] + [(n, "symbol", n, "f") for n in names], [*(f"f -contains-> {n}" for n in names), "caller -calls-> used", "Sub -extends-> Base", "f -exports-> exportedDead"], [("unresolved-member", "f", "Item"), ("unbound-callee", None, "run")])
    out = {r.id: (r.candidate, r.exported) for r in rollup.unused_symbols(g).collect()}
    assert out == {n: (n in ("Item", "run"), n == "exportedDead") for n in ("caller", "dead", "exportedDead", "Item", "run", "Sub")}


def test_pages(spark):
    df = spark.range(7).select(F.format_string("k%d", "id").alias("k"))
    one = reads.page(df, ["k"], 3)
    two = reads.page(df, ["k"], 3, one.next_cursor)
    three = reads.page(df, ["k"], 3, two.next_cursor)
    assert [r.k for p in (one, two, three) for r in p.items] == [f"k{i}" for i in range(7)]
    assert (one.total, two.total, three.next_cursor) == (7, None, None)
    assert [keys.clamp_limit(x) for x in (None, float("nan"), 0, 3.9, 999)] == [50, 50, 1, 3, 200]
    for bad in ("%%", keys.encode_cursor((1,)), keys.encode_cursor(("a", "b"))):
        with pytest.raises(keys.InvalidCursorError):
            keys.decode_cursor(bad, (False,))


def test_export_chains(spark):
    exports = spark.createDataFrame([("lib", "x", "sx"), ("m1", "y", "sy1"), ("m2", "y", "sy2"), ("m1", "z", "sz")], "file_id string, exported_name string, symbol_id string")
    re = spark.createDataFrame([("barrel", "named", "x", "x", "lib"), ("star", "star", None, None, "barrel"), ("wide", "star", None, None, "m1"), ("wide", "star", None, None, "m2"), ("a", "star", None, None, "b"), ("b", "star", None, None, "a")], "file_id string, kind string, exported_as string, name string, target_file string")
    asked = spark.createDataFrame([(1, "barrel", "x"), (2, "star", "x"), (3, "wide", "y"), (4, "wide", "z"), (5, "a", "q")], "request_id int, file_id string, name string")
    out = {r.request_id: (r.outcome, r.symbol_id, r.resolution) for r in resolve.export_chain(asked, exports, re).collect()}
    assert out == {1: ("bound", "sx", "deterministic"), 2: ("bound", "sx", "inferred"), 3: ("ambiguous", None, None), 4: ("bound", "sz", "deterministic"), 5: ("unresolved", None, None)}


HOPS = "file_id string, kind string, exported_as string, name string, target_file string, package string, status string, pos int"


def star(file, *targets):
    """Stars of a file in order: a file, a package ("npm x") or a failure ("!unresolved", "!ambiguous")."""
    return [(file, "star", None, None, None if t[0] == "!" or t.startswith("npm ") else t, t[4:] if t.startswith("npm ") else None, t[1:] if t[0] == "!" else None, i) for i, t in enumerate(targets)]


def named(file, outer, inner, target=None, package=None, status=None):
    return (file, "named", outer, inner, target, package, status, 0)


def test_stars_are_probed_as_a_tree(spark):
    exports = [("A1", "x", "sA1"), ("A2", "x", "sA2"), ("B", "x", "sB"), ("m1", "y", "sy"), ("C", "x", "sC"), ("D", "x", "sD"), ("p", "U", "Up"), ("p", "D", "Dp"), ("q", "D", "Dq"), ("deep", "w", "sw")]
    re = [*star("W", "A", "B"), *star("A", "A1", "A2"), *star("V", "m1", "m2"), named("m2", "y", "y1", "m1"), named("m2", "y", "y2", "m1"), *star("U", "A", "Z"), *star("multi", "p", "q"), *star("mixed", "p", "npm react"), *star("lone", "npm @s/x y"), *star("failed", "!unresolved", "!ambiguous"), *star("bad", "!unresolved"), *star("odd", "!ambiguous")]
    re += [named("n", "P", "Q", package="react"), named("n", "R", "R", status="unresolved"), named("n", "S", "S", status="ambiguous"), *star("n", "p"), *star("two", "npm react", "npm react"), *star("both", "npm react", "npm vue")]
    # C is entered by way of L first, so M provides D's x alone; and of a loop each start sees the rest once.
    re += [*star("T", "L", "M"), *star("L", "C"), *star("M", "C", "D"), *star("r1", "r2", "empty"), *star("r2", "r1", "deep"), *star("one", "inner"), *star("inner", "deep", "empty")]
    want = {("W", "x"): ("bound", "sB", "deterministic"), ("V", "y"): ("bound", "sy", "deterministic"), ("U", "x"): ("unresolved", None, None), ("multi", "U"): ("bound", "Up", "deterministic"), ("multi", "D"): ("ambiguous", None, None), ("multi", "N"): ("unresolved", None, None), ("mixed", "R"): ("external", "npm react R.", "deterministic"), ("mixed", "U"): ("ambiguous", None, None)}
    want |= {("lone", "a b"): ("external", "npm @s/x  y `a b`.", "deterministic"), ("failed", "x"): ("unresolved", None, None), ("bad", "x"): ("unresolved", None, None), ("odd", "x"): ("ambiguous", None, None), ("n", "P"): ("external", "npm react Q.", "deterministic"), ("n", "R"): ("unresolved", None, None), ("n", "S"): ("ambiguous", None, None), ("n", "U"): ("bound", "Up", "inferred"), ("two", "x"): ("external", "npm react x.", "deterministic"), ("both", "x"): ("ambiguous", None, None)}
    want |= {("T", "x"): ("ambiguous", None, None), ("M", "x"): ("ambiguous", None, None), ("r1", "w"): ("bound", "sw", "deterministic"), ("r2", "w"): ("bound", "sw", "deterministic"), ("one", "w"): ("bound", "sw", "inferred"), ("gone", "x"): ("unresolved", None, None)}
    asked = spark.createDataFrame([("|".join(k), *k) for k in want], "request_id string, file_id string, name string")
    out = {tuple(r.request_id.split("|")): (r.outcome, r.symbol_id, r.resolution) for r in resolve.export_chain(asked, spark.createDataFrame(exports, "file_id string, exported_name string, symbol_id string"), spark.createDataFrame(re, HOPS)).collect()}
    assert out == want


def rows_of(monkeypatch):
    """Rows that export chains write, by the name of the write."""
    rows, real = Counter(), resolve.cut

    def counted(df, name):
        out = real(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(resolve, "cut", counted)
    return rows


def test_names_at_a_barrel_reach_only_files_that_export_them(spark, monkeypatch):
    files = [f"f{i}" for i in range(200)]
    exports = spark.createDataFrame([(f, f"n{i}", f"s{i}") for i, f in enumerate(files)] + [("f0", "n1", "t")], "file_id string, exported_name string, symbol_id string")
    asked = spark.createDataFrame([(f"n{i}", "barrel", f"n{i}") for i in range(201)], "request_id string, file_id string, name string")
    rows = rows_of(monkeypatch)
    out = {r.request_id: (r.outcome, r.symbol_id, r.resolution) for r in resolve.export_chain(asked, exports, spark.createDataFrame(star("barrel", *files), HOPS)).collect()}
    assert out == {f"n{i}": ("bound", f"s{i}", "deterministic") for i in range(200)} | {"n1": ("ambiguous", None, None), "n200": ("unresolved", None, None)}
    assert rows["hop"] == 201 + 201  # 201 starts, and 201 exports; each name at each file would be 40,200


def test_names_at_a_top_reach_its_barrels_and_their_providers(spark, monkeypatch):
    files = {f"b{i}": [f"b{i}f{k}" for k in range(30)] for i in range(6)}
    exports = spark.createDataFrame([(f, f"n{b[1:]}-{k}", "s" + f) for b, own in files.items() for k, f in enumerate(own)], "file_id string, exported_name string, symbol_id string")
    stars = [*star("top", *files, "npm out"), *(x for b, own in files.items() for x in star(b, *own, *(["npm out"] if b == "b0" else [])))]
    asked = [f"n{i}-{k}" for i in (1, 2) for k in range(31)]
    rows = rows_of(monkeypatch)
    got = resolve.export_chain(spark.createDataFrame([(n, "top", n) for n in asked], "request_id string, file_id string, name string"), exports, spark.createDataFrame(stars, HOPS))
    assert {r.request_id: r.outcome for r in got.collect()} == {n: "external" if n.endswith("-30") else "ambiguous" for n in asked}
    assert rows["hop"] == 62 * 7 + 60  # starts and barrels, then one file of each name but two


def test_export_chain_of_forty_barrels(spark):
    exports = spark.createDataFrame([("b40", "x", "sx")], "file_id string, exported_name string, symbol_id string")
    re = spark.createDataFrame([(f"b{i}", "named", "x", "x", f"b{i + 1}") for i in range(40)], "file_id string, kind string, exported_as string, name string, target_file string")
    asked = spark.createDataFrame([(1, "b0", "x"), (2, "b0", "y")], "request_id int, file_id string, name string")
    out = {r.request_id: (r.outcome, r.symbol_id, r.resolution) for r in resolve.export_chain(asked, exports, re).collect()}
    assert out == {1: ("bound", "sx", "deterministic"), 2: ("unresolved", None, None)}


def test_bindings_of_imports_and_calls(spark):
    state = [("s1", "a", "./m", "internal", "m"), ("s2", "a", "./n", "internal", "n"), ("s3", "a", "./gone", "unresolved", None), ("s4", "a", "./m2", "ambiguous", None), ("s5", "a", "x", "external", None)]
    statements = spark.createDataFrame([("p", *r) for r in state], "project_id string, statement_id string, file_id string, specifier string, status string, module_id string")
    names = [("s1", "F", "G", "named", False), ("s1", "lost", "lost", "named", False), ("s1", "ext", "ext", "named", False), ("s2", "*", "NS", "namespace", False), ("s2", "T", "T", "named", True)]
    bindings = spark.createDataFrame([("p", *r) for r in names], "project_id string, statement_id string, name string, local_name string, kind string, type_only boolean")
    exports = spark.createDataFrame([("p", "m", "F", "F"), ("p", "n", "k", "K"), ("q", "m", "lost", "other")], "project_id string, file_id string, exported_name string, symbol_id string")
    re = spark.createDataFrame([("p", "m", "named", "ext", "e", None, "pkg")], "project_id string, file_id string, kind string, exported_as string, name string, target_file string, package string")
    bound = bind.bind_imports(statements, bindings, exports, re)
    assert got(bound.edges, "source_id", "target_id", "rule", "resolution") == [("a", "F", "resolve/import", "deterministic"), ("a", "n", "resolve/import-module", "deterministic"), ("a", "npm pkg e.", "resolve/import-external", "deterministic")]
    assert {tuple(r) for r in bound.gaps.select("code", "specifier", "target_file_id", "name").collect()} == {("unresolved-module", "./gone", None, None), ("ambiguous-module", "./m2", None, None), ("unresolved-export", "./m", "m", "lost")}
    callees = [("c1", "G", "react:element"), ("c2", "G.run", None), ("c3", "NS.k", None), ("c4", "NS.none", None), ("c5", "h.go", None), ("c6", "G.", None), ("c7", "who", None), ("c8", "", None), ("c9", "G", None), ("c10", "ext.x", None)]
    nodes = [("a", "file", None, None, "a", None, None), ("top", "symbol", None, "top", "a", None, None), ("F", "symbol", None, "F", "m", None, None), ("P", "symbol", "react:prop", "size", "m", None, None), ("inner", "symbol", None, "inner", "a", None, None)]
    nodes += [(i, "callSite", s, None, "a", "inner" if i == "c9" else "top", c) for i, c, s in callees]
    g = Graph(
        spark.createDataFrame([("p", *n) for n in nodes], "project_id string, id string, kind string, sub_kind string, name string, file_id string, enclosing_symbol_id string, callee string"),
        graph(spark, [], ["a -contains-> top", "top -contains-> inner", "F -contains-> P"]).edges,
        graph(spark, [], []).tail,
        spark.createDataFrame([("p", "c1", 0, "size", "named"), ("p", "c1", 1, "more", "named"), ("p", "c1", 2, "size", "spread")], "project_id string, id string, pos int, arg_name string, pass_kind string"),
    )
    edges, gaps = bind.bind_calls(g, bound, exports, re)
    assert got(edges, "source_id", "target_id", "rule", "resolution") == [("c1", "F", "react/renders-import", "deterministic"), ("c1", "P", "react/binds-prop", "deterministic"), ("c10", "npm pkg e.", "react/calls-member-root", "inferred"), ("c2", "F", "react/calls-member-root", "inferred"), ("c3", "K", "react/calls-namespace-member", "deterministic")]
    assert {tuple(r) for r in gaps.select("code", "specifier", "target_file_id", "name").collect()} == {("unresolved-member", "G.run", "m", "run"), ("unresolved-member", "NS.none", "n", "none"), ("unbound-callee", "h.go", None, "go"), ("unbound-callee", "ext.x", None, "x")}


@pytest.fixture(scope="module")
def by_barrel(spark):
    """What a file binds by way of a barrel of 150 files, each with a name of its own, and the rows of hops it took."""
    files, at_b = [f"f{i}" for i in range(150)], "project_id string, file_id string, "
    exports = spark.createDataFrame([("p", f, f"n{i}", f"s{i}") for i, f in enumerate(files)] + [("p", "f0", "n1", "t")], at_b + "exported_name string, symbol_id string")
    re = spark.createDataFrame([("p", *x[:6]) for x in star("b", *files)], "project_id string, file_id string, kind string, exported_as string, name string, target_file string, package string")
    statements = spark.createDataFrame([("p", "s1", "a", "./b", "internal", "b"), ("p", "s2", "a", "./b", "internal", "b")], "project_id string, statement_id string, file_id string, specifier string, status string, module_id string")
    names = [("p", "s1", n, n, "named", False) for n in [*(f"n{i}" for i in range(40)), "lost"]] + [("p", "s2", "*", "NS", "namespace", False)]
    bindings = spark.createDataFrame(names, "project_id string, statement_id string, name string, local_name string, kind string, type_only boolean")
    nodes = [("a", "file", "a", None, None), ("top", "symbol", "a", None, None), *((f"s{i}", "symbol", f"f{i}", None, None) for i in range(150)), *((f"c{i}", "callSite", "a", "top", c) for i, c in enumerate(("NS.n5", "NS.n1", "NS.lost", "n3", "n4.run")))]
    g = Graph(
        spark.createDataFrame([("p", i, k, None, i, f, e, c) for i, k, f, e, c in nodes], "project_id string, id string, kind string, sub_kind string, name string, file_id string, enclosing_symbol_id string, callee string"),
        graph(spark, [], ["a -contains-> top"]).edges,
        graph(spark, [], []).tail,
        spark.createDataFrame([], "project_id string, id string, pos int, arg_name string, pass_kind string"),
    )
    with pytest.MonkeyPatch.context() as patch:
        rows = rows_of(patch)
        bound = bind.bind_imports(statements, bindings, exports, re)
        first = rows["hop"]
        edges, gaps = bind.bind_calls(g, bound, exports, re)
    return bound, edges, gaps, first, rows["hop"] - first


def test_call_site_gaps_by_barrel(by_barrel):
    _, _, gaps, _, calls = by_barrel
    assert got(gaps, "code", "specifier", "target_file_id", "name") == [("unresolved-member", "NS.lost", "b", "lost"), ("unresolved-member", "NS.n1", "b", "n1"), ("unresolved-member", "n4.run", "f4", "run")]
    assert calls == 3 + 3  # members asked, and exports of these names; not 150 files each


def test_import_binding_by_barrel(by_barrel):
    bound, _, _, imports, _ = by_barrel
    assert got(bound.edges, "source_id", "target_id", "rule", "resolution") == sorted([*(("a", f"s{i}", "resolve/import", "deterministic") for i in range(40) if i != 1), ("a", "b", "resolve/import-module", "deterministic")])
    assert imports == 41 + 41


def test_call_site_binding_by_barrel(by_barrel):
    _, edges, _, _, calls = by_barrel
    assert got(edges, "source_id", "target_id", "rule") == [("c0", "s5", "react/calls-namespace-member"), ("c3", "s3", "react/calls-import"), ("c4", "s4", "react/calls-member-root")]
    assert calls == 3 + 3


def test_import_gaps_by_barrel(by_barrel):
    bound, _, _, imports, _ = by_barrel
    assert got(bound.gaps, "code", "specifier", "target_file_id", "name") == [("ambiguous-export", "./b", "b", "n1"), ("unresolved-export", "./b", "b", "lost")]
    assert imports == 41 + 41


def test_delta(spark):
    h = lambda *r: spark.createDataFrame([("p", *x) for x in r], "project_id string, path string, content_hash string")
    assert delta.unchanged(h(("a", "1")), h(("a", "1")))
    assert not delta.unchanged(h(("a", "1")), h(("a", "2")))
    cache = spark.createDataFrame([("k1", "old")], "cache_key string, fragment string")
    assert got(delta.cache_put(cache, spark.createDataFrame([("k1", "new"), ("k2", "x")], cache.schema)), "cache_key", "fragment") == [("k1", "old"), ("k2", "x")]


def test_tree(spark, tmp_path):
    for name, text in {"src/a.ts": "import {b} from './b';\nexport * from \"./c\";\n", "node_modules/x.ts": "", "src/b.md": ""}.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    files = tree.discover(spark, str(tmp_path / "t"))
    assert [r.path for r in files.collect()] == ["src/a.ts"]
    assert got(tree.imports_of(files), "specifier") == [("./b",), ("./c",)]


def test_imports_without_names_and_in_comments(spark):
    text = "import './side';\n/* import x from 'no'; */\n// import y from 'no'\nimport type {T} from \"./t\";\nexport const a = 'from';\n"
    files = spark.createDataFrame([("a.ts", text)], "path string, text string")
    assert got(tree.imports_of(files), "specifier") == [("./side",), ("./t",)]


def test_file_association_of_contains_cycles(spark):
    chain = [f"c{i} -contains-> c{i + 1}" for i in range(20)]
    nodes = [("f", "file", None, "f"), *((f"c{i}", "symbol", "c", "f") for i in range(21)), ("x", "symbol", "x", None), ("y", "symbol", "y", None), ("lone", "symbol", "l", None)]
    g = graph(spark, nodes, ["f -contains-> c0", *chain, "x -contains-> y", "y -contains-> x"])
    assert {r.id: r.file_id for r in traverse.file_association(g).collect()} == {"f": "f", **{f"c{i}": "f" for i in range(21)}, "x": None, "y": None, "lone": None}


def test_pages_of_hits_cycles_and_maps(spark):
    g = graph(spark, [(x, "symbol", x.lower(), "F") for x in "ABCD"], BLAST[:6])
    page = traverse.blast_radius_page(g, "A", 2, None, 2)
    assert got(page, "id", "depth", "node_kind", "truncated") == [("B", 1, "symbol", True), ("C", 2, "symbol", True)]
    assert got(traverse.blast_radius_page(g, "A", 9, (1, "B")), "id", "node_kind", "truncated") == [("C", "symbol", False), ("D", "symbol", False), ("E", None, False)]
    assert got(traverse.cycle_list(g, 3), "cycle_id", "size", "members", "truncated") == [("A", 4, "A B C", True)]
    assert got(traverse.expansion_probe(g, "A", 2), "depth", "paths", "nodes") == [(1, 1, 1), (2, 2, 2)]
    p = graph(spark, [("p1", "package", "p1", None), ("p2", "package", "p2", None), ("p3", "package", "p3", None)], [])
    nodes, edges, truncated = rollup.map_view(p, "package", limit=2)
    assert (got(nodes, "id"), edges.count(), truncated) == ([("p1",), ("p2",)], 0, True)


def test_jobs_change_state(spark):
    schema = "id long, dedupe_key string, status string, attempts int, available_at timestamp, lease_until timestamp"
    from datetime import datetime as at

    t = [at(2024, 1, d) for d in range(1, 9)]
    jobs = spark.createDataFrame([(1, "a", "ready", 0, t[0], None), (2, "b", "ready", 0, t[7], None), (3, "c", "processing", 1, t[1], t[2]), (4, "d", "processing", 5, t[1], t[7]), (5, None, "ready", 0, t[2], None)], schema)
    now = F.lit(t[4])
    won = delta.claim(jobs, now, 2)
    assert won.columns == jobs.columns
    assert got(won, "id", "status", "attempts") == [(1, "processing", 1), (2, "ready", 0), (3, "processing", 2), (4, "processing", 5), (5, "ready", 0)]
    outcomes = spark.createDataFrame([(1, True), (3, False), (4, False), (2, True), (1, False)], "id long, ok boolean")
    after = delta.settle(won, outcomes, now)
    assert got(after, "id", "status") == [(1, "done"), (2, "ready"), (3, "ready"), (4, "dead"), (5, "ready")]
    assert after.filter("id = 3").first().available_at == at(2024, 1, 5, 0, 0, 2)
    more = spark.createDataFrame([(10 + i, None, "ready", 0, t[0], None) for i in range(3)] + [(20, "b", "ready", 0, t[0], None), (22, "z", "ready", 0, t[0], None), (21, "z", "ready", 0, t[0], None)], schema)
    assert got(delta.enqueue(jobs, more), "id") == [(10,), (11,), (12,), (21,)]


def test_pushes_as_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "p", "refs/heads/main", "main", False, "a" * 40), ("2024-01-01 00:01:00", "p", "refs/heads/main", "main", False, "a" * 40), ("2024-01-01 00:00:00", "p", "refs/heads/x", "main", False, "b" * 40), ("2024-01-01 00:00:00", "p", "refs/heads/main", "main", True, "0" * 40)]
    df = spark.createDataFrame(rows, "ts string, project_id string, ref string, default_branch string, deleted boolean, sha string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs_of(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("pushed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got(spark.table("pushed"), "dedupe_key") == got(jobs_of(df), "dedupe_key") == [("p:" + "a" * 40,)]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_against_sql(spark, name):
    assert not differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connect(SF))


@pytest.mark.parametrize("name", ["map_symbol_edges", "search_wildcard_literal", "graph_invariants", "job_dedupe", "export_chain", "export_probe", "store_replace", "workspace_supersede", "alias_longest_prefix", "job_two_workers", "cycle_list", "resolve_project", "package_synthesis", "declared_signatures", "detail_uses", "binding_rows", "blast_rows"])
def test_query_has_rows(spark, name):
    assert not queries.queries()[name](spark, SF).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
