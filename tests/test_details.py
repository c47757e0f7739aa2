"""Symbol ids, doc comments, ignore rules, fragments, trails, simple paths and guarded links on odd fixtures."""

import json

import pytest
from pyspark.sql import functions as F
from test_graph import got, graph

from sparkloom.functions import comments, symbols
from sparkloom.operators import delta, rollup, traverse
from sparkloom.plans.graph import Graph
from sparkloom.sources import ignore, tree


def ids(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "id string")


GOOD = [
    (None, None, [("src", "namespace", None), ("a.ts", "namespace", None), ("f", "method", "+1"), ("x", "parameter", None)]),
    (None, None, [("C", "type", None), ("T", "type-parameter", None), ("m", "macro", None), ("k", "meta", None), ("v", "local", "3"), ("w", "local", None), ("g", "method", None)]),
    ("npm", "@s/p q", [("a `b` c", "term", None), ("``", "term", None), ("é", "type", None)]),
    ("npm", "react", [("$x_+-9", "term", None)]),
    (None, None, [("a  b c`", "parameter", None), ("(", "type-parameter", None)]),
]


def test_symbol_ids_round_trip(spark):
    df = spark.createDataFrame([(r,) for r in GOOD], f"s {symbols.SYMBOL}")
    back = df.select("s", symbols.format_symbol(F.col("s")).alias("id")).withColumn("parsed", symbols.parse_symbol(F.col("id")))
    rows = back.withColumn("external", symbols.is_external(F.col("id"))).collect()
    for r in rows:
        assert r.parsed == r.s
        assert r.external == (r.s.manager is not None)
    assert rows[0].id == "src/`a.ts`/f(+1).(x)" and rows[2].id == "npm @s/p  q `a ``b`` c`.``````.`é`#"
    assert rows[1].id == "C#[T]m!k:v~3~w~~g()."


def test_malformed_symbol_ids(spark):
    bad = ["", "a", "a.b", "`a.", "``.", "(a", "[a.", "a b.", "npm a b c.", "npm  a b.", "n`p x y.", "f(", "f(x)", "v~", "a;", " a.", "npm a ", " x y.", "a.(b)c"]
    assert got(ids(spark, *bad).filter(symbols.parse_symbol(F.col("id")).isNotNull()), "id") == []
    assert not ids(spark, *bad).filter(symbols.is_external(F.col("id"))).count()
    assert spark.createDataFrame([(None,)], "id string").select(symbols.parse_symbol(F.col("id")).alias("s"), symbols.is_external(F.col("id")).alias("x")).first() == (None, False)
    broken = [("npm", None, [("a", "term", None)]), (None, None, []), (None, None, [("", "term", None)]), (None, None, [("a", "what", None)]), ("n`", "p", [("a", "term", None)])]
    df = spark.createDataFrame([(r,) for r in broken], f"s {symbols.SYMBOL}")
    assert df.filter(symbols.format_symbol(F.col("s")).isNotNull()).count() == 0


def test_metrics_count_packages_by_their_ids(spark):
    g = graph(spark, [("a", "file", None, "a")], ["a -imports-> npm react useState.", "a -imports-> gone", "a -imports-> b inf", "a -imports-> npm x"])
    m = rollup.import_metrics(g).first()
    assert (m.deterministic, m.inferred, m.external) == (2, 1, 1)


def test_doc_comments(spark):
    cases = {
        "/** One line. */": ("One line.", []),
        "/**\n * Free {@link A.b|text} and {@link C d} {@link E}\n *\n *   kept margin\n * @param x the\n *    wrapped   line\n *\n * @returns {@link T}\n * @deprecated\n */": ("Free A.b and C E\n\n  kept margin", [("param", "x the wrapped   line"), ("returns", "T"), ("deprecated", "")]),
        "/* plain */": ("plain", []),
        "/** */": None,
        "": None,
        " /**\r\n * a \r\n * @b\tc\r\n */\n": ("a", [("b", "c")]),
        "@x": ("", [("x", "")]),
        "no fence\n* @t one\n * two": ("no fence", [("t", "one two")]),
        "/** a@b @not a tag */": ("a@b @not a tag", []),
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "raw string").withColumn("doc", comments.parse_doc(F.col("raw")))
    out = {r.raw: None if r.doc is None else (r.doc.description, [tuple(t) for t in r.doc.tags]) for r in df.collect()}
    assert out == cases | {None: None}


def verdicts(spark, sources, *paths):
    s = spark.createDataFrame([("p", d, t) for d, t in sources.items()], "project_id string, dir string, text string")
    f = spark.createDataFrame([("p", p, i) for i, p in enumerate(paths)] + [("q", p, 0) for p in paths], "project_id string, path string, dir int")
    out = ignore.with_ignored(f, s)
    assert out.columns == ["project_id", "path", "dir", "ignored"] and not out.filter("project_id = 'q' AND ignored").count()
    return {r.path for r in out.filter("project_id = 'p' AND ignored").collect()}


def test_ignore_files_nest(spark):
    assert verdicts(spark, {}, "src/a.ts") == set()
    assert verdicts(spark, {"": "dist/\n*.log\n"}, "dist/bundle.js", "logs/app.log", "src/index.ts", "x/dist/y.js", "dist") == {"dist/bundle.js", "logs/app.log", "x/dist/y.js"}
    assert verdicts(spark, {"packages/web": "generated/\n"}, "packages/web/generated/x.ts", "packages/api/generated/x.ts", "generated/x.ts") == {"packages/web/generated/x.ts"}
    assert verdicts(spark, {"packages/a": "local.ts\n", "packages/b": "other.ts\n"}, "packages/a/local.ts", "packages/a/other.ts", "packages/b/other.ts", "packages/b/local.ts") == {"packages/a/local.ts", "packages/b/other.ts"}
    assert verdicts(spark, {"": "*.snap\n", "packages/ui": "!button.snap\n"}, "packages/ui/button.snap", "packages/ui/modal.snap", "other/x.snap") == {"packages/ui/modal.snap", "other/x.snap"}


def test_patterns_of_ignore_files(spark):
    cases = {
        "/top.ts": ({"top.ts", "TOP.ts"}, {"a/top.ts"}),
        "a/b": ({"a/b", "a/b/c.ts"}, {"x/a/b"}),
        "**/b/*.ts": ({"b/x.ts", "a/c/b/x.ts"}, {"b/c/x.ts"}),
        "a/**/z": ({"a/z", "a/b/z", "a/b/c/z/q"}, {"z", "b/a/z"}),
        "a/**": ({"a/x", "a/b/c"}, {"a", "b/a/x"}),
        "f?o": ({"foo", "d/fXo"}, {"fo", "f/o"}),
        "[ab]x[!0-9]": ({"axc", "q/bxz"}, {"cxc", "ax1"}),
        "[z-a]": (set(), {"z", "a", "-"}),
        r"\#h": ({"#h"}, {"h"}),
        r"\!n": ({"!n"}, {"n"}),
        "# c": (set(), {"# c", "c"}),
        "sp  ": ({"sp"}, {"sp  "}),
        r"end\ ": ({"end "}, {"end"}),
        "d/*": ({"d/x", "d/x/y"}, {"d"}),
        "a.c+(1)|$^{}&~": ({"a.c+(1)|$^{}&~"}, {"abc"}),
        "d/\n!d/keep": ({"d/x", "d/keep"}, set()),
        "d/*\n!d/keep\n": ({"d/x"}, {"d/keep"}),
        "*\n!*.ts\n!src/": ({"src2/a.ts", "b"}, {"src/a.ts", "c.ts"}),
        "\n\n  \n/\n!\n": (set(), {"a"}),
        "*.log\r\nx\r": ({"a.log", "x"}, {"a.logs"}),
        "unclosed[": ({"unclosed["}, {"unclosed"}),
    }
    s = spark.createDataFrame([(str(i), "", t) for i, t in enumerate(cases)], "project_id string, dir string, text string")
    f = spark.createDataFrame([(str(i), p) for i, (yes, no) in enumerate(cases.values()) for p in yes | no], "project_id string, path string")
    out = {(r.project_id, r.path) for r in ignore.with_ignored(f, s).filter("ignored").collect()}
    assert out == {(str(i), p) for i, (yes, _) in enumerate(cases.values()) for p in yes}


def test_discovery_honours_ignore_files_and_skips_links(spark, tmp_path):
    for name, text in {".gitignore": "*.gen.ts\n", "src/.gitignore": "!keep.gen.ts\n", "src/keep.gen.ts": "1", "src/drop.gen.ts": "2", "b.ts": "3", "a.ts": "4"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "_app.tsx").write_text("5")
    (tmp_path / "link.ts").symlink_to(tmp_path / "a.ts")
    (tmp_path / "loop").symlink_to(tmp_path)
    assert [(r.path, r.text) for r in tree.discover(spark, str(tmp_path)).collect()] == [("_app.tsx", "5"), ("a.ts", "4"), ("b.ts", "3"), ("src/keep.gen.ts", "1")]
    assert tree.discover(spark, f"file://{tmp_path}/", gitignore=False).count() == 5
    assert [r.path for r in tree.discover(spark, str(tmp_path), suffixes=("b.ts",)).collect()] == ["b.ts"]


def test_discovery_of_many_trees_and_its_bounds(spark, tmp_path, monkeypatch):
    for t in "xy":
        (tmp_path / t / "build").mkdir(parents=True)
        (tmp_path / t / "build" / "no.ts").write_text("0" * 99)
        (tmp_path / t / f"{t}.ts").write_text("12345")
        (tmp_path / t / "z.js").write_text("1234")
    roots = spark.createDataFrame([(t, str(tmp_path / t)) for t in "xy"], "project_id string, root string")
    assert got(tree.discover_trees(roots), "project_id", "path", "bytes") == [("x", "x.ts", 5), ("x", "z.js", 4), ("y", "y.ts", 5), ("y", "z.js", 4)]
    monkeypatch.setattr(tree, "FILE_BYTES", 4)
    with pytest.raises(ValueError, match="a file of 5 or a tree of 9"):
        tree.discover_trees(roots)
    monkeypatch.setattr(tree, "FILE_BYTES", 5)
    monkeypatch.setattr(tree, "TREE_BYTES", 8)
    with pytest.raises(ValueError, match="a tree of 9"):
        tree.discover_trees(roots)
    assert tree.discover_trees(roots.limit(0)).count() == 0


def test_corrupt_fragments_are_misses(spark):
    good = {"version": "v1", "path": "a", "symbols": ["s"]}
    texts = {"ok": json.dumps(good), "more": json.dumps(good | {"new": 1}), "cut": json.dumps(good)[:20], "old": json.dumps(good | {"version": "v0"}), "less": json.dumps({"version": "v1", "path": "a"}), "kind": json.dumps(good | {"symbols": {"a": 1}}), "list": "[]", "null": "null", "text": "x", "empty": "", "none": None}
    cache = spark.createDataFrame([("v1:" + k, t) for k, t in texts.items()], "cache_key string, fragment string")
    files = spark.createDataFrame([("p", k, k) for k in [*texts, "absent", "ok"]], "project_id string, path string, content_hash string")
    out = delta.cache_get(files, cache, "v1", "version string, path string, symbols array<string>", ("path", "symbols"))
    assert got(out.filter("value IS NOT NULL"), "path") == [("more",), ("ok",), ("ok",)]
    assert out.count() == 13 and out.filter("path = 'ok'").first().value.asDict() == good


def test_breadcrumbs(spark):
    chain = [f"c{i} -contains-> c{i + 1}" for i in range(12)]
    nodes = [("f", "file", None, "f"), *((f"c{i}", "symbol", f"n{i}", "f") for i in range(13)), ("x", "symbol", "x", None), ("y", "symbol", "y", None), ("z", "symbol", "z", None), ("lone", "symbol", None, None), ("orphan", "symbol", "o", None)]
    g = graph(spark, nodes, ["f -contains-> c0", *chain, "x -contains-> y", "y -contains-> x", "y -contains-> z", "nowhere -contains-> orphan", "lone -calls-> f"])
    out = {r.id: None if r.trail is None else [tuple(t) for t in r.trail] for r in traverse.breadcrumbs(g).collect()}
    assert out["c12"] == [("f", "f"), *((f"c{i}", f"n{i}") for i in range(13))] and out["c0"] == [("f", "f"), ("c0", "n0")]
    assert out["x"] is out["y"] is out["z"] is None
    assert out["lone"] == [("lone", "lone")] and out["orphan"] == [("nowhere", "nowhere"), ("orphan", "o")]


def test_simple_paths_of_a_cycle(spark):
    g = graph(spark, [], ["B -calls-> A", "B -references-> A", "C -calls-> B", "A -calls-> C", "C -calls-> A", "D -calls-> D", "D -calls-> C"])
    assert got(traverse.expansion_probe(g, "A", 9), "depth", "paths", "nodes") == [(1, 3, 2), (2, 3, 2), (3, 2, 1)]
    with pytest.raises(ValueError):
        traverse.expansion_probe(g, "A", 9, budget=3)


def test_links_keep_their_owner(spark):
    stored = spark.createDataFrame([(1, "ann", "d0", "d0"), (9, "ann", "d0", "d0")], "id long, owner string, created_at string, updated_at string")
    asks = spark.createDataFrame([(1, 1, "bob", "d1"), (2, 1, "ann", "d2"), (3, 2, "bob", "d3"), (4, 2, "ann", "d4"), (5, 2, "bob", "d5")], "seq long, id long, owner string, at string")
    table, outcomes = delta.link_guarded(stored, asks)
    assert got(outcomes, "seq", "outcome") == [(1, "owner-mismatch"), (2, "linked"), (3, "linked"), (4, "owner-mismatch"), (5, "linked")]
    assert got(table, "id", "owner", "created_at", "updated_at") == [(1, "ann", "d0", "d2"), (2, "bob", "d3", "d5"), (9, "ann", "d0", "d0")]
    assert got(delta.link_guarded(stored, asks.limit(0))[0], "id") == [(1,), (9,)]


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert traverse.breadcrumbs(g).count() == 0 and isinstance(g, Graph)
