"""Cross-file resolution as joins: module probing, export chains and package owners."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.functions.keys import certainty_rank, dirname, external_id, external_symbol, normalise_path
from sparkloom.plans.graph import cut

#: Extensions in the order of probing, and source extensions for those of built files.
EXTENSIONS = (".ts", ".tsx", ".d.ts", ".js", ".jsx")
REMAP = {".js": (".ts", ".tsx"), ".mjs": (".mts",), ".cjs": (".cts",)}


def relative_targets(imports: DataFrame) -> DataFrame:
    """``imports(importer_path, specifier)`` with ``target``: the path that a relative specifier names."""
    return imports.withColumn("target", normalise_path(F.concat_ws("/", dirname(F.col("importer_path")), "specifier")))


def candidates(target) -> F.Column:
    """Paths to probe for a module, first to last."""
    remapped = [F.when(F.col(target).endswith(old), F.array(*(F.concat(F.regexp_replace(F.col(target), f"\\{old}$", ""), F.lit(x)) for x in new))).otherwise(F.array().cast("array<string>")) for old, new in REMAP.items()]
    plain = F.array(F.col(target), *(F.concat(F.col(target), F.lit(x)) for x in EXTENSIONS), *(F.concat(F.col(target), F.lit("/index" + x)) for x in EXTENSIONS))
    return F.concat(*remapped, plain)


def probe_modules(requests: DataFrame, files: DataFrame) -> DataFrame:
    """``requests(project_id, target, ...)`` with the first candidate among ``files(project_id, path, id)``, or null."""
    key = ["project_id", "target"]
    tried = requests.select(*key).distinct().select(*key, F.posexplode(candidates("target")).alias("pos", "path"))
    hit = tried.join(files.select("project_id", "path", F.col("id").alias("module_id")), ["project_id", "path"]).groupBy(*key).agg(F.min_by("module_id", "pos").alias("module_id"))
    return requests.join(hit, key, "left")


def combine_certainty(resolution_a, confidence_a, resolution_b, confidence_b) -> F.Column:
    """Proven only if both are; else the lower confidence."""
    low = F.least(certainty_rank(resolution_a, confidence_a), certainty_rank(resolution_b, confidence_b))
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("deterministic")), low)


def with_status(re_exports: DataFrame) -> DataFrame:
    """``re_exports`` with ``package``, ``pos`` and ``status``, which says how its module resolved.

    A target file is ``internal`` and a package ``external``; without either, a given status ``ambiguous`` holds, and
    everything else is ``unresolved``.
    """
    none = F.lit(None)
    given = {c: F.col(c) if c in re_exports.columns else none.cast(t) for c, t in (("package", "string"), ("pos", "int"), ("status", "string"))}
    status = F.when(F.col("target_file").isNotNull(), "internal").when(given["package"].isNotNull(), "external").when(given["status"] == "ambiguous", "ambiguous").otherwise("unresolved")
    return re_exports.withColumns(given | {"status": status})


def hop_tables(exports: DataFrame, re_exports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``known``: what each ``(file_id, name)`` exports by itself; ``ways``: how many stars a file has, and the first;
    ``branches``: the stars of files with several that can provide anything, ``wide`` if for any name."""
    hops = with_status(re_exports)
    aim = F.struct("pos", "target_file", "package", "status").alias("aim")
    none = F.lit(None)
    named = hops.filter("kind = 'named'").select("file_id", F.col("exported_as").alias("name"), F.struct(aim, F.col("name").alias("inner")).alias("to"))
    local = exports.select("file_id", F.col("exported_name").alias("name"), none.cast(named.schema["to"].dataType).alias("to"), "symbol_id")
    known = cut(local.unionByName(named, allowMissingColumns=True).groupBy("file_id", "name").agg(F.min("symbol_id").alias("symbol_id"), F.count("to").alias("n_named"), F.min("to").alias("to")), "known")
    stars = hops.filter("kind = 'star'").select("file_id", aim)
    ways = cut(stars.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_stars"), F.min("aim").alias("star")), "ways")
    inner = ways.select(F.col("file_id").alias("target_file"), F.lit(True).alias("wide"))
    open_ended = stars.filter("aim.status IN ('internal', 'external')").join(ways.filter("n_stars > 1"), "file_id", "left_semi")
    wide = F.coalesce(F.col("wide"), F.col("aim.status") == "external").alias("wide")
    return known, ways, cut(open_ended.withColumn("target_file", F.col("aim.target_file")).join(inner, "target_file", "left").select("file_id", "target_file", "aim", wide), "branches")


def export_hop(requests: DataFrame, known: DataFrame, ways: DataFrame) -> DataFrame:
    """One hop for ``requests(file_id, name)``: ``outcome, symbol_id, next_file, next_name, certain``.

    A local export is proven; else one named re-export redirects, several are ambiguous; else one star redirects as
    inferred, several are ``multi-star``; else the name is unresolved. Redirects to a package end ``external``, those to
    modules that failed end as these did; see :func:`with_status` and :func:`hop_tables`.
    """
    q = requests.join(known, ["file_id", "name"], "left").join(ways, "file_id", "left")
    by_name, one_star = F.col("n_named") == 1, F.col("n_stars") == 1
    aim = F.when(by_name, F.col("to.aim")).when(one_star, F.col("star"))
    inner = F.when(by_name, F.col("to.inner")).otherwise(F.col("name"))
    redirect = F.when(aim["status"] == "internal", "redirect").otherwise(aim["status"])
    outcome = F.when(F.col("symbol_id").isNotNull(), "bound").when(by_name, redirect).when(F.col("n_named") > 1, "ambiguous").when(one_star, redirect).when(F.col("n_stars") > 1, "multi-star").otherwise("unresolved")
    away = (outcome == "external") & F.col("symbol_id").isNull()
    made = {"outcome": outcome, "next_file": aim["target_file"], "next_name": inner, "certain": F.coalesce(by_name, F.lit(False)) | F.col("symbol_id").isNotNull(), "symbol_id": F.when(away, external_symbol(aim["package"], inner)).otherwise(F.col("symbol_id"))}
    return q.withColumns(made).drop("n_named", "to", "n_stars", "star")


def live_stars(hops: DataFrame, known: DataFrame, branches: DataFrame) -> DataFrame:
    """The stars that can provide the name of each multi-star ``hops(request_id, file_id, name, det)``, as ``star``.

    A file that has no star and nothing by that name is a dead end whenever it is entered, so it is never a row: names
    meet what files export, not all files of a barrel.
    """
    many = hops.filter("outcome = 'multi-star'").select("request_id", "file_id", "name", "det")
    here = branches.join(many.select("file_id").distinct(), "file_id", "left_semi")
    any_name = many.join(here.filter("wide").select("file_id", F.col("aim").alias("star")), "file_id")
    held = known.join(many.select("name").distinct(), "name", "left_semi").select(F.col("file_id").alias("target_file"), "name")
    by_name = many.join(here.filter("NOT wide").join(held, "target_file").select("file_id", "name", F.col("aim").alias("star")), ["file_id", "name"])
    return any_name.unionByName(by_name)


def probe_stars(rows: list[dict]) -> tuple[str, str | None, bool]:
    """Outcome, symbol and proof of a request from the hops that it can reach; the first row is its start.

    ``stars`` of a row are the live ones, in order; see :func:`live_stars`. Stars are tried in order, depth first. A branch that is ambiguous or unresolved inside provides nothing, and a
    ``(file, name)`` that was entered before is a dead end wherever it comes up again. One distinct provider binds with
    the proof of its own branch, the last one's of equal providers.
    """
    hops, entered = {(r["file_id"], r["name"]): r for r in rows}, set()

    def enter(file_id: str, name: str, proven: bool) -> tuple[str, str | None, bool]:
        while (file_id, name) not in entered:
            entered.add((file_id, name))
            hop = hops[file_id, name]
            proven = proven and (hop["certain"] or hop["outcome"] == "multi-star")
            if hop["outcome"] == "multi-star":
                return probe(hop["stars"] or [], name, proven)
            if hop["outcome"] != "redirect":
                return hop["outcome"], hop["symbol_id"], proven
            file_id, name = hop["next_file"], hop["next_name"]
        return "unresolved", None, False

    def probe(stars: list[dict], name: str, proven: bool) -> tuple[str, str | None, bool]:
        found = {}
        for star in stars:
            if star["status"] == "internal":
                end = enter(star["target_file"], name, proven)
            else:
                end = (star["status"], star["package"] and external_id(star["package"], name), True)
            if end[0] in ("bound", "external"):
                found[end[:2]] = end
        return next(iter(found.values())) if len(found) == 1 else ("ambiguous" if found else "unresolved", None, False)

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 4 * len(rows) + 1_000))
    try:
        return enter(rows[0]["file_id"], rows[0]["name"], True)
    finally:
        sys.setrecursionlimit(limit)


def export_chain(requests: DataFrame, exports: DataFrame, re_exports: DataFrame) -> DataFrame:
    """Follow re-exports for ``requests(request_id, file_id, name)``: ``request_id, outcome, symbol_id, resolution``.

    All requests take a hop a round, each ``(file, name)`` once a request, so cycles end unresolved. Requests that meet
    several stars get their whole search as rows, which :func:`probe_stars` judges: what a branch provides depends on
    what was entered before it, so a depth-first search in order is the meaning, and no set of ends would do. An
    ``external`` outcome carries the external symbol and is proven, whatever led there.
    """
    key = ["request_id", "file_id", "name"]
    known, ways, branches = hop_tables(exports, re_exports)
    at = requests.select(*key, F.lit(True).alias("det"), F.lit(0).alias("round"))
    seen, hops, stars = cut(at.select(*key), "seen"), None, None
    for n in itertools.count(1):
        hop = cut(export_hop(at, known, ways), "hop")
        live = cut(live_stars(hop, known, branches), "stars")
        hops, stars = (hop, live) if hops is None else (hops.unionByName(hop), stars.unionByName(live))
        one = hop.filter("outcome = 'redirect'").select("request_id", F.col("next_file").alias("file_id"), F.col("next_name").alias("name"), (F.col("det") & F.col("certain")).alias("det"))
        many = live.filter("star.status = 'internal'").select("request_id", F.col("star.target_file").alias("file_id"), "name", "det")
        at = cut(one.unionByName(many).dropDuplicates(key).join(seen, key, "left_anti").withColumn("round", F.lit(n)), "at")
        if at.isEmpty():
            break
        seen = seen.unionByName(at.select(*key))
        if n % 16 == 0:  # keeps the plans of long chains short
            seen, hops, stars = cut(seen, "seen"), cut(hops, "hops"), cut(stars, "stars")
    branched = stars.select("request_id").distinct()
    ends = hops.join(branched, "request_id", "left_anti").filter("outcome IN ('bound', 'external', 'ambiguous')").select("request_id", "outcome", "symbol_id", (F.col("det") & F.col("certain")).alias("det"))

    def judge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for table in tables for i in range(0, table.num_rows, 256) for row in table.slice(i, 256).to_pylist())
        judged = ((k, *probe_stars(list(own))) for k, own in itertools.groupby(rows, key=lambda r: r["request_id"]))
        while some := list(itertools.islice(judged, 4_096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], ["request_id", "outcome", "symbol_id", "det"])

    kind = requests.schema["request_id"].dataType
    types = [to_arrow_type(kind), pa.string(), pa.string(), pa.bool_()]
    searched = hops.join(branched, "request_id", "left_semi").join(stars.groupBy(*key).agg(F.sort_array(F.collect_list("star")).alias("stars")), key, "left").select(*key, "round", "outcome", "symbol_id", "certain", "next_file", "next_name", "stars")
    ends = ends.unionByName(searched.repartition("request_id").sortWithinPartitions("request_id", "round").mapInArrow(judge, f"request_id {kind.simpleString()}, outcome string, symbol_id string, det boolean"))
    out = requests.select("request_id").join(ends, "request_id", "left")
    outcome, found = F.coalesce("outcome", F.lit("unresolved")), F.col("outcome").isin("bound", "external")
    resolution = F.when(F.col("outcome") == "external", "deterministic").when(found, F.when(F.col("det"), "deterministic").otherwise("inferred"))
    return out.select("request_id", outcome.alias("outcome"), F.when(found, F.col("symbol_id")).alias("symbol_id"), resolution.alias("resolution"))


def package_owner(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``files(project_id, id, path)`` with the package whose ``dir`` is the deepest above, by equality of prefixes."""
    parts = F.split(F.col("path"), "/")
    above = files.select("project_id", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))).alias("a")).select("project_id", "id", "a.depth", "a.dir")
    hit = above.join(packages.select("project_id", "dir", "package_id"), ["project_id", "dir"]).groupBy("project_id", "id").agg(F.max_by("package_id", "depth").alias("package_id"))
    return files.join(hit, ["project_id", "id"], "left")
