"""Traversals as frontier loops: each level is a join, and what was seen is written to shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.reads import top_rows
from sparkloom.plans.graph import DEPENDENCIES, Graph, cut


#: Rows of a frontier that are broadcast at most; a larger one is shuffled to the edges.
BROADCAST_FRONTIER = 100_000
#: Levels that one job takes from a frontier of up to that size.
LEVELS = 4


def blast_radius(g: Graph, node_id: str, max_depth: int = 32, kinds: tuple[str, ...] = DEPENDENCIES) -> DataFrame:
    """What depends on a node: smallest depth, and whether a path within the cap has proven edges only.

    A row of the frontier is a node and whether it was reached by proven edges alone; each is visited once, so the
    number of rows is at most twice the nodes. Without kinds or depth, and for unknown nodes, the result is empty.
    """
    if "\x1f" in node_id:
        raise ValueError("the id holds a reserved character")
    e = g.dependencies(kinds) if kinds else g.edges.limit(0)
    e = e.select("project_id", F.col("target_id").alias("id"), "source_id", (F.col("resolution") == "deterministic").alias("det"))
    # Edges of projects that don't hold the node are never written.
    e = cut(e.join(e.filter(F.col("id") == node_id).select("project_id").distinct(), "project_id", "left_semi").distinct(), "edges")
    seen = e.filter(F.col("id") == node_id).select("project_id", "id").distinct().withColumns({"proven": F.lit(True), "depth": F.lit(0)})
    seen = cut(seen.unionByName(seen.withColumn("proven", F.lit(False))), "seen")
    frontier, size, depth, state = seen, 0, 0, ["project_id", "id", "proven"]
    while depth < max_depth:
        steps = min(LEVELS if size <= BROADCAST_FRONTIER else 1, max_depth - depth)
        at, found = (F.broadcast(frontier) if size <= BROADCAST_FRONTIER else frontier).select(*state), None
        for k in range(1, steps + 1):
            at = at.join(e, ["project_id", "id"]).filter("NOT proven OR det").select("project_id", F.col("source_id").alias("id"), "proven").distinct().join(seen.select(*state), state, "left_anti")
            level = at.withColumn("depth", F.lit(depth + k))
            found = level if found is None else found.unionByName(level)
        found = cut(found.groupBy(*state).agg(F.min("depth").alias("depth")), "levels")
        depth += steps
        frontier = found.filter(F.col("depth") == depth)
        if not (size := frontier.count()):
            seen = seen.unionByName(found)
            break
        seen = seen.unionByName(found)
    hits = seen.filter(F.col("id") != node_id).groupBy("project_id", "id").agg(F.min("depth").alias("depth"), F.max("proven").alias("proven"))
    return hits.select("project_id", "id", F.col("depth").cast("long").alias("depth"), F.when(F.col("proven"), "deterministic").otherwise("inferred").alias("resolution"))


def blast_radius_page(g: Graph, node_id: str, limit: int | None = None, cursor: tuple | None = None, max_depth: int = 32, kinds: tuple[str, ...] = DEPENDENCIES) -> DataFrame:
    """A page of hits by depth and id, with their nodes' columns (null without a node) and ``truncated``: whether any
    hit, on the page or not, lies at the cap."""
    hits = cut(blast_radius(g, node_id, max_depth, kinds), "hits")
    deepest = hits.agg(F.max("depth")).first()[0]
    shown = top_rows(hits, ["depth", "id"], limit, cursor)
    nodes = g.nodes.select("project_id", "id", F.col("kind").alias("node_kind"), F.coalesce("name", "path").alias("label"))
    return shown.join(nodes, ["project_id", "id"], "left").withColumn("truncated", F.lit(deepest is not None and deepest >= max_depth))


def expansion_probe(g: Graph, node_id: str, max_depth: int = 3, kinds: tuple[str, ...] = DEPENDENCIES, budget: int = 10_000_000) -> DataFrame:
    """By depth: how many simple paths lead from dependents to a node, and how many nodes they start at.

    A path enters no node twice, and parallel edges count as paths of their own; these are kept as one row with a
    count. More than ``budget`` rows raise, as no sum over nodes would tell simple paths from others.
    """
    e = g.dependencies(kinds).groupBy("project_id", F.col("target_id").alias("id"), "source_id").agg(F.count(F.lit(1)).alias("times"))
    e = cut(e, "edges")
    at = e.filter(F.col("id") == node_id).select("project_id", "id").distinct().withColumns({"path": F.array("id"), "n": F.lit(1).cast("long")})
    out, rows = None, 0
    for depth in range(1, max_depth + 1):
        step = at.join(e, ["project_id", "id"]).filter(~F.array_contains("path", F.col("source_id")))
        at = cut(step.select("project_id", F.col("source_id").alias("id"), F.array_append("path", F.col("source_id")).alias("path"), (F.col("n") * F.col("times")).alias("n")), "paths")
        rows += at.count()
        if rows > budget:
            raise ValueError(f"more than {budget} paths lead to {node_id} within {depth} steps")
        row = at.groupBy("project_id").agg(F.lit(depth).cast("long").alias("depth"), F.sum("n").alias("paths"), F.countDistinct("id").alias("nodes"))
        out = row if out is None else out.unionByName(row)
    return out


def breadcrumbs(g: Graph, rounds: int = 64) -> DataFrame:
    """``project_id, id, trail``: the containers of each node from the outermost down to itself, as ``(id, label)``.

    Lists double in each round, so the rounds grow with the logarithm of the depth. Of several containers that with the
    largest edge key holds; one that is no node ends the trail, with its id as label. Nodes whose containers form a
    cycle have no trail.
    """
    parent = g.edges.filter("kind = 'contains'").groupBy("project_id", F.col("target_id").alias("id")).agg(F.max_by("source_id", "edge_key").alias("up"))
    label = F.coalesce("name", "path", "id")
    own = F.array(F.struct(F.col("id"), label.alias("label")))
    at = g.nodes.select("project_id", "id", own.alias("trail")).join(parent, ["project_id", "id"], "left")
    before = None
    for _ in range(rounds):
        at = cut(at, "trail")
        left = at.filter("up IS NOT NULL").count()
        if left in (0, before):  # a round that settles nothing leaves cycles alone
            break
        before = left
        above = at.select("project_id", F.col("id").alias("up"), F.col("trail").alias("_trail"), F.col("up").alias("_up"))
        lost = F.when(F.col("up").isNotNull(), F.array(F.struct(F.col("up").alias("id"), F.col("up").alias("label"))))
        at = at.join(above, ["project_id", "up"], "left").select("project_id", "id", F.concat(F.coalesce("_trail", lost, F.array().cast(at.schema["trail"].dataType)), "trail").alias("trail"), F.col("_up").alias("up"))
    return at.select("project_id", "id", F.when(F.col("up").isNull(), F.col("trail")).alias("trail"))


def drill_level(kind: Column) -> Column:
    """The level of the map below a container, null at the deepest."""
    return F.when(kind == "package", "file").when(kind == "file", "symbol")


def cycle_candidates(g: Graph) -> DataFrame:
    """Dependencies whose source has an incoming and whose target an outgoing dependency."""
    e = g.dependencies()
    has_in = e.select("project_id", F.col("target_id").alias("source_id"))
    has_out = e.select("project_id", F.col("source_id").alias("target_id"))
    return e.join(has_in, ["project_id", "source_id"], "left_semi").join(has_out, ["project_id", "target_id"], "left_semi")


def spread(values: DataFrame, edges: DataFrame, rounds: int = 100_000) -> DataFrame:
    """Least fixpoint of handing the smallest ``v`` on along ``edges(p, a, b)``."""
    for _ in range(rounds):
        new = values
        for _ in range(4):  # a few steps for each job
            new = new.unionByName(new.withColumnRenamed("id", "a").join(edges, ["p", "a"]).select("p", F.col("b").alias("id"), "v")).groupBy("p", "id").agg(F.min("v").alias("v"))
        new = cut(new, "spread")
        if new.join(values.withColumnRenamed("v", "_v"), ["p", "id"]).filter("v < _v").isEmpty():
            return new
        values = new
    raise RuntimeError("no fixpoint")


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``p, id`` of what ``starts(p, id)`` reach along ``edges(p, a, b)``, themselves included."""
    seen = frontier = cut(starts.select("p", "id"), "seen")
    while True:
        at, found = frontier, None
        for _ in range(LEVELS):
            at = at.withColumnRenamed("id", "a").join(edges, ["p", "a"]).select("p", F.col("b").alias("id")).distinct().join(seen, ["p", "id"], "left_anti")
            found = at if found is None else found.unionByName(at)
        frontier = cut(found.distinct(), "reached")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def trimmed(e: DataFrame) -> tuple[DataFrame, int]:
    """``e(p, a, b)`` without what can't lie on a cycle, and its rows."""
    size = -1
    while True:
        for _ in range(2):
            e = e.join(e.select("p", F.col("b").alias("a")), ["p", "a"], "left_semi").join(e.select("p", F.col("a").alias("b")), ["p", "b"], "left_semi").select("p", "a", "b")
        e = cut(e, "trim")
        n = e.count()
        if n in (size, 0):
            return e, n
        size = n


def without(e: DataFrame, nodes: DataFrame) -> DataFrame:
    gone = nodes.select("p", F.col("id").alias("a"))
    return e.join(gone, ["p", "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), ["p", "b"], "left_anti")


def components(g: Graph) -> DataFrame:
    """``project_id, id, component`` of nodes on cycles: strongly connected components, each by its smallest id.

    A project mostly has one large component: what the busiest node reaches and is reached by. With that and the edges
    into and out of it gone, the rest goes by trimming and colouring, all components at once: the smallest id that
    reaches a node is its colour, and what reaches a colour's root inside the colour is a component. No project has to
    fit into one task.
    """
    e = cut(cycle_candidates(g).select(F.col("project_id").alias("p"), F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), "cycle-edges")
    own = e.filter("a = b").select(F.col("p").alias("project_id"), F.col("a").alias("id"), F.col("a").alias("component"))
    found = []
    e, n = trimmed(e.filter("a != b"))
    if n:
        degrees = e.groupBy("p", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("out")).join(e.groupBy("p", F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("in")), ["p", "id"])
        busiest = cut(degrees.groupBy("p").agg(F.max_by("id", F.struct(F.col("in") * F.col("out"), "id")).alias("id")), "pivots")
        ahead, behind = reached(busiest, e), reached(busiest, e.select("p", F.col("b").alias("a"), F.col("a").alias("b")))
        big = cut(ahead.join(behind, ["p", "id"]), "big")
        found.append(big.join(big.groupBy("p").agg(F.min("id").alias("component")), "p").select(F.col("p").alias("project_id"), "id", "component"))
        # No other cycle leaves the part that is ahead, or enters it.
        side = ahead.withColumn("side", F.lit(True))
        rest = without(e, big).join(side.withColumnRenamed("id", "a"), ["p", "a"], "left").withColumnRenamed("side", "sa").join(side.withColumnRenamed("id", "b"), ["p", "b"], "left").filter("sa <=> side").select("p", "a", "b")
        e, n = trimmed(cut(rest, "rest"))
    while n:
        nodes = e.select("p", F.col("a").alias("id")).unionByName(e.select("p", F.col("b").alias("id"))).distinct()
        colour = spread(cut(nodes.withColumn("v", F.col("id")), "colours"), e)
        inside = e.join(colour.select("p", F.col("id").alias("a"), F.col("v").alias("va")), ["p", "a"]).join(colour.select("p", F.col("id").alias("b"), F.col("v").alias("vb")), ["p", "b"]).filter("va = vb")
        back = cut(inside.select("p", F.col("b").alias("a"), F.col("a").alias("b")), "back")
        part = cut(spread(cut(colour.filter("id = v"), "roots"), back), "component")
        found.append(part.select(F.col("p").alias("project_id"), "id", F.col("v").alias("component")))
        e, n = trimmed(cut(without(e, part), "rest"))
    out = own
    for f in found:
        out = out.unionByName(f)
    return cut(out, "components")


def cycles(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """``project_id, cycle_id, size, candidate``: components of two nodes or more, or of one with a self loop."""
    c = components(g) if found is None else found
    real = c.groupBy("project_id", "id").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("k"))
    loops = g.dependencies().filter("source_id = target_id").select("project_id", F.col("source_id").alias("id")).distinct().withColumn("loop", F.lit(True))
    real = real.join(loops, ["project_id", "id"], "left")
    groups = real.groupBy("project_id", "component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("cycle_id"), F.max(F.coalesce("loop", F.lit(False))).alias("loop")).filter("size > 1 OR loop")
    src = real.select("project_id", F.col("id").alias("source_id"), F.col("component").alias("cs"))
    tgt = real.select("project_id", F.col("id").alias("target_id"), F.col("component").alias("ct"))
    inner = g.dependencies().join(src, ["project_id", "source_id"]).join(tgt, ["project_id", "target_id"]).filter("cs = ct").groupBy("project_id", F.col("cs").alias("component")).agg(F.max(F.col("resolution") != "deterministic").alias("candidate"))
    return groups.join(inner, ["project_id", "component"], "left").select("project_id", "cycle_id", "size", F.coalesce("candidate", F.lit(False)).alias("candidate"))


def cycle_list(g: Graph, most: int = 100) -> DataFrame:
    """:func:`cycles` with the ``most`` smallest ids as ``members`` and ``truncated``, in the order of ``cycle_id``."""
    parts = components(g)
    found = parts.groupBy("project_id", "id").agg(F.min("component").alias("component"))
    first = Window.partitionBy("project_id", "component").orderBy("id")
    kept = found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most)
    lists = kept.groupBy("project_id", "component").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("members"), F.min("id").alias("cycle_id")).drop("component")
    return cycles(g, parts).join(lists, ["project_id", "cycle_id"]).withColumn("truncated", F.col("size") > most)


def file_association(g: Graph, rounds: int = 64) -> DataFrame:
    """``project_id, id, file_id``: the owning file along ``contains``, the file itself for files, else null."""
    parent = g.edges.filter("kind = 'contains'").groupBy("project_id", F.col("target_id").alias("id")).agg(F.max(F.struct("edge_key", "source_id"))["source_id"].alias("up"))
    n = g.nodes.select("project_id", "id", (F.col("kind") == "file").alias("is_file"))
    at = n.join(parent, ["project_id", "id"], "left").select("project_id", "id", F.when(F.col("is_file"), F.col("id")).alias("file_id"), F.when(~F.col("is_file"), F.col("up")).alias("up"))
    before = None
    for _ in range(rounds):
        at = cut(at, "owner")
        # Steps double, so a round that settles nothing leaves cycles alone.
        left = at.filter("file_id IS NULL AND up IS NOT NULL").count()
        if left in (0, before):
            break
        before = left
        next_ = at.select("project_id", F.col("id").alias("up"), F.col("file_id").alias("f2"), F.col("up").alias("u2"))
        at = at.join(next_, ["project_id", "up"], "left").select("project_id", "id", F.coalesce("file_id", "f2").alias("file_id"), F.when(F.coalesce("file_id", "f2").isNull(), F.col("u2")).alias("up"))
    return at.select("project_id", "id", "file_id")
