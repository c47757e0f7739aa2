"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Vectors are scaled by the largest norm and lifted by one coordinate to unit length, so that the largest inner product is
the smallest distance; queries are scaled to unit length. A table hashes a vector to the cells of ``k`` Gaussian
projections cut at ``WIDTH`` times the vectors' spread about their mean, so that vectors that lie close together fill
many cells too. A query visits its own cell and perturbed ones, over all tables in the order of
their estimated success (the squared distances to the crossed boundaries). The candidates of all visited cells are
ranked by their exact inner products on the original vectors, in double precision.

The number of projections grows with the logarithm of the table, so that cells get finer as it grows, and visits grow
until they reach ``RECALL``: a bounded sample of queries is solved by brute force, and the fewest visits are taken with
which the sample's recall does. Where that takes more than ``VISITS``, there is a projection less, so that the rows of
all visits grow no faster than the queries; with one projection visits go on until they do. Cells with more than ``CHUNK``
vectors or visiting queries are dealt over several groups, of vectors and of queries. Each group keeps its best rows by
query alone, and a task those of its groups. Queries whose visits found fewer than ``top`` rows, though there are more,
are searched again exactly, ``BLOCK`` of them at a time against all vectors.

Groups compare by matrix products, whose last digits depend on their shapes; whatever these leave possible is scored
anew, products added from first to last on numbers scaled by powers of two. So the score is a function of the two
vectors alone, and equal scores are ties, which go to the smaller id. Scores beyond the range of doubles are infinite.

Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part; neither do
vectors of another length than most. Rows that repeat an id and its vector count once. Of rows with equal vectors the
``top + 1`` smallest ids are kept, since no other can be among the ``top``. Rows that repeat an id with another vector
are candidates each, of which the best counts; repeated queries are answered once. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut

#: Tables, cell width, cells that a projection makes in effect, vectors a cell should hold, and bounds of
#: the measurement and of groups.
TABLES, WIDTH, SPREAD, OCCUPANCY, SAMPLE, RECALL, VISITS, CHUNK, BLOCK, HELD, LEAST_SPREAD = 12, 2.0, 3, 40, 128, 0.95, 64, 4_000, 2_000, 1 << 19, 0.01
FOUND = "query_id long, vec_id long, score double"


def projections(dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim * 1_000 + k)
    return rng.standard_normal((TABLES, dim + 1, k)), rng.uniform(0, 1, (TABLES, k))


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their largest component in [0.5, 1), and the powers of two that were taken out."""
    power = np.frexp(np.abs(v).max(axis=1, initial=0.0))[1]
    return np.ldexp(v, -power[:, None]), power


def lift(v: np.ndarray, top: tuple[int, float], query: bool) -> np.ndarray:
    """Rows as unit vectors of one more dimension. ``top``: the largest norm, after a power of two was taken out."""
    u = scaled(v)[0] if query else np.ldexp(v, -top[0]) / top[1]
    norm = np.sqrt((u * u).sum(1))
    return np.c_[u / norm[:, None], np.zeros(len(u))] if query else np.c_[u, np.sqrt(np.maximum(0, 1 - norm**2))]


def cells(x: np.ndarray, dim: int, k: int, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (rows, tables, k) and the place within the cell, in [0, 1)."""
    a, b = projections(dim, k)
    at = np.einsum("nd,tdk->ntk", x, a) / width + b
    low = np.floor(at)
    return low.astype(np.int64), at - low


def keys(cell: np.ndarray) -> np.ndarray:
    """A number for each table and cell, (rows, tables)."""
    n, t, k = cell.shape
    return keys_at(np.tile(np.arange(t), n), cell.reshape(-1, k)).reshape(n, t)


def moves(frac: float) -> Iterator[tuple[float, int]]:
    """(squared distance, cells to move) in one projection, the nearest first."""
    up, down = (((j - frac) ** 2, j) for j in range(1, 1 << 20)), (((frac + j - 1) ** 2, -j) for j in range(1, 1 << 20))
    yield 0.0, 0
    yield from heapq.merge(up, down)


def visits(x: np.ndarray, dim: int, k: int, n: int, width: float = WIDTH) -> Iterator[np.ndarray]:
    """For each query the keys of its first ``n`` cells over all tables, the likeliest first."""
    cell, frac = cells(x, dim, k, width)
    for c, f in zip(cell, frac, strict=True):
        source = [[moves(x) for x in row] for row in f]
        known = [[[next(m)] for m in row] for row in source]
        heap = [(0.0, t, (0,) * k) for t in range(TABLES)]
        out, table = np.empty((n, k), np.int64), np.empty(n, np.int64)
        for i in range(n):
            cost, t, at = heapq.heappop(heap)
            table[i], out[i] = t, [known[t][j][a][1] for j, a in enumerate(at)]
            # Each set of moves comes from one other: the one before it in its last moved projection.
            for j in range(max((j for j in range(k) if at[j]), default=0), k):
                if len(known[t][j]) == at[j] + 1:
                    known[t][j].append(next(source[t][j]))
                heapq.heappush(heap, (cost - known[t][j][at[j]][0] + known[t][j][at[j] + 1][0], t, (*at[:j], at[j] + 1, *at[j + 1 :])))
        yield keys_at(table, c[table] + out)


def keys_at(table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    h = table.astype(np.uint64)
    for j in range(cell.shape[1]):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (cell[:, j].astype(np.uint64) + np.uint64(0x7F4A7C15))
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def stack(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1 if len(raw) else 1)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (packed doubles), ``dim, largest`` (component) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("e")).filter("vec_id IS NOT NULL AND e IS NOT NULL").filter(F.coalesce(sound, F.lit(False)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [np.asarray(e, np.float64) + 0.0 for e in b["e"]]  # -0.0 becomes 0.0
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [x.tobytes() for x in v], "dim": [len(x) for x in v], "largest": [np.abs(x).max() for x in v]})

    return rows.mapInPandas(pack, "vec_id long, v binary, dim int, largest double")


def largest_norm(vectors: DataFrame) -> tuple[int, float]:
    """(power of two, norm) of the longest vector, the norm after the power was taken out of all vectors."""
    power = math.frexp(vectors.agg(F.max("largest")).first()[0] or 1.0)[1]

    def norm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"norm": np.sqrt((np.ldexp(stack(b["v"]), -power) ** 2).sum(1))})

    return power, vectors.select("v").mapInPandas(norm, "norm double").agg(F.max("norm")).first()[0] or 1.0


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows: products are added one after the other, whatever the number of rows."""
    return added(scaled(q[None]), scaled(v), np.zeros(len(v), np.int64), np.arange(len(v)))


def added(q: tuple, v: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`scores` of pairs of rows, of numbers that :func:`scaled` returned."""
    out = np.empty(len(i))
    with np.errstate(over="ignore"):
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            out[at : at + len(a)] = np.ldexp(np.cumsum(q[0][a] * v[0][b], axis=1)[:, -1], q[1][a] + v[1][b])
    return out


def leading(rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """The ``top`` rows by query of ``query_id, vec_id, score``, every id with its best score, ties to the smaller id."""
    query, ids, score = (rows[c].to_numpy() for c in ("query_id", "vec_id", "score"))
    order = np.lexsort((ids, -score, query))
    query, ids = query[order], ids[order]
    same = np.lexsort((ids, query))  # stable, so an id's best row comes first
    again = same[1:][(query[same[1:]] == query[same[:-1]]) & (ids[same[1:]] == ids[same[:-1]])]
    once = np.delete(np.arange(len(order)), again)
    rank = np.arange(len(once)) - np.searchsorted(query[once], query[once])
    return rows.iloc[order[once[rank < top]]]


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, top: int) -> pd.DataFrame:
    """The best rows of a block by query, own ids left out, ties to the smaller id; every id once."""
    out = [pd.DataFrame({"query_id": query_ids[:0], "vec_id": ids[:0], "score": np.zeros(0)})]
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    flat = np.ldexp(v, -np.frexp(np.abs(v).max(initial=0.0))[1])
    size, each = np.sqrt((flat * flat).sum(1)), scaled(v)
    for at in range(0, len(query_ids) if len(ids) else 0, 256):
        own, part = query_ids[at : at + 256], scaled(q[at : at + 256])
        rough = part[0] @ flat.T
        slack = 4 * v.shape[1] * np.finfo(float).eps * np.sqrt((part[0] * part[0]).sum(1))[:, None] * size + 1e-300
        rough[own[:, None] == ids] = -np.inf
        level = -np.inf
        if len(first) > top:
            sure = np.maximum.reduceat(rough - slack, first, axis=1)
            level = np.partition(sure, -top, axis=1)[:, -top, None]
        i, j = np.nonzero((rough + slack >= level) & (rough > -np.inf))
        out.append(leading(pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": added(part, each, i, j)}), top))
    return pd.concat(out[1:] or out, ignore_index=True)


def ranked(found: DataFrame, top: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, top: int) -> DataFrame:
    """Exact neighbours of a bounded block of queries, every batch of vectors against it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for b in batches:
            held = [leading(pd.concat([*held, best(ids, q, b["vec_id"].to_numpy(), stack(b["v"]), top)], ignore_index=True), top)]
        yield from held

    return ranked(vectors.mapInPandas(run, FOUND), top)


def complete(found: DataFrame, vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """``found`` with exact rows for all queries that have fewer than ``top`` of them, or than there are ids."""
    found = cut(found, "found")
    enough = min(top, vectors.select("vec_id").distinct().count())
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough).select(F.col("query_id").alias("vec_id"))
    short = cut(queries.join(full, "vec_id", "left_anti").select("vec_id", "v"), "short")
    blocks = math.ceil(short.count() / BLOCK)
    out = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(found.columns) if blocks else found
    for k in range(blocks):
        block = short.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)) == k).toPandas()
        if len(block):
            out = out.unionByName(cut(brute_force(vectors, block["vec_id"].to_numpy(), stack(block["v"]), top), "exact"))
    return out


def cell_width(vectors: DataFrame, n: int, longest: tuple[int, float]) -> float:
    """``WIDTH`` times the root mean square distance of the lifted vectors from their mean."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(lift(stack(b["v"]), longest, False).sum(0) for b in batches if len(b))
        yield pd.DataFrame({"at": np.arange(np.size(total)), "x": np.ravel(total)})

    mean = vectors.select("v").mapInPandas(sums, "at long, x double").groupBy("at").agg((F.sum("x") / F.lit(float(max(n, 1)))).alias("x"))
    length = mean.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0
    return WIDTH * max(LEAST_SPREAD, math.sqrt(max(0.0, 1.0 - length)))


def plan_visits(vectors: DataFrame, queries: DataFrame, n: int, dim: int, longest: tuple[int, float], width: float, top: int) -> tuple[int, int]:
    """(projections, visits) with which a sample of at most ``SAMPLE`` queries finds ``RECALL`` of its neighbours."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).dropDuplicates(["vec_id"]).toPandas()
    if not len(sample):
        return 1, 1
    ids, q = sample["vec_id"].to_numpy(), stack(sample["v"])
    truth = brute_force(vectors, ids, q, top)
    truth = truth.join(vectors.select("vec_id", "v"), "vec_id").groupBy("query_id", "vec_id").agg(F.min("v").alias("v")).toPandas()
    if not len(truth):
        return 1, 1
    row = {i: k for k, i in enumerate(ids)}
    of, x, near = truth["query_id"].map(row).to_numpy(), lift(q, longest, True), lift(stack(truth["v"]), longest, False)
    for k in range(max(1, round(math.log(max(n, 1) / OCCUPANCY, SPREAD))), 0, -1):
        most = 16
        while k == 1 or most <= VISITS:
            mine, order = keys(cells(near, dim, k, width)[0]), list(visits(x, dim, k, most, width))
            at = np.asarray([np.append(np.flatnonzero(np.isin(order[o], m)), most)[0] for o, m in zip(of, mine, strict=True)])
            reached = np.cumsum(np.bincount(at, minlength=most + 1)[:most]) / len(at)
            if reached[-1] >= RECALL:
                return k, int(np.argmax(reached >= RECALL)) + 1
            most *= 2


def nearest(df: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` rows of ``df`` with the largest inner products by query."""
    vectors = valid_vectors(df, id_col, vector_col).distinct()
    first = Window.partitionBy("v").orderBy("vec_id")
    vectors = cut(vectors.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= top + 1).drop("_r"), "vectors")
    asked = cut(valid_vectors(queries, id_col, vector_col), "queries")
    common = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = common[0].dim if common else 1
    vectors = vectors.filter(F.col("dim") == dim)
    asked = asked.filter(F.col("dim") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    longest = largest_norm(vectors)
    n = vectors.count()
    width = cell_width(vectors, n, longest)
    k, probes = plan_visits(vectors, asked, n, dim, longest, width, top)
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key = keys(cells(lift(stack(b["v"]), longest, False), dim, k, width)[0])
            yield pd.DataFrame({"cell": key.ravel(), "vec_id": b["vec_id"].repeat(TABLES).to_numpy(), "v": b["v"].repeat(TABLES).to_numpy()})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = list(visits(lift(stack(b["v"]), longest, True), dim, k, probes, width))
            yield pd.DataFrame({"cell": np.concatenate(own) if own else np.zeros(0, np.int64), "vec_id": b["vec_id"].repeat(probes).to_numpy(), "v": b["v"].repeat(probes).to_numpy()})

    schema = "cell long, vec_id long, v binary"
    entries, probed = vectors.select("vec_id", "v").mapInPandas(index, schema), asked.mapInPandas(probe, schema)
    # A cell is a grid of groups: each holds a share of its vectors and a share of the queries that visit it.
    parts = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))
    size = parts(entries, "columns").join(parts(probed, "rows"), "cell")
    own = lambda c, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    entries = entries.join(size, "cell").withColumn("column", own("columns", 1)).withColumn("row", all_of("rows")).withColumn("asks", F.lit(False))
    probed = probed.join(size, "cell").withColumn("row", own("rows", 2)).withColumn("column", all_of("columns")).withColumn("asks", F.lit(True))
    group = ["cell", "row", "column"]
    both = entries.unionByName(probed).select(*group, "asks", "vec_id", "v")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, v, held, rows = None, [], [], [], 0
        for b in batches:
            for key, part in b.groupby([*group, "asks"], sort=True):
                if key[:3] != at:
                    at, ids, v = key[:3], [], []
                if not key[3]:
                    ids.append(part["vec_id"].to_numpy())
                    v.append(stack(part["v"]))
                elif ids:
                    ids, v = [np.concatenate(ids)], [np.concatenate(v)]
                    held.append(best(part["vec_id"].to_numpy(), stack(part["v"]), ids[0], v[0], top))
                    rows += len(held[-1])
                if rows > HELD:
                    held = [leading(pd.concat(held, ignore_index=True), top)]
                    rows = len(held[0])
                    if rows > HELD // 2:
                        yield held[0]
                        held, rows = [], 0
        if held:
            yield leading(pd.concat(held, ignore_index=True), top)

    dealt = both.repartition(shares, *group).sortWithinPartitions(*group, "asks")
    return complete(ranked(dealt.mapInPandas(search, FOUND), top), vectors, asked, top)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))
