"""Merkle manifest of a table: contiguous digest matrices in aligned blocks, with siblings found by index arithmetic.

A node's hash covers up to ``FANOUT`` consecutive nodes below it. The leaves of a source, in the order of their ids, are
cut into aligned blocks of ``FANOUT ** BLOCK_LEVELS``; each block is one row of the manifest that holds its leaves as
one contiguous matrix of 64-byte hex digests. A task reshapes the matrix by the fanout and hashes its rows level by
level; the blocks' roots are the leaves of the next tier, until every source has one root, and the roots of the sources
form a tree in the same way. Then the tiers are descended: each block hands its nodes the siblings above them. No task
holds more than a block, so a source of any size is spread.

Sources are ordered by their bytes, null first, and leaves by id, null first; rows of one source and id go by leaf, and
equal rows are leaves each. Null columns count as ``-``, so a null text differs from an empty one. A null id is never
picked for tampering. Other columns are ignored. An empty table has no leaves and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import crc32_sql, cut, numbered

FANOUT, BLOCK_LEVELS = 16, 2
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """The hash of a row, over columns that each say their length."""
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def levels(digests: bytes, total: int) -> list[np.ndarray]:
    """The matrices of a block, from its nodes to its root; ``total`` nodes of the whole tree tell when to stop."""
    out = [np.frombuffer(digests, np.uint8).reshape(-1, 64)]
    for _ in range(BLOCK_LEVELS):
        if total <= 1:
            break
        below, n = out[-1], len(out[-1])
        whole = n // FANOUT * FANOUT
        rows = [sha(r.data) for r in below[:whole].reshape(-1, FANOUT * 64)]
        if whole < n:
            rows.append(sha(below[whole:].tobytes()))
        out.append(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 64))
        total = -(-total // FANOUT)
    return out


def siblings(matrices: list[np.ndarray], at: int) -> tuple[list[bytes], list[bytes]]:
    """For each level below a block's root: the digests on the left and on the right in the run of node ``at``."""
    left, right = [], []
    for m in matrices[:-1]:
        start = at // FANOUT * FANOUT
        left.append(m[start:at].tobytes())
        right.append(m[at + 1 : start + FANOUT].tobytes())
        at //= FANOUT
    return left, right


def pack(nodes: DataFrame, extra: dict[str, str], name: str) -> DataFrame:
    """Blocks ``(tree, block, total, digests, root, ...)`` of ``nodes(tree, pos, total, digest, ...)``; ``extra``
    columns become arrays in the order of the nodes."""
    more = "".join(f", {c} array<{t}>" for c, t in extra.items())

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        digests, total = "".join(table["digest"].to_pylist()).encode(), table["total"][0].as_py()
        out = {"tree": [table["tree"][0].as_py()], "block": [table["block"][0].as_py()], "total": [total], "digests": [digests], "root": [levels(digests, total)[-1].tobytes().decode()]}
        return pa.table(out | {c: pa.array([table[c].to_pylist()], pa.list_(table.schema.field(c).type)) for c in extra})

    dealt = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "total", "digest", *extra).groupBy("tree", "block")
    return cut(dealt.applyInArrow(block, f"tree string, block long, total long, digests binary, root string{more}"), name)


def climb(blocks: DataFrame, name: str) -> list[DataFrame]:
    """The tiers of blocks up to one block a tree."""
    tiers = [blocks]
    while (tiers[-1].agg(F.max("total")).first()[0] or 0) > BLOCK:
        above = F.ceil(F.col("total") / BLOCK)
        tiers.append(pack(tiers[-1].select("tree", F.col("block").alias("pos"), above.alias("total"), F.col("root").alias("digest")), {}, name))
    return tiers


def along(blocks: DataFrame, paths: DataFrame, made: Callable[[dict, list[np.ndarray]], Iterator[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """The rows that ``made`` gives for each block together with the path above it, from
    ``paths(tree, pos, subroot, left, right)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time bounds what a task holds
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist(list(made(row, levels(row["digests"], row["total"]))), arrow)

    return blocks.join(paths.withColumnRenamed("pos", "block"), ["tree", "block"]).mapInArrow(run, schema)


PATH = "tree string, pos long, subroot string, left array<binary>, right array<binary>"
PATH_ARROW = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("left", pa.list_(pa.binary())), ("right", pa.list_(pa.binary()))])


def steps(row: dict, matrices: list[np.ndarray]) -> Iterator[dict]:
    """The paths of a block's nodes."""
    for at in range(len(matrices[0])):
        left, right = siblings(matrices, at)
        yield {"tree": row["tree"], "pos": row["block"] * BLOCK + at, "subroot": row["subroot"], "left": left + row["left"], "right": right + row["right"]}


def descend(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the blocks of the lowest of ``tiers``, from the paths of the highest one's."""
    for tier in reversed(tiers[1:]):
        top = along(tier, top, steps, PATH, PATH_ARROW)
    return top


def proofs(row: dict, matrices: list[np.ndarray]) -> Iterator[dict]:
    """The rows of a block of leaves: proofs, and roots folded from the tampered or else the original leaves."""
    for at, (doc_id, forged) in enumerate(zip(row["ids"], row["forged"], strict=True)):
        left, right = siblings(matrices, at)
        proof, own = hashlib.sha256(), matrices[0][at].tobytes()
        node = own if forged is None else forged.encode()
        for a, b in zip(left + row["left"], right + row["right"], strict=True):
            proof.update(a + b)
            node = sha(a + node + b)
        yield {"doc_id": doc_id, "leaf": own.decode(), "subroot": row["subroot"], "proof_sha256": proof.hexdigest(), "folded_root": node.decode()}


def manifest(docs: DataFrame, tampered: Column, forged: dict[str, Column]) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of ``docs``.

    Rows that are ``tampered`` are checked with the columns ``forged`` in place of their own.
    """
    row = [F.col(c) for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf(row).alias("digest"), F.when(tampered, leaf([forged.get(c, F.col(c)) for c in FIELDS])).alias("forged"))
    placed = numbered(leaves, "tree", ["id", "digest"], "leaves")
    low = climb(pack(placed.withColumnRenamed("id", "ids"), {"ids": "bigint", "forged": "string"}, "blocks"), "blocks")
    roots = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    roots = numbered(roots, "tree", ["source"], "roots")
    high = climb(pack(roots, {}, "sources"), "sources")
    root = high[-1].select("root").first()
    root = root.root if root else None

    top = high[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.lit("").alias("subroot"), F.array().cast("array<binary>").alias("left"), F.array().cast("array<binary>").alias("right"))
    at_sources = along(high[0], descend(high, top), steps, PATH, PATH_ARROW)
    own = at_sources.drop("subroot", "tree").join(roots.select("pos", "source", F.col("digest").alias("subroot")), "pos")
    own = cut(own.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "subroot", "left", "right"), "paths")
    schema = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
    arrow = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])
    out = along(low[0], descend(low, own), proofs, schema, arrow)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(docs, picked, {"text": F.translate("text", UPPER, LOWER)})


def op13_sql() -> str:
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join(enc(c) for c in (*FIELDS[:-1], text)) + ")"
    run = f"sha256(string_agg(digest, '' ORDER BY pos)), pos // {FANOUT}"
    return f"""WITH RECURSIVE {crc32_sql("documents", "doc_id::VARCHAR", "doc_id")},
    lower AS (SELECT d.*, crc % 5 = 0 AS picked, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents d LEFT JOIN crcs USING (doc_id)),
    leaves AS (SELECT doc_id, source, {row("text")} AS leaf, CASE WHEN picked THEN {row("low")} ELSE {row("text")} END AS used FROM lower),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
    tree AS (SELECT source, 0 AS level, leaf AS digest, pos, n FROM placed UNION ALL SELECT source, level + 1, {run}, (n + {FANOUT - 1}) // {FANOUT} FROM tree WHERE n > 1 GROUP BY source, level, n, pos // {FANOUT}),
    subs AS (SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
    above AS (SELECT 0 AS level, subroot AS digest, pos, n FROM subs UNION ALL SELECT level + 1, {run}, (n + {FANOUT - 1}) // {FANOUT} FROM above WHERE n > 1 GROUP BY level, n, pos // {FANOUT}),
    path AS (SELECT p.doc_id, p.leaf, p.used, p.pos AS spot, p.source, 0 AS step, t.level, t.digest, t.pos AS k, p.pos // power({FANOUT}, t.level)::BIGINT AS own FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND t.n > 1 AND t.pos // {FANOUT} = p.pos // power({FANOUT}, t.level + 1)::BIGINT
      UNION ALL SELECT p.doc_id, p.leaf, p.used, p.pos, p.source, 1, a.level, a.digest, a.pos, s.pos // power({FANOUT}, a.level)::BIGINT FROM placed p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source JOIN above a ON a.n > 1 AND a.pos // {FANOUT} = s.pos // power({FANOUT}, a.level + 1)::BIGINT),
    sides AS (SELECT spot, source, row_number() OVER (PARTITION BY spot, source ORDER BY step, level) AS i, coalesce(string_agg(digest, '' ORDER BY k) FILTER (k < own), '') AS l, coalesce(string_agg(digest, '' ORDER BY k) FILTER (k > own), '') AS r FROM path GROUP BY spot, source, step, level),
    fold AS (SELECT pos AS spot, source, 0::BIGINT AS i, used AS node FROM placed UNION ALL SELECT f.spot, f.source, s.i, sha256(s.l || f.node || s.r) FROM fold f JOIN sides s ON s.spot = f.spot AND s.source IS NOT DISTINCT FROM f.source AND s.i = f.i + 1),
    last AS (SELECT spot, source, arg_max(node, i) AS folded_root FROM fold GROUP BY 1, 2), proof AS (SELECT spot, source, sha256(string_agg(l || r, '' ORDER BY i)) AS proof_sha256 FROM sides GROUP BY 1, 2)
    SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM above WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM above WHERE n = 1) AS verified
    FROM placed p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source JOIN last f ON f.spot = p.pos AND f.source IS NOT DISTINCT FROM p.source LEFT JOIN proof q ON q.spot = p.pos AND q.source IS NOT DISTINCT FROM p.source"""
