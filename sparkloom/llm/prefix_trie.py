"""Prefix trie of conversations: an LCP-aware mergesort of turn sequences whose merged stream emits finished nodes.

A turn is the SHA-256 of its role and text, so a conversation is a sequence of digests. Ranges of sequences (ties by id,
so that copies are spread) go to tasks. A task sorts runs of bounded size, front-coded by the longest common prefix
(LCP) with the row before; a loser tree merges them and compares two heads only beyond the shorter LCP with the last
winner. The merged stream feeds a stack of open nodes: what the next sequence doesn't share is finished and emitted.

The nodes on a range's first and last path may go on in the ranges beside it. They leave the task as partial sums, a few
dozen for each range, which one streaming pass in range order folds by the same stack; the ids that end at such a node
arrive joined, one text a range, and are hashed as they come. A task holds the front-coded turns of its range; one
conversation's digests and lengths, 40 bytes a turn, must fit in a task.

Turns of a conversation go by turn, null first, and equal ones by digest. Null roles and texts count as empty. Rows with
a null conversation id take no part, other columns are ignored, and an empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import crc32_sql, cut

#: Turns of a run at most, unless one conversation has more.
RUN = 1 << 15
#: Turns that a rebuilt conversation takes from the first of its five: fewer than this.
HEADS = 9
NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
PLACE = [("part", pa.int32()), ("slot", pa.int32())]
#: Rows of a task: finished nodes, whose parent is known or stands in ``part, slot``; and partial sums, which have ``ends``.
FOUND = pa.schema([*NODE, *PLACE, ("partial", pa.bool_()), ("symbol", pa.binary()), ("bytes", pa.int64()), ("ends", pa.string())])
FOUND_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, slot int, partial boolean, symbol binary, bytes long, ends string"
MERGED = pa.schema([*NODE, *PLACE, ("mark", pa.bool_())])
MERGED_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, slot int, mark boolean"


@dataclass
class Node:
    """An open node: sums over what is finished below it."""

    depth: int
    symbol: bytes | None = None
    bytes: int = 0
    slot: int | None = None
    smallest: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    waiting: list[dict] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)
    hash: object = None

    def least(self, conv_id: int | None) -> None:
        if conv_id is not None and (self.smallest is None or conv_id < self.smallest):
            self.smallest = conv_id

    def finish(self, ends_sha256: str) -> dict:
        """The node's row, its parent apart."""
        self.n_leaves = self.n_leaves or 1
        self.saved += (self.n_convs - 1) * self.bytes
        return {"conv_id": self.smallest, "depth": self.depth, "n_convs": self.n_convs, "n_children": self.n_children, "n_leaves": self.n_leaves, "saved_tokens": self.saved, "ends_sha256": ends_sha256}

    def add(self, child: Node, row: dict) -> None:
        self.n_convs += child.n_convs
        self.n_children += 1
        self.n_leaves += child.n_leaves
        self.saved += child.saved
        self.least(child.smallest)
        self.waiting.append(row)


def shared(a: list[bytes], b: list[bytes], n: int = 0) -> int:
    """The length of the common prefix of two sequences that agree in the first ``n`` places."""
    most = min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


def front_coded(rows: list[tuple[list[bytes], int, list[int]]]) -> list[tuple[int, list[bytes], int, list[int]]]:
    """A sorted run of ``(sequence, id, lengths)``: the LCP with the row before, and what follows it."""
    rows.sort(key=lambda r: (r[0], r[1]))
    out, last = [], []
    for key, conv_id, sizes in rows:
        n = shared(last, key)
        out.append((n, key[n:], conv_id, sizes[n:]))
        last = key
    return out


def merge(runs: list[list[tuple[int, list[bytes], int, list[int]]]]) -> Iterator[tuple[int, list[bytes], int, list[int]]]:
    """All rows of front-coded runs in order, each with its LCP with the row before it.

    Every head's LCP counts against the last row that was given out, as every head lost to it on its way up. The head
    with the longer LCP is the smaller one; equal LCPs are compared from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    keys, sizes, ids, lcps, at = [[] for _ in range(size)], [[] for _ in range(size)], [0] * size, [0] * size, [0] * size
    live = [False] * size

    def advance(r: int) -> None:
        """Take the next row of a run whose last head was given out just now."""
        live[r] = r < len(runs) and at[r] < len(runs[r])
        if live[r]:
            n, rest, ids[r], more = runs[r][at[r]]
            runs[r][at[r]] = None  # what was taken is let go
            keys[r], sizes[r], lcps[r] = keys[r][:n] + rest, sizes[r][:n] + more, n
            at[r] += 1

    def beats(a: int, b: int) -> bool:
        if not (live[a] and live[b]):
            return live[a]
        if lcps[a] != lcps[b]:
            return lcps[a] > lcps[b]
        x, y = keys[a], keys[b]
        n = shared(x, y, lcps[a])
        if n < len(x) and n < len(y):
            first = x[n] < y[n]
        else:
            first = (len(x), ids[a]) < (len(y), ids[b])
        lcps[b if first else a] = n
        return first

    for r in range(size):
        advance(r)
    losers, winners = [0] * size, [*[0] * size, *range(size)]
    for i in range(size - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        winners[i], losers[i] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if size > 1 else 0
    while live[top]:
        yield lcps[top], keys[top], ids[top], sizes[top]
        advance(top)
        i = (top + size) // 2
        while i:
            if not beats(top, losers[i]):
                top, losers[i] = losers[i], top
            i //= 2


def digest(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def sweep(rows: Iterable[tuple[int, list[bytes], int, list[int]]], part: int) -> Iterator[dict]:
    """Finished nodes of a merged stream, and partial sums of those on its first and its last path."""
    stack: list[Node] = []
    slots = 0

    def leave(node: Node, slot: int) -> Iterator[dict]:
        for row in node.waiting:
            yield row | {"part": part, "slot": slot, "partial": False}
        yield {"part": part, "slot": slot, "partial": True, "depth": node.depth, "symbol": node.symbol, "bytes": node.bytes, "conv_id": node.smallest, "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": node.n_leaves, "saved_tokens": node.saved, "ends": ",".join(map(str, node.ends))}

    def close() -> Iterator[dict]:
        node = stack.pop()
        node.n_convs += len(node.ends)
        if node.slot is not None:
            yield from leave(node, node.slot)
            return
        row = node.finish(digest(node.ends))
        for child in node.waiting:
            yield child | {"parent_conv_id": node.smallest, "partial": False}
        stack[-1].add(node, row)

    for n, key, conv_id, sizes in rows:
        first = not stack
        if first:
            stack.append(Node(0, slot=0))
        while len(stack) > n + 1:
            yield from close()
        for d in range(n, len(key)):
            stack.append(Node(d + 1, key[d], sizes[d], d + 1 if first else None))
        slots = slots or len(stack)
        stack[-1].ends.append(conv_id)
        stack[-1].least(conv_id)
        if stack[0].waiting:  # the root stays open to the end, so what waits for it leaves at once
            for row in stack[0].waiting:
                yield row | {"part": part, "slot": 0, "partial": False}
            stack[0].waiting.clear()
    for node in stack:
        if node.slot is None:
            node.slot, slots = slots, slots + 1
    while stack:
        yield from close()


def fold(partials: Iterable[dict]) -> Iterator[dict]:
    """The nodes on the paths between ranges, from their partial sums in order; marks tell where each sum went."""
    stack: list[Node] = []

    def close() -> Iterator[dict]:
        node = stack.pop()
        row = node.finish(node.hash.hexdigest())
        for child in node.waiting:
            yield child | {"parent_conv_id": node.smallest, "mark": False}
        for part, slot in node.places:
            yield {"part": part, "slot": slot, "conv_id": node.smallest, "mark": True}
        if stack:
            stack[-1].add(node, row)
        else:
            yield row | {"mark": False}

    for p in partials:
        d = p["depth"]
        if not (len(stack) > d and stack[d].symbol == p["symbol"]):
            while len(stack) > d:
                yield from close()
            stack.append(Node(d, p["symbol"], p["bytes"], hash=hashlib.sha256()))
        node = stack[d]
        node.places.append((p["part"], p["slot"]))
        node.least(p["conv_id"])
        if p["ends"]:
            node.hash.update((("," if node.ends else "") + p["ends"]).encode())
            node.ends = [0]  # some id came before
        for k, v in (("n_convs", "n_convs"), ("n_children", "n_children"), ("n_leaves", "n_leaves"), ("saved", "saved_tokens")):
            setattr(node, k, getattr(node, k) + p[v])
    while stack:
        yield from close()


def batched(rows: Iterator[dict], schema: pa.Schema, most: int = 4_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` of ``turns(conv_id, turn, role, text)``: structs of digest and bytes in their order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    symbol = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", symbol.alias("symbol"), F.octet_length(text).alias("bytes")).alias("t")).filter("conv_id IS NOT NULL")
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["symbol"].alias("symbol"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(turns: DataFrame, base: Column, take: Column) -> DataFrame:
    """:func:`sequences` whose first ``take`` turns are those of conversation ``base``; both are of ``conv_id``."""
    own = cut(sequences(turns), "sequences")
    heads = own.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    joined = own.withColumns({"_base": base, "_take": take}).join(heads, "_base", "left")
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_take")), F.array().cast(own.schema["turns"].dataType))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("_take") + 1, F.size("turns"))).alias("turns"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of ``conversations(conv_id, turns)`` with their members, children, leaves, savings and ends."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = cut(conversations.select("conv_id", F.col("turns.symbol").alias("symbols"), F.col("turns.bytes").alias("bytes")), "rebuilt")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held, size = [], [], 0
        for batch in batches:
            for conv_id, symbols, sizes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and size + len(symbols) > RUN:
                    runs.append(front_coded(held))
                    held, size = [], 0
                held.append((symbols, conv_id, sizes))
                size += len(symbols) + 1
        if held:
            runs.append(front_coded(held))
        yield from batched(sweep(merge(runs), TaskContext.get().partitionId()), FOUND)

    found = cut(keyed.repartitionByRange(parts, "symbols", "conv_id").mapInArrow(sort, FOUND_DDL), "found")

    def fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(fold(p for b in batches for p in b.to_pylist()), MERGED)

    # A few dozen rows for each range, in the order of ranges.
    partial = found.filter("partial").select("part", "slot", "depth", "symbol", "bytes", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    merged = cut(partial.repartition(1).sortWithinPartitions("part", "slot").mapInArrow(fold_all, MERGED_DDL), "merged")
    names = [n for n, _ in NODE]
    done = found.filter("NOT partial")
    marks = merged.filter("mark").select("part", "slot", F.col("conv_id").alias("_parent"))
    beside = done.filter("slot IS NOT NULL").join(marks, ["part", "slot"]).withColumn("parent_conv_id", F.col("_parent"))
    return done.filter("slot IS NULL").select(*names).unionByName(beside.select(*names)).unionByName(merged.filter("NOT mark").select(*names))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c = F.col("conv_id")
    return prefix_trie(rebuilt(turns, c - c % 5, (F.crc32(c.cast("string")) % HEADS).cast("int")))


def op11_sql() -> str:
    return f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, count(*) AS n FROM t GROUP BY c), {crc32_sql("own", "c::VARCHAR", "c")},
    ids AS (SELECT own.c, crc % {HEADS} AS h, own.c - own.c % 5 AS b, coalesce(least(crc % {HEADS}, bases.n), 0) AS k FROM own JOIN crcs USING (c) LEFT JOIN own bases ON bases.c = own.c - own.c % 5),
    turn AS (SELECT i.c, t.r AS pos, role, text FROM ids i JOIN t ON t.c = i.b AND t.r <= i.h UNION ALL SELECT i.c, i.k + t.r - i.h, role, text FROM ids i JOIN t ON t.c = i.c AND t.r > i.h),
    pre AS (SELECT c, pos AS depth, list({{'role': role, 'text': text}}) OVER (PARTITION BY c ORDER BY pos) AS key, strlen(text) AS bytes FROM turn UNION ALL SELECT c, 0, [], 0 FROM ids),
    last AS (SELECT c, max(depth) AS len FROM pre GROUP BY c),
    node AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = len), '')) AS ends_sha256 FROM pre JOIN last USING (c) GROUP BY depth, key),
    named AS (SELECT pre.c, pre.depth, node.conv_id FROM pre JOIN node ON node.depth = pre.depth AND node.key = pre.key),
    kin AS (SELECT n.*, p.conv_id AS parent_conv_id FROM node n LEFT JOIN named p ON p.c = n.conv_id AND p.depth = n.depth - 1),
    kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM kin WHERE depth > 0 GROUP BY 1, 2),
    below AS (SELECT a.conv_id, a.depth, count(*) FILTER (coalesce(n_children, 0) = 0) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens FROM kin n LEFT JOIN kids ON kids.conv_id = n.conv_id AND kids.depth = n.depth JOIN named a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY 1, 2)
    SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256 FROM kin JOIN below USING (conv_id, depth) LEFT JOIN kids USING (conv_id, depth)"""
