"""Shards of nearly equal bytes: minimax contiguous partition of groups of equal texts.

Groups are atomic and stand in the order of their texts' SHA-256. The smallest capacity is found at which a greedy fill
needs no more than the wanted shards. The driver searches it on marks: known prefix sums of group sizes, at most
``MARKS`` of a round, with a flag for gaps that may hide more of them. A bound from below and one from above tell which
gaps still matter; one job a round looks into them, and a round shrinks them by a factor of hundreds, whatever the
number of groups. Rows meet their shard by comparing their digest with the digests at the cuts, so no row is joined and
a text of any number of copies is spread over all tasks.

Of all cuts that keep the capacity, each goes where the rest divides evenly (the lower place of two equally near ones),
so that a group above the mean leaves no shard empty.

Null texts count as empty ones, and both are one group. Rows with a null or repeated id are rows like others; a shard's
slots go by digest, then id (null first). Fewer groups than shards leave the last shards empty. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import crc32_sql, cut, numbered

SHARDS = 16
#: Buckets that one round looks into, each of which gives two marks at most.
MARKS = 1 << 15


class Marks:
    """Ascending boundaries between groups that are known so far, and which gaps between two of them may hold others."""

    def __init__(self, total: int):
        self.at, self.open = [0, total], [True]

    def below(self, x: int) -> tuple[int, bool]:
        """The largest known boundary up to ``x``, and whether no unknown one can lie between."""
        i = bisect_right(self.at, x) - 1
        return self.at[i], self.at[i] == x or i == len(self.open) or not self.open[i]

    def above(self, x: int) -> tuple[int, bool]:
        """The smallest known boundary from ``x`` on, and whether no unknown one can lie between."""
        i = bisect_left(self.at, x)
        return self.at[i], self.at[i] == x or not self.open[i - 1]

    def spans(self, windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Disjoint stretches between known boundaries that hold the open gaps touched by ``windows``."""
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(windows):
            first, last = max(0, bisect_right(self.at, lo) - 1), min(len(self.open), bisect_left(self.at, hi + 1))
            gaps = [i for i in range(first, last) if self.open[i]]
            if gaps and out and self.at[gaps[0]] <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], self.at[gaps[-1] + 1]))
            elif gaps:
                out.append((self.at[gaps[0]], self.at[gaps[-1] + 1]))
        return out

    def learn(self, spans: list[tuple[int, int]], buckets: list[tuple[int, int, int]]) -> None:
        """Take in the (smallest, largest, number) of boundaries of each bucket inside ``spans``."""
        hidden = sorted((a, b) for a, b, n in buckets if n > 2)
        starts = [a for a, _ in hidden]
        known = dict(zip(self.at, [*self.open, False], strict=True))
        at = sorted({*self.at, *(a for a, _, _ in buckets), *(b for _, b, _ in buckets)})

        def may_hide(x: int, y: int) -> bool:
            if any(a <= x and y <= b for a, b in spans):
                i = bisect_right(starts, x) - 1
                return i >= 0 and y <= hidden[i][1]
            return known.get(x, False)

        self.open = [may_hide(x, y) for x, y in zip(at, at[1:], strict=False)]
        self.at = at


def fill(marks: Marks, capacity: int, shards: int, total: int, upper: bool) -> list[int]:
    """Where a greedy fill from the left ends each shard; with ``upper`` no true end lies farther right, else none
    farther left."""
    out, pos = [], 0
    for _ in range(shards):
        known, sure = marks.below(min(pos + capacity, total))
        pos = known if sure or not upper else min(pos + capacity, total)
        out.append(pos)
    return out


def fill_back(marks: Marks, capacity: int, shards: int, total: int) -> list[tuple[int, bool]]:
    """The leftmost ends of the first shards from which the others hold the rest, and whether each is exact."""
    out, pos = [(total, True)], total
    for _ in range(shards - 1):
        pos, sure = marks.above(max(pos - capacity, 0))
        out.append((pos, sure and out[-1][1]))
    return out[::-1]


def least(lo: int, hi: int, fits: Callable[[int], bool]) -> int:
    """The smallest value that ``fits``, by binary search; ``hi`` does."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(look: Callable[[list[tuple[int, int]]], list[tuple[int, int, int]]], total: int, biggest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the ends of the shards; ``look`` gives the buckets of boundaries inside spans."""
    marks = Marks(total)

    def refine(windows: list[tuple[int, int]]) -> bool:
        spans = marks.spans(windows)
        if spans:
            marks.learn(spans, look(spans))
        return bool(spans)

    while True:
        floor = max(biggest, -(-total // shards))
        low = least(floor, total, lambda c: fill(marks, c, shards, total, True)[-1] == total)
        high = least(low, total, lambda c: fill(marks, c, shards, total, False)[-1] == total)
        if low == high or not refine(list(zip(fill(marks, low, shards, total, False), fill(marks, high, shards, total, True), strict=True))):
            break
    while not all(sure for _, sure in fill_back(marks, high, shards, total)):
        back = fill_back(marks, high, shards, total)
        refine([(max((end if i + 1 == shards else back[i + 1][0]) - high, 0), end) for i, (end, _) in enumerate(back)])
    back, ends, pos = fill_back(marks, high, shards, total), [], 0
    for left, (need, _) in zip(range(shards, 0, -1), back, strict=True):
        want, most = pos + (total - pos) // left, min(pos + high, total)
        while not (marks.below(want)[1] and marks.above(want)[1] and marks.below(most)[1] and marks.above(min(pos + 1, total))[1]):
            refine([(want, want), (most, most), (pos, min(pos + 1, total))])
        a, b = marks.below(want)[0], marks.above(want)[0]
        pos = min(max(a if want - a <= b - want else b, need, marks.above(min(pos + 1, total))[0]), marks.below(most)[0])
        ends.append(pos)
    return high, ends


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of all rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = cut(rows, "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))

    def run_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = 0
        for batch in batches:
            ends = batch["size"].cumsum() + held
            held = int(ends.iloc[-1]) if len(ends) else held
            yield batch.assign(within=ends)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = groups.repartitionByRange(parts, "digest").sortWithinPartitions("digest").withColumn("part", F.spark_partition_id())
    ordered = cut(ordered.mapInPandas(run_up, "digest string, size long, part int, within long"), "groups")
    # One row a partition, whose number the session sets.
    sums = ordered.groupBy("part").agg(F.max("within").alias("bytes"), F.max("size").alias("biggest")).orderBy("part").collect()
    total, bases = 0, {}
    for s in sums:
        bases[s.part], total = total, total + s.bytes
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    base = F.element_at(F.create_map(*(F.lit(x) for pair in bases.items() for x in pair)), F.col("part"))
    ends = ordered.select("digest", (F.col("within") + base).cast("long").alias("end"))

    def look(spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        width = max(1, -(-sum(b - a for a, b in spans) // MARKS))
        bucket = None
        for i, (a, b) in enumerate(spans):
            here, there = (F.col("end") > a) & (F.col("end") < b), F.struct(F.lit(i).alias("span"), F.floor((F.col("end") - a) / width).alias("k"))
            bucket = F.when(here, there) if bucket is None else bucket.when(here, there)
        found = ends.withColumn("bucket", bucket).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n"))
        return [(r.a, r.b, r.n) for r in found.select("a", "b", "n").collect()]

    _, cuts = minimax_cuts(look, total, max(s.biggest for s in sums), shards)
    marks = sorted(r.digest for r in ends.filter(F.col("end").isin(cuts)).select("digest").collect())
    at = sum(((F.col("digest") > m).cast("int") for m in marks), F.lit(0))
    return numbered(rows.withColumn("shard", at), "shard", ["digest", "doc_id"], "slots").select("doc_id", "size", "text_crc32", "shard", F.col("pos").alias("slot"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_sql() -> str:
    """The same by recursion: the capacity, the leftmost ends, and the even cuts, one group boundary at a time."""
    k = SHARDS
    return f"""WITH RECURSIVE rows AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS digest, strlen(coalesce(text, ''))::BIGINT + 1 AS size FROM documents),
    pre AS (SELECT digest, sum(size) AS size, (sum(sum(size)) OVER (ORDER BY digest))::BIGINT AS p FROM rows GROUP BY digest), tot AS (SELECT max(p) AS t, max(size)::BIGINT AS big FROM pre),
    s AS (SELECT greatest(big, (t + {k - 1}) // {k}) AS lo, t AS hi, 0::BIGINT AS s, 0::BIGINT AS pos FROM tot UNION ALL
      SELECT CASE WHEN done AND NOT ok THEN mid + 1 ELSE lo END, CASE WHEN ok THEN mid ELSE hi END, CASE WHEN done THEN 0 ELSE s + 1 END, CASE WHEN done THEN 0 ELSE nxt END FROM
      (SELECT *, nxt = t OR s = {k - 1} AS done, nxt = t AS ok FROM (SELECT s.*, (lo + hi) // 2 AS mid, t, (SELECT coalesce(max(p), 0) FROM pre WHERE p <= s.pos + (s.lo + s.hi) // 2) AS nxt FROM s, tot WHERE s.lo < s.hi))),
    cap AS (SELECT lo AS c FROM s WHERE lo = hi),
    back AS (SELECT {k}::BIGINT AS s, t AS need FROM tot UNION ALL SELECT back.s - 1, CASE WHEN back.need <= c THEN 0 ELSE (SELECT min(p) FROM pre WHERE p >= back.need - c) END FROM back, cap WHERE back.s > 1),
    fwd AS (SELECT 0::BIGINT AS s, 0::BIGINT AS pos, NULL::BIGINT AS want UNION ALL
      SELECT s + 1, least(greatest(CASE WHEN want - a <= b - want THEN a ELSE b END, need, nxt), far), want FROM
      (SELECT f.s, f.want, (SELECT need FROM back WHERE back.s = f.s + 1) AS need, (SELECT coalesce(max(p), 0) FROM pre WHERE p <= f.want) AS a, (SELECT coalesce(min(p) FILTER (p >= f.want), f.t) FROM pre) AS b,
        (SELECT coalesce(min(p), f.t) FROM pre WHERE p >= least(f.pos + 1, f.t)) AS nxt, (SELECT coalesce(max(p), 0) FROM pre WHERE p <= f.pos + f.c) AS far
       FROM (SELECT fwd.s, fwd.pos, t, c, fwd.pos + (t - fwd.pos) // ({k} - fwd.s) AS want FROM fwd, tot, cap WHERE fwd.s < {k}) f)),
    spot AS (SELECT digest, (SELECT count(*) FROM fwd WHERE fwd.s BETWEEN 1 AND {k - 1} AND fwd.pos < pre.p) AS shard FROM pre), {crc32_sql("rows", "text", "digest")}
    SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM rows JOIN spot USING (digest) JOIN crcs USING (digest)"""
